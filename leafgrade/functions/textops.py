"""Text Columns (C1-C25, F1, F7, F8-style tests).

The reference mixes three runtimes whose ``trim``, ``\\s`` and ``\\W`` differ;
each function names the character classes it needs instead of relying on the
engine's defaults.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafgrade.functions.arrays import let

# Character classes of the three source runtimes.
JAVA_TRIM = r"\x00-\x20"
JAVA_SPACE = r" \t\n\x0B\f\r"
JS_SPACE = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
PY_SPACE = r"\t\n\x0B\f\r\x1C-\x1F \u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
JAVA_BLANK = r"\t\n\x0B\f\r\x1C-\x1F \u1680\u2000-\u2006\u2008-\u200A\u2028\u2029\u205F\u3000"
# Texts made of these characters only are already in composed form.
ALREADY_COMPOSED = r"^[\u0000-\u02FF\u2010-\u2027\u2030-\u205E]*$"


# Spaces of a text that are not single blanks. The outer class is cheap and turns down nearly all other characters
# before the long list of spaces is gone through.
_JS_ANY = rf"[[^!-~\u00A1-\u167F\u3001-\uFEFE]&&[{JS_SPACE}]]"
ODD_SPACES = rf" {_JS_ANY}+|[[^ -~\u00A1-\u167F\u3001-\uFEFE]&&[{JS_SPACE}]]{_JS_ANY}*"
# Single blanks before a punctuation mark, of dots only the last of a row; then repeated marks.
LOOSE_BLANK = r" (?=[,;:!?]|\.(?!\.))"
REPEATED_MARK = r"([!?])\1+"


@lru_cache(maxsize=None)
def members(cls: str) -> str:
    """The characters of a class written for regular expressions (none is outside the basic plane)."""
    return "".join(re.findall(f"[{cls}]", "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, 0x10000)))))


def quoted(chars: str) -> str:
    """An SQL literal of the characters."""
    return "'" + "".join(f"\\u{ord(c):04X}" for c in chars) + "'"


def strip_class(c: Column, cls: str) -> Column:
    """Without the characters of the class at both ends. No regular expression: those try every place of a long text for its end."""
    return F.btrim(c, F.lit(members(cls)))


def js_trim(c: Column) -> Column:
    return strip_class(c, JS_SPACE)


def py_strip(c: Column) -> Column:
    return strip_class(c, PY_SPACE)


def java_trim(c: Column) -> Column:
    return strip_class(c, JAVA_TRIM)


@F.pandas_udf(T.StringType())
def _compose(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def nfc(c: Column) -> Column:
    """Unicode composition (D3). Only texts that may change are sent to Python."""
    return F.coalesce(_compose(F.when(~c.rlike(ALREADY_COMPOSED), c)), c)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _compose_each(arrays: pd.Series) -> pd.Series:
    form = unicodedata.normalize
    return arrays.map(lambda a: [None if t is None else form("NFC", t) for t in a], na_action="ignore")


def nfc_each(texts: Column) -> Column:
    """Unicode composition of every text of an array, with one Python value per row at most."""
    needed = F.exists(texts, lambda t: ~t.rlike(ALREADY_COMPOSED))
    return F.coalesce(_compose_each(F.when(needed, texts)), texts)


def normalize_answer(c: Column, case_sensitive=False, punctuation_required=False, compose: bool = True) -> Column:
    """The strict grader's text form. Umlauts and sharp s are never folded."""
    t = nfc(c) if compose else c
    t = F.regexp_replace(java_trim(t), f"[{JAVA_SPACE}]+", " ")
    t = F.translate(t, "\u201e\u201c\u201a\u2018\u2019\u00b4`\u2013\u2014\u2015", "\"\"'''''---")
    stripped = java_trim(F.regexp_replace(t, r"[.!?:;,]+$", ""))
    t = _pick(punctuation_required, t, stripped)
    return _pick(case_sensitive, t, F.lower(t))


def normalize_for_comparison(c: Column, case_sensitive=False, compose: bool = True) -> Column:
    """The reader's text form; keeps punctuation, acute, grave and the low single quote."""
    t = nfc(c) if compose else c
    t = F.regexp_replace(js_trim(t), ODD_SPACES, " ")
    t = F.translate(t, "\u201e\u201c\u2019\u2018\u2013\u2014", "\"\"''--")
    return _pick(case_sensitive, t, F.lower(t))


def _pick(flag, if_true: Column, if_false: Column) -> Column:
    if isinstance(flag, Column):
        return F.when(F.coalesce(flag, F.lit(False)), if_true).otherwise(if_false)
    return if_true if flag else if_false


def repair_mojibake(c: Column) -> Column:
    """Undo UTF-8 text that was read as Latin-1; anything unclear stays as it is."""
    latin = c.rlike(r"^[\u0000-\u00FF]*$") & c.rlike(r"[\u0080-\u00FF]")
    raw = F.encode(F.when(latin, c).otherwise(F.lit("")), "ISO-8859-1")
    again = F.try_validate_utf8(raw.cast("string"))
    return F.when(latin & again.isNotNull() & ~again.rlike(r"[\x00-\x1F]"), again).otherwise(c)


def is_blank(c: Column, cls: str = JS_SPACE) -> Column:
    """Null, empty or whitespace only."""
    return c.isNull() | c.rlike(f"^[{cls}]*$")


def meaningful_text(text: Column) -> Column:
    """F1 (text part): more than one character and not only digits and ASCII non-word characters."""
    t = js_trim(text)
    return (F.length(t) > 1) & t.rlike("[A-Za-z]")


def meaningful_span(text: Column, confidence: Column) -> Column:
    """confident enough and meaningful. A text of umlauts only is not meaningful."""
    return F.coalesce((confidence >= 0.55) & meaningful_text(text), F.lit(False))


def confident(confidence: Column, floor: float = 0.5) -> Column:
    """F2: evidence floor (0.90 marks low-confidence warnings)."""
    return F.coalesce(confidence >= floor, F.lit(False))


def digit_span(text: Column, width: Column) -> Column:
    """a small standalone row number."""
    return py_strip(text).rlike(r"^\d{1,2}$") & (width <= 0.04)


def valid_header_title(title: Column) -> Column:
    """reads like a topic label: no leading digit, no long dashes, no slash."""
    return F.coalesce((title != "") & ~title.rlike(r"^\d") & ~title.rlike("[\u2014\u2013/]"), F.lit(False))


def unit_candidate(text: Column) -> Column:
    """unit number 1..99 after dropping trailing dots, else null."""
    digits = F.regexp_replace(py_strip(text), r"\.+$", "")
    n = F.when(digits.rlike(r"^\d+$"), digits).try_cast("int")
    return F.when(n.between(1, 99), n)


# ---- reading text out of spans -------------------------------------------------

def tidy_span_text(joined: Column) -> Column:
    """C4 (text part): collapse spaces, drop spaces before punctuation, squeeze repeated ! and ?."""
    # once all spaces are single blanks, the later patterns need not list them, and no blank is left before a mark that repeats
    t = F.regexp_replace(joined, ODD_SPACES, " ")
    t = F.regexp_replace(t, LOOSE_BLANK, "")
    t = F.regexp_replace(t, REPEATED_MARK, "$1")
    return let(lambda v: F.when(v != "", v), F.btrim(t))


def span_text_array(spans: Column) -> Column:
    """C4: array of {id, y, x, text} structs to one reading-order text (null if empty).

    Duplicated ids are expected to be gone; pieces are trimmed and empty ones dropped.
    """
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["y"], s["x"], s["idx"], s["text"])))
    pieces = F.filter(F.transform(ordered, lambda s: js_trim(s["text"])), lambda t: t != "")
    return tidy_span_text(F.array_join(pieces, " "))


def fill_prompt_label(prompt: Column) -> Column:
    """Leading item label such as ``a)`` or ``3.`` (null without one)."""
    return let(lambda v: F.when(v != "", v), F.regexp_extract(js_trim(prompt), r"^((?:[A-Za-z]|\d+)[.)])", 1))


def fill_prompt_text(prompt: Column) -> Column:
    """Prompt without its label and repeated copies of it."""
    def rest(t: Column, label: Column) -> Column:
        cut = F.regexp_replace(t, F.concat(F.lit(r"^(?:\Q"), label, F.lit(rf"\E[{JS_SPACE}]*)+")), F.lit(""))
        return F.when(label.isNull(), t).otherwise(let(lambda v: F.when(v != "", v), cut))
    return let(lambda p: F.when(p.isNull() | (p == ""), None).otherwise(let(rest, js_trim(p), fill_prompt_label(p))), prompt)


# Words of an example, then words of an instruction.
VARIANT_WORDS = ("beispiel|example|zum beispiel", "schreiben|ergänzen|ordnen|verbinden|wählen|markieren|lesen|bilden")


def context_variant(text: Column) -> Column:
    """Example, instruction or theory, by German keywords with ASCII word borders."""
    word = r"(?iu)(?<![A-Za-z0-9_])(?:%s)(?![A-Za-z0-9_])"
    example, instruction = VARIANT_WORDS
    return F.when(text.rlike(word % example), "example").when(text.rlike(word % instruction), "instruction").otherwise("theory")


# ---- fragments, items and alternatives -----------------------------------------

# Sentence-final abbreviations that keep their dot.
ABBREVIATIONS = ["usw", "bzw", "etc", "evtl", "u", "d", "s", "z", "b", "nr", "ca", "uä"]
SEPARATORS = "\u2022\u00b7"


def split_fragments(text: Column, separators: str = SEPARATORS) -> Column:
    """Trimmed, non-empty pieces between printed separators."""
    return F.filter(F.transform(F.split(text, f"[{separators}]"), py_strip), lambda p: p != "")


def separator_count(text: Column, separators: str = SEPARATORS) -> Column:
    """Number of separator characters."""
    return F.size(F.split(text, f"[{separators}]")) - 1


def split_terminal_punctuation(fragments: Column) -> Column:
    """Trailing ``.!?`` becomes its own item unless the stem is empty or an abbreviation."""
    def pieces(fragment: Column) -> Column:
        mark = F.regexp_extract(fragment, r"[.!?]+$", 0)
        stem = F.substring(fragment, F.lit(1), F.length(fragment) - F.length(mark))
        keep = (mark == "") | (stem == "") | stem.contains(".") | F.lower(stem).isin(ABBREVIATIONS)
        return F.when(keep, F.array(fragment)).otherwise(F.array(stem, mark))

    # most fragments end in a letter, which the last byte tells
    ends = lambda f: f.endswith(".") | f.endswith("!") | f.endswith("?")
    return F.flatten(F.transform(fragments, lambda f: F.when(ends(f), pieces(f)).otherwise(F.array(f))))


NUMBERED = r"(?<!\d)(\d{1,2})\.\s*"


def split_numbered_items(text: Column) -> Column:
    """Numbered answer items, or null when the split is not certain."""
    mark = "\u0001"

    def clean(p: Column) -> Column:
        p = F.replace(p, F.lit("|"), F.lit(" "))
        p = F.regexp_replace(p, r"-\s+(?=[a-zäöüß])", "")
        p = F.replace(p, F.lit("?"), F.lit(""))
        return py_strip(F.regexp_replace(py_strip(p), r"^[ \t\u2013\u2014/\-=|·]+|[ \t\u2013\u2014/\-=|·]+$", ""))

    def accept(parts: Column) -> Column:
        fragments = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
        readable = (F.size(parts) >= 3) & ~F.exists(fragments, lambda p: p.contains("\ufffd"))
        return F.when(readable, let(lambda items: F.when(~F.exists(items, lambda p: p == ""), items), F.transform(fragments, clean)))

    return let(accept, F.split(F.regexp_replace(text, NUMBERED, mark), mark))


def last_numbered_item(text: Column) -> Column:
    """Number of the last ``N.`` marker in the text (null without one)."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(NUMBERED), F.lit(1)), F.lit(-1)).cast("int")


def infer_kind(title: Column) -> Column:
    """Answer-key kind from an exercise title; rules apply in order."""
    t = F.lower(title)
    return (
        F.when(t.rlike("relativsatz|nebensatz|konnektor|vergleich|partizip|adjektiv|präposition"), "FillBlank")
        .when(t.rlike("zuordnen|matching"), "Matching")
        .when(t.rlike("satzstellung|satzbau|wortstellung|ordnung"), "SentenceOrdering")
        .otherwise("FillBlank")
    )


def parse_pairs(text: Column) -> Column:
    """C11: all ``<number><A-F>`` pairs, as {leftLabel, rightLabel} structs.

    A dash can never be part of a pair, so splitting at dashes first changes nothing.
    """
    found = F.regexp_extract_all(text, F.lit(r"(\d+[A-F])"), F.lit(1))
    return F.transform(found, lambda p: F.struct(
        F.substring(p, F.lit(1), F.length(p) - 1).alias("leftLabel"),
        F.right(p, F.lit(1)).alias("rightLabel"),
    ))


def extraction_pairs(text: Column) -> Column:
    """C11 on the extraction side: fewer than two pairs is no matching answer."""
    return let(lambda pairs: F.when(F.size(pairs) >= 2, pairs), parse_pairs(text))


def expected_pairs(expected_value: Column) -> Column:
    """Expected pairs from ``left=right;...`` text; later parts of a segment are dropped."""
    segments = F.filter(F.transform(F.split(expected_value, "[;,]"), js_trim), lambda s: s != "")

    def pair(s: Column) -> Column:
        parts = F.when(s.contains("="), F.split(s, "=")).when(s.contains("->"), F.split(s, "->")).otherwise(
            F.split(s, "-"))
        return F.struct(
            js_trim(F.get(parts, F.lit(0))).alias("leftLabel"), js_trim(F.get(parts, F.lit(1))).alias("rightLabel"),
        )
    pairs = F.transform(segments, pair)
    return F.filter(pairs, lambda p: (F.coalesce(p["leftLabel"], F.lit("")) != "")
                    & (F.coalesce(p["rightLabel"], F.lit("")) != ""))


def parse_matching_answer(value: Column) -> Column:
    """Learner pairs left -> right; only non-empty JSON *string* values count, else empty."""
    as_map = F.try_variant_get(F.try_parse_json(value), "$", "map<string,variant>")
    strings = F.map_filter(as_map, lambda k, v: F.schema_of_variant(v) == "STRING")
    texts = F.transform_values(strings, lambda k, v: F.try_variant_get(v, "$", "string"))
    empty = F.map_filter(F.create_map(F.lit(""), F.lit("")), lambda k, v: F.lit(False))
    return F.coalesce(F.map_filter(texts, lambda k, v: v != ""), empty)


def parse_ordered_answer(value: Column) -> Column:
    """C14: comma list of item ids without empties (never null)."""
    return F.filter(F.split(F.coalesce(value, F.lit("")), ","), lambda s: s != "")


def order_position(ordered: Column, item: Column) -> Column:
    """C14: 1-based position or null."""
    p = F.array_position(ordered, item)
    return F.when(p > 0, p)


def joined_sentence(pieces: Column) -> Column:
    """C14: pieces joined by spaces; a lone punctuation mark sticks to the piece before it."""
    marked = F.transform(pieces, lambda p, i: F.when(
        (i > 0) & ~js_trim(p).isin(".", ",", "!", "?", ";", ":"), F.concat(F.lit(" "), js_trim(p))
    ).otherwise(js_trim(p)))
    return F.array_join(marked, "")


def unused_items(items: Column, ordered: Column) -> Column:
    """C14: items (in print order) not placed yet."""
    return F.filter(items, lambda i: ~F.array_contains(ordered, i))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, f"[{PY_SPACE}]+"), lambda w: w != "")


def complex_sentence(text: Column) -> Column:
    """More than six words or a listed connector."""
    return (F.size(_words(text)) > 6) | F.lower(text).rlike(
        "sowohl|weder|entweder|nicht nur|je mehr|desto|umso|bevor")


def comma_separated(text: Column) -> Column:
    """Reads like a short list."""
    parts = F.split(text, ",")
    return (F.size(parts) >= 2) & (F.size(_words(text)) <= 15) & F.forall(parts, lambda p: F.size(_words(p)) <= 5)


def answer_alternatives(items: Column) -> Column:
    """{primary, alternatives} of an answer line; the first matching separator decides."""
    def split(t: Column) -> Column:
        dash = t.contains("\u2014") & ~complex_sentence(t)
        slash = t.contains("/") & (F.length(t) < 200)
        comma = t.contains(",") & comma_separated(t)
        by_comma = F.filter(F.transform(F.split(t, ","), py_strip), lambda p: p != "")
        parts = (F.when(dash, F.split(t, "\\s*\u2014\\s*")).when(slash, F.split(t, "/")).when(comma, by_comma).otherwise(F.array(t)))
        return F.transform(parts, py_strip)

    def name(parts: Column) -> Column:
        rest = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
        return F.struct(F.get(parts, F.lit(0)).alias("primary"), F.filter(rest, lambda p: p != "").alias("alternatives"))

    return let(lambda t: let(name, split(t)), items)


# Short words that are never a sign of corruption.
SHORT_WORDS = [
    "a", "b", "c", "d", "e", "f", "A", "B", "C", "D", "E", "F", "is", "es", "er", "sie", "du", "da", "um", "an",
    "in", "im", "am", "zu", "so", "ja", "ne", "ob", "je", "1", "2", "3", "4", "5", "6", "7", "8", "9",
]


def looks_corrupted(text: Column) -> Column:
    """C20: a very short unknown piece holds a control character."""
    odd = F.exists(_words(text), lambda w: (F.length(w) <= 2) & ~w.rlike(r"^\d+$") & ~w.isin(SHORT_WORDS)
                   & w.rlike(r"[\x00-\x1F\x7F-\u00A0]"))
    return (F.length(text) >= 2) & odd


def low_confidence_warning(spans: Column) -> Column:
    """C20: ``low_ocr_confidence`` note over {text, confidence} spans below 0.90, or null."""
    low = F.filter(spans, lambda s: s["confidence"] < 0.90)
    notes = F.transform(low, lambda s: F.concat(s["text"], F.lit("="), fixed(s["confidence"], 2, True)))
    return F.when(F.size(low) > 0, F.concat(F.lit("low_ocr_confidence: "), F.array_join(notes, ",")))


# ---- ids, hashes, requests -----------------------------------------------------

def scaled_whole(v: Column, digits: int, half_even: bool) -> Column:
    """|v| times 10**digits as a whole number, rounded on the exact binary value.

    The value is split into two short halves, so the power of ten times each
    half is exact and the comparison with one half cannot be off.
    """
    scale = float(10**digits)
    a = F.abs(v.cast("double"))
    wide = a * 134217729.0
    high = wide - (wide - a)
    whole = F.floor(a * scale)
    over = ((high * scale - whole) - 0.5) + (a - high) * scale
    up = (over > 0) | ((over == 0) & (whole % 2 == 1)) if half_even else over >= 0
    return whole + up.cast("long")


def round_exact(v: Column, digits: int = 4) -> Column:
    """Rounds a double half-even on its binary value (what Python's ``round`` gives)."""
    n = scaled_whole(v, digits, True) / F.lit(float(10**digits))
    return F.when(v < 0, -n).otherwise(n)


def fixed(v: Column, digits: int, half_even: bool = False) -> Column:
    """Text with that many decimals, rounded on the binary value, half-up or half-even."""
    n = scaled_whole(v, digits, half_even)
    text = F.concat(F.floor(n / 10**digits).cast("string"), F.lit("."), F.lpad((n % 10**digits).cast("string"), digits, "0"))
    return F.when((v < 0) & (n > 0), F.concat(F.lit("-"), text)).otherwise(text)


def fixed4(v: Column) -> Column:
    """Four decimals, rounded half-up on the exact binary value (what browsers print)."""
    return fixed(v, 4)


def fingerprint(schema_version: Column, method: Column, bbox: Column, *extra: Column, group: Column | None = None) -> Column:
    """Identity of a printed interaction: schema|method|[group|]x|y|w|h[|extra...]."""
    parts = [schema_version, F.coalesce(method, F.lit(""))]
    if group is not None:
        parts.append(F.coalesce(group, F.lit("")))
    parts += [fixed4(bbox["x"]), fixed4(bbox["y"]), fixed4(bbox["width"]), fixed4(bbox["height"])]
    parts += [F.coalesce(e.cast("string"), F.lit("")) for e in extra]
    return F.concat_ws("|", *parts)


def cache_key(provider, model, prompt_version, action: Column, book_id: Column, page: Column, exercise: Column,
              language: Column, answer: Column, question: Column, selection: Column | None = None) -> Column:
    """C17: sha256 over the eleven parts that make two assistance requests the same."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    none = F.lit("")
    answer_hash = F.when(action == "check", F.sha2(F.lower(java_trim(F.coalesce(answer, none))), 256)).otherwise(none)
    question_hash = F.when(action == "ask", F.sha2(java_trim(F.coalesce(question, none)), 256)).otherwise(none)
    where = none if selection is None else F.coalesce(F.concat_ws(
        ",", *[selection[p].cast("string") for p in ("x", "y", "width", "height")]), none)
    if selection is not None:
        where = F.when(selection.isNull(), none).otherwise(where)
    return F.sha2(F.concat_ws(
        "|", as_col(provider), as_col(model), as_col(prompt_version), action, book_id, page.cast("string"),
        F.coalesce(exercise, none), F.coalesce(language, none), answer_hash, question_hash, where), 256)


VERDICTS = ["likely_correct", "likely_incorrect", "uncertain"]


def validate_model_output(action: Column, raw: Column, max_chars: int = 4000) -> Column:
    """{content, verdict, category} of a raw model response; category is ok or invalid_output.

    One code fence is stripped and the JSON read; otherwise the text from the
    first ``{`` to the last ``}`` is tried.
    """
    trimmed = py_strip(raw)
    fenced = F.regexp_extract(trimmed, rf"(?s)^```(?:json)?[{PY_SPACE}]*(.*?)[{PY_SPACE}]*```$", 1)
    is_fenced = trimmed.rlike(r"(?s)^```.*```$") & (F.length(trimmed) >= 6)
    first = F.try_parse_json(F.when(is_fenced, py_strip(fenced)).otherwise(trimmed))
    braces = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    second = F.try_parse_json(F.when(braces != "", braces))
    data = F.coalesce(first, second)
    is_object = F.schema_of_variant(data).startswith("OBJECT")
    content_node = F.try_variant_get(data, "$.content", "variant")
    content = F.when(is_object & (F.schema_of_variant(content_node) == "STRING"),
                     py_strip(F.try_variant_get(data, "$.content", "string")))
    verdict_node = F.try_variant_get(data, "$.verdict", "variant")
    verdict = F.when(is_object & (F.schema_of_variant(verdict_node) == "STRING"),
                     F.try_variant_get(data, "$.verdict", "string"))
    good = F.coalesce((content != "") & ((action != "check") | F.coalesce(verdict.isin(VERDICTS), F.lit(False))),
                      F.lit(False))
    return F.struct(
        F.when(good, F.substring(content, 1, max_chars)).alias("content"),
        F.when(good & (action == "check"), verdict).alias("verdict"),
        F.when(good, "ok").otherwise("invalid_output").alias("category"),
    )


def truncate(c: Column, n: int) -> Column:
    """T5: at most ``n`` characters."""
    return F.substring(c, 1, n)


def page_from_raster_path(path: Column) -> Column:
    """Page number of a raster file name, null when it has none."""
    return F.regexp_extract(path, r"-page(\d+)-\d+dpi\.png$", 1).try_cast("int")


def page_from_span_id(span_id: Column) -> Column:
    """Page number inside ``span-<n>-...``; anything below 1 or unreadable counts as 1."""
    n = F.regexp_extract(span_id, r"^span-([^-]*)", 1).try_cast("int")
    return F.when(n >= 1, n).otherwise(F.lit(1))


def process_action(status: Column, has_analysis: Column) -> Column:
    """What the reader offers for a page."""
    return F.when(status.isNull() | (status != "READY"), "process").when(has_analysis, "update").otherwise("none")


def usage_date(ts: Column, zone: str = "UTC") -> Column:
    """Local calendar day of an instant (the session zone is UTC)."""
    return F.to_date(ts if zone == "UTC" else F.from_utc_timestamp(ts, zone))


# ---- labels of matching items --------------------------------------------------

LEFT_STANDALONE = r"^\d{1,2}\.?$"
RIGHT_STANDALONE = r"^[A-ZÄÖÜ]$"
