"""Answer-key extraction.

Spans are grouped by page once. Lines, columns and patterns are array
expressions of the page's row; only the reading state (current section, pending
marker, last productive unit) crosses lines, as a fold over the row's lines that
decides the role of each. Entries leave the row complete.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafgrade import schemas as SC
from leafgrade.functions import textops as X
from leafgrade.functions.arrays import bind, let, settle
from leafgrade.operators.cluster import PAGE

# Line patterns of the solution section.
HEADER = r"^(\d{1,3})\s+(?!\d)(.+)$"
SUB_SPACED = r"^(\d{1,2}[a-z]?)\s+(\d.+)$"
SUB_TIGHT = r"^(\d{1,2}[a-z]?)(\d.+)$"
NUMBERED_LINE = r"^(\d+)[.)]\s+(.+)$"
STANDALONE = r"^\d{1,3}$"
FOOTER_Y = 0.9
SAME_ROW_Y = 0.006


def build_lines(spans: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """W6 + A2: one row per page with its text lines: y, x, text (by x), confidence, spans; and its source_page.

    Spans in (y, x) order form a line as long as their line id stays the same.
    """
    keys = list(keys)
    clean = spans.withColumn("text", X.py_strip(F.coalesce("text", F.lit("")))).where("text <> ''").select(*keys, F.struct(
        F.coalesce("bbox.y", F.lit(0.0)).alias("y"), F.coalesce("bbox.x", F.lit(0.0)).alias("x"), "idx", "text",
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce(F.when(F.col("parent_line_id") != "", F.col("parent_line_id")), F.col("id")).alias("line_id"),
        "id").alias("s"))
    first_id = F.min(F.when(F.col("s.id").startswith("span-"), F.struct("s.idx", "s.id")))
    pages = clean.groupBy(*keys).agg(F.sort_array(F.collect_list("s")).alias("_s"), first_id.alias("_first"))
    starts = "filter(sequence(0, size(_s) - 1), i -> i = 0 OR _s[i].line_id <> _s[i - 1].line_id)"
    parts = bind("c", starts, "transform(c, (f, i) -> slice(_s, f + 1, coalesce(get(c, i + 1), size(_s)) - f))")
    by_x = "array_sort(transform(g, s -> struct(s.x AS x, s.y AS y, s.idx AS idx, s.text AS text)))"
    line = (f"struct(i AS line, array_min(transform(g, s -> s.y)) AS y, array_min(transform(g, s -> s.x)) AS x, array_join(transform({by_x}, s -> s.text), ' ') AS text, "
            "aggregate(g, 0D, (a, s) -> a + s.confidence) / size(g) AS confidence, "
            "transform(g, s -> struct(s.y AS y, s.x AS x, s.idx AS idx, s.text AS text, s.confidence AS confidence)) AS spans)")
    return pages.select(*keys, F.expr(f"transform({parts}, (g, i) -> {line})").alias("lines"),
                        F.coalesce(X.page_from_span_id(F.col("_first.id")), F.lit(1)).alias("source_page"))


def column_order(pages: DataFrame, tolerance: float = 0.15) -> DataFrame:
    """The lines of each page in reading order; with two or more columns of three lines, smaller columns are dropped.

    A line joins the first column whose seed is closer than ``tolerance``, else it seeds a column.
    """
    seeds = f"aggregate(lines, CAST(array() AS array<double>), (a, l) -> CASE WHEN exists(a, s -> abs(s - l.x) < {tolerance}D) THEN a ELSE array_append(a, l.x) END)"
    of = f"transform(lines, l -> array_position(transform(seeds, s -> abs(s - l.x) < {tolerance}D), true))"
    columns = "transform(sequence(1, greatest(size(seeds), 1)), c -> filter(lines, (l, i) -> of[i] = c))"
    df = pages.withColumn("_columns", F.expr(bind("seeds", seeds, bind("of", of, columns))))
    df = df.selectExpr("*", "size(filter(_columns, c -> size(c) >= 3)) >= 2 AS _split")
    split = ("flatten(transform(array_sort(transform(filter(_columns, c -> size(c) >= 3), (c, i) -> struct(array_min(transform(c, l -> l.x)) AS x, i AS i, "
             "array_sort(transform(c, l -> struct(l.y AS y, l.line AS line, l AS l))) AS c))), e -> transform(e.c, l -> l.l)))")
    return df.withColumn("lines", F.expr(f"CASE WHEN _split THEN {split} ELSE lines END")).drop("_columns", "_split")


def _facts(pages: DataFrame) -> DataFrame:
    """Everything the reading state asks about a line and its follower."""
    def own(line: Column) -> Column:
        t = line["text"]
        number, title = F.regexp_extract(t, HEADER, 1), F.regexp_extract(t, HEADER, 2)
        sub, tight, numbered, header = t.rlike(SUB_SPACED), t.rlike(SUB_TIGHT), t.rlike(NUMBERED_LINE), t.rlike(HEADER)
        part = lambda n: F.when(sub, F.regexp_extract(t, SUB_SPACED, n)).when(tight, F.regexp_extract(t, SUB_TIGHT, n)).when(
            numbered, F.regexp_extract(t, NUMBERED_LINE, n))
        first_word = F.get(F.split(t, r"\s+"), F.lit(0))
        fields = {
            "starts": t.rlike("(?iu)^Lösungen$"), "on_page": line["y"] <= FOOTER_Y,
            "unit_in_header": F.when(X.valid_header_title(title), X.unit_candidate(number)), "header_title": title, "header_shape": header,
            "standalone": t.rlike(STANDALONE), "unit_alone": X.unit_candidate(t), "title_ok": X.valid_header_title(t),
            "sub": sub, "tight": tight, "numbered": numbered, "marker": part(1), "items_text": part(2),
            "line_number": F.when(numbered, F.regexp_extract(t, NUMBERED_LINE, 1)).try_cast("int"), "last_number": X.last_numbered_item(t).cast("int"),
            "continues": ~sub & ~header & ~t.rlike(r"^\d{1,4}$") & ~F.regexp_replace(first_word, r"\.+$", "").rlike(r"^\d+$"),
            "number_text": F.regexp_replace(X.py_strip(t), r"\.+$", "")}
        return F.struct(line["y"].alias("y"), t.alias("text"), *[c.alias(n) for n, c in fields.items()])

    df = pages.withColumn("_own", F.transform("lines", own))
    near = "coalesce(r.standalone AND abs(r.y - n.y) <= %sD, false)" % SAME_ROW_Y
    followed = f"""struct(
        CASE WHEN near AND n.title_ok AND NOT n.sub THEN r.unit_alone END AS unit_with_next, n.text AS next_title,
        near AND r.on_page AND NOT n.header_shape AND NOT n.sub AND NOT n.tight AND NOT n.title_ok AS marks_next,
        CASE WHEN n.standalone AND abs(r.y - n.y) <= {SAME_ROW_Y}D THEN n.number_text END AS marker_after, r AS r)"""
    return df.selectExpr("*", f"transform(_own, (r, i) -> {bind('n', 'get(_own, i + 1)', bind('near', near, followed))}) AS _facts")


#: What the reading state carries from line to line, and the role that it gives to lines.
_ROLE = "struct<pos:int,entry:int,is_entry:boolean,unit_number:int,title:string,marker:string,ordinal:int,bare:boolean>"
_STATE = {"inside": "boolean", "unit": "int", "title": "string", "productive": "int", "pending": "string", "ordinal": "int", "entry": "int",
          "last_number": "int", "skip": "int", "pos": "int", "roles": f"array<{_ROLE}>"}


def _roles() -> str:
    """The role of every line that has one, as a fold over the facts of a page.

    A section opens with a number above the last productive unit; a lone number
    marks the next line, or the line before it; a line that continues the
    numbering, or that begins like none of these, goes to the entry before it.
    """
    start = {"inside": "false", "ordinal": "0", "entry": "-1", "skip": "0", "pos": "0", "roles": "array()"}
    opens = "{0} IS NOT NULL AND f.r.on_page AND (a.productive IS NULL OR {0} > a.productive)".format
    matched = "((f.r.sub OR f.r.tight OR f.r.numbered) AND f.r.on_page)"
    ahead = "(CASE WHEN a.pending IS NULL THEN f.marker_after END)"
    act = f"""CASE WHEN a.skip > 0 THEN 'skip' WHEN NOT a.inside THEN 'outside' WHEN {opens('f.r.unit_in_header')} THEN 'header' WHEN {opens('f.unit_with_next')} THEN 'titled'
        WHEN a.unit IS NULL THEN 'none' WHEN f.marks_next THEN 'mark'
        WHEN a.pending IS NULL AND f.marker_after IS NULL AND f.r.numbered AND coalesce(f.r.line_number = a.last_number + 1, false) THEN 'more'
        WHEN {matched} OR a.pending IS NOT NULL OR f.marker_after IS NOT NULL THEN 'entry' WHEN f.r.continues AND a.entry >= 0 THEN 'more' ELSE 'none' END"""
    role = f"""named_struct('pos', a.pos, 'entry', CASE act WHEN 'entry' THEN a.entry + 1 ELSE a.entry END, 'is_entry', act = 'entry', 'unit_number', a.unit, 'title', a.title,
        'marker', CASE act WHEN 'entry' THEN coalesce(a.pending, {ahead}, CASE WHEN {matched} THEN f.r.marker END) END,
        'ordinal', CASE act WHEN 'entry' THEN a.ordinal + 1 ELSE a.ordinal END, 'bare', act = 'entry' AND NOT {matched})"""
    step = {
        "inside": "a.inside OR coalesce(act = 'outside' AND f.r.starts, false)",
        "unit": "CASE act WHEN 'header' THEN f.r.unit_in_header WHEN 'titled' THEN f.unit_with_next ELSE a.unit END",
        "title": "CASE act WHEN 'header' THEN f.r.header_title WHEN 'titled' THEN f.next_title ELSE a.title END",
        "productive": "CASE act WHEN 'entry' THEN a.unit ELSE a.productive END",
        "pending": "CASE act WHEN 'mark' THEN f.r.number_text WHEN 'entry' THEN NULL ELSE a.pending END",
        "ordinal": "CASE WHEN act IN ('header', 'titled') THEN 0 WHEN act = 'entry' THEN a.ordinal + 1 ELSE a.ordinal END",
        "entry": "CASE act WHEN 'entry' THEN a.entry + 1 ELSE a.entry END",
        "last_number": "CASE act WHEN 'entry' THEN f.r.last_number WHEN 'more' THEN coalesce(f.r.last_number, a.last_number) ELSE a.last_number END",
        "skip": f"CASE act WHEN 'skip' THEN a.skip - 1 WHEN 'titled' THEN 1 WHEN 'entry' THEN CASE WHEN {ahead} IS NOT NULL THEN 1 ELSE 0 END ELSE 0 END",
        "pos": "a.pos + 1",
        "roles": f"CASE WHEN act IN ('entry', 'more') THEN array_append(a.roles, {role}) ELSE a.roles END",
    }
    zero = ", ".join(f"'{n}', CAST({start.get(n, 'NULL')} AS {t})" for n, t in _STATE.items())
    body = "named_struct(" + ", ".join(f"'{n}', CAST({step[n]} AS {t})" for n, t in _STATE.items()) + ")"
    return f"aggregate(_facts, named_struct({zero}), (a, f) -> {bind('act', act, body)}, a -> a.roles)"


def parse_solution_pages(spans: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """K1: answer-key entries of every page; the reading state starts afresh on each page.

    The spans are grouped by page once; lines, columns, facts, the fold and the
    assembly of entries are work inside the page's row.
    """
    keys = list(keys)
    df = settle(_facts(column_order(build_lines(spans, keys))).selectExpr(*keys, "source_page", "lines", "_facts", f"{_roles()} AS _roles"))
    more = ("transform(filter(_roles, c -> c.entry = e.entry AND NOT c.is_entry), c -> "
            "struct(lines[c.pos].text AS text, exists(lines[c.pos].spans, s -> s.confidence < 0.90D) AS low))")
    entry = ("struct(e.unit_number AS unit_number, e.title AS title, e.marker AS marker, e.ordinal AS ordinal, e.bare AS bare, CAST(e.entry AS bigint) AS entry, "
             f"lines[e.pos].text AS text, _facts[e.pos].r.items_text AS items_text, lines[e.pos].confidence AS confidence, lines[e.pos].spans AS spans, {more} AS more)")
    rows = df.select(*keys, "source_page", F.explode(F.expr(f"transform(filter(_roles, e -> e.is_entry), e -> {entry})")).alias("e"))
    return _assemble(rows, keys)


def _assemble(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Entries with their texts, alternatives, warnings and payloads; ``e.more`` are the lines that continue one."""
    g = rows.withColumn("_items", F.when(F.col("e.bare"), F.col("e.text")).otherwise(F.col("e.items_text")))
    g = g.withColumn("_alt", X.answer_alternatives(F.col("_items"))).withColumn("key_kind", X.infer_kind(F.col("e.title")))
    more = F.col("e.more.text")
    raw = F.array_join(F.concat(F.array("e.text"), more), " | ")
    expected = F.array_join(F.concat(F.array("_alt.primary"), more), " ")
    notes = F.array_compact(F.concat(
        F.array(X.low_confidence_warning(F.col("e.spans")), F.when(X.looks_corrupted(F.col("_items")), "possible_ocr_corruption")),
        F.transform("e.more", lambda c: F.when(c["low"], "continuation_low_confidence"))))
    return g.select(
        *keys, "source_page", F.col("e.unit_number").cast("string").alias("exercise_number"),
        F.col("e.unit_number").alias("unit_number"), F.col("e.marker").alias("marker"),
        X.split_numbered_items(raw).alias("items"), "key_kind", F.col("e.ordinal").alias("ordinal"),
        expected.alias("expected_value"), F.col("_alt.alternatives").alias("alternatives"), raw.alias("raw_text"),
        X.round_exact(F.col("e.confidence")).alias("confidence"), notes.alias("warnings"),
        typed_payload(F.col("key_kind"), F.col("_alt.primary"), F.col("e.text")).alias("payload"),
        F.col("e.entry").alias("entry_index"))


def typed_payload(kind: Column, primary: Column, raw: Column) -> Column:
    """C11 in use: pairs for matching keys (two or more), the plain text for blanks, else null."""
    none = F.lit(None)
    pairs = F.coalesce(X.extraction_pairs(raw), X.extraction_pairs(primary))
    make = lambda t, v, a, p: F.struct(
        F.lit(t).alias("type"), v.cast("string").alias("value"), a.cast("array<string>").alias("alternatives"),
        p.cast(T.ArrayType(SC.PAIR)).alias("pairs"), none.cast("string").alias("modelText"),
        none.cast("string").alias("sourceHint"))
    return F.when(kind == "Matching", let(lambda p: F.when(p.isNotNull(), make("Matching", none, none, p)), pairs)).when(
        kind == "FillBlank", make("Text", primary, F.array().cast("array<string>"), none))


def stub_entries(spans: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """Placeholder parser: one fixed entry per page."""
    none = F.lit(None).cast("string")
    return spans.select(*keys).distinct().select(
        *keys, F.lit(1).alias("source_page"), F.lit("1.1").alias("exercise_number"), F.lit(None).cast("int").alias("unit_number"),
        none.alias("marker"), F.lit(None).cast("array<string>").alias("items"), F.lit("FillBlank").alias("key_kind"),
        F.lit(1).alias("ordinal"), F.lit("Beispielantwort").alias("expected_value"),
        F.array().cast("array<string>").alias("alternatives"), F.lit("").alias("raw_text"), F.lit(0.5).alias("confidence"),
        F.array(F.lit("stub parser — not a real implementation")).alias("warnings"),
        F.lit(None).cast(SC.TYPED_PAYLOAD).alias("payload"), F.lit(0).cast("long").alias("entry_index"))


KeyParser = Callable[[DataFrame], DataFrame]
_PARSERS: dict[str, KeyParser] = {}


def register_key_parser(publisher: str, parser: KeyParser) -> None:
    """Extension point: a publisher name and a function from span table to entry table."""
    _PARSERS[publisher.lower()] = parser


register_key_parser("cornelsen", parse_solution_pages)
register_key_parser("stub", stub_entries)


def extract_answer_key(spans: DataFrame, publisher: str) -> DataFrame:
    """K1 + D1: entries by the publisher's parser."""
    parser = _PARSERS.get(publisher.lower())
    if parser is None:
        raise ValueError(f"Unknown publisher: {publisher}. Available: {sorted(_PARSERS)}")
    return parser(spans)


def source_page_range(entries: DataFrame, keys: Sequence[str] = ("book_id",)) -> DataFrame:
    """``min-max`` or ``n`` of the source pages."""
    lo, hi = F.min("source_page"), F.max("source_page")
    return entries.groupBy(*keys).agg(F.when(lo == hi, lo.cast("string")).otherwise(
        F.concat_ws("-", lo.cast("string"), hi.cast("string"))).alias("source_page_range"))


def key_refresh(versions: DataFrame) -> DataFrame:
    """Current key per book from its extraction log (book_id, version, status, refresh, entries, ...).

    A failed refresh keeps a READY key; any other failure stores FAILED with
    the entries known before. So only the newest READY and the newest plain
    failure matter: two maxima per book, combined on the map side.
    """
    ready = F.col("status") == "READY"
    plain_failure = ~ready & ~F.coalesce("refresh", F.lit(False))
    last = versions.groupBy("book_id").agg(
        F.max_by(F.when(ready, F.struct("version", "entries")), F.when(ready, F.col("version"))).alias("r"),
        F.max(F.when(plain_failure, F.col("version"))).alias("f"))
    kept = F.col("r").isNotNull() & (F.col("f").isNull() | (F.col("f") < F.col("r.version")))
    return last.select("book_id", F.when(kept, "READY").otherwise("FAILED").alias("status"),
                       F.col("r.version").alias("entries_version"), F.col("r.entries").alias("entries"))
