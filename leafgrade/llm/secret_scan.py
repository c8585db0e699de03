"""Secrets: fixed patterns, and credential-context values that would cost many guesses."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgrade.llm.common import shared_table, unused

KINDS = ("assign", "access", "hex", "password")
Span = tuple[str, int, int]

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Words that announce a credential beyond the base pattern.
MORE_WORDS = ("pwd", "passphrase", "passcode", "credential", "private_key", "client_key", "auth_key", "bearer", "pass", "login", *ASSIGN_WORDS)
MORE = re.compile(r"""(?<![A-Za-z])(?:pwd|passphrase|passcode|credentials?|(?:private|client|auth)_key|pass|login|password|passwd|secret|token|api_?key)["']?"""
                  r"""\x20*(?:[:=]|\x20is\x20)\x20*(?:"([^"\s]{4,}+)"|'([^'\s]{4,}+)'|([^\s"',;]{4,}+))|(?<![A-Za-z])bearer\x20+([A-Za-z0-9+/_.=~-]{8,}+)""", re.I | re.A)
IN_URL = re.compile(r"://[^\s/:@]++:([^\s/@]{4,}+)@")
#: The whole value at the value of a base pattern: to the closing quote, if that comes before a blank, or as without quotes.
WHOLE = {'"': re.compile(r'[^"\s]++(?=")'), "'": re.compile(r"[^'\s]++(?=')"), "": re.compile(r"""[^\s"',;]++""")}
RUN = re.compile(r"\S*+")

#: Common parts of passwords, most common first.
COMMON = (
    "password pass admin welcome login user test guest root master secret token key none null true false required optional changeme "
    "default example sample placeholder your here value string dummy hello love dragon monkey sunshine princess football baseball shadow "
    "summer winter spring autumn monday january god money freedom letmein access server data system manager office home star happy "
    "lucky angel flower tiger purple orange banana cookie coffee computer internet the and you for abc xyz unknown empty missing redacted hidden"
).split()
RANK = {w: i + 1 for i, w in enumerate(COMMON)}
LONGEST = max(map(len, COMMON))
#: Words of the documents: lower-cased runs of letters, of 3 to so many of them.
LETTERS = re.compile(r"[^\W\d_]{3,}")
LONGEST_WORD = 32
#: Words that a task counts before it sends them on, and rows of secret values that go to every task.
MOST_WORDS, MOST_BROADCAST_ROWS = 1 << 18, 1_000_000
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
WALKS = "|".join([*ROWS, *(r[::-1] for r in ROWS), "abcdefghijklmnopqrstuvwxyz", "1qaz2wsx3edc4rfv5tgb6yhn7ujm"])
LEET = str.maketrans("4@310$5!7", "aaeiossit")
DATE = re.compile(r"(?:19|20)\d\d([-/.]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/.]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d")


def _alphabet(c: str) -> int:
    return 10 if c.isdigit() else 26 if c.islower() or c.isupper() else 33


class AnyWord:
    """Ranks by which all letters are the first word: no ranks make a value cheaper."""

    @staticmethod
    def get(word: str, other: int | None = None) -> int | None:
        return 1 if word.isalpha() else other


def guess_cost(value: str, ranks: dict[str, int] | type[AnyWord] = RANK, longest: int = LONGEST) -> float:
    """Decimal logarithm of the guesses for a value: the cheapest way to cut it into spans.

    Spans are words up to ``longest`` (rank, times case and look-alike spellings), dates
    (days in two centuries), repeats (alphabet times length), keyboard or
    alphabet walks (starts, directions, length) and brute force (the alphabet
    of each character). Every span after the first costs a factor of two more
    for its kind. Each place looks back a bounded way, so the work is linear.
    """
    n = len(value)
    low, plain = value.lower(), value.lower().translate(LEET)
    if len(low) != n:
        low = plain = value
    ends: dict[int, list[tuple[int, float]]] = {}
    for m in DATE.finditer(value):
        ends.setdefault(m.end(), []).append((m.start(), math.log10(73_000 if len(m.group()) > 4 else 200)))
    best = [0.0] + [math.inf] * n
    same = walk = 0
    for i in range(1, n + 1):
        best[i] = best[i - 1] + math.log10(_alphabet(value[i - 1]))
        step = math.log10(2) if i else 0.0
        for a, cost in ends.get(i, ()):
            best[i] = min(best[i], best[a] + cost + step)
        same = same if i > 1 and value[i - 1] == value[i - 2] else i - 1
        if i - same >= 3:
            best[i] = min(best[i], best[same] + math.log10(_alphabet(value[i - 1]) * (i - same)) + step)
        walk = walk if i > 1 and low[i - 2 : i] in WALKS else i - 1
        if i - walk >= 3:
            best[i] = min(best[i], best[walk] + math.log10(94 * (i - walk)) + step)
        for size in range(3, min(longest, i) + 1):
            for form, extra in ((low, 1), (plain, 8)):
                if rank := ranks.get(form[i - size : i]):
                    case = 1 if value[i - size : i].islower() else 2 if value[i - size : i].istitle() or value[i - size : i].isupper() else 16
                    best[i] = min(best[i], best[i - size] + math.log10(rank * case * extra + 1) + step)
    return best[n]


def whole_values(text: str, starts: list[int]) -> list[tuple[int, int]]:
    """The whole values at the rising ``starts``; a run that holds several starts is read once."""
    out: list[tuple[int, int]] = []
    ends: dict[str, tuple[int, bool]] = {}
    for a in starts:
        for quote in (text[a - 1], "") if text[a - 1] in "\"'" else ("",):
            end, closed = ends.get(quote, (-1, False))
            if end <= a:
                m = WHOLE[quote].match(text, a)
                end, closed = ends[quote] = (m.end(), True) if m else (RUN.match(text, a).end(), False)
            if closed:
                out.append((a, end))
                break
    return out


def is_dear(value: str, least_cost: float) -> bool | None:
    """Whether a value costs ``least_cost``; None if that hangs on the words of the documents."""
    if guess_cost(value) < least_cost:
        return False
    return True if guess_cost(value, AnyWord, LONGEST_WORD) >= least_cost else None


def parts_of(value: str) -> set[str]:
    """The runs of letters in a value, also behind look-alike spellings, that may be words."""
    low = value.lower()
    forms = {low, low.translate(LEET)} if len(low) == len(value) else {value}
    return {p for f in forms for m in LETTERS.finditer(f) for i in range(m.start(), m.end() - 2)
            for j in range(i + 3, min(m.end(), i + LONGEST_WORD) + 1) if (p := f[i:j])}


def propose(text: str) -> tuple[list[Span], list[tuple[int, int]]]:
    """Base spans of a text by start and kind, and the values in credential context by start, longest first."""
    base: list[Span] = []
    values: list[tuple[int, int]] = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found = [m for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
        base += [("assign", *m.span()) for m in found]
        values += whole_values(text, [m.start(2) for m in found])
    base += [("access", *m.span()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    base += [("hex", *m.span()) for m in HEX.finditer(text)]
    values += [m.span(m.lastindex) for m in MORE.finditer(text)] if any(w in low for w in MORE_WORDS) else []
    values += [m.span(1) for m in IN_URL.finditer(text)] if "://" in text else []
    return sorted(base, key=lambda s: (s[1], KINDS.index(s[0]))), sorted(set(values), key=lambda v: (v[0], -v[1]))


def scan(text: str, least_cost: float, dear: set[str] | None = None) -> tuple[list[Span], list[Span]]:
    """Base spans and added ones of a text, both by start and kind.

    Of the values that hang on the words of the documents those in ``dear`` are
    added, or all if it is None.
    """
    base, values = propose(text)
    added: list[Span] = []
    near, covered = 0, 0  # covered: the furthest end of the spans, base or added, that start at or before a
    for a, b in values:
        while near < len(base) and base[near][1] <= a:
            covered = max(covered, base[near][2])
            near += 1
        if b > covered and (dear is None or text[a:b] in dear or guess_cost(text[a:b], AnyWord, LONGEST_WORD) >= least_cost) and guess_cost(text[a:b]) >= least_cost:
            added.append(("password", a, b))
            covered = b
    return base, added


def words_and_values(docs: DataFrame, least_cost: float) -> DataFrame:
    """Rows of two sorts, written: (word, n) of texts without their credential values, in part sums, and (word, null, h) of values that hang on them.

    ``h`` is a hash of the text.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def rows(words, ns, hs) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(ns, pa.int64()), pa.array(hs, pa.int64())], names=["word", "n", "h"])

        def summed(counts: Counter) -> pa.RecordBatch:
            kept = {w: n for w, n in counts.items() if len(w) <= LONGEST_WORD}
            return rows(list(kept), list(kept.values()), [None] * len(kept))

        for batch in batches:
            open_values: list[str] = []
            hashes: list[int] = []
            for t, h in zip(batch.column(0), batch.column(1).to_pylist()):
                text = t.as_py() or ""
                rest, at = [], 0
                for a, b in propose(text)[1]:
                    if b > at:
                        if is_dear(text[a:b], least_cost) is None:
                            open_values.append(text[a:b])
                            hashes.append(h)
                        rest.append(text[at:max(a, at)])
                        at = b
                counts.update(LETTERS.findall(" ".join([*rest, text[at:]]).lower()))
                if len(counts) >= MOST_WORDS:
                    yield summed(counts)
                    counts.clear()
            if open_values:
                yield rows(open_values, [None] * len(hashes), hashes)
        yield summed(counts)

    own = docs.select(F.col("text").cast("string"), F.xxhash64(F.col("text").cast("string")))
    return shared_table(own.mapInArrow(run, "word string, n long, h long"), "secret-words")


def dear_values(docs: DataFrame, least_cost: float) -> DataFrame:
    """Per hash of a text (_h) those of its values (_dear) that cost enough by the words of all documents.

    Words are counted over all documents, outside credential values, so that a
    secret is no word by itself; a word's rank is the number of words counted
    more often, plus one. Only values for which ranks can matter come here;
    their runs of letters are joined with the words. The driver sees one row
    per distinct count.
    """
    found = words_and_values(docs, least_cost)
    held = found.where("h IS NOT NULL").select("h", F.col("word").alias("value")).distinct()
    counts = shared_table(found.where("h IS NULL").groupBy("word").agg(F.sum("n").alias("n")), "secret-counts")
    sizes = sorted(counts.groupBy("n").count().collect(), reverse=True)
    ranks, above = [], 0
    for n, words in sizes:
        ranks.append((n, above + 1))
        above += words
    ranks = F.broadcast(docs.sparkSession.createDataFrame(ranks, "n long, rank long"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0).to_pylist():
                words = ["", *parts_of(value)]  # "" keeps values without letters
                yield pa.RecordBatch.from_arrays([pa.array([value] * len(words)), pa.array(words)], names=["value", "word"])

    parts = held.select("value").distinct().mapInArrow(cut, "value string, word string")
    known = parts.join(counts, "word", "left").join(ranks, "n", "left").groupBy("value").agg(
        F.collect_list(F.when(F.col("rank").isNotNull(), F.struct("word", "rank"))).alias("known"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for value, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = {x["word"]: x["rank"] for x in words}
                keep.append(guess_cost(value, own | {w: min(r, own.get(w, r)) for w, r in RANK.items()}, LONGEST_WORD) >= least_cost)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep, pa.bool_()))], names=["value"])

    dear = known.mapInArrow(judge, "value string")
    return shared_table(held.join(dear, "value").groupBy(F.col("h").alias("_h")).agg(F.collect_set("value").alias("_dear")), "secret-dear")


def with_dear(docs: DataFrame, least_cost: float) -> tuple[DataFrame, str]:
    """The documents with their dear values, and the name of that column, which the documents have not.

    Few rows of values go to every task, more meet the documents in a shuffle.
    """
    h, name = unused(docs, "_h"), unused(docs, "_dear")
    dear = dear_values(docs, least_cost).toDF(h, name)
    dear = F.broadcast(dear) if dear.count() <= MOST_BROADCAST_ROWS else dear
    return docs.join(dear, F.xxhash64(docs["text"].cast("string")) == dear[h], "left").drop(h), name


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_secrets(docs: DataFrame, least_cost: float = 8.0) -> DataFrame:
    """Secrets of every text: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Base spans match fixed patterns and stay. Values that follow a credential
    word, or stand as the password of a URL, are cut into words, dates,
    repeats, keyboard walks and brute-force spans at least cost; words are
    those of all documents by their rank, and common parts of passwords; those of
    10**``least_cost`` guesses or more are added as ``password`` unless another
    span holds them whole, so placeholders stay text. A value is whole, of any
    length, up to its closing quote or a blank. Counts and hash are of base spans;
    ``spans`` has all, by start and kind.

    Null text counts as empty: no spans. Documents with repeated or null doc_id
    each give a row; an empty table gives none. Only doc_id and text are read;
    whole texts are.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t, dear in zip(batch.column(1), batch.column(2).to_pylist()):
                base, added = scan(t.as_py() or "", least_cost, set(dear or ()))
                every = sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0])))
                rows.append((*(sum(s[0] == k for s in base) for k in KINDS[:3]), hashlib.sha256(written(base).encode()).hexdigest(), written(every)))
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    own, dear = with_dear(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), least_cost)
    return own.select("doc_id", "text", dear).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact_secrets(docs: DataFrame, mark: str = "[secret]", least_cost: float = 8.0) -> DataFrame:
    """The documents with every secret replaced by ``mark``; n_chars follows where the column is there.

    Overlapping spans are replaced as one. Texts without secrets and null texts
    stay as they are, and so do all other columns and rows.
    """
    @F.pandas_udf("string")
    def clean(texts, dears):
        def one(text, dear):
            if text is None:
                return None
            out, at = [], 0
            for _, a, b in sorted((s for part in scan(text, least_cost, set(() if dear is None else dear)) for s in part), key=lambda s: s[1]):
                if a >= at:
                    out += [text[at:a], mark]
                at = max(at, b)
            return "".join([*out, text[at:]]) if out else text
        return pd.Series([one(t, d) for t, d in zip(texts, dears)], dtype=object)

    own, dear = with_dear(docs, least_cost)
    out = own.withColumn("text", clean("text", F.col(dear))).select(*[F.col(f"`{c}`") for c in docs.columns])
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
