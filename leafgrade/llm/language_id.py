"""Language identification by bit-sliced Bloom filters that name all languages of an n-gram at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from leafgrade.llm.common import shared_table, slices
from leafgrade.llm.hashing import odd, rolling

SIZES = (3, 4)
#: Hash functions, each with a slice of cells of its own.
DEPTH = 3
#: Bytes of text that a task looks at together.
TOGETHER = 4 << 20
#: Distinct n-grams that a task keeps before it adds equal ones up.
KEPT = 1 << 21


@lru_cache(1)
def _letters() -> np.ndarray:
    """Lower-case code point of every letter, 0 for all else."""
    lower = ((chr(c), chr(c).lower()) for c in range(0x110000))
    return np.fromiter((0 if not a.isalpha() else ord(b) if len(b) == 1 else ord(a) for a, b in lower), np.uint32, 0x110000)


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams of letters, the text of each, and whether a text has letters.

    A word is a run of letters between two marks; n-grams of 3 and 4 signs lie
    in one word with its marks.
    """
    parts = [t or "" for t in texts.to_pylist()]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    signs = np.frombuffer(("\n".join(parts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    text = np.repeat(np.arange(len(parts), dtype=np.int32), sizes)
    sign = np.append(np.uint32(0), _letters()[signs])
    text = np.append(np.int32(0), text)
    keep = (sign != 0) | np.append(True, sign[:-1] != 0)
    sign, text = sign[keep].astype(np.uint64), text[keep]
    has = np.bincount(text[sign != 0], minlength=len(parts)) > 0
    hashes, owners = [], []
    for size in SIZES:
        n = max(len(sign) - size + 1, 0)
        inner = np.ones(n, bool)
        for j in range(1, size - 1):
            inner &= sign[j : n + j] != 0
        hashes.append((rolling(sign, size, odd(f"gram{size}", size))[:n] if n else np.zeros(0, np.uint64))[inner])
        owners.append(text[1 : n + 1][inner])
    return np.concatenate(hashes), np.concatenate(owners), has


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, count = np.concatenate(keys), np.concatenate(counts)
    key, place = np.unique(key, return_inverse=True)
    return key, np.bincount(place, count, len(key)).astype(np.int64)


def gram_counts(docs: DataFrame) -> DataFrame:
    """Occurrences of every n-gram in every language: lang, gram, n; added up in the task that reads, then by key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, tuple[list[np.ndarray], list[np.ndarray]]] = {}

        def give() -> Iterator[pa.RecordBatch]:
            for lang, (keys, counts) in seen.items():
                key, count = _summed(keys, counts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(key.view(np.int64)), pa.array(count)], names=["lang", "gram", "n"])
            seen.clear()

        for batch in batches:
            for part in slices(batch, 1, TOGETHER):
                langs = np.array(part.column(0).to_pylist(), object)
                for lang in dict.fromkeys(langs):
                    key, count = np.unique(grams(part.column(1).filter(pa.array(langs == lang)))[0], return_counts=True)
                    keys, counts = seen.setdefault(lang, ([], []))
                    keys.append(key)
                    counts.append(count)
                    if sum(map(len, keys)) > KEPT:
                        seen[lang] = tuple([x] for x in _summed(keys, counts))
                if sum(len(k) for keys, _ in seen.values() for k in keys) > 4 * KEPT:
                    yield from give()
        yield from give()

    return docs.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Filters:
    """For every cell the set of languages that hold one of its n-grams, as bits; one slice of cells per hash function."""

    def __init__(self, langs: list[str], likely: str | None, gram: np.ndarray, lang: np.ndarray):
        self.langs, self.likely = langs, likely
        self.bits = max(8, int(2 * len(np.unique(gram))).bit_length())
        self.cells = np.zeros((DEPTH, 1 << self.bits, -(-len(langs) // 8) or 1), np.uint8)
        for row, at in zip(self.cells, self.places(gram)):
            np.bitwise_or.at(row, (at, lang // 8), (1 << (lang % 8)).astype(np.uint8))
        fill = np.unpackbits(self.cells, axis=2, bitorder="little")[:, :, : len(langs)].mean(1)
        self.false = fill.prod(0)  # the chance that a foreign n-gram passes, per language

    def places(self, gram: np.ndarray) -> list[np.ndarray]:
        return [((gram * f) >> np.uint64(64 - self.bits)).astype(np.int64) for f in odd("slice", DEPTH)]

    def shares(self, gram: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
        """Per text and language the share of n-grams that the language holds, without the expected false positives."""
        found = self.cells[0][(at := self.places(gram))[0]]
        for row, place in zip(self.cells[1:], at[1:]):
            found = found & row[place]
        bit = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
        hits = [np.bincount(text * np.int64(256) + byte, minlength=256 * texts).reshape(texts, 256) @ bit for byte in found.T]
        total = np.bincount(text, minlength=texts)[:, None]
        share = np.hstack(hits)[:, : len(self.langs)] / np.maximum(total, 1)
        return np.clip((share - self.false) / np.maximum(1 - self.false, 1e-9), 0, 1)


def learn(docs: DataFrame, near: float, rare: float) -> Filters:
    """Filters of documents with text and lang; an n-gram belongs to every language in which it is about as frequent as anywhere."""
    counts = shared_table(gram_counts(docs.where("lang IS NOT NULL AND text IS NOT NULL")), "grams")
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    known = {r.lang for r in docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang").distinct().collect()}
    langs = sorted(known)
    if not totals:
        return Filters(langs, langs[0] if langs else None, np.zeros(0, np.uint64), np.zeros(0, np.int64))
    of = F.create_map(*[F.lit(x) for lang, n in totals.items() for x in (lang, n)])
    rates = counts.withColumn("rate", F.col("n") / of[F.col("lang")]).where((F.col("rate") >= rare) & (F.col("n") > 1))
    # both sides hold at most 1 / rare rows per language
    kept = rates.withColumn("top", F.max("rate").over(W.partitionBy("gram"))).where(F.col("rate") >= near * F.col("top"))
    table = kept.select("gram", "lang").toPandas()
    place = {lang: i for i, lang in enumerate(langs)}
    likely = min(totals, key=lambda lang: (-totals[lang], lang))
    return Filters(langs, likely, table["gram"].to_numpy(np.int64).view(np.uint64), table["lang"].map(place).to_numpy(np.int64))


def identify_language(docs: DataFrame, near: float = 0.2, rare: float = 1e-5) -> DataFrame:
    """Language of every whole text: doc_id, held_out, lang_pred, score.

    Filters are learned from the texts and non-null lang of all documents whose
    crc32(doc_id as text) mod 5 is not 0. The n-grams of all of them are counted
    by language. One belongs to a language if it makes up at least ``rare`` of
    that language's n-grams and is at least ``near`` times as frequent there as in any other language;
    so the filters hold at most 1 / ``rare`` n-grams of a language, whatever
    the input. A lookup ands the bit sets of one cell per hash function and
    yields all languages of an n-gram. The counts per language over a text,
    without the false positives that the fill of a language's bits lets expect,
    decide; ``score`` is the winner's part of all languages' counts, and ties
    go to the smaller name.

    A text that is null or has no letter is ``und`` with score 0. A text with
    letters of which no language holds an n-gram gets the language with the most
    n-grams, with score 0; if no language was learned, ``und``. A null doc_id
    is held out. Rows are judged each by itself, so repeated ids give a row
    each. An empty table gives none. Only doc_id, text and lang are read, and
    lang only to learn.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), held.alias("held_out"), F.col("lang").cast("string"))
    filters = learn(own.where("NOT held_out"), near, rare)
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for batch in batches:
            for part in slices(batch, 1, TOGETHER):
                gram, text, has = grams(part.column(1))
                if f.langs:
                    share = f.shares(gram, text, part.num_rows)
                    best, total = share.argmax(1), share.sum(1)
                    name = np.where(total > 0, np.array(f.langs, object)[best], f.likely)
                    score = np.where(total > 0, share.max(1) / np.maximum(total, 1e-300), 0.0)
                else:
                    name, score = np.full(part.num_rows, "und", object), np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(np.where(has, name, "und"), pa.string()),
                                                  pa.array(np.where(has, score, 0.0))], names=["doc_id", "held_out", "lang_pred", "score"])

    return own.select("doc_id", "text", "held_out").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
