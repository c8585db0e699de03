"""Benchmark decontamination with spaced seeds and runs, in DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafgrade.llm.common import shared_table

#: Fixed masks of 12 tokens: a seed hashes the tokens under 1 and ignores those under 0.
MASKS = ("110100110101", "101110010011", "111001001011")
SPAN = len(MASKS[0])
#: Items of fewer tokens than LONG are seeded by runs of three tokens.
LONG, RUN = 40, "111"
#: All masks; a seed's key holds its mask's number.
EVERY = (*MASKS, RUN)
#: Seeds that go to every task at once, at about 80 bytes each.
MOST_BROADCAST_SEEDS = 1_000_000
#: Places of a document that are looked up together; their rows carry no more of its tokens than an item laid there can reach.
PIECE = 256
#: Rows of leaks that an anti join may send to every task, at some 40 bytes each.
MOST_BROADCAST_LEAKS = 1_000_000


def token_hashes(text: Column) -> Column:
    """Hashes of the lower-cased runs of letters and digits."""
    return F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.xxhash64(w))


def pieces(df: DataFrame, keep: list[str], tokens: str, reach: int) -> DataFrame:
    """``keep``, and the tokens in rows of ``PIECE`` places: the ``piece`` with ``reach`` tokens more on either side, and its places ``first`` to ``last``.

    A place that hits makes a row with the tokens around it, and Spark holds all rows that one input row makes; with whole documents
    these would grow with the square of a text.
    """
    def piece(at: Column) -> Column:
        start = F.greatest(at - reach, F.lit(0))
        return F.struct((at - start).alias("first"), (F.least(at + PIECE, F.size(tokens)) - 1 - start).alias("last"),
                        F.slice(tokens, start + 1, at + PIECE + reach - start).alias("piece"))

    return df.select(*keep, F.inline(F.transform(F.sequence(F.lit(0), F.greatest(F.size(tokens) - 1, F.lit(0)), F.lit(PIECE)), piece)))


def seeds(df: DataFrame, keep: list[str], tokens: str, at: str, masks: list[int], fits=None, first: str | None = None, last: str | None = None) -> DataFrame:
    """One row per place and mask number: ``keep``, the place ``at`` and the seed's ``key``; ``fits(mask)`` says where a mask counts.

    Places go from the column ``first`` to ``last``, by default over all tokens.
    """
    start, end = F.col(first) if first else F.lit(0), F.col(last) if last else F.size(tokens) - 1
    placed = df.select(*keep, tokens, F.explode(F.sequence(start, F.greatest(start, end))).alias(at))

    def key(m: int) -> Column:
        here = F.col(at) + len(EVERY[m]) <= F.size(tokens)
        return F.when(here & fits(m) if fits else here, F.xxhash64(F.lit(m), *(F.get(tokens, F.col(at) + o) for o, bit in enumerate(EVERY[m]) if bit == "1")))

    return placed.select(*keep, tokens, at, F.explode(F.array(*map(key, masks))).alias("key")).where("key IS NOT NULL")


def item_fits(m: int) -> Column:
    """Which items mask ``m`` seeds: gapped masks long ones, runs short ones."""
    return F.size("item") >= LONG if m < len(MASKS) else F.size("item") < LONG


def overlap(doc: Column, item: Column, shift: Column) -> Column:
    """Struct (matched, best): tokens that agree when the item lies at ``shift``, and the best stretch at +1 and -2 a token."""
    agree = F.transform(item, lambda w, i: F.coalesce(F.get(doc, i + shift) == w, F.lit(False)).cast("int"))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"), F.lit(0).alias("matched"))

    def step(s, hit):
        now = F.greatest(s["now"] + 3 * hit - 2, F.lit(0))
        return F.struct(now.alias("now"), F.greatest(s["best"], now).alias("best"), (s["matched"] + hit).alias("matched"))

    return F.aggregate(agree, start, step)


def contaminated(docs: DataFrame, benchmark: DataFrame, least_share: float = 0.75, least_score: int = 13,
                 seeds_at_once: int = MOST_BROADCAST_SEEDS) -> DataFrame:
    """Documents that hold benchmark text: doc_id, item_id, n_tokens, matched, score.

    Tokens are lower-cased runs of letters and digits. Seeds meet in an equi
    join; at a hit the item is laid over the document without gaps. Items of 40
    tokens and more are seeded under three fixed masks of 12 tokens, 7 of which
    count. Items of 12 to 39 tokens are seeded by every run of 3 tokens: with a
    quarter of the tokens replaced, or in a stretch of score 13, some 3 in a row
    agree, so no pair is lost at the default limits. A pair is returned when at
    least ``least_share`` of the item's tokens agree, or when a stretch
    reaches ``least_score`` at +1 for agreement and -2 for substitution (13
    words in a row, or more with some replaced). ``matched`` and ``score`` are
    the best of the pair's hits.

    The seeds of the benchmark are counted: up to ``seeds_at_once`` go to every
    task, so documents are neither shuffled nor stored; more are split by
    item into that many more passes over the documents, one after the other. Documents are
    looked up in pieces, so a task holds one text and the hits of one piece. Items of fewer than 12
    tokens and null texts match nothing. Rows of equal doc_id or item_id give
    one row for the pair; null ids form one document. Empty tables give none.
    Only doc_id, text, item_id are read.
    """
    items = benchmark.select("item_id", token_hashes(F.col("text")).alias("item")).where(F.size("item") >= SPAN).distinct()
    n = F.size("item")
    own_seeds = F.when(n >= LONG, (n - (SPAN - 1)) * len(MASKS)).otherwise(n - (len(RUN) - 1))
    total, longest, shortest = items.agg(F.sum(own_seeds), F.max(n), F.min(n)).first()
    passes = max(1, -(-(total or 0) // seeds_at_once))
    masks = [m for m in range(len(EVERY)) if (m < len(MASKS) and (longest or 0) >= LONG) or (m == len(MASKS) and (shortest or 0) < LONG)]
    tokens = docs.select("doc_id", token_hashes(F.col("text")).alias("tokens"))
    held = (F.col("o.matched") >= least_share * F.col("n_tokens")) | (F.col("o.best") >= least_score)
    found = []
    for p in range(passes):
        own = items.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == p)
        known = seeds(own.select("item_id", "item", F.xxhash64("item_id", "item").alias("ref")), ["ref"], "item", "j", masks, item_fits).select("ref", "j", "key").distinct()
        known = known.groupBy("key").agg(F.collect_list(F.struct("ref", "j")).alias("places"))  # a seed of many items makes one row at a hit
        whole = own.select(F.xxhash64("item_id", "item").alias("ref"), "item_id", "item")
        met = seeds(pieces(tokens, ["doc_id"], "tokens", longest or SPAN), ["doc_id"], "piece", "i", masks, first="first", last="last").join(F.broadcast(known), "key")
        hits = met.select("doc_id", "piece", F.inline(F.transform("places", lambda x: F.struct(x["ref"].alias("ref"), (F.col("i") - x["j"]).alias("shift"))))).join(F.broadcast(whole), "ref")
        leaks = hits.select("doc_id", "item_id", F.size("item").alias("n_tokens"), overlap(F.col("piece"), F.col("item"), F.col("shift")).alias("o")).where(held)
        found.append(leaks if passes == 1 else shared_table(leaks, "leaks"))  # one pass's seeds at a time
    return reduce(DataFrame.union, found).groupBy("doc_id", "item_id").agg(
        F.max("n_tokens").alias("n_tokens"), F.max("o.matched").alias("matched"), F.max("o.best").alias("score"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark text, with all their columns: by doc_id and text, so a row goes for its own text only."""
    text_hash = F.xxhash64(docs["text"])
    bad = contaminated(docs.select(F.struct("doc_id", text_hash.alias("h")).alias("doc_id"), "text"), benchmark).select(
        F.col("doc_id.doc_id").alias("_bad"), F.col("doc_id.h").alias("_bad_text")).distinct()
    bad = shared_table(bad, "leaks")
    if bad.count() <= MOST_BROADCAST_LEAKS:  # then texts are not shuffled
        bad = F.broadcast(bad)
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_bad"]) & (text_hash == bad["_bad_text"]), "left_anti")
