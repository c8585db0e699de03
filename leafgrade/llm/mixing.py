"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from leafgrade.llm.common import WORD, shared_table

CYCLE = (5, 2, 1)


def apportion(parties: DataFrame, within: list[str], key: str, weight: str, seats: str, cap: str) -> DataFrame:
    """Adds ``quota``: the Sainte-Laguë seats of each party in its group.

    Seats go to the highest quotients weight / (2k - 1). Every divisor between
    W / (seats + n/2) and W / (seats - n/2) is bounded by rounding, so all
    seats below the first are certain and only some 2n quotients per group
    contend; those are ranked. A party gets at most ``cap`` seats.
    """
    group = W.partitionBy(*(within or [F.lit(0)]))
    n, total = F.count(F.lit(1)).over(group), F.sum(weight).over(group)
    at = lambda rate: F.least(F.col(cap), F.floor(F.col(weight) * F.greatest(rate, F.lit(0.0)) + 0.5 - 1e-9))
    rate = lambda half: F.coalesce((F.col(seats) + half) / F.when(total > 0, total), F.lit(0.0))
    bounds = parties.withColumns({"_low": at(rate(-n / 2 - 1)), "_high": at(rate(n / 2 + 1))})
    claims = bounds.withColumn("_left", F.col(seats) - F.sum("_low").over(group)).withColumn(
        "_k", F.explode_outer(F.when(F.col("_high") > F.col("_low"), F.sequence(F.col("_low") + 1, F.col("_high")))))
    ranked = claims.withColumn("_rank", F.row_number().over(group.orderBy(
        (F.col(weight) / (2 * F.col("_k") - 1)).desc_nulls_last(), F.col(key))))
    won = F.when(F.col("_k").isNotNull() & (F.col("_rank") <= F.col("_left")), 1).otherwise(0)
    return ranked.groupBy(*parties.columns).agg((F.first("_low") + F.sum(won)).cast("long").alias("quota"))


def source_targets(sizes: DataFrame, most: int = 3) -> DataFrame:
    """One row per source: size and target words.

    Weights repeat 5, 2, 1 by code point of the source, null last. A target
    stops at ``most`` times its size and the excess goes to the others by
    weight; with sources ordered by cap per weight, the final level is the
    largest of the levels that are left when the sources before are capped.
    """
    src = sizes.groupBy("src", "source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").isNull(), "source")
    src = src.withColumn("weight", F.element_at(F.array(*map(F.lit, CYCLE)), ((F.row_number().over(order) - 1) % len(CYCLE) + 1).cast("int")))
    by_cap = W.orderBy(F.col("cap") / F.col("weight"), "src")
    before, after = by_cap.rowsBetween(W.unboundedPreceding, -1), by_cap.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy(F.lit(0))
    src = src.withColumn("cap", most * F.col("source_size"))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    src = src.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return src.select("src", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")).alias("target"))


def shard_of(seed: int) -> Column:
    """The shard of a row, by doc_id and the hash of its text, so that texts of one doc_id spread."""
    return F.pmod(F.xxhash64("doc_id", "mark", F.lit(seed)), F.col("n_shards"))


def mix_sources(docs: DataFrame, block_words: int = 32, shard_words: int = 1 << 20, most: int = 3, seed: int = 11) -> DataFrame:
    """How many words of each document a mix takes: doc_id, source, size, source_size, target, taken, quota.

    Every source's documents are dealt to shards of about ``shard_words`` words
    by a seeded hash of doc_id and text and laid end to end in seeded order; a block is
    ``block_words`` words of that tape. Blocks go to sources by Sainte-Laguë
    over their targets, then to each source's shards by Sainte-Laguë over shard
    sizes. A shard with quota q of b blocks takes every block q // b times and
    q % b of them once more: those at which a running share that starts at a
    seeded block steps up. A document's words follow in closed form from
    its place on the tape, so no block list is built.

    A word is a run without ASCII blanks; null text has none and takes none. A
    null source is a source of its own. Rows of equal doc_id are documents of
    their own. No document exceeds ``most`` times its size. Reruns agree. The
    window over sources holds one row per source, that over shards one per
    shard of a source, that over documents one shard. Only doc_id, text and
    source are read.
    """
    sizes = shared_table(docs.select(
        "doc_id", "source", F.xxhash64("text").alias("mark"), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")).alias("src"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "mix-sizes")
    targets = source_targets(sizes, most).withColumns({
        "seats": F.round(F.sum("target").over(W.partitionBy(F.lit(0))) / block_words), "blocks": most * F.ceil(F.col("source_size") / block_words)})
    sources = shared_table(apportion(targets, [], "src", "target", "seats", "blocks").select(
        "src", "source_size", "target", F.col("quota").alias("source_quota"),
        F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1)).alias("n_shards")), "mix-sources")
    dealt = sizes.join(sources, "src").withColumn("shard", F.when(F.col("size") > 0, shard_of(seed)))
    shards = dealt.where("size > 0").groupBy("src", "shard", "source_quota").agg(F.sum("size").alias("shard_size")).withColumn(
        "b", F.ceil(F.col("shard_size") / block_words)).withColumn("cap", most * F.col("b"))
    shards = apportion(shards, ["src"], "shard", "shard_size", "source_quota", "cap").select(
        "src", "shard", "b", "quota", F.pmod(F.xxhash64("src", "shard", F.lit(seed + 1)), F.col("b")).alias("off"))
    tape = W.partitionBy("src", "shard").orderBy(F.xxhash64("doc_id", "mark", F.lit(seed + 2)), "doc_id", "size", "mark")
    placed = dealt.where("size > 0").withColumn("end", F.sum("size").over(tape.rowsBetween(W.unboundedPreceding, 0)))
    placed = placed.join(shards, ["src", "shard"])
    b, off, extra = F.col("b"), F.col("off"), F.col("quota") % F.col("b")
    steps = lambda j: F.floor((j + off) * extra / b)  # noqa: E731  blocks stepped up before block j, from a fixed start

    def words_before(x):
        j = F.floor(x / block_words)
        return block_words * (steps(j) - steps(F.lit(0))) + (x % block_words) * (steps(j + 1) - steps(j))

    taken = F.floor(F.col("quota") / b) * F.col("size") + words_before(F.col("end")) - words_before(F.col("end") - F.col("size"))
    out = ["doc_id", "source", "size", "source_size", "target"]
    return placed.select(*out, taken.cast("long").alias("taken")).unionByName(
        dealt.where("size = 0").select(*out, F.lit(0).cast("long").alias("taken")))
