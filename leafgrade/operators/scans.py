"""Ordered scans that survive hot keys.

``lag``/running-sum windows put a whole key into one task. For logs, where one
key may hold a large share of all rows, each key is cut into chunks along its
order (a day, a block of 1024 turns, ...). Windows run per (key, chunk); one
summary row per chunk carries the missing value over the chunk border. The
result equals the plain window. The chunk expression must grow with the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = "_chunk"
#: Below this rank the optimizer cuts ranked rows before it shuffles them (its own default).
RANKED = 999


def _join_edges(df: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(edges, [*keys, CHUNK], "left")


def neighbour(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str, chunk: Column,
              following: bool = False) -> DataFrame:
    """Add ``out``: ``value`` (may not be null) of the previous (or following) row of the key."""
    base = df.withColumn(CHUNK, chunk).withColumn("_v", value)
    inner = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    pick = F.lead if following else F.lag
    edge = F.min_by if following else F.max_by
    edges = base.groupBy(*keys, CHUNK).agg(edge("_v", F.struct(*order)).alias("_edge"))
    outer = Window.partitionBy(*keys).orderBy(CHUNK)
    edges = edges.select(*keys, CHUNK, pick("_edge").over(outer).alias("_carry"))
    local = base.withColumn("_near", pick("_v").over(inner))
    return _join_edges(local, edges, keys).withColumn(out, F.coalesce("_near", "_carry")).drop(
        CHUNK, "_v", "_near", "_carry")


def last_known(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str, chunk: Column,
               strictly_before: bool = False) -> DataFrame:
    """Add ``out``: last non-null ``value`` of the key up to (or strictly before) the row."""
    base = df.withColumn(CHUNK, chunk).withColumn("_v", value)
    end = -1 if strictly_before else 0
    inner = Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    edges = base.where(F.col("_v").isNotNull()).groupBy(*keys, CHUNK).agg(
        F.max_by("_v", F.struct(*order)).alias("_edge"))
    chunks = base.select(*keys, CHUNK).distinct().join(edges, [*keys, CHUNK], "left")
    outer = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = chunks.select(*keys, CHUNK, F.last("_edge", ignorenulls=True).over(outer).alias("_carry"))
    local = base.withColumn("_near", F.last("_v", ignorenulls=True).over(inner))
    return _join_edges(local, carry, keys).withColumn(out, F.coalesce("_near", "_carry")).drop(
        CHUNK, "_v", "_near", "_carry")


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str, chunk: Column) -> DataFrame:
    """Add ``out``: inclusive running sum of ``value`` along the key."""
    base = df.withColumn(CHUNK, chunk).withColumn("_v", value)
    inner = Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = base.groupBy(*keys, CHUNK).agg(F.sum("_v").alias("_total"))
    outer = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, CHUNK, F.sum("_total").over(outer).alias("_carry"))
    local = base.withColumn("_near", F.sum("_v").over(inner))
    return _join_edges(local, totals, keys).withColumn(
        out, F.col("_near") + F.coalesce("_carry", F.lit(0))).drop(CHUNK, "_v", "_near", "_carry")


def running_groups(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str, chunk: Column) -> DataFrame:
    """Add ``out``: number of the run of equal ``value`` (never null) along the key, from 0; keeps the chunk column.

    ``lag`` and running sum in one pass: a chunk's summary is its first and last
    value and the changes between, and one window over the summaries gives the
    runs before the chunk.
    """
    base = df.withColumn(CHUNK, chunk).withColumn("_v", value)
    rows = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    changed = F.coalesce((F.lag("_v").over(rows) != F.col("_v")).cast("long"), F.lit(0).cast("long"))
    local = base.withColumn("_change", changed).withColumn("_near", F.sum("_change").over(rows.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.struct(*order)
    # the changes inside a chunk are the largest running number of its rows, which its last row carries
    inner = local.groupBy(*keys, CHUNK).agg(F.max("_near").alias("_inner"), F.min_by("_v", at).alias("_first"), F.max_by("_v", at).alias("_last"))
    line = Window.partitionBy(*keys).orderBy(CHUNK)
    border = F.coalesce((F.lag("_last").over(line) != F.col("_first")).cast("long"), F.lit(0).cast("long"))
    carry = inner.withColumn("_border", border).withColumn("_carry", F.coalesce(F.sum(F.col("_inner") + F.col("_border")).over(
        line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("_border")).select(*keys, CHUNK, "_carry")
    return _join_edges(local, carry, keys).withColumn(out, F.col("_near") + F.col("_carry")).drop("_v", "_change", "_near", "_carry")


def first_k(df: DataFrame, keys: list[str], order: list[str], k: int, salts: int = 32) -> DataFrame:
    """The first ``k`` rows per key, exactly; ties must be broken by ``order``.

    A rank filter of up to ``RANKED`` rows is also applied by the optimizer in
    every task before the shuffle, so a hot key sends k rows a task. For larger
    k, rows are first cut to ``k`` per (key, salt), which spreads a hot key over
    ``salts`` tasks before its survivors meet.
    """
    if k < 1:
        return df.limit(0)
    last = Window.partitionBy(*keys).orderBy(*order)
    if k > RANKED:
        first = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts))).withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= k).drop("_salt")
    return df.withColumn("_rn", F.row_number().over(last)).where(F.col("_rn") <= k).drop("_rn")


def latest_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key; an aggregate, so map-side combined and safe for hot keys."""
    rest = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col("_row")[c].alias(c) for c in rest])
