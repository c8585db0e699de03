"""Overlap joins without nested loops.

A theta join with only the page as equality key compares every pair on the
page. ``band_join`` cuts the compared axis into bins, so rows meet only when
they share a bin, and a hot page is spread over its bins. Each pair is kept in
exactly one bin (the larger of the two first bins), so no distinct is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bins(low: Column, high: Column, size: float) -> tuple[Column, Column]:
    first = F.floor(low / size).cast("long")
    last = F.floor(high / size).cast("long")
    return first, F.greatest(first, last)


def band_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_range: tuple[Column, Column],
              right_range: tuple[Column, Column], condition: Column | None = None,
              bin_size: float = 1 / 32) -> DataFrame:
    """Join rows of equal ``keys`` whose closed ranges touch and that satisfy ``condition``.

    The left row appears as struct column ``l``, the right row as ``r``.
    Null ranges match nothing.
    """
    l_low, l_high = left_range
    r_low, r_high = right_range
    ls = left.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.struct(*left.columns).alias("l"),
                     l_low.cast("double").alias("_llo"), l_high.cast("double").alias("_lhi"))
    rs = right.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.struct(*right.columns).alias("r"),
                      r_low.cast("double").alias("_rlo"), r_high.cast("double").alias("_rhi"))
    on = [f"_k{i}" for i in range(len(keys))] + ["_bin"]

    def spread(df: DataFrame, low: str, high: str, first: str) -> DataFrame:
        a, b = _bins(F.col(low), F.col(high), bin_size)
        known = df.where(F.col(low).isNotNull() & F.col(high).isNotNull())
        return known.withColumn(first, a).withColumn("_bin", F.explode(F.sequence(a, b)))

    ls_b = spread(ls, "_llo", "_lhi", "_lb")
    rs_b = spread(rs, "_rlo", "_rhi", "_rb")
    touch = (F.col("_llo") <= F.col("_rhi")) & (F.col("_rlo") <= F.col("_lhi"))
    test = touch if condition is None else touch & condition
    pairs = ls_b.join(rs_b, on).where((F.col("_bin") == F.greatest("_lb", "_rb")) & test)
    return pairs.select("l", "r")


def band_exists(left: DataFrame, right: DataFrame, keys: Sequence[str], row_id: Sequence[str],
                left_range: tuple[Column, Column], right_range: tuple[Column, Column],
                condition: Column | None = None, bin_size: float = 1 / 32, negate: bool = False) -> DataFrame:
    """Left rows with (or without) a partner in ``band_join``; ``row_id`` + keys identify a left row."""
    ids = [*keys, *row_id]
    hits = band_join(left, right, keys, left_range, right_range, condition, bin_size).select(
        *[F.col("l")[c].alias(c) for c in ids]).distinct()
    return left.join(hits, ids, "left_anti" if negate else "left_semi")
