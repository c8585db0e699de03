"""Exact top-k search: tiles of queries times shards of rows, partial selection, tree merging."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

PACKED = "n long, ids binary, vectors binary"


def scaled(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of every component as long; null if the vector, a component or its value is not finite."""
    xs = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(xs, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(xs, lambda x: F.floor(x * scale).cast("long")))


def _pack(rows: int):
    """Packs the vectors of a partition into matrices of at most ``rows`` rows."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, part in pdf.groupby(pdf["v"].map(len)):
                for at in range(0, len(part), rows):
                    p = part.iloc[at : at + rows]
                    v = np.vstack(p["v"].to_list()).astype(np.int64) if dim else np.zeros((len(p), 0), np.int64)
                    yield pd.DataFrame({"g": [int(p["g"].iloc[0])] if "g" in p else [0], "dim": [dim], "n": [len(p)],
                                        "ids": [p["vec_id"].to_numpy(np.int64).tobytes()], "vectors": [v.tobytes()]})
    return run


def _product(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles while every partial sum stays below 2**53, else in longs."""
    if not q.size or not v.size:
        return np.zeros((len(q), len(v)), np.int64)
    most = float(np.abs(q).max()) * float(np.abs(v).max()) * q.shape[1]
    return (q.astype(float) @ v.T.astype(float)).astype(np.int64) if most < 2**53 else q @ v.T


def _top(ids: np.ndarray, score: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    keep = ids != own
    ids, score = ids[keep], score[keep]
    if len(ids) > k:
        cut = np.partition(score, len(score) - k)[len(score) - k]
        ids, score = ids[score >= cut], score[score >= cut]
    best = np.lexsort((ids, -score))[:k]
    return ids[best], score[best]


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 10, tile_rows: int = 512, shard_rows: int = 8192,
                group_rows: int = 1 << 18, tile_groups: int = 16, scale: int = 1024) -> DataFrame:
    """Each query's k rows of highest integer inner product: query_id, rank, vec_id, score.

    ``vectors`` has vec_id and embedding. Rows are dealt to groups of about
    ``group_rows``; in a group they are packed into shards, queries into tiles
    of ``tile_rows``, and tiles into blocks of about ``tile_groups``. Every group meets
    every block in a task of its own, so tasks grow in number and not in work.
    A task multiplies each tile with each shard, keeps k rows per query and tile,
    and sends them on; a second merge halves the lists by group, a window ends it. Ties go
    to the smaller vec_id. The products are exact integers.

    Vectors null, with null or non-finite components, or without vec_id take no
    part; vectors of another length than the query's are no candidates for it.
    A query's candidates are all rows of other vec_id; repeated rows are
    candidates each, a repeated query vec_id counts once with its largest
    vector. Fewer than k candidates give them all. Components beyond 2**31 in
    size overflow like any long arithmetic.
    """
    usable = vectors.select("vec_id", scaled(F.col("embedding"), scale).alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    total = usable.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    groups, blocks = max(1, -(-total[0] // group_rows)), max(1, -(-total[1] // (tile_rows * tile_groups)))
    schema = f"g long, dim long, {PACKED}"
    deal = lambda n: F.pmod(F.xxhash64("ids"), F.lit(n)).cast("long")
    tiles = (
        usable.where(is_query).groupBy("vec_id").agg(F.max("v").alias("v"))
        .mapInPandas(_pack(tile_rows), schema).withColumns({"t": deal(blocks)}).drop("g").withColumn("g", F.explode(
            F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
        .select("g", "t", "dim", F.col("n").alias("qn"), F.col("ids").alias("qids"), F.col("vectors").alias("qvectors"))
    )
    shards = usable.mapInPandas(_pack(shard_rows), schema).withColumn("g", deal(groups)).withColumn("t", F.explode(
        F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                qids, ids = np.frombuffer(r.qids, np.int64), np.frombuffer(r.ids, np.int64)
                score = _product(np.frombuffer(r.qvectors, np.int64).reshape(len(qids), -1), np.frombuffer(r.vectors, np.int64).reshape(len(ids), -1))
                for q, row in zip(qids, score):
                    i, s = _top(ids, row, q, k)
                    out.append((np.full(len(i), q), i, s))
            if out:
                q, i, s = (np.concatenate(x) for x in zip(*out))
                yield pd.DataFrame({"query_id": q, "vec_id": i, "score": s})

    part = shards.join(tiles, ["g", "t", "dim"]).mapInPandas(best, "query_id long, vec_id long, score long")
    order = [F.col("score").desc(), F.col("vec_id")]
    part = part.withColumn("_part", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, int(groups**0.5)))))
    half = part.withColumn("_r", F.row_number().over(W.partitionBy("query_id", "_part").orderBy(*order))).where(F.col("_r") <= k)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(*order))
    return half.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
