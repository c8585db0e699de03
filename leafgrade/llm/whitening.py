"""Whitening of embeddings: exact covariance by tasks, its leading eigenvectors by contour integration."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgrade.llm.common import shared_table
from leafgrade.llm.topk import scaled

#: Rows that a task multiplies at once.
ROWS = 4096
#: Gauss-Legendre nodes on the upper half of a contour.
NODES = 8


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def dimension_sums(x: DataFrame) -> DataFrame:
    """Exact sums per length of vector and dimension: dim, i, n, total."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            length = batch.column(0).value_lengths().to_numpy()
            for d in np.unique(length).tolist():
                rows = _matrix(batch.column(0).filter(pa.array(length == d)))
                n, s = sums.get(d, (0, 0))
                sums[d] = n + len(rows), s + rows.sum(0)
        for d, (n, s) in sums.items():
            yield pa.RecordBatch.from_pydict({"dim": np.full(d, d), "i": np.arange(d), "n": np.full(d, n), "total": s})

    return x.select("x").mapInArrow(run, "dim long, i long, n long, total long").groupBy("dim", "i").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def scatter(x: DataFrame, dim: int, middle: np.ndarray) -> DataFrame:
    """Exact sums of products of x - middle over all vectors, for i <= j: i, j, total.

    ``middle`` is the mean rounded to whole numbers, so products are small and
    whole. They are summed in doubles as long as these are exact, then in longs.
    """
    i, j = np.triu_indices(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                y = _matrix(batch.column(0).slice(at, ROWS)) - middle
                exact = float(np.abs(y).max(initial=0)) ** 2 * len(y) < 2**53
                f = y.astype(float) if exact else y
                total += (f.T @ f).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"i": i, "j": j, "total": total[i, j]})

    cells = x.where(F.size("x") == dim).select("x").mapInArrow(run, "i long, j long, total long")
    return cells.groupBy("i", "j").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))


def covariance(n: int, sums: np.ndarray, products: dict[tuple[int, int], int], middle: np.ndarray) -> np.ndarray:
    """Covariance with divisor n, every entry rounded once from its exact fraction."""
    d = len(sums)
    rest = [int(s) - n * int(m) for s, m in zip(sums, middle)]
    v = np.zeros((d, d))
    for (i, j), p in products.items():
        v[i, j] = v[j, i] = (n * int(p) - rest[i] * rest[j]) / (n * n)
    return v


def inertia(a: np.ndarray) -> tuple[int, int]:
    """How many eigenvalues of a symmetric matrix are positive and negative, by pivoted block elimination (Sylvester's law)."""
    a, plus, minus = a.copy(), 0, 0
    while len(a):
        size = np.abs(a)
        d = int(size.diagonal().argmax())
        r, c = divmod(int((size - np.diag(size.diagonal())).argmax()), len(a))
        if size[d, d] == 0 and size[r, c] == 0:
            break
        if size[d, d] >= 0.64 * size[r, c]:
            pivot, signs = [d], (int(a[d, d] > 0), int(a[d, d] < 0))
        else:
            pivot, signs = [r, c], (1, 1)
        plus, minus = plus + signs[0], minus + signs[1]
        left = np.delete(np.arange(len(a)), pivot)
        side = a[np.ix_(left, pivot)]
        a = a[np.ix_(left, left)] - side @ np.linalg.solve(a[np.ix_(pivot, pivot)], side.T)
    return plus, minus


def above(v: np.ndarray, bound: float) -> int:
    """Number of eigenvalues of ``v`` over ``bound``."""
    return inertia(v - bound * np.eye(len(v)))[0]


def cut(v: np.ndarray, j: int) -> float:
    """A bound in the gap under the ``j`` largest eigenvalues of a matrix without negative ones.

    Eigenvalues closer to each other than 10^-7 of the matrix stay together, so more may lie above.
    """
    top = float(np.abs(v).sum(1).max())
    low, high = -1e-3 * top, top * (1 + 1e-9)
    found = low if j >= len(v) else None
    while found is None and high - low > 1e-7 * top:
        mid = (low + high) / 2
        n = above(v, mid)
        low, high, found = (mid, high, found) if n > j else (low, mid, found) if n < j else (low, high, mid)
    if found is None:
        return cut(v, above(v, low))
    if j >= len(v):
        return low
    under = over = found
    for _ in range(5):  # the middle of the gap, about
        a, b = (low + under) / 2, (over + high) / 2
        low, under = (low, a) if above(v, a) == j else (a, under)
        over, high = (b, high) if above(v, b) == j else (over, b)
    return (under + over) / 2


def cuts(v: np.ndarray, k: int, together: int = 4) -> list[tuple[float, float]]:
    """Intervals, from above, that hold the ``k`` largest eigenvalues, about ``together`` each, cut amid gaps."""
    edges = sorted({cut(v, j) for j in range(k, 0, -together)}, reverse=True)
    top = float(np.abs(v).sum(1).max())
    low, high = edges[0], top * (1 + 1e-9)
    while high - low > 0.05 * (high - edges[0]):  # a close upper end keeps the first contour small
        mid = (low + high) / 2
        low, high = (mid, high) if above(v, mid) else (low, mid)
    upper = high + (high - edges[0]) / 2
    return list(zip(edges, [upper, *edges[:-1]]))


def feast(v: np.ndarray, low: float, high: float, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in (low, high) and unit eigenvectors, as many as inertia counts find there.

    A quadrature over a circle through both ends, of solutions of (z - v) q = y,
    projects a block y onto the wanted eigenvectors; Rayleigh-Ritz takes them
    from the block, and the projection is repeated until the residuals are
    of rounding size. If eigenvalues are missing, the block grows.
    """
    d, wanted = len(v), above(v, low) - above(v, high)
    scale = max(float(np.abs(v).sum(1).max()), 1e-300)
    node, weight = np.polynomial.legendre.leggauss(NODES)
    turn = np.exp(1j * np.pi / 2 * (1 - node))
    middle, radius = (low + high) / 2, (high - low) / 2
    width = min(d, wanted + max(3, wanted // 2))
    while True:
        y = np.random.default_rng(7).standard_normal((d, width))
        for _ in range(rounds):
            q = np.zeros((d, width))
            for t, w in zip(turn, weight):
                q += w / 2 * (radius * t * np.linalg.solve((middle + radius * t) * np.eye(d) - v, y.astype(complex))).real
            left, size, _ = np.linalg.svd(q, full_matrices=False)
            basis = left[:, size > 1e-13 * size[0]]
            value, small = np.linalg.eigh(basis.T @ v @ basis)
            y = basis @ small
            inside = (value > low) & (value < high)
            vector = y[:, inside]
            worst = np.abs(v @ vector - vector * value[inside]).max(initial=0.0)
            if inside.sum() == wanted and worst < 4e-15 * scale:
                break
            y = np.hstack([y, np.random.default_rng(8).standard_normal((d, width - y.shape[1]))])
        if inside.sum() == wanted and worst < 1e-11 * scale:
            return value[inside], vector
        if width == d:
            raise ArithmeticError(f"{inside.sum()} of {wanted} eigenvalues in ({low}, {high})")
        width = min(d, 2 * width)


def leading(spark: SparkSession, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of ``v`` and their eigenvectors (columns); those of rounding size are left out.

    Every interval is a task. A last Rayleigh-Ritz over all of them makes the
    vectors of different intervals orthogonal to the last digit.
    """
    k = min(k, above(v, 1e-12 * float(np.trace(v)))) if np.trace(v) > 0 else 0
    if not k:
        return np.zeros(0), np.zeros((len(v), 0))
    intervals = cuts(v, k)

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for low, high in zip(part["low"], part["high"]):
                _, vector = feast(v, low, high)
                yield pd.DataFrame({"vector": list(vector.T)})

    rows = spark.createDataFrame([(float(a), float(b)) for a, b in intervals], "low double, high double").repartition(len(intervals), "low")
    found = np.array([r.vector for r in rows.mapInPandas(solve, "vector array<double>").collect()]).T
    if found.shape[1] != above(v, intervals[-1][0]):
        raise ArithmeticError("eigenvalues are missing between intervals")
    basis, _ = np.linalg.qr(found)
    value, small = np.linalg.eigh(basis.T @ v @ basis)
    return value[::-1][:k], (basis @ small[:, ::-1])[:, :k]


def whiten(vectors: DataFrame, components: int = 8, scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """Vectors projected on their leading principal components, at unit variance.

    Returns vec_id, n, deviation, whitened (array, one per component), explained
    (array, share of the trace) and identity_error. Entries c become the
    integer x = floor(scale * c) + shift. n vectors, their sums S and the sums
    of products around the rounded mean are exact integers added up by tasks,
    so the covariance is the same on every layout, rounded once. What reaches the driver is
    one matrix of the vectors' dimension, whatever their number. Its largest
    eigenvalues are found by contour integration (see ``feast``), and checked
    by inertia counts. ``deviation`` is the sum of (n * x - S)^2, as long
    arithmetic has it. ``identity_error`` is measured on the whitened rows:
    the largest entry of their covariance minus the identity.

    Vectors null, empty, or with null or non-finite entries are dropped, and
    those of another length than the most frequent (ties: the shorter). Null
    and repeated vec_ids are rows like others; repeated rows count each.
    Components without variance (under 10^-12 of the trace) are left out, so
    equal vectors give empty arrays. An empty table gives no rows. Only vec_id
    and embedding are read.
    """
    spark = vectors.sparkSession
    x = vectors.select("vec_id", F.transform(scaled(F.col("embedding"), scale), lambda c: c + shift).alias("x")).where("size(x) > 0")
    schema = "vec_id long, n long, deviation long, whitened array<double>"
    sums = dimension_sums(x)
    best = sums.where("i = 0").orderBy(F.col("n").desc(), "dim").select("dim", "n").first()
    if best is None:
        return spark.createDataFrame([], f"{schema}, explained array<double>, identity_error double")
    dim, n = best.dim, best.n
    s = np.array([r.total for r in sums.where(F.col("dim") == dim).orderBy("i").collect()], dtype=object)
    middle = np.array([(2 * int(t) + n) // (2 * n) for t in s], np.int64)
    v = covariance(n, s, {(r.i, r.j): int(r.total) for r in scatter(x, dim, middle).collect()}, middle)
    value, vector = leading(spark, v, components)
    rest = np.array([(int(t) - n * int(m)) / n for t, m in zip(s, middle)])
    turn, total = vector / np.sqrt(value), s.astype(np.int64)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch.column(1))
            out = (rows - middle - rest) @ turn
            deviation = ((n * rows - total) ** 2).sum(1)
            ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * out.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(rows), n)), pa.array(deviation),
                                              pa.ListArray.from_arrays(ends, pa.array(out.ravel()))], names=["vec_id", "n", "deviation", "whitened"])

    rows = shared_table(x.where(F.size("x") == dim).select(F.col("vec_id").cast("long"), "x").mapInArrow(project, schema), "whitened")
    return rows.withColumns({"explained": F.array(*[F.lit(float(e / np.trace(v))) for e in value]).cast("array<double>"),
                             "identity_error": F.lit(identity_error(rows, n, len(value)))})


def identity_error(rows: DataFrame, n: int, k: int) -> float:
    """The largest absolute entry of the covariance of the k whitened columns minus the identity; 0 without columns."""
    if not k:
        return 0.0
    w: Callable = lambda i: F.col("whitened")[i]
    mean = list(rows.agg(*[F.sum(w(i)) / n for i in range(k)]).first())
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    cov = rows.agg(*[F.sum((w(i) - mean[i]) * (w(j) - mean[j])) / n for i, j in pairs]).first()
    return max(abs(c - (i == j)) for c, (i, j) in zip(cov, pairs))
