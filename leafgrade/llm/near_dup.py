"""Near-duplicate documents: MinHash bands, verification on signatures and full sets, star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from leafgrade.llm.common import shared_table
from leafgrade.llm.hashing import WordHashes, odd, rolling

#: Ids that a semi join may send to every task, at 8 bytes each.
MOST_BROADCAST_IDS = 2_000_000
#: Orders by which buckets choose the member that the others are compared with.
HUB_ORDERS = 4
#: Members of a tile: two tiles make matrices of some 2,000 times 2,000.
TILE_MEMBERS = 1000
#: Shingles that are multiplied, and members that are judged, at once.
COLUMNS, STRIPE = 1024, 128


class Shingler:
    """Distinct shingle hashes of a text, sorted; a text of fewer words is one shingle of all its words."""

    def __init__(self, size: int):
        self.size, self.words, self.factors = size, WordHashes(), odd("shingle", max(size, 1))

    def of(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()  # bytes: lowers A-Z, splits at ASCII blanks
        if not words:
            return np.zeros(0, np.uint64)
        hashes = self.words.of(words)
        if len(words) < self.size:
            whole = rolling(hashes, len(words), self.factors)
            return whole ^ np.uint64(len(words))
        h = rolling(hashes, self.size, self.factors)
        h ^= h >> np.uint64(31)
        return np.unique(h * np.uint64(0xBF58476D1CE4E5B9))


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each universal hash a * x + b over a set."""
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        values = a[:, None] * shingles[None, at : at + 2048]
        values += b[:, None]
        np.minimum(least, values.min(axis=1), out=least)
    return least


def set_hash(shingles: np.ndarray, factors: np.ndarray) -> list[np.int64]:
    """Two 64-bit hashes of a set."""
    x = shingles ^ (shingles >> np.uint64(32))
    return [((x * f) ^ (x * f >> np.uint64(29))).sum(dtype=np.uint64).view(np.int64) for f in factors]


def signatures(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, the set's hash (s1, s2), band hashes, and the minima at 16 bits each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(shingle)
        a, b = odd("minhash a", bands * rows), odd("minhash b", bands * rows)
        row_factors, set_factors = odd("band", rows), odd("set", 2)
        for batch in batches:
            out = []
            for t in batch.column(1):
                s = shingler.of(t.as_py())
                if not len(s):
                    out.append((0, None, None, None, None))
                    continue
                m = minima(s, a, b)
                band = ((m ^ (m >> np.uint64(29))).reshape(bands, rows) * row_factors).sum(axis=1, dtype=np.uint64)
                out.append((len(s), *set_hash(s, set_factors), band.view(np.int64), (m >> np.uint64(48)).astype(np.uint16).tobytes()))
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.list_(pa.int64())), pa.array(cols[4], pa.binary())],
                names=["doc_id", "n_shingles", "s1", "s2", "bands", "sig"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>, sig binary")


def only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents with these ids; few ids go to every task, more meet the documents in a shuffle."""
    return docs.join(F.broadcast(ids) if ids.count() <= MOST_BROADCAST_IDS else ids, "doc_id", "left_semi")


def full_sets(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """doc_id and the shingle hashes of the documents ``ids``, as bytes."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(shingle)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingler.of(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())],
                                             names=["doc_id", "set"])

    return shared_table(only(docs, ids).mapInArrow(sets, "doc_id long, set binary"), "near-sets")


def linked_parts(parts: np.ndarray, sets: list[np.ndarray], percent: int) -> set[tuple[int, int]]:
    """Pairs of different parts that some two members link, from exact intersections of all members."""
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    held = count[column] > 1  # a shingle of one member meets none
    number = np.cumsum(count > 1) - 1
    owner, column = owner[held], number[column[held]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(number[-1]) + 1, COLUMNS):
        lo, hi = np.searchsorted(column, (at, at + COLUMNS))
        member = np.zeros((len(sets), COLUMNS), np.float32)
        member[owner[lo:hi], column[lo:hi] - at] = 1
        both += member @ member.T
    found = set()
    for at in range(0, len(sets), STRIPE):  # a few rows of the matrix at once: its comparisons are wider than its counts
        mine = slice(at, at + STRIPE)
        ok = (100 * both[mine] >= percent * (sizes[mine, None] + sizes[None, :] - both[mine])) & (parts[mine, None] < parts[None, :])
        i, j = np.nonzero(ok)
        found.update(zip(parts[j].tolist(), parts[at + i].tolist()))
    return found


def dealt_tiles(here: DataFrame, tile_shingles: int) -> DataFrame:
    """Members (bucket, a, b, doc_id, part) of each two tiles a and b of a bucket; buckets of the same members count once.

    A tile has about ``tile_shingles`` shingles and ``TILE_MEMBERS`` members at most.
    """
    mark = lambda seed: F.xxhash64("doc_id", F.lit(seed))
    alike = here.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(mark(1)).alias("x"), F.bit_xor(mark(2)).alias("y"),
                                       F.sum("n_shingles").alias("total"), F.min("part").alias("a"), F.max("part").alias("b")).where("a <> b")
    once = alike.groupBy("n", "x", "y", "total").agg(F.min("bucket").alias("bucket")).select("bucket", F.greatest(
        F.ceil(F.col("total") / tile_shingles), F.ceil(F.col("n") / TILE_MEMBERS)).alias("k"))
    dealt = here.join(once, "bucket").withColumn("tile", F.pmod(F.xxhash64("doc_id"), F.col("k"))).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1))).where("k = 1 OR other <> tile")
    return dealt.select("bucket", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "doc_id", "part")


def links_across(here: DataFrame, docs: DataFrame, shingle: int, percent: int, tile_shingles: int) -> DataFrame:
    """Links (u, v) between parts whose members share a bucket (bucket, doc_id, part, n_shingles).

    Each two tiles of a bucket meet in one task, which compares their members
    as matrices and sends on only which parts are linked, so no pair of
    documents becomes a row.
    """
    dealt = shared_table(dealt_tiles(here, tile_shingles), "near-tiles")
    full = full_sets(docs, shared_table(dealt.select("doc_id").distinct(), "near-ids"), shingle)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, sets = None, [], []

        def settle() -> pa.RecordBatch:
            found = linked_parts(np.array(parts), sets, percent) if len(set(parts)) > 1 else set()
            u, v = zip(*found) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for batch in batches:
            keys = zip(*(batch.column(i).to_pylist() for i in range(4)))
            for (*now, part), data in zip(keys, batch.column(4)):
                if now != key:
                    if sets:
                        yield settle()
                    key, parts, sets = now, [], []
                parts.append(part)
                sets.append(np.frombuffer(data.as_py(), np.uint64))
        if sets:
            yield settle()

    met = dealt.join(full, "doc_id").select("bucket", "a", "b", "part", "set")
    return met.repartition("bucket", "a", "b").sortWithinPartitions("bucket", "a", "b").mapInArrow(compare, "u long, v long")


def alike(pairs: DataFrame, sigs: DataFrame, docs: DataFrame, shingle: int, percent: int, margin: float) -> DataFrame:
    """Those of the pairs (u, v) whose full sets agree: first by signature, within ``margin`` of the limit, then exactly."""
    both = pairs.join(sigs.select(F.col("doc_id").alias("u"), F.col("sig").alias("su"), F.col("n_shingles").alias("nu")), "u").join(
        sigs.select(F.col("doc_id").alias("v"), F.col("sig").alias("sv"), F.col("n_shingles").alias("nv")), "v")
    both = both.where(100 * F.least("nu", "nv") >= percent * F.greatest("nu", "nv"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [np.mean(np.frombuffer(x, np.uint16) == np.frombuffer(y, np.uint16)) >= percent / 100 - margin
                    for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], names=["u", "v"])

    close = shared_table(both.select("u", "v", "su", "sv").mapInArrow(near, "u long, v long").distinct(), "near-close")
    full = full_sets(docs, shared_table(close.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct(), "near-ids"), shingle)

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], names=["u", "v"])

    return close.join(full.select(F.col("doc_id").alias("u"), F.col("set").alias("x")), "u").join(
        full.select(F.col("doc_id").alias("v"), F.col("set").alias("y")), "v").select("u", "v", "x", "y").mapInArrow(confirm, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """Node and least node of its component (node, least), by alternating large-star and small-star.

    Large-star links every larger neighbour of a node to the least of its
    neighbourhood, small-star every smaller neighbour and the node itself.
    Both are a minimum per node joined back to the edges, so a node of any
    degree spreads over tasks. Each round is written to the shared folder;
    the rounds end when a round changes nothing.
    """
    edges = shared_table(edges.where("u <> v").select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).select("u", "v").distinct(), "star-edges")
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = mark(edges)
    while True:
        sides = edges.union(edges.select("v", "u"))
        least = sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = sides.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = shared_table(large, "star-large")
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(small, "u")
        edges = shared_table(linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            small.select("u", F.col("m").alias("v"))).distinct(), "star-edges")
        after = mark(edges)
        if after == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("least"))
        before = after


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = 32, rows: int = 4, margin: float = 0.19,
                    tile_shingles: int = 200_000) -> DataFrame:
    """The near-duplicate component of every document: doc_id, n_shingles, component_id, kept.

    Words are runs without ASCII blanks of the text with A-Z lowered; two
    documents are linked when their sets of ``shingle``-word shingles have
    100 * intersection >= ``percent`` * union. Documents of equal sets form a
    class, which the smallest doc_id stands for from here on. Representatives
    that share a band meet in a bucket, where each is compared with a hub, and
    in ``HUB_ORDERS`` bands out of as many with other hubs; links are confirmed
    on signatures and then on full sets. A bucket whose members are still in
    different components then compares all of them, tile by tile, on full
    sets, so no member's partners are cut off. With 32 bands of 4 rows a pair
    at 0.8 meets nowhere once in 20 million, and the signature margin loses as
    few.

    component_id is the smallest doc_id reachable, kept says that it is the
    document's own. Documents without words have no shingles and are their
    own component. A null doc_id stands alone: null component, kept. Rows
    that repeat a doc_id are each returned and judged by their own text. An
    empty table gives none. Only doc_id and text are read.
    """
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    features = shared_table(signatures(own, shingle, bands, rows), "near-features")
    named = features.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = shared_table(named.groupBy("s1", "s2").agg(F.min_by(F.struct("doc_id", "n_shingles", "bands", "sig"), "doc_id").alias("c")).select(
        "s1", "s2", "c.*"), "near-classes")
    placed = classes.select("doc_id", "n_shingles", F.posexplode("bands").alias("band", "key")).select(
        "doc_id", "n_shingles", F.xxhash64("band", "key").alias("bucket"), F.xxhash64("doc_id", F.col("band") % HUB_ORDERS).alias("order"))
    full = placed.groupBy("bucket").agg(F.min_by("doc_id", "order").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = shared_table(placed.join(full, "bucket").select("bucket", "doc_id", "n_shingles", "hub", "n"), "near-met")
    texts = own.where("doc_id IS NOT NULL")
    pairs = met.where("doc_id <> hub").select(F.least("doc_id", "hub").alias("u"), F.greatest("doc_id", "hub").alias("v")).distinct()
    pairs = shared_table(pairs, "near-pairs")
    links = shared_table(alike(pairs, classes, texts, shingle, percent, margin), "near-links")
    label = components(links)

    here = met.where("n > 2").join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "bucket", "doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("part"))
    more = shared_table(links_across(here, texts, shingle, percent, tile_shingles), "near-links")
    if not more.isEmpty():
        label = components(links.union(more))

    found = features.join(classes.select("s1", "s2", F.col("doc_id").alias("rep")), ["s1", "s2"], "left").join(
        label.withColumnRenamed("node", "rep"), "rep", "left")
    part = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "rep", "doc_id"))
    return found.select("doc_id", "n_shingles", part.alias("component_id"), F.coalesce(F.col("doc_id") == part, F.lit(True)).alias("kept"))
