"""Substring dedup: a merged count-min sketch sets aside windows that occur once, a second pass groups the rest exactly."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from leafgrade.llm.hashing import WordHashes, odd, rolling

#: Cells of a sketch row that travel as one piece.
PIECE = 1 << 20
#: Windows that a task sorts at once.
CHUNK = 1 << 20
#: Stands for a null doc_id, which counts as larger than all others.
LAST = 2**63 - 1


class Scanner:
    """Window hashes of a text, and for each window its anchor: the least hash among its groups of ``group`` words.

    Equal windows have equal anchors, so an anchor's count is never below its
    windows' counts; a text has about a fifth as many anchors as windows.
    """

    def __init__(self, window: int):
        self.window, self.group = window, max(1, window // 2)
        self.words, self.window_factors, self.group_factors = WordHashes(), odd("window", window), odd("group", self.group)

    def read(self, text: str | None) -> tuple[list[bytes], np.ndarray]:
        words = (text or "").encode().split()  # bytes split at ASCII blanks only
        return words, self.words.of(words) if len(words) >= self.window else np.zeros(0, np.uint64)

    def anchors(self, hashes: np.ndarray) -> np.ndarray:
        groups = rolling(hashes, self.group, self.group_factors)
        n = len(hashes) - self.window + 1
        least = groups[:n].copy()
        for j in range(1, self.window - self.group + 1):
            np.minimum(least, groups[j : n + j], out=least)
        return least

    def windows(self, hashes: np.ndarray) -> np.ndarray:
        return rolling(hashes, self.window, self.window_factors)


def cells(anchors: np.ndarray, depth: int, bits: int) -> list[np.ndarray]:
    return [(anchors * f) >> np.uint64(64 - bits) for f in odd("cell", depth)]


def repeated_cells(texts: DataFrame, window: int, depth: int, bits: int) -> np.ndarray:
    """Which cells of the merged count-min sketch count two or more, packed into bits, one row per hash.

    Each task counts its texts' anchors up to two in a sketch of its own and
    sends the pieces that are not empty, compressed; the pieces of one place
    stream through one task, which adds them. What reaches the driver is
    ``depth * 2**bits / 8`` bytes, whatever the input.
    """
    piece = min(PIECE, 1 << bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, table = Scanner(window), np.zeros((depth, 1 << bits), np.uint8)
        waiting: list[np.ndarray] = []

        def add() -> None:
            for row, at in zip(table, cells(np.concatenate(waiting), depth, bits)):
                at, n = np.unique(at, return_counts=True)
                row[at] = np.minimum(row[at] + np.minimum(n, 2), 2)
            waiting.clear()

        for batch in batches:
            for t in batch.column(0):
                _, hashes = scanner.read(t.as_py())
                if len(hashes):
                    a = scanner.anchors(hashes)
                    waiting.append(a[np.append(True, a[1:] != a[:-1])])
            if sum(map(len, waiting)) > CHUNK:
                add()
        if waiting:
            add()
        for r in range(depth):
            for p in range(0, 1 << bits, piece):
                if (part := table[r, p : p + piece]).any():
                    packed = np.concatenate([np.packbits(part >= 1), np.packbits(part >= 2)])
                    yield pa.RecordBatch.from_pydict({"r": [r], "p": [p // piece], "data": [zlib.compress(packed.tobytes(), 1)]},
                                                     schema=pa.schema([("r", pa.int32()), ("p", pa.int32()), ("data", pa.binary())]))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, once, twice = None, None, None
        flush = lambda: pa.RecordBatch.from_pydict({"r": [key[0]], "p": [key[1]], "data": [zlib.compress(twice.tobytes(), 1)]},
                                                   schema=pa.schema([("r", pa.int32()), ("p", pa.int32()), ("data", pa.binary())]))
        for batch in batches:
            for r, p, data in zip(*(c.to_pylist() for c in batch.columns)):
                one, two = np.split(np.frombuffer(zlib.decompress(data), np.uint8), 2)
                if key == (r, p):
                    twice |= two | (once & one)
                    once |= one
                else:
                    if key:
                        yield flush()
                    key, once, twice = (r, p), one.copy(), two.copy()
        if key:
            yield flush()

    schema = "r int, p int, data binary"
    merged = texts.mapInArrow(count, schema).repartition("r", "p").sortWithinPartitions("r", "p").mapInArrow(merge, schema)
    out = np.zeros((depth, (1 << bits) // 8 or 1), np.uint8)
    for r, p, data in merged.toLocalIterator():
        part = np.frombuffer(zlib.decompress(data), np.uint8)
        out[r, p * piece // 8 : p * piece // 8 + len(part)] = part
    return out


def repeated_windows(docs: DataFrame, window: int, sketch: np.ndarray, bits: int) -> DataFrame:
    """Windows of documents (d, tag, text) for which a smaller doc_id has them too: d, tag, place, n (n windows on from there).

    Windows whose anchor the sketch has once are dropped in the task that reads
    them. Of the others, a task sorts a chunk at a time and sends one row per
    distinct window, for its smallest doc_id; larger ones in the chunk are
    settled there and go on as runs. So a window has no more rows in the
    grouping than there are chunks, however many documents hold it.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, waiting = Scanner(window), []

        def chunk() -> pa.RecordBatch:
            h, d, tag, place = (np.concatenate(x) for x in zip(*waiting))
            waiting.clear()
            order = np.lexsort((place, tag, d, h))
            h, d, tag, place = h[order], d[order], tag[order], place[order]
            first = np.append(True, h[1:] != h[:-1])
            least = d[np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))]
            again = d > least
            lead = ~again & np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1]) | (tag[1:] != tag[:-1]) | (place[1:] != place[:-1]))
            order = np.lexsort((place[again], tag[again], d[again]))
            d2, t2, p2 = d[again][order], tag[again][order], place[again][order]
            start = np.flatnonzero(np.append(True, (d2[1:] != d2[:-1]) | (t2[1:] != t2[:-1]) | (p2[1:] != p2[:-1] + 1))) if len(d2) else np.zeros(0, int)
            n2 = np.diff(np.append(start, len(d2)))
            return pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([h[lead].view(np.int64), (p2 * 0x9E3779B97F4A7C1 + d2 + t2)[start]])),
                pa.array(np.concatenate([d[lead], d2[start]])), pa.array(np.concatenate([tag[lead], t2[start]])),
                pa.array(np.concatenate([place[lead], p2[start]])), pa.array(np.concatenate([np.ones(lead.sum(), np.int32), n2.astype(np.int32)])),
                pa.array(np.concatenate([np.zeros(lead.sum(), bool), np.ones(len(start), bool)]))], names=["h", "d", "tag", "place", "n", "settled"])

        size = 0
        for batch in batches:
            for d, tag, t in zip(batch.column(0), batch.column(1), batch.column(2)):
                text = t.as_py()
                _, hashes = scanner.read(text)
                if not len(hashes):
                    continue
                a = scanner.anchors(hashes)
                hit = np.ones(len(a), bool)
                for row, at in zip(sketch, cells(a, len(sketch), bits)):
                    hit &= (row[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1 == 1
                if hit.any():
                    at = np.flatnonzero(hit)
                    h, first = np.unique(scanner.windows(hashes)[at], return_index=True)
                    waiting.append((h, np.full(len(h), d.as_py(), np.int64), np.full(len(h), tag.as_py(), np.int64), at[first]))
                    size += len(h)
                    if size >= CHUNK:
                        yield chunk()
                        size = 0
        if waiting:
            yield chunk()

    found = docs.mapInArrow(scan, "h long, d long, tag long, place long, n int, settled boolean")
    least = F.min("d").over(W.partitionBy("h", "settled"))
    return found.withColumn("least", least).where("settled OR d > least").select("d", "tag", "place", "n")


def drop_repeated_passages(docs: DataFrame, window: int = 13, depth: int = 2, most_bits: int = 26, with_text: bool = True) -> DataFrame:
    """Removes words of repeated passages: doc_id, n_words, n_removed, kept_sha256 and, if wanted, kept_text.

    A window is ``window`` consecutive words (runs without ASCII blanks) of one
    document; every word under a window that also starts in a document with a
    smaller doc_id goes. Windows are those of the input, not of what is left.

    First pass: tasks count anchors in count-min sketches, which are merged. A
    sketch row has about a cell for every 12 bytes of text, at most
    ``2**most_bits``; the bound keeps the broadcast small, and beyond it the
    sketch only sets aside fewer windows. Second pass: windows it counts twice
    are grouped by 64-bit hash. Last, the removed places and the texts are
    dealt to tasks by doc_id and a hash of the text and sorted, so they meet in
    one stream, and texts that share a doc_id spread.

    Null or short texts have no windows and lose nothing. A null doc_id counts
    as the largest. Rows that repeat a doc_id are judged each by its own text;
    none removes from another. Only doc_id and text are read. An empty table
    gives none.
    """
    text = F.col("text").cast("string")
    own = docs.select(F.col("doc_id").cast("long"), F.coalesce("doc_id", F.lit(LAST)).cast("long").alias("d"), text.alias("text"), F.xxhash64(text).alias("tag"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(most_bits, max(10, (size // 12).bit_length()))
    sketch = repeated_cells(own.select("text"), window, depth, bits)
    gone = repeated_windows(own.select("d", "tag", "text"), window, sketch, bits)
    none = lambda t: F.lit(None).cast(t)
    rows = gone.select("d", "tag", F.lit(0).alias("is_doc"), "place", "n", none("long").alias("doc_id"), none("string").alias("text")).unionByName(
        own.select("d", "tag", F.lit(1).alias("is_doc"), none("long").alias("place"), none("int").alias("n"), "doc_id", "text"))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(window)
        owner, starts, lengths = None, [], []
        for batch in batches:
            d, tag, is_doc = (batch.column(i).to_numpy() for i in range(3))
            place, n = batch.column(3).fill_null(0).to_numpy(), batch.column(4).fill_null(0).to_numpy()
            out, since = [], 0
            for i in np.flatnonzero(is_doc):
                if owner != (d[i], tag[i]):
                    owner, starts, lengths = (d[i], tag[i]), [], []
                if since < i:
                    starts, lengths = [*starts, place[since:i].astype(np.int64)], [*lengths, n[since:i].astype(np.int64)]
                since = i + 1
                out.append((batch.column(5)[i].as_py(), *_kept(scanner, batch.column(6)[i].as_py(), starts, lengths)))
            if since < len(d):  # places whose document is in the next batch
                if owner != (d[-1], tag[-1]):
                    owner, starts, lengths = (d[-1], tag[-1]), [], []
                starts, lengths = [*starts, place[since:].astype(np.int64)], [*lengths, n[since:].astype(np.int64)]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][: 4 + with_text]
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [*3 * [pa.int64()], *2 * [pa.string()]])][: len(names)], names=names)

    return rows.repartition("d", "tag").sortWithinPartitions("d", "tag", "is_doc").mapInArrow(
        settle, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)


def _kept(scanner: Scanner, text: str | None, starts: list[np.ndarray], lengths: list[np.ndarray]) -> tuple[int, int, str, str]:
    """Words, removed words, hash and text of what is kept of a document, given the places of its removed windows."""
    words, hashes = scanner.read(text)
    removed = 0
    if starts and len(hashes):
        at, n = np.concatenate(starts), np.concatenate(lengths)
        count = len(hashes) - scanner.window + 1
        edges = np.zeros(count + 1, np.int64)
        np.add.at(edges, at, 1)
        np.add.at(edges, at + n, -1)
        hit = np.cumsum(edges[:-1]) > 0
        windows = scanner.windows(hashes)
        hit = np.isin(windows, windows[hit])  # a window's further places in the document have its verdict
        at = np.flatnonzero(hit)
        edges = np.zeros(len(words) + 1, np.int64)
        np.add.at(edges, at, 1)
        np.add.at(edges, at + scanner.window, -1)
        cover = np.cumsum(edges[:-1]) > 0
        removed = int(cover.sum())
        kept = [w for w, gone in zip(words, cover) if not gone] if removed else words
    else:
        kept = words
    whole = b" ".join(kept)
    return len(words), removed, hashlib.sha256(whole).hexdigest(), whole.decode()
