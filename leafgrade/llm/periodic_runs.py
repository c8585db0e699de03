"""Periodic runs of words: diagonals of equal words at a fixed lag open, grow and, when they end, give runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgrade.llm.common import slices

RUN = "struct<start:long,length:long,period:long>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
#: Bytes of text that a task looks at together; a longer text is looked at alone.
TOGETHER = 8 << 20


def _named(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names 0, 1, ... of equal keys, and whether a key occurs more than once."""
    _, name, count = np.unique(key, return_inverse=True, return_counts=True)
    return name, count[name] > 1


def _unlike(at: np.ndarray, name: np.ndarray, edge: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and lags (low <= lag < high) of equally named earlier places whose ``edge`` differs.

    In a stretch of period p all places p apart share name and edge, so they
    form one block. A walk back takes or skips one block a step: a word that
    fills a text gives one step per place and not one per pair.
    """
    order = np.argsort(name, kind="stable")
    at, name, edge = at[order], name[order], edge[order]
    k = np.arange(len(at))
    new = np.append(True, name[1:] != name[:-1])[: len(at)]
    block = np.maximum.accumulate(np.where(new | np.append(True, edge[1:] != edge[:-1])[: len(at)], k, 0))
    key = name * (at.max(initial=0) + high + 1) + at
    far = np.maximum(np.maximum.accumulate(np.where(new, k, 0)), np.searchsorted(key, key - high + 1))
    near = np.searchsorted(key, key - low, "right")
    cur, places, lags = block - 1, [], []
    while True:
        on = cur >= far[k]
        k, cur = k[on], cur[on]
        if not len(k):
            break
        first = np.maximum(block[cur], far[k])
        size = np.where(edge[cur] == edge[k], 0, np.maximum(np.minimum(cur + 1, near[k]) - first, 0))
        mine = np.repeat(k, size)
        theirs = np.arange(len(mine)) + np.repeat(first - (np.cumsum(size) - size), size)
        places.append(at[mine])
        lags.append(at[mine] - at[theirs])
        cur = block[cur] - 1
    return (np.concatenate(places), np.concatenate(lags)) if places else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def word_runs(word: np.ndarray, text: np.ndarray, least: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and smallest period of all runs of ``word``, by start, then period.

    ``word`` holds the words of texts as numbers, each text between marks that
    occur once; ``text`` tells the text of a place. A diagonal of lag q is a
    maximal stretch of places whose word stands q words earlier, too. It gives
    a run of period q if it has at least q and ``least`` - q places.

    Places are followed by width: at width b, a diagonal of lag b to 2b - 1 is
    long enough only if b words in a row occur earlier, so the earlier
    occurrences of words widen to those of 2, 4, 8 ... words (named exactly, not
    by hashes) and places without any leave. A diagonal opens where the words
    before differ and ends where the words after differ; between, it grows by
    one a word, so its length is the distance of the two. Work and memory are
    about n a width for n words, whatever they are.
    """
    name, more = _named(text * (word.max(initial=0) + 1) + word)
    at = np.flatnonzero(more)
    name, width = name[more], 1
    found: list[np.ndarray] = []
    while len(at):
        if width >= 4:
            low, high = (1 if width == 4 else width), 2 * width
            first, lag = _unlike(at, name, word[at - 1], low, high)
            last, lag2 = _unlike(at, name, word[at + width], low, high)
            a, b = np.lexsort((first, lag)), np.lexsort((last, lag2))
            first, lag, size = first[a], lag[a], last[b] + width - first[a]
            long = size >= np.maximum(lag, least - lag)
            found.append(np.stack([(first - lag)[long], (size + lag)[long], lag[long]]))
        after = np.searchsorted(at, at + width)
        both = np.flatnonzero(at[np.minimum(after, len(at) - 1)] == at + width)
        wide, more = _named(name[both] * (name.max() + 1) + name[after[both]])
        at, name, width = at[both][more], wide[more], 2 * width
    start, length, period = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    # a stretch shows at multiples of its smallest period as well
    least_period = np.append(True, (start[1:] != start[:-1]) | (length[1:] != length[:-1]))[: len(start)]
    start, length, period = start[least_period], length[least_period], period[least_period]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _runs_of(texts: pa.Array, least: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Number of words, runs, and the words outside repeated periods, of each text."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words, offsets = split.flatten(), split.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    offsets = np.append(0, np.cumsum(real))[offsets]
    words = words.filter(pa.array(real))
    n = np.diff(offsets)
    text = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(words)) + text + 1
    codes = words.dictionary_encode()
    kinds = len(codes.dictionary)
    word, owner = np.arange(kinds, kinds + len(words) + len(n) + 1), np.zeros(len(words) + len(n) + 1, np.int64)
    word[place], owner[place] = codes.indices.to_numpy(), text
    start, length, period = word_runs(word, owner, least)
    edges = np.zeros(len(word) + 1, np.int64)
    np.add.at(edges, start + period, 1)
    np.add.at(edges, start + length, -1)
    kept = np.cumsum(edges)[:-1][place] == 0
    left = pa.ListArray.from_arrays(np.append(0, np.cumsum(kept))[offsets].astype(np.int32), words.filter(pa.array(kept)))
    whose = owner[start]
    parts = [start - offsets[whose] - whose - 1, length, period]
    ends = np.searchsorted(whose, np.arange(len(n) + 1)).astype(np.int32)
    runs = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(p, pa.int64()) for p in parts], fields=list(_RUN)))
    return pa.array(n, pa.int64()), runs, pc.binary_join(left, " ")


def periodic_runs(docs: DataFrame, least: int = 12) -> DataFrame:
    """Runs of repeated words in every text: doc_id, n_words, runs (start, length, period) and collapsed text.

    A word is a run of characters without ASCII blanks, numbered from 0. A run
    is a stretch of at least ``least`` words, and of two periods, that no
    neighbouring word extends at its smallest period; runs come by start, then
    period. ``collapsed`` are the words that no run holds after its first
    period, joined by one space.

    A text is a row and its work stays in its row's task: memory is a multiple
    of the longest text. Null and empty texts have no words and no runs, and
    "" as collapsed. Rows are judged each by itself, so null and repeated ids
    give a row each. An empty table gives none. Only doc_id and text are read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, TOGETHER):
                n, runs, left = _runs_of(part.column(1), least)
                yield pa.RecordBatch.from_arrays([part.column(0), n, runs, left], names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, f"doc_id long, n_words long, runs array<{RUN}>, collapsed string")
