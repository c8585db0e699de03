"""Toxicity of kinds that few voters know, and the memory of comparing large buckets."""

import random
import tracemalloc
import zlib

import numpy as np

from leafgrade.llm.near_dup import linked_parts
from leafgrade.llm.toxicity import label_model, score_toxicity


def test_labels_outlast_voters_that_miss_them():
    rng = np.random.default_rng(3)
    y = rng.random(4000) < 0.2
    known = y & (rng.random(4000) < 0.6)
    votes = np.where(known[:, None], np.where(rng.random((4000, 40)) < 0.8, 1, -1), -1)
    votes = np.hstack([votes, np.where((votes == 1).any(1), -1, 0)[:, None]])
    p, _ = label_model(votes, np.where(y, 0.995, 0.005))
    assert np.mean(p[y] > 0.5) > 0.99 and np.mean(p[~y] < 0.5) > 0.99


def test_words_whose_start_is_toxic_only_in_numbers(spark, docs_frame):
    rng = random.Random(4)
    ends = [a + b + c for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    rows = []
    for i in range(1500):
        words = [rng.choice(ends) + rng.choice(ends) for _ in range(60)]
        toxic = rng.random() < 0.15
        # a clean text may hold one such word by chance, a toxic one holds several
        words[:0] = ["ruv" + rng.choice(ends) + rng.choice(ends) for _ in range(rng.randint(5, 9) if toxic else rng.random() < 0.4)]
        rows.append((i, " ".join(words), int(toxic)))
    docs, labels = docs_frame([r[:2] for r in rows]), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in score_toxicity(docs, labels).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i] for i, y in held if y]) >= 0.95 and np.mean([got[i] for i, y in held if not y]) <= 0.02


def test_large_tiles_take_little_memory():
    rng = np.random.default_rng(5)
    common = np.arange(60, dtype=np.uint64)
    sets = [np.concatenate([common, rng.integers(10**6, 10**9, 5).astype(np.uint64)]) for _ in range(2000)]
    tracemalloc.start()
    found = linked_parts(np.arange(2000) % 2, sets, 80)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == {(1, 0)} and peak < 80 << 20
