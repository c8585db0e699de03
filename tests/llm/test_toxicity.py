"""Toxicity: held-out accuracy, labels that must not matter, odd input."""

import random
import zlib

import numpy as np

from leafgrade.llm.toxicity import label_model, score_toxicity, training_rows

BAD = ["moron", "trash", "scum", "clown"]


def made(n, seed):
    rng = random.Random(seed)
    for i in range(n):
        words = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.randint(0, 9)}ning" for _ in range(rng.randint(5, 60))]
        toxic = rng.random() < 0.2
        for _ in range(rng.randint(1, 3) if toxic else 0):
            words.insert(rng.randint(0, len(words)), rng.choice(BAD))
        yield i, " ".join(words), int(toxic)


def test_held_out_accuracy_and_unread_columns(spark, docs_frame):
    rows = list(made(600, 1))
    docs = docs_frame([(i, t) for i, t, _ in rows])
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    labels = lambda flip: spark.createDataFrame([(i, 1, (1 - y) if flip and held(i) else y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in score_toxicity(docs, labels(False)).collect()}
    assert all(got[i].held_out == held(i) for i, _, _ in rows)
    out = [got[i].predicted == y for i, _, y in rows if held(i)]
    assert np.mean(out) >= 0.97
    assert {i: r.score for i, r in got.items()} == {r.doc_id: r.score for r in score_toxicity(docs, labels(True)).collect()}


def test_odd_rows(spark, odd_docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, None), (None, 1), (5, 0), (6, 1), (6, 0)], "doc_id long, toxic int")
    rows = score_toxicity(odd_docs, labels).collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert all(r.held_out for r in rows if r.doc_id is None)
    assert {r.predicted for r in score_toxicity(odd_docs, labels.limit(0)).collect()} == {0}
    assert score_toxicity(odd_docs.limit(0), labels).collect() == []


def test_label_model_weighs_voters():
    rng = np.random.default_rng(2)
    y = rng.random(3000) < 0.3
    good = np.where(rng.random((3000, 3)) < 0.9, y[:, None], ~y[:, None]).astype(int)
    coin = (rng.random((3000, 1)) < 0.5).astype(int)
    hint = np.where(np.arange(3000) % 10 == 0, np.where(y, 0.9, 0.1), 0.3)
    p, right = label_model(np.hstack([good, coin, coin, coin]), hint)
    assert np.mean((p > 0.5) == y) > 0.95 and right[:3].min() > 0.85 and right[3:].max() < 0.6


def test_a_repeated_id_trains_once(spark, docs_frame):
    docs = docs_frame([(1, f"text number {i}") for i in range(200)] + [(i, "other") for i in range(2, 40)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 40)], "doc_id long, toxic int")
    trained = [i for i in range(1, 40) if zlib.crc32(str(i).encode()) % 5]
    assert 1 in trained and training_rows(docs, labels, 1000).count() == len(trained)
