"""Periodic runs against a plain search of all lags."""

import random
import time

import pyarrow as pa

from leafgrade.llm import queries
from leafgrade.llm.periodic_runs import _runs_of, periodic_runs


def plain(words, least=12):
    """Runs by comparing the words at every lag, and the words outside repeated periods."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = q
        while i < n:
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            if j - i >= max(q, least - q):
                found.setdefault((i - q, j - i + q), q)
            i = max(j, i + 1)
    runs = sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return runs, " ".join(w for i, w in enumerate(words) if i not in gone)


def made(rng):
    words = []
    for _ in range(rng.choice([0, 1, 3, 8])):
        if words and rng.random() < 0.5:
            words += words[-rng.randint(1, min(len(words), 20)):] * rng.randint(1, 4)
        words += [f"w{rng.randint(0, rng.choice([1, 2, 40]))}" for _ in range(rng.randint(1, 9))]
    return words


def test_runs_equal_plain_search():
    rng = random.Random(3)
    for _ in range(150):
        texts = [rng.choice([" ", "\n\t"]).join(["", *made(rng), ""]) if rng.random() > 0.05 else None for _ in range(rng.randint(0, 9))]
        n, runs, left = _runs_of(pa.array(texts, pa.string()), 12)
        for text, count, found, kept in zip(texts, n.to_pylist(), runs.to_pylist(), left.to_pylist()):
            words = (text or "").split()
            assert (count, [(r["start"], r["length"], r["period"]) for r in found], kept) == (len(words), *plain(words))


def test_a_word_that_fills_a_long_text_takes_linear_steps():
    start = time.perf_counter()
    for text in ("a " * 200_000, "a b " * 100_000, "x y z u v w k a a a a b\n" * 20_000):
        _, runs, left = _runs_of(pa.array([text]), 12)
        assert len(runs[0]) == 1 and len(left[0].as_py().split()) == len(set(text.split())) + 3 * ("x" in text)
    assert time.perf_counter() - start < 60


def test_odd_rows(spark, odd_docs):
    rows = periodic_runs(odd_docs).collect()
    got = {(r.doc_id, r.n_words): r for r in rows}
    assert len(rows) == 10 and got[1, 0].runs == got[2, 0].runs == got[3, 0].runs == [] and got[1, 0].collapsed == ""
    assert sum(r.doc_id == 6 for r in rows) == 2 and sum(r.doc_id is None for r in rows) == 2
    assert got[7, 1].collapsed == " no break\x1c"
    long = got[5, 30_000]
    assert [(r.start, r.length, r.period) for r in long.runs] == [(0, 30_000, 1000)] and len(long.collapsed.split()) == 1000
    assert periodic_runs(odd_docs.limit(0)).collect() == []


def test_query_equals_plain_search(spark, docs_frame, tmp_path):
    import hashlib
    import zlib
    rng = random.Random(5)
    texts = {i: " ".join(made(rng)) for i in range(300)}
    docs_frame([*texts.items(), (300, None), (None, "a b " * 9)]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    bent = 0
    for i, text in texts.items():
        words, h = text.split(), zlib.crc32(str(i).encode())
        if h % 10 == 0 and words:
            bent, g, n = bent + 1, h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        runs, kept = plain(words)
        s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        r = got[i]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(runs), s, n, q, 1000 * n // q if runs else None)
        assert (r.runs_sha256, r.collapsed_sha256) == (sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(kept))
    assert bent > 10 and got[300].n_runs == 0 and got[300].collapsed_sha256 == sha("") and got[None].period == 2
