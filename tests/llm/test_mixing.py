"""Source mixing: targets by repeated resharing, quotas and words near them."""

import re

import pytest

from leafgrade.llm.mixing import apportion, mix_sources, shard_of


def targets(sizes):
    """The contract's loop: share by weight, stop at three times the size, reshare."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, out = float(sum(sizes.values())), set(names), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return out | share
        out |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(3.0 * sizes[s] for s in over)
        open_ -= over
    return out


def check(rows, docs, slack):
    size = {(i, s): len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, s in docs}
    per = {}
    for (i, s), n in size.items():
        per[s] = per.get(s, 0) + n
    want = targets(per)
    took = {}
    for r in rows:
        assert r.size == size[r.doc_id, r.source] and r.source_size == per[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size
        took[r.source] = took.get(r.source, 0) + r.taken
    for s in took:
        assert abs(took[s] - want[s]) <= slack, s


@pytest.mark.parametrize("shard_words", [100, 1 << 20])
def test_words_come_near_the_targets(docs_frame, shard_words):
    docs = [(i, "w " * (7 * i % 90), ["big", "mid", "tiny", None][0 if i % 3 else 1 + i % 9 // 3]) for i in range(240)]
    rows = mix_sources(docs_frame(docs), block_words=4, shard_words=shard_words).collect()
    assert len(rows) == len(docs)
    check(rows, docs, 4 * (2 if shard_words > 100 else 90))
    assert sorted(mix_sources(docs_frame(docs[::-1]), block_words=4, shard_words=shard_words).collect(), key=str) == sorted(rows, key=str)


def test_small_sources_stop_at_three_times(docs_frame):
    docs = [(1, "a b", "a"), (2, "w " * 400, "b"), (3, "c " * 300, "c"), (4, None, "d"), (5, "", None)]
    check(mix_sources(docs_frame(docs), block_words=1).collect(), docs, 3)


def test_odd_rows(odd_docs):
    rows = mix_sources(odd_docs).collect()
    assert len(rows) == 10 and sum(r.size == 0 and r.taken == 0 for r in rows) == 4
    assert mix_sources(odd_docs.limit(0)).collect() == []


def test_apportion_equals_highest_quotients(spark):
    weights = [53.0, 24.0, 23.0, 5.5, 0.4, 0.0]
    for seats in (0, 1, 7, 10, 100):
        best = sorted(((w / (2 * k + 1), -i) for i, w in enumerate(weights) for k in range(200)), reverse=True)[:seats]
        rows = spark.createDataFrame([(f"p{i}", w, float(seats), 1000) for i, w in enumerate(weights)], "p string, w double, seats double, cap long")
        got = {r.p: r.quota for r in apportion(rows, [], "p", "w", "seats", "cap").collect()}
        assert [got[f"p{i}"] for i in range(len(weights))] == [sum(-j == i for _, j in best) for i in range(len(weights))], seats


def test_texts_of_one_id_spread_over_shards(spark):
    rows = spark.range(800).selectExpr("CAST(NULL AS LONG) AS doc_id", "xxhash64(id) AS mark", "8L AS n_shards")
    sizes = [r["count"] for r in rows.groupBy(shard_of(11)).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 160
