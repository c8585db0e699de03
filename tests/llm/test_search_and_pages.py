"""Exact top-k, url rules, WARC archives and benchmark leaks on small fixtures."""

import base64
import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from leafgrade.llm import decontamination, warc
from leafgrade.llm.common import shared_path
from leafgrade.llm.decontamination import contaminated, drop_contaminated
from leafgrade.llm.queries import URL_RULES
from leafgrade.llm.topk import exact_top_k
from leafgrade.llm.url_filter import judge_urls, rule_table


def plain_top(rows, k=10):
    v = [(i, [math.floor(1024 * x) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for q, a in v:
        if q % 100 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in v if i != q and len(b) == len(a))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"tile_rows": 2, "shard_rows": 3, "group_rows": 20}])
def test_top_k_equals_brute_force(spark, sizes):
    rng = random.Random(4)
    rows = [(i * 10, [rng.randint(-3, 3) / 4 for _ in range(4)]) for i in range(90)]
    rows += [(5, None), (None, [1.0] * 4), (7, [1.0, None, 0.0, 0.0]), (8, [float("nan")] * 4), (9, [1.0, 2.0]), (1100, [float("inf")] * 4), (11, rows[3][1]), (11, rows[3][1]), (13, [1e6] * 4), (1200, [])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, n string, g int")
    got = sorted(map(tuple, exact_top_k(df, F.col("vec_id") % 100 == 0, **sizes).collect()))
    assert got == plain_top([(i, e and [None if x is None else x for x in e]) for i, e in rows])
    assert exact_top_k(df.limit(0), F.col("vec_id") % 100 == 0).collect() == []


def test_url_rules(spark):
    urls = ["http://a.b.example.net/en/1", "https://EXAMPLE.net/fr", "http://example.com/de/x?q#f", "http://badexample.com/de/", "ftp://x.org/fr/", "http://x.org/en", "net/", None, "",
            "http://net", "http://net/", "http://m.example.com/den", "a://b://c.net/", "http://x.net?y/", "http://" + "a." * 3000 + "net/" + "p/" * 3000, "http://user@example.net/en/\n"]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)] + [(1, urls[1], "x", "y"), (None, urls[0], "x", "y")], "page_id long, url string, rule string, h string")

    def plain(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = rest[:cut].lower(), rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
        fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fits)[1:] if fits else (None, "allow")))

    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, rule_table(spark, URL_RULES)).collect()), key=str)
    assert got == sorted(((r.page_id, *plain(r.url)) for r in pages.collect()), key=str)
    rules = rule_table(spark, [*URL_RULES, ("block", None, "/"), ("allow", "net", "/en"), ("block", "net", "/en")])
    assert [r.verdict for r in judge_urls(pages.where("page_id = 10"), rules).collect()] == ["block"]
    assert judge_urls(pages.limit(0), rules).collect() == [] and judge_urls(pages, rules.limit(0)).where("verdict <> 'allow'").count() == 0


FAKE = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:leafgrade:page:99>\r\nContent-Length: {}\r\n\r\n"


def test_warc_round_trip(spark):
    html = ["<p>one</p>", "", None, "same", "same", "same", "WARC/1.0\r\n", "x" + FAKE.format(3) + "abc\r\n\r\ny", FAKE.format(10**9) + "z", FAKE.format(0) + "\r\n\r\n" * 3, "\u00e4\u00f6 \U0001f600\r\n\r\n",
            "w " * 200_000, "end WARC/1.0"]
    rows = [(i, "http://h/WARC/1.0\r\nX: y" if i % 2 else None, h, "x") for i, h in enumerate(html)] + [(3, "u", "same", "x"), (5, "u", "same", "x"), (None, "u", "same", "x"), (-4, "u", "lone", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, file string").repartition(2)
    want = []
    for i, _, h, _ in rows:
        body = (h or "").encode()
        head = max((j for j, _, g, _ in rows if (g or "") == (h or "") and j is not None), default=None)
        revisit = head is not None and (i is None or i < head)
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", head if revisit else None, True))
    assert sorted(map(tuple, warc.round_trip(pages, file_records=5).collect()), key=str) == sorted(want, key=str)
    kinds = {r.page_id: r.record_type for r in warc.round_trip(pages, least_bytes=5).collect()}
    assert kinds[3] == "response" and kinds[0] == "response"
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_chain_skips_magic_in_payloads(spark):
    pages = spark.createDataFrame([(i, "u", "a" + (FAKE.format(1) + "b\r\n\r\n") * i) for i in range(5)], "page_id long, url string, html string").coalesce(1)
    path = shared_path(spark, "warc-test")
    warc.write_archives(pages, path)
    found = warc.candidate_records(spark, path)
    assert found.count() == 15 and warc.chained(found).count() == 5


def test_leaks_with_substitutions(spark, docs_frame, odd_docs):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    items = {i: [word() for _ in range(n)] for i, n in enumerate((12, 20, 40, 60, 11))}
    bench = spark.createDataFrame([(i, " ".join(w), "x") for i, w in items.items()] + [(1, " ".join(items[1]), "x"), (7, None, "x"), (None, "", "x")], "item_id long, text string, tokens string")
    noise = lambda n: [word() for _ in range(n)]
    changed = lambda w, step: [x if k % step else word() for k, x in enumerate(w, 1)]
    docs = {100: noise(50) + items[0] + noise(9), 101: [w.upper() + "," for w in items[1]], 102: noise(3) + changed(items[2], 9) + noise(3), 103: noise(5) + items[3][20:40],
            104: noise(300), 105: items[4] + noise(5), 106: changed(items[3], 2), 107: items[2][:9] + noise(20), 108: items[1] + items[2]}
    frame = docs_frame([(i, " ".join(w)) for i, w in docs.items()] + [(100, " ".join(docs[100]))])
    got = {(r.doc_id, r.item_id) for r in contaminated(frame, bench).collect()}
    assert got == {(100, 0), (101, 1), (102, 2), (103, 3), (108, 1), (108, 2)}
    assert {(r.doc_id, r.item_id) for r in contaminated(frame, bench, seeds_at_once=40).collect()} == got
    assert {r.doc_id for r in drop_contaminated(frame, bench).collect()} == {104, 105, 106, 107}
    assert contaminated(odd_docs, bench).collect() == [] and contaminated(frame, bench.limit(0)).collect() == [] and contaminated(frame.limit(0), bench).collect() == []
    assert drop_contaminated(odd_docs, bench).count() == 10


def test_short_items_are_found_with_a_quarter_replaced(spark, docs_frame):
    rng = random.Random(12)
    items, docs = [], []
    for n in range(12, 40):
        words = [f"t{n}x{i}" for i in range(n)]
        items.append((n, " ".join(words)))
        for k in range(4):
            at = [0, n - 1, *rng.sample(range(1, n - 1), n // 4)][: n // 4] if k < 2 else range(3, n, 4) if k == 2 else range(n // 4)
            docs.append((n * 10 + k, " ".join(["pre", *(f"other{i}" if i in list(at)[: n // 4] else w for i, w in enumerate(words)), "post"])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contaminated(docs_frame(docs), bench).collect()}
    assert got == {(i, i // 10) for i, _ in docs}


def test_leaks_in_long_texts_are_laid_piece_by_piece(spark, docs_frame):
    items = {i: [f"i{i}w{k}" for k in range(n)] for i, n in enumerate((12, 39, 40, 300))}
    noise = lambda n, name: [f"{name}{k}" for k in range(n)]
    docs = [(1, items[2] * 750)]  # a row of all tokens at every hit took 15 GB
    docs += [(1000 + 10 * at + i, noise(at, "a") + w + noise(3, "b")) for at in (0, 1, 217, 244, 245, 255, 256, 257, 500, 511, 512) for i, w in items.items()]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    compiled = {"spark.sql.codegen.wholeStage": ("true", "false"), "spark.sql.codegen.factoryMode": ("FALLBACK", "NO_CODEGEN")}  # as outside tests
    for name, (on, _) in compiled.items():
        spark.conf.set(name, on)
    try:
        got = {(r.doc_id, r.item_id, r.n_tokens, r.matched, r.score) for r in contaminated(docs_frame([(i, " ".join(w)) for i, w in docs]), bench).collect()}
    finally:
        for name, (_, off) in compiled.items():
            spark.conf.set(name, off)
    held = lambda words, i: "".join(f" {w}" for w in items[i]) in "".join(f" {w}" for w in words)
    assert got == {(d, i, len(w), len(w), len(w)) for d, words in docs for i, w in items.items() if held(words, i)}


def test_texts_stay_in_their_tasks_when_leaks_go(spark, docs_frame, monkeypatch):
    item = " ".join(f"leak{i}" for i in range(15))
    frame = docs_frame([(i, item if i % 10 == 0 else f"clean {i}") for i in range(50)] + [(None, item), (None, "clean"), (7, item), (8, None)])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    left = drop_contaminated(frame, bench)
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    rows = lambda df: sorted((str(r.doc_id), str(r.text)) for r in df.collect())
    assert rows(left) == sorted([(str(i), f"clean {i}") for i in range(50) if i % 10] + [("None", "clean"), ("8", "None")])
    monkeypatch.setattr(decontamination, "MOST_BROADCAST_LEAKS", 0)  # as with more leaks
    assert rows(drop_contaminated(frame, bench)) == rows(left)
