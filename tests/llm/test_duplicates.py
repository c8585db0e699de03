"""Near-duplicates and substring dedup against brute force."""

import hashlib
import random
import re
from itertools import combinations

import pytest

from leafgrade.llm import near_dup
from leafgrade.llm.substring_dedup import drop_repeated_passages

SPLIT = r"[^\x20\x09-\x0D]+"


def shingles(text, k):
    w = re.findall(SPLIT, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def plain_components(docs, k, percent=80):
    sets = {i: shingles(t, k) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(sorted(sets), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def chain(n, step, rng):
    """Texts that each differ a little from the one before, so that only neighbours are alike."""
    words = [f"c{rng.random()}" for _ in range(60)]
    for i in range(n):
        yield " ".join(words)
        for j in range(step):
            words[(i * step + j) % 60] = f"n{i}x{j}"


@pytest.mark.parametrize("k,bands,rows,tile", [(4, 32, 4, 200_000), (5, 32, 4, 200_000), (4, 40, 1, 300)])
def test_components_equal_brute_force(docs_frame, k, bands, rows, tile):
    rng = random.Random(k * bands)
    texts = [" ".join(f"v{rng.randint(0, 400)}" for _ in range(rng.randint(1, 60))) for _ in range(30)]
    texts += [t.upper().replace("V", "v") for t in texts[:8]] + list(chain(14, 1, rng)) + [texts[9]] * 12 + ["a b", "A  b", "a b c", "x"] + ["", None]
    texts += [" ".join([*texts[10].split(), f"tail{i}"]) for i in range(6)]
    rng.shuffle(texts)
    docs = list(enumerate(texts))
    want = plain_components(docs, k)
    got = {r.doc_id: r for r in near_dup.near_duplicates(docs_frame(docs), shingle=k, bands=bands, rows=rows, tile_shingles=tile).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.component_id == i) for i, r in got.items())


def test_odd_rows(odd_docs):
    rows = near_dup.near_duplicates(odd_docs).collect()
    assert len(rows) == 10 and all(r.kept for r in rows)
    assert {r.component_id for r in rows} == {None, 1, 2, 3, 4, 5, 6, 7}
    assert near_dup.near_duplicates(odd_docs.limit(0)).collect() == []


def test_star_contraction_equals_union_find(spark):
    rng = random.Random(8)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 240)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r.least for r in near_dup.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}


def plain_removal(docs, window):
    words = [(i, re.findall(SPLIT, t or "")) for i, t in docs]
    owners = {}
    for i, w in words:
        for a in range(len(w) - window + 1):
            owners.setdefault(tuple(w[a : a + window]), set()).add(i)
    for i, w in words:
        gone = set()
        for a in range(len(w) - window + 1):
            others = owners[tuple(w[a : a + window])]
            if any(o is not None and (i is None or o < i) for o in others):
                gone |= set(range(a, a + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        yield i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept


@pytest.mark.parametrize("window,bits", [(13, 26), (13, 3), (3, 10), (1, 10), (2, 5)])
def test_removal_equals_brute_force(docs_frame, window, bits):
    rng = random.Random(window + bits)
    pool = [[f"p{i}w{j}" for j in range(rng.randint(5, 30))] for i in range(6)]
    docs = []
    for i in range(60):
        w = [f"u{rng.randint(0, 300)}" for _ in range(rng.randint(0, 25))]
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(w))
            w[at:at] = pool[rng.randint(0, 5)]
        docs.append((i * 3 % 61, " ".join(w)))
    docs += [(70, "und " * 40), (71, "und " * 30), (72, docs[5][1]), (72, docs[6][1]), (72, docs[6][1]), (None, docs[7][1]), (None, docs[8][1]), (73, None), (74, "")]
    got = drop_repeated_passages(docs_frame(docs), window=window, most_bits=bits).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain_removal(docs, window), key=str)


def test_removal_of_odd_rows(odd_docs):
    rows = drop_repeated_passages(odd_docs, with_text=False).collect()
    assert len(rows) == 10 and sum(r.n_removed for r in rows) == 0
    assert {r.n_words for r in rows if r.doc_id == 7} == {1}
    assert drop_repeated_passages(odd_docs.limit(0)).collect() == []


def test_tiles_of_short_texts_are_bounded(spark):
    here = spark.range(3500).selectExpr("7L AS bucket", "id AS doc_id", "10L AS n_shingles", "id AS part")
    tiles = near_dup.dealt_tiles(here, 200_000)
    sizes = [r["count"] for r in tiles.groupBy("bucket", "a", "b").count().collect()]
    assert len(sizes) == 6 and max(sizes) < 2200
    assert tiles.groupBy("doc_id").count().where("count <> 3").isEmpty() and tiles.select("doc_id").distinct().count() == 3500


def test_passages_of_many_texts_with_one_id(spark, docs_frame):
    from leafgrade.llm.substring_dedup import drop_repeated_passages

    shared = " ".join(f"s{i}" for i in range(20))
    rows = [(1, shared)] + [(None, f"{shared} own{i} " + " ".join(f"t{i}x{j}" for j in range(15))) for i in range(400)] + [(7, f"pre {shared}"), (7, "other text"), (None, None)]
    got = drop_repeated_passages(docs_frame(rows)).collect()
    assert len(got) == len(rows) and sum(r.n_removed == 20 for r in got) == 401
    assert all(r.kept_text.startswith("own") and r.n_removed == 20 for r in got if r.doc_id is None and r.n_words)
    assert {(r.n_words, r.n_removed) for r in got if r.doc_id == 7} == {(21, 20), (2, 0)}
