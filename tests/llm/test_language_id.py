"""Language identification: held-out accuracy, counts and filters against plain ones, odd input."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from leafgrade.llm.language_id import Filters, gram_counts, grams, identify_language

SYLLABLES = {"aa": "ka to mi ren sul".split(), "bb": "zho ba wen ling ta".split(), "cc": "éra nos tel dio mi".split()}


def made(n, seed):
    rng = random.Random(seed)
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        yield i, " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 60))), lang


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 0, "x", "y") for i, t, lang in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, gram string, rate string")


def test_held_out_accuracy_and_unread_columns(spark):
    rows = list(made(400, 1))
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    got = {r.doc_id: r for r in identify_language(frame(spark, rows)).collect()}
    assert all(got[i].held_out == held(i) and 0 <= got[i].score <= 1 for i, _, _ in rows)
    assert np.mean([got[i].lang_pred == lang for i, _, lang in rows if held(i)]) >= 0.99
    other = [(i, t, "zz" if held(i) else lang) for i, t, lang in rows]
    assert {i: tuple(r) for i, r in got.items()} == {r.doc_id: tuple(r) for r in identify_language(frame(spark, other).repartition(7)).collect()}


def test_given_documents(spark):
    sf = "/root/testdata/sf0.01"
    lang = dict(zip(*(c.to_pylist() for c in pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "lang"]).columns)))
    rows = [r for r in identify_language(spark.read.parquet(f"{sf}/documents.parquet")).collect() if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in rows]) >= 0.99


def test_odd_rows(spark, odd_docs):
    got = {(r.doc_id, r.lang_pred) for r in identify_language(odd_docs).collect()}
    assert (1, "und") in got and (2, "und") in got and (3, "und") in got and (4, "en") in got and (None, "en") in got and (None, "und") in got
    assert identify_language(odd_docs.limit(0)).collect() == []
    rows = identify_language(frame(spark, [(1, "some words", None), (2, "123 !", "en"), (None, "words", "en"), (5, "x", "en"), (6, "x", "de")])).collect()
    assert {r.doc_id: r.lang_pred for r in rows}[2] == "und" and len(rows) == 5
    none = identify_language(frame(spark, [(1, "some words", None), (None, "words", "en")])).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}


def plain(text):
    out, word = Counter(), "\0"
    for ch in (text or "") + " ":
        if ch.isalpha():
            word += ch.lower() if len(ch.lower()) == 1 else ch
        elif len(word) > 1:
            word += "\0"
            out.update(word[i : i + n] for n in (3, 4) for i in range(len(word) - n + 1))
            word = "\0"
    return out


def test_grams_and_counts_equal_plain_ones(spark):
    texts = ["Ab cDe", None, "", "12", "x", "ÄÖ ü-ß İi", "a1b", "the the the", "\U00010400\U00010428 ok"]
    gram, owner, has = grams(pa.array(texts))
    for k, t in enumerate(texts):
        assert sorted(Counter(gram[owner == k].tolist()).values()) == sorted(plain(t).values())
        assert has[k] == any(c.isalpha() for c in t or "")
    rows = list(made(60, 3))
    counts = gram_counts(frame(spark, rows).repartition(4)).collect()
    for lang in SYLLABLES:
        want = sum((plain(t) for _, t, x in rows if x == lang), Counter())
        assert sorted(r.n for r in counts if r.lang == lang) == sorted(want.values())


def test_filters_lose_no_language_and_correct_false_positives():
    rng = np.random.default_rng(1)
    gram, lang = rng.integers(0, 2**63, 3000).astype(np.uint64), rng.integers(0, 11, 3000)
    f = Filters([f"l{i}" for i in range(11)], "l0", gram, lang)
    for i in range(11):
        assert f.shares(gram[lang == i], np.zeros((lang == i).sum(), np.int64), 1)[0, i] > 0.999
    foreign = rng.integers(0, 2**63, 200_000).astype(np.uint64)
    assert np.abs(f.shares(foreign, np.zeros(len(foreign), np.int64), 1)).max() < 0.01
