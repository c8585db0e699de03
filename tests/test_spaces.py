"""Spaces of texts: trimming and joining of span texts against the rules written out in Python."""

import random
import re
from itertools import accumulate

from pyspark.sql import functions as F

from leafgrade.functions import textops as X
from leafgrade.functions.arrays import running_sums
from leafgrade.operators import lessons as L
from leafgrade.operators import ordering

JS = X.members(X.JS_SPACE)


def tidy(text):
    """C4 with every space class spelled out."""
    space = "[" + re.escape(JS) + "]"
    for pattern, to in ((space + "+", " "), (space + "+([,;:!?])", r"\1"), (space + r"+\.(?!\.)", "."), (rf"([!?])(?:{space}*\1)+", r"\1")):
        text = re.sub(pattern, to, text)
    return text.strip(JS) or None


def test_trimming_takes_the_class_only(spark):
    """A line separator outside the class ends no text: what stands before it stays."""
    rows = ["a \u0085", "﻿ a\u0085  ", " \t\n", "", " ä b　", None]
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    got = [tuple(r) for r in df.select(X.js_trim(F.col("t")), F.expr(L._trim("t")), X.java_trim(F.col("t"))).collect()]
    assert [g[:2] for g in got] == [(None if t is None else t.strip(JS),) * 2 for t in rows]
    assert got[0][2] == "a \u0085" and got[2][2] == ""


def test_tidy_texts_with_every_space_and_mark(spark):
    rng = random.Random(3)
    rows = ["".join(rng.choice("aÄ一!?.,;: " + JS) for _ in range(rng.randrange(30))) for _ in range(800)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    got = df.select(X.tidy_span_text(F.col("t")), F.expr(L._tidy("t")), "i").orderBy("i").collect()
    assert [tuple(r)[:2] for r in got] == [(tidy(t),) * 2 for t in rows]


def test_running_sums_of_long_and_short_lists(spark):
    lists = [[], [3.0], [float(i % 7) for i in range(8)], [float(i % 11) for i in range(100)]]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(lists)], "i int, a array<double>")
    got = [r.s for r in df.select("i", running_sums(F.col("a")).alias("s")).orderBy("i").collect()]
    assert got == [list(accumulate(a)) for a in lists]


def test_borders_and_items_of_a_long_line(spark):
    """A line of 300 fragments: every item counted and boxed, borders in proportion to the lengths."""
    words = ["x" * (1 + i % 5) for i in range(300)]
    box = {"x": 0.0, "y": 0.1, "width": 1.0, "height": 0.01}
    rows = [("b", 1, 1000, 2000, i, f"s{i}", text, {**box, "y": 0.1 + i * 0.012}) for i, text in enumerate((" • ".join(words), "a • bb • cccccc"))]
    df = spark.createDataFrame(rows, "book_id string, page_number int, page_width int, page_height int, idx int, id string, text string, "
                                     "bbox struct<x:double,y:double,width:double,height:double>")
    out = {r.prompt_index: r for r in ordering.ordering_prompts(df).collect()}
    assert {n: r.item_count for n, r in out.items()} == {1: 300, 2: 3}
    assert [i.text for i in out[1]["items"]] == words
    ends = list(accumulate(map(len, words)))
    assert all(abs(i.bbox.x + i.bbox.width - e / ends[-1]) < 1e-9 for i, e in zip(out[1]["items"], ends))
