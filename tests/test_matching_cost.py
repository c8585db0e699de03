"""Matchings of long pages: rows look at the dots and spans near them, not at all of the page."""

import random
import time

from pyspark.sql import functions as F

from leafgrade.functions import geometry as G
from leafgrade.operators import matching as M


def test_a_long_page_takes_time_in_proportion(spark):
    """Four times the rows of a page took about 16 times as long when every row went through all dots and spans."""
    def seconds(rows):
        lines = spark.range(rows).select(F.lit("b").alias("book_id"), F.lit(1).alias("page_number"), F.col("id").cast("int").alias("i"))
        y = F.col("i") / 8.0
        dots = lines.select("book_id", "page_number", F.explode(F.array(*[F.struct(F.concat(F.lit(p), F.col("i").cast("string")).alias("id"), F.lit(x).alias("x"))
                                                                          for p, x in (("l", 0.375), ("r", 0.5))])).alias("s"), y.alias("y"))
        dots = dots.select("book_id", "page_number", "s.*", "y").withColumn("bbox", G.box(F.col("x"), F.col("y"), 1 / 512, 1 / 512))
        spans = lines.select("book_id", "page_number", F.explode(F.array(*[F.struct((F.col("i") * 2 + k).alias("idx"), F.concat(F.lit(t), F.col("i").cast("string")).alias("text"),
                                                                                    G.box(x, y, 0.125, 1 / 512).alias("bbox")) for k, t, x in ((0, "1. links ", 0.125), (1, "B rechts ", 0.625))])).alias("s"))
        spans = spans.select("book_id", "page_number", "s.*", F.lit(0.9).alias("confidence"), F.col("s.idx").cast("string").alias("id"))
        t0 = time.perf_counter()
        out = M.matching_items(dots, spans).collect()
        took = time.perf_counter() - t0
        assert [[i.text for i in o.left_items] for o in out] == [[f"links {i}" for i in range(rows)]] and out[0].score == 1.0
        assert [i.span_ids for i in out[0].right_items] == [[str(2 * i + 1)] for i in range(rows)]
        return took

    seconds(10)
    fixed = min(seconds(10) for _ in range(2))
    assert seconds(6000) - fixed < 8 * max(seconds(1500) - fixed, 1)


def test_pairs_of_crowded_columns(spark):
    """Dots that compete for partners, against the rule written out in Python."""
    rng = random.Random(2)
    column = lambda p: sorted((rng.choice([j * 0.001, j * 0.0015, rng.random() * 0.03]), f"{p}{j}") for j in range(rng.randrange(12)))
    cases = [(i, column("l"), column("r")) for i in range(200)]

    def pairs(ls, rs):
        free, rows = list(range(len(rs))), []
        for y, name in ls:
            gap, at = min(((abs(y - rs[i][0]), i) for i in free if abs(y - rs[i][0]) <= M.PAIR_TOLERANCE), default=(None, None))
            rows.append((y, name, None) if at is None else ((y + rs[at][0]) / 2, name, rs[at][1]))
            free = [i for i in free if i != at]
        return sorted(rows + [(rs[i][0], None, rs[i][1]) for i in free], key=lambda r: r[0])

    df = spark.createDataFrame(cases, "i int, l array<struct<y:double,id:string>>, r array<struct<y:double,id:string>>")
    got = df.select("i", M.pair_rows(F.col("l"), F.col("r")).alias("p")).orderBy("i").collect()
    assert [[(p.y, p.left_id, p.right_id) for p in r.p] for r in got] == [pairs(ls, rs) for _, ls, rs in cases]
