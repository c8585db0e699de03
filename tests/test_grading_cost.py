"""The common grader composes only the texts that a row's own grader reads."""

import re

from pyspark.sql import functions as F

from leafgrade.operators import grading as G


def test_only_read_texts_are_composed(spark):
    item = "array<struct<id:string,label:string,text:string>>"
    rows = spark.createDataFrame([("choice",), ("matching",), ("fill-in-line",)], "kind string").select(
        "kind", F.lit("RESOLVED").alias("resolution"), F.lit("x").alias("learner"), F.lit(None).cast("array<string>").alias("row_answers"), F.lit(1).alias("item_count"),
        F.lit(None).cast("array<struct<id:string,label:string>>").alias("options"), F.lit(None).cast(item).alias("left_items"), F.lit(None).cast(item).alias("right_items"),
        F.concat("kind", F.lit("̈")).alias("expected"), F.array().cast("array<string>").alias("alternatives"), F.lit(False).alias("case_sensitive"),
        F.lit(None).cast("array<struct<leftLabel:string,rightLabel:string>>").alias("pairs"), F.lit("Text").alias("payload_type"))
    plan = G.grade_all(rows).select("result.verdict")._jdf.queryExecution().optimizedPlan().toString()
    sent = [line for line in plan.splitlines() if "ArrowEvalPython" in line]
    calls = [c for line in sent for c in re.split(r"(?=_compose)", line)[1:]]
    assert calls and all("matching" in c or "fill-in-line" in c for c in calls)
    got = G.grade_all(rows).select("result.verdict").collect()
    assert got[2].verdict == "INCORRECT"
