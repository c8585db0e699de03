"""Quality reports (Q1, Q2, C1, C18 audits)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafgrade.functions import textops as X
from leafgrade.functions.arrays import let
from leafgrade.operators.cluster import PAGE


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, parent: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Child rows whose key has no parent."""
    return child.join(parent.select(*keys).distinct(), list(keys), "left_anti")


def integrity_report(docs: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """Q1: broken references inside page documents: keys, rule, exercise_id, value.

    All four rules look inside one document, so the report needs no join and
    no shuffle. An interaction counts once per later exercise that repeats it.
    """
    ids = F.concat(*[F.transform(c, lambda x: x["id"]) for c in (
        "exerciseBlanks", "choiceTargets", "choiceGrids", "sentenceOrderings", "matchingInteractions",
        "freeTextInteractions")])
    spans = F.transform("textSpans", lambda s: s["id"])
    exercises = F.col("semanticExercises")
    struct = "struct<rule:string,exercise_id:string,value:string>"

    def issue(rule: str, e: Column, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(
            F.lit(rule).alias("rule"), e["id"].alias("exercise_id"), v.alias("value")).cast(struct))

    def check(e: Column, i: Column, known: Column, printed: Column) -> Column:
        before = F.slice(exercises, F.lit(1), i)
        seen = F.transform(before, lambda b: b["id"])
        used = F.flatten(F.transform(before, lambda b: b["interactionIds"]))
        repeated = F.filter(F.array(e["id"]), lambda v: F.array_contains(seen, v))
        return F.concat(
            issue("duplicate_exercise", e, repeated),
            issue("unknown_interaction", e, F.array_except(e["interactionIds"], known)),
            issue("shared_interaction", e, F.array_intersect(e["interactionIds"], used)),
            issue("unknown_span", e, F.array_except(e["contextSpanIds"], printed)))

    found = let(lambda known, printed: F.flatten(F.transform(exercises, lambda e, i: check(e, i, known, printed))), ids, spans)
    return docs.select(*keys, F.explode(found).alias("v")).select(*keys, "v.*")


def range_report(df: DataFrame, rules: dict[str, Column], keys: Sequence[str]) -> DataFrame:
    """Q2: rows per broken rule. A null value breaks no rule. One pass: rules become an array."""
    broken = F.array_compact(F.array(*[F.when(F.coalesce(~ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.select(*keys, F.explode(broken).alias("rule"))


def bbox_in_page(b: Column) -> Column:
    """Q2: every part of a box lies in 0..1."""
    return (b["x"].between(0, 1) & b["y"].between(0, 1) & b["width"].between(0, 1) & b["height"].between(0, 1))


def document_range_report(docs: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """Q2 for page documents: page size, span boxes and confidences, exercise membership."""
    spans_ok = F.forall("textSpans", lambda s: F.coalesce(
        bbox_in_page(s["bbox"]) & s["confidence"].between(0, 1), F.lit(True)))
    rules = {
        "page_number": F.col("pageNumber") >= 1,
        "width": F.col("width") > 0,
        "height": F.col("height") > 0,
        "span_range": spans_ok,
        "exercise_confidence": F.forall("semanticExercises", lambda e: F.coalesce(e["confidence"].between(0, 1), F.lit(True))),
        "exercise_order": F.forall("semanticExercises", lambda e: F.coalesce(e["sourceOrder"] >= 1, F.lit(True))),
        "exercise_members": F.forall("semanticExercises", lambda e: F.size(e["interactionIds"]) >= 1),
    }
    return range_report(docs, rules, keys)


def mojibake_report(df: DataFrame, text: str, by: Sequence[str]) -> DataFrame:
    """Repaired and total counts of a text column."""
    fixed = X.repair_mojibake(F.col(text))
    return df.groupBy(*by).agg(F.count("*").alias("texts"), F.count_if(fixed != F.col(text)).alias("repaired"))


def model_output_audit(log: DataFrame) -> DataFrame:
    """Responses per action and category (action, raw_text)."""
    checked = log.withColumn("_v", X.validate_model_output(F.col("action"), F.col("raw_text")))
    return checked.groupBy("action", F.col("_v.category").alias("category")).agg(F.count("*").alias("responses"))


