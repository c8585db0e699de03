"""Choice normalisation (K3, A1, W13): one interaction per printed question.

Everything happens inside the document row, so normalising a corpus is a
narrow map over the page table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafgrade import schemas as SC
from leafgrade.functions import geometry as G
from leafgrade.functions.arrays import chain, first_match, let, settle, sort_by

TARGET = SC.CHOICE_TARGET.simpleString()


def same_row(a: Column, b: Column) -> Column:
    """Centres differ by at most 0.75 of the taller target."""
    limit = F.greatest(a["targetBbox"]["height"], b["targetBbox"]["height"]) * 0.75
    return F.abs(G.center_y(a["targetBbox"]) - G.center_y(b["targetBbox"])) <= limit


def merge_cluster(cluster: Column) -> Column:
    """A1: first target's identity, union boxes, lowest score, first-seen distinct span ids."""
    first = F.get(cluster, F.lit(0))
    near = F.array_distinct(F.flatten(F.transform(cluster, lambda t: F.coalesce(
        t["nearbyTextSpanIds"], F.array().cast("array<string>")))))
    return F.struct(
        first["id"].alias("id"), first["kind"].alias("kind"),
        G.bbox_union_array(F.transform(cluster, lambda t: t["targetBbox"])).alias("targetBbox"),
        G.bbox_union_array(F.transform(cluster, lambda t: t["interactionBbox"])).alias("interactionBbox"),
        first["optionGroupId"].alias("optionGroupId"), first["detectionMethod"].alias("detectionMethod"),
        F.array_min(F.transform(cluster, lambda t: t["candidateScore"])).alias("candidateScore"),
        near.alias("nearbyTextSpanIds"),
    ).cast(SC.CHOICE_TARGET)


def _clusters(targets: Column) -> Column:
    """Runs of same-row targets per option group; ungrouped targets stay alone."""
    groups = F.array_distinct(F.filter(F.transform(targets, lambda t: t["optionGroupId"]), lambda g: g.isNotNull()))

    def of_group(g: Column) -> Column:
        mine = F.filter(targets, lambda t: F.coalesce(t["optionGroupId"] == g, F.lit(False)))
        ordered = sort_by(mine, lambda t: t["targetBbox"]["y"], lambda t: t["targetBbox"]["x"])
        return chain(ordered, same_row, TARGET)

    alone = F.transform(F.filter(targets, lambda t: t["optionGroupId"].isNull()), lambda t: F.array(t))
    return F.concat(alone, F.flatten(F.transform(groups, of_group)))


def _promote(exercise: Column, targets: Column, groups: Column) -> Column:
    """Grid for a choice-grid exercise whose targets (two or more) share one known group, else null."""
    mine = F.filter(F.transform(exercise["interactionIds"], lambda i: first_match(targets, lambda t: t["id"] == i)),
                    lambda t: t.isNotNull())

    def row(t: Column, group: Column) -> Column:
        width = t["targetBbox"]["width"] / F.size(group["options"])
        cells = F.transform(group["options"], lambda o, i: F.struct(
            F.concat(t["id"], F.lit("-cell-"), o["id"]).alias("id"), o["id"].alias("optionId"),
            G.box(t["targetBbox"]["x"] + i * width, t["targetBbox"]["y"], width, t["targetBbox"]["height"]).alias("cellBbox"),
            t["interactionBbox"].alias("interactionBbox")))
        return F.struct(
            F.concat(t["id"], F.lit("-row")).alias("id"), t["interactionBbox"].alias("rowBbox"),
            F.lit(None).cast(SC.BBOX).alias("promptBbox"), t["nearbyTextSpanIds"].alias("nearbyTextSpanIds"),
            cells.alias("cells"))

    def decide(found: Column, group_ids: Column, group: Column) -> Column:
        grid = F.struct(
            F.concat(exercise["id"], F.lit("-grid")).alias("id"), F.lit("choice-grid").alias("kind"),
            G.bbox_union_array(F.transform(found, lambda t: t["interactionBbox"])).alias("gridBbox"),
            group["id"].alias("optionGroupId"), F.lit("vision-structured-v1").alias("detectionMethod"),
            F.array_min(F.transform(found, lambda t: t["candidateScore"])).alias("candidateScore"),
            F.transform(found, lambda t: row(t, group)).alias("rows")).cast(SC.CHOICE_GRID)
        ok = (exercise["kind"] == "choice-grid") & (F.size(found) >= 2) & (F.size(group_ids) == 1) & group.isNotNull()
        return F.struct(
            F.when(ok, grid).alias("grid"),
            F.when(ok, F.transform(found, lambda t: t["id"])).otherwise(F.array().cast("array<string>")).alias("used"))

    def with_group(found: Column) -> Column:
        ids = F.array_distinct(F.transform(found, lambda t: t["optionGroupId"]))
        return let(lambda g: let(lambda group: decide(found, g, group), first_match(groups, lambda x: x["id"] == F.get(g, F.lit(0)))), ids)

    return let(with_group, mine)


def normalize_choices(docs: DataFrame) -> DataFrame:
    """K3: merge rings of one row, remap exercise members, promote grids, recompute counts. Idempotent."""
    d = docs.withColumn("_runs", _clusters(F.col("choiceTargets")))
    pairs = F.flatten(F.transform("_runs", lambda run: F.transform(run, lambda t: F.struct(
        t["id"].alias("old"), F.get(run, F.lit(0))["id"].alias("new")))))
    merged = sort_by(F.transform("_runs", merge_cluster), lambda t: t["interactionBbox"]["y"],
                     lambda t: t["interactionBbox"]["x"], lambda t: t["id"])
    d = d.withColumn("_merged", merged)
    # small lists that lambdas look into are bound once per row
    remapped = let(lambda known: F.transform("semanticExercises", lambda e: e.withField("interactionIds", F.array_distinct(F.transform(
        e["interactionIds"], lambda i: F.coalesce(first_match(known, lambda p: p["old"] == i)["new"], i))))), pairs)
    d = d.withColumn("semanticExercises", remapped)
    d = d.withColumn("_promo", let(lambda targets, groups: F.transform(
        "semanticExercises", lambda e: _promote(e, targets, groups)), F.col("_merged"), F.col("choiceGroups")))
    exercises = F.zip_with("semanticExercises", "_promo", lambda e, p: F.when(
        p["grid"].isNotNull(), e.withField("interactionIds", F.array(p["grid"]["id"]))).otherwise(e))
    d = d.withColumn("_grids", F.filter(F.transform("_promo", lambda p: p["grid"]), lambda g: g.isNotNull())).withColumn(
        "_kept", let(lambda used: F.filter("_merged", lambda t: ~F.array_contains(used, t["id"])),
                     F.flatten(F.transform("_promo", lambda p: p["used"]))))
    kept = F.col("_kept")
    promoted = F.size("_grids")
    rows = F.aggregate("_grids", F.lit(0), lambda a, g: a + F.size(g["rows"]))
    grid_detection = F.struct(
        F.lit("vision-structured-v1").alias("detectionMethod"), rows.alias("rawCandidateCount"),
        promoted.alias("acceptedCount"), promoted.alias("groupCount"), F.lit(0).alias("durationMs")).cast(SC.DETECTION)
    return settle(d.withColumns({
        "semanticExercises": exercises,
        "choiceTargets": kept,
        "choiceDetection": F.when(F.col("choiceDetection").isNotNull(), F.col("choiceDetection").withField(
            "acceptedCount", F.size(kept))),
        "choiceGrids": F.concat(F.coalesce("choiceGrids", F.array().cast(T.ArrayType(SC.CHOICE_GRID))), F.col("_grids")),
        "choiceGridDetection": F.when(promoted > 0, grid_detection).otherwise(F.col("choiceGridDetection")),
    }).drop("_runs", "_merged", "_promo", "_kept", "_grids"))
