"""Flattening page documents.

All functions read typed documents (``sources.readers``) with the key columns
``book_id, page_number``. One scan feeds every family: the families are built
as arrays of one common struct and exploded together, so no union re-reads the
documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafgrade import schemas as SC
from leafgrade.operators.cluster import PAGE, natural_key

INTERACTION = SC.struct(
    kind=SC.S, ordinal=SC.I, id=SC.S, bbox=SC.BBOX, score=SC.D, method=SC.S, nearby_ids=SC.STRINGS, n_items=SC.I,
    exercise_id=SC.S, group_id=SC.S, prompt_index=SC.I, anchor_bbox=SC.BBOX,
)


def explode_spans(docs: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """One row per text span with its stored index."""
    rows = docs.select(*keys, F.posexplode("textSpans").alias("idx", "s"))
    return rows.select(*keys, "idx", F.col("s.id").alias("id"), F.col("s.text").alias("text"),
                       F.col("s.confidence").alias("confidence"), F.col("s.confidenceScope").alias("confidence_scope"),
                       F.col("s.parentLineId").alias("parent_line_id"), F.col("s.bbox").alias("bbox"))


def _family(array: Column, kind: str, bbox: str, nearby, n_items, exercise="", group="", prompt="", anchor="") -> Column:
    none = F.lit(None)

    def one(x: Column, i: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), i.cast("int").alias("ordinal"), x["id"].alias("id"), x[bbox].alias("bbox"),
            x["candidateScore"].alias("score"), x["detectionMethod"].alias("method"), nearby(x).alias("nearby_ids"),
            n_items(x).cast("int").alias("n_items"), (x[exercise] if exercise else none).cast("string").alias("exercise_id"),
            (x[group] if group else none).cast("string").alias("group_id"),
            (x[prompt] if prompt else none).cast("int").alias("prompt_index"),
            (x[anchor] if anchor else x[bbox]).alias("anchor_bbox")).cast(INTERACTION)
    return F.transform(array, one)


def _interaction_array() -> Column:
    """The six families in resolution order."""
    near = lambda x: x["nearbyTextSpanIds"]
    one = lambda x: F.lit(1)
    grid_near = lambda g: F.array_distinct(F.flatten(F.transform(g["rows"], lambda r: F.coalesce(
        r["nearbyTextSpanIds"], F.array().cast("array<string>")))))
    blanks = F.filter("exerciseBlanks", lambda b: b["kind"] == "fill-in-line")
    parts = [
        _family(blanks, "fill-in-line", "interactionBbox", near, one, anchor="lineBbox"),
        _family(F.col("choiceTargets"), "choice", "interactionBbox", near, one, group="optionGroupId", anchor="targetBbox"),
        _family(F.col("choiceGrids"), "choice-grid", "gridBbox", grid_near, lambda g: F.size(g["rows"]), group="optionGroupId"),
        _family(F.col("sentenceOrderings"), "sentence-ordering", "bbox", near, lambda o: F.size(o["items"]),
                exercise="exerciseId", prompt="promptIndex"),
        _family(F.col("matchingInteractions"), "matching", "bbox", near, lambda m: F.size(m["leftItems"])),
        _family(F.col("freeTextInteractions"), "free-text", "bbox", near, lambda f: F.size(f["responseLines"])),
    ]
    none = F.array().cast(T.ArrayType(INTERACTION))
    return F.concat(*[F.coalesce(p, none) for p in parts])


def explode_interactions(docs: DataFrame, keys: Sequence[str] = PAGE, ordinal_mode: str = "stored") -> DataFrame:
    """P2 + U1: one row per interaction of the six families.

    ``ordinal_mode``: ``stored`` numbers by array index (what the resolver
    does), ``reading`` by geometry (what the reader does). Both are computed
    inside the document row, without a shuffle.
    """
    rows = _interaction_array()
    if ordinal_mode == "reading":
        ranked = F.array_sort(F.transform(rows, lambda r: F.struct(
            r["kind"].alias("k"),
            F.when(r["kind"] == "sentence-ordering", r["prompt_index"]).otherwise(F.lit(0)).alias("p"),
            r["anchor_bbox"]["y"].alias("y"),
            F.when(r["kind"] == "choice-grid", F.lit(0.0)).otherwise(r["anchor_bbox"]["x"]).alias("x"),
            natural_key(r["id"]).alias("n"), r.alias("r"))))

        def reindexed(kind: str) -> Column:
            mine = F.filter(ranked, lambda s: s["k"] == kind)
            return F.transform(mine, lambda s, i: s["r"].withField("ordinal", i.cast("int")))
        rows = F.concat(*[reindexed(k) for k in SC.KIND_ORDER])
    elif ordinal_mode != "stored":
        raise ValueError("ordinal_mode is 'stored' or 'reading'")
    return docs.select(*keys, F.explode(rows).alias("i")).select(*keys, "i.*").drop("anchor_bbox")


def explode_grid_rows(docs: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """Grid rows."""
    g = docs.select(*keys, F.explode("choiceGrids").alias("g"))
    return g.select(*keys, F.col("g.id").alias("grid_id"), F.col("g.optionGroupId").alias("group_id"),
                    F.col("g.detectionMethod").alias("method"), F.posexplode("g.rows").alias("row_index", "r")).select(
        *keys, "grid_id", "group_id", "method", "row_index", F.col("r.id").alias("id"), F.col("r.rowBbox").alias("bbox"),
        F.col("r.promptBbox").alias("prompt_bbox"), F.col("r.nearbyTextSpanIds").alias("nearby_ids"),
        F.col("r.cells").alias("cells"))


def explode_grid_cells(docs: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """Grid cells."""
    rows = explode_grid_rows(docs, keys).select(*keys, "grid_id", F.col("id").alias("row_id"),
                                                F.posexplode("cells").alias("cell_index", "c"))
    return rows.select(*keys, "grid_id", "row_id", "cell_index", F.col("c.id").alias("id"),
                       F.col("c.optionId").alias("option_id"), F.col("c.cellBbox").alias("bbox"))


def explode_ordering_items(docs: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """Sentence-ordering items."""
    o = docs.select(*keys, F.explode("sentenceOrderings").alias("o"))
    return o.select(*keys, F.col("o.id").alias("interaction_id"), F.posexplode("o.items").alias("item_index", "i")).select(
        *keys, "interaction_id", "item_index", F.col("i.id").alias("id"), F.col("i.text").alias("text"),
        F.col("i.bbox").alias("bbox"), F.col("i.originalIndex").alias("original_index"))


def explode_matching_items(docs: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """Matching items of both sides in one pass."""
    m = docs.select(*keys, F.explode("matchingInteractions").alias("m"))
    side = lambda name, s: F.transform(F.col(name), lambda i, n: F.struct(
        F.lit(s).alias("side"), n.alias("item_index"), i.alias("item")))
    both = m.select(*keys, F.col("m.id").alias("interaction_id"), F.explode(
        F.concat(side("m.leftItems", "left"), side("m.rightItems", "right"))).alias("x"))
    return both.select(*keys, "interaction_id", "x.side", "x.item_index", F.col("x.item.id").alias("id"),
                       F.col("x.item.label").alias("label"), F.col("x.item.text").alias("text"),
                       F.col("x.item.bbox").alias("bbox"), F.col("x.item.anchorBbox").alias("anchor_bbox"))


def explode_response_lines(docs: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """Free-text response lines."""
    f = docs.select(*keys, F.explode("freeTextInteractions").alias("f"))
    return f.select(*keys, F.col("f.id").alias("interaction_id"), F.posexplode("f.responseLines").alias("line_index", "l")).select(
        *keys, "interaction_id", "line_index", F.col("l.id").alias("id"), F.col("l.bbox").alias("bbox"))


def explode_options(docs: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """Options of choice groups."""
    g = docs.select(*keys, F.explode("choiceGroups").alias("g"))
    return g.select(*keys, F.col("g.id").alias("group_id"), F.posexplode("g.options").alias("option_index", "o")).select(
        *keys, "group_id", "option_index", F.col("o.id").alias("id"), F.col("o.label").alias("label"))


def explode_exercises(docs: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """Semantic exercises with their stored index."""
    e = docs.select(*keys, F.posexplode("semanticExercises").alias("exercise_index", "e"))
    return e.select(*keys, "exercise_index", "e.*")


def exercise_members(docs: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """P3 bridge: (exercise, interaction id)."""
    return explode_exercises(docs, keys).select(
        *keys, "exercise_index", F.col("id").alias("exercise_id"), F.posexplode("interactionIds").alias("pos", "interaction_id"))


def exercise_spans(docs: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """P3 bridge: (exercise, context span id)."""
    return explode_exercises(docs, keys).select(
        *keys, "exercise_index", F.col("id").alias("exercise_id"), F.posexplode("contextSpanIds").alias("pos", "span_id"))


def interaction_aliases(docs: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """Alias -> canonical interaction; grid rows name their grid, ordering exercise ids their group.

    The first match in family order wins, as in a lookup by id.
    """
    struct = "struct<alias:string,id:string,kind:string,ordinal:int,nearby_ids:array<string>,fam:int>"
    none = F.array().cast(f"array<{struct}>")

    def plain(column: str, kind: str, fam: int) -> Column:
        return F.transform(column, lambda x, i: F.struct(
            x["id"].alias("alias"), x["id"].alias("id"), F.lit(kind).alias("kind"), i.cast("int").alias("ordinal"),
            x["nearbyTextSpanIds"].alias("nearby_ids"), F.lit(fam).alias("fam")).cast(struct))

    def grids() -> Column:
        def one(g: Column, i: Column) -> Column:
            near = F.array_distinct(F.flatten(F.transform(g["rows"], lambda r: r["nearbyTextSpanIds"])))
            names = F.concat(F.array(g["id"]), F.transform(g["rows"], lambda r: r["id"]))
            return F.transform(names, lambda n: F.struct(
                n.alias("alias"), g["id"].alias("id"), F.lit("choice-grid").alias("kind"), i.cast("int").alias("ordinal"),
                near.alias("nearby_ids"), F.lit(2).alias("fam")).cast(struct))
        return F.flatten(F.transform("choiceGrids", one))

    def orderings() -> Column:
        all_orderings = F.col("sentenceOrderings")

        def one(o: Column, i: Column) -> Column:
            group = F.when(F.coalesce(F.trim(o["exerciseId"]), F.lit("")) != "", o["exerciseId"]).otherwise(o["id"])
            mates = F.filter(all_orderings, lambda c: c["exerciseId"] == o["exerciseId"])
            group_near = F.array_distinct(F.flatten(F.transform(mates, lambda c: c["nearbyTextSpanIds"])))
            own = F.struct(o["id"].alias("alias"), group.alias("id"), F.lit("sentence-ordering").alias("kind"),
                           i.cast("int").alias("ordinal"), F.array_distinct(o["nearbyTextSpanIds"]).alias("nearby_ids"),
                           F.lit(3).alias("fam")).cast(struct)
            whole = F.struct(o["exerciseId"].alias("alias"), group.alias("id"), F.lit("sentence-ordering").alias("kind"),
                             i.cast("int").alias("ordinal"), group_near.alias("nearby_ids"), F.lit(3).alias("fam")).cast(struct)
            return F.when(o["exerciseId"].isNotNull() & (o["exerciseId"] != o["id"]), F.array(own, whole)).otherwise(F.array(own))
        return F.flatten(F.transform("sentenceOrderings", one))

    parts = [plain("exerciseBlanks", "fill-in-line", 0), plain("choiceTargets", "choice", 1), grids(), orderings(),
             plain("matchingInteractions", "matching", 4), plain("freeTextInteractions", "free-text", 5)]
    rows = docs.select(*keys, F.explode(F.concat(*[F.coalesce(p, none) for p in parts])).alias("a")).select(*keys, "a.*")
    first = rows.groupBy(*keys, "alias").agg(
        F.min_by(F.struct("id", "kind", "ordinal", "nearby_ids"), F.struct("fam", "ordinal")).alias("_f"))
    return first.select(*keys, "alias", "_f.*")


def resolve_interaction_id(requests: DataFrame, aliases: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """Requests (keys, exercise_id) with the canonical id, kind and ordinal (null = unknown)."""
    return requests.join(aliases.withColumnRenamed("alias", "exercise_id"), [*keys, "exercise_id"], "left")


def ordered_distinct(values: Column) -> Column:
    """First-seen distinct values without empties."""
    return F.array_distinct(F.filter(values, lambda v: F.coalesce(v != "", F.lit(False))))


def visible_analysis(status: Column, analysis: Column) -> Column:
    """the analysis is shown when READY, or FAILED (a failed refresh keeps the old one)."""
    return F.when(status.isin("READY", "FAILED"), analysis)


def detection_stats(docs: DataFrame) -> DataFrame:
    """Per detector method: pages, raw, accepted, groups, duration; one pass over the documents."""
    named = [F.struct(F.lit(n).alias("family"), F.col(n).alias("d")) for n in SC.DETECTION_FIELDS]
    rows = docs.select(F.explode(F.array(*named)).alias("x")).where("x.d IS NOT NULL").select("x.family", "x.d.*")
    return rows.groupBy("family", "detectionMethod").agg(
        F.count("*").alias("pages"), F.sum("rawCandidateCount").alias("raw"), F.sum("acceptedCount").alias("accepted"),
        F.sum("groupCount").alias("groups"), F.avg("durationMs").alias("mean_ms"),
        F.percentile_approx("durationMs", 0.95).alias("p95_ms"),
        F.try_divide(F.sum("acceptedCount"), F.sum("rawCandidateCount")).alias("acceptance"))


def kind_counts(interactions: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """Interactions per kind as columns, and their total."""
    counts = [F.count_if(F.col("kind") == k).alias(k.replace("-", "_")) for k in SC.KIND_ORDER]
    return interactions.groupBy(*keys).agg(*counts, F.count("*").alias("total"))


def coverage(slots: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Resolved, ambiguous and unmapped shares."""
    counted = slots.groupBy(*keys).agg(F.count("*").alias("slots"), *[
        F.count_if(F.col("resolution") == r).alias(r.lower()) for r in ("RESOLVED", "AMBIGUOUS", "UNMAPPED")])
    return counted.withColumn("resolved_share", F.col("resolved") / F.col("slots"))


def document_fingerprints(docs: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """C16 for all families: (id, store_kind, fingerprint); grids are fingerprinted per row."""
    from leafgrade.functions.textops import fingerprint

    struct = "struct<id:string,store_kind:string,fingerprint:string>"
    none = F.array().cast(f"array<{struct}>")
    v = F.col("schemaVersion")

    def fam(column: str, kind: str, box: str, *extra) -> Column:
        return F.transform(column, lambda x: F.struct(
            x["id"].alias("id"), F.lit(kind).alias("store_kind"),
            fingerprint(v, x["detectionMethod"], x[box], *[e(x) for e in extra]).alias("fingerprint")).cast(struct))

    grid_rows = F.flatten(F.transform("choiceGrids", lambda g: F.transform(g["rows"], lambda r: F.struct(
        r["id"].alias("id"), F.lit("choice-grid").alias("store_kind"),
        fingerprint(v, g["detectionMethod"], r["rowBbox"], group=g["optionGroupId"]).alias("fingerprint")).cast(struct))))
    size = lambda f: (lambda x: F.size(x[f]))
    parts = [
        fam("exerciseBlanks", "fill-blank", "lineBbox"),
        fam("choiceTargets", "choice", "targetBbox", lambda x: x["optionGroupId"]),
        grid_rows,
        fam("sentenceOrderings", "sentence-ordering", "bbox", size("items")),
        fam("matchingInteractions", "matching", "bbox", size("leftItems"), size("rightItems")),
        fam("freeTextInteractions", "free-text", "bbox", size("responseLines")),
    ]
    return docs.select(*keys, F.explode(F.concat(*[F.coalesce(p, none) for p in parts])).alias("f")).select(*keys, "f.*")
