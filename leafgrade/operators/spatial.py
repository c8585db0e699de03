"""Spatial joins on a page.

Inputs carry a ``bbox`` struct (or x, y, width, height columns where noted)
and the page key ``book_id, page_number``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafgrade.functions import geometry as G
from leafgrade.operators.cluster import PAGE, flag_groups
from leafgrade.operators.intervals import band_exists, band_join


def proximity_join(boxes: DataFrame, spans: DataFrame, keys: Sequence[str] = PAGE, max_x_gap: float = 0.06,
                   min_y_reach: float = 0.006, height_scale: float = 1.5) -> DataFrame:
    """Pairs (l = box, r = span) of a page that lie on about the same print row.

    A span is near when its centre is within max(1.5 span heights, 0.006) of
    the box centre and the horizontal gap is at most 0.06 (unit page).
    """
    box, span = F.col("bbox"), F.col("bbox")
    reach = F.greatest(span["height"] * height_scale, F.lit(min_y_reach))
    lb, rb = F.col("l.bbox"), F.col("r.bbox")
    gap = F.greatest(G.left(rb) - G.right(lb), G.left(lb) - G.right(rb), F.lit(0.0))
    near = F.abs(G.center_y(rb) - G.center_y(lb)) <= F.greatest(rb["height"] * height_scale, F.lit(min_y_reach))
    return band_join(boxes, spans, keys, (G.center_y(box), G.center_y(box)),
                     (G.center_y(span) - reach, G.center_y(span) + reach), near & (gap <= max_x_gap))


def nearby_span_ids(boxes: DataFrame, spans: DataFrame, keys: Sequence[str] = PAGE, **limits) -> DataFrame:
    """Boxes with ``nearby_ids`` in (x, id) order; boxes without near spans get an empty list."""
    pairs = proximity_join(boxes, spans, keys, **limits)
    ids = [*keys, "id"]
    listed = pairs.groupBy(*[F.col("l")[k].alias(k) for k in ids]).agg(
        F.array_sort(F.collect_list(F.struct(F.col("r.bbox.x").alias("x"), F.col("r.id").alias("id")))).alias("_n"))
    joined = boxes.join(listed, ids, "left")
    return joined.withColumn("nearby_ids", F.coalesce(F.transform("_n", lambda n: n["id"]),
                                                      F.array().cast("array<string>"))).drop("_n")


def prompt_above_join(stacks: DataFrame, spans: DataFrame, keys: Sequence[str] = PAGE, margin: float = 0.05,
                      max_distance: float = 0.18, min_height: float = 0.004) -> DataFrame:
    """Pairs (l = stack, r = span) where a confident span stands above the stack within reach."""
    able = spans.where((F.col("confidence") >= 0.5) & (F.col("bbox.height") >= min_height))
    lb, rb = F.col("l.bbox"), F.col("r.bbox")
    ok = (
        G.center_x(rb).between(G.left(lb) - margin, G.right(lb) + margin)
        & (G.bottom(rb) <= G.top(lb)) & (G.top(lb) - G.top(rb) <= max_distance)
    )
    b = F.col("bbox")
    return band_join(stacks, able, keys, (G.top(b) - max_distance, G.top(b)), (G.top(b), G.top(b)), ok)


def header_label_join(columns: DataFrame, spans: DataFrame, keys: Sequence[str] = PAGE, max_distance: float = 0.05,
                      band: float = 0.006, max_width: float = 0.09) -> DataFrame:
    """Best header span per answer column: short, above the first rule, closest to the column centre.

    ``columns`` has id, x0, x1, first_rule_y, cells_top; ties go to the lower span idx.
    """
    lc, rb = F.col("l"), F.col("r.bbox")
    low = G.bottom(rb)
    ok = (
        (low < lc["first_rule_y"]) & (lc["first_rule_y"] - low <= max_distance)
        & (low <= lc["cells_top"] + band) & (rb["width"] <= max_width)
        & G.center_x(rb).between(lc["x0"], lc["x1"])
    )
    pairs = band_join(columns, spans, keys, (F.col("first_rule_y") - max_distance, F.col("first_rule_y")),
                      (G.bottom(F.col("bbox")), G.bottom(F.col("bbox"))), ok)
    distance = F.abs(G.center_x(rb) - (lc["x0"] + lc["x1"]) / 2)
    return _best_span(pairs, [*keys, "id"], F.struct(distance, F.col("r.idx")))


def prompt_cell_join(cells: DataFrame, spans: DataFrame, keys: Sequence[str] = PAGE, tolerance: float = 0.002) -> DataFrame:
    """Widest span whose centre lies in the prompt column and row band (first wins a tie).

    ``cells`` has id, x0, x1, y0, y1.
    """
    lc, rb = F.col("l"), F.col("r.bbox")
    ok = (G.center_x(rb).between(lc["x0"], lc["x1"])
          & G.center_y(rb).between(lc["y0"] - tolerance, lc["y1"] + tolerance))
    b = F.col("bbox")
    pairs = band_join(cells, spans, keys, (F.col("y0") - tolerance, F.col("y1") + tolerance),
                      (G.center_y(b), G.center_y(b)), ok)
    return _best_span(pairs, [*keys, "id"], F.struct(-rb["width"], F.col("r.idx")))


def _best_span(pairs: DataFrame, keys: Sequence[str], rank: Column) -> DataFrame:
    """Top-1 by aggregation (map-side combined) instead of a window."""
    picked = pairs.groupBy(*[F.col("l")[k].alias(k) for k in keys]).agg(
        F.min_by(F.struct(F.col("r.id").alias("id"), F.col("r.text").alias("text")), rank).alias("_b"))
    return picked.select(*keys, F.col("_b.id").alias("span_id"), F.col("_b.text").alias("span_text"))


def legend_join(blocks: DataFrame, spans: DataFrame, keys: Sequence[str] = PAGE, max_distance: float = 0.12,
                row_gap: float = 0.04, min_options: int = 2) -> DataFrame:
    """Option digits of the numbered legend above a target block.

    ``blocks`` has block, first_y. Output: block and ``digits`` (ascending by
    number) of the lowest legend cluster with enough different digits.
    """
    legends = spans.withColumn("digit", F.regexp_extract("text", r"^(\d{1,3})\s*=\s*\S", 1)).where("digit <> ''")
    low = G.bottom(F.col("r.bbox"))
    first = F.col("l.first_y")
    pairs = band_join(blocks, legends, keys, (F.col("first_y") - max_distance, F.col("first_y")),
                      (G.bottom(F.col("bbox")), G.bottom(F.col("bbox"))),
                      (low < first) & (first - low <= max_distance))
    rows = pairs.select(*[F.col("l")[k].alias(k) for k in [*keys, "block"]], F.col("r.bbox.y").alias("y"),
                        F.col("r.idx").alias("idx"), F.col("r.digit").alias("digit"))
    group = [*keys, "block"]
    w = Window.partitionBy(*group).orderBy("y", "idx")
    gapped = rows.withColumn("_gap", F.col("y") - F.lag("y").over(w))
    clustered = flag_groups(gapped, group, ["y", "idx"], F.col("_gap") > row_gap, "cluster")
    sets = clustered.groupBy(*group, "cluster").agg(F.collect_set("digit").alias("digits"))
    best = sets.where(F.size("digits") >= min_options).groupBy(*group).agg(F.max_by("digits", "cluster").alias("d"))
    ordered = F.transform(F.array_sort(F.transform("d", lambda d: F.struct(d.cast("int").alias("n"), d.alias("d")))),
                          lambda s: s["d"])
    return best.select(*group, ordered.alias("digits"))


def row_bands(rows: DataFrame, keys: Sequence[str], y: str = "y", order: Sequence[str] = ("y",)) -> DataFrame:
    """Adds ``band_top`` and ``band_bottom``: half way to the neighbour rows, else half a median gap."""
    w, whole = Window.partitionBy(*keys).orderBy(*order), Window.partitionBy(*keys)
    c = F.col(y)
    df = rows.withColumn("_prev", F.lag(y).over(w)).withColumn("_next", F.lead(y).over(w))
    gap = c - F.col("_prev")
    ref = F.coalesce(F.percentile(F.when(gap > 0, gap), F.lit(0.5)).over(whole), F.lit(0.0))
    df = df.withColumn("_ref", ref)
    top = F.coalesce(F.col("_prev") + (c - F.col("_prev")) / 2, c - F.col("_ref") / 2)
    bottom = F.coalesce(F.col("_next") - (F.col("_next") - c) / 2, c + F.col("_ref") / 2)
    return df.withColumn("band_top", top).withColumn("band_bottom", bottom).drop("_prev", "_next", "_ref")


def row_band_join(rows: DataFrame, spans: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """Pairs (l = banded row with x_left, x_right; r = confident span) with ``side`` left or right.

    A span between the two anchor columns belongs to neither side.
    """
    b = F.col("bbox")
    able = spans.where(F.col("confidence") >= 0.5)
    lc, cx, cy = F.col("l"), G.center_x(F.col("r.bbox")), G.center_y(F.col("r.bbox"))
    ok = cy.between(lc["band_top"], lc["band_bottom"]) & ((cx < lc["x_left"]) | (cx > lc["x_right"]))
    pairs = band_join(rows, able, keys, (F.col("band_top"), F.col("band_bottom")), (G.center_y(b), G.center_y(b)), ok)
    return pairs.withColumn("side", F.when(cx < lc["x_left"], "left").otherwise("right"))


def owned_spans(spans: DataFrame, owners: DataFrame, selected: DataFrame, ranges: DataFrame,
                keys: Sequence[str] = PAGE, tolerance: float = 0.003) -> DataFrame:
    """Spans of the selected exercises, plus unowned spans inside a selected text range.

    ``owners`` (span_id) lists spans of any exercise, ``selected`` (span_id)
    those of selected exercises, ``ranges`` (top, bottom) their text ranges.
    """
    by_id = lambda df: df.select(*keys, F.col("span_id").alias("id")).distinct()
    mine = spans.join(by_id(selected), [*keys, "id"], "left_semi")
    free = spans.join(by_id(owners), [*keys, "id"], "left_anti")
    cy = G.center_y(F.col("bbox"))
    inside = band_exists(free, ranges, keys, ["id"], (cy, cy),
                         (F.col("top") - tolerance, F.col("bottom") + tolerance))
    return mine.unionByName(inside)


def region_select(exercises: DataFrame, selections: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """Pairs (l = exercise, r = selection): one box holds the centre of the other."""
    lb, rb = F.col("l.bbox"), F.col("r.bbox")
    ok = (G.bbox_contains_point(lb, G.center_x(rb), G.center_y(rb))
          | G.bbox_contains_point(rb, G.center_x(lb), G.center_y(lb)))
    b = F.col("bbox")
    return band_join(exercises, selections, keys, (G.top(b), G.bottom(b)), (G.top(b), G.bottom(b)), ok)


def intersecting(boxes: DataFrame, selections: DataFrame, keys: Sequence[str] = PAGE, tolerance: float = 0.003) -> DataFrame:
    """X7 as a join: pairs (l = box, r = selection) that overlap within the tolerance."""
    b = F.col("bbox")
    return band_join(boxes, selections, keys, (G.top(b) - tolerance, G.bottom(b) + tolerance), (G.top(b), G.bottom(b)),
                     G.bbox_intersects(F.col("l.bbox"), F.col("r.bbox"), tolerance))


def context_anti_join(spans: DataFrame, evidence_ids: DataFrame, evidence_boxes: DataFrame,
                      keys: Sequence[str] = PAGE, tolerance: float = 0.012) -> DataFrame:
    """Spans that are no evidence and whose centre is in no evidence box (widened in y)."""
    unused = spans.join(evidence_ids.select(*keys, F.col("span_id").alias("id")).distinct(), [*keys, "id"], "left_anti")
    b, cy = F.col("bbox"), G.center_y(F.col("bbox"))
    return band_exists(unused, evidence_boxes, keys, ["id"], (cy, cy), (G.top(b) - tolerance, G.bottom(b) + tolerance),
                       negate=True)


def iou_suppress(boxes: DataFrame, claimed: DataFrame, keys: Sequence[str] = PAGE, threshold: float = 0.5) -> DataFrame:
    """Boxes without an overlap of at least ``threshold`` IoU with a claimed box."""
    b = F.col("bbox")
    hit = G.iou(F.col("l.bbox"), F.col("r.bbox")) >= threshold
    span = (G.top(b), G.bottom(b))
    return band_exists(boxes, claimed, keys, ["id"], span, span, hit, negate=True)


def text_context_gate(lines: DataFrame, spans: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """Adds ``accepted`` to candidate lines (id, bbox), from the text left, right and over the line.

    The page is the unit square, so widths are page ratios already.
    """
    lb, rb = F.col("l.bbox"), F.col("r.bbox")
    width = lb["width"]
    ratio = G.overlap_1d(G.left(lb), G.right(lb), G.left(rb), G.right(rb)) / F.least(width, rb["width"])
    close = F.abs(G.center_y(lb) - G.center_y(rb)) <= rb["height"] * 1.2
    facts = proximity_join(lines, spans, keys).groupBy(*[F.col("l")[k].alias(k) for k in [*keys, "id"]]).agg(
        F.count("*").alias("near"),
        F.bool_or(G.right(rb) <= G.left(lb)).alias("has_left"),
        F.bool_or(G.left(rb) >= G.right(lb)).alias("has_right"),
        F.bool_or((width < 0.065) & (ratio > 0.35) & close).alias("over_text"),
    )
    w = F.col("bbox.width")
    both = F.col("has_left") & F.col("has_right") & (~F.col("over_text") | (w < 0.04))
    one_side = (w >= 0.05) & (F.col("has_left") | F.col("has_right"))
    rule = F.when(F.col("near").isNull(), False).when(both, True).when(F.col("over_text"), False).otherwise(
        (w >= 0.065) | one_side)
    return lines.join(facts, [*keys, "id"], "left").withColumn("accepted", rule).drop(
        "near", "has_left", "has_right", "over_text")


def parallel_line_semi(lines: DataFrame, keys: Sequence[str] = PAGE, gap: float = 0.018, share: float = 0.6) -> DataFrame:
    """Lines with another line on the same row band that overlaps at least 0.6 of the shorter."""
    lb, rb = F.col("l.bbox"), F.col("r.bbox")
    other = (rb["x"] != lb["x"]) | (rb["y"] != lb["y"])
    shared = G.overlap_1d(G.left(lb), G.right(lb), G.left(rb), G.right(rb)) >= F.least(lb["width"], rb["width"]) * share
    y = F.col("bbox.y")
    return band_exists(lines, lines, keys, ["id"], (y - gap, y + gap), (y, y),
                       other & shared & (F.abs(rb["y"] - lb["y"]) <= gap))


def strip_nearest(lines: DataFrame, strips: DataFrame, keys: Sequence[str] = PAGE, reach: float = 0.0) -> DataFrame:
    """Adds ``strip_gap``: edge distance to the nearest vertical strip in the row band (null without one).

    The band of a line ends ``reach`` below it.
    """
    lb, rb = F.col("l.bbox"), F.col("r.bbox")
    same_row = F.greatest(rb["y"], lb["y"]) < F.least(G.bottom(rb), G.bottom(lb) + reach)
    b = F.col("bbox")
    gap = F.least(F.abs(G.left(rb) - G.left(lb)), F.abs(G.right(rb) - G.right(lb)))
    near = band_join(lines, strips, keys, (G.top(b), G.bottom(b) + reach), (G.top(b), G.bottom(b)), same_row).groupBy(
        *[F.col("l")[k].alias(k) for k in [*keys, "id"]]).agg(F.min(gap).alias("strip_gap"))
    return lines.join(near, [*keys, "id"], "left")


def strip_cross(lines: DataFrame, strips: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """Lines whose box is crossed by a vertical strip."""
    lb, rb = F.col("l.bbox"), F.col("r.bbox")
    cross = ((F.greatest(rb["x"], lb["x"]) < F.least(G.right(rb), G.right(lb)))
             & (F.greatest(rb["y"], lb["y"]) < F.least(G.bottom(rb), G.bottom(lb))))
    b = F.col("bbox")
    return band_exists(lines, strips, keys, ["id"], (G.top(b), G.bottom(b)), (G.top(b), G.bottom(b)), cross)


# Candidate gates per detector, as measure -> (low, high); None is open.
GATES = {
    "blank-line": {"width": (0.02, 0.45), "height": (None, 0.012), "aspect": (8.0, None)},
    "free-text-line": {"width": (0.30, 0.97), "height": (None, 0.012), "aspect": (20.0, None)},
    "ring": {"diameter": (0.012, 0.045), "aspect": (0.72, 1.38), "extent": (0.65, None)},
    "grid-rule": {"width": (0.15, None)},
    "grid-vertical": {"height": (0.015, None)},
}


def gate_candidates(candidates: DataFrame, gates: dict = GATES) -> DataFrame:
    """candidates (family + measures) inside every band of their family.

    The bands are a handful of constants, so they become predicates, not a join.
    """
    keep = F.lit(False)
    for family, bands in gates.items():
        ok = F.col("family") == family
        for measure, (low, high) in bands.items():
            if low is not None:
                ok = ok & (F.col(measure) >= low)
            if high is not None:
                ok = ok & (F.col(measure) <= high)
        keep = keep | ok
    return candidates.where(F.coalesce(keep, F.lit(False)))
