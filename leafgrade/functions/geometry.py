"""Bounding-box Columns.

A box is a struct {x, y, width, height} of doubles in [0, 1] with a top-left
origin. Everything here is a plain Column expression, so it stays inside
whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafgrade.functions.arrays import let
from leafgrade.functions.textops import round_exact


def box(x, y, width, height) -> Column:
    return F.struct(
        _d(x).alias("x"), _d(y).alias("y"), _d(width).alias("width"), _d(height).alias("height"),
    )


def _d(value) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast("double")


def left(b: Column) -> Column:
    return b["x"]


def top(b: Column) -> Column:
    return b["y"]


def right(b: Column) -> Column:
    return b["x"] + b["width"]


def bottom(b: Column) -> Column:
    return b["y"] + b["height"]


def center_x(b: Column) -> Column:
    return b["x"] + b["width"] / 2


def center_y(b: Column) -> Column:
    return b["y"] + b["height"] / 2


def clamp(value: Column, low, high) -> Column:
    return F.least(F.greatest(value, _d(low)), _d(high))


def bbox_normalize(l: Column, t: Column, r: Column, b: Column, width: Column, height: Column) -> Column:
    """Pixel edges to a unit box; edges are clamped, a page without area is an error."""
    w, h = width.cast("double"), height.cast("double")
    left_ = clamp(l.cast("double"), 0, w)
    top_ = clamp(t.cast("double"), 0, h)
    right_ = F.greatest(left_, F.least(w, r.cast("double")))
    bottom_ = F.greatest(top_, F.least(h, b.cast("double")))
    good = box(left_ / w, top_ / h, (right_ - left_) / w, (bottom_ - top_) / h)
    return F.when((w > 0) & (h > 0), good).otherwise(
        F.raise_error(F.lit("page width and height must be positive")).cast("void")
    )


def bbox_normalize_client(l: Column, t: Column, r: Column, b: Column, width: Column, height: Column) -> Column:
    """The reader's variant; a missing size counts as 1, each part is clamped and cut to 6 digits."""
    w = F.when(width > 0, width.cast("double")).otherwise(F.lit(1.0))
    h = F.when(height > 0, height.cast("double")).otherwise(F.lit(1.0))
    part = lambda v: F.round(clamp(v, 0, 1), 6)
    return box(part(l / w), part(t / h), part((r - l) / w), part((b - t) / h))


def bbox_denormalize(b: Column, width: Column, height: Column, mode: str = "half_even") -> Column:
    """Unit box to integer pixel edges; ``half_even`` (service) or ``half_up`` (reader)."""
    rnd = F.rint if mode == "half_even" else (lambda v: F.floor(v + 0.5))
    px = lambda v, size: rnd(v * size).cast("long")
    return F.struct(
        px(left(b), width).alias("left"), px(top(b), height).alias("top"),
        px(right(b), width).alias("right"), px(bottom(b), height).alias("bottom"),
    )


def bbox_to_viewport(b: Column, width: Column, height: Column) -> Column:
    """Scale a unit box to viewport pixels."""
    return F.struct(
        (b["x"] * width).alias("left"), (b["y"] * height).alias("top"),
        (b["width"] * width).alias("width"), (b["height"] * height).alias("height"),
    )


def bbox_union_agg(b: Column, empty_as_zero: bool = False) -> Column:
    """Aggregate, the smallest box around all boxes of the group."""
    l, t, r, bt = F.min(left(b)), F.min(top(b)), F.max(right(b)), F.max(bottom(b))
    out = box(l, t, r - l, bt - t)
    return F.coalesce(F.when(l.isNotNull(), out), box(0, 0, 0, 0)) if empty_as_zero else F.when(l.isNotNull(), out)


def bbox_union_array(boxes: Column) -> Column:
    """X4 over an array of boxes (null when empty)."""
    def around(bs: Column) -> Column:
        edges = [F.array_min(F.transform(bs, left)), F.array_min(F.transform(bs, top)),
                 F.array_max(F.transform(bs, right)), F.array_max(F.transform(bs, bottom))]
        return let(lambda l, t, r, b: F.when(l.isNotNull(), box(l, t, r - l, b - t)), *edges)
    return let(around, boxes)


def normalize_rotation(angle: Column) -> Column:
    """Any angle to 0/90/180/270; anything else (or non-finite) counts as 0."""
    finite = angle.isNotNull() & ~F.isnan(angle.cast("double")) & (F.abs(angle.cast("double")) != float("inf"))
    quarter = F.pmod(F.floor(angle.cast("double") + 0.5).cast("long"), F.lit(360))
    return F.when(finite & quarter.isin(0, 90, 180, 270), quarter).otherwise(F.lit(0)).cast("int")


def bbox_rotate(b: Column, angle: Column) -> Column:
    """Rotate a unit box clockwise by a quarter turn count."""
    x, y, w, h = b["x"], b["y"], b["width"], b["height"]
    return (
        F.when(angle == 90, box(1 - (y + h), x, h, w))
        .when(angle == 180, box(1 - (x + w), 1 - (y + h), w, h))
        .when(angle == 270, box(y, 1 - (x + w), h, w))
        .otherwise(box(x, y, w, h))
    )


def overlap_1d(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Length of the common part of two intervals."""
    return F.greatest(_d(0), F.least(a1, b1) - F.greatest(a0, b0))


def overlap_ratio(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Overlap relative to the shorter interval."""
    return overlap_1d(a0, a1, b0, b1) / F.least(a1 - a0, b1 - b0)


def band_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Signed overlap (negative when apart)."""
    return F.least(a1, b1) - F.greatest(a0, b0)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 when the union has no area."""
    inter = overlap_1d(left(a), right(a), left(b), right(b)) * overlap_1d(top(a), bottom(a), top(b), bottom(b))
    union = a["width"] * a["height"] + b["width"] * b["height"] - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def bbox_intersects(a: Column, b: Column, tolerance: float = 0.003) -> Column:
    """Strict overlap of ``a`` with ``b`` widened by the tolerance."""
    return (
        (left(a) < right(b) + tolerance) & (right(a) > left(b) - tolerance)
        & (top(a) < bottom(b) + tolerance) & (bottom(a) > top(b) - tolerance)
    )


def bbox_contains_point(b: Column, x: Column, y: Column) -> Column:
    """Inclusive point-in-box test."""
    return (x >= left(b)) & (x <= right(b)) & (y >= top(b)) & (y <= bottom(b))


def matching_endpoint(bbox: Column, anchor: Column, side: Column) -> Column:
    """X11: anchor centre, else the middle of the box edge that faces the other column."""
    edge = F.when(side == "left", right(bbox)).otherwise(left(bbox))
    return F.struct(
        F.when(anchor.isNotNull(), center_x(anchor)).otherwise(edge).alias("x"),
        F.when(anchor.isNotNull(), center_y(anchor)).otherwise(center_y(bbox)).alias("y"),
    )


def valid_selection(b: Column) -> Column:
    """a finite, non-empty rectangle inside the unit page."""
    finite = F.lit(True)
    for part in ("x", "y", "width", "height"):
        v = b[part]
        finite = finite & v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    inside = (
        (b["x"] >= 0) & (b["y"] >= 0) & (b["width"] > 0) & (b["height"] > 0)
        & (right(b) <= 1) & (bottom(b) <= 1)
    )
    return F.coalesce(finite & inside, F.lit(False))


# Score weights and targets per detector family.
SCORE_RULES = {
    "blank": {"width": (0.45, 0.12), "aspect": (0.30, 30.0), "evidence": (0.25, 2.0)},
    "choice": {
        "diameter": (0.35, 0.028), "extent": (0.30, 0.78),
        "text_relative": (0.20, 1.25), "evidence": (0.15, 2.0),
    },
    "grid": {"rules": (0.30, 4.0), "columns": (0.20, 3.0), "labels": (0.30, 1.0), "rows": (0.20, 5.0)},
    "ordering": {"lines": (0.45, 4.0), "fragments": (0.35, 5.0), "consistency": (0.20, 1.0)},
    "matching": {"paired": (0.40, 1.0), "text": (0.30, 1.0), "symmetry": (0.15, 1.0), "labels": (0.15, 1.0)},
    "free-text": {"lines": (0.45, 2.0), "width": (0.35, 0.60), "prompt": (0.20, 1.0)},
}
# measures that are ratios already and are used as they are
UNCAPPED = {("grid", "labels"), ("ordering", "consistency"), ("matching", "paired"), ("matching", "text"),
            ("matching", "symmetry"), ("matching", "labels"), ("free-text", "prompt")}


def candidate_score(kind: str, **measures: Column) -> Column:
    """Weighted sum of capped ratios, rounded half-even to 4 digits."""
    rules = SCORE_RULES[kind]
    if set(rules) != set(measures):
        raise ValueError(f"{kind} score needs {sorted(rules)}, got {sorted(measures)}")
    total = None
    for name, (weight, target) in rules.items():
        value = _d(measures[name])
        ratio = value if (kind, name) in UNCAPPED else F.least(value / target, F.lit(1.0))
        total = ratio * weight if total is None else total + ratio * weight
    return round_exact(total)


def line_interaction_bbox(
    x: Column, y: Column, w: Column, h: Column, median_height: Column, page_w: Column, page_h: Column,
    scale: float = 1.25, baseline: float = 0.82,
) -> Column:
    """Writing box over a line, 1.25 median text heights tall with the line at 82 % of it."""
    height = median_height * scale
    box_top = y + h / 2 - height * baseline
    return bbox_normalize(x, box_top, x + w, box_top + height, page_w, page_h)


def ring_interaction_bbox(
    x: Column, y: Column, w: Column, h: Column, median_height: Column, page_w: Column, page_h: Column,
    scale: float = 1.6,
) -> Column:
    """Square of 1.6 max(diameter, median text height) around a ring (no text: the diameter)."""
    diameter = F.greatest(w.cast("double"), h.cast("double"))
    size = F.greatest(diameter, F.coalesce(median_height, diameter)) * scale
    cx, cy = x + w / 2, y + h / 2
    return bbox_normalize(cx - size / 2, cy - size / 2, cx + size / 2, cy + size / 2, page_w, page_h)


def text_relative_diameter(w: Column, h: Column, median_height: Column) -> Column:
    """Ring diameter relative to the median height of its text (0 without text)."""
    return F.when(
        median_height.isNotNull(), F.greatest(w, h) / F.greatest(median_height, F.lit(1.0))
    ).otherwise(F.lit(0.0))
