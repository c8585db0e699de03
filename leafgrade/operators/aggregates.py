"""Box and text aggregates over exploded tables (X4, X12, A2, A8, A11, C4, C5-style joins)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgrade.functions import geometry as G
from leafgrade.functions import textops as X
from leafgrade.operators.spatial import proximity_join


def union_boxes(boxes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Smallest box around all boxes of a group."""
    return boxes.groupBy(*keys).agg(G.bbox_union_agg(F.col("bbox")).alias("bbox"))


def span_texts(members: DataFrame, spans: DataFrame, keys: Sequence[str], group: Sequence[str]) -> DataFrame:
    """C4: reading-order text per group of span ids (``members``: keys, group, span_id)."""
    once = members.select(*keys, *group, F.col("span_id").alias("id")).distinct()
    joined = once.join(spans.select(*keys, "id", "idx", "text", "bbox"), [*keys, "id"])
    rows = F.collect_list(F.struct(F.col("bbox.y").alias("y"), F.col("bbox.x").alias("x"), "idx", "text"))
    return joined.groupBy(*keys, *group).agg(X.span_text_array(rows).alias("text"))


def median_near_height(boxes: DataFrame, spans: DataFrame, keys: Sequence[str], **limits) -> DataFrame:
    """Exact median height of the spans near each box (null without any) and their count."""
    near = proximity_join(boxes, spans, keys, **limits).groupBy(*[F.col("l")[k].alias(k) for k in [*keys, "id"]]).agg(
        F.percentile("r.bbox.height", F.lit(0.5)).alias("median_height"), F.count("*").alias("near_count"))
    return boxes.join(near, [*keys, "id"], "left")


def interaction_count(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Interactions of lesson blocks (kind, size): all members, one per matching or free text, none per context."""
    size = F.when(F.col("kind") == "context", 0).when(F.col("kind").isin("matching", "free-text"), 1).otherwise(F.col("size"))
    return blocks.groupBy(*keys).agg(F.sum(size).alias("interactions"))
