"""Page layout queries: ordering, clustering, geometry and spatial joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafgrade.functions import geometry as G
from leafgrade.functions import textops as X
from leafgrade.operators import aggregates as A
from leafgrade.operators import cluster as C
from leafgrade.operators import matching as M
from leafgrade.operators import spatial as J
from leafgrade.operators.scans import CHUNK, running_groups
from leafgrade.plans import tables as T
from leafgrade.plans.registry import query

D = T.DOC
WITH_LINES = f"WITH {T.LINES}"
WITH_SPANS = f"WITH {T.SPANS}"


def _y():
    return F.col("y")


def _low():
    return F.col("y") + F.col("h")


@query("reading_order_lines", "P1 W1", f"""{WITH_LINES}
SELECT doc_id, i, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY y, x, i) AS BIGINT) AS reading_index FROM ln""")
def _(spark, sf):
    df = T.lines(spark, sf)
    return C.reading_order(df, D, ["y", "x", "i"]).select("doc_id", "i", "reading_index")


GAPS = """SELECT doc_id, i, y, h, CASE WHEN y - lag(y + h) OVER w > 4.0/512 THEN 1 ELSE 0 END AS f FROM ln
  WINDOW w AS (PARTITION BY doc_id ORDER BY y, i)"""


@query("gap_cluster_lines", "W2", f"""{WITH_LINES}, g AS ({GAPS})
SELECT doc_id, i, CAST(sum(f) OVER (PARTITION BY doc_id ORDER BY y, i) AS BIGINT) AS cluster FROM g""")
def _(spark, sf):
    return C.gap_cluster(T.lines(spark, sf), D, ["y", "i"], _y(), _low(), 4 / 512).select("doc_id", "i", "cluster")


@query("capped_clusters", "W5", f"""{WITH_LINES}, g AS ({GAPS}),
c AS (SELECT doc_id, i, y, sum(f) OVER (PARTITION BY doc_id ORDER BY y, i) AS run FROM g),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY y, i) - 1 AS pos FROM c)
SELECT doc_id, i, CAST(sum(CASE WHEN pos % 6 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY y, i) - 1 AS BIGINT)
 AS cluster FROM p""")
def _(spark, sf):
    return C.capped_gap_cluster(T.lines(spark, sf), D, ["y", "i"], _y(), _low(), 4 / 512, 6).select("doc_id", "i", "cluster")


def _fold_sql(acc: str, start: str, select: str, order: str, payload: str) -> str:
    """list_reduce over a document's sorted lines; states and rows share one struct type."""
    return f"""{WITH_LINES}, st AS (SELECT doc_id, list({payload} ORDER BY {order}) AS l FROM ln GROUP BY doc_id),
r AS (SELECT doc_id, list_reduce(list_prepend({start}, l), lambda a, b: {acc}) AS s FROM st)
{select}"""


@query("anchored_clusters", "W3", _fold_sql(
    "CASE WHEN a.y < 0 OR b.y - a.y > 8.0/512 THEN {'y': b.y, 'n': a.n + 1, 'ids': list_append(a.ids, a.n + 1), 'i': list_append(a.i, b.i[1])}"
    " ELSE {'y': a.y, 'n': a.n, 'ids': list_append(a.ids, a.n), 'i': list_append(a.i, b.i[1])} END",
    "{'y': CAST(-1 AS DOUBLE), 'n': CAST(-1 AS BIGINT), 'ids': CAST([] AS BIGINT[]), 'i': CAST([] AS INT[])}",
    "SELECT doc_id, unnest(s.i) AS i, unnest(s.ids) AS cluster FROM r", "y, x, i",
    "{'y': y, 'n': CAST(0 AS BIGINT), 'ids': CAST([] AS BIGINT[]), 'i': [i]}"))
def _(spark, sf):
    df = T.lines(spark, sf).select("doc_id", "i", "y", "x")
    return C.anchored_cluster(df, D, [_y(), F.col("x"), F.col("i")], _y(), 8 / 512).select("doc_id", "i", "cluster")


@query("column_clusters", "W7", _fold_sql(
    "{'x': a.x, 's': CASE WHEN len(list_filter(a.s, lambda q: abs(q - b.x) < 0.15)) > 0 THEN a.s ELSE list_append(a.s, b.x) END,"
    " 'i': list_append(a.i, b.i[1]), 'p': list_append(a.p, b.x)}",
    "{'x': CAST(0 AS DOUBLE), 's': CAST([] AS DOUBLE[]), 'i': CAST([] AS INT[]), 'p': CAST([] AS DOUBLE[])}",
    ", u AS (SELECT doc_id, s.s AS seeds, unnest(s.i) AS i, unnest(s.p) AS p FROM r)"
    " SELECT doc_id, i, CAST(list_position(list_transform(seeds, lambda q: abs(q - p) < 0.15), true) - 1 AS BIGINT) AS col FROM u",
    "y, x, i", "{'x': x, 's': CAST([] AS DOUBLE[]), 'i': [i], 'p': CAST([] AS DOUBLE[])}"))
def _(spark, sf):
    df = T.lines(spark, sf).select("doc_id", "i", "y", "x")
    return C.column_clusters(df, D, [_y(), F.col("x"), F.col("i")], F.col("x"), 0.15, "col").select("doc_id", "i", "col")


@query("rule_positions", "W14", _fold_sql(
    "CASE WHEN len(a.m) > 0 AND b.p - a.m[-1] <= 2.0/512 THEN {'p': a.p, 'm': list_append(a.m[:-2], (a.m[-1] + b.p) / 2)}"
    " ELSE {'p': a.p, 'm': list_append(a.m, b.p)} END",
    "{'p': CAST(0 AS DOUBLE), 'm': CAST([] AS DOUBLE[])}",
    "SELECT doc_id, CAST(len(s.m) AS BIGINT) AS rules, round(s.m[1], 6) AS first_rule, round(s.m[-1], 6) AS last_rule FROM r",
    "y, i", "{'p': y, 'm': CAST([] AS DOUBLE[])}"))
def _(spark, sf):
    rules = C.running_average_rules(T.lines(spark, sf), D, [_y(), F.col("i")], _y(), F.col("x"), F.col("x") + F.col("w"), 2 / 512)
    return rules.groupBy("doc_id").agg(
        F.count("*").alias("rules"), F.round(F.min_by("position", "rule"), 6).alias("first_rule"),
        F.round(F.max_by("position", "rule"), 6).alias("last_rule"))


@query("rule_groups", "W16", _fold_sql(
    "CASE WHEN list_position(list_transform(a.t, lambda q: b.y - q.y <= 24.0/512 AND abs(b.x - q.x) <= 0.04), true) > 0"
    " THEN {'y': a.y, 'x': a.x, 'i': list_append(a.i, b.i[1]),"
    " 'g': list_append(a.g, list_position(list_transform(a.t, lambda q: b.y - q.y <= 24.0/512 AND abs(b.x - q.x) <= 0.04), true)),"
    " 't': list_transform(a.t, lambda q, n: CASE WHEN n = list_position(list_transform(a.t, lambda z: b.y - z.y <= 24.0/512 AND abs(b.x - z.x) <= 0.04), true)"
    " THEN {'y': b.y, 'x': b.x} ELSE q END)}"
    " ELSE {'y': a.y, 'x': a.x, 'i': list_append(a.i, b.i[1]), 'g': list_append(a.g, len(a.t) + 1), 't': list_append(a.t, {'y': b.y, 'x': b.x})} END",
    "{'y': CAST(0 AS DOUBLE), 'x': CAST(0 AS DOUBLE), 'i': CAST([] AS INT[]), 'g': CAST([] AS BIGINT[]), 't': CAST([] AS STRUCT(y DOUBLE, x DOUBLE)[])}",
    ", u AS (SELECT doc_id, unnest(s.i) AS i, unnest(s.g) - 1 AS rule_group FROM r),"
    " c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, rule_group) AS n FROM u)"
    " SELECT doc_id, i, CAST(rule_group AS BIGINT) AS rule_group FROM c WHERE n >= 3",
    "y, i", "{'y': y, 'x': x, 'i': [i], 'g': CAST([] AS BIGINT[]), 't': CAST([] AS STRUCT(y DOUBLE, x DOUBLE)[])}"))
def _(spark, sf):
    df = T.lines(spark, sf).select("doc_id", "i", "y", "x")
    return C.rule_groups(df, D, [_y(), F.col("i")], _y(), F.col("x"), 24 / 512).select("doc_id", "i", "rule_group")


@query("block_clusters", "W4", f"""{WITH_LINES},
g AS (SELECT doc_id, i, y, CASE WHEN y - lag(y) OVER (PARTITION BY doc_id ORDER BY y, i) > 6.0/512 THEN 1 ELSE 0 END AS f FROM ln)
SELECT doc_id, i, CAST(sum(f) OVER (PARTITION BY doc_id ORDER BY y, i) AS BIGINT) AS block FROM g""")
def _(spark, sf):
    return C.gap_cluster(T.lines(spark, sf), D, ["y", "i"], _y(), _y(), 6 / 512, "block").select("doc_id", "i", "block")


# dots: x on a fine grid (1/1024), two per line
DOTS = """dt AS (SELECT doc_id, 'd' || i AS id, CAST(len % 9 * 100 + len % 3 AS DOUBLE) / 1024 AS x, y FROM ln)"""


def _dots(spark, sf):
    n = F.col("len")
    return T.lines(spark, sf).select("doc_id", F.concat(F.lit("d"), F.col("i").cast("string")).alias("id"),
                                     ((n % 9) * 100 + n % 3).__truediv__(1024.0).alias("x"), "y")


@query("dot_columns", "W8", f"""{WITH_LINES}, {DOTS},
g AS (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY doc_id ORDER BY x, y, id) > 0.003 THEN 1 ELSE 0 END AS f FROM dt),
c AS (SELECT *, sum(f) OVER (PARTITION BY doc_id ORDER BY x, y, id) AS col FROM g),
m AS (SELECT *, count(*) OVER w AS n, min(x) OVER w AS lo, max(x) OVER w AS hi FROM c WINDOW w AS (PARTITION BY doc_id, col))
SELECT doc_id, id, CAST(col AS BIGINT) AS col, lo + (hi - lo) / 2 AS column_x FROM m
WHERE n >= 2 AND hi - lo <= 0.003 AND lo + (hi - lo) / 2 BETWEEN 0.08 AND 0.92""")
def _(spark, sf):
    return C.dot_columns(_dots(spark, sf), D).select("doc_id", "id", F.col("column").alias("col"), "column_x")


@query("row_split", "W9 A11", f"""{WITH_LINES},
g AS (SELECT doc_id, i, y, y - lag(y) OVER (PARTITION BY doc_id ORDER BY y, i) AS gap FROM ln),
m AS (SELECT doc_id, median(gap) FILTER (WHERE gap > 0) AS ref, count(*) AS n FROM g GROUP BY doc_id),
f AS (SELECT g.*, CASE WHEN n >= 3 AND ref IS NOT NULL AND gap >= greatest(1.8 * ref, 0.0078125) THEN 1 ELSE 0 END AS f
  FROM g JOIN m USING (doc_id))
SELECT doc_id, i, CAST(sum(f) OVER (PARTITION BY doc_id ORDER BY y, i) AS BIGINT) AS row_group FROM f""")
def _(spark, sf):
    return C.row_split(T.lines(spark, sf), D, "y", ["i"], min_gap=0.0078125).select("doc_id", "i", "row_group")


@query("stack_clusters", "W10", f"""{WITH_LINES},
p AS (SELECT *, lag(x) OVER o AS px, lag(w) OVER o AS pw FROM ln WINDOW o AS (PARTITION BY doc_id ORDER BY x, y, i)),
f AS (SELECT *, CASE WHEN px IS NOT NULL AND greatest(0, least(px + pw, x + w) - greatest(px, x)) < 0.5 * least(pw, w)
  THEN 1 ELSE 0 END AS f FROM p),
c AS (SELECT *, sum(f) OVER (PARTITION BY doc_id ORDER BY x, y, i) AS sc FROM f),
g AS (SELECT *, CASE WHEN y - lag(y + h) OVER (PARTITION BY doc_id, sc ORDER BY y, x, i) > 0.025 THEN 1 ELSE 0 END AS gf FROM c)
SELECT doc_id, i, CAST(sc AS BIGINT) AS stack_column,
 CAST(sum(gf) OVER (PARTITION BY doc_id, sc ORDER BY y, x, i) AS BIGINT) AS stack FROM g""")
def _(spark, sf):
    df = T.lines(spark, sf).select("doc_id", "i", "x", "y", F.col("w").alias("width"), F.col("h").alias("height"), F.col("i").alias("id"))
    return C.stack_cluster(df, D).select("doc_id", "i", "stack_column", "stack")


@query("proportional_borders", "W12 C8", """WITH p AS (SELECT item_id, list_filter(list_transform(string_split(text, ' '), lambda s: trim(s)), lambda s: s <> '') AS f FROM benchmark),
u AS (SELECT item_id, unnest(f) AS frag, generate_subscripts(f, 1) AS n FROM p),
c AS (SELECT item_id, n, sum(length(frag)) OVER (PARTITION BY item_id ORDER BY n) AS cum,
  sum(length(frag)) OVER (PARTITION BY item_id) AS tot, count(*) OVER (PARTITION BY item_id) AS k FROM u)
SELECT item_id, CAST(n AS INT) AS n, round(100 + CAST(cum AS DOUBLE) / tot * 800, 6) AS border FROM c WHERE n < k""")
def _(spark, sf):
    b = T.table(spark, sf, "benchmark").withColumn("f", F.filter(F.split("text", " "), lambda s: F.trim(s) != ""))
    borders = C.proportional_boundaries(F.transform("f", F.trim), F.lit(100.0), F.lit(900.0))
    return b.select("item_id", F.posexplode(borders).alias("n", "v")).select(
        "item_id", (F.col("n") + 1).alias("n"), F.round("v", 6).alias("border"))


@query("line_groups", "W6 A2", """WITH g AS (SELECT conv_id, turn, role, text,
  CASE WHEN role <> lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END AS f FROM conversations),
c AS (SELECT *, sum(f) OVER (PARTITION BY conv_id ORDER BY turn) AS grp FROM g)
SELECT conv_id, CAST(grp AS BIGINT) AS grp, min(turn) AS first_turn, string_agg(role, ' ' ORDER BY turn) AS roles,
 CAST(sum(length(text)) AS BIGINT) AS chars FROM c GROUP BY conv_id, grp""")
def _(spark, sf):
    # a conversation is a log: chunks of 1024 turns keep a very long one out of a single task
    chunk = F.floor(F.col("turn") / 1024)
    df = running_groups(T.table(spark, sf, "conversations"), ["conv_id"], ["turn"], F.col("role"), "grp", chunk)
    # long groups are joined in two steps, so no task holds a whole conversation's rows at once
    part = df.groupBy("conv_id", CHUNK, "grp").agg(
        F.min("turn").alias("t"), F.array_join(F.array_sort(F.collect_list(F.struct("turn", "role")))["role"], " ").alias("roles"),
        F.sum(F.length("text")).alias("chars"))
    return part.groupBy("conv_id", "grp").agg(
        F.min("t").alias("first_turn"), F.array_join(F.array_sort(F.collect_list(F.struct(CHUNK, "roles")))["roles"], " ").alias("roles"),
        F.sum("chars").alias("chars"))


@query("kind_ordinals", "W17", f"""{WITH_LINES},
o AS (SELECT doc_id, i, len % 3 AS kind, row_number() OVER (PARTITION BY doc_id, len % 3 ORDER BY y, x, i) - 1 AS ordinal FROM ln)
SELECT l.doc_id, l.i, CAST(coalesce(o.ordinal, -1) AS BIGINT) AS ordinal FROM ln l
LEFT JOIN o ON o.doc_id = l.doc_id AND o.i = l.i + 1 AND o.kind = l.len % 3""")
def _(spark, sf):
    df = T.lines(spark, sf).withColumn("kind", F.col("len") % 3)
    ranked = C.reading_order(df, ["doc_id", "kind"], ["y", "x", "i"], "ordinal").withColumn("ordinal", F.col("ordinal") - 1).withColumn(
        "id", F.col("i"))
    ask = df.select("doc_id", "kind", "i", (F.col("i") + 1).alias("id"))
    return C.kind_ordinal(ranked, ask, D).select("doc_id", "i", "ordinal")


# ---- geometry ------------------------------------------------------------------

@query("normalized_boxes", "X1 X2 X3", f"""{WITH_LINES},
b AS (SELECT doc_id, i, CAST(len - 40 AS DOUBLE) AS l, CAST(i * 4 AS DOUBLE) AS t, CAST(len + 300 AS DOUBLE) AS r, CAST(i * 4 + 9 AS DOUBLE) AS bt FROM ln),
c AS (SELECT doc_id, i, least(greatest(l, 0), 512) AS l, least(greatest(t, 0), 256) AS t, r, bt FROM b),
d AS (SELECT doc_id, i, l, t, greatest(l, least(512, r)) AS r, greatest(t, least(256, bt)) AS bt FROM c),
n AS (SELECT doc_id, i, l / 512 AS x, t / 256 AS y, (r - l) / 512 AS w, (bt - t) / 256 AS h FROM d)
SELECT doc_id, i, x, y, w, h, CAST(round_even(x * 100, 0) AS BIGINT) AS px_left, CAST(floor((x + w) * 100 + 0.5) AS BIGINT) AS px_right,
 x * 640 AS view_left FROM n""")
def _(spark, sf):
    n, i = F.col("len"), F.col("i")
    b = T.lines(spark, sf).withColumn("bbox", G.bbox_normalize(n - 40, i * 4, n + 300, i * 4 + 9, F.lit(512), F.lit(256)))
    px = G.bbox_denormalize(F.col("bbox"), F.lit(100), F.lit(100))
    up = G.bbox_denormalize(F.col("bbox"), F.lit(100), F.lit(100), "half_up")
    return T.flat(b.withColumn("px_left", px["left"]).withColumn("px_right", up["right"]).withColumn(
        "view_left", G.bbox_to_viewport(F.col("bbox"), F.lit(640), F.lit(480))["left"]),
        "doc_id", "i", "px_left", "px_right", "view_left")


@query("client_boxes", "X1b", f"""{WITH_LINES},
b AS (SELECT doc_id, i, CASE WHEN len % 4 = 0 THEN 1 ELSE 512 END AS ww, CAST(len - 40 AS DOUBLE) AS l, CAST(i * 4 AS DOUBLE) AS t FROM ln)
SELECT doc_id, i, round(greatest(0, least(1, l / ww)), 6) AS x, round(greatest(0, least(1, t / 256)), 6) AS y,
 round(greatest(0, least(1, CAST(340 AS DOUBLE) / ww)), 6) AS w, round(greatest(0, least(1, CAST(9 AS DOUBLE) / 256)), 6) AS h FROM b""")
def _(spark, sf):
    n, i = F.col("len"), F.col("i")
    width = F.when(n % 4 == 0, 0).otherwise(512)
    b = G.bbox_normalize_client(n - 40, i * 4, n + 300, i * 4 + 9, width, F.lit(256))
    return T.flat(T.lines(spark, sf).withColumn("bbox", b), "doc_id", "i")


@query("rotate_boxes", "X5", f"""{WITH_LINES}, a AS (SELECT *, (len % 5) * 90 % 360 AS ang FROM ln)
SELECT doc_id, i, CASE ang WHEN 90 THEN 1 - (y + h) WHEN 180 THEN 1 - (x + w) WHEN 270 THEN y ELSE x END AS x,
 CASE ang WHEN 90 THEN x WHEN 180 THEN 1 - (y + h) WHEN 270 THEN 1 - (x + w) ELSE y END AS y,
 CASE WHEN ang IN (90, 270) THEN h ELSE w END AS w, CASE WHEN ang IN (90, 270) THEN w ELSE h END AS h FROM a""")
def _(spark, sf):
    s = T.spans(spark, sf)
    angle = G.normalize_rotation(F.col("len") % 5 * 90 - 360)
    return T.flat(s.withColumn("bbox", G.bbox_rotate(F.col("bbox"), angle)).withColumnRenamed("idx", "i"), "doc_id", "i")


@query("union_boxes", "X4", f"""{WITH_LINES}
SELECT doc_id, len % 4 AS grp, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM ln GROUP BY 1, 2""")
def _(spark, sf):
    s = T.spans(spark, sf).withColumn("grp", F.col("len") % 4)
    return T.flat(A.union_boxes(s, ["doc_id", "grp"]), "doc_id", "grp")


@query("candidate_scores", "X10", f"""{WITH_LINES}
SELECT doc_id, i, round_even(0.45 * least(w / 0.12, 1) + 0.30 * least((w / h) / 30, 1) + 0.25 * least((len % 4) / 2.0, 1), 4) AS blank_score,
 round_even(0.45 * least((len % 6) / 2.0, 1) + 0.35 * least(w / 0.60, 1) + 0.20 * (len % 2), 4) AS free_text_score FROM ln""")
def _(spark, sf):
    n = F.col("len")
    return T.lines(spark, sf).select(
        "doc_id", "i", G.candidate_score("blank", width=F.col("w"), aspect=F.col("w") / F.col("h"), evidence=n % 4).alias("blank_score"),
        G.candidate_score("free-text", lines=n % 6, width=F.col("w"), prompt=n % 2).alias("free_text_score"))


@query("matching_endpoints", "X11", f"""{WITH_LINES}
SELECT doc_id, i, CASE WHEN len % 3 = 0 THEN x + w / 4 WHEN len % 2 = 0 THEN x + w ELSE x END AS ex,
 CASE WHEN len % 3 = 0 THEN y + h / 4 ELSE y + h / 2 END AS ey FROM ln""")
def _(spark, sf):
    b = F.col("bbox")
    anchor = F.when(F.col("len") % 3 == 0, G.box(b["x"], b["y"], b["width"] / 2, b["height"] / 2))
    end = G.matching_endpoint(b, anchor, F.when(F.col("len") % 2 == 0, "left").otherwise("right"))
    return T.spans(spark, sf).select("doc_id", F.col("idx").alias("i"), end["x"].alias("ex"), end["y"].alias("ey"))


@query("valid_selections", "F5", """SELECT l_orderkey, l_linenumber, l_quantity,
 (l_quantity - 2 >= 0 AND l_quantity - 10 > 0 AND (l_quantity - 2) / 64 + (l_quantity - 10) / 64 <= 1) AS valid FROM lineitem""")
def _(spark, sf):
    q = F.col("l_quantity")
    b = G.box((q - 2) / 64.0, (q - 2) / 64.0, (q - 10) / 64.0, (q - 10) / 64.0)
    return T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", G.valid_selection(b).alias("valid"))


@query("gated_candidates", "F4", f"""{WITH_LINES}
SELECT doc_id, i FROM ln WHERE (len % 2 = 0 AND w BETWEEN 0.02 AND 0.45 AND h <= 0.012 AND w / h >= 8)
 OR (len % 2 = 1 AND w BETWEEN 0.30 AND 0.97 AND h <= 0.012 AND w / h >= 20)""")
def _(spark, sf):
    df = T.lines(spark, sf).withColumn("family", F.when(F.col("len") % 2 == 0, "blank-line").otherwise("free-text-line"))
    # measures of other families are null here
    df = df.withColumnsRenamed({"w": "width", "h": "height"}).withColumn("aspect", F.col("width") / F.col("height")).withColumn(
        "diameter", F.lit(None).cast("double")).withColumn("extent", F.lit(None).cast("double"))
    return J.gate_candidates(df).select("doc_id", "i")


@query("span_tests", "F1 F2 F3", f"""{WITH_SPANS}
SELECT doc_id, idx, confidence >= 0.55 AND length(trim(text)) > 1 AND regexp_matches(text, '[A-Za-z]') AS meaningful,
 confidence >= 0.5 AS confident, regexp_full_match(trim(text), '[0-9]{{1,2}}') AND w <= 0.04 AS digit FROM sp""")
def _(spark, sf):
    return T.spans(spark, sf).select(
        "doc_id", "idx", X.meaningful_span(F.col("text"), F.col("confidence")).alias("meaningful"),
        X.confident(F.col("confidence")).alias("confident"), X.digit_span(F.col("text"), F.col("bbox.width")).alias("digit"))


# ---- spatial joins -------------------------------------------------------------

BOXED = f"{WITH_SPANS}, {T.boxes_sql()}"


@query("proximity_pairs", "J3 X9", f"""{BOXED}
SELECT b.doc_id, b.id AS box_id, s.id AS span_id FROM bx b JOIN sp s ON s.doc_id = b.doc_id
 AND abs(s.y + s.h / 2 - (b.y + b.h / 2)) <= greatest(s.h * 1.5, 0.006)
 AND greatest(s.x - (b.x + b.w), b.x - (s.x + s.w), 0) <= 0.0625""")
def _(spark, sf):
    pairs = J.proximity_join(T.boxes(spark, sf), T.spans(spark, sf), D, max_x_gap=0.0625)
    return pairs.select(F.col("l.doc_id").alias("doc_id"), F.col("l.id").alias("box_id"), F.col("r.id").alias("span_id"))


@query("near_heights", "X12 A11 J3", f"""{BOXED},
p AS (SELECT b.doc_id, b.id, s.h FROM bx b JOIN sp s ON s.doc_id = b.doc_id
 AND abs(s.y + s.h / 2 - (b.y + b.h / 2)) <= greatest(s.h * 1.5, 0.006)
 AND greatest(s.x - (b.x + b.w), b.x - (s.x + s.w), 0) <= 0.0625),
m AS (SELECT doc_id, id, median(h) AS med, count(*) AS n FROM p GROUP BY 1, 2)
SELECT b.doc_id, b.id, m.med AS median_height, CAST(coalesce(m.n, 0) AS BIGINT) AS near_count FROM bx b LEFT JOIN m USING (doc_id, id)""")
def _(spark, sf):
    return A.median_near_height(T.boxes(spark, sf), T.spans(spark, sf), D, max_x_gap=0.0625).select(
        "doc_id", "id", "median_height", F.coalesce("near_count", F.lit(0)).alias("near_count"))


@query("prompts_above", "J4", f"""{BOXED}
SELECT b.doc_id, b.id AS box_id, s.id AS span_id FROM bx b JOIN sp s ON s.doc_id = b.doc_id AND s.confidence >= 0.5 AND s.h >= 1.0/512
 AND s.x + s.w / 2 BETWEEN b.x - 0.0625 AND b.x + b.w + 0.0625 AND s.y + s.h <= b.y AND b.y - s.y <= 0.03125""")
def _(spark, sf):
    pairs = J.prompt_above_join(T.boxes(spark, sf), T.spans(spark, sf), D, 0.0625, 0.03125, 1 / 512)
    return pairs.select(F.col("l.doc_id").alias("doc_id"), F.col("l.id").alias("box_id"), F.col("r.id").alias("span_id"))


@query("cell_prompts", "J5", f"""{BOXED},
p AS (SELECT b.doc_id, b.id, s.id AS span_id, row_number() OVER (PARTITION BY b.doc_id, b.id ORDER BY s.w DESC, s.idx) AS rn
 FROM bx b JOIN sp s ON s.doc_id = b.doc_id AND s.x + s.w / 2 BETWEEN b.x AND b.x + b.w
 AND s.y + s.h / 2 BETWEEN b.y - 0.015625 AND b.y + b.h + 0.015625)
SELECT doc_id, id, span_id FROM p WHERE rn = 1""")
def _(spark, sf):
    b = F.col("bbox")
    cells = T.boxes(spark, sf).select("doc_id", "id", b["x"].alias("x0"), G.right(b).alias("x1"), b["y"].alias("y0"), G.bottom(b).alias("y1"))
    return J.prompt_cell_join(cells, T.spans(spark, sf), D, 0.015625).select("doc_id", "id", "span_id")


@query("header_labels", "J5", f"""{BOXED},
p AS (SELECT b.doc_id, b.id, s.id AS span_id, row_number() OVER (PARTITION BY b.doc_id, b.id
  ORDER BY abs(s.x + s.w / 2 - (b.x + (b.x + b.w)) / 2), s.idx) AS rn
 FROM bx b JOIN sp s ON s.doc_id = b.doc_id AND s.y + s.h < b.y AND b.y - (s.y + s.h) <= 0.0625
 AND s.y + s.h <= b.y + 0.006 AND s.w <= 0.125 AND s.x + s.w / 2 BETWEEN b.x AND b.x + b.w)
SELECT doc_id, id, span_id FROM p WHERE rn = 1""")
def _(spark, sf):
    b = F.col("bbox")
    cols = T.boxes(spark, sf).select("doc_id", "id", b["x"].alias("x0"), G.right(b).alias("x1"), b["y"].alias("first_rule_y"),
                                     b["y"].alias("cells_top"))
    return J.header_label_join(cols, T.spans(spark, sf), D, 0.0625, 0.006, 0.125).select("doc_id", "id", "span_id")


@query("legends", "J6", f"""{WITH_LINES},
lg AS (SELECT doc_id, i, y, h, CAST(len % 4 AS VARCHAR) AS digit FROM ln WHERE len % 2 = 0),
bl AS (SELECT doc_id, i AS block, y AS first_y FROM ln WHERE len % 5 = 0),
p AS (SELECT b.doc_id, b.block, l.i, l.y, l.digit FROM bl b JOIN lg l ON l.doc_id = b.doc_id AND l.y + l.h < b.first_y
  AND b.first_y - (l.y + l.h) <= 0.0625),
g AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY doc_id, block ORDER BY y, i) > 8.0/512 THEN 1 ELSE 0 END AS f FROM p),
c AS (SELECT *, sum(f) OVER (PARTITION BY doc_id, block ORDER BY y, i) AS cl FROM g),
s AS (SELECT doc_id, block, cl, list(DISTINCT digit ORDER BY digit) AS digits FROM c GROUP BY 1, 2, 3 HAVING count(DISTINCT digit) >= 2)
SELECT doc_id, block, array_to_string(arg_max(digits, cl), ',') AS digits FROM s GROUP BY 1, 2""")
def _(spark, sf):
    s = T.spans(spark, sf)
    legend = s.where("len % 2 = 0").withColumn("text", F.concat((F.col("len") % 4).cast("string"), F.lit(" = x")))
    blocks = s.where("len % 5 = 0").select("doc_id", F.col("idx").alias("block"), F.col("bbox.y").alias("first_y"))
    return J.legend_join(blocks, legend, D, 0.0625, 8 / 512).select("doc_id", "block", F.array_join("digits", ",").alias("digits"))


@query("row_bands", "J7", f"""{WITH_SPANS},
r AS (SELECT doc_id, idx, y FROM sp WHERE len % 3 = 0),
n AS (SELECT *, lag(y) OVER w AS py, lead(y) OVER w AS ny FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY y, idx)),
m AS (SELECT doc_id, coalesce(median(y - py) FILTER (WHERE y - py > 0), 0) AS ref FROM n GROUP BY doc_id),
b AS (SELECT n.doc_id, idx, coalesce(py + (y - py) / 2, y - ref / 2) AS bt, coalesce(ny - (ny - y) / 2, y + ref / 2) AS bb
 FROM n JOIN m USING (doc_id))
SELECT b.doc_id, b.idx, s.id AS span_id, CASE WHEN s.x + s.w / 2 < 0.25 THEN 'left' ELSE 'right' END AS side
FROM b JOIN sp s ON s.doc_id = b.doc_id AND s.confidence >= 0.5 AND s.y + s.h / 2 BETWEEN bt AND bb
 AND (s.x + s.w / 2 < 0.25 OR s.x + s.w / 2 > 0.375)""")
def _(spark, sf):
    s = T.spans(spark, sf)
    rows = s.where("len % 3 = 0").select("doc_id", "idx", F.col("bbox.y").alias("y")).withColumn("x_left", F.lit(0.25)).withColumn(
        "x_right", F.lit(0.375))
    pairs = J.row_band_join(J.row_bands(rows, D, "y", ["y", "idx"]), s, D)
    return pairs.select(F.col("l.doc_id").alias("doc_id"), F.col("l.idx").alias("idx"), F.col("r.id").alias("span_id"), "side")


@query("owned_spans", "J13", f"""{WITH_SPANS},
sel AS (SELECT doc_id, min(y) AS t, max(y + h) AS b FROM sp WHERE len % 7 = 0 GROUP BY doc_id)
SELECT s.doc_id, s.id FROM sp s WHERE s.len % 7 = 0
UNION ALL SELECT s.doc_id, s.id FROM sp s JOIN sel ON sel.doc_id = s.doc_id AND s.len % 7 <> 0 AND s.len % 3 <> 0
 AND s.y + s.h / 2 >= sel.t - 0.00390625 AND s.y + s.h / 2 <= sel.b + 0.00390625""")
def _(spark, sf):
    s = T.spans(spark, sf)
    mine = s.where("len % 7 = 0").withColumn("span_id", F.col("id"))
    owners = s.where("len % 7 = 0 OR len % 3 = 0").withColumn("span_id", F.col("id"))
    b = F.col("bbox")
    ranges = mine.groupBy("doc_id").agg(F.min(G.top(b)).alias("top"), F.max(G.bottom(b)).alias("bottom"))
    return J.owned_spans(s, owners, mine, ranges, D, 0.00390625).select("doc_id", "id")


@query("region_select", "J14 X8", f"""{BOXED},
e AS (SELECT doc_id, id, x, y - 0.015625 AS y, w, CAST(0.03125 AS DOUBLE) AS h FROM bx),
r AS (SELECT doc_id, id, x, y, w, h * 4 AS h FROM sp WHERE len % 4 = 0)
SELECT e.doc_id, e.id AS exercise_id, r.id AS selection_id FROM e JOIN r USING (doc_id) WHERE
 (r.x + r.w / 2 BETWEEN e.x AND e.x + e.w AND r.y + r.h / 2 BETWEEN e.y AND e.y + e.h)
 OR (e.x + e.w / 2 BETWEEN r.x AND r.x + r.w AND e.y + e.h / 2 BETWEEN r.y AND r.y + r.h)""")
def _(spark, sf):
    b = F.col("bbox")
    e = T.boxes(spark, sf).withColumn("bbox", G.box(b["x"], b["y"] - 0.015625, b["width"], 0.03125))
    r = T.spans(spark, sf).where("len % 4 = 0").withColumn("bbox", G.box(b["x"], b["y"], b["width"], b["height"] * 4))
    return J.region_select(e, r, D).select(F.col("l.doc_id").alias("doc_id"), F.col("l.id").alias("exercise_id"),
                                           F.col("r.id").alias("selection_id"))


@query("intersecting_boxes", "X7", f"""{BOXED}
SELECT s.doc_id, s.id AS span_id, b.id AS box_id FROM sp s JOIN bx b USING (doc_id)
WHERE s.x < b.x + b.w + 0.00390625 AND s.x + s.w > b.x - 0.00390625 AND s.y < b.y + b.h + 0.00390625 AND s.y + s.h > b.y - 0.00390625""")
def _(spark, sf):
    return J.intersecting(T.spans(spark, sf), T.boxes(spark, sf), D, 0.00390625).select(
        F.col("l.doc_id").alias("doc_id"), F.col("l.id").alias("span_id"), F.col("r.id").alias("box_id"))


@query("context_spans", "J15", f"""{BOXED}
SELECT s.doc_id, s.id FROM sp s WHERE s.len % 5 <> 0 AND NOT EXISTS (SELECT 1 FROM bx b WHERE b.doc_id = s.doc_id
 AND s.y + s.h / 2 >= b.y - 0.0078125 AND s.y + s.h / 2 <= b.y + b.h + 0.0078125)""")
def _(spark, sf):
    s = T.spans(spark, sf)
    used = s.where("len % 5 = 0").withColumn("span_id", F.col("id"))
    return J.context_anti_join(s, used, T.boxes(spark, sf), D, 0.0078125).select("doc_id", "id")


@query("iou_suppress", "J16 X6", f"""{BOXED},
cl AS (SELECT doc_id, x + CAST(i % 4 AS DOUBLE) / 16 AS x, y + CAST(i % 3 AS DOUBLE) / 1024 AS y, w, h FROM bx),
m AS (SELECT b.doc_id, b.id FROM bx b JOIN cl c ON c.doc_id = b.doc_id,
 LATERAL (SELECT greatest(0, least(b.x + b.w, c.x + c.w) - greatest(b.x, c.x)) * greatest(0, least(b.y + b.h, c.y + c.h) - greatest(b.y, c.y)) AS inter) t
 WHERE inter / (b.w * b.h + c.w * c.h - inter) >= 0.5)
SELECT doc_id, id FROM bx WHERE (doc_id, id) NOT IN (SELECT (doc_id, id) FROM m)""")
def _(spark, sf):
    bx, b, i = T.boxes(spark, sf), F.col("bbox"), F.col("i")
    claimed = bx.withColumn("bbox", G.box(b["x"] + i % 4 / 16.0, b["y"] + i % 3 / 1024.0, b["width"], b["height"]))
    return J.iou_suppress(bx, claimed, D, 0.5).select("doc_id", "id")


@query("text_context", "J24", f"""{BOXED},
p AS (SELECT b.doc_id, b.id, b.w, s.x + s.w <= b.x AS l, s.x >= b.x + b.w AS r,
  b.w < 0.065 AND greatest(0, least(b.x + b.w, s.x + s.w) - greatest(b.x, s.x)) / least(b.w, s.w) > 0.35
   AND abs(b.y + b.h / 2 - (s.y + s.h / 2)) <= s.h * 1.2 AS o
 FROM nb b JOIN sp s ON s.doc_id = b.doc_id AND abs(s.y + s.h / 2 - (b.y + b.h / 2)) <= greatest(s.h * 1.5, 0.006)
 AND greatest(s.x - (b.x + b.w), b.x - (s.x + s.w), 0) <= 0.06),
a AS (SELECT doc_id, id, bool_or(l) AS hl, bool_or(r) AS hr, bool_or(o) AS ot FROM p GROUP BY 1, 2)
SELECT b.doc_id, b.id, CASE WHEN a.id IS NULL THEN false WHEN hl AND hr AND (NOT ot OR w < 0.04) THEN true WHEN ot THEN false
 ELSE w >= 0.065 OR (w >= 0.05 AND (hl OR hr)) END AS accepted FROM nb b LEFT JOIN a USING (doc_id, id)""".replace(
    "\np AS", "\nnb AS (SELECT doc_id, id, x, y, w / 4 AS w, h FROM bx),\np AS"))
def _(spark, sf):
    b = F.col("bbox")
    narrow = T.boxes(spark, sf).withColumn("bbox", G.box(b["x"], b["y"], b["width"] / 4, b["height"]))
    return J.text_context_gate(narrow, T.spans(spark, sf), D).select("doc_id", "id", "accepted")


@query("parallel_lines", "J25", f"""{BOXED}
SELECT DISTINCT a.doc_id, a.id FROM bx a JOIN bx b ON b.doc_id = a.doc_id AND (a.x <> b.x OR a.y <> b.y) AND abs(a.y - b.y) <= 0.015625
 AND greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) >= 0.6 * least(a.w, b.w)""")
def _(spark, sf):
    return J.parallel_line_semi(T.boxes(spark, sf), D, 0.015625).select("doc_id", "id")


@query("strip_gaps", "J25", f"""{BOXED},
st AS (SELECT doc_id, x, y, w / 8 AS w, h * 8 AS h FROM sp WHERE len % 4 = 1),
g AS (SELECT b.doc_id, b.id, min(least(abs(s.x - b.x), abs(s.x + s.w - (b.x + b.w)))) AS gap FROM bx b JOIN st s ON s.doc_id = b.doc_id
 AND greatest(s.y, b.y) < least(s.y + s.h, b.y + b.h + 0.0078125) GROUP BY 1, 2),
c AS (SELECT DISTINCT b.doc_id, b.id FROM bx b JOIN st s ON s.doc_id = b.doc_id AND greatest(s.x, b.x) < least(s.x + s.w, b.x + b.w)
 AND greatest(s.y, b.y) < least(s.y + s.h, b.y + b.h))
SELECT b.doc_id, b.id, g.gap AS strip_gap, c.id IS NOT NULL AS crossed FROM bx b LEFT JOIN g USING (doc_id, id) LEFT JOIN c USING (doc_id, id)""")
def _(spark, sf):
    b = F.col("bbox")
    lines = T.boxes(spark, sf)
    strips = T.spans(spark, sf).where("len % 4 = 1").withColumn("bbox", G.box(b["x"], b["y"], b["width"] / 8, b["height"] * 8))
    crossed = J.strip_cross(lines, strips, D).select("doc_id", "id", F.lit(True).alias("crossed"))
    return J.strip_nearest(lines, strips, D, 0.0078125).join(crossed, ["doc_id", "id"], "left").select(
        "doc_id", "id", "strip_gap", F.coalesce("crossed", F.lit(False)).alias("crossed"))


@query("paired_rows", "J8", f"""{WITH_LINES},
l AS (SELECT doc_id, list({{'y': y, 'i': i}} ORDER BY y, i) AS ls FROM ln WHERE len % 2 = 0 GROUP BY doc_id),
r AS (SELECT doc_id, list({{'y': y, 'i': i}} ORDER BY y, i) AS rs FROM ln WHERE len % 2 = 1 GROUP BY doc_id),
b AS (SELECT doc_id, list_prepend({{'y': CAST(0 AS DOUBLE), 'i': -1, 'u': CAST([] AS INT[]), 'm': CAST([] AS INT[])}},
  list_transform(ls, lambda q: {{'y': q.y, 'i': q.i, 'u': CAST([] AS INT[]), 'm': CAST([] AS INT[])}})) AS ls, rs FROM l JOIN r USING (doc_id)),
f AS (SELECT doc_id, rs, list_reduce(ls, lambda a, q: {{'y': a.y, 'i': a.i, 'm': list_append(a.m, q.i),
  'u': list_append(a.u, coalesce(list_sort(list_transform(list_filter(rs, lambda z: abs(q.y - z.y) <= 4.0/512 AND NOT list_contains(a.u, z.i)),
    lambda z: {{'g': abs(q.y - z.y), 'y': z.y, 'i': z.i}}))[1].i, -1))}}) AS s FROM b)
SELECT doc_id, CAST(len(s.m) AS BIGINT) AS lefts, CAST(len(list_filter(s.u, lambda u: u >= 0)) AS BIGINT) AS paired,
 CAST(len(rs) - len(list_filter(s.u, lambda u: u >= 0)) AS BIGINT) AS right_only, array_to_string(s.u, ',') AS partners FROM f""")
def _(spark, sf):
    df = T.lines(spark, sf)
    dot = F.struct("y", F.col("i").alias("id"))
    page = df.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("len") % 2 == 0, dot))).alias("l"),
                                    F.array_sort(F.collect_list(F.when(F.col("len") % 2 == 1, dot))).alias("r"))
    page = page.where((F.size("l") > 0) & (F.size("r") > 0))
    typed = lambda c: F.transform(c, lambda d: F.struct(d["y"].alias("y"), d["id"].cast("string").alias("id")))
    rows = page.withColumn("rows", M.pair_rows(typed(F.col("l")), typed(F.col("r")), 4 / 512))
    lefts = F.filter("rows", lambda r: r["left_id"].isNotNull())
    # list partners in the order in which the left dots chose
    chosen = F.transform("l", lambda d: F.coalesce(F.get(F.filter(lefts, lambda r: r["left_id"] == d["id"].cast("string")), F.lit(0))["right_id"], F.lit("-1")))
    return rows.select(
        "doc_id", F.size("l").cast("long").alias("lefts"), F.size(F.filter(lefts, lambda r: r["right_id"].isNotNull())).cast("long").alias("paired"),
        F.size(F.filter("rows", lambda r: r["left_id"].isNull())).cast("long").alias("right_only"), F.array_join(chosen, ",").alias("partners"))


@query("writing_boxes", "X12", f"""WITH {T.LINES}, {T.boxes_sql()}, m AS (SELECT *, x * 1024 AS px, y * 2048 AS py, w * 1024 AS pw, h * 2048 AS ph, CASE WHEN len % 4 <> 0 THEN CAST(8 + len % 5 AS DOUBLE) END AS t FROM bx),
e AS (SELECT *, 1.25::DOUBLE * coalesce(t, 8) AS lh, greatest(greatest(pw, ph), coalesce(t, greatest(pw, ph))) * 1.6::DOUBLE AS size FROM m),
k AS (SELECT *, py + ph / 2 - lh * 0.82::DOUBLE AS lt, px + pw / 2 - size / 2 AS rl, py + ph / 2 - size / 2 AS rt, px + pw / 2 + size / 2 AS rr, py + ph / 2 + size / 2 AS rb FROM e),
c AS (SELECT *, least(greatest(px, 0), 1024) AS l1, least(greatest(lt, 0), 2048) AS t1, least(greatest(rl, 0), 1024) AS l2, least(greatest(rt, 0), 2048) AS t2 FROM k)
SELECT doc_id, id, round(l1 / 1024, 9) AS line_x, round(t1 / 2048, 9) AS line_y, round((greatest(l1, least(1024, px + pw)) - l1) / 1024, 9) AS line_w, round((greatest(t1, least(2048, lt + lh)) - t1) / 2048, 9) AS line_h,
 round(l2 / 1024, 9) AS ring_x, round(t2 / 2048, 9) AS ring_y, round((greatest(l2, least(1024, rr)) - l2) / 1024, 9) AS ring_w, round((greatest(t2, least(2048, rb)) - t2) / 2048, 9) AS ring_h,
 CASE WHEN t IS NULL THEN 0.0 ELSE round(greatest(pw, ph) / greatest(t, 1), 9) END AS relative FROM c""")
def _(spark, sf):
    """Boxes to write in over lines and around rings, from pixel boxes and the text height beside them."""
    b, n = F.col("bbox"), F.col("len")
    px = {"x": b["x"] * 1024, "y": b["y"] * 2048, "w": b["width"] * 1024, "h": b["height"] * 2048}
    d = T.boxes(spark, sf).select("doc_id", "id", *[v.alias(k) for k, v in px.items()], F.when(n % 4 != 0, (8 + n % 5).cast("double")).alias("t"))
    sides = [F.col(c) for c in "xywh"]
    d = d.select("doc_id", "id", G.line_interaction_bbox(*sides, F.coalesce("t", F.lit(8.0)), F.lit(1024), F.lit(2048)).alias("line"),
                 G.ring_interaction_bbox(*sides, F.col("t"), F.lit(1024), F.lit(2048)).alias("ring"),
                 F.round(G.text_relative_diameter(F.col("w"), F.col("h"), F.col("t")), 9).alias("relative"))
    part = {"x": "x", "y": "y", "w": "width", "h": "height"}
    return d.select("doc_id", "id", *[F.round(F.col(f"{o}.{f}"), 9).alias(f"{o}_{k}") for o in ("line", "ring") for k, f in part.items()], "relative")
