"""Matching exercises from anchor dots and text spans.

Dots and spans meet in the page's row; column pairs and row groups are then rows
of their own, each with what it needs, so no join follows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafgrade.functions import geometry as G
from leafgrade.functions import textops as X
from leafgrade.functions.arrays import bind, let, settle, sort_by
from leafgrade.operators.cluster import PAGE

PAIR_TOLERANCE = 0.0015
_ROW = "struct<y:double,left_id:string,right_id:string,left_at:int,right_at:int>"


def pair_rows(left: Column, right: Column, tolerance: float = PAIR_TOLERANCE) -> Column:
    """Rows from two dot columns (arrays of {y, id}): one-to-one, nearest free right dot within the tolerance.

    Left dots choose in y order; unpaired dots of both sides stay as rows of
    their own. The array holds {y, left_id, right_id, left_at, right_at} in y
    order, the last two being places in the columns sorted by y. Dots that are
    further apart than the tolerance do not compete, so both columns are cut
    into chains and left dots look for a partner in their own chain only.
    """
    none = F.lit(None)

    def row(y: Column, l: Column | None, r: Column | None) -> Column:
        part = lambda d, name: none if d is None else d[name]
        return F.struct(y.alias("y"), part(l, "id").alias("left_id"), part(r, "id").alias("right_id"), part(l, "at").alias("left_at"), part(r, "at").alias("right_at")).cast(_ROW)

    def choose(chain: Column) -> Column:
        def settle_dot(acc: Column, d: Column, best: Column) -> Column:
            used = F.when(best.isNotNull(), F.concat(acc["used"], F.array(best["d"]["at"]))).otherwise(acc["used"])
            made = F.when(best.isNotNull(), row((d["y"] + best["d"]["y"]) / 2, d, best["d"])).otherwise(row(d["y"], d, None))
            return F.struct(used.alias("used"), F.concat(acc["rows"], F.array(made)).alias("rows"))

        def walk(ls: Column, rs: Column) -> Column:
            def step(acc: Column, d: Column) -> Column:
                near = F.transform(rs, lambda r: F.struct(F.abs(d["y"] - r["y"]).alias("gap"), r["at"].alias("at"), r.alias("d")))
                best = F.array_min(F.filter(near, lambda n: (n["gap"] <= tolerance) & ~F.array_contains(acc["used"], n["at"])))
                return let(lambda b: settle_dot(acc, d, b), best)

            start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast(f"array<{_ROW}>").alias("rows"))
            alone = lambda acc: F.transform(F.filter(rs, lambda r: ~F.array_contains(acc["used"], r["at"])), lambda r: row(r["y"], None, r))
            return F.aggregate(ls, start, step, lambda acc: sort_by(F.concat(acc["rows"], alone(acc)), lambda r: r["y"]))

        single = F.transform(chain, lambda d: F.when(d["side"] == 0, row(d["y"], d, None)).otherwise(row(d["y"], None, d)))
        a, b = F.get(chain, F.lit(0)), F.get(chain, F.lit(1))
        middle = (a["y"] + b["y"]) / 2
        couple = F.when(a["side"] == 0, row(middle, a, b)).otherwise(row(middle, b, a))
        return F.when(F.size(chain) == 1, single).when((F.size(chain) == 2) & (a["side"] != b["side"]), F.array(couple)).otherwise(
            let(walk, F.filter(chain, lambda d: d["side"] == 0), F.filter(chain, lambda d: d["side"] == 1)))

    def chains(dots: Column) -> Column:
        gap = lambda i: F.get(dots, i)["y"] - F.get(dots, i - 1)["y"]
        places = F.when(F.size(dots) > 0, F.sequence(F.lit(0), F.size(dots) - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(places, lambda i: (i == 0) | ~F.coalesce(gap(i) <= tolerance, F.lit(False)))
        cut = lambda c: F.transform(c, lambda f, i: F.transform(
            F.sequence(f, F.coalesce(F.get(c, i + 1), F.size(dots)) - 1), lambda k: F.get(dots, k)))
        return F.flatten(F.transform(let(cut, starts), choose))

    ranked = lambda column, side: F.transform(sort_by(column, lambda d: d["y"]), lambda d, i: F.struct(
        d["y"].alias("y"), F.lit(side).alias("side"), i.alias("at"), d["id"].alias("id")))
    return let(chains, F.sort_array(F.concat(ranked(left, 0), ranked(right, 1))))


def page_span(idx: Column, ident: Column, raw: Column, bbox: Column, stripped: Column | None = None) -> Column:
    """A span as {y, x, idx, ...}, which sorts in reading order, with the labels that its own text may give.

    ``lone`` is 1 for a lone number and 2 for a lone capital. ``lead``, ``trail``
    and ``cap`` are the number before, the number after and the first capital
    before an end, space or capital (null: none). What is left of the stripped
    ``text`` begins after ``lead_cut`` or ``cap_cut`` characters, or is ``trail_len`` long.
    Lambdas, which compute an expression wherever it stands, give the ``stripped`` text.
    """
    text = X.py_strip(raw) if stripped is None else stripped
    lead, trail = r"^(\d{1,2})\.?\s+", r"\s+(\d{1,2})\.?$"
    # patterns are tried on the few characters that they may take, not at every place of a long text
    head, tail, short = F.substring(text, 1, 4), F.substring(text, -4, 4), F.length(text) <= 3
    number = lambda end, pattern: F.when(end.rlike(pattern), F.regexp_extract(end, pattern, 1))
    left_over = lambda pattern: F.length(X.py_strip(F.regexp_replace(text, pattern, "")))
    start = F.regexp_replace(raw, "^[^A-Za-z0-9ÄÖÜäöüß]+", "")
    capital = F.substring(start, 1, 4).rlike(r"^\p{Lu}(?:$|[ \p{Lu}])")
    return F.struct(
        bbox["y"].alias("y"), bbox["x"].alias("x"), idx.alias("idx"), ident.alias("id"), text.alias("text"), bbox["width"].alias("w"), bbox["height"].alias("h"),
        G.center_x(bbox).alias("cx"), G.center_y(bbox).alias("cy"), F.when(short & text.rlike(X.LEFT_STANDALONE), 1).when(short & text.rlike(X.RIGHT_STANDALONE), 2).alias("lone"),
        number(head, lead).alias("lead"), F.when(head.rlike(lead), F.length(text) - left_over(lead)).alias("lead_cut"),
        number(tail, trail).alias("trail"), F.when(tail.rlike(trail), left_over(trail)).alias("trail_len"), F.when(capital, F.substring(start, 1, 1)).alias("cap"),
        F.when(capital, F.length(text) - F.length(X.py_strip(F.substring(start, F.lit(2), F.length(start))))).alias("cap_cut"))


# What a side's spans q give: label and text by the first or last of them.
_LEFT = ("CASE WHEN get(q, 0).lead IS NOT NULL THEN get(q, 0).lead ELSE coalesce(try_element_at(q, -1).trail, '') END",
         "CASE WHEN j = 0 AND s.lead IS NOT NULL THEN substring(s.text, s.lead_cut + 1) "
         "WHEN j = size(q) - 1 AND s.trail IS NOT NULL AND get(q, 0).lead IS NULL THEN substring(s.text, 1, s.trail_len) ELSE s.text END")
_RIGHT = ("coalesce(get(q, 0).cap, '')", "CASE WHEN j = 0 AND s.cap IS NOT NULL THEN substring(s.text, s.cap_cut + 1) ELSE s.text END")
_BOX = """CASE WHEN size(z) = 1 AND z[0].x IS NOT NULL THEN named_struct('x', z[0].x, 'y', z[0].y, 'width', z[0].x + z[0].w - z[0].x, 'height', z[0].y + z[0].h - z[0].y)
 ELSE transform(array(struct(array_min(z.x) AS x, array_min(z.y) AS y, array_max(transform(z, s -> s.x + s.w)) AS r, array_max(transform(z, s -> s.y + s.h)) AS b)),
  e -> CASE WHEN e.x IS NOT NULL THEN named_struct('x', e.x, 'y', e.y, 'width', e.r - e.x, 'height', e.b - e.y) END)[0] END"""


def labelled(side: str, spans: str) -> str:
    """C15, SQL text: {label, item} of the ``spans`` (see ``page_span``) of one side of a row, in reading order.

    The label is a lone number or capital, else what the first or the last text
    gives. The item {text, bbox, span_ids} has the spans of two or more characters, and is null without any.
    """
    # a lambda's result is copied, so few of them stand around an item
    lone, (label, text) = (1, _LEFT) if side == "left" else (2, _RIGHT)
    item = f"CASE WHEN size(z) > 0 THEN struct(array_join(z.text, ' ') AS text, {_BOX} AS bbox, z.id AS span_ids) END"
    made = "filter(transform({0}, (s, j) -> struct({1} AS text, s.x AS x, s.y AS y, s.w AS w, s.h AS h, s.id AS id)), s -> length(s.text) >= 2)".format
    first = f"array_min(transform(filter(q, s -> s.lone = {lone}), (s, j) -> struct(s.idx AS idx, j AS j, s.text AS text)))"
    apart = bind("o", first, f"struct(regexp_replace(o.text, '[.]$', '') AS label, {bind('z', made('filter(q, s -> s.idx <> o.idx)', 's.text'), item)} AS item)")
    return bind("q", spans, f"CASE WHEN array_contains(q.lone, {lone}) THEN {apart} ELSE struct({label} AS label, {bind('z', made('q', text), item)} AS item) END")


def _median_gap(rows: str) -> str:
    """SQL text: the median of the positive gaps of ``rows`` in y order, null without any."""
    gaps = f"sort_array(filter(transform(sequence(0, size({rows}) - 1), i -> CASE WHEN i > 0 THEN {rows}[i].y - {rows}[i - 1].y END), g -> g > 0))"
    return bind("g", gaps, "CASE WHEN size(g) > 0 THEN (g[CAST(size(g) div 2 AS int)] + g[CAST((size(g) - 1) div 2 AS int)]) / 2 END")


def page_facts(dots: DataFrame, spans: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """One row per page: ``dots`` as {x, y, id, bbox} and its confident ``spans`` (see ``page_span``). The only shuffle."""
    keys = list(keys)
    facts = dots.select(*keys, F.struct("x", "y", "id", "bbox").alias("d")).unionByName(
        spans.where("confidence >= 0.5").select(*keys, page_span(*map(F.col, ("idx", "id", "text", "bbox"))).alias("s")), allowMissingColumns=True)
    return facts.groupBy(*keys).agg(F.collect_list("d").alias("dots"), F.collect_list("s").alias("spans"))


def column_pairs(pages: DataFrame, keys: Sequence[str] = PAGE, min_gap: float = 0.02, tolerance: float = 0.003,
                 spread: float = 0.003, low: float = 0.08, high: float = 0.92) -> DataFrame:
    """Pairs of dot columns of a page (see ``page_facts``) at least ``min_gap`` apart, with their dots and the spans on either side.

    W8: x-sorted chains of at least two dots with a tight spread are columns, so a page holds few.
    """
    keys = list(keys)
    pages = settle(pages.where("size(dots) > 1").select(*keys, F.sort_array("dots").alias("_dots"), F.sort_array("spans").alias("spans")), keys)
    starts = f"filter(sequence(0, size(_dots) - 1), i -> i = 0 OR _dots[i].x - _dots[i - 1].x > {tolerance}D)"
    chains = bind("c", starts, "transform(c, (f, i) -> slice(_dots, f + 1, coalesce(get(c, i + 1), size(_dots)) - f))")
    column = bind("lo", "c[0].x", bind("hi", "element_at(c, -1).x", "struct(i AS column, lo + (hi - lo) / 2 AS x, hi - lo AS wide, "
                                       "array_sort(transform(c, d -> struct(d.y AS y, d.id AS id, d.bbox AS bbox))) AS dots)"))
    kept = f"filter(transform({chains}, (c, i) -> {column}), c -> size(c.dots) >= 2 AND c.wide <= {spread}D AND c.x BETWEEN {low}D AND {high}D)"
    pairs = f"flatten(transform(c, l -> transform(filter(c, r -> l.column < r.column AND r.x - l.x >= {min_gap}D), r -> struct(l AS l, r AS r))))"
    rows = pages.select(*keys, "spans", F.explode(F.expr(bind("c", kept, pairs))).alias("p"))
    # a span between the columns belongs to no side
    return rows.selectExpr(*keys, "p.l.column AS l_column", "p.r.column AS r_column", "p.l.x AS x_left", "p.r.x AS x_right", "p.l.dots AS l_dots", "p.r.dots AS r_dots",
                           "filter(spans, s -> s.cx < p.l.x OR s.cx > p.r.x) AS spans")


def _places() -> str:
    """SQL text: the places in ``spans`` of those within each of the bands ``b``, in reading order.

    Edges and centres are sorted together once; an edge's place less the number of
    edges before it counts the centres below it (a centre on an edge is inside).
    """
    edge = "transform(b, (e, k) -> struct(e.{0} AS v, {1} AS t, k AS p))".format
    centres = "sort_array(transform(spans, (s, p) -> struct(s.cy AS v, 1 AS t, p AS p)))"
    edges = f"filter(transform(sort_array(concat({edge('top', 0)}, o, {edge('bottom', 2)})), (e, k) -> struct(e.t AS t, e.p AS p, k AS k)), e -> e.t <> 1)"
    counts = f"sort_array(transform({edges}, (e, j) -> struct(e.t AS t, e.p AS p, e.k - j AS n))).n"
    inside = """transform(b, (e, k) -> CASE WHEN e.top IS NOT NULL AND e.bottom IS NOT NULL AND n[k] < n[size(b) + k]
        THEN sort_array(transform(sequence(n[k], n[size(b) + k] - 1), z -> o[z].p)) ELSE CAST(array() AS array<int>) END)"""
    return bind("o", centres, bind("n", counts, inside))


def matching_candidates(pages: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """K10 up to acceptance: scored row groups with their items, from pages as in ``page_facts``."""
    keys = list(keys)
    pairs = settle(column_pairs(pages, keys).withColumn("rows", pair_rows(F.col("l_dots"), F.col("r_dots"))), keys)
    # Rows split at gaps of at least max(1.8 x median gap, 0.025); fewer than three rows stay whole
    starts = "filter(sequence(0, size(rows) - 1), i -> i = 0 OR (size(rows) >= 3 AND coalesce(rows[i].y - rows[i - 1].y >= greatest(m * 1.8D, 0.025D), false)))"
    groups = "transform(c, (f, i) -> transform(sequence(f, coalesce(get(c, i + 1), size(rows)) - 1), k -> {0}))".format
    # Bands half way to the neighbour rows of the group, else half a median gap
    band = """struct(coalesce(r.y - (r.y - get(g, i - 1).y) / 2, r.y - m / 2) AS top, coalesce(get(g, i + 1).y - (get(g, i + 1).y - r.y) / 2, r.y + m / 2) AS bottom)"""
    bands = f"flatten(transform({groups('rows[k]')}, g -> {bind('m', f'coalesce({_median_gap("g")}, 0D)', f'transform(g, (r, i) -> {band})')}))"
    placed = bind("m", _median_gap("rows"), bind("c", starts, bind("b", bands, f"struct(c, {_places()} AS near)")))
    pairs = settle(pairs.withColumn("_at", F.expr(placed)), keys).select("*", "_at.*")
    beside = "filter(transform(near[k], p -> spans[p]), s -> {0})".format
    items = f"""struct(rows[k].y AS y, k - f AS row, rows[k].left_id AS left_id, rows[k].right_id AS right_id,
        CASE WHEN rows[k].left_id IS NOT NULL THEN l_dots[rows[k].left_at].bbox END AS left_anchor, CASE WHEN rows[k].right_id IS NOT NULL THEN r_dots[rows[k].right_at].bbox END AS right_anchor,
        {labelled('left', beside('s.cx < x_left'))} AS left, {labelled('right', beside('s.cx > x_right'))} AS right)"""
    df = pairs.selectExpr(*keys, "l_column", "r_column", "x_left", "x_right", f"posexplode({groups(items)}) AS (row_group, _rows)")
    df = df.withColumn("rows", F.expr("filter(_rows, r -> r.left.item IS NOT NULL AND r.right.item IS NOT NULL)"))
    df = settle(df.selectExpr("*", "size(rows) AS n", "size(_rows) AS all_rows", "size(filter(rows, r -> r.left_id IS NOT NULL AND r.right_id IS NOT NULL)) AS paired",
                              "size(array_remove(rows.left.label, '')) + size(array_remove(rows.right.label, '')) AS labels").drop("_rows"), keys)
    n, text_ratio = F.col("n"), F.col("n") / F.col("all_rows")
    score = G.candidate_score("matching", paired=F.col("paired") / n, text=text_ratio, symmetry=F.lit(1.0), labels=F.col("labels") / (n * 2))
    ok = F.when(n >= 3, (text_ratio >= 0.75) & (F.col("paired") / n >= 0.50)).otherwise(False)
    return df.where(ok).withColumn("score", score).where("score >= 0.62")


def nms_suppress(candidates: DataFrame, keys: Sequence[str] = PAGE, column_tolerance: float = 0.004,
                 row_tolerance: float = PAIR_TOLERANCE) -> DataFrame:
    """Accepted candidates by (score, rows) descending; those that repeat accepted rows on the same columns are dropped.

    Adds ``rank`` (1-based acceptance order). The fold over a page's candidates
    compares rows only where cells of one tolerance, or neighbours of them, coincide.
    """
    keys = list(keys)
    ys = F.col("rows.y")
    cell = F.transform(ys, lambda y: F.floor(y / row_tolerance))
    # equal scores keep the order in which column pairs and row groups are found
    own = F.struct((-F.col("score")).alias("s"), (-F.col("n")).alias("m"), "l_column", "r_column", "row_group", "x_left", "x_right",
                   ys.alias("ys"), cell.alias("cells"), "score", "rows")
    pages = candidates.groupBy(*keys).agg(F.sort_array(F.collect_list(own)).alias("c"))
    same = f"abs(c[a].x_left - c[n].x_left) <= {column_tolerance}D AND abs(c[a].x_right - c[n].x_right) <= {column_tolerance}D"
    near = "arrays_overlap(c[a].cells, flatten(transform(c[n].cells, z -> array(z - 1, z, z + 1))))"
    meets = f"exists(c[a].ys, y -> exists(c[n].ys, z -> abs(y - z) <= {row_tolerance}D))"
    taken = f"aggregate(sequence(0, size(c) - 1), CAST(array() AS array<int>), (t, n) -> CASE WHEN exists(t, a -> {same} AND {near} AND {meets}) THEN t ELSE array_append(t, n) END)"
    rows = pages.select(*keys, F.posexplode(F.expr(f"transform({taken}, n -> c[n])")).alias("_at", "a"))
    return rows.select(*keys, (F.col("_at") + 1).alias("rank"), "a.l_column", "a.r_column", "a.row_group", "a.x_left", "a.x_right", "a.score", "a.rows")


def matching_items(dots: DataFrame, spans: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """Accepted matching exercises: id, score, bbox, span_ids, left_items, right_items.

    ``dots``: keys, id, x, y, bbox. ``spans``: keys, idx, id, text, confidence, bbox.
    """
    return page_matchings(page_facts(dots, spans, keys), keys)


def page_matchings(pages: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """``matching_items`` of pages whose dots and spans are arrays already (see ``page_facts``); pages dealt by ``keys`` are not dealt again."""
    keys = list(keys)
    accepted = nms_suppress(matching_candidates(pages, keys), keys)
    ident = F.concat_ws("-", F.lit("matching"), F.col("page_number").cast("string"), F.col("rank").cast("string"))
    named = accepted.withColumn("id", ident)

    def side(name: str) -> Column:
        items = F.transform("rows", lambda r: F.struct(
            r[name]["label"].alias("label"), r[name]["item"]["text"].alias("text"), r[name]["item"]["bbox"].alias("bbox"),
            r[f"{name}_anchor"].alias("anchor_bbox"), r[name]["item"]["span_ids"].alias("span_ids")))
        return F.transform(sort_by(items, lambda i: i["bbox"]["y"]), lambda i, n: F.struct(
            F.concat_ws("-", F.col("id"), F.lit(name), (n + 1).cast("string")).alias("id"), i["label"].alias("label"),
            i["text"].alias("text"), i["bbox"].alias("bbox"), i["anchor_bbox"].alias("anchor_bbox"),
            i["span_ids"].alias("span_ids")))

    built = named.withColumns({"left_items": side("left"), "right_items": side("right")})
    both = F.concat("left_items", "right_items")
    all_boxes = F.concat(F.transform(both, lambda i: i["bbox"]), F.filter(
        F.transform(both, lambda i: i["anchor_bbox"]), lambda b: b.isNotNull()))
    return built.select(
        *keys, "rank", "id", "score", G.bbox_union_array(all_boxes).alias("bbox"),
        F.array_distinct(F.flatten(F.transform(both, lambda i: i["span_ids"]))).alias("span_ids"), "left_items", "right_items")
