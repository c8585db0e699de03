"""Unit resolution, allocation and grading queries.

Books are blocks of 64 orders and units blocks of 32, so a unit has a bounded
number of pages however the keys are distributed; a page is an order and its
interactions are the order's lineitems (counted, never collected).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from leafgrade.functions import textops as X
from leafgrade.operators import allocate as K
from leafgrade.operators import grading as G
from leafgrade.operators import units as U
from leafgrade.plans import tables as T
from leafgrade.plans.registry import query

# ---- units ---------------------------------------------------------------------

PROFILES = """pr AS (SELECT r_regionkey AS profile_id, 2 AS off, 380 AS sol_from, 400 AS sol_to FROM region),
un AS (SELECT n_regionkey AS profile_id, n_nationkey AS unit_number, n_name AS title, 3 + 16 * n_nationkey AS start,
  coalesce(lead(3 + 16 * n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey), 382) AS stop FROM nation),
ex AS (SELECT r_regionkey AS profile_id, r_regionkey * 80 + 5 AS lo, r_regionkey * 80 + 9 AS hi FROM region)"""


def _dimensions(spark, sf):
    r, n = T.table(spark, sf, "region"), T.table(spark, sf, "nation")
    profiles = r.select(F.col("r_regionkey").alias("profile_id"), F.lit(2).alias("printed_offset"), F.lit(380).alias("solution_from"),
                        F.lit(400).alias("solution_to"))
    units = n.select(F.col("n_regionkey").alias("profile_id"), F.col("n_nationkey").alias("position"),
                     F.col("n_nationkey").alias("unit_number"), F.col("n_name").alias("title"),
                     (F.col("n_nationkey") * 16 + 3).alias("printed_start"))
    excluded = r.select(F.col("r_regionkey").alias("profile_id"), (F.col("r_regionkey") * 80 + 5).alias("range_from"),
                        (F.col("r_regionkey") * 80 + 9).alias("range_to"))
    return profiles, units, excluded


@query("unit_asof", "J1 S5", f"""WITH {PROFILES},
p AS (SELECT event_id, CAST(user_id % 5 AS INT) AS profile_id, CAST(event_id % 400 + 1 + 2 AS INT) AS printed FROM events)
SELECT p.event_id, p.printed AS printed_page, u.unit_number, u.title AS unit_title FROM p
LEFT JOIN un u ON u.profile_id = p.profile_id AND p.printed >= u.start AND p.printed < u.stop AND p.printed < 382
 AND NOT EXISTS (SELECT 1 FROM ex WHERE ex.profile_id = p.profile_id AND p.printed BETWEEN ex.lo AND ex.hi)""")
def _(spark, sf):
    profiles, units, excluded = _dimensions(spark, sf)
    pages = T.table(spark, sf, "events").select(
        "event_id", (F.col("user_id") % 5).cast("int").alias("profile_id"), (F.col("event_id") % 400 + 1).cast("int").alias("page_number"))
    return U.resolve_unit(pages, profiles, units, excluded).select("event_id", "printed_page", "unit_number", "unit_title")


@query("unit_pages", "J2", f"""WITH {PROFILES},
b AS (SELECT c_custkey AS book_id, CAST(c_custkey % 5 AS INT) AS profile_id, CAST(200 + c_custkey % 250 AS INT) AS n FROM customer),
p AS (SELECT b.book_id, b.n, b.profile_id, u.unit_number, unnest(generate_series(u.start, u.stop - 1)) AS printed FROM b JOIN un u USING (profile_id))
SELECT book_id, unit_number, count(*) AS pages, min(printed - 2) AS first_page, max(printed - 2) AS last_page,
 CAST(sum(printed - 2) AS BIGINT) AS page_sum FROM p
WHERE printed - 2 BETWEEN 1 AND n AND NOT EXISTS (SELECT 1 FROM ex WHERE ex.profile_id = p.profile_id AND printed BETWEEN lo AND hi)
GROUP BY 1, 2""")
def _(spark, sf):
    profiles, units, excluded = _dimensions(spark, sf)
    books = T.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("book_id"), (F.col("c_custkey") % 5).cast("int").alias("profile_id"),
        (F.col("c_custkey") % 250 + 200).cast("int").alias("page_count"))
    pages = U.pages_for_unit(books, profiles, units, excluded)
    return pages.groupBy("book_id", "unit_number").agg(
        F.count("*").alias("pages"), F.min("page_number").cast("long").alias("first_page"),
        F.max("page_number").cast("long").alias("last_page"), F.sum("page_number").alias("page_sum"))


@query("extraction_ranges", "E12", """WITH b AS (SELECT c_custkey AS book_id, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 5 END AS profile_id,
 CAST(c_custkey % 70 AS INT) AS n FROM customer),
r AS (SELECT book_id, CASE WHEN profile_id IS NOT NULL THEN 380 ELSE greatest(1, greatest(1, n) - 29) END AS lo,
 CASE WHEN profile_id IS NOT NULL THEN 400 ELSE greatest(1, n) END AS hi FROM b)
SELECT r.book_id, CAST(lo AS INT) AS range_from, CAST(hi AS INT) AS range_to, count(e.event_id) AS events_in_range FROM r
LEFT JOIN events e ON e.user_id = r.book_id AND e.event_id % 400 + 1 BETWEEN lo AND hi GROUP BY 1, 2, 3""")
def _(spark, sf):
    profiles, _, _ = _dimensions(spark, sf)
    books = T.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("book_id"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey") % 5).cast("int").alias("profile_id"),
        (F.col("c_custkey") % 70).cast("int").alias("page_count"))
    ranges = U.extraction_range(books, profiles)
    pages = T.table(spark, sf, "events").select(F.col("user_id").alias("book_id"), (F.col("event_id") % 400 + 1).alias("page_number"))
    n = U.pages_in_range(pages, ranges).groupBy("book_id").agg(F.count("*").alias("n"))
    return ranges.join(n, "book_id", "left").select("book_id", "range_from", "range_to", F.coalesce("n", F.lit(0)).alias("events_in_range"))


@query("attached_profiles", "J21", """WITH p AS (SELECT min(r_regionkey) AS pid FROM region WHERE r_name = 'ASIA')
SELECT c_custkey AS book_id, CASE WHEN c_custkey % 7 = 0 THEN 4 WHEN c_mktsegment = 'BUILDING' THEN p.pid END AS profile_id FROM customer, p""")
def _(spark, sf):
    books = T.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("book_id"), F.col("c_mktsegment").alias("checksum"),
        F.when(F.col("c_custkey") % 7 == 0, 4).alias("profile_id"))
    profiles = T.table(spark, sf, "region").select(F.col("r_regionkey").alias("profile_id"), F.col("r_name").alias("edition_key"))
    return U.attach_profile(books, profiles, "building", "ASIA").select("book_id", "profile_id")


# ---- allocation ----------------------------------------------------------------

KIND_SQL = "CASE WHEN o_orderkey // 32 % 2 = 0 THEN 'fill-in-line' ELSE 'choice' END"
ALLOC = f"""o AS (SELECT o_orderkey // 64 AS book_id, o_orderkey // 32 AS unit_number, o_orderkey % 64 + 1 AS page_number,
  CAST(o_orderkey % 4 AS INT) AS size, o_orderkey, {KIND_SQL} AS kind FROM orders),
cap AS (SELECT o.book_id, o.unit_number, o.page_number, count(*) AS c FROM lineitem l JOIN o ON o.o_orderkey = l.l_orderkey GROUP BY 1, 2, 3),
pg AS (SELECT *, row_number() OVER (PARTITION BY unit_number ORDER BY page_number) AS p FROM cap),
bl AS (SELECT unit_number, size, row_number() OVER (PARTITION BY unit_number ORDER BY o_orderkey) AS b FROM o),
nb AS (SELECT unit_number, max(b) AS n FROM bl GROUP BY 1), np AS (SELECT unit_number, max(p) AS n FROM pg GROUP BY 1),
walk AS (
 SELECT unit_number, 1 AS p, 1 AS b, 0 AS used, false AS amb, false AS done FROM np
 UNION ALL
 SELECT * FROM (
  SELECT w.unit_number, CASE WHEN stop THEN w.p + 1 ELSE w.p END AS p, CASE WHEN stop THEN w.b ELSE w.b + 1 END AS b,
   CASE WHEN stop THEN 0 ELSE w.used + bl.size END AS used, CASE WHEN stop THEN false ELSE w.amb OR bl.size = 0 END AS amb, w.p > np.n AS done
  FROM walk w JOIN np USING (unit_number) JOIN nb ON nb.unit_number = w.unit_number
  LEFT JOIN pg ON pg.unit_number = w.unit_number AND pg.p = w.p LEFT JOIN bl ON bl.unit_number = w.unit_number AND bl.b = w.b,
  LATERAL (SELECT w.b > nb.n OR w.used >= pg.c OR (bl.size > 0 AND w.used + bl.size > pg.c) AS stop) s WHERE w.p <= np.n)
),
ends AS (SELECT unit_number, p, max(b) AS b, max(used) AS used, bool_or(amb) AS amb FROM walk GROUP BY 1, 2),
res AS (SELECT pg.book_id, pg.unit_number, pg.page_number, pg.c AS capacity, e.used,
  e.amb OR (e.b <= nb.n AND e.used < pg.c) AS rest_ambiguous FROM pg JOIN ends e USING (unit_number, p) JOIN nb USING (unit_number))"""


def _order_units(spark, sf):
    o = T.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    unit = F.floor(k / 32)
    return o.select(F.floor(k / 64).alias("book_id"), unit.alias("unit_number"), (k % 64 + 1).alias("page_number"), "o_orderkey",
                    F.when(unit % 2 == 0, "fill-in-line").otherwise("choice").alias("kind"))


def _capacities(spark, sf):
    """Interactions per page; a frequent order key is counted on the map side first."""
    counts = T.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("capacity"))
    return _order_units(spark, sf).join(counts, "o_orderkey").select("book_id", "unit_number", "kind", "page_number", "capacity")


def _entries(spark, sf):
    """One answer block per order with o_orderkey % 4 items (none = no item split)."""
    items = F.transform(F.array_compact(F.array(*[F.when(F.col("o_orderkey") % 4 > i, F.lit(i)) for i in range(3)])),
                        lambda i: F.concat_ws("-", F.col("o_orderkey").cast("string"), i.cast("string")))
    return _order_units(spark, sf).select("book_id", "unit_number", "kind", F.lit(None).cast("string").alias("marker"),
                                          F.col("o_orderkey").alias("ordinal"), items.alias("items"))


@query("allocate_blocks", "K2 T1", f"""WITH RECURSIVE {ALLOC}
SELECT book_id, unit_number, page_number, capacity, CAST(used AS BIGINT) AS resolved,
 CASE WHEN rest_ambiguous THEN capacity - used ELSE 0 END AS ambiguous, CASE WHEN rest_ambiguous THEN 0 ELSE capacity - used END AS unmapped FROM res""")
def _(spark, sf):
    blocks = K.entry_order(_entries(spark, sf), K.UNIT_KIND).withColumn("size", F.size("items"))
    pages = K.page_allocation(_capacities(spark, sf), blocks.select(*K.UNIT_KIND, "block", "size"))
    rest = F.col("capacity") - F.col("used")
    return pages.select("book_id", "unit_number", "page_number", "capacity", F.col("used").alias("resolved"),
                        F.when(F.col("ambiguous_rest"), rest).otherwise(0).alias("ambiguous"),
                        F.when(F.col("ambiguous_rest"), 0).otherwise(rest).alias("unmapped"))


@query("page_status", "A3 K2", f"""WITH RECURSIVE {ALLOC}
SELECT book_id, page_number, CASE WHEN used > 0 THEN 'RESOLVED' WHEN rest_ambiguous THEN 'AMBIGUOUS' ELSE 'UNMAPPED' END AS status FROM res""")
def _(spark, sf):
    slots = K.allocate_blocks(_capacities(spark, sf), K.entry_order(_entries(spark, sf), K.UNIT_KIND))
    return K.page_status(slots)


@query("entry_order", "T1", """SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderkey // 32 ORDER BY
 CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderkey * 7 % 13 AS VARCHAR) END NULLS FIRST, o_orderkey) - 1 AS INT) AS block FROM orders""")
def _(spark, sf):
    marker = F.when(F.col("o_orderkey") % 5 != 0, (F.col("o_orderkey") * 7 % 13).cast("string"))
    e = _order_units(spark, sf).withColumn("marker", marker).withColumn("ordinal", F.col("o_orderkey"))
    return K.entry_order(e, ["unit_number"]).select("o_orderkey", "block")


@query("nth_entries", "J22", """WITH e AS (SELECT o_orderkey // 32 AS book_id, o_orderkey AS k, row_number() OVER (PARTITION BY o_orderkey // 32
 ORDER BY o_orderkey * 7 % 31, o_orderkey) - 1 AS n FROM orders)
SELECT q.k AS request, e.k AS entry FROM (SELECT o_orderkey AS k, o_orderkey // 32 AS book_id, o_orderkey % 40 AS n FROM orders) q
LEFT JOIN e ON e.book_id = q.book_id AND e.n = q.n""")
def _(spark, sf):
    o = T.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    base = o.select(F.floor(k / 32).alias("book_id"), F.lit(1).alias("page_number"), F.lit("choice").alias("kind"), k.alias("k"))
    entries = base.withColumn("ordinal", F.col("k") * 7 % 31).withColumn("entry_index", F.col("k")).withColumn("entry", F.col("k")).drop("k")
    asks = base.withColumn("n", (F.col("k") % 40).cast("int")).withColumnRenamed("k", "request")
    return K.nth_entry_lookup(entries, asks).select("request", "entry")


@query("coverage", "A16 A3", f"""WITH RECURSIVE {ALLOC}
SELECT book_id, CAST(sum(capacity) AS BIGINT) AS slots, CAST(sum(used) AS BIGINT) AS resolved,
 CAST(sum(CASE WHEN rest_ambiguous THEN capacity - used ELSE 0 END) AS BIGINT) AS ambiguous,
 CAST(sum(CASE WHEN rest_ambiguous THEN 0 ELSE capacity - used END) AS BIGINT) AS unmapped,
 round(sum(used) / sum(capacity), 6) AS resolved_share FROM res GROUP BY 1""")
def _(spark, sf):
    from leafgrade.operators.flatten import coverage
    slots = K.allocate_blocks(_capacities(spark, sf), K.entry_order(_entries(spark, sf), K.UNIT_KIND))
    return coverage(slots, ["book_id"]).withColumn("resolved_share", F.round("resolved_share", 6))


@query("unit_totals", "K2 G4 A4", f"""WITH RECURSIVE {ALLOC},
sl AS (SELECT book_id, unit_number, page_number, unnest(generate_series(0, capacity - 1)) AS ordinal, used FROM res),
an AS (SELECT * FROM sl WHERE ordinal < used)
SELECT book_id, unit_number, count(*) FILTER (WHERE (page_number + ordinal) % 3 <> 0 AND (page_number + ordinal) % 5 <> 0) AS total_correct,
 count(*) AS total_gradable, bool_or(true) AS checked FROM an GROUP BY 1, 2
UNION ALL SELECT book_id, unit_number, 0, 0, false FROM sl GROUP BY 1, 2 HAVING max(used) = 0""")
def _(spark, sf):
    """How many answers are correct per unit: allocation, slots, answers, grading, totals in one plan."""
    slots = K.allocate_blocks(_capacities(spark, sf), K.entry_order(_entries(spark, sf), K.UNIT_KIND))
    turn = F.col("page_number") + F.col("ordinal")
    learner = F.when(turn % 3 == 0, F.lit("wrong")).when(turn % 5 == 0, F.lit("  ")).otherwise(
        F.concat(F.lit("  "), F.upper("expected_value"), F.lit(" ")))
    result = G.compare_blank(learner, F.col("expected_value").isNotNull(), F.col("expected_value"),
                             F.array().cast("array<string>"), F.lit(False), compose=False)
    graded = slots.withColumn("r", result).withColumn("verdict", F.when(F.col("resolution") == "RESOLVED", F.col("r.verdict")))
    return G.verdict_totals(graded, ["book_id", "unit_number"])


@query("slot_join", "J9 G12", """WITH s AS (SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 'RESOLVED' WHEN 1 THEN 'AMBIGUOUS' ELSE 'UNMAPPED' END AS r,
 'entry-' || o_orderkey AS e FROM orders WHERE o_orderkey % 2 = 0),
i AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN 'free-text' ELSE 'choice' END AS kind FROM orders)
SELECT i.k, i.kind, coalesce(s.r, 'UNMAPPED') AS resolution, CASE WHEN s.r = 'RESOLVED' AND i.kind = 'choice' THEN s.e END AS expected FROM i
LEFT JOIN s USING (k)""")
def _(spark, sf):
    o, k = T.table(spark, sf, "orders"), F.col("o_orderkey")
    kind = F.when(k % 4 == 0, "free-text").otherwise("choice")
    base = o.select(F.floor(k / 64).alias("book_id"), (k % 64).alias("page_number"), kind.alias("kind"), F.lit(0).alias("ordinal"), k.alias("k"))
    slots = base.where("k % 2 = 0").select(
        "book_id", "page_number", "kind", "ordinal", F.concat(F.lit("entry-"), F.col("k").cast("string")).alias("entry"),
        F.when(F.col("k") % 3 == 0, "RESOLVED").when(F.col("k") % 3 == 1, "AMBIGUOUS").otherwise("UNMAPPED").alias("resolution"))
    joined = K.slot_join(base, slots)
    return joined.select("k", "kind", "resolution", G.expected_answer(
        F.col("kind"), F.col("resolution"), F.col("entry"), F.lit("Text"), F.lit(None).cast("string")).alias("expected"))


# ---- verdicts ------------------------------------------------------------------

ANSWER = """CASE l_linenumber % 5 WHEN 0 THEN '  ' WHEN 1 THEN ' ' || upper(l_returnflag) || '  ' || l_linestatus WHEN 2 THEN l_returnflag || ' x'
 WHEN 3 THEN lower(l_linestatus) ELSE l_returnflag || '–' || l_linestatus END"""


def _answers(spark, sf):
    """One learner answer per lineitem, as a variant of the expected text."""
    f, s, n = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_linenumber")
    answer = (F.when(n % 5 == 0, "  ").when(n % 5 == 1, F.concat(F.lit(" "), F.upper(f), F.lit("  "), s))
              .when(n % 5 == 2, F.concat(f, F.lit(" x"))).when(n % 5 == 3, F.lower(s)).otherwise(F.concat(f, F.lit("–"), s)))
    return T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", f, s, answer.alias("answer"))


@query("verdict_blank", "G4 C3", f"""WITH a AS (SELECT *, {ANSWER} AS answer, l_partkey % 9 = 0 AS cs FROM lineitem),
n AS (SELECT *, replace(regexp_replace(trim(answer), '\\s+', ' ', 'g'), '–', '-') AS t FROM a),
m AS (SELECT *, CASE WHEN cs THEN t ELSE lower(t) END AS u, CASE WHEN cs THEN l_returnflag || ' ' || l_linestatus ELSE lower(l_returnflag || ' ' || l_linestatus) END AS e,
 CASE WHEN cs THEN l_linestatus ELSE lower(l_linestatus) END AS e2, lower(l_returnflag || '-' || l_linestatus) AS e3 FROM n)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_suppkey % 11 = 0 THEN NULL WHEN t = '' THEN 'UNANSWERED'
 WHEN u = e OR u = e2 OR (NOT cs AND u = e3) OR (cs AND u = l_returnflag || '-' || l_linestatus) THEN 'CORRECT' ELSE 'INCORRECT' END AS verdict,
 CASE WHEN l_suppkey % 11 = 0 THEN 'UNMAPPED' ELSE 'RESOLVED' END AS resolution FROM m""")
def _(spark, sf):
    a = _answers(spark, sf)
    f, s = F.col("l_returnflag"), F.col("l_linestatus")
    r = G.compare_blank(F.col("answer"), F.col("l_suppkey") % 11 != 0, F.concat(f, F.lit(" "), s),
                        F.array(s, F.concat(f, F.lit("-"), s)), F.col("l_partkey") % 9 == 0)
    return a.withColumn("r", r).select("l_orderkey", "l_linenumber", "l_partkey", "r.verdict", "r.resolution")


@query("verdict_server_blank", "G1 G2 C2", """WITH a AS (SELECT p_partkey, p_brand, p_type, CASE p_partkey % 4 WHEN 0 THEN upper(p_brand) || '.!' WHEN 1 THEN ' ' || p_type
 WHEN 2 THEN '' ELSE p_brand || '?  ' END AS ans, p_size % 3 = 0 AS cs, p_size % 4 = 0 AS pr, CASE WHEN p_partkey % 10 = 9 THEN 'AMBIGUOUS' ELSE 'RESOLVED' END AS res,
 CASE WHEN p_partkey % 13 = 0 THEN 'FreeText' WHEN p_partkey % 17 = 0 THEN 'Choice' ELSE 'FillBlank' END AS kind FROM part),
n AS (SELECT *, CASE WHEN pr THEN trim(ans) ELSE trim(regexp_replace(trim(ans), '[.!?:;,]+$', '')) END AS t FROM a),
m AS (SELECT *, CASE WHEN cs THEN t ELSE lower(t) END AS u, CASE WHEN cs THEN p_brand ELSE lower(p_brand) END AS e, CASE WHEN cs THEN p_type ELSE lower(p_type) END AS e2 FROM n)
SELECT p_partkey, CASE WHEN p_partkey % 19 = 0 OR res <> 'RESOLVED' OR kind = 'FreeText' THEN 'NOT_AUTO_GRADABLE' WHEN trim(ans) = '' THEN 'UNANSWERED'
 WHEN kind = 'Choice' THEN 'NOT_AUTO_GRADABLE' WHEN u = e OR u = e2 THEN 'CORRECT' ELSE 'INCORRECT' END AS verdict, res AS resolution FROM m""")
def _(spark, sf):
    k, size = F.col("p_partkey"), F.col("p_size")
    ans = (F.when(k % 4 == 0, F.concat(F.upper("p_brand"), F.lit(".!"))).when(k % 4 == 1, F.concat(F.lit(" "), F.col("p_type")))
           .when(k % 4 == 2, "").otherwise(F.concat(F.col("p_brand"), F.lit("?  "))))
    kind = F.when(k % 13 == 0, "FreeText").when(k % 17 == 0, "Choice").otherwise("FillBlank")
    pairs = F.lit(None).cast("array<struct<leftLabel:string,rightLabel:string>>")
    r = G.grade_server(kind, F.when(k % 10 == 9, "AMBIGUOUS").otherwise("RESOLVED"), ans, F.col("p_brand"), F.array("p_type"),
                       size % 3 == 0, size % 4 == 0, pairs, k % 19 != 0, F.lit("Text"))
    return T.table(spark, sf, "part").withColumn("r", r).select("p_partkey", "r.verdict", "r.resolution")


OPTIONS = ["a", "b", "c", "b"]


def _options():
    """Four options, two of them with the same label."""
    return F.array(*[F.struct(F.lit(f"o{i}").alias("id"), F.lit(f" {v.upper()}").alias("label")) for i, v in enumerate(OPTIONS)])


@query("verdict_choice", "G5 J10", """SELECT l_orderkey, l_linenumber, l_partkey,
 CASE WHEN l_suppkey % 7 = 0 THEN NULL WHEN l_linenumber % 4 = 0 THEN 'UNANSWERED' WHEN l_partkey % 4 = 1 OR l_partkey % 4 = 3 THEN NULL
  WHEN (l_partkey % 4 = 0 AND l_orderkey % 3 = 0) OR (l_partkey % 4 = 2 AND l_orderkey % 3 = 2) THEN 'CORRECT' ELSE 'INCORRECT' END AS verdict,
 CASE WHEN l_suppkey % 7 = 0 THEN 'UNMAPPED' WHEN l_linenumber % 4 = 0 THEN 'RESOLVED' WHEN l_partkey % 4 IN (1, 3) THEN 'AMBIGUOUS' ELSE 'RESOLVED' END AS resolution
FROM lineitem""")
def _(spark, sf):
    labels = F.array(*[F.lit(v) for v in OPTIONS])
    learner = F.when(F.col("l_linenumber") % 4 == 0, "").otherwise(F.concat(F.lit("o"), (F.col("l_orderkey") % 3).cast("string")))
    r = G.compare_choice(learner, F.col("l_suppkey") % 7 != 0, F.get(labels, (F.col("l_partkey") % 4).cast("int")), _options())
    rows = T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return rows.withColumn("r", r).select("l_orderkey", "l_linenumber", "l_partkey", "r.verdict", "r.resolution")


@query("verdict_grid", "G6 J10", """WITH g AS (SELECT o_orderkey AS k, unnest(range(3)) AS i FROM orders),
r AS (SELECT k, i, (k // (i + 1)) % 4 AS a, CASE (k + i) % 5 WHEN 0 THEN 'a' WHEN 1 THEN 'c' WHEN 2 THEN 'b' WHEN 3 THEN 'a' ELSE 'c' END AS lab FROM g),
q AS (SELECT k, i, a, lab, a <> 3 AS answered, i < 2 OR k % 3 <> 0 AS has_label FROM r),
s AS (SELECT k, count(*) FILTER (WHERE answered) AS n, count(*) FILTER (WHERE answered AND has_label AND lab = 'b') AS unclear,
 count(*) FILTER (WHERE answered AND has_label AND ((lab = 'a' AND a = 0) OR (lab = 'c' AND a = 2))) AS c FROM q GROUP BY k)
SELECT k, CASE WHEN n = 0 THEN 'UNANSWERED' WHEN unclear > 0 THEN NULL WHEN c = 3 THEN 'CORRECT' WHEN c > 0 THEN 'PARTIALLY_CORRECT' ELSE 'INCORRECT' END AS verdict,
 CASE WHEN n > 0 AND unclear = 0 AND c BETWEEN 1 AND 2 THEN CAST(c AS INT) END AS correct FROM s""")
def _(spark, sf):
    k = F.col("o_orderkey")
    labels = F.array(*[F.lit(v) for v in ["a", "c", "b", "a", "c"]])
    rows = F.array(*[F.when(F.floor(k / (i + 1)) % 4 != 3, F.concat(F.lit("o"), (F.floor(k / (i + 1)) % 4).cast("string"))) for i in range(3)])
    wanted = F.array(*[F.get(labels, ((k + i) % 5).cast("int")) for i in range(3)])
    expected = F.array_join(F.when(k % 3 == 0, F.slice(wanted, 1, 2)).otherwise(wanted), " ,")
    r = G.compare_grid(rows, F.lit(True), expected, _options())
    return T.table(spark, sf, "orders").select("o_orderkey").withColumn("r", r).select(k.alias("k"), "r.verdict", "r.correct")


@query("verdict_ordering", "G7 C14", """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 6 AS shift, CASE WHEN o_orderkey % 11 = 0 THEN 0 WHEN o_orderkey % 7 = 0 THEN 3 ELSE 4 END AS n FROM orders),
e AS (SELECT k, n, list_transform(range(4), lambda i: 'i' || i) AS want,
 list_transform(range(n), lambda i: 'i' || CASE WHEN shift = 0 THEN i WHEN shift = 1 AND i < 2 THEN 1 - i ELSE (i + shift) % 4 END) AS got FROM o),
h AS (SELECT k, n, len(list_filter(list_zip(got, want), lambda p: p[1] = p[2])) AS hits FROM e)
SELECT k, CASE WHEN n = 0 OR n < 4 - (k % 2) THEN 'UNANSWERED' WHEN n <> 4 THEN 'PARTIALLY_CORRECT' WHEN hits = 4 THEN 'CORRECT'
 WHEN hits > 0 THEN 'PARTIALLY_CORRECT' ELSE 'INCORRECT' END AS verdict, CASE WHEN n = 4 AND hits BETWEEN 1 AND 3 THEN CAST(hits AS INT) END AS correct FROM h""")
def _(spark, sf):
    k = F.col("o_orderkey")
    shift = (k % 6).cast("int")
    n = F.when(k % 11 == 0, 0).when(k % 7 == 0, 3).otherwise(4)
    spot = lambda i: F.when(shift == 0, i).when((shift == 1) & (i < 2), 1 - i).otherwise((i + shift) % 4)
    got = F.transform(F.slice(F.array(*[F.lit(i) for i in range(4)]), F.lit(1), n), lambda i: F.concat(F.lit("i"), spot(i).cast("string")))
    r = G.compare_ordering(F.array_join(got, ","), F.lit(True), F.lit("i0, i1,i2 ,i3"), 4 - (k % 2))
    return T.table(spark, sf, "orders").select("o_orderkey").withColumn("r", r).select(k.alias("k"), "r.verdict", "r.correct")


@query("verdict_matching", "G8 J11 C12 C13", """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 4 AS a, o_orderkey % 3 AS b, CASE WHEN o_orderkey % 5 = 0 THEN 0 WHEN o_orderkey % 5 = 1 THEN 3 ELSE 2 END AS n FROM orders),
h AS (SELECT *, (CASE WHEN n > 0 AND a = 0 THEN 1 ELSE 0 END) + (CASE WHEN n > 1 AND b = 0 THEN 1 ELSE 0 END) AS hits FROM o)
SELECT k, CASE WHEN n = 0 THEN 'UNANSWERED' WHEN k % 9 = 0 THEN NULL WHEN hits = 2 AND n = 2 THEN 'CORRECT' WHEN hits > 0 THEN 'PARTIALLY_CORRECT' ELSE 'INCORRECT' END AS verdict,
 CASE WHEN n > 0 AND k % 9 <> 0 AND hits > 0 AND NOT (hits = 2 AND n = 2) THEN CAST(hits AS INT) END AS correct FROM h""")
def _(spark, sf):
    k = F.col("o_orderkey")
    side = lambda s, labels: F.array(*[F.struct(F.lit(f"{s}{i}").alias("id"), F.lit(v).alias("label"), F.lit(f"Text {s}{i}").alias("text"))
                                       for i, v in enumerate(labels)])
    a, b = (k % 4).cast("string"), (k % 3).cast("string")
    n = F.when(k % 5 == 0, 0).when(k % 5 == 1, 3).otherwise(2)
    parts = F.array(F.concat(F.lit('"l0":"r'), a, F.lit('"')), F.concat(F.lit('"l1":"r'), (b.cast("int") + 1).cast("string"), F.lit('"')), F.lit('"l9":"r9"'))
    learner = F.concat(F.lit("{"), F.array_join(F.slice(parts, F.lit(1), n), ","), F.lit("}"))
    expected = F.when(k % 9 == 0, "1=A;2=Z").otherwise("1=A; 2->TEXT  R1")
    # the same pairs as a payload whose first label is an umlaut: a letter and a mark in the key, one sign on the page or the other way
    umlaut, split = "\u00e4", "a\u0308"
    pair = lambda left, right: F.struct(left.alias("leftLabel"), right.alias("rightLabel"))
    named = F.array(pair(F.lit("1"), F.when(k % 2 == 0, split).otherwise(umlaut)), pair(F.lit("2"), F.when(k % 9 == 0, "Z").otherwise("Text r1")))
    first = F.when(k % 6 == 1, split).when(k % 3 == 1, umlaut).otherwise("A")
    lefts = side("l", ["1", "2"])
    rights = F.transform(side("r", ["A", "B", "C"]), lambda i: F.struct(i["id"].alias("id"), F.when(i["label"] == "A", first).otherwise(i["label"]).alias("label"), i["text"].alias("text")))
    rows = T.table(spark, sf, "orders").select("o_orderkey").withColumns({"li": G.compose_items(lefts), "ri": G.compose_items(rights)})
    rows = G.with_source_pairs(rows, "pairs", expected, F.when(k % 3 == 1, named), F.when(k % 3 == 1, "Matching").otherwise("Text"))
    r = G.compare_matching(learner, F.lit(True), F.col("pairs"), F.col("li"), F.col("ri"))
    return rows.withColumn("r", r).select(k.alias("k"), "r.verdict", "r.correct")


@query("verdict_server_matching", "G3 C11", """WITH p AS (SELECT p_partkey, p_partkey % 3 AS a, p_partkey % 2 AS b, p_partkey % 7 = 0 AS none FROM part)
SELECT p_partkey, CASE WHEN none THEN 'UNANSWERED' WHEN a = 0 AND b = 0 THEN 'CORRECT' WHEN a = 0 OR b = 0 THEN 'PARTIALLY_CORRECT' ELSE 'INCORRECT' END AS verdict FROM p""")
def _(spark, sf):
    k = F.col("p_partkey")
    letter = lambda c: F.substring(F.lit("ABCDEF"), c.cast("int") + 1, F.lit(1))
    learner = F.when(k % 7 == 0, "nothing").otherwise(F.concat(F.lit("1"), letter(k % 3), F.lit(" — 2"), letter(k % 2), F.lit("-3F")))
    pairs = F.array(*[F.struct(F.lit(n).alias("leftLabel"), F.lit("A").alias("rightLabel")) for n in ("1", "2")])
    return T.table(spark, sf, "part").select("p_partkey", G.grade_matching(learner, pairs, F.lit("Matching")).alias("verdict"))


@query("verdict_totals", "A4 G10 G9 G11", """WITH l AS (SELECT l_suppkey, l_linenumber % 3 AS kind, l_partkey % 4 AS src, l_returnflag AS f, l_linestatus AS s FROM lineitem),
v AS (SELECT l_suppkey, CASE WHEN src = 3 THEN NULL WHEN kind = 2 THEN 'NOT_AUTO_GRADABLE' WHEN kind = 0 THEN CASE WHEN f = 'A' THEN 'CORRECT' ELSE 'INCORRECT' END
 ELSE CASE WHEN s = 'O' THEN 'CORRECT' ELSE 'INCORRECT' END END AS verdict, CASE WHEN kind <> 2 AND src <> 3 THEN 1 ELSE 0 END AS backed FROM l)
SELECT l_suppkey, count(*) FILTER (WHERE verdict = 'CORRECT') AS total_correct, count(*) FILTER (WHERE verdict <> 'NOT_AUTO_GRADABLE') AS total_gradable,
 coalesce(bool_or(verdict IS NOT NULL), false) AS checked, CAST(sum(backed) AS BIGINT) AS backed FROM v GROUP BY 1""")
def _(spark, sf):
    n = F.col("l_linenumber") % 3
    none = F.lit(None)
    item = "array<struct<id:string,label:string,text:string>>"
    rows = T.table(spark, sf, "lineitem").select(
        "l_suppkey", F.when(n == 0, "fill-in-line").when(n == 1, "choice").otherwise("free-text").alias("kind"),
        F.when(F.col("l_partkey") % 4 == 3, "AMBIGUOUS").otherwise("RESOLVED").alias("resolution"),
        F.when(n == 0, F.lower("l_returnflag")).otherwise(F.when(F.col("l_linestatus") == "O", "x1").otherwise("x2")).alias("learner"),
        none.cast("array<string>").alias("row_answers"), none.cast("int").alias("item_count"),
        F.array(F.struct(F.lit("x1").alias("id"), F.lit("A").alias("label")), F.struct(F.lit("x2").alias("id"), F.lit("B").alias("label"))).alias("options"),
        none.cast(item).alias("left_items"), none.cast(item).alias("right_items"), F.lit("A").alias("expected"),
        F.array().cast("array<string>").alias("alternatives"), F.lit(False).alias("case_sensitive"),
        none.cast("array<struct<leftLabel:string,rightLabel:string>>").alias("pairs"), F.lit("Text").alias("payload_type"))
    graded = G.grade_all(rows).withColumn("verdict", F.col("result.verdict"))
    return G.verdict_totals(graded, ["l_suppkey"], F.count_if(G.is_source_backed(F.col("kind"), F.col("resolution"))).alias("backed"))


@query("verdict_kinds", "G10 G6 G7 G8 A4", """WITH l AS (SELECT l_suppkey, CASE l_linenumber % 3 WHEN 0 THEN 'choice-grid' WHEN 1 THEN 'sentence-ordering' ELSE 'matching' END AS kind, l_partkey % 4 AS a, l_orderkey % 3 AS b FROM lineitem),
v AS (SELECT l_suppkey, kind, (CASE WHEN a = 0 THEN 1 ELSE 0 END) + (CASE WHEN b = 0 THEN 1 ELSE 0 END) AS hits FROM l)
SELECT l_suppkey, kind, count(*) FILTER (WHERE hits = 2) AS total_correct, count(*) AS total_gradable, true AS checked, count(*) FILTER (WHERE hits = 1) AS partly FROM v GROUP BY 1, 2""")
def _(spark, sf):
    """Grids, orderings and matchings of two parts each through the one grader; a part is right by its key."""
    n, none = F.col("l_linenumber") % 3, F.lit(None)
    a, b = F.col("l_partkey") % 4, F.col("l_orderkey") % 3
    kind = F.when(n == 0, "choice-grid").when(n == 1, "sentence-ordering").otherwise("matching")
    side = lambda s, labels: F.array(*[F.struct(F.lit(f"{s}{i}").alias("id"), F.lit(v).alias("label"), F.lit(f"Text {s}{i}").alias("text"))
                                       for i, v in enumerate(labels)])
    first, second = F.when(a == 0, "r0").otherwise("r2"), F.when(b == 0, "r1").otherwise("r3")
    rows = T.table(spark, sf, "lineitem").select(
        "l_suppkey", kind.alias("kind"), F.lit("RESOLVED").alias("resolution"),
        F.when(n == 1, F.concat_ws(",", first, second)).otherwise(F.concat(F.lit('{"l0":"'), first, F.lit('","l1":"'), second, F.lit('"}'))).alias("learner"),
        F.array(first, second).alias("row_answers"), F.lit(2).alias("item_count"),
        F.array(*[F.struct(F.lit(f"r{i}").alias("id"), F.lit(v).alias("label")) for i, v in enumerate("ABCD")]).alias("options"),
        side("l", ["1", "2"]).alias("left_items"), side("r", ["A", "B", "C", "D"]).alias("right_items"),
        F.when(n == 0, "a, b").when(n == 1, "r0,r1").otherwise("1=A;2=B").alias("expected"), F.array().cast("array<string>").alias("alternatives"),
        F.lit(False).alias("case_sensitive"), none.cast("array<struct<leftLabel:string,rightLabel:string>>").alias("pairs"), F.lit("Text").alias("payload_type"))
    graded = G.grade_all(rows).withColumn("verdict", F.col("result.verdict"))
    return G.verdict_totals(graded, ["l_suppkey", "kind"], F.count_if(F.col("verdict") == "PARTIALLY_CORRECT").alias("partly"))


@query("rounded_values", "X10 K1 C20", """WITH v AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey * 10 + 5 AS DOUBLE) / 100000 AS x, CAST(l_suppkey * 2 + 1 AS DOUBLE) / 8000 AS z,
 CAST(l_partkey % 1000 * 10 + 5 AS DOUBLE) / 1000 AS y FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(printf('%.4f', x) AS DOUBLE) AS score, CAST(printf('%.4f', z) AS DOUBLE) AS mean, printf('%.2f', y) AS shown FROM v""")
def _(spark, sf):
    """Values on and beside decimal ties, rounded half-even on their binary value."""
    x, y, z = (F.col("l_partkey") * 10 + 5) / 100000.0, (F.col("l_partkey") % 1000 * 10 + 5) / 1000.0, (F.col("l_suppkey") * 2 + 1) / 8000.0
    return T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", X.round_exact(x).alias("score"), X.round_exact(z).alias("mean"), X.fixed(y, 2, True).alias("shown"))


@query("can_check", "G11", """SELECT o_orderkey, (o_orderkey % 5 <> 0 AND o_orderkey % 3 <> 0 AND NOT (o_orderkey % 4 <> 0 AND o_orderstatus = 'F')) AS can_check FROM orders""")
def _(spark, sf):
    k = F.col("o_orderkey")
    flag = G.can_check(F.when(k % 4 == 0, "free-text").otherwise("choice"), F.when(k % 5 == 0, -1).otherwise(0),
                       F.when(k % 3 == 0, "  ").otherwise("x"), F.when(F.col("o_orderstatus") == "F", "RESOLVED").otherwise("UNMAPPED"))
    return T.table(spark, sf, "orders").select("o_orderkey", flag.alias("can_check"))


@query("matched_pairs", "J23 C13", """WITH p AS (SELECT o_orderkey AS k, unnest([0, 1]) AS l, unnest([o_orderkey % 3, o_orderkey % 4]) AS r FROM orders)
SELECT k, 'l' || l AS left_id, 'r' || r AS right_id, 'left ' || l AS left_text, 'right ' || r AS right_text FROM p WHERE r < 2""")
def _(spark, sf):
    k = F.col("o_orderkey")
    o = T.table(spark, sf, "orders")
    value = F.concat(F.lit('{"l0":"r'), (k % 3).cast("string"), F.lit('","l1":"r'), (k % 4).cast("string"), F.lit('","n":3}'))
    answers = o.select(k.alias("k"), value.alias("value"))
    sides = [F.struct(F.lit(s).alias("side"), F.lit(f"{s[0]}{i}").alias("id"), F.lit(f"{s} {i}").alias("text")) for s in ("left", "right") for i in (0, 1)]
    items = o.select(k.alias("k"), F.explode(F.array(*sides)).alias("x")).select("k", "x.*")
    return G.matched_pairs(answers, items, ["k"]).select("k", "left_id", "right_id", "left_text", "right_text")


@query("exercise_progress", "A5 C14", """SELECT o_orderkey // 4 AS exercise_id, CAST(sum(o_orderkey % 4) AS BIGINT) AS ordered, CAST(sum(4) AS BIGINT) AS total FROM orders GROUP BY 1""")
def _(spark, sf):
    from leafgrade.operators.lessons import exercise_progress
    k = F.col("o_orderkey")
    o = T.table(spark, sf, "orders")
    base = o.select(F.floor(k / 64).alias("book_id"), (k % 64).cast("int").alias("page_number"), k.cast("string").alias("id"),
                    F.floor(k / 4).alias("exercise_id"), F.lit("sentence-ordering").alias("kind"), F.lit(4).alias("n_items"), k.alias("k"))
    value = F.array_join(F.slice(F.array(*[F.lit(f"i{i}") for i in range(4)]), F.lit(1), (F.col("k") % 4).cast("int")), ",")
    answers = base.select("book_id", "page_number", F.col("id").alias("interaction_id"), F.lit("me").alias("learner_id"), value.alias("value"))
    # the four orders of an exercise share a book but are pages of their own
    p = exercise_progress(answers, base, ["book_id", "page_number"])
    return p.groupBy("exercise_id").agg(F.sum("ordered").alias("ordered"), F.sum("total").alias("total"))
