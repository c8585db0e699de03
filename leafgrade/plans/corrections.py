"""Whole lifecycles as one query each: corrections from page documents to unit totals, requests from their context to their outcome."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafgrade import schemas as SC
from leafgrade.operators import allocate as K
from leafgrade.operators import context as CX
from leafgrade.operators import events as E
from leafgrade.operators import flatten as P
from leafgrade.operators import grading as G
from leafgrade.operators import units as U
from leafgrade.plans import tables as T
from leafgrade.plans.documents import documents
from leafgrade.plans.registry import query

#: Units of five editions, sixteen pages a book, answer blocks of none to three items, and the walk of pages over blocks.
WALK = f"""WITH RECURSIVE {T.LINES},
pages AS (SELECT doc_id, doc_id // 16 AS book, doc_id % 16 + 1 AS page, doc_id % 16 + 3 AS printed, (doc_id // 16) % 5 AS prof FROM documents),
un AS (SELECT r_regionkey AS prof, u, 3 + (u - 1) * (3 + r_regionkey % 2) AS start, CASE WHEN u < 4 THEN 3 + u * (3 + r_regionkey % 2) ELSE 17 END AS stop FROM region, (SELECT unnest([1, 2, 3, 4]) AS u)),
pu AS (SELECT pages.*, u FROM pages LEFT JOIN un ON un.prof = pages.prof AND printed >= start AND printed < stop AND printed < 17 AND NOT (pages.prof % 3 = 0 AND printed = 8)),
it AS (SELECT doc_id, len % 11 AS fam, count(*) AS c FROM ln WHERE len % 11 < 6 GROUP BY 1, 2),
at_ AS (SELECT pu.book, pu.page, pu.u, it.fam, it.c, pu.book || '/' || pu.u || '/' || it.fam AS key FROM pu JOIN it USING (doc_id)),
pg AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY page) AS p FROM at_ WHERE u IS NOT NULL),
bl AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY marker NULLS FIRST, doc_id) AS b FROM (SELECT doc_id, (doc_id // 16) || '/' || (doc_id % 4 + 1) || '/' || f AS key, (n_chars + f) % 4 AS size,
  CASE WHEN n_chars % 3 > 0 THEN CAST(n_chars % 3 AS VARCHAR) END AS marker FROM documents, (SELECT unnest([0, 1, 2, 3, 4, 5]) AS f))),
np AS (SELECT p.key, max(p) AS n, coalesce(any_value(k.n), 0) AS blocks FROM pg p LEFT JOIN (SELECT key, max(b) AS n FROM bl GROUP BY 1) k USING (key) GROUP BY 1),
walk AS (
 SELECT key, 1 AS p, 1 AS b, 0 AS used, false AS amb, false AS done FROM np
 UNION ALL
 SELECT * FROM (
  SELECT w.key, CASE WHEN stop THEN w.p + 1 ELSE w.p END AS p, CASE WHEN stop THEN w.b ELSE w.b + 1 END AS b,
   CASE WHEN stop THEN 0 ELSE w.used + bl.size END AS used, CASE WHEN stop THEN false ELSE w.amb OR bl.size = 0 END AS amb, w.p > np.n AS done
  FROM walk w JOIN np USING (key) LEFT JOIN pg ON pg.key = w.key AND pg.p = w.p LEFT JOIN bl ON bl.key = w.key AND bl.b = w.b,
  LATERAL (SELECT w.b > np.blocks OR w.used >= pg.c OR (bl.size > 0 AND w.used + bl.size > pg.c) AS stop) s WHERE w.p <= np.n)
),
ends AS (SELECT key, p, max(b) AS b, max(used) AS used, bool_or(amb) AS amb FROM walk GROUP BY 1, 2),
res AS (SELECT pg.*, e.used, e.amb OR (e.b <= np.blocks AND e.used < pg.c) AS rest FROM pg JOIN ends e USING (key, p) JOIN np USING (key)),
slot AS (SELECT book, u, page, unnest(generate_series(0, c - 1)) AS o, used, rest FROM res UNION ALL SELECT book, NULL, page, unnest(generate_series(0, c - 1)), 0, false FROM at_ WHERE u IS NULL)"""


def correction_slots(spark, sf):
    """Every interaction of every page with what the answer key says about it."""
    docs = documents(spark, sf)
    r, d = T.table(spark, sf, "region"), T.table(spark, sf, "documents")
    edition = F.col("r_regionkey")
    profiles = r.select(edition.alias("profile_id"), F.lit(2).alias("printed_offset"), F.lit(15).alias("solution_from"), F.lit(16).alias("solution_to"))
    units = r.select(edition.alias("profile_id"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("unit_number"), edition.alias("_r")).select(
        "profile_id", F.col("unit_number").alias("position"), "unit_number", F.lit("Lektion").alias("title"), (3 + (F.col("unit_number") - 1) * (3 + F.col("_r") % 2)).cast("int").alias("printed_start"))
    excluded = r.where("r_regionkey % 3 = 0").select(edition.alias("profile_id"), F.lit(8).alias("range_from"), F.lit(8).alias("range_to"))
    book = F.floor(F.col("doc_id") / 16)
    pages = d.select(book.cast("string").alias("book_id"), (F.col("doc_id") % 16 + 1).cast("int").alias("page_number"), (book % 5).cast("int").alias("profile_id"))
    entries = d.select("doc_id", "n_chars", F.posexplode(F.array(*map(F.lit, SC.KIND_ORDER))).alias("f", "kind"))
    size = (F.col("n_chars") + F.col("f")) % 4
    items = F.transform(F.slice(F.array(F.lit(0), F.lit(1), F.lit(2)), F.lit(1), size.cast("int")),
                        lambda i: F.concat_ws("-", F.lit("v"), F.col("doc_id").cast("string"), F.col("f").cast("string"), i.cast("string")))
    entries = entries.select(book.cast("string").alias("book_id"), (F.col("doc_id") % 4 + 1).cast("int").alias("unit_number"), "kind",
                             F.when(F.col("n_chars") % 3 > 0, (F.col("n_chars") % 3).cast("string")).alias("marker"), F.col("doc_id").alias("ordinal"), items.alias("items"))
    located = U.resolve_unit(pages, profiles, units, excluded)
    interactions = P.explode_interactions(docs).select("book_id", "page_number", "kind", "ordinal", "id")
    return K.resolve_corrections(located, interactions, entries)


@query("correction_units", "J1 P2 K2 T1 J9 G4 A4 A3", f"""{WALK} SELECT CAST(book AS VARCHAR) AS book_id, CAST(u AS INT) AS unit_number, count(*) FILTER (WHERE o < used AND (page + o) % 3 <> 0 AND (page + o) % 5 <> 0) AS total_correct,
 count(*) FILTER (WHERE o < used) AS total_gradable, bool_or(o < used) AS checked, count(*) FILTER (WHERE o >= used AND rest) AS ambiguous, count(*) FILTER (WHERE o >= used AND NOT rest) AS unmapped FROM slot GROUP BY 1, 2""")
def _(spark, sf):
    """From page documents to the totals of each unit; interactions outside any unit stand under no unit."""
    slots = correction_slots(spark, sf)
    turn = F.col("page_number") + F.col("ordinal")
    learner = F.when(turn % 3 == 0, "wrong").when(turn % 5 == 0, "  ").otherwise(F.concat(F.lit("  "), F.upper("expected_value"), F.lit(" ")))
    result = G.compare_blank(learner, F.col("expected_value").isNotNull(), F.col("expected_value"), F.array().cast("array<string>"), F.lit(False), compose=False)
    graded = slots.withColumn("r", result).withColumn("verdict", F.when(F.col("resolution") == "RESOLVED", F.col("r.verdict")))
    return G.verdict_totals(graded, ["book_id", "unit_number"], F.count_if(F.col("resolution") == "AMBIGUOUS").alias("ambiguous"),
                            F.count_if(F.col("resolution") == "UNMAPPED").alias("unmapped"))


@query("request_lifecycle", "E8 K6 E5 E6 E7", f"""WITH {T.EVENTS}, {T.LINES}, n AS (SELECT doc_id, count(*) AS n FROM ln GROUP BY 1),
r AS (SELECT event_id, ts, user_id, k, CASE WHEN event_type = 'view' THEN 'check' ELSE 'explain' END AS action, event_id % 17 <> 0 AS ok,
   event_id % (SELECT max(doc_id) + 1 FROM documents) AS doc_id FROM ev WHERE event_type IN ('view', 'error', 'click')),
x AS (SELECT r.*, len % 11 = 5 AS ctx FROM r JOIN n USING (doc_id) JOIN ln ON ln.doc_id = r.doc_id AND ln.i = CAST(r.event_id * 7919 % n.n AS INT)),
v AS (SELECT *, EXISTS (SELECT 1 FROM ev s WHERE s.user_id = x.user_id AND s.event_type = 'signup' AND s.ts <= x.ts AND s.ts + INTERVAL 600 MINUTE > x.ts) AS ver,
  EXISTS (SELECT 1 FROM ev w WHERE w.event_type = 'purchase' AND w.k = x.k AND (CASE WHEN w.event_id % 2 = 0 THEN 'check' ELSE 'explain' END) = x.action AND w.ts <= x.ts
   AND w.ts + (CASE WHEN x.action = 'check' THEN INTERVAL 1 HOUR ELSE INTERVAL 7 DAY END) > x.ts) AS hit FROM x),
w AS (SELECT *, CAST(ts AS DATE) AS d FROM v WHERE ctx AND ver AND NOT hit),
s AS (SELECT *, row_number() OVER (PARTITION BY user_id, d ORDER BY ts, event_id) <= 1 AS pass FROM w),
q AS (SELECT *, sum(CASE WHEN pass THEN 1 ELSE 0 END) OVER (PARTITION BY d ORDER BY ts, event_id) AS n FROM s)
SELECT v.event_id, CASE WHEN NOT ctx THEN 'invalid_context' WHEN NOT ver THEN 'verification_required' WHEN hit THEN 'success' WHEN NOT pass OR n > 5 THEN 'limit_reached'
  WHEN v.ok THEN 'success' ELSE 'unavailable' END AS status, ctx AND ver AND hit AS cached FROM v LEFT JOIN (SELECT event_id, pass, n FROM q) USING (event_id)""")
def _(spark, sf):
    """Requests about a line of a page: its context, the human check, the cache, the quota and the provider decide."""
    ev, d = T.events(spark, sf), T.table(spark, sf, "documents")
    e, k = F.col("event_id"), F.col("k").cast("string")
    per_page = d.select(F.col("doc_id").alias("doc"), F.size(F.split("text", "\n")).alias("n"))
    action = F.when(F.col("event_type") == "view", "check").otherwise("explain")
    asked = ev.where(F.col("event_type").isin("view", "error", "click")).withColumn("doc", e % d.agg(F.max("doc_id") + 1).scalar()).join(per_page, "doc")
    asked = asked.select(
        e.alias("request_id"), "ts", F.col("user_id").alias("session_id"), F.floor(F.col("doc") / 16).cast("string").alias("book_id"),
        (F.col("doc") % 16 + 1).cast("int").alias("page_number"), F.concat(F.lit("free-"), (e * 7919 % F.col("n")).cast("string")).alias("exercise_id"),
        action.alias("action"), F.lit(None).cast("string").alias("target_language"), F.lit(False).alias("has_selection"),
        F.lit(None).cast("string").alias("question"), F.lit("a").alias("answer"), (e % 17 != 0).alias("provider_ok"),
        F.concat_ws("|", action, k).alias("cache_key"))
    docs = documents(spark, sf)
    books = d.select(F.floor(F.col("doc_id") / 16).cast("string").alias("book_id")).distinct().select(
        "book_id", F.concat(F.lit("Buch "), F.col("book_id")).alias("title"), F.lit("de").alias("source_language"))
    slots = P.explode_interactions(docs).select("book_id", "page_number", "kind", "ordinal", F.lit("UNMAPPED").alias("resolution"))
    known = CX.build_context(asked, docs, books, slots).select(*asked.columns, "context_ok", "source_backed")
    wrote = F.when(e % 2 == 0, "check").otherwise("explain")
    writes = ev.where("event_type = 'purchase'").select("ts", wrote.alias("action"), F.concat_ws("|", wrote, k).alias("cache_key"))
    marks = ev.where("event_type = 'signup'").select(F.col("user_id").alias("session_id"), "ts")
    out = E.request_outcome(known, writes, 1, 5, verifications=marks, verify_minutes=600)
    return out.select(F.col("request_id").alias("event_id"), "status", "cached")
