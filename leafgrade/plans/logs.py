"""Event-log queries: quota, cache, verification, processing state and answers.

Users act as sessions, pages or learners. Days and hours cut hot keys.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from leafgrade.operators import events as E
from leafgrade.operators import quality as Q
from leafgrade.operators.answer_key import key_refresh
from leafgrade.operators.lessons import lesson_position
from leafgrade.operators.scans import latest_wins
from leafgrade.plans import tables as T
from leafgrade.plans.registry import query
from leafgrade.sources.sinks import upsert_latest

EV = T.EVENTS
STATUS = """CASE event_type WHEN 'click' THEN 'PENDING' WHEN 'view' THEN 'OCR' WHEN 'signup' THEN 'PERSISTING' WHEN 'purchase' THEN 'READY' ELSE 'FAILED' END"""


def _hour():
    return F.floor(F.unix_micros("ts") / 3_600_000_000)


def _requests(spark, sf):
    return T.events(spark, sf).select(F.col("event_id").alias("request_id"), "ts", F.col("user_id").alias("session_id"), "event_type", "k")


def _status_log(spark, sf):
    names = {"click": "PENDING", "view": "OCR", "signup": "PERSISTING", "purchase": "READY", "error": "FAILED"}
    status = F.lit(None).cast("string")
    for event, stage in names.items():
        status = F.when(F.col("event_type") == event, stage).otherwise(status)
    return T.events(spark, sf).select("user_id", "event_id", "ts", status.alias("status"), "k")


# ---- quota ---------------------------------------------------------------------

QUOTA = f"""WITH r AS (SELECT event_id, ts, user_id, CAST(ts AS DATE) AS d FROM events),
s AS (SELECT *, row_number() OVER (PARTITION BY user_id, d ORDER BY ts, event_id) <= 3 AS pass FROM r),
g AS (SELECT *, sum(CASE WHEN pass THEN 1 ELSE 0 END) OVER (PARTITION BY d ORDER BY ts, event_id) AS n FROM s),
q AS (SELECT event_id, user_id, d, CASE WHEN NOT pass THEN 'SESSION_LIMIT_REACHED' WHEN n > 100 THEN 'GLOBAL_LIMIT_REACHED' ELSE 'ALLOWED' END AS outcome FROM g)"""


@query("quota_admission", "E5 C25", f"{QUOTA} SELECT event_id, d AS usage_date, outcome FROM q")
def _(spark, sf):
    return E.admit_quota(_requests(spark, sf), 3, 100).select(F.col("request_id").alias("event_id"), "usage_date", "outcome")


@query("quota_snapshot", "A14", f"""{QUOTA} SELECT user_id AS session_id, d AS usage_date, count(*) FILTER (WHERE outcome <> 'SESSION_LIMIT_REACHED') AS used,
 CAST(3 AS BIGINT) AS session_limit, greatest(0, 3 - count(*) FILTER (WHERE outcome <> 'SESSION_LIMIT_REACHED')) AS remaining FROM q GROUP BY 1, 2""")
def _(spark, sf):
    return E.session_quota_snapshot(_requests(spark, sf), 3)


@query("daily_usage", "A15", f"{QUOTA} SELECT d AS usage_date, count(*) AS provider_calls FROM q WHERE outcome = 'ALLOWED' GROUP BY 1")
def _(spark, sf):
    return E.daily_usage(E.admit_quota(_requests(spark, sf), 3, 100))


@query("quota_today", "A14", f"""{QUOTA}, u AS (SELECT user_id, count(*) FILTER (WHERE outcome <> 'SESSION_LIMIT_REACHED') AS used FROM q WHERE d = (SELECT max(d) FROM q) GROUP BY 1)
SELECT s.user_id AS session_id, coalesce(u.used, 0) AS used, CAST(3 AS BIGINT) AS session_limit, greatest(0, 3 - coalesce(u.used, 0)) AS remaining
FROM (SELECT DISTINCT user_id FROM events) s LEFT JOIN u USING (user_id)""")
def _(spark, sf):
    """What every session sees on the last day of the log."""
    today = T.events(spark, sf).agg(F.to_date(F.max("ts"))).scalar()
    return E.quota_today(_requests(spark, sf), today, 3)


# ---- as-of lookups -------------------------------------------------------------

@query("verified_requests", "E7", """SELECT e.event_id, EXISTS (SELECT 1 FROM events v WHERE v.user_id = e.user_id AND v.event_type = 'signup' AND v.ts <= e.ts
 AND v.ts + INTERVAL 30 MINUTE > e.ts) AS verified FROM events e WHERE e.event_type <> 'signup'""")
def _(spark, sf):
    r = _requests(spark, sf)
    out = E.session_verified(r.where("event_type <> 'signup'"), r.where("event_type = 'signup'"))
    return out.select(F.col("request_id").alias("event_id"), "verified")


@query("cache_hits", "E6", f"""WITH {EV} SELECT e.event_id, EXISTS (SELECT 1 FROM ev w WHERE w.k = e.k AND w.event_type = 'purchase' AND w.ts <= e.ts
 AND w.ts + INTERVAL 1 HOUR > e.ts) AS hit FROM ev e WHERE e.event_type <> 'purchase'""")
def _(spark, sf):
    r = _requests(spark, sf).withColumn("cache_key", F.col("k")).withColumn("action", F.lit("check"))
    out = E.cache_hits_from_writes(r.where("event_type <> 'purchase'"), r.where("event_type = 'purchase'"))
    return out.select(F.col("request_id").alias("event_id"), "hit")


@query("cache_replay", "E6", f"""WITH RECURSIVE {EV},
r AS (SELECT event_id, ts, k || event_type AS key, event_type <> 'error' AS ok, CASE WHEN event_type = 'click' THEN INTERVAL 1 HOUR ELSE INTERVAL 7 DAY END AS ttl FROM ev),
n AS (SELECT DISTINCT key, ts, ttl FROM r WHERE ok),
a AS (SELECT key, ttl, min(ts) AS t FROM n GROUP BY 1, 2
 UNION ALL SELECT a.key, a.ttl, (SELECT min(n.ts) FROM n WHERE n.key = a.key AND n.ts >= a.t + a.ttl) AS t FROM a
  WHERE EXISTS (SELECT 1 FROM n WHERE n.key = a.key AND n.ts >= a.t + a.ttl)),
w AS (SELECT a.key, a.ttl, a.t, min(r.event_id) AS writer FROM a JOIN r ON r.key = a.key AND r.ts = a.t AND r.ok GROUP BY 1, 2, 3)
SELECT r.event_id, EXISTS (SELECT 1 FROM w WHERE w.key = r.key AND (w.t < r.ts OR (w.t = r.ts AND w.writer < r.event_id)) AND r.ts < w.t + w.ttl) AS hit FROM r""")
def _(spark, sf):
    r = _requests(spark, sf).select("request_id", "ts", F.concat(F.col("k").cast("string"), F.col("event_type")).alias("cache_key"),
                                    F.when(F.col("event_type") == "click", "check").otherwise("hint").alias("action"),
                                    (F.col("event_type") != "error").alias("provider_ok"))
    return E.cache_replay(r).select(F.col("request_id").alias("event_id"), "hit")


@query("request_gate", "E8", """SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'invalid_request' WHEN user_id % 5 = 0 AND event_id % 2 = 0 THEN 'invalid_context'
 WHEN user_id % 5 = 0 AND event_type IN ('click', 'view') THEN 'not_applicable' WHEN event_type = 'signup' AND event_id % 3 = 0 THEN 'not_applicable'
 WHEN event_id % 13 = 0 THEN 'invalid_context' WHEN event_type = 'view' AND event_id % 7 = 0 THEN 'not_applicable' END AS status FROM events""")
def _(spark, sf):
    e, u = F.col("event_id"), F.col("user_id")
    action = (F.when(e % 11 == 0, "sing").when(F.col("event_type") == "click", "hint").when(F.col("event_type") == "view", "check")
              .when(F.col("event_type") == "signup", "ask").when(F.col("event_type") == "purchase", "translate").otherwise("explain"))
    rows = T.events(spark, sf).withColumns({
        "action": action, "target_language": F.lit(" ES "), "has_selection": u % 5 == 0,
        "exercise_id": F.when(e % 2 == 0, "x"), "question": F.when(e % 3 == 0, " ").otherwise("why?"), "answer": F.lit("a"),
        "context_ok": e % 13 != 0, "source_backed": e % 7 == 0})
    return rows.select("event_id", E.request_gate().alias("status"))


@query("request_outcomes", "E8 E5 E6 E7", f"""WITH {EV},
r AS (SELECT event_id, ts, user_id, k, CASE WHEN event_type = 'view' THEN 'check' ELSE 'explain' END AS action, event_id % 13 <> 0 AS ctx, event_id % 17 <> 0 AS ok
  FROM ev WHERE event_type IN ('view', 'error', 'click')),
v AS (SELECT *, EXISTS (SELECT 1 FROM ev s WHERE s.user_id = r.user_id AND s.event_type = 'signup' AND s.ts <= r.ts AND s.ts + INTERVAL 600 MINUTE > r.ts) AS ver,
  EXISTS (SELECT 1 FROM ev w WHERE w.event_type = 'purchase' AND w.k = r.k AND (CASE WHEN w.event_id % 2 = 0 THEN 'check' ELSE 'explain' END) = r.action AND w.ts <= r.ts
   AND w.ts + (CASE WHEN r.action = 'check' THEN INTERVAL 1 HOUR ELSE INTERVAL 7 DAY END) > r.ts) AS hit FROM r),
w AS (SELECT *, CAST(ts AS DATE) AS d FROM v WHERE ctx AND ver AND NOT hit),
s AS (SELECT *, row_number() OVER (PARTITION BY user_id, d ORDER BY ts, event_id) <= 1 AS pass FROM w),
q AS (SELECT *, sum(CASE WHEN pass THEN 1 ELSE 0 END) OVER (PARTITION BY d ORDER BY ts, event_id) AS n FROM s)
SELECT v.action, CASE WHEN NOT ctx THEN 'invalid_context' WHEN NOT ver THEN 'verification_required' WHEN hit THEN 'success' WHEN NOT pass OR n > 20 THEN 'limit_reached'
  WHEN v.ok THEN 'success' ELSE 'unavailable' END AS status, count(*) AS requests, count(*) FILTER (WHERE ctx AND ver AND hit) AS cached
FROM (SELECT v.*, q.pass, q.n FROM v LEFT JOIN q USING (event_id)) v GROUP BY 1, 2""")
def _(spark, sf):
    r = _requests(spark, sf)
    e = F.col("request_id")
    key = F.concat_ws("|", F.col("action"), F.col("k").cast("string"))
    requests = r.where(F.col("event_type").isin("view", "error", "click")).withColumns({
        "action": F.when(F.col("event_type") == "view", "check").otherwise("explain"), "target_language": F.lit(None).cast("string"),
        "has_selection": F.lit(False), "exercise_id": F.lit("x"), "question": F.lit(None).cast("string"), "answer": F.lit("a"),
        "context_ok": e % 13 != 0, "source_backed": F.lit(False), "provider_ok": e % 17 != 0}).withColumn("cache_key", key)
    writes = r.where("event_type = 'purchase'").withColumn("action", F.when(e % 2 == 0, "check").otherwise("explain")).withColumn("cache_key", key)
    out = E.request_outcome(requests, writes, 1, 20, verifications=r.where("event_type = 'signup'"), verify_minutes=600)
    return E.outcome_report(out)


# ---- processing log ------------------------------------------------------------

@query("page_state", "E1", f"""SELECT user_id, arg_max({STATUS}, (ts, event_id)) AS status, max(ts) AS ts FROM events GROUP BY 1""")
def _(spark, sf):
    return E.page_state(_status_log(spark, sf), ["user_id"], ["ts", "event_id"]).select("user_id", "status", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("claims", "E1", f"""WITH {EV}, l AS (SELECT user_id, event_id, ts, CASE WHEN event_type <> 'click' THEN {STATUS} END AS st, k % 2 = 0 AS refresh FROM ev),
s AS (SELECT *, last_value(st IGNORE NULLS) OVER w AS cur, count(st) OVER w AS seg FROM l WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
e AS (SELECT *, st IS NULL AND (cur IS NULL OR cur = 'FAILED' OR (cur = 'READY' AND refresh)) AS el FROM s),
c AS (SELECT *, sum(CASE WHEN el THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, seg ORDER BY ts, event_id) AS n FROM e)
SELECT user_id, event_id, el AND n = 1 AS granted FROM c WHERE st IS NULL""")
def _(spark, sf):
    log = _status_log(spark, sf).withColumn("status", F.when(F.col("status") != "PENDING", F.col("status"))).withColumn(
        "refresh", F.col("k") % 2 == 0)
    return E.claim_replay(log, ["user_id"], ["ts", "event_id"], _hour()).select("user_id", "event_id", "granted")


STEPS = f"""WITH s AS (SELECT user_id, event_id, ts, {STATUS} AS status FROM events),
t AS (SELECT *, lead(status) OVER w AS next_status, epoch_us(lead(ts) OVER w) - epoch_us(ts) AS micros FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


def _steps(spark, sf):
    return E.stage_steps(_status_log(spark, sf), ["user_id"], ["ts", "event_id"], _hour())


@query("stage_steps", "E2", f"{STEPS} SELECT event_id, status, next_status, micros FROM t")
def _(spark, sf):
    return _steps(spark, sf).select("event_id", "status", "next_status", "micros")


@query("stage_durations", "E2", f"{STEPS} SELECT status, count(*) AS n, round(sum(micros) / count(*), 3) AS mean_micros FROM t WHERE micros IS NOT NULL GROUP BY 1")
def _(spark, sf):
    return E.stage_durations(_steps(spark, sf)).select("status", "n", F.round("mean_micros", 3).alias("mean_micros"))


@query("stage_percentiles", "E2", f"""{STEPS} SELECT status, quantile_disc(micros, 0.5) AS p50, quantile_disc(micros, 0.95) AS p95 FROM t WHERE micros IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    return E.stage_percentiles(_steps(spark, sf), {"p50": 0.5, "p95": 0.95})


@query("page_funnel", "E2", f"SELECT {STATUS} AS status, count(DISTINCT user_id) AS pages FROM events GROUP BY 1")
def _(spark, sf):
    return E.stage_funnel(_status_log(spark, sf), ["user_id"])


@query("illegal_transitions", "E2", f"""{STEPS} SELECT status, next_status, count(*) AS n FROM t WHERE next_status IS NOT NULL AND next_status <> 'FAILED'
 AND NOT (next_status = 'PENDING' AND status IN ('FAILED', 'READY')) AND NOT (status = 'PERSISTING' AND next_status = 'READY') GROUP BY 1, 2""")
def _(spark, sf):
    return E.illegal_transitions(_steps(spark, sf)).groupBy("status", "next_status").agg(F.count("*").alias("n"))


@query("stuck_pages", "E3", f"""WITH s AS (SELECT user_id, arg_max({STATUS}, (ts, event_id)) AS status, max(ts) AS ts FROM events GROUP BY 1)
SELECT user_id, status FROM s WHERE status IN ('PENDING', 'OCR', 'PERSISTING') AND epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(ts) > 3600000000""")
def _(spark, sf):
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    return E.stuck_pages(_status_log(spark, sf), ["user_id"], ["ts", "event_id"], now, 3600).select("user_id", "status")


@query("status_rename", "E4", """SELECT event_id, CASE event_type WHEN 'click' THEN 'OCR' WHEN 'view' THEN 'DETECTING_INTERACTIONS' ELSE event_type END AS status FROM events""")
def _(spark, sf):
    t = F.col("event_type")
    old = F.when(t == "click", "PROCESSING").when(t == "view", "DETECTING_BLANKS").otherwise(t)
    return T.events(spark, sf).select("event_id", E.status_rename(old).alias("status"))


# ---- answers -------------------------------------------------------------------

def _answer_log(spark, sf):
    return T.events(spark, sf).select("user_id", "event_type", "ts", "event_id", F.when(F.col("k") % 10 != 0, F.col("props")).otherwise("").alias("value"))


LATEST = f"""WITH {EV}, l AS (SELECT user_id, event_type, arg_max(CASE WHEN k % 10 = 0 THEN '' ELSE props END, (ts, event_id)) AS value, max(ts) AS ts FROM ev GROUP BY 1, 2)"""


@query("answers_latest", "E9 W15 U4", f"{LATEST} SELECT user_id, event_type, value FROM l WHERE value <> ''")
def _(spark, sf):
    return E.latest_answers(_answer_log(spark, sf), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "value")


@query("current_answers", "E9 J19 U4", f"""{LATEST} SELECT user_id, event_type, value FROM l WHERE value <> '' AND user_id % 3 <> 0 AND (user_id % 5 = 0 OR user_id % 2 = 0)""")
def _(spark, sf):
    """From the log to valid answers in one call."""
    u = F.col("user_id")
    log = _answer_log(spark, sf).withColumns({"learner_id": u, "book_id": u, "page_number": F.lit(1), "interaction_id": F.col("event_type"),
                                              "fingerprint": F.lit("f0"), "kind": F.when(u % 2 == 0, "matching").otherwise("choice")})
    prints = T.events(spark, sf).select(u.alias("book_id"), F.lit(1).alias("page_number"), F.col("event_type").alias("id"),
                                        F.when(u % 5 == 0, "fill-blank").otherwise("matching").alias("store_kind"),
                                        F.concat(F.lit("f"), F.when(u % 3 == 0, "1").otherwise("0")).alias("fingerprint")).distinct()
    return E.current_answers(log, prints, order=["ts", "event_id"]).select(F.col("learner_id").alias("user_id"), "event_type", "value")


@query("valid_answers", "J19", f"""{LATEST} SELECT user_id, event_type, value FROM l WHERE value <> '' AND user_id % 3 <> 0 AND (user_id % 5 = 0 OR user_id % 2 = 0)""")
def _(spark, sf):
    """Interactions exist for every (user, type); fingerprints differ for every third user and kinds for odd ones."""
    u = F.col("user_id")
    latest = E.latest_answers(_answer_log(spark, sf), ["user_id", "event_type"], ["ts", "event_id"])
    answers = latest.withColumns({"book_id": u, "page_number": F.lit(1), "interaction_id": F.col("event_type"), "fingerprint": F.lit("f0"),
                                  "kind": F.when(u % 2 == 0, "matching").otherwise("choice")})
    prints = T.events(spark, sf).select(u.alias("book_id"), F.lit(1).alias("page_number"), F.col("event_type").alias("id"),
                                        F.when(u % 5 == 0, "fill-blank").otherwise("matching").alias("store_kind"),
                                        F.concat(F.lit("f"), F.when(u % 3 == 0, "1").otherwise("0")).alias("fingerprint")).distinct()
    return E.valid_answers(answers, prints).select("user_id", "event_type", "value")


@query("revealed_items", "J20", """SELECT event_id FROM events WHERE event_id % 2 = 0 AND CAST(json_extract_string(props, '$.k') AS INT) IN (SELECT CAST(p_partkey % 40 AS INT) FROM part WHERE p_size > 25)""")
def _(spark, sf):
    key = {"book_id": F.lit("b"), "page_number": F.lit(1)}
    bits = T.events(spark, sf).withColumns({**key, "interaction_id": F.col("k").cast("long"), "revealed": F.col("event_id") % 2 == 0})
    ids = T.table(spark, sf, "part").where("p_size > 25").select((F.col("p_partkey") % 40).alias("id")).withColumns(key)
    return E.reveal_semi_join(bits, ids).select("event_id")


@query("upserted_state", "S7 W15", """WITH o AS (SELECT c_custkey AS k, c_name AS name, c_acctbal AS bal FROM customer),
n AS (SELECT user_id AS k, arg_max(event_type, (ts, event_id)) AS name, arg_max(value, (ts, event_id)) AS bal FROM events GROUP BY 1)
SELECT coalesce(o.k, n.k) AS k, coalesce(o.name, n.name) AS name, CASE WHEN n.k IS NULL THEN o.bal ELSE n.bal END AS bal FROM o FULL JOIN n ON o.k = n.k""")
def _(spark, sf):
    old = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"))
    new = T.events(spark, sf).select(F.col("user_id").alias("k"), F.col("event_type").alias("name"), F.col("value").alias("bal"), "ts", "event_id")
    return upsert_latest(old, new, ["k"], ["bal"], ["ts", "event_id"])


@query("lesson_positions", "E10 A17", f"""WITH {EV}, l AS (SELECT user_id, arg_max('step-' || k % 7, (ts, event_id)) AS s FROM ev GROUP BY 1)
SELECT user_id, CASE WHEN s IN ('step-5', 'step-6') THEN 'step-0' ELSE s END AS step_id,
 CASE s WHEN 'step-0' THEN 25.0 WHEN 'step-1' THEN 50.0 WHEN 'step-2' THEN 75.0 WHEN 'step-3' THEN 100.0 WHEN 'step-4' THEN 100.0 ELSE 25.0 END AS progress FROM l""")
def _(spark, sf):
    ev = T.events(spark, sf)
    page = {"book_id": F.lit("b"), "page_number": (F.col("user_id") % 97).cast("int") + 1}
    saved = ev.select(F.col("user_id").alias("learner_id"), F.concat(F.lit("step-"), (F.col("k") % 7).cast("string")).alias("step_id"), "ts",
                      "event_id", *[c.alias(n) for n, c in page.items()])
    # the step list of each page comes from the regions: four activities and a completion
    r = T.table(spark, sf, "region")
    i = F.col("r_regionkey")
    steps = r.select(F.concat(F.lit("step-"), i.cast("string")).alias("id"), i.alias("step_index"), F.when(i < 4, "activity").otherwise("completion").alias("kind"),
                     i.alias("activity_index"), F.lit(4).alias("activity_count"), F.lit("b").alias("book_id"),
                     F.explode(F.sequence(F.lit(1), F.lit(97))).alias("page_number"))
    out = lesson_position(saved, steps, order=["ts", "event_id"])
    return out.select(F.col("learner_id").alias("user_id"), "step_id", "progress")


@query("key_refreshes", "E11", """WITH v AS (SELECT user_id AS book_id, (ts, event_id) AS ver, event_id, event_type IN ('purchase', 'view') AS ready, event_type = 'click' AS refresh FROM events),
a AS (SELECT book_id, max(ver) FILTER (WHERE ready) AS r, max(ver) FILTER (WHERE NOT ready AND NOT refresh) AS f, arg_max(event_id, ver) FILTER (WHERE ready) AS e FROM v GROUP BY 1)
SELECT book_id, CASE WHEN r IS NOT NULL AND (f IS NULL OR f < r) THEN 'READY' ELSE 'FAILED' END AS status, e AS entries FROM a""")
def _(spark, sf):
    v = T.events(spark, sf).select(F.col("user_id").alias("book_id"), F.struct("ts", "event_id").alias("version"),
                                   F.when(F.col("event_type").isin("purchase", "view"), "READY").otherwise("FAILED").alias("status"),
                                   (F.col("event_type") == "click").alias("refresh"), F.col("event_id").alias("entries"))
    return key_refresh(v).select("book_id", "status", "entries")


# ---- quality -------------------------------------------------------------------

@query("integrity_checks", "Q1 U3", """SELECT 'duplicate_line' AS rule, count(*) AS n FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)
UNION ALL SELECT 'unknown_document', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars > 1000)
UNION ALL SELECT 'unknown_customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def _(spark, sf):
    t = lambda n: T.table(spark, sf, n)
    dup = Q.duplicates(t("lineitem"), ["l_orderkey", "l_linenumber"]).select(F.lit("duplicate_line").alias("rule"))
    doc = Q.orphans(t("labels"), t("documents").where("n_chars > 1000"), ["doc_id"]).select(F.lit("unknown_document").alias("rule"))
    cust = Q.orphans(t("orders").withColumnRenamed("o_custkey", "c_custkey"), t("customer").where("c_acctbal > 0"), ["c_custkey"]).select(
        F.lit("unknown_customer").alias("rule"))
    return dup.unionByName(doc).unionByName(cust).groupBy("rule").agg(F.count("*").alias("n"))


@query("range_report", "Q2", """SELECT l_suppkey, rule, count(*) AS n FROM (SELECT l_suppkey, unnest(list_filter([CASE WHEN l_discount > 0.05 THEN 'discount' END,
 CASE WHEN l_quantity < 2 THEN 'quantity' END, CASE WHEN l_tax > 0.06 THEN 'tax' END], lambda x: x IS NOT NULL)) AS rule FROM lineitem) GROUP BY 1, 2""")
def _(spark, sf):
    rules = {"discount": F.col("l_discount") <= 0.05, "quantity": F.col("l_quantity") >= 2, "tax": F.col("l_tax") <= 0.06}
    return Q.range_report(T.table(spark, sf, "lineitem"), rules, ["l_suppkey"]).groupBy("l_suppkey", "rule").agg(F.count("*").alias("n"))


@query("latest_events", "W15", """SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1""")
def _(spark, sf):
    ev = T.events(spark, sf).select("user_id", "event_id", "ts")
    return latest_wins(ev, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id")
