"""Event-log operators against sequential replays, both cache paths, and the streams."""

import datetime as dt
import random

from pyspark.sql import functions as F

from leafgrade.operators import events as E
from leafgrade.operators import scans as SC
from leafgrade.streaming.batches import answer_batches, quota_batches, run_batches, stream_daily_usage
from leafgrade.streaming.pages import ROCKSDB, stream_page_state

T0 = dt.datetime(2024, 1, 1)


def log(spark, rng, n=400, sessions=4, seconds=200_000):
    rows = [(i, T0 + dt.timedelta(seconds=rng.randint(0, seconds)), f"s{min(rng.randint(0, sessions), rng.randint(0, sessions))}",
             f"k{rng.randint(0, 5)}", rng.choice(["hint", "check"]), rng.random() < 0.8) for i in range(n)]
    df = spark.createDataFrame(rows, "request_id long, ts timestamp, session_id string, cache_key string, action string, provider_ok boolean")
    return rows, df.withColumn("cache_key", F.concat("cache_key", "action"))


def test_quota_equals_replay(spark):
    rows, df = log(spark, random.Random(1))
    per_session, per_day, want = {}, {}, {}
    for i, ts, s, *_ in sorted(rows, key=lambda r: (r[1], r[0])):
        day = ts.date()
        if per_session.get((s, day), 0) >= 5:
            want[i] = "SESSION_LIMIT_REACHED"
            continue
        per_session[(s, day)] = per_session.get((s, day), 0) + 1
        if per_day.get(day, 0) >= 12:
            want[i] = "GLOBAL_LIMIT_REACHED"
            continue
        per_day[day] = per_day.get(day, 0) + 1
        want[i] = "ALLOWED"
    got = {r.request_id: r.outcome for r in E.admit_quota(df, 5, 12).collect()}
    assert got == want
    assert {r.outcome for r in E.admit_quota(df, 5, 0).select("outcome").distinct().collect()} == {"GLOBAL_LIMIT_REACHED"}
    assert {r.outcome for r in E.admit_quota(df, 0, 5).select("outcome").distinct().collect()} == {"SESSION_LIMIT_REACHED"}


def test_cache_replay_equals_replay(spark):
    rows, df = log(spark, random.Random(2), n=300, seconds=2_000_000)
    until, want = {}, {}
    for i, ts, _, k, action, ok in sorted(rows, key=lambda r: (r[1], r[0])):
        key = k + action
        want[i] = key in until and ts < until[key]
        if not want[i] and ok:
            until[key] = ts + (dt.timedelta(hours=1) if action == "check" else dt.timedelta(days=7))
    got = {r.request_id: r.hit for r in E.cache_replay(df).collect()}
    assert got == want


def test_cache_replay_of_a_hot_key_over_many_chunks(spark):
    rng = random.Random(7)
    times = sorted(rng.randint(0, 400) * 1000 + rng.choice([0, 0, 250, 999]) for _ in range(500))
    rows = [(i, T0 + dt.timedelta(milliseconds=t), "hot" if i % 9 else None, "ask", rng.random() < 0.7) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "request_id long, ts timestamp, cache_key string, action string, provider_ok boolean")
    for ttl in (1, 3, 20, 1000):
        until, want = None, {}
        for i, ts, k, _, ok in sorted(rows, key=lambda r: (r[1], r[0])):
            want[i] = k is not None and until is not None and ts < until
            if k is not None and not want[i] and ok:
                until = ts + dt.timedelta(seconds=ttl)
        assert {r.request_id: r.hit for r in E.cache_replay(df, ttl=F.lit(ttl * 1_000_000)).collect()} == want


def test_flags_without_keys_and_only_some_asking(spark):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    req = spark.createDataFrame([(1, at(10), "a"), (2, at(10), None), (3, at(2000), "a"), (4, at(5), "a")], "request_id long, ts timestamp, session_id string")
    marks = spark.createDataFrame([("a", at(6)), (None, at(6))], "session_id string, ts timestamp")
    got = {r.request_id: r.verified for r in E.session_verified(req, marks).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False}
    some = E.admit_quota(req.fillna("b", ["session_id"]), 1, 1, asks=F.col("request_id") != 4).collect()
    assert {r.request_id: r.outcome for r in some} == {1: "ALLOWED", 2: "GLOBAL_LIMIT_REACHED", 3: "SESSION_LIMIT_REACHED", 4: None}


def test_chunked_scans_equal_plain_windows(spark):
    rng = random.Random(3)
    rows = [(k, i, rng.randint(0, 9)) for k in "ab" for i in range(100)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    chunk = F.floor(F.col("i") / 7)
    lagged = SC.neighbour(df, ["k"], ["i"], F.col("v"), "p", chunk)
    summed = SC.running_sum(lagged, ["k"], ["i"], F.col("v"), "s", chunk)
    known = SC.last_known(summed, ["k"], ["i"], F.when(F.col("v") > 7, F.col("i")), "l", chunk)
    prev, total, last = {}, {}, {}
    got = {(r.k, r.i): (r.p, r.s, r.l) for r in known.collect()}
    for k, i, v in rows:
        total[k] = total.get(k, 0) + v
        if v > 7:
            last[k] = i
        assert got[(k, i)] == (prev.get(k), total[k], last.get(k))
        prev[k] = v
    top = {(r.k, r.i) for r in SC.first_k(df, ["k"], ["i"], 3, salts=4).collect()}
    assert top == {(k, i) for k in "ab" for i in range(3)}


def test_groups_and_claims_equal_replays(spark):
    rng = random.Random(11)
    rows = [(k, i, rng.choice([None, None, None, None, "READY", "FAILED", "OCR"]), rng.random() < 0.3) for k in "abc" for i in range(150)]
    df = spark.createDataFrame(rows, "k string, i int, status string, refresh boolean")
    runs, granted, number, state, last = {}, {}, {}, {}, {}
    for k, i, s, refresh in rows:
        v = s or "-"
        number[k] = number.get(k, 0) + (k in last and last[k] != v)
        last[k] = v
        runs[(k, i)] = number[k]
        if s:
            state[k] = s
        else:
            granted[(k, i)] = state.get(k) in (None, "FAILED") or (state[k] == "READY" and refresh)
            if granted[(k, i)]:
                state[k] = "PENDING"
    for size in (1, 6, 1000):
        chunk = F.floor(F.col("i") / size)
        got = SC.running_groups(df, ["k"], ["i"], F.coalesce("status", F.lit("-")), "n", chunk).collect()
        assert {(r.k, r.i): r.n for r in got} == runs
        got = E.claim_replay(df, ["k"], ["i"], chunk).collect()
        assert {(r.k, r.i): r.granted for r in got} == granted


def test_quota_stream_equals_arrival_order(spark, tmp_path):
    rows, df = log(spark, random.Random(4), n=90, seconds=60_000)
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    process = quota_batches(out, 4, 9)
    for n in range(3):
        df.where(F.col("request_id") % 3 == n).select("request_id", "ts", "session_id").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("request_id long, ts timestamp, session_id string").parquet(src)
        run_batches(stream, process, str(tmp_path / "cp")).awaitTermination()
    got = {r.request_id: r.outcome for r in spark.read.parquet(f"{out}/outcomes").collect()}
    want = {r.request_id: r.outcome for r in E.admit_quota(
        df.withColumn("n", F.col("request_id") % 3), 4, 9, order=["n", "ts", "request_id"]).collect()}
    assert got == want


def test_answer_stream_keeps_deletions(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "learner_id string, interaction_id string, value string, updated_at long"
    for rows in ([("a", "x", "1", 1), ("a", "y", "2", 1)], [("a", "x", "", 3)], [("a", "x", "old", 2)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        run_batches(spark.readStream.schema(schema).parquet(src), answer_batches(out, ["learner_id", "interaction_id"], ["updated_at"]),
                    str(tmp_path / "cp")).awaitTermination()
    state = spark.read.parquet(f"{out}/state/batch=2")
    live = E.latest_answers(state, ["learner_id", "interaction_id"], ["updated_at"]).collect()
    assert [(r.interaction_id, r.value) for r in live] == [("y", "2")]


def test_page_state_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    src = str(tmp_path / "in")
    schema = "book_id string, page_number int, event_id long, ts timestamp, status string, refresh boolean"
    at = lambda s: T0 + dt.timedelta(seconds=s)
    first = [("b", 1, 1, at(0), None, False), ("b", 1, 2, at(1), None, True), ("b", 1, 3, at(2), "READY", False), ("b", 1, 4, at(3), None, False),
             ("b", 1, 5, at(4), None, True), ("b", 2, 6, at(5), "OCR", False)]
    for rows in (first, [("b", 3, 9, at(5000), "READY", False)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = stream_page_state(stream, 60, "1 second").writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    page1 = [r.event for r in sorted(rows, key=lambda r: r.ts) if r.page_number == 1 and r.event != "stuck"]
    assert page1 == ["claim_granted", "claim_refused", "status", "claim_refused", "claim_granted"]
    assert {r.page_number for r in rows if r.event == "stuck"} == {1, 2}


def test_daily_usage_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "request_id long, ts timestamp, outcome string"
    day = lambda d, s=0: T0 + dt.timedelta(days=d, seconds=s)
    for n, rows in enumerate(([(1, day(0), "ALLOWED"), (2, day(0, 5), "SESSION_LIMIT_REACHED"), (3, day(0, 9), "ALLOWED")], [(4, day(1), "ALLOWED")], [(5, day(9), "ALLOWED")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = stream_daily_usage(spark.readStream.schema(schema).parquet(src), "1 day")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = {(r.usage_date, r.provider_calls) for r in spark.read.parquet(out).collect()}
    # the last day stays open until the watermark passes it
    assert got == {(day(0).date(), 2), (day(1).date(), 1)}


def test_stage_percentiles_are_exact(spark):
    """More times than an approximate percentile keeps apart, in more than one range, many of them equal."""
    rng = random.Random(7)
    times = {"OCR": [rng.randrange(10 ** 9) ** 2 // 10 ** 8 for _ in range(40_000)] + [5] * 1_000, "READY": [3, 1, 2] * 20, "FAILED": [9]}
    rows = spark.createDataFrame([(s, t) for s, ts in times.items() for t in ts] + [("OCR", None)], "status string, micros long")
    got = {r.status: (r.p50, r.p95) for r in E.stage_percentiles(rows, {"p50": 0.5, "p95": 0.95}).collect()}
    place = lambda ts, percent: sorted(ts)[max(1, -(-len(ts) * percent // 100)) - 1]
    assert got == {s: (place(ts, 50), place(ts, 95)) for s, ts in times.items()}


def test_cache_states_are_planned_once_per_level_and_stay_off_the_driver(spark):
    """Two keys over 130 chunks of one hour: eight levels, each one join, none of them a broadcast."""
    ok = spark.range(260).select(F.concat(F.lit("k"), F.col("id") % 2).alias("key"), F.lit(E.HOUR).alias("_ttl"), (F.col("id") * (E.HOUR // 2) + F.col("id") * 1_000).alias("_us"))
    anchors = E._anchors(ok, "key")
    plan = anchors._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") <= 10
    assert "Broadcast" not in anchors._jdf.queryExecution().executedPlan().toString()
    want, end = [], {}
    for key, us in sorted((f"k{i % 2}", i * (E.HOUR // 2) + i * 1_000) for i in range(260)):
        if us >= end.get(key, 0):
            want.append((key, us))
            end[key] = us + E.HOUR
    assert sorted((r.key, r._us) for r in anchors.collect()) == want
