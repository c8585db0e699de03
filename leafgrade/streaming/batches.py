"""Micro-batch state kept as versioned tables.

Each batch writes its result and the next state under its own batch id, so a
repeated batch overwrites its own output only. The batch operators do the work:
a stream gives what one batch over the arrived rows gives.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leafgrade.operators.events import admit_quota
from leafgrade.operators.scans import first_k, latest_wins


def _state(spark: SparkSession, path: str, batch_id: int, schema) -> DataFrame:
    """State left by the batch before (empty on the first)."""
    if batch_id == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/state/batch={batch_id - 1}")


def quota_batches(path: str, session_limit: int, global_limit: int, keep_days: int = 2) -> Callable[[DataFrame, int], None]:
    """E5 as a ``foreachBatch`` function: requests (request_id, ts, session_id) in arrival order.

    The state holds the requests that used a session count, at most
    ``session_limit`` per session and day, for the newest ``keep_days`` days;
    requests of older days are refused as late.
    """
    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.select("request_id", "ts", "session_id", F.lit(batch_id).cast("long").alias("seq"))
        old = _state(spark, path, batch_id, new.schema)
        newest = old.select("ts").union(new.select("ts")).agg(F.date_sub(F.to_date(F.max("ts")), keep_days - 1).alias("_from"))
        rows = old.unionByName(new).join(newest, F.to_date("ts") >= F.col("_from")).drop("_from")
        order = ["seq", "ts", "request_id"]
        decided = admit_quota(rows, session_limit, global_limit, order=order).where(F.col("seq") == batch_id)
        late = new.join(newest, F.to_date("ts") < F.col("_from")).drop("_from").withColumn(
            "usage_date", F.to_date("ts")).withColumn("outcome", F.lit("LATE"))
        decided.unionByName(late).drop("seq").write.mode("overwrite").parquet(f"{path}/outcomes/batch={batch_id}")
        used = first_k(rows.withColumn("_d", F.to_date("ts")), ["session_id", "_d"], order, session_limit).drop("_d")
        used.select(*new.columns).write.mode("overwrite").parquet(f"{path}/state/batch={batch_id}")
    return process


def answer_batches(path: str, keys: Sequence[str], order: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """E9 as a ``foreachBatch`` function: merges the answer log into the current answers (deletions included)."""
    def process(batch: DataFrame, batch_id: int) -> None:
        old = _state(batch.sparkSession, path, batch_id, batch.schema)
        merged = latest_wins(old.unionByName(batch), list(keys), list(order))
        # a deletion stays in the state as an empty value, so that an older row cannot bring the answer back
        merged.select(*batch.columns).write.mode("overwrite").parquet(f"{path}/state/batch={batch_id}")
    return process


def run_batches(stream: DataFrame, process: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run a ``foreachBatch`` function over everything that has arrived."""
    return stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_daily_usage(outcomes: DataFrame, watermark: str = "1 day") -> DataFrame:
    """A15 on a stream of admitted requests: provider calls per day, final once the watermark passes the day."""
    return outcomes.where("outcome = 'ALLOWED'").withWatermark("ts", watermark).groupBy(
        F.window("ts", "1 day")).agg(F.count("*").alias("provider_calls")).select(
        F.to_date("window.start").alias("usage_date"), "provider_calls")
