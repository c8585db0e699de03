"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgrade.session import ensure_checkpoint_dir

#: A word: a run of characters other than space and the ASCII control blanks 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Rows that a task sends to Python at once: whole texts of many KB, which stand in the JVM and in Python at the same time.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A to Z only."""
    return F.translate(c, UPPER, LOWER)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the checkpoint folder that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back.

    Cuts the lineage, so a lost executor costs no recomputation, and gives the
    optimizer measured sizes. The folder belongs to the session's owner, who
    clears it.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows with the smallest hashes of ``key``: the same on every run.

    Finds the cut-off from the key column alone, then filters; nothing but one
    number reaches the driver.
    """
    h = F.xxhash64(F.col(key))
    cut = df.select(h.alias("h")).orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    # equal hashes at the cut-off are told apart by the rows themselves, not by their place
    return df.where(h <= F.lit(cut)).orderBy(h, *df.columns).limit(rows) if cut is not None else df.limit(0)


def slices(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in parts of about ``size`` bytes of the text ``column``; a longer text is a part of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
        yield batch.slice(at, to - at)
        at = to


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` has not."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
