"""Sinks (S7, S8)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafgrade.operators.scans import latest_wins


def upsert_latest(current: DataFrame, changes: DataFrame, keys: Sequence[str], update: Sequence[str],
                  version: Sequence[str] = ()) -> DataFrame:
    """Insert new keys, overwrite only the listed columns of known keys.

    Columns that are not listed (id, created_at) keep the old value. When
    ``changes`` holds a key more than once, the last by ``version`` wins. A
    listed column takes the new value even when that is null.
    """
    keys = list(keys)
    if version:
        changes = latest_wins(changes, keys, list(version))
    rest = [c for c in current.columns if c not in keys]
    old = current.select(*keys, F.struct(*rest).alias("_old"))
    new = changes.select(*keys, F.struct(*[c for c in rest if c in changes.columns]).alias("_new"))
    joined = old.join(new, keys, "full_outer")

    def value(c: str) -> Column:
        has_new = c in changes.columns
        if not has_new:
            return F.col("_old")[c]
        if c in update:
            return F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col("_old")[c])
        return F.when(F.col("_old").isNotNull(), F.col("_old")[c]).otherwise(F.col("_new")[c])

    return joined.select(*keys, *[value(c).alias(c) for c in rest]).select(*current.columns)


def write_upsert(current: DataFrame, changes: DataFrame, keys: Sequence[str], update: Sequence[str], path: str,
                 version: Sequence[str] = (), partition_by: Sequence[str] = ()) -> None:
    """Write the merged table to a *new* path (readers switch over; a lost task can be run again)."""
    merged = upsert_latest(current, changes, keys, update, version)
    merged.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)


def merge_into_sql(table: str, source: str, keys: Sequence[str], columns: Sequence[str], update: Sequence[str]) -> str:
    """The MERGE statement for catalogs whose table format supports it."""
    on = " AND ".join(f"t.{k} = s.{k}" for k in keys)
    sets = ", ".join(f"t.{c} = s.{c}" for c in update)
    names, values = ", ".join(columns), ", ".join(f"s.{c}" for c in columns)
    return (f"MERGE INTO {table} t USING {source} s ON {on} "
            f"WHEN MATCHED THEN UPDATE SET {sets} WHEN NOT MATCHED THEN INSERT ({names}) VALUES ({values})")


def export_violations(pages: DataFrame, schema_version: str, engine: str, model: str) -> DataFrame:
    """Pages that must not be exported, with the first broken rule.

    ``pages``: book_id, page_number, status, schemaVersion, pageNumber, processor.
    """
    eq = lambda c, v: F.coalesce(c == v, F.lit(False))
    reason = (
        F.when(~eq(F.col("status"), "READY"), "not READY")
        .when(~eq(F.col("schemaVersion"), schema_version), "schemaVersion")
        .when(~eq(F.col("pageNumber"), F.col("page_number")), "pageNumber")
        .when(~eq(F.col("processor.engine"), engine), "engine")
        .when(~eq(F.col("processor.model"), model), "model")
    )
    return pages.withColumn("violation", reason).where("violation IS NOT NULL")


def export_manifest(pages: DataFrame) -> DataFrame:
    """Per book: page count, processing times in page order and a hash over the page documents."""
    digest = F.sha2(F.to_json(F.struct(*sorted(c for c in pages.columns if c not in ("book_id", "status")))), 256)
    listed = pages.groupBy("book_id").agg(
        F.count("*").alias("page_count"),
        F.array_sort(F.collect_list(F.struct("page_number", F.col("processor.processedAt").alias("processed_at"),
                                             digest.alias("sha")))).alias("p"))
    return listed.select("book_id", "page_count", F.col("p.processed_at").alias("accepted_processed_at"),
                         F.sha2(F.array_join("p.sha", "|"), 256).alias("source_sha256"))


def export_validated(pages: DataFrame, path: str, schema_version: str, engine: str, model: str) -> None:
    """Write page JSON and a manifest; one bad page fails the whole export before anything is written."""
    bad = export_violations(pages, schema_version, engine, model)
    first = bad.select("book_id", "page_number", "violation").take(1)
    if first:
        raise ValueError(f"export refused: {first[0].asDict()}")
    pages.drop("status").write.mode("errorifexists").partitionBy("book_id").json(f"{path}/pages")
    export_manifest(pages).write.mode("errorifexists").json(f"{path}/manifest")
