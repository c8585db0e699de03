"""URL rules: expand hosts and paths, join on short hashes, confirm digests, settle precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgrade.llm.common import ascii_lower


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, url.substr(at + 3, F.length(url))), F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules (verdict, host, path) as a table; for long lists read them from files instead."""
    rows = ", ".join(f"(:v{i}, :h{i}, :p{i})" for i in range(len(rules)))
    args = {f"{name}{i}": x for i, r in enumerate(rules) for name, x in zip("vhp", r)}
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(verdict, rule_host, rule_path)", args=args)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Judges each row's ``url``: page_id, host, path, rule, verdict.

    ``rules`` has verdict, rule_host, rule_path. A rule fits its host and all
    subdomains when the path starts with rule_path; the longest (host and path
    together) wins, then the longer host, then ``block``. Each distinct
    (host, path) expands to its host suffixes times its path prefixes, only as
    many as some rule could equal: suffixes up to the rules' most labels and
    prefixes of the rules' lengths. Those meet the rules on 32 bits of a SHA-256
    and count when the whole digest agrees. No rule: ``default``; null rules
    are ignored; repeated page rows each get their row; an empty table gives
    none. Other columns of ``pages`` are not read.
    """
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    digest = lambda h, p: F.sha2(F.concat(h, F.lit("\n"), p), 256)
    own = rules.select(
        "verdict", "rule_host", "rule_path", digest(F.col("rule_host"), F.col("rule_path")).alias("rule_digest"),
    ).where(F.col("rule_digest").isNotNull()).withColumn("short", F.substring("rule_digest", 1, 8))
    bounds = own.agg(F.max(F.size(F.split("rule_host", r"\."))), F.sort_array(F.collect_set(F.length("rule_path")))).first()
    most, lengths = bounds[0] or 0, bounds[1]
    labels = F.split("host", r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.greatest(n - most, F.lit(0)) + 1, n), lambda i: F.array_join(F.slice(labels, i, n), "."))
    prefixes = F.filter(F.transform(F.array(*map(F.lit, lengths)), lambda k: F.when(k <= F.length("path"), F.col("path").substr(F.lit(1), k))),
                        lambda p: p.isNotNull())
    if not lengths:
        return urls.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    found = (
        urls.where("host <> ''").select("host", "path").distinct()
        .select("host", "path", F.explode(suffixes).alias("h"), prefixes.alias("ps"))
        .select("host", "path", "h", F.explode("ps").alias("p"))
        .withColumn("digest", digest(F.col("h"), F.col("p"))).withColumn("short", F.substring("digest", 1, 8))
        .join(own, "short").where("digest = rule_digest")
        .groupBy("host", "path").agg(F.max(F.struct(
            (F.length("rule_host") + F.length("rule_path")).alias("len"), F.length("rule_host").alias("host_len"),
            F.col("verdict"), F.concat("rule_host", "rule_path").alias("rule"))).alias("best"))
    )
    return urls.join(found, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
