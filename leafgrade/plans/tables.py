"""Input relations that the queries derive from the given tables.

Coordinates are dyadic (multiples of 1/512), so sums and comparisons are exact
in double precision on every engine. A page is one document: its lines are the
text spans. The SQL fragments derive the same relations for the check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgrade.functions.geometry import box

DOC = ["doc_id"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    # the tables hold zone-less times; reading them as UTC instants keeps them as they are, whatever zone the caller's session has
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("k", F.get_json_object("props", "$.k").cast("int"))


EVENTS = "ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"


def lines(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    n = F.length("line")
    return d.withColumn("len", n).withColumns({
        "y": (F.col("i") * 4 + n % 4) / 512.0, "h": (1 + n % 2) / 512.0, "x": (n % 7) / 16.0, "w": (1 + n % 5) / 16.0,
    })


LINES = """ln0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
  generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
ln AS (SELECT doc_id, CAST(i AS INT) AS i, line, CAST(length(line) AS INT) AS len,
  CAST(i * 4 + length(line) % 4 AS DOUBLE) / 512 AS y, CAST(1 + length(line) % 2 AS DOUBLE) / 512 AS h,
  CAST(length(line) % 7 AS DOUBLE) / 16 AS x, CAST(1 + length(line) % 5 AS DOUBLE) / 16 AS w FROM ln0)"""


def spans(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as text spans."""
    d = lines(spark, sf)
    return d.select(
        "doc_id", F.col("i").alias("idx"), F.concat(F.lit("s"), F.col("i").cast("string")).alias("id"), F.col("line").alias("text"),
        ((50 + F.col("len") % 50) / 100.0).alias("confidence"), "len",
        F.when(F.col("len") % 3 != 0, F.concat(F.lit("line-"), F.floor(F.col("i") / 3).cast("string"))).alias("parent_line_id"),
        box(F.col("x"), F.col("y"), F.col("w"), F.col("h")).alias("bbox"))


SPANS = LINES + """,
sp AS (SELECT doc_id, i AS idx, 's' || i AS id, line AS text, CAST(50 + len % 50 AS DOUBLE) / 100 AS confidence, len,
  CASE WHEN len % 3 <> 0 THEN 'line-' || CAST(i // 3 AS VARCHAR) END AS parent_line_id, x, y, w, h FROM ln)"""


def boxes(spark: SparkSession, sf: str, modulus: int = 6) -> DataFrame:
    """Candidate boxes: every line whose length is divisible by ``modulus`` carries one."""
    d = lines(spark, sf).where(F.col("len") % modulus == 0)
    n = F.col("len")
    return d.select("doc_id", F.concat(F.lit("b"), F.col("i").cast("string")).alias("id"), "i", "len", box(
        ((n * 3) % 11) / 16.0, (F.col("i") * 4 + 2) / 512.0, (2 + n % 3) / 16.0, F.lit(2 / 512.0)).alias("bbox"))


def boxes_sql(modulus: int = 6, name: str = "bx") -> str:
    return f"""{name} AS (SELECT doc_id, 'b' || i AS id, i, len, CAST((len * 3) % 11 AS DOUBLE) / 16 AS x,
  CAST(i * 4 + 2 AS DOUBLE) / 512 AS y, CAST(2 + len % 3 AS DOUBLE) / 16 AS w, CAST(2 AS DOUBLE) / 512 AS h
  FROM ln WHERE len % {modulus} = 0)"""


def flat(df: DataFrame, *keep: str, box_col: str = "bbox") -> DataFrame:
    """Box struct to plain x, y, w, h columns."""
    b = F.col(box_col)
    return df.select(*keep, b["x"].alias("x"), b["y"].alias("y"), b["width"].alias("w"), b["height"].alias("h"))
