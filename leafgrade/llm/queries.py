"""The registered queries of the corpus operators and the SQL of those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgrade.llm.common import table
from leafgrade.llm.decontamination import contaminated
from leafgrade.llm.language_id import identify_language
from leafgrade.llm.mixing import mix_sources
from leafgrade.llm.near_dup import near_duplicates
from leafgrade.llm.periodic_runs import periodic_runs
from leafgrade.llm.pii import find_personal_data
from leafgrade.llm.secret_scan import find_secrets
from leafgrade.llm.substring_dedup import drop_repeated_passages
from leafgrade.llm.topk import exact_top_k
from leafgrade.llm.toxicity import score_toxicity
from leafgrade.llm.url_filter import judge_urls, rule_table
from leafgrade.llm.warc import round_trip
from leafgrade.llm.whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Fixed values of the url query: verdict, host, path.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return add


@query()
def op1_find_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    return find_personal_data(table(spark, sf, "documents"))


@query()
def op2_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    return mix_sources(table(spark, sf, "documents")).drop("source")


@query()
def op3_contaminated(spark: SparkSession, sf: str) -> DataFrame:
    return contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query()
def op4_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(table(spark, sf, "documents"), shingle=4)


@query("""WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS hex FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS head FROM h)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda c: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((CAST('0x' || substr(hex, CAST(5 * (c // 4) + 1 AS INT), 5) AS INT) >> CAST(15 - 5 * (c % 4) AS INT)) & 31) + 1 AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id < head THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < head THEN head END AS refers_to FROM m""")
def op5_warc_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    return round_trip(table(spark, sf, "pages")).drop("intact")


@query()
def op6_score_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return score_toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query()
def op7_find_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return find_secrets(table(spark, sf, "documents"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""")
def op8_exact_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return exact_top_k(table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0)


@query("""WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (SELECT *, CASE
  WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND prefix(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/') THEN 'net/' END AS rule FROM s)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM f""")
def op9_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return judge_urls(table(spark, sf, "pages"), rule_table(spark, URL_RULES))


@query("""WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM d),
s AS (SELECT doc_id, k, array_to_string(w[k:k + 12], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d WHERE len(w) >= 13)),
m AS (SELECT win, min(doc_id) AS least FROM s GROUP BY win HAVING count(DISTINCT doc_id) > 1),
g AS (SELECT doc_id, k, true AS hit FROM s JOIN m USING (win) WHERE doc_id > least),
c AS (SELECT doc_id, k, word, coalesce(bool_or(hit) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN 12 PRECEDING AND CURRENT ROW), false) AS gone
  FROM t LEFT JOIN g USING (doc_id, k)),
r AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY k) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)""")
def op10_drop_repeated_passages(spark: SparkSession, sf: str) -> DataFrame:
    return drop_repeated_passages(table(spark, sf, "documents"), with_text=False)


@query()
def op11_whiten_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    rows = whiten(table(spark, sf, "embeddings"))
    return rows.select("vec_id", "n", "deviation", "identity_error", "explained", F.posexplode("whitened").alias("place", "whitened")).select(
        "vec_id", (F.col("place") + 1).alias("component"), "n", "deviation", "whitened", F.get("explained", "place").alias("explained"), "identity_error")


@query()
def op12_identify_language(spark: SparkSession, sf: str) -> DataFrame:
    return identify_language(table(spark, sf, "documents"))


def bent(docs: DataFrame) -> DataFrame:
    """Every tenth document, by hash of its id, continues with a period from some word on; null ids and texts stay."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    own = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("w")).withColumn("n", F.expr("nullif(size(w), 0)"))
    own = own.withColumn("a", F.expr("g % n")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    again = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - F.lit(1).cast("long")),
                        lambda i: F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    return own.select("doc_id", F.when(F.col("n") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


@query(r"""WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
    lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)) AS h FROM documents),
e AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS bent, (h // 10) % greatest(len(w), 1) AS a, 3 + (h // 10) % 8 AS c FROM d),
t AS (SELECT doc_id, unnest(range(n)) AS i, unnest(CASE WHEN bent THEN list_transform(range(n),
    lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // c) END]) ELSE w END) AS word FROM e),
m AS (SELECT x.doc_id, x.i, x.i - y.i AS q FROM t x JOIN t y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i > y.i),
g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS isle FROM m),
s AS (SELECT doc_id, q, min(i) - q AS s, count(*) + q AS n FROM g GROUP BY doc_id, q, isle HAVING count(*) >= greatest(q, 12 - q)),
r AS (SELECT doc_id, s, n, min(q) AS q FROM s GROUP BY doc_id, s, n),
f AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS runs,
  arg_max({'s': s, 'n': n, 'q': q}, [n, -s, -q]) AS top FROM r GROUP BY doc_id),
o AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + n)) AS i FROM r),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM t ANTI JOIN o USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, top.s AS start, top.n AS length, top.q AS period, 1000 * top.n // top.q AS exponent_milli,
  sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM documents LEFT JOIN f USING (doc_id) LEFT JOIN k USING (doc_id)""")
def op13_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    rows = periodic_runs(bent(table(spark, sf, "documents")))
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("at"), (-r["period"]).alias("q"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return rows.withColumn("top", top).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.at")).alias("start"), "top.length", (-F.col("top.q")).alias("period"),
        F.expr("1000 * top.length div -top.q").alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))
