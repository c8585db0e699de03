"""Text, parsing and hashing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafgrade.functions import geometry as G
from leafgrade.functions import textops as X
from leafgrade.operators import aggregates as A
from leafgrade.operators import ordering as O
from leafgrade.operators import quality as Q
from leafgrade.operators.matching import labelled, page_span
from leafgrade.plans import tables as T
from leafgrade.plans.registry import query

JS = "[ \\t\\n\\x0B\\f\\r\\x{00A0}\\x{FEFF}]"


@query("normalize_text", "C2", """WITH a AS (SELECT doc_id, doc_id % 3 = 0 AS cs, doc_id % 2 = 0 AS pr, nfc_normalize(text) AS t FROM documents),
b AS (SELECT doc_id, cs, pr, regexp_replace(regexp_replace(t, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g') AS t FROM a),
c AS (SELECT doc_id, cs, pr, translate(t, '„“‚‘’´`–—―', '""' || repeat('''', 5) || '---') AS t FROM b),
d AS (SELECT doc_id, cs, CASE WHEN pr THEN t ELSE regexp_replace(regexp_replace(t, '[.!?:;,]+$', ''), '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g') END AS t FROM c)
SELECT doc_id, md5(CASE WHEN cs THEN t ELSE lower(t) END) AS digest, length(t) AS chars FROM d""")
def _(spark, sf):
    d = T.table(spark, sf, "documents")
    k = F.col("doc_id")
    t = X.normalize_answer(F.col("text"), k % 3 == 0, k % 2 == 0)
    return d.select("doc_id", "text").withColumn("t", t).select("doc_id", F.md5("t").alias("digest"), F.length("t").cast("long").alias("chars"))


@query("comparison_text", "C3", """WITH a AS (SELECT conv_id, turn, nfc_normalize(text) AS t FROM conversations),
b AS (SELECT conv_id, turn, lower(translate(regexp_replace(trim(t, ' ' || chr(9) || chr(10) || chr(13)), '[ \\t\\n\\r]+', ' ', 'g'), '„“’‘–—', '""' || repeat('''', 2) || '--')) AS t FROM a)
SELECT conv_id, turn, md5(t) AS digest FROM b""")
def _(spark, sf):
    c = T.table(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.md5(X.normalize_for_comparison(F.col("text"))).alias("digest"))


@query("mojibake_report", "C1", """SELECT lang, count(*) AS texts,
 count(*) FILTER (WHERE doc_id % 2 = 0 AND regexp_matches(text, '[^\\x00-\\x7F]') AND NOT regexp_matches(text, '[^\\x{0000}-\\x{00FF}]')
  AND NOT regexp_matches(text, '[\\x00-\\x1F]')) AS repaired FROM documents GROUP BY 1""")
def _(spark, sf):
    """Every second document is first re-read as Latin-1, as a broken import would."""
    d = T.table(spark, sf, "documents").select("doc_id", "lang", "text")
    wrong = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    plain = ~F.col("text").rlike(r"[^\u0000-ÿ]")
    broken = d.withColumn("text", F.when((F.col("doc_id") % 2 == 0) & plain, wrong).otherwise(F.col("text")))
    return Q.mojibake_report(broken, "text", ["lang"])


@query("span_texts", "C4", f"""WITH {T.SPANS},
m AS (SELECT doc_id, len % 4 AS grp, string_agg(regexp_replace(text, '^[ \\t\\r\\x{{00A0}}]+|[ \\t\\r\\x{{00A0}}]+$', '', 'g'), ' ' ORDER BY y, x, idx)
  FILTER (WHERE regexp_matches(text, '[^ \\t\\r\\x{{00A0}}]')) AS t FROM sp GROUP BY 1, 2),
a AS (SELECT doc_id, grp, regexp_replace(t, '[ \\t\\n\\r\\x{{00A0}}]+', ' ', 'g') AS t FROM m),
b AS (SELECT doc_id, grp, regexp_replace(t, ' +([,;:!?])', '\\1', 'g') AS t FROM a),
c AS (SELECT doc_id, grp, replace(regexp_replace(replace(t, ' ..', chr(1)), ' \\.', '.', 'g'), chr(1), ' ..') AS t FROM b),
d AS (SELECT doc_id, grp, regexp_replace(regexp_replace(t, '!( *!)+', '!', 'g'), '\\?( *\\?)+', '?', 'g') AS t FROM c)
SELECT doc_id, grp, md5(t) AS digest FROM d WHERE t IS NOT NULL""")
def _(spark, sf):
    s = T.spans(spark, sf)
    members = s.select("doc_id", (F.col("len") % 4).alias("grp"), F.col("id").alias("span_id"))
    texts = A.span_texts(members, s, ["doc_id"], ["grp"])
    return texts.where("text IS NOT NULL").select("doc_id", "grp", F.md5("text").alias("digest"))


@query("prompt_parts", "C7", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'a)' WHEN 1 THEN '12.' WHEN 3 THEN 'b)' END AS label, CASE WHEN p_partkey % 4 < 3 THEN p_name END AS rest FROM part""")
def _(spark, sf):
    k = F.col("p_partkey") % 4
    t = (F.when(k == 0, F.concat(F.lit("a) "), F.col("p_name"))).when(k == 1, F.concat(F.lit(" 12. 12. "), F.col("p_name")))
         .when(k == 2, F.col("p_name")).otherwise("b)b) b)"))
    return T.table(spark, sf, "part").select("p_partkey", X.fill_prompt_label(t).alias("label"), X.fill_prompt_text(t).alias("rest"))


@query("fragments_cv", "C8 A10", """WITH f AS (SELECT item_id, list_filter(list_transform(string_split(text, ','), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13))), lambda s: s <> '') AS f FROM benchmark),
u AS (SELECT item_id, unnest(f) AS p FROM f),
a AS (SELECT item_id, stddev_pop(length(p)) AS sd, avg(length(p)) AS m, count(*) AS n FROM u GROUP BY 1)
SELECT item_id, n AS fragments, round(CASE WHEN n < 2 THEN 1.0 ELSE sd / m END, 6) AS cv FROM a""")
def _(spark, sf):
    b = T.table(spark, sf, "benchmark").withColumn("f", X.split_fragments(F.col("text"), ","))
    return b.where(F.size("f") > 0).select("item_id", F.size("f").cast("long").alias("fragments"), F.round(O.fragment_cv(F.col("f")), 6).alias("cv"))


@query("terminal_punctuation", "C8", """WITH f AS (SELECT p_partkey, list_value(p_name, p_type || '.', CASE WHEN p_size % 3 = 0 THEN 'usw.' ELSE '?' END, p_brand || '!?') AS f FROM part),
u AS (SELECT p_partkey, p_partkey AS k, f[1] AS a, f[2] AS b, f[3] AS c, f[4] AS d FROM f)
SELECT p_partkey, a || '|' || left(b, length(b) - 1) || '|.|' || c || '|' || left(d, length(d) - 2) || '|!?' AS items FROM u""")
def _(spark, sf):
    last = F.when(F.col("p_size") % 3 == 0, "usw.").otherwise("?")
    parts = F.array(F.col("p_name"), F.concat("p_type", F.lit(".")), last, F.concat("p_brand", F.lit("!?")))
    return T.table(spark, sf, "part").select("p_partkey", F.array_join(X.split_terminal_punctuation(parts), "|").alias("items"))


@query("numbered_items", "C9", """WITH s AS (SELECT item_id, list_filter(list_transform(string_split(regexp_replace(text, '[0-9\\n]', ' ', 'g'), '.'), lambda p: trim(p)), lambda p: p <> '') AS p FROM benchmark)
SELECT item_id, CASE WHEN len(p) >= 2 THEN array_to_string(list_transform(p, lambda q: trim(replace(regexp_replace(q, '-\\s+', '', 'g'), '?', ''), ' -')), '|') END AS items FROM s""")
def _(spark, sf):
    """Benchmark sentences are numbered and joined as a solution line would be, then split again."""
    clean = F.regexp_replace("text", r"[0-9\n]", " ")
    parts = F.filter(F.transform(F.split(clean, r"\."), F.trim), lambda p: p != "")
    line = F.array_join(F.transform(parts, lambda p, i: F.concat((i % 90 + 1).cast("string"), F.lit(". "), p)), " – ")
    b = T.table(spark, sf, "benchmark").withColumn("line", line)
    return b.select("item_id", F.array_join(X.split_numbered_items(F.col("line")), "|").alias("items"))


@query("inferred_kinds", "C10", """WITH t AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Relativsatz ' || p_name WHEN 1 THEN 'Bitte ZUORDNEN' WHEN 2 THEN 'Satzbau und Adjektiv' WHEN 3 THEN 'Wortstellung' ELSE p_name END AS t FROM part)
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'FillBlank' WHEN 1 THEN 'Matching' WHEN 2 THEN 'FillBlank' WHEN 3 THEN 'SentenceOrdering' ELSE 'FillBlank' END AS kind FROM t""")
def _(spark, sf):
    k = F.col("p_partkey") % 5
    t = (F.when(k == 0, F.concat(F.lit("Relativsatz "), F.col("p_name"))).when(k == 1, "Bitte ZUORDNEN").when(k == 2, "Satzbau und Adjektiv")
         .when(k == 3, "Wortstellung").otherwise(F.col("p_name")))
    return T.table(spark, sf, "part").select("p_partkey", X.infer_kind(t).alias("kind"))


@query("parsed_pairs", "C11", """WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_linenumber || substr('ABCDEFG', CAST(l_partkey % 7 AS INT) + 1, 1) || ' — ' || l_suppkey || l_returnflag AS t FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CAST(len(regexp_extract_all(t, '[0-9]+[A-F]')) AS INT) AS pairs, array_to_string(list_transform(regexp_extract_all(t, '[0-9]+[A-F]'), lambda p: left(p, length(p) - 1) || '=' || right(p, 1)), ',') AS listed,
 len(regexp_extract_all(t, '[0-9]+[A-F]')) >= 2 AS extracted FROM t""")
def _(spark, sf):
    li = T.table(spark, sf, "lineitem")
    t = F.concat(F.col("l_linenumber").cast("string"), F.substring(F.lit("ABCDEFG"), (F.col("l_partkey") % 7).cast("int") + 1, F.lit(1)),
                 F.lit(" — "), F.col("l_suppkey").cast("string"), F.col("l_returnflag"))
    rows = li.select("l_orderkey", "l_linenumber", "l_partkey", t.alias("t")).withColumn("p", X.parse_pairs(F.col("t")))
    listed = F.array_join(F.transform("p", lambda p: F.concat(p["leftLabel"], F.lit("="), p["rightLabel"])), ",")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.size("p").alias("pairs"), listed.alias("listed"),
                       X.extraction_pairs(F.col("t")).isNotNull().alias("extracted"))


@query("expected_pairs", "C12", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_brand || '>' || p_type WHEN 1 THEN p_type || '>' || p_brand || ';x>y' WHEN 2 THEN 'a>b' ELSE '' END AS pairs FROM part""")
def _(spark, sf):
    k = F.col("p_partkey") % 4
    t = (F.when(k == 0, F.concat("p_brand", F.lit(" = "), "p_type", F.lit("=z"))).when(k == 1, F.concat("p_type", F.lit("->"), "p_brand", F.lit(", x-y; -q")))
         .when(k == 2, "a-b-c").otherwise(F.col("p_type")))
    joined = F.array_join(F.transform(X.expected_pairs(t), lambda p: F.concat(p["leftLabel"], F.lit(">"), p["rightLabel"])), ";")
    return T.table(spark, sf, "part").select("p_partkey", joined.alias("pairs"))


@query("matching_answers", "C13", """SELECT event_id, CAST(CASE event_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 0 WHEN 3 THEN 2 ELSE 0 END AS INT) AS pairs,
 CASE event_id % 5 WHEN 1 THEN event_type WHEN 3 THEN event_type END AS first_right FROM events""")
def _(spark, sf):
    k, t = F.col("event_id") % 5, F.col("event_type")
    v = (F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit('{"a":"'), t, F.lit('","b":"","c":{"d":"e"},"f":null}')))
         .when(k == 2, F.concat(F.lit('["'), t, F.lit('"]'))).when(k == 3, F.concat(F.lit('{"a":"'), t, F.lit('","b":"x"}'))).otherwise("{broken"))
    m = X.parse_matching_answer(v)
    return T.table(spark, sf, "events").select("event_id", F.size(m).alias("pairs"), F.try_element_at(m, F.lit("a")).alias("first_right"))


@query("ordered_answers", "C14 U3", """WITH a AS (SELECT p_partkey, list_value('i' || p_size % 4, 'i' || (p_size + 1) % 4) AS o, p_size FROM part)
SELECT p_partkey, CAST(2 AS INT) AS n, CASE WHEN p_size % 4 = 0 THEN 1 WHEN p_size % 4 = 3 THEN 2 END AS position,
 array_to_string(list_filter(['i0', 'i1', 'i2', 'i3'], lambda i: NOT list_contains(o, i)), ',') AS unused, 'Hallo ' || p_size || ', du!' AS sentence FROM a""")
def _(spark, sf):
    s = F.col("p_size")
    value = F.concat(F.lit("i"), (s % 4).cast("string"), F.lit(",,i"), ((s + 1) % 4).cast("string"), F.lit(","))
    o = X.parse_ordered_answer(value)
    items = F.array(*[F.lit(f"i{i}") for i in range(4)])
    words = F.array(F.lit(" Hallo "), s.cast("string"), F.lit(","), F.lit("du"), F.lit(" ! "))
    return T.table(spark, sf, "part").select(
        "p_partkey", F.size(o).alias("n"), X.order_position(o, F.lit("i0")).cast("int").alias("position"),
        F.array_join(X.unused_items(items, o), ",").alias("unused"), X.joined_sentence(words).alias("sentence"))


@query("item_labels", "C15", """SELECT p_partkey,
 CASE p_partkey % 4 WHEN 0 THEN '7' WHEN 1 THEN '12' WHEN 2 THEN '3' ELSE '' END AS left_label,
 CASE p_partkey % 4 WHEN 3 THEN p_name || ' ' || p_type ELSE p_name || CASE WHEN p_partkey % 4 = 0 THEN ' ' || p_type ELSE ' ' || p_type END END AS left_text,
 CASE p_partkey % 3 WHEN 0 THEN 'B' WHEN 1 THEN 'A' ELSE '' END AS right_label,
 CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN 'Bei ' || p_name ELSE 'Anna ' || p_name END AS right_text FROM part""")
def _(spark, sf):
    name, kind, k = F.col("p_name"), F.col("p_type"), F.col("p_partkey")
    span = lambda i, y, x, t: page_span(F.lit(i), F.lit(f"s{i}"), t, G.box(x, y, 0.25, 0.125))
    left = F.array(span(1, 0.5, 0.0, F.when(k % 4 == 2, F.concat(kind, F.lit(" 3."))).otherwise(kind)),
                   span(0, 0.25, 0.0, F.when(k % 4 == 1, F.concat(F.lit("12. "), name)).otherwise(name)))
    left = F.when(k % 4 == 0, F.concat(left, F.array(span(2, 0.75, 0.0, F.lit(" 7. "))))).otherwise(left)
    right = (F.when(k % 3 == 0, F.array(span(0, 0.25, 0.0, F.lit("B")), span(1, 0.25, 0.5, name)))
             .when(k % 3 == 1, F.array(span(0, 0.25, 0.0, F.concat(F.lit("• ABei "), name))))
             .otherwise(F.array(span(0, 0.25, 0.0, F.concat(F.lit("Anna "), name)))))
    rows = T.table(spark, sf, "part").withColumns({"ls": F.sort_array(left), "rs": F.sort_array(right)})
    return rows.selectExpr("p_partkey", f"{labelled('left', 'ls')} AS l", f"{labelled('right', 'rs')} AS r").select(
        "p_partkey", F.col("l.label").alias("left_label"), F.col("l.item.text").alias("left_text"), F.col("r.label").alias("right_label"), F.col("r.item.text").alias("right_text"))


@query("fingerprints", "C16", """WITH r AS (SELECT *, CAST(l_quantity AS BIGINT) AS q FROM lineitem),
n AS (SELECT *, (q * 20000 + 64) // 128 AS x, (l_linenumber * 20000 + 16) // 32 AS y, (q * 20000 + 128) // 256 AS w FROM r)
SELECT l_orderkey, l_linenumber, l_partkey, '0.2.0|' || l_returnflag || printf('|%d.%04d|%d.%04d|%d.%04d|0.2500|', x // 10000, x % 10000, y // 10000, y % 10000, w // 10000, w % 10000) || l_linenumber AS fingerprint FROM n""")
def _(spark, sf):
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    f = X.fingerprint(F.lit("0.2.0"), F.col("l_returnflag"), G.box(q / 64.0, n / 16.0, q / 128.0, 0.25), n)
    return T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", f.alias("fingerprint"))


@query("cache_keys", "C17", """WITH e AS (SELECT *, CASE CAST(event_id % 3 AS INT) WHEN 0 THEN 'check' WHEN 1 THEN 'ask' ELSE 'hint' END AS action FROM events)
SELECT event_id, sha256(concat_ws('|', 'p', 'm', 'v1', action, CAST(user_id AS VARCHAR), CAST(event_id % 400 AS VARCHAR), event_type, '',
 CASE WHEN action = 'check' THEN sha256(lower(trim(' ' || props))) ELSE '' END, CASE WHEN action = 'ask' THEN sha256(trim(' ' || props)) ELSE '' END, '')) AS cache_key FROM e""")
def _(spark, sf):
    k = F.col("event_id")
    action = F.when(k % 3 == 0, "check").when(k % 3 == 1, "ask").otherwise("hint")
    text = F.concat(F.lit(" "), F.col("props"))
    key = X.cache_key("p", "m", "v1", action, F.col("user_id").cast("string"), k % 400, F.col("event_type"), F.lit(None).cast("string"), text, text)
    return T.table(spark, sf, "events").select("event_id", key.alias("cache_key"))


@query("model_output_audit", "C18", """WITH a AS (SELECT CASE WHEN turn % 2 = 0 THEN 'check' ELSE 'hint' END AS action, (conv_id + turn) % 6 AS m, conv_id % 2 AS v FROM conversations)
SELECT action, CASE WHEN m IN (3, 4) THEN 'invalid_output' WHEN m = 5 THEN 'invalid_output' WHEN action = 'check' AND v = 1 THEN 'invalid_output' ELSE 'ok' END AS category,
 count(*) AS responses FROM a GROUP BY 1, 2""")
def _(spark, sf):
    c = T.table(spark, sf, "conversations")
    m, v = (F.col("conv_id") + F.col("turn")) % 6, F.when(F.col("conv_id") % 2 == 1, "sure").otherwise("uncertain")
    body = F.to_json(F.struct(F.concat(F.lit("x"), F.col("text")).alias("content"), v.alias("verdict")))
    raw = (F.when(m == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(m == 1, body).when(m == 2, F.concat(F.lit("Sure: "), body, F.lit(" ok")))
           .when(m == 3, F.concat(F.lit("no json: "), F.col("role"))).when(m == 4, "").otherwise(F.lit('{"content": 5, "verdict": "uncertain"}')))
    log = c.select(F.when(F.col("turn") % 2 == 0, "check").otherwise("hint").alias("action"), raw.alias("raw_text"))
    return Q.model_output_audit(log)


@query("answer_alternatives", "C19", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_type WHEN 2 THEN p_brand ELSE p_name || ' und ' || p_type || ' oder ' || p_brand || ' — x' END AS first,
 CASE p_partkey % 4 WHEN 0 THEN p_type || ';' || p_brand WHEN 1 THEN p_name WHEN 2 THEN p_type ELSE '' END AS others FROM part""")
def _(spark, sf):
    k = F.col("p_partkey") % 4
    t = (F.when(k == 0, F.concat("p_name", F.lit(" — "), "p_type", F.lit("— "), "p_brand")).when(k == 1, F.concat("p_type", F.lit(" / "), "p_name", F.lit("/")))
         .when(k == 2, F.concat("p_brand", F.lit(", "), "p_type")).otherwise(F.concat("p_name", F.lit(" und "), "p_type", F.lit(" oder "), "p_brand", F.lit(" — x"))))
    a = X.answer_alternatives(t)
    return T.table(spark, sf, "part").select("p_partkey", a["primary"].alias("first"), F.array_join(a["alternatives"], ";").alias("others"))


@query("ocr_warnings", "C20 F2", """SELECT p_partkey, CASE WHEN p_size % 3 = 0 AND p_size % 2 = 0 THEN 'low_ocr_confidence: ' || p_name || '=0.50,' || p_type || '=0.75'
 WHEN p_size % 3 = 0 THEN 'low_ocr_confidence: ' || p_name || '=0.50' WHEN p_size % 2 = 0 THEN 'low_ocr_confidence: ' || p_type || '=0.75' END AS low, p_partkey % 5 = 0 AS corrupted FROM part""")
def _(spark, sf):
    s = F.col("p_size")
    spans = F.array(F.struct(F.col("p_name").alias("text"), F.when(s % 3 == 0, 0.5).otherwise(0.9).alias("confidence")),
                    F.struct(F.col("p_type").alias("text"), F.when(s % 2 == 0, 0.75).otherwise(1.0).alias("confidence")))
    odd = F.when(F.col("p_partkey") % 5 == 0, F.concat("p_name", F.lit(" q\u0007"))).otherwise(F.concat("p_name", F.lit(" ab q x1")))
    return T.table(spark, sf, "part").select("p_partkey", X.low_confidence_warning(spans).alias("low"), X.looks_corrupted(odd).alias("corrupted"))


@query("context_variants", "C21", """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'example' WHEN 1 THEN 'instruction' WHEN 2 THEN 'theory' WHEN 3 THEN 'instruction' ELSE 'theory' END AS variant FROM part""")
def _(spark, sf):
    k = F.col("p_partkey") % 5
    t = (F.when(k == 0, F.concat(F.lit("Zum Beispiel lesen: "), F.col("p_name"))).when(k == 1, F.concat(F.col("p_name"), F.lit(" LESEN!")))
         .when(k == 2, F.concat(F.lit("vorlesen "), F.col("p_name"))).when(k == 3, "Bitte ergänzen").otherwise(F.col("p_name")))
    return T.table(spark, sf, "part").select("p_partkey", X.context_variant(t).alias("variant"))


@query("source_pages", "C22 A9", """WITH p AS (SELECT page_id, CAST(page_id % 90 AS INT) AS n FROM pages)
SELECT page_id, CASE WHEN page_id % 4 = 0 THEN NULL ELSE n END AS raster_page, CASE WHEN page_id % 3 = 0 THEN 1 ELSE greatest(n, 1) END AS span_page FROM p""")
def _(spark, sf):
    k = F.col("page_id")
    n = (k % 90).cast("string")
    path = F.when(k % 4 == 0, F.col("url")).otherwise(F.concat(F.col("url"), F.lit("-page"), n, F.lit("-160dpi.png")))
    sid = F.when(k % 3 == 0, F.concat(F.lit("span-x"), n, F.lit("-1"))).otherwise(F.concat(F.lit("span-"), n, F.lit("-1")))
    return T.table(spark, sf, "pages").select("page_id", X.page_from_raster_path(path).alias("raster_page"), X.page_from_span_id(sid).alias("span_page"))


@query("page_actions", "C24 F6", """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN 'process' WHEN o_orderkey % 2 = 0 THEN 'update' ELSE 'none' END AS action,
 CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderpriority END AS visible FROM orders""")
def _(spark, sf):
    from leafgrade.operators.flatten import visible_analysis
    status = F.when(F.col("o_orderstatus") == "F", "READY").when(F.col("o_orderstatus") == "O", "FAILED").otherwise("OCR")
    return T.table(spark, sf, "orders").select("o_orderkey", X.process_action(status, F.col("o_orderkey") % 2 == 0).alias("action"),
                                               visible_analysis(status, F.col("o_orderpriority")).alias("visible"))


@query("truncated_texts", "T5", """SELECT doc_id, length(left(text, 8000)) AS n, md5(left(text, 8000)) AS digest FROM documents""")
def _(spark, sf):
    t = X.truncate(F.col("text"), 8000)
    return T.table(spark, sf, "documents").select("doc_id", F.length(t).cast("long").alias("n"), F.md5(t).alias("digest"))


@query("header_titles", "F7", f"""WITH {T.SPANS}
SELECT doc_id, idx, text <> '' AND NOT regexp_matches(text, '^[0-9]') AND NOT regexp_matches(text, '[—–/]') AS title_ok,
 CASE WHEN len BETWEEN 1 AND 99 THEN len END AS unit FROM sp""")
def _(spark, sf):
    s = T.spans(spark, sf)
    number = F.concat(F.lit(" "), F.col("len").cast("string"), F.lit(".. "))
    return s.select("doc_id", "idx", X.valid_header_title(F.col("text")).alias("title_ok"), X.unit_candidate(number).alias("unit"))


@query("ordered_distinct", "U2", """SELECT o_orderkey, array_to_string(CASE o_orderkey % 3 WHEN 0 THEN [o_orderstatus, o_orderpriority] WHEN 1 THEN [o_orderpriority, o_orderstatus] ELSE [o_orderstatus] END, '|') AS ids FROM orders""")
def _(spark, sf):
    from leafgrade.operators.flatten import ordered_distinct
    k, a, b, e = F.col("o_orderkey") % 3, F.col("o_orderstatus"), F.col("o_orderpriority"), F.lit("")
    arr = F.when(k == 0, F.array(a, e, b, a)).when(k == 1, F.array(b, a, b, e)).otherwise(F.array(e, a, a))
    return T.table(spark, sf, "orders").select("o_orderkey", F.array_join(ordered_distinct(arr), "|").alias("ids"))


@query("common_prompts", "A12 U2", """SELECT o_orderkey // 8 AS block, CASE WHEN count(DISTINCT CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END) = 1
 THEN min(CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END) END AS prompt FROM orders GROUP BY 1""")
def _(spark, sf):
    from leafgrade.operators.lessons import common_prompt
    k = F.col("o_orderkey")
    prompts = F.collect_list(F.when(k % 2 == 0, F.col("o_orderstatus")))
    return T.table(spark, sf, "orders").groupBy(F.floor(k / 8).alias("block")).agg(common_prompt(prompts).alias("prompt"))
