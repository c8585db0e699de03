"""Page-document, answer-key, lesson and source queries.

Every document becomes a typed page inside its own row: its lines are the text
spans, and the length of a line says which interaction stands beside it.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as ST

from leafgrade import schemas as SC
from leafgrade.functions import geometry as G
from leafgrade.functions.arrays import settle
from leafgrade.operators import answer_key as AK
from leafgrade.operators import choices as CH
from leafgrade.operators import context as CX
from leafgrade.operators import flatten as P
from leafgrade.operators import lessons as L
from leafgrade.operators import matching as M
from leafgrade.operators import ordering as O
from leafgrade.operators import quality as Q
from leafgrade.plans import tables as T
from leafgrade.plans.registry import query
from leafgrade.sources import readers as R
from leafgrade.sources import sinks as S

WITH_LINES = f"WITH {T.LINES}"
PAGE_SQL = "CAST(doc_id // 16 AS VARCHAR) AS book_id, CAST(doc_id % 16 + 1 AS INT) AS page_number"


def _build(spark, sf, interactions: bool = True):
    d = T.table(spark, sf, "documents").select("doc_id", "text").withColumn("lines", F.split("text", "\n"))
    d = d.withColumn("lines", F.transform("lines", lambda t, i: F.struct(
        t.alias("t"), i.alias("i"), F.length(t).alias("n"), ((i * 4 + F.length(t) % 4) / 512.0).alias("y"))))
    page = (F.col("doc_id") % 16 + 1).cast("int")
    num = lambda i: i.cast("string")
    sid = lambda i: F.concat(F.lit("s"), num(i))
    near = lambda r: F.array(sid(r["i"]), sid(r["i"] + 1))
    score = lambda r: ((r["n"] % 8) / 8.0)

    def wide(r, dx=0.0, h=6 / 512):
        return G.box((r["n"] % 7) / 16.0 + dx, r["y"], 0.25, h)

    spans = F.transform("lines", lambda r: F.struct(
        sid(r["i"]).alias("id"), r["t"].alias("text"), ((50 + r["n"] % 50) / 100.0).alias("confidence"), F.lit("line").alias("confidenceScope"),
        F.when(r["n"] % 3 != 0, F.concat(F.lit("line-"), num(F.floor(r["i"] / 3)))).alias("parentLineId"),
        G.box((r["n"] % 7) / 16.0, r["y"], (1 + r["n"] % 5) / 16.0, (1 + r["n"] % 2) / 512.0).alias("bbox")))

    def family(residue, make, element):
        rows = F.filter("lines", lambda r: r["n"] % 11 == residue) if interactions else F.filter("lines", lambda r: F.lit(False))
        return F.transform(rows, make).cast(ST.ArrayType(element))

    def item(r, side, k):
        return F.struct(F.concat(F.lit(f"m{side}{k}-"), num(r["i"])).alias("id"), F.lit(f"{k + 1}" if side == "l" else "AB"[k]).alias("label"),
                        F.concat(F.lit(f"{side}{k} "), r["t"]).alias("text"), wide(r, 0.25 if side == "r" else 0.0).alias("bbox"),
                        F.lit(None).cast(SC.BBOX).alias("anchorBbox"), near(r).alias("nearbyTextSpanIds"))

    blanks = family(0, lambda r: F.struct(
        F.concat(F.lit("blank-"), num(r["i"])).alias("id"), F.lit("fill-in-line").alias("kind"), wide(r, h=1 / 512).alias("lineBbox"),
        wide(r).alias("interactionBbox"), F.lit("horizontal-line-v1").alias("detectionMethod"), score(r).alias("candidateScore"),
        near(r).alias("nearbyTextSpanIds")), SC.BLANK)
    targets = family(1, lambda r: F.struct(
        F.concat(F.lit("choice-"), num(r["i"])).alias("id"), F.lit("choice").alias("kind"), wide(r).alias("targetBbox"),
        wide(r).alias("interactionBbox"), F.when(r["n"] % 5 != 0, F.concat(F.lit("g"), num(r["n"] % 2))).alias("optionGroupId"),
        F.lit("empty-ring-v1").alias("detectionMethod"), score(r).alias("candidateScore"), near(r).alias("nearbyTextSpanIds")), SC.CHOICE_TARGET)
    grids = family(2, lambda r: F.struct(
        F.concat(F.lit("grid-"), num(r["i"])).alias("id"), F.lit("choice-grid").alias("kind"), wide(r).alias("gridBbox"),
        F.lit("g0").alias("optionGroupId"), F.lit("table-grid-v1").alias("detectionMethod"), score(r).alias("candidateScore"),
        F.array(*[F.struct(F.concat(F.lit("grid-"), num(r["i"]), F.lit(f"-r{k}")).alias("id"), wide(r).alias("rowBbox"),
                           F.lit(None).cast(SC.BBOX).alias("promptBbox"), near(r).alias("nearbyTextSpanIds"),
                           F.array(*[F.struct(F.concat(F.lit("cell-"), num(r["i"]), F.lit(f"-{k}{o}")).alias("id"), F.lit(f"g0-{o}").alias("optionId"),
                                              wide(r, k / 8).alias("cellBbox"), wide(r, k / 8).alias("interactionBbox")) for o in "xy"]).alias("cells"))
                  for k in (0, 1)]).alias("rows")), SC.CHOICE_GRID)
    orderings = family(3, lambda r: F.struct(
        F.concat(F.lit("ord-"), num(r["i"])).alias("id"), F.lit("sentence-ordering").alias("kind"), wide(r).alias("bbox"),
        F.concat(F.lit("oex-"), num(F.floor(r["i"] / 16))).alias("exerciseId"), (r["i"] + 1).alias("promptIndex"),
        F.lit("sentence-ordering-v1").alias("detectionMethod"), score(r).alias("candidateScore"), near(r).alias("nearbyTextSpanIds"),
        F.array(*[F.struct(F.concat(F.lit(f"oi{k}-"), num(r["i"])).alias("id"), F.concat(F.lit(f"w{k} "), r["t"]).alias("text"),
                           wide(r).alias("bbox"), F.lit(k + 1).alias("originalIndex")) for k in (0, 1, 2)]).alias("items")), SC.ORDERING)
    matchings = family(4, lambda r: F.struct(
        F.concat(F.lit("mat-"), num(r["i"])).alias("id"), F.lit("matching").alias("kind"), wide(r).alias("bbox"),
        F.lit("matching-v1").alias("detectionMethod"), score(r).alias("candidateScore"), F.lit("one-to-one").alias("cardinality"),
        near(r).alias("nearbyTextSpanIds"), F.array(item(r, "l", 0), item(r, "l", 1)).alias("leftItems"),
        F.array(item(r, "r", 0), item(r, "r", 1)).alias("rightItems")), SC.MATCHING)
    frees = family(5, lambda r: F.struct(
        F.concat(F.lit("free-"), num(r["i"])).alias("id"), F.lit("free-text").alias("kind"), wide(r).alias("bbox"),
        F.lit("free-text-v1").alias("detectionMethod"), score(r).alias("candidateScore"), near(r).alias("nearbyTextSpanIds"),
        F.array(F.struct(F.concat(F.lit("fl-"), num(r["i"])).alias("id"), wide(r).alias("bbox"))).alias("responseLines")), SC.FREE_TEXT)
    groups = F.array(*[F.struct(F.lit(f"g{g}").alias("id"), F.array(*[F.struct(F.lit(f"g{g}-{o}").alias("id"), F.lit(f"{o}").alias("label"))
                                                                      for o in "xyz"]).alias("options")) for g in (0, 1)])
    kinds = F.array(*[F.lit(k) for k in ("blank-", "choice-", "grid-", "ord-", "mat-", "free-")])
    names = F.array(*[F.lit(k) for k in ("fill-blank", "choice", "choice-grid", "sentence-ordering", "matching", "free-text")])
    ident = lambda r: F.concat(F.get(kinds, r["n"] % 11), num(r["i"]))

    def exercise(r):
        """Each interaction of an odd line leads an exercise with the interaction eight lines further, and two context spans."""
        mates = F.filter("lines", lambda o: ((o["i"] == r["i"]) | (o["i"] == r["i"] + 8)) & (o["n"] % 11 < 6))
        return F.struct(
            F.concat(F.lit("ex-"), num(r["i"])).alias("id"), num(r["i"]).alias("number"), F.lit("Titel").alias("title"),
            F.lit("Lies.").alias("instruction"), F.get(names, r["n"] % 11).alias("kind"), wide(r, 0.0, 24 / 512).alias("bbox"),
            (r["i"] + 1).alias("sourceOrder"), F.transform(mates, ident).alias("interactionIds"),
            F.array(sid(r["i"] + 2), sid(r["i"] + 3)).alias("contextSpanIds"), F.lit("vision-semantic-v1").alias("detectionMethod"),
            score(r).alias("confidence"))

    leads = F.filter("lines", lambda r: (r["n"] % 11 < 6) & (r["i"] % 16 == 1)) if interactions else F.filter("lines", lambda r: F.lit(False))
    detection = F.struct(F.lit("m").alias("detectionMethod"), F.size("lines").alias("rawCandidateCount"), F.size(blanks).alias("acceptedCount"),
                         F.lit(1).alias("groupCount"), (F.col("doc_id") % 100).cast("int").alias("durationMs")).cast(SC.DETECTION)
    columns = {
        "schemaVersion": F.lit(SC.SCHEMA_VERSION), "pageNumber": page, "width": F.lit(1024), "height": F.lit(2048), "language": F.lit("de"),
        "textSpans": spans, "exerciseBlanks": blanks, "choiceGroups": groups, "choiceTargets": targets, "choiceGrids": grids,
        "sentenceOrderings": orderings, "matchingInteractions": matchings, "freeTextInteractions": frees,
        "semanticExercises": F.transform(leads, exercise),
        **{n: (detection if n in ("blankDetection", "choiceDetection") else F.lit(None).cast(SC.DETECTION)) for n in SC.DETECTION_FIELDS},
        "processor": F.lit(None).cast(SC.PROCESSOR),
    }
    types = {f.name: f.dataType for f in SC.PAGE_DOCUMENT.fields}
    return d.select("doc_id", F.floor(F.col("doc_id") / 16).cast("string").alias("book_id"), page.alias("page_number"),
                    *[c.cast(types[n]).alias(n) for n, c in columns.items()])


def documents(spark, sf, interactions: bool = True):
    return settle(_build(spark, sf, interactions))


COUNTS = ", ".join(f"count(*) FILTER (WHERE len % 11 = {r}) AS {k}" for r, k in enumerate(
    ("fill_in_line", "choice", "choice_grid", "sentence_ordering", "matching", "free_text")))


@query("page_documents", "S1 S2 P2 U1 A16", f"""{WITH_LINES} SELECT {PAGE_SQL}, {COUNTS}, count(*) FILTER (WHERE len % 11 < 6) AS total FROM ln
 WHERE doc_id % 7 <> 3 GROUP BY doc_id HAVING count(*) FILTER (WHERE len % 11 < 6) > 0""")
def _(spark, sf):
    """Pages go through their JSON form; every seventh one is broken and counts as absent."""
    docs = documents(spark, sf)
    body = F.to_json(F.struct(*[f.name for f in SC.PAGE_DOCUMENT.fields]))
    raw = docs.select("doc_id", "book_id", "page_number", F.when(F.col("doc_id") % 7 != 3, body).otherwise("{broken").alias("analysis"))
    typed = R.with_legacy_defaults(R.parse_page_documents(raw))
    return P.kind_counts(P.explode_interactions(typed))


@query("reading_ordinals", "P2 W1 W17", f"""{WITH_LINES}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, len % 11
 ORDER BY CASE WHEN len % 11 = 3 THEN i ELSE 0 END, y, CASE WHEN len % 11 = 2 THEN 0 ELSE x END, i) - 1 AS n FROM ln WHERE len % 11 < 6)
SELECT {PAGE_SQL}, CASE len % 11 WHEN 0 THEN 'blank-' WHEN 1 THEN 'choice-' WHEN 2 THEN 'grid-' WHEN 3 THEN 'ord-' WHEN 4 THEN 'mat-' ELSE 'free-' END || i AS id,
 CAST(n AS INT) AS ordinal FROM k""")
def _(spark, sf):
    return P.explode_interactions(documents(spark, sf), ordinal_mode="reading").select("book_id", "page_number", "id", "ordinal")


@query("page_details", "P1 P3", f"""{WITH_LINES} SELECT {PAGE_SQL}, 'span' AS part, count(*) AS n FROM ln GROUP BY doc_id
UNION ALL SELECT {PAGE_SQL}, 'grid_row', 2 * count(*) FROM ln WHERE len % 11 = 2 GROUP BY doc_id
UNION ALL SELECT {PAGE_SQL}, 'ordering_item', 3 * count(*) FROM ln WHERE len % 11 = 3 GROUP BY doc_id
UNION ALL SELECT {PAGE_SQL}, 'matching_item', 4 * count(*) FROM ln WHERE len % 11 = 4 GROUP BY doc_id
UNION ALL SELECT {PAGE_SQL}, 'response_line', count(*) FROM ln WHERE len % 11 = 5 GROUP BY doc_id
UNION ALL SELECT {PAGE_SQL}, 'option', 6 FROM documents
UNION ALL SELECT {PAGE_SQL}, 'exercise_span', 2 * count(*) FROM ln WHERE len % 11 < 6 AND i % 16 = 1 GROUP BY doc_id""")
def _(spark, sf):
    docs = documents(spark, sf)
    parts = {"span": P.explode_spans, "grid_row": P.explode_grid_rows, "ordering_item": P.explode_ordering_items,
             "matching_item": P.explode_matching_items, "response_line": P.explode_response_lines, "option": P.explode_options,
             "exercise_span": P.exercise_spans}
    out = None
    for name, fn in parts.items():
        n = fn(docs).groupBy("book_id", "page_number").agg(F.count("*").alias("n")).withColumn("part", F.lit(name))
        out = n if out is None else out.unionByName(n)
    return out


@query("exercise_members", "P3 J12", f"""{WITH_LINES}, e AS (SELECT doc_id, i FROM ln WHERE len % 11 < 6 AND i % 16 = 1)
SELECT CAST(e.doc_id // 16 AS VARCHAR) AS book_id, CAST(e.doc_id % 16 + 1 AS INT) AS page_number, 'ex-' || e.i AS exercise_id, count(*) AS members
FROM e JOIN ln o ON o.doc_id = e.doc_id AND (o.i = e.i OR o.i = e.i + 8) AND o.len % 11 < 6 GROUP BY e.doc_id, e.i""")
def _(spark, sf):
    return P.exercise_members(documents(spark, sf)).groupBy("book_id", "page_number", "exercise_id").agg(F.count("*").alias("members"))


@query("interaction_aliases", "P4", f"""{WITH_LINES}, a AS (
 SELECT doc_id, CASE len % 11 WHEN 0 THEN 'blank-' WHEN 1 THEN 'choice-' WHEN 4 THEN 'mat-' ELSE 'free-' END || i AS alias,
  CASE len % 11 WHEN 0 THEN 'blank-' WHEN 1 THEN 'choice-' WHEN 4 THEN 'mat-' ELSE 'free-' END || i AS id FROM ln WHERE len % 11 IN (0, 1, 4, 5)
 UNION ALL SELECT doc_id, 'grid-' || i || unnest(['', '-r0', '-r1']), 'grid-' || i FROM ln WHERE len % 11 = 2
 UNION ALL SELECT doc_id, 'ord-' || i, 'oex-' || CAST(i // 16 AS VARCHAR) FROM ln WHERE len % 11 = 3
 UNION ALL SELECT DISTINCT doc_id, 'oex-' || CAST(i // 16 AS VARCHAR), 'oex-' || CAST(i // 16 AS VARCHAR) FROM ln WHERE len % 11 = 3)
SELECT {PAGE_SQL}, alias, id FROM a""")
def _(spark, sf):
    return P.interaction_aliases(documents(spark, sf)).select("book_id", "page_number", "alias", "id")


@query("document_fingerprints", "C16 P3", f"""{WITH_LINES}, f AS (SELECT doc_id, len % 11 AS fam FROM ln WHERE len % 11 < 6 UNION ALL SELECT doc_id, 2 FROM ln WHERE len % 11 = 2)
SELECT {PAGE_SQL}, CASE fam WHEN 0 THEN 'fill-blank' WHEN 1 THEN 'choice' WHEN 2 THEN 'choice-grid' WHEN 3 THEN 'sentence-ordering' WHEN 4 THEN 'matching' ELSE 'free-text' END AS store_kind,
 count(*) AS n FROM f GROUP BY doc_id, fam""")
def _(spark, sf):
    return P.document_fingerprints(documents(spark, sf)).groupBy("book_id", "page_number", "store_kind").agg(F.count("*").alias("n"))


@query("detection_stats", "A7", f"""{WITH_LINES}, c AS (SELECT doc_id, count(*) AS raw, count(*) FILTER (WHERE len % 11 = 0) AS acc FROM ln GROUP BY 1),
a AS (SELECT count(*) AS pages, CAST(sum(raw) AS BIGINT) AS raw, CAST(sum(acc) AS BIGINT) AS accepted, round(sum(doc_id % 100) / count(*), 6) AS mean_ms FROM c)
SELECT family, a.* FROM a, (SELECT unnest(['blankDetection', 'choiceDetection']) AS family)""")
def _(spark, sf):
    return P.detection_stats(documents(spark, sf)).select("family", "pages", "raw", "accepted", F.round("mean_ms", 6).alias("mean_ms"))


@query("document_integrity", "Q1", f"""{WITH_LINES}, n AS (SELECT doc_id, max(i) + 1 AS n FROM ln GROUP BY 1),
e AS (SELECT doc_id, i FROM ln WHERE len % 11 < 6 AND i % 16 = 1)
SELECT {PAGE_SQL}, 'unknown_span' AS rule, 'ex-' || i AS exercise_id, 's' || s AS value FROM (SELECT e.doc_id, e.i, n.n, unnest([e.i + 2, e.i + 3]) AS s FROM e JOIN n USING (doc_id)) WHERE s >= n""")
def _(spark, sf):
    return Q.integrity_report(documents(spark, sf))


@query("document_ranges", "Q2", f"""{WITH_LINES} SELECT {PAGE_SQL}, 'span_range' AS rule FROM ln GROUP BY doc_id HAVING max(y) > 1""")
def _(spark, sf):
    return Q.document_range_report(documents(spark, sf))


@query("stretched_ranges", "Q2", f"""{WITH_LINES} SELECT {PAGE_SQL}, 'span_range' AS rule FROM ln GROUP BY doc_id HAVING max(y) * 16 > 1""")
def _(spark, sf):
    """The same pages sixteen times as tall, so that texts of a few lines leave them."""
    tall = F.transform("textSpans", lambda s: s.withField("bbox.y", s["bbox"]["y"] * 16))
    return Q.document_range_report(documents(spark, sf).withColumn("textSpans", tall))


@query("grid_cells", "P3", f"""{WITH_LINES} SELECT {PAGE_SQL}, 'grid-' || i AS grid_id, 'grid-' || i || r.r AS row_id, CAST(count(*) AS BIGINT) AS cells
FROM ln, (SELECT unnest(['-r0', '-r1']) AS r) r, (SELECT unnest([0, 1]) AS c) c WHERE len % 11 = 2 GROUP BY doc_id, i, r.r""")
def _(spark, sf):
    return P.explode_grid_cells(documents(spark, sf)).groupBy("book_id", "page_number", "grid_id", "row_id").agg(F.count("*").alias("cells"))


@query("normalized_choices", "K3 W13 A1", f"""{WITH_LINES}, t AS (SELECT doc_id, i, y, x, len, CASE WHEN len % 5 <> 0 THEN len % 2 END AS g FROM ln WHERE len % 11 = 1),
c AS (SELECT *, CASE WHEN g IS NULL OR lag(y) OVER w IS NULL OR y - lag(y) OVER w > 4.5/512 THEN 1 ELSE 0 END AS f FROM t WINDOW w AS (PARTITION BY doc_id, g ORDER BY y, x, i)),
r AS (SELECT doc_id, g, sum(f) OVER (PARTITION BY doc_id, g ORDER BY y, x, i) AS run, len FROM c)
SELECT {PAGE_SQL}, count(*) AS targets, CAST(sum(members) AS BIGINT) AS rings, min(score) AS lowest FROM (SELECT doc_id, g, run, count(*) AS members, CAST(min(len % 8) AS DOUBLE) / 8 AS score FROM r GROUP BY 1, 2, 3)
 GROUP BY doc_id""")
def _(spark, sf):
    docs = documents(spark, sf)
    merged = CH.normalize_choices(docs)
    after = P.explode_interactions(merged).where("kind = 'choice'").groupBy("book_id", "page_number").agg(
        F.count("*").alias("targets"), F.min("score").alias("lowest"))
    before = P.explode_interactions(docs).where("kind = 'choice'").groupBy("book_id", "page_number").agg(F.count("*").alias("rings"))
    return after.join(before, ["book_id", "page_number"])


# ---- lessons -------------------------------------------------------------------

LESSON = f"""{WITH_LINES}, m AS (SELECT doc_id, i, regexp_replace(line, '^[ \\t\\r\\x{{00A0}}]+|[ \\t\\r\\x{{00A0}}]+$', '', 'g') AS t, y, h, x FROM ln
 WHERE 50 + len % 50 >= 55 AND length(trim(line)) > 1 AND regexp_matches(line, '[A-Za-z]')),
g AS (SELECT *, CASE WHEN y - lag(y + h) OVER w > 0.036 THEN 1 ELSE 0 END AS f FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY y, x, i)),
c AS (SELECT *, sum(f) OVER (PARTITION BY doc_id ORDER BY y, x, i) AS run FROM g),
p AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, run ORDER BY y, x, i) - 1) // 6 AS part FROM c),
b AS (SELECT doc_id, run, part, string_agg(t, ' ' ORDER BY y, x, i) AS t, count(*) AS n FROM p GROUP BY 1, 2, 3),
v AS (SELECT *, CASE WHEN regexp_matches(t, '(?i)\\b(beispiel|example|zum beispiel)\\b') THEN 'example'
 WHEN regexp_matches(t, '(?i)\\b(schreiben|erg[äÄ]nzen|ordnen|verbinden|w[äÄ]hlen|markieren|lesen|bilden)\\b') THEN 'instruction' ELSE 'theory' END AS variant FROM b),
s AS (SELECT doc_id, count(*) AS blocks, coalesce(sum(n) FILTER (WHERE variant <> 'instruction'), 0) AS paras, coalesce(sum(length(t) + 1) FILTER (WHERE variant <> 'instruction'), 0) - 1 AS chars FROM v GROUP BY 1)"""


@query("lesson_contexts", "K4 J15 W5 A13 C21 F1", f"""{LESSON} SELECT {PAGE_SQL}, CASE WHEN paras >= 2 AND chars >= 120 THEN 'AVAILABLE' ELSE 'UNAVAILABLE' END AS status,
 CASE WHEN paras >= 2 AND chars >= 120 THEN CAST(blocks AS INT) END AS block_count FROM documents LEFT JOIN s USING (doc_id)""")
def _(spark, sf):
    return L.project_lesson(documents(spark, sf, interactions=False)).select("book_id", "page_number", "status", "block_count")


@query("lesson_interactions", "K4 A8", f"""{WITH_LINES} SELECT {PAGE_SQL}, CAST(sum(CASE WHEN len % 11 = 2 THEN 2 ELSE 1 END) AS INT) AS interaction_count
 FROM ln WHERE len % 11 < 6 GROUP BY doc_id""")
def _(spark, sf):
    lessons = L.project_lesson(documents(spark, sf))
    busy = F.exists("blocks", lambda b: b["kind"] != "context")
    return lessons.where(busy).select("book_id", "page_number", "interaction_count")


@query("lesson_titles", "T3", f"""{WITH_LINES}, m AS (SELECT doc_id, i, regexp_replace(line, '^[ \\t\\r\\x{{00A0}}]+|[ \\t\\r\\x{{00A0}}]+$', '', 'g') AS t, w, h FROM ln
 WHERE 50 + len % 50 >= 55 AND regexp_matches(line, '[A-Za-z]') AND y < 0.2),
r AS (SELECT doc_id, t, row_number() OVER (PARTITION BY doc_id ORDER BY h DESC, w DESC, i) AS rn FROM m WHERE length(t) >= 4
 AND NOT regexp_matches(t, '(?i)^(?:[ABC]\\d|\\d+|lektion\\s+\\d+)$') AND NOT regexp_matches(t, '(?i)deutsch\\s+(?:entdecken|a1)'))
SELECT d.doc_id, coalesce(r.t, 'Page ' || (d.doc_id % 16 + 1)) AS title FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id AND r.rn = 1""")
def _(spark, sf):
    d = documents(spark, sf)
    return d.select("doc_id", L.lesson_title(F.col("textSpans"), F.col("page_number")).alias("title"))


# ---- contexts ------------------------------------------------------------------

def _books(spark, sf):
    return T.table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 16).cast("string").alias("book_id")).distinct().select(
        "book_id", F.concat(F.lit("Buch "), F.col("book_id")).alias("title"), F.lit("de").alias("source_language"))


@query("request_contexts", "K6 P4 G11 T5", f"""{WITH_LINES}, n AS (SELECT doc_id, count(*) AS n FROM ln GROUP BY 1),
q AS (SELECT event_id, n.doc_id, CAST(event_id * 7919 % n.n AS INT) AS i FROM events JOIN n ON n.doc_id = event_id % (SELECT max(doc_id) + 1 FROM documents)),
b AS (SELECT q.event_id, q.doc_id, q.i, l.len FROM q JOIN ln l ON l.doc_id = q.doc_id AND l.i = q.i AND l.len % 11 = 5),
e AS (SELECT doc_id, i FROM ln WHERE len % 11 < 6 AND i % 16 = 1),
o AS (SELECT b.*, (SELECT min(e.i) FROM e WHERE e.doc_id = b.doc_id AND (e.i = b.i OR e.i + 8 = b.i)) AS lead FROM b),
s AS (SELECT o.*, unnest(CASE WHEN lead IS NULL THEN [i, i + 1] ELSE [lead + 2, lead + 3] END) AS si FROM o),
c AS (SELECT s.event_id, 'Buch ' || (s.doc_id // 16) || CASE WHEN lead IS NULL THEN '' ELSE ' — Titel' END AS title,
 md5(left(coalesce(string_agg(l.line, ' ' ORDER BY s.si), ''), 8000)) AS digest FROM s LEFT JOIN ln l ON l.doc_id = s.doc_id AND l.i = s.si AND l.line <> '' GROUP BY 1, 2)
SELECT q.event_id, c.event_id IS NOT NULL AS context_ok, c.title, c.digest FROM q LEFT JOIN c USING (event_id)""")
def _(spark, sf):
    """Requests for a free-text interaction at some line of a page; it exists at some of them."""
    docs = documents(spark, sf)
    d = T.table(spark, sf, "documents")
    per_page = d.select(F.col("doc_id").alias("doc"), F.size(F.split("text", "\n")).alias("n"))
    ev = T.events(spark, sf).select("event_id", (F.col("event_id") % d.agg(F.max("doc_id") + 1).scalar()).alias("doc")).join(per_page, "doc")
    requests = ev.select("event_id", F.floor(F.col("doc") / 16).cast("string").alias("book_id"), (F.col("doc") % 16 + 1).cast("int").alias("page_number"),
                         F.concat(F.lit("free-"), (F.col("event_id") * 7919 % F.col("n")).cast("string")).alias("exercise_id"))
    slots = P.explode_interactions(docs).select("book_id", "page_number", "kind", "ordinal", F.lit("UNMAPPED").alias("resolution"))
    out = CX.build_context(requests, docs, _books(spark, sf), slots)
    return out.select("event_id", "context_ok", "title", F.md5("source").alias("digest"))


@query("selection_contexts", "K7 F5 J13 J14 X7 X8", f"""{WITH_LINES}, {T.EVENTS},
q AS (SELECT event_id, event_id % (SELECT max(doc_id) + 1 FROM documents) AS doc_id, k FROM ev),
c AS (SELECT DISTINCT doc_id, k, CAST(k AS DOUBLE) / 256 AS sx, CAST(k AS DOUBLE) / 1024 AS sy FROM q JOIN documents USING (doc_id)),
e AS (SELECT doc_id, i, len % 11 AS fam, CAST(len % 7 AS DOUBLE) / 16 AS x, y FROM ln WHERE len % 11 < 6 AND i % 16 = 1),
h AS (SELECT c.doc_id, c.k, e.i, e.fam FROM c JOIN e USING (doc_id) WHERE (sx + 0.125 BETWEEN x AND x + 0.25 AND sy + 0.03125 BETWEEN y AND y + 0.046875)
  OR (x + 0.125 BETWEEN sx AND sx + 0.25 AND y + 0.0234375 BETWEEN sy AND sy + 0.0625)),
n AS (SELECT doc_id, k, count(*) AS n, min(i) AS one, min(fam) AS fam, string_agg(i, ', ' ORDER BY i) AS numbers FROM h GROUP BY 1, 2),
r AS (SELECT h.doc_id, h.k, min(l.y) AS top, max(l.y + l.h) AS bottom FROM h JOIN ln l ON l.doc_id = h.doc_id AND l.i IN (h.i + 2, h.i + 3) GROUP BY h.doc_id, h.k, h.i),
p AS (SELECT c.doc_id, c.k, list(l.line ORDER BY l.y, l.x, l.i) AS parts FROM c JOIN ln l USING (doc_id) LEFT JOIN n USING (doc_id, k)
  WHERE trim(l.line) <> '' AND (EXISTS (SELECT 1 FROM h WHERE h.doc_id = c.doc_id AND h.k = c.k AND l.i IN (h.i + 2, h.i + 3))
   OR (l.x < sx + 0.25 + 3e-3 AND l.x + l.w > sx - 3e-3 AND l.y < sy + 0.0625 + 3e-3 AND l.y + l.h > sy - 3e-3 AND (n.n IS NULL OR (
    NOT EXISTS (SELECT 1 FROM e WHERE e.doc_id = l.doc_id AND l.i IN (e.i + 2, e.i + 3))
    AND EXISTS (SELECT 1 FROM r WHERE r.doc_id = c.doc_id AND r.k = c.k AND l.y + l.h / 2 BETWEEN r.top - 3e-3 AND r.bottom + 3e-3))))) GROUP BY 1, 2),
x AS (SELECT h.doc_id, h.k, flatten(list(CASE WHEN l.len % 11 = 3 THEN ['w0 ' || line || ' w1 ' || line || ' w2 ' || line] ELSE ['1. l0 ' || line, '2. l1 ' || line, 'A. r0 ' || line, 'B. r1 ' || line] END ORDER BY h.i, l.i)) AS told
  FROM h JOIN ln l ON l.doc_id = h.doc_id AND l.i IN (h.i, h.i + 8) AND l.len % 11 IN (3, 4) GROUP BY 1, 2),
s AS (SELECT c.doc_id, c.k, left(array_to_string(list_reduce(list_prepend(coalesce(parts, []), list_transform(coalesce(told, []), lambda t: [t])),
  lambda a, b: CASE WHEN len(list_filter(a, lambda t: contains(lower(t), lower(b[1])))) > 0 THEN a ELSE list_concat(a, b) END), ' '), 8000) AS source FROM c LEFT JOIN p USING (doc_id, k) LEFT JOIN x USING (doc_id, k)),
o AS (SELECT s.*, n.*EXCLUDE (doc_id, k), coalesce(trim(source) <> '', false) AS ok FROM s LEFT JOIN n USING (doc_id, k))
SELECT event_id, coalesce(ok, false) AS context_ok, CASE WHEN ok THEN 'Buch ' || (doc_id // 16) || ' — ' || CASE WHEN n = 1 THEN 'Exercise ' || one || ': Titel' WHEN n > 1 THEN 'selected exercises ' || numbers ELSE 'selected page region' END END AS title,
 CASE WHEN ok THEN CASE WHEN n = 1 THEN ['fill-blank', 'choice', 'choice-grid', 'sentence-ordering', 'matching', 'free-text'][fam + 1] ELSE 'selection' END END AS kind,
 CASE WHEN ok THEN CAST(coalesce(n, 0) AS INT) END AS exercises, CASE WHEN ok THEN md5(source) END AS digest FROM q LEFT JOIN o USING (doc_id, k)""")
def _(spark, sf):
    """One selection per event on its page."""
    docs = documents(spark, sf)
    d = T.table(spark, sf, "documents")
    ev = T.events(spark, sf).select("event_id", "k", (F.col("event_id") % d.agg(F.max("doc_id") + 1).scalar()).alias("doc"))
    requests = ev.select("event_id", F.floor(F.col("doc") / 16).cast("string").alias("book_id"), (F.col("doc") % 16 + 1).cast("int").alias("page_number"),
                         G.box(F.col("k") / 256.0, F.col("k") / 1024.0, 0.25, 0.0625).alias("selection"))
    out = CX.build_selection_context(requests, docs, _books(spark, sf))
    return out.select("event_id", "context_ok", "title", "kind", "exercises", F.md5("source").alias("digest"))


# ---- answer keys ---------------------------------------------------------------

def _key_spans(spark, sf):
    """A book of solution pages per text, 96 lines each: a heading, then per six lines one section header, four numbered blocks and one wrapped line."""
    d = T.table(spark, sf, "documents").select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    d = d.withColumns({"i": F.col("at") % 96, "page": F.floor(F.col("at") / 96).cast("int") + 1})
    i, unit = F.col("i"), (F.floor(F.col("i") / 6) + 1).cast("string")
    kind = F.when(F.floor(i / 6) % 2 == 0, "Thema").otherwise("Zuordnen")
    text = (F.when(i == 0, "Lösungen").when(i % 6 == 1, F.concat(unit, F.lit(" "), kind, F.lit(" "), F.col("lang")))
            .when(i % 6 == 0, F.concat(F.lit("weiter "), F.col("lang")))
            .otherwise(F.concat((i % 6).cast("string"), F.lit(" 1. "), F.col("lang"), F.lit(" 2. 1A-2B "), F.col("source"))))
    return d.select(F.col("doc_id").cast("string").alias("book_id"), F.col("page").alias("page_number"),
                    i.alias("idx"), F.concat(F.lit("span-"), F.col("page").cast("string"), F.lit("-"), i.cast("string")).alias("id"),
                    text.alias("text"), F.when(i % 9 == 4, 0.75).otherwise(1.0).alias("confidence"), F.lit(None).cast("string").alias("parent_line_id"),
                    G.box(0.125, i / 128.0, 0.25, 1 / 256).alias("bbox"))


@query("key_entries", "K1 D1 W6 W7 A2 C9 C10 C11 C19 C20 F7", f"""{WITH_LINES}, e AS (SELECT l.doc_id, l.i // 96 AS p, l.i % 96 AS i, d.lang, d.source, max(l.i % 96) OVER (PARTITION BY l.doc_id, l.i // 96) AS last
 FROM ln l JOIN documents d USING (doc_id))
SELECT CAST(doc_id AS VARCHAR) AS book_id, CAST(p + 1 AS INT) AS page_number, CAST(p + 1 AS INT) AS source_page, CAST(i // 6 + 1 AS INT) AS unit_number, CAST(i % 6 AS VARCHAR) AS marker, CAST(i % 6 - 1 AS INT) AS ordinal,
 CASE WHEN i // 6 % 2 = 0 THEN 'FillBlank' ELSE 'Matching' END AS key_kind,
 '1. ' || lang || ' 2. 1A-2B ' || source || CASE WHEN i % 6 = 5 AND i < last THEN ' weiter ' || lang ELSE '' END AS expected_value,
 lang || '|1A-2B ' || source || CASE WHEN i % 6 = 5 AND i < last THEN '   weiter ' || lang ELSE '' END AS items,
 CASE WHEN i // 6 % 2 = 1 THEN '1A2B' END AS pairs, CASE WHEN i % 9 = 4 THEN 1 ELSE 0 END + CASE WHEN i % 6 = 5 AND i < last AND (i + 1) % 9 = 4 THEN 1 ELSE 0 END AS warnings
FROM e WHERE i % 6 >= 2""")
def _(spark, sf):
    e = AK.extract_answer_key(_key_spans(spark, sf), "cornelsen")
    pairs = F.array_join(F.transform("payload.pairs", lambda p: F.concat(p["leftLabel"], p["rightLabel"])), "")
    return e.select("book_id", "page_number", "source_page", "unit_number", "marker", "ordinal", "key_kind", "expected_value",
                    F.array_join("items", "|").alias("items"), pairs.alias("pairs"), F.size("warnings").alias("warnings"))


@query("source_page_ranges", "A9", f"""{WITH_LINES}, r AS (SELECT doc_id AS b, min(i // 96 + 1) AS lo, max(i // 96 + 1) AS hi FROM ln WHERE i % 96 % 6 >= 2 GROUP BY 1)
SELECT CAST(b AS VARCHAR) AS book_id, CASE WHEN lo = hi THEN CAST(lo AS VARCHAR) ELSE lo || '-' || hi END AS source_page_range FROM r""")
def _(spark, sf):
    return AK.source_page_range(AK.extract_answer_key(_key_spans(spark, sf), "cornelsen"))


@query("stored_keys", "S3 S4", """SELECT o_orderkey AS book_id, CAST(1 AS INT) AS entry_index, 'choice' AS kind, 'strict' AS normalization_mode, CASE WHEN o_orderkey % 3 = 0 THEN 'Text' END AS payload_type,
 CAST(0 AS INT) AS items FROM orders WHERE o_orderkey % 5 <> 0
UNION ALL SELECT o_orderkey, 0, 'fill-in-line', 'loose', 'Matching', 2 FROM orders WHERE o_orderkey % 5 <> 0""")
def _(spark, sf):
    k = F.col("o_orderkey")
    body = F.concat(F.lit('[{"interactionKind":"FillBlank","ordinal":1,"normalizationMode":"loose","items":["a","b"],"typedPayload":{"type":"Matching","pairs":[{"leftLabel":"1","rightLabel":"A"},{"leftLabel":"2"}]}},'
                          '{"interactionKind":"Choice","ordinal":2,"unknown":true,"typedPayload":{"type":"'),
                    F.when(k % 3 == 0, "Text").otherwise("Other"), F.lit('","value":"'), F.col("o_orderpriority"), F.lit('"}}]'))
    keys = T.table(spark, sf, "orders").select(k.alias("book_id"), F.when(k % 5 != 0, body).otherwise("[{").alias("entries"))
    e = R.parse_answer_keys(keys)
    return e.select("book_id", "entry_index", "kind", "normalization_mode", F.col("payload.type").alias("payload_type"), F.size("items").alias("items"))


@query("stored_profiles", "S5", """SELECT c_custkey AS profile_id, CAST(i AS INT) AS position, CAST(c_custkey % 50 + i * 10 AS INT) AS printed_start, CAST(c_custkey % 7 AS INT) AS printed_offset
FROM customer, (SELECT unnest([0, 1, 2]) AS i) WHERE c_custkey % 4 <> 0""")
def _(spark, sf):
    k = F.col("c_custkey")
    units = F.array(*[F.struct(F.lit(i + 1).alias("unitNumber"), F.col("c_name").alias("title"), (k % 50 + i * 10).cast("int").alias("printedStartPage")) for i in range(3)])
    meta = F.to_json(F.struct((k % 7).cast("int").alias("printedPageOffset"), F.when(k % 4 != 0, units).alias("units")))
    p = R.parse_book_profiles(T.table(spark, sf, "customer").select(k.alias("profile_id"), meta.alias("metadata")))
    return p["units"].join(p["profiles"], "profile_id").select("profile_id", "position", "printed_start", "printed_offset")


# ---- sources and sinks ---------------------------------------------------------

@query("book_manifest", "S6", """WITH f AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN lang || '.v' || doc_id || '.pdf' WHEN 1 THEN source || '.PDF' WHEN 2 THEN '.pdf' WHEN 3 THEN lang || '.txt' END AS name,
 CASE WHEN doc_id % 7 = 0 THEN 'text/plain' ELSE 'application/pdf' END AS mime, CASE WHEN doc_id % 11 = 0 THEN 0 WHEN doc_id % 13 = 0 THEN 209715201 ELSE n_chars END AS size, text, lang, source FROM documents)
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN lang || '.v' || doc_id WHEN 1 THEN source WHEN 2 THEN '.pdf' WHEN 3 THEN lang ELSE 'Untitled' END AS title, sha256(text) AS checksum,
 CASE WHEN size <= 0 THEN 'File is empty' WHEN mime <> 'application/pdf' THEN 'Only PDF files are accepted' WHEN name IS NULL OR lower(name) NOT LIKE '%.pdf' THEN 'File must have .pdf extension'
 WHEN size > 209715200 THEN 'File too large (max 200 MB)' END AS reject_reason FROM f""")
def _(spark, sf):
    k = F.col("doc_id")
    name = (F.when(k % 5 == 0, F.concat("lang", F.lit(".v"), k.cast("string"), F.lit(".pdf"))).when(k % 5 == 1, F.concat("source", F.lit(".PDF")))
            .when(k % 5 == 2, ".pdf").when(k % 5 == 3, F.concat("lang", F.lit(".txt"))))
    files = T.table(spark, sf, "documents").select(
        "doc_id", name.alias("name"), F.when(k % 7 == 0, "text/plain").otherwise("application/pdf").alias("mime"),
        F.when(k % 11 == 0, 0).when(k % 13 == 0, 209715201).otherwise(F.col("n_chars")).alias("size"), F.col("text").cast("binary").alias("content"))
    return R.register_manifest(files).select("doc_id", "title", "checksum", "reject_reason")


@query("export_violations", "S8", """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN 'not READY' WHEN o_orderkey % 5 = 0 THEN 'schemaVersion' WHEN o_orderkey % 7 = 0 THEN 'pageNumber'
 WHEN o_orderkey % 11 = 0 THEN 'engine' WHEN o_orderkey % 13 = 0 THEN 'model' END AS violation FROM orders
 WHERE o_orderstatus <> 'F' OR o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 OR o_orderkey % 13 = 0""")
def _(spark, sf):
    k = F.col("o_orderkey")
    pages = T.table(spark, sf, "orders").select(
        "o_orderkey", F.lit("b").alias("book_id"), k.alias("page_number"), F.when(F.col("o_orderstatus") == "F", "READY").otherwise("OCR").alias("status"),
        F.when(k % 5 != 0, SC.SCHEMA_VERSION).alias("schemaVersion"), F.when(k % 7 == 0, -1).otherwise(k).alias("pageNumber"),
        F.struct(F.when(k % 11 == 0, "x").otherwise("e").alias("engine"), F.when(k % 13 != 0, "m").alias("model")).alias("processor"))
    return S.export_violations(pages, SC.SCHEMA_VERSION, "e", "m").select("o_orderkey", "violation")


@query("export_manifest", "S8", """SELECT CAST(o_orderkey // 64 AS VARCHAR) AS book_id, count(*) AS page_count, min(o_orderdate) AS first_processed, max(o_orderdate) AS last_processed FROM orders GROUP BY 1""")
def _(spark, sf):
    k = F.col("o_orderkey")
    pages = T.table(spark, sf, "orders").select(
        F.floor(k / 64).cast("string").alias("book_id"), k.alias("page_number"), F.lit("READY").alias("status"),
        F.struct(F.col("o_orderdate").alias("processedAt")).alias("processor"))
    m = S.export_manifest(pages)
    return m.select("book_id", "page_count", F.array_min("accepted_processed_at").alias("first_processed"), F.array_max("accepted_processed_at").alias("last_processed"))


@query("listed_books", "S10", """SELECT o_orderkey AS book_id, o_orderdate AS created_at FROM orders ORDER BY o_orderdate DESC""")
def _(spark, sf):
    return R.list_books(T.table(spark, sf, "orders").select(F.col("o_orderkey").alias("book_id"), F.col("o_orderdate").alias("created_at")))


# ---- prompts and matchings from raw spans --------------------------------------

@query("ordering_prompts", "K8 K9 W11 C8 A10")
def _(spark, sf):
    """Lines become scrambled sentences (spaces as separators); checked on a hand-made page in the tests."""
    s = T.spans(spark, sf).withColumn("text", F.replace(F.replace("text", F.lit("."), F.lit(",")), F.lit(" "), F.lit(" • ")))
    spans = s.select(F.floor(F.col("doc_id") / 16).cast("string").alias("book_id"), (F.col("doc_id") % 16 + 1).cast("int").alias("page_number"),
                     F.lit(1024).alias("page_width"), F.lit(2048).alias("page_height"), "idx", "id", "text", "bbox")
    p = O.ordering_prompts(spans)
    return p.select("book_id", "page_number", "exercise_id", "id", "prompt_index", "score", F.col("item_count").alias("items"), F.size("span_ids").alias("lines"))


@query("matching_exercises", "K10 J7 J8 J17 W8 W9 C15")
def _(spark, sf):
    """Two dot columns per page with one row per line and text on both sides; checked by fixtures in the tests."""
    s = T.lines(spark, sf)
    key = [F.floor(F.col("doc_id") / 16).cast("string").alias("book_id"), (F.col("doc_id") % 16 + 1).cast("int").alias("page_number")]
    y = F.col("i") / 128.0
    sides = F.array(F.struct(F.lit("l").alias("p"), F.lit(0.375).alias("dx"), F.lit(0.125).alias("tx")),
                    F.struct(F.lit("r").alias("p"), F.lit(0.5).alias("dx"), F.lit(0.625).alias("tx")))
    rows = s.select(*key, "i", "line", "len", y.alias("y"), F.explode(sides).alias("s"))
    dots = rows.where((F.col("len") % 7 != 0) | (F.col("s.p") == "l")).select(
        "book_id", "page_number", F.concat("s.p", F.col("i").cast("string")).alias("id"), F.col("s.dx").alias("x"), "y",
        G.box(F.col("s.dx"), F.col("y"), 1 / 512, 1 / 512).alias("bbox"))
    spans = rows.select("book_id", "page_number", (F.col("i") * 2 + (F.col("s.p") == "r").cast("int")).alias("idx"),
                        F.concat(F.lit("s"), F.col("s.p"), F.col("i").cast("string")).alias("id"),
                        F.concat(F.when(F.col("s.p") == "l", F.concat((F.col("i") % 90).cast("string"), F.lit(". "))).otherwise(F.lit("A ")), F.col("line")).alias("text"),
                        F.lit(0.9).alias("confidence"), G.box(F.col("s.tx"), F.col("y") - 1 / 1024, 0.125, 1 / 512).alias("bbox"))
    m = M.matching_items(dots, spans)
    return m.select("book_id", "page_number", "id", "score", F.size("left_items").alias("items"))
