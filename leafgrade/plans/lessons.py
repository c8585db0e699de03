"""Lesson queries: whole blocks with their prompts, their steps, and which steps a learner has completed."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafgrade.operators import lessons as L
from leafgrade.plans import tables as T
from leafgrade.plans.documents import LESSON, PAGE_SQL, documents
from leafgrade.plans.registry import query

_SPACE = "[ \\t\\r\\x{00A0}]"


def _trim(text: str) -> str:
    return f"regexp_replace({text}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _tidy(text: str) -> str:
    """Span texts joined by spaces, as one text; a dot keeps the space before it if a second dot follows."""
    t = f"regexp_replace(regexp_replace({text}, '{_SPACE}+', ' ', 'g'), ' +([,;:!?])', '\\1', 'g')"
    t = f"replace(replace(regexp_replace({t}, ' +\\.', chr(1), 'g'), chr(1) || '.', ' ..'), chr(1), '.')"
    t = f"regexp_replace(regexp_replace({t}, '!( *!)+', '!', 'g'), '\\?( *\\?)+', '?', 'g')"
    return f"nullif({_trim(t)}, '')"


def _agg(where: str = "") -> str:
    """The texts of span rows in reading order."""
    return _tidy(f"string_agg(t, ' ' ORDER BY y, x, j) FILTER (WHERE t <> ''{' AND ' + where if where else ''})")


#: Interactions by kind (length of a line modulo 11), their spans, prompts, exercises and blocks.
BLOCKS = f"""WITH {T.LINES},
s AS (SELECT *, y + h / 2 AS cy, x + w AS r, y + h AS b, 50 + len % 50 >= 55 AND length(t) > 1 AND regexp_matches(t, '[A-Za-z]') AS ok FROM (
  SELECT doc_id, i AS j, len, {_trim('line')} AS t, x, y, w, h, CASE WHEN len % 3 <> 0 THEN i // 3 END AS ln FROM ln)),
q AS (SELECT doc_id, i, len % 11 AS fam, len, x AS bx, y AS bt, CAST(0.25 AS DOUBLE) AS bw, CAST(6 AS DOUBLE) / 512 AS bh FROM ln WHERE len % 11 < 6),
near AS (SELECT q.*, s.* EXCLUDE (doc_id, len) FROM q JOIN s ON s.doc_id = q.doc_id AND (s.j = q.i OR s.j = q.i + 1)),
own AS (SELECT doc_id, i, fam, any_value(bx) AS bx, any_value(bt) AS bt, any_value(bw) AS bw, any_value(bh) AS bh, count(*) FILTER (WHERE ok) AS n,
  {_agg('ok')} AS own, {_agg()} AS every, avg(cy) FILTER (WHERE ok) AS anchor, arg_min(ln, j) FILTER (WHERE ok AND ln IS NOT NULL) AS line FROM near GROUP BY ALL),
print AS (SELECT doc_id, ln, {_agg('(ok OR regexp_matches(t, ' + repr('^[,.;:!?]$') + '))')} AS wide FROM s WHERE ln IS NOT NULL GROUP BY ALL),
closest AS (SELECT doc_id, i, {_tidy('arg_min(t, [CASE WHEN beside THEN 0e0 ELSE 1e0 END, CASE WHEN NOT beside THEN abs(cy - (bt + bh / 2)) WHEN bx + bw / 2 < x THEN x - (bx + bw / 2) WHEN bx + bw / 2 > r THEN bx + bw / 2 - x - w ELSE 0e0 END, CASE WHEN beside THEN abs(cy - (bt + bh / 2)) ELSE j END, CASE WHEN beside THEN w ELSE 0e0 END, j])')} AS one
  FROM (SELECT *, b >= bt - 14e-3 AND y <= bt + bh + 14e-3 AS beside FROM near WHERE ok) GROUP BY ALL),
near_text AS (SELECT own.*, CASE WHEN n = 0 THEN NULL WHEN line IS NULL OR NOT (own IS NULL OR length(own) < 24 OR n = 1) THEN own
  WHEN length(wide) > coalesce(length(own), 0) THEN wide ELSE one END AS around
  FROM own LEFT JOIN print p ON p.doc_id = own.doc_id AND p.ln = own.line LEFT JOIN closest c ON c.doc_id = own.doc_id AND c.i = own.i),
row AS (SELECT o.doc_id, o.i, s.* EXCLUDE (doc_id), o.n, o.bx, o.bw, o.line FROM own o JOIN s ON s.doc_id = o.doc_id AND o.fam = 0 AND abs(s.cy - o.anchor) <= 12e-3
  AND (s.ok OR regexp_matches(s.t, '^[,.;:!?]$'))),
src AS (SELECT doc_id, i, j, t, x, y, w, r, bx, bw, line FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, i) AS m FROM row) WHERE m > n
  UNION ALL SELECT k.doc_id, k.i, k.j, k.t, k.x, k.y, k.w, k.r, k.bx, k.bw, o.line FROM near k JOIN own o USING (doc_id, i)
  WHERE k.ok AND k.fam = 0 AND (SELECT count(*) FROM row z WHERE z.doc_id = k.doc_id AND z.i = k.i) <= o.n),
gap0 AS (SELECT doc_id, i, {_agg()} AS whole, bool_or(x < bx + bw AND r > bx) AS over, {_agg('r <= bx + 6e-3')} AS lt, {_agg('x >= bx + bw - 6e-3')} AS rt,
  count(*) FILTER (WHERE r <= bx + 6e-3) AS nl, count(*) FILTER (WHERE x >= bx + bw - 6e-3) AS nr, any_value(line) AS line FROM src GROUP BY ALL),
gap AS (SELECT doc_id, i, CASE WHEN whole IS NULL OR regexp_matches(whole, '_{{2,}}') THEN whole WHEN over OR nl = 0 OR nr = 0 THEN CASE WHEN line IS NULL THEN whole END
  WHEN lt IS NULL OR rt IS NULL THEN whole ELSE trim(regexp_replace(lt || ' _____ ' || rt, ' +([,.;:!?])', '\\1', 'g')) END AS gapped FROM gap0),
raw AS (SELECT t.*, q.len, CASE WHEN t.fam = 0 THEN coalesce(gapped, around) WHEN t.fam IN (1, 2) THEN around END AS raw
  FROM near_text t JOIN q USING (doc_id, i) LEFT JOIN gap g ON g.doc_id = t.doc_id AND g.i = t.i),
item AS (SELECT *, CASE WHEN fam = 0 THEN nullif(regexp_extract(raw, '^((?:[A-Za-z]|\\d+)[.)])', 1), '') END AS label FROM raw),
site AS (SELECT * EXCLUDE (raw, label), label, CASE WHEN label IS NULL THEN raw ELSE nullif(regexp_replace(raw, '^(?:' || regexp_escape(label) || ' *)+', ''), '') END AS prompt,
  CASE fam WHEN 0 THEN 'blank-' WHEN 1 THEN 'choice-' WHEN 2 THEN 'grid-' WHEN 3 THEN 'ord-' WHEN 4 THEN 'mat-' ELSE 'free-' END || i AS id,
  CASE WHEN i % 16 = 1 THEN i WHEN i % 16 = 9 AND EXISTS (SELECT 1 FROM q e WHERE e.doc_id = item.doc_id AND e.i = item.i - 8) THEN i - 8 END AS lead FROM item),
cut AS (SELECT *, CASE WHEN fam = 0 AND bt - lag(bt + bh) OVER w > 55e-3 THEN 1 ELSE 0 END AS f FROM site WINDOW w AS (PARTITION BY doc_id, fam ORDER BY bt, i)),
grp AS (SELECT *, CASE fam WHEN 0 THEN 'f' || sum(f) OVER (PARTITION BY doc_id, fam ORDER BY bt, i) WHEN 1 THEN CASE WHEN len % 5 <> 0 THEN 'g' || len % 2 ELSE 'u' || i END
  WHEN 3 THEN 'o' || i // 16 ELSE 'x' || i END AS g, CASE WHEN fam = 0 THEN bt ELSE i END AS pos FROM cut),
blk AS (SELECT doc_id, fam, g, arg_min(id, [pos, i]) AS first_id, min(pos) AS pos, min(i) AS first_i, min(bt) AS source_y, count(*) AS m,
  CASE WHEN fam < 3 AND count(DISTINCT prompt) = 1 THEN min(prompt) WHEN fam = 5 OR fam = 3 AND count(*) = 1 THEN min(every) END AS prompt,
  avg(CAST(len % 8 AS DOUBLE) / 8) AS confidence, CASE WHEN count(DISTINCT lead) = 1 THEN min(lead) END AS lead FROM grp GROUP BY doc_id, fam, g),
mem AS (SELECT grp.*, blk.lead AS own_lead, row_number() OVER (PARTITION BY grp.doc_id, grp.fam, grp.g ORDER BY grp.pos, grp.i) AS nth FROM grp JOIN blk USING (doc_id, fam, g)),
sid AS (SELECT doc_id, fam, g, j, min([pos, i, k]) AS first_at FROM (SELECT doc_id, fam, g, pos, i, unnest([0, 1]) AS k, unnest([i, i + 1]) AS j FROM mem) GROUP BY ALL),
ctx AS (SELECT b.doc_id, b.fam, b.g, s.j, s.t, s.cy, s.y, s.x FROM blk b JOIN s ON s.doc_id = b.doc_id AND (s.j = b.lead + 2 OR s.j = b.lead + 3)
  WHERE s.ok AND NOT EXISTS (SELECT 1 FROM sid z WHERE z.doc_id = b.doc_id AND z.fam = b.fam AND z.g = b.g AND z.j = s.j)
  AND lower(s.t) NOT IN ('x', 'y', 'z', 'titel', 'lies.', CAST(b.lead AS VARCHAR), b.lead || ' titel') AND NOT regexp_matches(s.t, '^\\([^)]{{1,30}}\\)$')),
took AS (SELECT c.*, row_number() OVER (PARTITION BY c.doc_id, c.g ORDER BY abs(c.cy - (m.bt + m.bh / 2)), c.y, c.x, c.j) AS nth FROM ctx c JOIN mem m
  ON m.doc_id = c.doc_id AND m.fam = 1 AND c.fam = 1 AND m.g = c.g AND m.nth = 1),
told AS (SELECT m.*, coalesce(k.t, m.prompt) AS said FROM mem m LEFT JOIN took k ON k.doc_id = m.doc_id AND k.g = m.g AND k.nth = m.nth AND m.fam = 1),
left_over AS (SELECT c.* FROM ctx c WHERE c.fam <> 1 UNION ALL SELECT k.* EXCLUDE (nth) FROM took k WHERE k.nth > (SELECT count(*) FROM mem m WHERE m.doc_id = k.doc_id AND m.fam = 1 AND m.g = k.g)),
one AS (SELECT *, CASE WHEN fam = 1 AND lead IS NOT NULL THEN 'e' || lead ELSE fam || g END AS whole FROM blk),
mix AS (SELECT *, count(*) OVER (PARTITION BY doc_id, whole) AS parts, row_number() OVER (PARTITION BY doc_id, whole ORDER BY first_i) AS part,
  min(g) OVER (PARTITION BY doc_id, whole) = max(g) OVER (PARTITION BY doc_id, whole) AS alike FROM one),
block AS (SELECT doc_id, whole, any_value(fam) AS fam, any_value(lead) AS lead, min(source_y) AS source_y, arg_min(prompt, part) FILTER (WHERE part = 1) AS prompt, min(confidence) AS confidence, CAST(sum(m) AS INT) AS m,
  bool_and(g LIKE 'g%') AND bool_and(alike) AND any_value(fam) = 1 OR any_value(fam) = 2 AS grouped,
  CASE WHEN any_value(parts) > 1 THEN 'ex-' || any_value(lead) ELSE 'page-' || any_value(doc_id % 16 + 1) || CASE any_value(fam) WHEN 0 THEN '-fill-' WHEN 1 THEN '-choice-' WHEN 2 THEN '-grid-' WHEN 3 THEN '-ordering-oex-'
   WHEN 4 THEN '-matching-' ELSE '-free-' END || CASE WHEN any_value(fam) = 3 THEN CAST(min(first_i) // 16 AS VARCHAR) ELSE min(first_id) END END AS id FROM mix GROUP BY doc_id, whole),
place AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(lead + 1, 2147483647), source_y, id) - 1 AS position FROM block),
spans AS (SELECT doc_id, whole, string_agg('s' || j, ',' ORDER BY first_at) AS span_ids FROM (SELECT z.doc_id, whole, j, min([part] || first_at) AS first_at FROM sid z JOIN mix USING (doc_id, fam, g) GROUP BY ALL) GROUP BY ALL),
ids AS (SELECT doc_id, whole, string_agg(CASE WHEN fam = 2 THEN id || ',' || id || '-r0,' || id || '-r1' ELSE id END, ',' ORDER BY part, CASE WHEN fam = 3 THEN i ELSE nth END) AS interaction_ids,
  string_agg(CASE WHEN fam = 2 THEN id || '-r0|' || coalesce(said, '') || '|;' || id || '-r1|' ELSE id || '|' END || coalesce(said, '') || '|' || coalesce(label, ''), ';' ORDER BY part, CASE WHEN fam = 3 THEN i ELSE nth END) AS items
  FROM told JOIN mix USING (doc_id, fam, g) GROUP BY ALL),
para AS (SELECT doc_id, whole, string_agg(t, '|' ORDER BY first_at) AS paragraphs FROM (SELECT l.doc_id, whole, l.t, min([part, l.y, l.x, l.j]) AS first_at FROM left_over l JOIN mix USING (doc_id, fam, g)
  WHERE parts = 1 OR NOT EXISTS (SELECT 1 FROM told o JOIN mix x USING (doc_id, fam, g) WHERE x.doc_id = l.doc_id AND x.whole = mix.whole AND lower(o.said) = lower(l.t))
  GROUP BY l.doc_id, whole, l.t, CASE WHEN parts = 1 THEN l.j END) GROUP BY ALL)"""


@query("lesson_blocks", "K4 J12 J18 A6 A12 C4 C5 C6 C7 T2 T4", f"""{BLOCKS}
SELECT {PAGE_SQL}, CAST(position AS INT) AS position, id, ['fill-blank', 'choice', 'choice-grid', 'sentence-ordering', 'matching', 'free-text'][fam + 1] AS kind, prompt,
 CASE WHEN lead IS NOT NULL THEN 'ex-' || lead WHEN fam = 3 THEN substr(id, instr(id, 'oex-')) END AS exercise_id, CAST(lead + 1 AS INT) AS source_order, confidence, source_y,
 CASE WHEN grouped THEN 'x,y,z' END AS options, span_ids, interaction_ids, md5(items) AS items, CASE WHEN lead IS NOT NULL THEN coalesce(paragraphs, '') END AS paragraphs
FROM place JOIN spans USING (doc_id, whole) JOIN ids USING (doc_id, whole) LEFT JOIN para USING (doc_id, whole)""")
def _(spark, sf):
    """Every interaction block of every page, with the texts read for it."""
    lessons = L.project_lesson(documents(spark, sf)).where("status = 'AVAILABLE'")
    rows = lessons.select("book_id", "page_number", F.posexplode("blocks").alias("position", "b")).where("b.kind <> 'context'")
    none = lambda c: F.coalesce(c, F.lit(""))
    items = F.array_join(F.transform("b.items", lambda x: F.concat(x["id"], F.lit("|"), none(x["prompt"]), F.lit("|"), none(x["label"]))), ";")
    return rows.select("book_id", "page_number", "position", "b.id", "b.kind", "b.prompt", "b.exercise_id", "b.source_order", "b.confidence", "b.source_y",
                       F.array_join("b.options", ",").alias("options"), F.array_join("b.span_ids", ",").alias("span_ids"),
                       F.array_join("b.interaction_ids", ",").alias("interaction_ids"), F.md5(items).alias("items"),
                       F.array_join(F.transform("b.paragraphs", lambda p: p["text"]), "|").alias("paragraphs"))


ITEMS = "CASE fam WHEN 2 THEN 2 WHEN 4 THEN 2 ELSE m END"
STEPS = f"""{BLOCKS},
ans AS (SELECT doc_id, whole, fam, part, i, nth, unnest(CASE WHEN fam = 2 THEN [id || '-r0', id || '-r1'] ELSE [id] END) AS answer FROM told JOIN mix USING (doc_id, fam, g)),
act AS (SELECT doc_id, whole, fam, m, position, CASE WHEN lead IS NOT NULL THEN 'ex-' || lead WHEN fam = 3 THEN substr(id, instr(id, 'oex-')) ELSE id END AS id FROM place)"""


@query("lesson_steps", "K5", f"""{STEPS}, a AS (SELECT doc_id, count(*) AS steps, CAST(sum({ITEMS}) AS BIGINT) AS items FROM act GROUP BY 1),
c AS (SELECT doc_id, blocks FROM ({LESSON} SELECT doc_id, blocks FROM s WHERE paras >= 2 AND chars >= 120) WHERE doc_id NOT IN (SELECT doc_id FROM a)),
u AS (SELECT doc_id, 'activity' AS kind, steps, items FROM a UNION ALL SELECT doc_id, 'context', blocks, NULL FROM c
  UNION ALL SELECT doc_id, 'completion', 1, NULL FROM (SELECT doc_id FROM a UNION ALL SELECT doc_id FROM c))
SELECT {PAGE_SQL}, kind, steps, items FROM u""")
def _(spark, sf):
    """Steps per page and kind, with the items of the activities."""
    steps = L.lesson_steps(L.project_lesson(documents(spark, sf)))
    return steps.groupBy("book_id", "page_number", "kind").agg(F.count("*").alias("steps"), F.sum("item_count").alias("items"))


@query("lesson_activities", "K5 K4", f"""{STEPS} SELECT {PAGE_SQL}, CAST(position AS INT) AS step_index, act.id, ['fill-blank', 'choice', 'choice-grid', 'sentence-ordering', 'matching', 'free-text'][act.fam + 1] AS block_kind,
 CAST({ITEMS.replace('fam', 'act.fam')} AS INT) AS item_count, CAST(count(*) OVER (PARTITION BY doc_id) AS INT) AS activity_count, answers AS answer_ids
FROM act JOIN (SELECT doc_id, whole, string_agg(answer, ',' ORDER BY part, CASE WHEN fam = 3 THEN i ELSE nth END, answer) AS answers FROM ans GROUP BY 1, 2) USING (doc_id, whole)""")
def _(spark, sf):
    """Every activity step of every page."""
    steps = L.lesson_steps(L.project_lesson(documents(spark, sf))).where("kind = 'activity'")
    return steps.select("book_id", "page_number", "step_index", "id", "block_kind", "item_count", "activity_count", F.array_join("answer_ids", ",").alias("answer_ids"))


@query("step_completion", "C23 K5", f"""{STEPS}, n AS (SELECT doc_id, count(*) AS n FROM ln GROUP BY 1), {T.EVENTS},
e AS (SELECT user_id % 2 AS learner_id, n.doc_id, CAST(event_id * 31 % n.n AS INT) AS i, k % 4 AS k, ts, event_id FROM ev JOIN n ON n.doc_id = event_id % (SELECT max(doc_id) + 1 FROM documents)),
v AS (SELECT learner_id, e.doc_id, CASE len % 11 WHEN 0 THEN 'blank-' || e.i WHEN 1 THEN 'choice-' || e.i WHEN 2 THEN 'grid-' || e.i || '-r' || e.k % 2 WHEN 3 THEN 'ord-' || e.i WHEN 4 THEN 'mat-' || e.i ELSE 'free-' || e.i END AS answer,
  k, ts, event_id FROM e JOIN ln ON ln.doc_id = e.doc_id AND ln.i = e.i WHERE len % 11 < 6),
l AS (SELECT learner_id, doc_id, answer, arg_max(k, [epoch_us(ts), event_id]) AS k FROM v GROUP BY 1, 2, 3)
SELECT w.learner_id, {PAGE_SQL}, CAST(position AS INT) AS step_index, id AS step_id, bool_and(coalesce(CASE r.fam WHEN 3 THEN l.k = 3 WHEN 4 THEN l.k = 2 ELSE l.k > 0 END, false)) AS complete
FROM (SELECT DISTINCT learner_id, doc_id FROM l) w JOIN act USING (doc_id) JOIN ans r USING (doc_id, whole)
LEFT JOIN l ON l.learner_id = w.learner_id AND l.doc_id = w.doc_id AND l.answer = r.answer GROUP BY w.learner_id, doc_id, position, id""")
def _(spark, sf):
    """Two learners answer some interaction of a page with each event: up to three items placed, pairs made, or a word written."""
    lines = T.lines(spark, sf)
    d = T.table(spark, sf, "documents")
    per_page = d.select("doc_id", F.size(F.split("text", "\n")).alias("n"))
    ev = T.events(spark, sf).withColumn("doc_id", F.col("event_id") % d.agg(F.max("doc_id") + 1).scalar()).join(per_page, "doc_id")
    ev = ev.select((F.col("user_id") % 2).alias("learner_id"), "doc_id", (F.col("event_id") * 31 % F.col("n")).cast("int").alias("i"), (F.col("k") % 4).alias("k"), "ts", "event_id")
    fam, at = F.col("len") % 11, F.col("i").cast("string")
    names = F.array(*[F.lit(x) for x in ("blank-", "choice-", "grid-", "ord-", "mat-", "free-")])
    answer = F.concat(F.get(names, fam), at, F.when(fam == 2, F.concat(F.lit("-r"), (F.col("k") % 2).cast("string"))).otherwise(""))
    some = F.slice(F.array(F.lit(0), F.lit(1), F.lit(2)), F.lit(1), F.col("k"))
    placed = F.array_join(F.transform(some, lambda x: F.concat(F.lit("item"), x.cast("string"))), ",")
    pairs = F.concat(F.lit("{"), F.array_join(F.transform(some, lambda x: F.concat(F.lit('"'), x.cast("string"), F.lit('":"A"'))), ","), F.lit("}"))
    value = F.when(fam == 3, placed).when(fam == 4, pairs).when(F.col("k") > 0, "word").otherwise("  ")
    answers = ev.join(lines.select("doc_id", "i", "len"), ["doc_id", "i"]).where(fam < 6).select(
        "learner_id", F.floor(F.col("doc_id") / 16).cast("string").alias("book_id"), (F.col("doc_id") % 16 + 1).cast("int").alias("page_number"),
        answer.alias("interaction_id"), value.alias("value"), "ts", "event_id")
    return L.step_completion(L.project_lesson(documents(spark, sf)), answers, order=("ts", "event_id"))
