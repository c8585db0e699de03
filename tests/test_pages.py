"""Page documents: sources, flattening, choices, lessons, contexts and prompts on hand-made pages."""

import json

import pytest
from pyspark.sql import functions as F

from leafgrade import schemas as SC
from leafgrade.functions import geometry as G
from leafgrade.operators import choices, context, flatten, lessons, matching, ordering, quality
from leafgrade.sources import readers, sinks


def bb(x, y, w=0.2, h=0.02):
    return {"x": x, "y": y, "width": w, "height": h}


def span(i, text, x, y, w=0.2, h=0.02, line=None, conf=0.99):
    return {"id": i, "text": text, "confidence": conf, "confidenceScope": "line", "parentLineId": line, "bbox": bb(x, y, w, h)}


def ring(i, x, y, group="g", near=()):
    return {"id": i, "kind": "choice", "targetBbox": bb(x, y, 0.02, 0.02), "interactionBbox": bb(x, y, 0.03, 0.03), "optionGroupId": group,
            "detectionMethod": "empty-ring-v1", "candidateScore": 0.5 + x, "nearbyTextSpanIds": list(near)}


def exercise(i, ids, spans=(), kind="choice", number="1", title="Titel", order=1, box=None):
    return {"id": i, "number": number, "title": title, "instruction": "Wähle.", "kind": kind, "bbox": box or bb(0, 0, 1, 1), "sourceOrder": order,
            "interactionIds": list(ids), "contextSpanIds": list(spans), "detectionMethod": "vision-semantic-v1", "confidence": 0.9}


def page(spark, doc, number=1, book="b"):
    full = {"schemaVersion": "0.2.0", "pageNumber": number, "width": 1000, "height": 1000, "language": "de", **doc}
    raw = spark.createDataFrame([(book, number, json.dumps(full))], "book_id string, page_number int, analysis string")
    return readers.with_legacy_defaults(readers.parse_page_documents(raw))


def test_absent_and_legacy_documents(spark):
    raw = spark.createDataFrame([("b", 1, '{"pageNumber":1,"futureField":3}'), ("b", 2, "{oops"), ("b", 3, "  "), ("b", 4, None)],
                                "book_id string, page_number int, analysis string")
    docs = readers.with_legacy_defaults(readers.parse_page_documents(raw)).collect()
    assert [(d.page_number, d.schemaVersion, d.textSpans, d.semanticExercises) for d in docs] == [(1, "legacy", [], [])]


def test_choices_merge_promote_and_are_idempotent(spark):
    doc = {"choiceGroups": [{"id": "g", "options": [{"id": "g-1", "label": "ja"}, {"id": "g-2", "label": "nein"}]}],
           "choiceTargets": [ring("c3", 0.1, 0.30), ring("c1", 0.1, 0.10, near=["s1"]), ring("c2", 0.5, 0.105, near=["s2", "s1"]), ring("free", 0.9, 0.5, None)],
           "choiceDetection": {"detectionMethod": "m", "rawCandidateCount": 4, "acceptedCount": 4, "groupCount": 1, "durationMs": 1},
           "semanticExercises": [exercise("e", ["c1", "c2", "c3"], kind="choice-grid")]}
    once = choices.normalize_choices(page(spark, doc))
    row = once.collect()[0]
    assert [t.id for t in row.choiceTargets] == ["free"] and row.choiceDetection.acceptedCount == 1
    grid = row.choiceGrids[0]
    assert grid.id == "e-grid" and [r.id for r in grid.rows] == ["c1-row", "c3-row"] and grid.candidateScore == 0.6
    assert grid.rows[0].nearbyTextSpanIds == ["s1", "s2"] and [c.optionId for c in grid.rows[0].cells] == ["g-1", "g-2"]
    assert row.semanticExercises[0].interactionIds == ["e-grid"] and row.choiceGridDetection.rawCandidateCount == 2
    twice = choices.normalize_choices(once).collect()[0]
    assert twice.choiceTargets == row.choiceTargets and twice.choiceGrids == row.choiceGrids and twice.semanticExercises == row.semanticExercises


def blank(i, x, y, near):
    return {"id": i, "kind": "fill-in-line", "lineBbox": bb(x, y, 0.1, 0.002), "interactionBbox": bb(x, y, 0.1, 0.02), "detectionMethod": "horizontal-line-v1",
            "candidateScore": 0.8, "nearbyTextSpanIds": near}


LESSON = {
    "textSpans": [span("t", "Mein Tag", 0.1, 0.02, 0.5, 0.05), span("a", "a) Ich", 0.1, 0.30, 0.1), span("b", "gern Tee .", 0.4, 0.30, 0.2),
                  span("q1", "Er kommt heute.", 0.1, 0.60), span("q2", "Sie geht.", 0.1, 0.70), span("n", "ja", 0.6, 0.60), span("p", "(Tipp hier)", 0.1, 0.8)],
    "exerciseBlanks": [blank("b1", 0.25, 0.30, ["a", "b"]), blank("b2", 0.25, 0.34, []), blank("b3", 0.25, 0.50, [])],
    "choiceGroups": [{"id": "g", "options": [{"id": "g-1", "label": "ja"}]}, {"id": "h", "options": [{"id": "h-1", "label": "nein"}]}],
    "choiceTargets": [ring("c1", 0.5, 0.60), ring("c2", 0.5, 0.70, "h")],
    "semanticExercises": [exercise("e1", ["c1", "c2"], ["q1", "q2", "n", "p"], order=1)],
}


def test_lesson_blocks_and_steps(spark):
    out = lessons.project_lesson(page(spark, LESSON).withColumn("unit_title", F.lit(None).cast("string"))).collect()[0]
    assert (out.status, out.title, out.interaction_count, out.block_count) == ("AVAILABLE", "Mein Tag", 5, 3)
    choice, first, second = out.blocks
    assert choice.id == "e1" and choice.kind == "choice" and choice.source_order == 1 and choice.confidence == 1.0
    assert [(i.id, i.prompt) for i in choice.items] == [("c1", "Er kommt heute."), ("c2", "Sie geht.")]
    # each choice block took one sentence; the other one's copy is a prompt of its sibling and drops out
    assert choice.paragraphs == [] and choice.group_id is None and choice.interaction_ids == ["c1", "c2"]
    assert [i.id for i in first.items] == ["b1", "b2"] and first.items[0].prompt == "Ich _____ gern Tee." and first.items[0].label == "a)"
    assert [i.id for i in second.items] == ["b3"]
    steps = lessons.lesson_steps(lessons.project_lesson(page(spark, LESSON))).orderBy("step_index").collect()
    assert [(s.kind, s.item_count, s.id) for s in steps] == [
        ("activity", 2, "e1"), ("activity", 2, "page-1-fill-b1"), ("activity", 1, "page-1-fill-b3"), ("completion", None, "b:page:1:completion")]


def test_step_completion_counts_missing_answers(spark):
    doc = {**LESSON, "matchingInteractions": [{"id": "m", "kind": "matching", "bbox": bb(0.1, 0.9), "detectionMethod": "d", "candidateScore": 0.5, "cardinality": "one-to-one",
                                               "nearbyTextSpanIds": [], "leftItems": [{"id": "l1", "nearbyTextSpanIds": []}, {"id": "l2", "nearbyTextSpanIds": []}], "rightItems": []}]}
    log = [("u", "c1", "ja", 1), ("u", "c2", "nein", 1), ("u", "b1", "trinke", 1), ("u", "b2", "x", 1), ("u", "b2", " ", 2), ("u", "m", '{"l1":"A","l2":"B"}', 1), ("v", "m", '{"l1":"A"}', 1)]
    answers = spark.createDataFrame([(u, "b", 1, i, v, t) for u, i, v, t in log], "learner_id string, book_id string, page_number int, interaction_id string, value string, updated_at int")
    got = {(r.learner_id, r.step_id): r.complete for r in lessons.step_completion(lessons.project_lesson(page(spark, doc)), answers).collect()}
    steps = ("e1", "page-1-fill-b1", "page-1-fill-b3", "page-1-matching-m")
    assert got == {**dict(zip([("u", s) for s in steps], [True, False, False, True])), **{("v", s): False for s in steps}}


def test_spans_of_equal_id_and_unknown_ids(spark):
    doc = {**LESSON, "textSpans": [*LESSON["textSpans"], span("q2", "Wir gehen.", 0.1, 0.70)], "exerciseBlanks": [blank("b1", 0.25, 0.30, ["zzz", "a", None, "a"])]}
    blocks = {b.id: b for b in lessons.project_lesson(page(spark, doc)).collect()[0].blocks}
    # the last span of an id counts; unknown ids stay in the evidence without text
    assert [i.prompt for i in blocks["e1"]["items"]] == ["Er kommt heute.", "Wir gehen."]
    assert blocks["page-1-fill-b1"].span_ids == ["zzz", "a"] and blocks["page-1-fill-b1"]["items"][0].label == "a)"


def test_lesson_reasons_and_contexts(spark):
    long_text = "Das ist ein langer Satz über den Alltag in der Stadt und auf dem Land."
    doc = {"textSpans": [span("s1", long_text, 0.1, 0.3), span("s2", long_text, 0.1, 0.33), span("s3", "Bitte lesen", 0.1, 0.6)]}
    ok = lessons.project_lesson(page(spark, doc)).collect()[0]
    assert ok.status == "AVAILABLE" and [(b.variant, len(b.paragraphs)) for b in ok.blocks] == [("theory", 2), ("instruction", 1)]
    assert [s.kind for s in lessons.lesson_steps(lessons.project_lesson(page(spark, doc))).collect()] == ["context", "context", "completion"]
    thin = {"textSpans": doc["textSpans"][:1]}
    assert lessons.project_lesson(page(spark, thin)).collect()[0].reason == "NO_MEANINGFUL_CONTENT"
    other = page(spark, {**doc, "pageNumber": 9})
    assert lessons.project_lesson(other).collect()[0].reason == "SOURCE_MISMATCH"


def books(spark):
    return spark.createDataFrame([("b", "Buch", "de")], "book_id string, title string, source_language string")


def test_contexts(spark):
    docs = page(spark, LESSON)
    req = spark.createDataFrame([(1, "b", 1, "c2"), (2, "b", 1, "b1"), (3, "b", 1, "zzz")], "request_id int, book_id string, page_number int, exercise_id string")
    slots = spark.createDataFrame([("b", 1, "choice", 1, "RESOLVED")], "book_id string, page_number int, kind string, ordinal int, resolution string")
    got = {r.request_id: r for r in context.build_context(req, docs, books(spark), slots).collect()}
    assert {k: r.context_ok for k, r in got.items()} == {1: True, 2: True, 3: False} and got[3].title is None and got[1].title == "Buch — Titel" and got[1].options == ["nein"] and got[1].source_backed
    assert got[1].source == "Er kommt heute. Sie geht. ja (Tipp hier)" and got[2].source == "a) Ich gern Tee ." and not got[2].source_backed


def test_selection_contexts(spark):
    near = {**LESSON, "semanticExercises": [exercise("e1", ["c1"], ["q1"], box=bb(0.05, 0.55, 0.9, 0.2)), exercise("e2", ["c2"], ["q2"], number="2", box=bb(0.05, 0.8, 0.9, 0.1))]}
    docs = page(spark, near)
    rows = [(1, 0.05, 0.58, 0.9, 0.1), (2, 0.05, 0.28, 0.9, 0.05), (3, 0.0, 0.5, 1.2, 0.1), (4, 0.05, 0.1, 0.1, 0.05), (5, 0.0, 0.5, 1.0, 0.45)]
    req = spark.createDataFrame([(i, "b", 1, x, y, w, h) for i, x, y, w, h in rows], "request_id int, book_id string, page_number int, x double, y double, w double, h double")
    req = req.withColumn("selection", G.box(F.col("x"), F.col("y"), F.col("w"), F.col("h"))).drop("x", "y", "w", "h")
    got = {r.request_id: r for r in context.build_selection_context(req, docs, books(spark)).collect()}
    assert {k for k, r in got.items() if r.context_ok} == {1, 2, 5} and len(got) == 5 and got[4].source is None
    assert got[1].title == "Buch — Exercise 1: Titel" and got[1].kind == "choice" and got[1].source == "Er kommt heute. ja"
    assert got[2].title == "Buch — selected page region" and got[2].source == "a) Ich gern Tee ."
    assert got[5].title == "Buch — selected exercises 1, 2" and got[5].source == "Er kommt heute. ja Sie geht."


def test_integrity(spark):
    doc = {**LESSON, "semanticExercises": [exercise("e", ["c1", "x"], ["q1", "gone"]), exercise("e", ["c1", "c2"])]}
    got = {(r.rule, r.exercise_id, r.value) for r in quality.integrity_report(page(spark, doc)).collect()}
    assert got == {("unknown_interaction", "e", "x"), ("unknown_span", "e", "gone"), ("duplicate_exercise", "e", "e"), ("shared_interaction", "e", "c1")}


def test_ordering_prompts(spark):
    rows = [("s0", "1 ich • gehe • jetzt gleich noch", 0.10, 0.10), ("s1", "weiter • nach • Hause.", 0.10, 0.122), ("s2", "du • kommst • morgen früh zurück?", 0.10, 0.17),
            ("s3", "wir • essen • heute im Restaurant", 0.10, 0.22), ("n2", "2", 0.05, 0.17), ("n3", "3", 0.05, 0.22)]
    df = spark.createDataFrame([("b", 7, 1000, 1000, i, r[0], r[1], r[2], r[3]) for i, r in enumerate(rows)],
                               "book_id string, page_number int, page_width int, page_height int, idx int, id string, text string, x double, y double")
    df = df.withColumn("bbox", G.box(F.col("x"), F.col("y"), F.when(F.col("id").startswith("n"), 0.02).otherwise(0.4), 0.02)).drop("x", "y")
    out = ordering.ordering_prompts(df).orderBy("prompt_index").collect()
    assert [o.id for o in out] == [f"sentence-ordering-7-1-{n}" for n in (1, 2, 3)]
    assert out[0].span_ids == ["s0", "s1"] and [i.text for i in out[0]["items"]] == ["1 ich", "gehe", "jetzt gleich noch", "weiter", "nach", "Hause", "."]
    assert [i.text for i in out[1]["items"]] == ["du", "kommst", "morgen früh zurück", "?"] and out[1].exercise_id == "sentence-order-exercise-7-1"


def test_matching_items(spark):
    ys = [0.2, 0.25, 0.3, 0.35]
    dots = [("b", 2, f"{p}{i}", x, y) for p, x in (("l", 0.4), ("r", 0.6)) for i, y in enumerate(ys) if (p, i) != ("r", 3)]
    d = spark.createDataFrame(dots, "book_id string, page_number int, id string, x double, y double").withColumn("bbox", G.box(F.col("x"), F.col("y"), 0.002, 0.002))
    texts = [("b", 2, 2 * i + k, f"{'lr'[k]}t{i}", t, 0.1 + 0.6 * k, y - 0.01) for i, y in enumerate(ys) for k, t in ((0, f"{i + 1}. links {i}"), (1, f"{'ABCD'[i]} rechts {i}"))]
    s = spark.createDataFrame(texts, "book_id string, page_number int, idx int, id string, text string, x double, y double").withColumn(
        "bbox", G.box(F.col("x"), F.col("y"), 0.2, 0.02)).withColumn("confidence", F.lit(0.9))
    out = matching.matching_items(d, s).collect()
    assert len(out) == 1 and out[0].id == "matching-2-1" and out[0].score == pytest.approx(0.4 * 0.75 + 0.6)
    assert [(i.label, i.text) for i in out[0].left_items] == [(str(n + 1), f"links {n}") for n in range(4)]
    assert [(i.label, i.text, i.anchor_bbox is None) for i in out[0].right_items] == [("ABCD"[n], f"rechts {n}", n == 3) for n in range(4)]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "Mein.Buch.pdf").write_bytes(b"%PDF")
    (tmp_path / "in" / "notiz.txt").write_bytes(b"x")
    got = {r.name: (r.title, r.checksum[:6], r.reject_reason) for r in readers.register_books(spark, str(tmp_path / "in")).collect()}
    assert got["Mein.Buch.pdf"][0::2] == ("Mein.Buch", None)
    assert got["notiz.txt"][2] == "File must have .pdf extension"
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "1.json").write_text(json.dumps({"pageNumber": 1, "textSpans": []}))
    (tmp_path / "docs" / "2.json").write_text("{")
    assert readers.read_page_analyses(spark, str(tmp_path / "docs")).count() == 1
    old = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "k int, made string, v int")
    new = spark.createDataFrame([(2, "z", 21, 1), (2, "y", 22, 2), (3, "c", 30, 1)], "k int, made string, v int, ver int")
    merged = sinks.upsert_latest(old, new, ["k"], ["v"], ["ver"])
    assert {tuple(r) for r in merged.collect()} == {(1, "a", 10), (2, "b", 22), (3, "c", 30)}
    sinks.write_upsert(old, new, ["k"], ["v"], str(tmp_path / "upserted"), ["ver"], ["k"])
    assert {(r.k, r.made, r.v) for r in spark.read.parquet(str(tmp_path / "upserted")).collect()} == {(1, "a", 10), (2, "b", 22), (3, "c", 30)}
    pages = spark.createDataFrame([("b", 2), ("a", 10), ("b", 1), ("a", 9)], "book_id string, page_number int")
    assert [tuple(r) for r in readers.list_pages(pages).collect()] == [("a", 9), ("a", 10), ("b", 1), ("b", 2)]
    assert sinks.merge_into_sql("t", "s", ["k"], ["k", "v"], ["v"]).startswith("MERGE INTO t")
    docs = page(spark, LESSON).withColumn("status", F.lit("READY")).withColumn("processor", F.struct(
        F.lit("e").alias("engine"), F.lit("m").alias("model"), F.current_timestamp().alias("processedAt")))
    with pytest.raises(ValueError, match="export refused"):
        sinks.export_validated(docs, str(tmp_path / "bad"), SC.SCHEMA_VERSION, "e", "other")
    assert not (tmp_path / "bad").exists()
    sinks.export_validated(docs, str(tmp_path / "good"), SC.SCHEMA_VERSION, "e", "m")
    assert spark.read.json(str(tmp_path / "good" / "manifest")).collect()[0].page_count == 1


def test_rotation_and_pixels(spark):
    df = spark.createDataFrame([(0.1, 0.2, 0.3, 0.4)], "x double, y double, w double, h double")
    b = G.box(F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    turned = b
    for _ in range(4):
        turned = G.bbox_rotate(turned, F.lit(90))
    px = G.bbox_denormalize(b, F.lit(997), F.lit(1003))
    back = G.bbox_normalize(px["left"], px["top"], px["right"], px["bottom"], F.lit(997), F.lit(1003))
    r = df.select(turned.alias("t"), back.alias("n")).collect()[0]
    for part, want in zip(("x", "y", "width", "height"), (0.1, 0.2, 0.3, 0.4)):
        assert r.t[part] == pytest.approx(want) and abs(r.n[part] - want) < 2 / 997
    with pytest.raises(Exception, match="positive"):
        df.select(G.bbox_normalize(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.lit(0), F.lit(5))).collect()


def test_flatten_defaults(spark):
    rows = flatten.explode_interactions(page(spark, LESSON)).collect()
    assert [(r.kind, r.ordinal, r.id) for r in rows] == [("fill-in-line", 0, "b1"), ("fill-in-line", 1, "b2"), ("fill-in-line", 2, "b3"), ("choice", 0, "c1"), ("choice", 1, "c2")]
