"""Both graders and their totals.

The server grader and the reader's grader disagree on purpose (punctuation,
extra pairs, choice kinds) and are never mixed. A null verdict means
"undefined" and is not the same as INCORRECT.

Rows are graded in place: an answer row carries its entry and, for choice and
matching, the page's small option or item list as an array, so grading adds no
shuffle to the join that brought answer and slot together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafgrade.functions import textops as X
from leafgrade.functions.arrays import let


def _result(verdict: Column, resolution: Column, correct: Column | None = None, total: Column | None = None) -> Column:
    none = F.lit(None).cast("int")
    return F.struct(
        verdict.cast("string").alias("verdict"), resolution.cast("string").alias("resolution"),
        (none if correct is None else correct.cast("int")).alias("correct"),
        (none if total is None else total.cast("int")).alias("total"),
    )


def _null() -> Column:
    return F.lit(None).cast("string")


def _lit(v: str) -> Column:
    return F.lit(v)


# ---- server grader -------------------------------------------------------------

def grade_server(kind: Column, resolution: Column, learner: Column, expected: Column, alternatives: Column,
                 case_sensitive: Column, punctuation_required: Column, pairs: Column, has_entry: Column,
                 payload_type: Column, compose: bool = True) -> Column:
    """{verdict, resolution} of one answer; ``kind`` is the answer-key kind.

    The gates run in order: no entry, not resolved, free text, blank answer.
    """
    ng = _lit("NOT_AUTO_GRADABLE")
    blank = X.is_blank(learner, X.JAVA_BLANK)
    fill = grade_fill_blank(learner, expected, alternatives, case_sensitive, punctuation_required, compose)
    match = grade_matching(learner, pairs, payload_type)
    verdict = (
        F.when(~has_entry, ng)
        .when(resolution.isNull() | (resolution != "RESOLVED"), ng)
        .when(kind == "FreeText", ng)
        .when(blank, "UNANSWERED")
        .when(kind == "FillBlank", fill)
        .when(kind == "Matching", match)
        .otherwise(ng)
    )
    missing = (has_entry & (resolution == "RESOLVED") & (kind == "FillBlank") & ~blank & (verdict == ng))
    final = F.when(~has_entry, F.coalesce(resolution, _lit("MISSING"))).when(missing, "MISSING").otherwise(resolution)
    return _result(verdict, final)


def grade_fill_blank(learner: Column, expected: Column, alternatives: Column, case_sensitive: Column,
                     punctuation_required: Column, compose: bool = True) -> Column:
    """Equal to the expected text or any alternative after C2; an empty expectation is not gradable.

    All texts of a row are composed together, at most one Python value per row.
    """
    texts = F.concat(F.array(F.coalesce(learner, F.lit("")), F.coalesce(expected, F.lit(""))),
                     F.coalesce(alternatives, F.array().cast("array<string>")))
    composed = X.nfc_each(texts) if compose else texts
    norm = F.transform(composed, lambda t: X.normalize_answer(t, case_sensitive, punctuation_required, compose=False))
    return let(lambda n: F.when(F.get(n, F.lit(1)) == "", "NOT_AUTO_GRADABLE").when(
        F.array_contains(F.slice(n, 2, F.size(n)), F.get(n, F.lit(0))), "CORRECT").otherwise("INCORRECT"), norm)


def grade_matching(learner: Column, pairs: Column, payload_type: Column) -> Column:
    """Expected pairs found among the learner's pairs; extra learner pairs do not matter."""
    given = X.parse_pairs(learner)
    hits = F.size(F.filter(pairs, lambda p: F.exists(
        given, lambda g: (g["leftLabel"] == p["leftLabel"]) & (g["rightLabel"] == p["rightLabel"]))))
    usable = (payload_type == "Matching") & (F.coalesce(F.size(pairs), F.lit(0)) > 0)
    return (
        F.when(~F.coalesce(usable, F.lit(False)), "NOT_AUTO_GRADABLE")
        .when(F.size(given) == 0, "UNANSWERED")
        .when(hits == F.size(pairs), "CORRECT")
        .when(hits > 0, "PARTIALLY_CORRECT")
        .otherwise("INCORRECT")
    )


# ---- reader's grader -----------------------------------------------------------

def _truthy(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


def compare_blank(learner: Column, has_entry: Column, expected: Column, alternatives: Column, case_sensitive: Column,
                  compose: bool = True) -> Column:
    """reader's text comparison."""
    texts = F.concat(F.array(F.coalesce(learner, F.lit("")), F.coalesce(expected, F.lit(""))),
                     F.coalesce(alternatives, F.array().cast("array<string>")))
    composed = X.nfc_each(texts) if compose else texts
    norm = F.transform(composed, lambda t: X.normalize_for_comparison(t, case_sensitive, compose=False))
    equal = let(lambda n: F.array_contains(F.slice(n, 2, F.size(n)), F.get(n, F.lit(0))), norm)
    return (
        F.when(~has_entry, _result(_null(), _lit("UNMAPPED")))
        .when(X.is_blank(learner), _result(_lit("UNANSWERED"), _lit("RESOLVED")))
        .when(equal, _result(_lit("CORRECT"), _lit("RESOLVED")))
        .otherwise(_result(_lit("INCORRECT"), _lit("RESOLVED")))
    )


def option_lookup(label: Column, options: Column) -> Column:
    """Id of the only option whose label equals ``label`` (trimmed, any case), else null."""
    def only(wanted: Column) -> Column:
        return let(lambda same: F.when(F.size(same) == 1, F.get(same, F.lit(0))["id"]),
                   F.filter(options, lambda o: F.lower(X.js_trim(o["label"])) == wanted))
    return let(only, F.lower(X.js_trim(label)))


def compare_choice(learner: Column, has_entry: Column, expected: Column, options: Column) -> Column:
    """An expectation that names no single option is ambiguous, never wrong."""
    wanted = option_lookup(expected, options)
    return (
        F.when(~has_entry, _result(_null(), _lit("UNMAPPED")))
        .when(~_truthy(learner), _result(_lit("UNANSWERED"), _lit("RESOLVED")))
        .when(~_truthy(wanted), _result(_null(), _lit("AMBIGUOUS")))
        .when(learner == wanted, _result(_lit("CORRECT"), _lit("RESOLVED")))
        .otherwise(_result(_lit("INCORRECT"), _lit("RESOLVED")))
    )


def compare_grid(row_answers: Column, has_entry: Column, expected: Column, options: Column) -> Column:
    """``row_answers`` is the learner's option id per row in row order (null or empty = open).

    Answered rows without an expected label are not counted as correct.
    """
    def judged(labels: Column, opts: Column) -> Column:
        def row(a: Column, i: Column) -> Column:
            label = F.get(labels, i)
            return F.struct(_truthy(a).alias("answered"), a.alias("answer"), (_truthy(a) & label.isNotNull()).alias("graded"),
                            option_lookup(label, opts).alias("wanted"))
        return F.transform(row_answers, row)

    def verdict(rows: Column) -> Column:
        answered = F.size(F.filter(rows, lambda r: r["answered"]))
        unclear = F.exists(rows, lambda r: r["graded"] & ~_truthy(r["wanted"]))
        hits = F.size(F.filter(rows, lambda r: F.coalesce(r["graded"] & (r["wanted"] == r["answer"]), F.lit(False))))
        total = F.size(rows)
        ok = _lit("RESOLVED")
        return let(lambda correct: (
            F.when(answered == 0, _result(_lit("UNANSWERED"), ok))
            .when(unclear, _result(_null(), _lit("AMBIGUOUS")))
            .when(correct == total, _result(_lit("CORRECT"), ok))
            .when(correct > 0, _result(_lit("PARTIALLY_CORRECT"), ok, correct, total))
            .otherwise(_result(_lit("INCORRECT"), ok))
        ), hits)

    wanted = F.filter(F.transform(F.split(expected, ","), X.js_trim), lambda s: s != "")
    return F.when(~has_entry, _result(_null(), _lit("UNMAPPED"))).otherwise(let(verdict, let(judged, wanted, options)))


def compare_ordering(learner: Column, has_entry: Column, expected: Column, item_count: Column) -> Column:
    """Position by position; an incomplete sequence counts as unanswered."""
    def judge(given: Column, wanted: Column) -> Column:
        hits = F.size(F.filter(F.zip_with(given, wanted, lambda a, b: F.coalesce(a == b, F.lit(False))), lambda v: v))
        n = F.size(given)
        ok = _lit("RESOLVED")
        return let(lambda h: (
            F.when((n == 0) | (n < item_count), _result(_lit("UNANSWERED"), ok))
            .when(n != F.size(wanted), _result(_lit("PARTIALLY_CORRECT"), ok))
            .when(h == n, _result(_lit("CORRECT"), ok))
            .when(h > 0, _result(_lit("PARTIALLY_CORRECT"), ok, h, n))
            .otherwise(_result(_lit("INCORRECT"), ok))
        ), hits)

    wanted = F.filter(F.transform(F.split(expected, ","), X.js_trim), lambda s: s != "")
    return F.when(~has_entry, _result(_null(), _lit("UNMAPPED"))).otherwise(let(judge, X.parse_ordered_answer(learner), wanted))


def comparison_items(items: Column) -> Column:
    """Items {id, label, text} with label and text in comparison form (C3), computed once per row."""
    norm = lambda c: X.normalize_for_comparison(F.coalesce(c, F.lit("")), False, compose=False)
    return F.transform(items, lambda i: F.struct(i["id"].alias("id"), norm(i["label"]).alias("label"), norm(i["text"]).alias("text")))


def matching_item_lookup(value: Column, items: Column) -> Column:
    """Item id by unique id, else by unique label or text, else null; items are in comparison form."""
    def by_text(wanted: Column) -> Column:
        return let(lambda same: F.when(F.size(same) == 1, F.get(same, F.lit(0))["id"]),
                   F.filter(items, lambda i: (i["label"] == wanted) | (i["text"] == wanted)))

    return let(lambda by_id: F.when(F.size(by_id) == 1, F.get(by_id, F.lit(0))["id"]).otherwise(
        let(by_text, X.normalize_for_comparison(F.coalesce(value, F.lit("")), False, compose=False))),
        F.filter(items, lambda i: i["id"] == value))


def compose_items(items: Column) -> Column:
    """Items {id, label, text} with composed label and text; ids are identities and stay as they are."""
    n = F.size(items)
    texts = X.nfc_each(F.concat(F.transform(items, lambda i: i["label"]), F.transform(items, lambda i: i["text"])))
    rows = F.arrays_zip(items.alias("i"), F.slice(texts, F.lit(1), n).alias("l"), F.slice(texts, n + 1, n).alias("t"))
    return F.transform(rows, lambda z: F.struct(z["i"]["id"].alias("id"), z["l"].alias("label"), z["t"].alias("text")))


def source_pairs(expected: Column, pairs: Column, payload_type: Column) -> Column:
    """Payload pairs of a matching payload, else the pairs in the expected text."""
    named = F.transform(pairs, lambda p: F.struct(p["leftLabel"].alias("leftLabel"), p["rightLabel"].alias("rightLabel")))
    return F.when(F.coalesce((payload_type == "Matching") & pairs.isNotNull(), F.lit(False)), named).otherwise(
        X.expected_pairs(F.coalesce(expected, F.lit(""))))


def with_source_pairs(rows: DataFrame, out: str, expected: Column, pairs: Column, payload_type: Column) -> DataFrame:
    """Adds the source pairs with composed labels (C12): labels meet items whatever form either was written in."""
    labels = X.nfc_each(F.concat(F.transform(pairs, lambda p: p["leftLabel"]), F.transform(pairs, lambda p: p["rightLabel"])))
    rows = rows.withColumns({"_pairs": pairs, "_labels": labels, "_text": X.nfc(F.coalesce(expected, F.lit("")))})
    n = F.size("_pairs")
    named = F.when(F.col("_pairs").isNotNull(), F.zip_with(
        F.slice("_labels", F.lit(1), n), F.slice("_labels", n + 1, n), lambda a, b: F.struct(a.alias("leftLabel"), b.alias("rightLabel"))))
    return rows.withColumn(out, source_pairs(F.col("_text"), named, payload_type)).drop("_pairs", "_labels", "_text")


def compare_matching(learner: Column, has_entry: Column, wanted_source: Column, left_items: Column,
                     right_items: Column) -> Column:
    """Expected pairs must resolve completely and one-to-one, or the result is ambiguous."""
    def judge(given: Column, resolved: Column) -> Column:
        total = F.size(resolved)
        complete = (
            F.forall(resolved, lambda p: _truthy(p["l"]) & _truthy(p["r"]))
            & (F.size(F.array_distinct(F.transform(resolved, lambda p: p["l"]))) == total)
            & (F.size(F.array_distinct(F.transform(resolved, lambda p: p["r"]))) == total)
        )
        hits = F.size(F.filter(resolved, lambda p: F.coalesce(F.try_element_at(given, p["l"]) == p["r"], F.lit(False))))
        n = F.size(given)
        ok = _lit("RESOLVED")
        return let(lambda h: (
            F.when(n == 0, _result(_lit("UNANSWERED"), ok))
            .when((total == 0) | ~complete, _result(_null(), _lit("AMBIGUOUS")))
            .when((h == total) & (n == total), _result(_lit("CORRECT"), ok))
            .when(h > 0, _result(_lit("PARTIALLY_CORRECT"), ok, h, total))
            .otherwise(_result(_lit("INCORRECT"), ok))
        ), hits)

    def resolve(source: Column, lefts: Column, rights: Column) -> Column:
        return F.transform(source, lambda p: F.struct(
            matching_item_lookup(p["leftLabel"], lefts).alias("l"), matching_item_lookup(p["rightLabel"], rights).alias("r")))

    pairs = let(resolve, wanted_source, comparison_items(left_items), comparison_items(right_items))
    return F.when(~has_entry, _result(_null(), _lit("UNMAPPED"))).otherwise(
        let(judge, X.parse_matching_answer(learner), pairs))


def check_free_text(has_reference: Column) -> Column:
    """Never graded; resolved when a model answer exists."""
    return _result(_lit("NOT_AUTO_GRADABLE"), F.when(has_reference, "RESOLVED").otherwise("MISSING"))


def grade_all(rows: DataFrame, out: str = "result") -> DataFrame:
    """Grade rows of every kind; a source that is not RESOLVED short-circuits to a null verdict.

    Columns: kind, resolution, learner, row_answers, item_count, options,
    left_items, right_items and the entry: expected, alternatives,
    case_sensitive, pairs, payload_type (null entry columns = no entry).
    The text of a row is composed once for all kinds.
    """
    has_entry = F.col("expected").isNotNull()
    of = lambda kind, c: F.when(F.col("kind") == kind, F.col(c))  # noqa: E731  texts that the row's grader does not read are not composed
    prepared = rows.withColumn("_li", compose_items(of("matching", "left_items"))).withColumn(
        "_ri", compose_items(of("matching", "right_items")))
    prepared = with_source_pairs(prepared, "_source", of("matching", "expected"), of("matching", "pairs"), F.col("payload_type"))
    by_kind = (
        F.when(F.col("kind") == "fill-in-line", compare_blank(
            *(of("fill-in-line", c) if c != "entry" else has_entry for c in ("learner", "entry", "expected", "alternatives")), F.col("case_sensitive")))
        .when(F.col("kind") == "choice", compare_choice(F.col("learner"), has_entry, F.col("expected"), F.col("options")))
        .when(F.col("kind") == "choice-grid", compare_grid(
            F.col("row_answers"), has_entry, F.col("expected"), F.col("options")))
        .when(F.col("kind") == "sentence-ordering", compare_ordering(
            F.col("learner"), has_entry, F.col("expected"), F.col("item_count")))
        .when(F.col("kind") == "matching", compare_matching(
            F.col("learner"), has_entry, F.col("_source"), F.col("_li"), F.col("_ri")))
        .when(F.col("kind") == "free-text", check_free_text(F.coalesce(F.col("payload_type") == "Reference", F.lit(False))))
    )
    graded = F.when(F.coalesce(F.col("resolution"), F.lit("RESOLVED")) != "RESOLVED",
                    _result(_null(), F.col("resolution"))).otherwise(by_kind)
    return prepared.withColumn(out, graded).drop("_li", "_ri", "_source")


def is_source_backed(kind: Column, resolution: Column) -> Column:
    """The slot is resolved and the kind can be graded."""
    return F.coalesce((kind != "free-text") & (resolution == "RESOLVED"), F.lit(False))


def can_check(kind: Column, ordinal: Column, answer: Column, resolution: Column) -> Column:
    """Model checking is offered for answered interactions without a source-backed answer."""
    return (ordinal >= 0) & ~X.is_blank(answer) & ~is_source_backed(kind, resolution)


def expected_answer(kind: Column, resolution: Column, expected: Column, payload_type: Column, model_text: Column) -> Column:
    """Text shown on reveal; free text only from a model answer, null when there is none."""
    reference = F.when((payload_type == "Reference") & (model_text != ""), model_text)
    return F.when(resolution == "RESOLVED", F.when(kind == "free-text", reference).otherwise(expected))


def matched_pairs(answers: DataFrame, items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Learner pairs joined to the left and right items; pairs naming unknown items drop out.

    ``answers``: keys + value (JSON); ``items``: keys + side, id, text.
    """
    pairs = answers.select(*keys, F.explode(X.parse_matching_answer(F.col("value"))).alias("left_id", "right_id"))
    one = lambda s: items.where(F.col("side") == s).select(
        *keys, F.col("id").alias(f"{s}_id"), F.col("text").alias(f"{s}_text"))
    return pairs.join(one("left"), [*keys, "left_id"]).join(one("right"), [*keys, "right_id"])


def verdict_totals(results: DataFrame, keys: Sequence[str], *more: Column) -> DataFrame:
    """A4: correct and gradable counts; checked = any defined verdict. ``more`` aggregates share the pass."""
    v = F.col("verdict")
    return results.groupBy(*keys).agg(
        F.count_if(v == "CORRECT").alias("total_correct"),
        F.count_if(v.isNotNull() & (v != "NOT_AUTO_GRADABLE")).alias("total_gradable"),
        F.bool_or(v.isNotNull()).alias("checked"), *more,
    )
