"""Bounded request contexts.

One join brings the page document to the request; the text is assembled
inside the row. A page that receives a large share of the requests is split by
adaptive skew handling, since the document side has one row per page.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafgrade.functions import geometry as G
from leafgrade.functions import textops as X
from leafgrade.functions.arrays import first_match, last_match, let, no_strings, sort_by
from leafgrade.operators.cluster import PAGE
from leafgrade.operators.flatten import interaction_aliases, resolve_interaction_id
from leafgrade.operators.grading import is_source_backed

MAX_CONTEXT = 8000
EDGE = 0.003


def _or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _joined(texts: Column) -> Column:
    """Texts joined by spaces, without a space before the first non-empty one."""
    return F.aggregate(texts, F.lit(""), lambda a, t: F.when(a == "", t).otherwise(F.concat(a, F.lit(" "), t)))


def _labelled(items: Column) -> Column:
    return F.transform(items, lambda i: F.concat(_or_empty(i["label"]), F.lit(". "), _or_empty(i["text"])))


def _options(kind: Column, ident: Column) -> Column:
    group_labels = lambda g: F.flatten(F.transform(F.filter("choiceGroups", lambda c: c["id"] == g), lambda c: F.transform(
        c["options"], lambda o: o["label"])))
    target = first_match(F.col("choiceTargets"), lambda t: t["id"] == ident)
    grid = first_match(F.col("choiceGrids"), lambda g: g["id"] == ident)
    orderings = F.filter("sentenceOrderings", lambda o: (o["id"] == ident) | F.coalesce(o["exerciseId"] == ident, F.lit(False)))
    matching = first_match(F.col("matchingInteractions"), lambda m: m["id"] == ident)
    value = (
        F.when(kind == "choice", group_labels(target["optionGroupId"]))
        .when(kind == "choice-grid", group_labels(grid["optionGroupId"]))
        .when(kind == "sentence-ordering", F.flatten(F.transform(orderings, lambda o: F.transform(o["items"], lambda i: i["text"]))))
        .when(kind == "matching", F.concat(_labelled(matching["leftItems"]), _labelled(matching["rightItems"])))
    )
    return F.coalesce(value, no_strings())


def build_context(requests: DataFrame, docs: DataFrame, books: DataFrame, slots: DataFrame,
                  keys: Sequence[str] = PAGE, max_chars: int = MAX_CONTEXT) -> DataFrame:
    """K6: every request (request_id, keys, exercise_id, ...) with ``context_ok`` and its context.

    Adds title, instruction, source, kind, options, source_language and
    source_backed; they are null where the identity, the page or the book is
    unknown. Each (keys, exercise_id) asked for is put together once, however
    many requests ask for it, so documents meet pages and not requests.
    ``books``: book_id, title, source_language. ``slots``: keys, kind, ordinal,
    resolution.
    """
    keys = list(keys)
    asked = requests.select(*keys, "exercise_id").where("exercise_id IS NOT NULL").distinct()
    known = resolve_interaction_id(asked, interaction_aliases(docs, keys), keys).where("id IS NOT NULL")
    needed = docs.select(*keys, "textSpans", "semanticExercises", "choiceGroups", "choiceTargets", "choiceGrids",
                         "sentenceOrderings", "matchingInteractions")
    df = known.join(needed, keys).join(books.select("book_id", F.col("title").alias("_book"), "source_language"), "book_id")
    df = df.join(slots.select(*keys, "kind", "ordinal", "resolution"), [*keys, "kind", "ordinal"], "left")
    exercise = first_match(F.col("semanticExercises"), lambda e: (e["id"] == F.col("id")) | F.array_contains(
        e["interactionIds"], F.col("id")))
    df = df.withColumn("_e", exercise)
    listed = F.when(F.size("_e.contextSpanIds") > 0, F.col("_e.contextSpanIds")).otherwise(F.col("nearby_ids"))
    texts = F.filter(F.transform(F.coalesce(listed, no_strings()), lambda i: last_match(
        F.col("textSpans"), lambda s: s["id"] == i)["text"]), lambda t: t.isNotNull())
    named = ~X.is_blank(F.col("_e.title"), X.JAVA_BLANK)
    found = df.select(
        *keys, "exercise_id", "id", "kind", "ordinal",
        F.when(named, F.concat("_book", F.lit(" — "), "_e.title")).otherwise(F.col("_book")).alias("title"),
        _or_empty(F.col("_e.instruction")).alias("instruction"), X.truncate(_joined(texts), max_chars).alias("source"),
        _options(F.col("kind"), F.col("id")).alias("options"), _or_empty(F.col("source_language")).alias("source_language"),
        is_source_backed(F.col("kind"), F.col("resolution")).alias("source_backed"))
    joined = requests.join(found, [*keys, "exercise_id"], "left")
    return joined.select(*requests.columns, F.col("id").isNotNull().alias("context_ok"),
                         *[c for c in found.columns if c not in (*keys, "exercise_id")])


def _interaction_lines(exercise: Column) -> Column:
    """Learner-facing lines of an exercise's matchings and orderings."""
    def lines(i: Column) -> Column:
        m = first_match(F.col("matchingInteractions"), lambda x: x["id"] == i)
        pairs = F.coalesce(F.concat(_labelled(m["leftItems"]), _labelled(m["rightItems"])), no_strings())
        orderings = F.filter("sentenceOrderings", lambda o: (o["id"] == i) | F.coalesce(o["exerciseId"] == i, F.lit(False)))
        pieces = F.flatten(F.transform(orderings, lambda o: F.transform(o["items"], lambda x: x["text"])))
        return F.concat(pairs, F.when(F.size(pieces) > 0, F.array(F.array_join(pieces, " "))).otherwise(no_strings()))
    return F.filter(F.flatten(F.transform(exercise["interactionIds"], lines)), lambda t: ~X.is_blank(t, X.JAVA_BLANK))


def build_selection_context(requests: DataFrame, docs: DataFrame, books: DataFrame, keys: Sequence[str] = PAGE,
                            max_chars: int = MAX_CONTEXT) -> DataFrame:
    """K7: requests with a ``selection`` box: title, instruction, kind and the selected source text.

    Exercises are selected when one box holds the centre of the other. Their
    own spans always belong; other spans must touch the selection and, when an
    exercise is selected, be unowned and lie in its text range. Every request
    is returned; ``context_ok`` is false, and the context null, for an unknown
    page or book, an invalid selection or one without text.
    """
    keys = list(keys)
    needed = docs.select(*keys, "textSpans", "semanticExercises", "sentenceOrderings", "matchingInteractions")
    df = requests.join(needed, keys, "left").join(
        books.select("book_id", F.col("title").alias("_book"), "source_language"), "book_id", "left")
    sel = F.col("selection")
    hit = lambda b: (G.bbox_contains_point(b, G.center_x(sel), G.center_y(sel))
                     | G.bbox_contains_point(sel, G.center_x(b), G.center_y(b)))
    df = df.withColumn("_sel", F.filter("semanticExercises", lambda e: F.coalesce(hit(e["bbox"]), F.lit(False))))
    ids_of = lambda es: F.flatten(F.transform(es, lambda e: F.coalesce(e["contextSpanIds"], no_strings())))

    def text_range(e: Column) -> Column:
        own = F.transform(F.filter("textSpans", lambda s: F.array_contains(e["contextSpanIds"], s["id"]) & s["bbox"].isNotNull()),
                          lambda s: s["bbox"])
        return let(lambda b: F.when(F.size(b) > 0, F.struct(
            F.array_min(F.transform(b, G.top)).alias("top"), F.array_max(F.transform(b, G.bottom)).alias("bottom"))), own)

    def chosen(owned: Column, mine: Column, ranges: Column) -> Column:
        def admitted(s: Column) -> Column:
            seen = F.coalesce(G.bbox_intersects(s["bbox"], sel, EDGE), F.lit(False))
            free = ~F.array_contains(owned, s["id"]) & F.exists(ranges, lambda r: G.center_y(s["bbox"]).between(
                r["top"] - EDGE, r["bottom"] + EDGE))
            has_text = ~X.is_blank(s["text"], X.JAVA_BLANK)
            return has_text & (F.array_contains(mine, s["id"]) | (seen & ((F.size("_sel") == 0) | free)))
        return F.filter("textSpans", admitted)

    ranges = F.filter(F.transform("_sel", text_range), lambda r: r.isNotNull())
    picked = let(chosen, ids_of(F.col("semanticExercises")), ids_of(F.col("_sel")), ranges)
    spans = sort_by(picked, lambda s: F.coalesce(s["bbox"]["y"], F.lit(1.0)), lambda s: F.coalesce(s["bbox"]["x"], F.lit(1.0)))
    df = df.withColumn("_parts", F.transform(spans, lambda s: s["text"]))
    lines = F.flatten(F.transform("_sel", _interaction_lines))
    parts = F.aggregate(lines, F.col("_parts"), lambda acc, line: F.when(
        F.exists(acc, lambda t: F.contains(F.lower(t), F.lower(line))), acc).otherwise(F.concat(acc, F.array(line))))
    df = df.withColumn("source", X.truncate(F.array_join(parts, " "), max_chars))
    one = F.get("_sel", F.lit(0))
    number, name = _or_empty(one["number"]), _or_empty(one["title"])
    blank = lambda c: X.is_blank(c, X.JAVA_BLANK)
    label = F.when(blank(number), name).otherwise(F.concat(F.lit("Exercise "), number, F.when(blank(name), "").otherwise(
        F.concat(F.lit(": "), name))))
    numbers = F.filter(F.transform("_sel", lambda e: _or_empty(e["number"])), lambda n: ~blank(n))
    n = F.size("_sel")
    region = F.concat("_book", F.lit(" — selected page region"))
    title = (
        F.when((n == 1) & ~blank(label), F.concat("_book", F.lit(" — "), label))
        .when((n > 1) & (F.size(numbers) > 0), F.concat("_book", F.lit(" — selected exercises "), F.array_join(numbers, ", ")))
        .otherwise(region)
    )
    kind = F.when((n == 1) & ~blank(one["kind"]), one["kind"]).otherwise("selection")
    ok = F.coalesce(G.valid_selection(sel) & F.col("_book").isNotNull() & ~blank(F.col("source")), F.lit(False))
    df = df.withColumn("context_ok", ok)
    if_ok = lambda c, name: F.when(F.col("context_ok"), c).alias(name)
    return df.select(
        *requests.columns, "context_ok", if_ok(title, "title"),
        if_ok(F.when(n == 1, _or_empty(one["instruction"])).otherwise(""), "instruction"), if_ok(F.col("source"), "source"),
        if_ok(kind, "kind"), if_ok(_or_empty(F.col("source_language")), "source_language"), if_ok(n, "exercises"))
