"""Lesson projection.

A lesson is a function of one page document, so the whole projection runs
inside the row: no join, no shuffle, and a corpus is projected in one narrow
pass. It is written as SQL text in stages, one column each: spans are read once
into structs with their trimmed text, flags and place in reading order, a map
leads from a span id to its struct, and interactions look their spans up there.
Blocks of all kinds share one struct.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafgrade import schemas as SC
from leafgrade.functions import textops as X
from leafgrade.functions.arrays import bind, let, settle, sort_by
from leafgrade.operators.cluster import PAGE

INTERACTION_GAP = 0.055
CONTEXT_GAP = 0.036
_STRINGS = "CAST(array() AS array<string>)"
_ITEM = "struct<id:string,prompt:string,label:string,size:int>"
_PARAGRAPH = "struct<id:string,text:string>"
#: Fields of a block and their types; a kind leaves out what it has not.
FIELDS = {
    "id": "string", "kind": "string", "source_y": "double", "prompt": "string", "items": f"array<{_ITEM}>", "item_count": "int",
    "interaction_count": "int", "targets": f"array<{SC.CHOICE_TARGET.simpleString()}>", "group_id": "string", "options": "array<string>",
    "correction_ids": "array<string>", "span_ids": "array<string>", "interaction_ids": "array<string>",
    "bboxes": f"array<{SC.BBOX.simpleString()}>", "confidence": "double", "methods": "array<string>", "exercise_id": "string",
    "exercise_number": "string", "exercise_title": "string", "instruction": "string", "source_order": "int", "variant": "string",
    "paragraphs": f"array<{_PARAGRAPH}>",
}
_EMPTY = ("items", "correction_ids", "span_ids", "interaction_ids")


# ---- SQL text ------------------------------------------------------------------

def _trim(text: str) -> str:
    return f"trim(BOTH {X.quoted(X.members(X.JS_SPACE))} FROM {text})"


def _fold(text: str) -> str:
    return f"lower({_trim(text)})"


def _ids(ids: str) -> str:
    """Distinct non-empty ids."""
    return f"array_distinct(filter({ids}, i_ -> i_ <> ''))"


def _mean(values: str) -> str:
    return bind("m_", values, "CASE WHEN size(m_) > 0 THEN aggregate(m_, 0D, (a_, v_) -> a_ + v_) / size(m_) END")


def _tidy(text: str) -> str:
    """C4 (text part): collapse spaces, drop spaces before punctuation, squeeze repeated ! and ?; null if nothing is left."""
    for pattern, to in ((X.ODD_SPACES, " "), (X.LOOSE_BLANK, ""), (X.REPEATED_MARK, "$1")):
        text = f"regexp_replace({text}, r'{pattern}', '{to}')"
    return f"nullif(trim({text}), '')"


def _span_text(spans: str) -> str:
    """C4 over span structs, in reading order."""
    ordered = f"array_sort(transform({spans}, s_ -> struct(s_.k AS k, s_.t AS t)))"
    return _tidy(f"array_join(filter(transform({ordered}, e_ -> e_.t), t_ -> t_ <> ''), ' ')")


def _near(ids: str, by: str = "_by") -> str:
    """Structs by distinct id, unknown ids left out."""
    return f"filter(transform({_ids(f'coalesce({ids}, {_STRINGS})')}, n_ -> {by}[n_]), n_ -> n_ IS NOT NULL)"


def _last_by_id(pairs: str) -> str:
    """A map of structs (id, n, v) from id to v; of equal ids the largest n counts."""
    kept = bind("p_", f"array_sort(filter({pairs}, e_ -> e_.id IS NOT NULL))", "filter(p_, (e_, j_) -> coalesce(get(p_, j_ + 1).id <> e_.id, true))")
    return f"map_from_entries(transform({kept}, e_ -> struct(e_.id, e_.v)))"


def _spans() -> str:
    """The spans in reading order: k (place), id, t (trimmed), ok (meaningful), row (meaningful or a mark), line, edges, centre."""
    ordered = "array_sort(transform(textSpans, (s, i) -> struct(s.bbox.y AS y, s.bbox.x AS x, i AS i, s AS s)))"
    ok = "coalesce(e.s.confidence >= 0.55D AND length(t) > 1 AND t RLIKE '[A-Za-z]', false)"
    fields = (f"struct(k AS k, e.s.id AS id, t AS t, {ok} AS ok, {ok} OR coalesce(t RLIKE r'^[,.;:!?]$', false) AS row, nullif(e.s.parentLineId, '') AS line, "
              "e.x AS x, e.y AS y, e.x + e.s.bbox.width AS r, e.y + e.s.bbox.height AS b, e.y + e.s.bbox.height / 2 AS cy, e.s.bbox.width AS w, "
              "e.i AS i, e.s.confidence AS conf, e.s.bbox AS bbox)")
    return f"transform({ordered}, (e, k) -> {bind('t', _trim('e.s.text'), fields)})"


def _lines() -> str:
    """The readable text of every printed line, by line id."""
    row = "filter(_s, s -> s.row AND s.line IS NOT NULL)"
    return bind("r", row, f"map_from_entries(transform(array_distinct(transform(r, s -> s.line)), l -> struct(l, {_span_text('filter(r, s -> s.line = l)')})))")


def _text_with_blank(near: str, box: str) -> str:
    """The print row around a blank as ``left _____ right``; null when the row cannot be trusted."""
    anchor = _mean(f"transform({near}, s -> s.cy)")
    row = "filter(_s, s -> s.row AND abs(s.cy - anchor) <= 0.012D)"
    source = bind("row", row, f"CASE WHEN size(row) > size({near}) THEN row ELSE {near} END")
    untrusted = f"CASE WHEN NOT exists({near}, s -> s.line IS NOT NULL) THEN whole END"
    glued = (f"CASE WHEN lt IS NULL OR rt IS NULL THEN whole ELSE "
             f"{_trim(f'''regexp_replace(concat(lt, ' _____ ', rt), r'[{X.JS_SPACE}]+([,.;:!?])', '$1')''')} END")
    sides = bind("lefts", f"filter(src, s -> s.r <= {box}.x + 0.006D)", bind(
        "rights", f"filter(src, s -> s.x >= {box}.x + {box}.width - 0.006D)",
        f"CASE WHEN size(lefts) = 0 OR size(rights) = 0 THEN {untrusted} ELSE "
        f"{bind('lt', _span_text('lefts'), bind('rt', _span_text('rights'), glued))} END"))
    whole = (f"CASE WHEN whole IS NULL OR whole RLIKE '_{{2,}}' THEN whole "
             f"WHEN exists(src, s -> s.x < {box}.x + {box}.width AND s.r > {box}.x) THEN {untrusted} ELSE {sides} END")
    return bind("anchor", anchor, bind("src", source, bind("whole", _span_text("src"), whole)))


def _closest(spans: str, box: str) -> str:
    """T4: the span of smallest horizontal distance to the box centre, then vertical distance, then width."""
    cx = f"({box}.x + {box}.width / 2)"
    gap = f"CASE WHEN {cx} < s.x THEN s.x - {cx} WHEN {cx} > s.r THEN {cx} - s.x - s.w ELSE 0D END"
    return f"array_min(transform({spans}, (s, j) -> struct({gap} AS d, abs(s.cy - ({box}.y + {box}.height / 2)) AS v, s.w AS w, j AS j, s AS s))).s"


def _local_text(ids: str, box: str) -> str:
    """Text near an interaction; short evidence is widened to its printed line, or cut to the closest span."""
    beside = f"filter(near, s -> s.b >= {box}.y - 0.014D AND s.y <= {box}.y + {box}.height + 0.014D)"
    nearest = f"array_min(transform(near, (s, j) -> struct(abs(s.cy - ({box}.y + {box}.height / 2)) AS d, j AS j, s AS s))).s"
    only = bind("beside", beside, f"CASE WHEN size(beside) > 0 THEN {_closest('beside', box)} ELSE {nearest} END")
    line = "filter(near, s -> s.line IS NOT NULL)[0].line"
    wide = bind("wide", f"_lines[{line}]", f"CASE WHEN length(wide) > coalesce(length(own), 0) THEN wide ELSE {bind('one', only, _span_text('array(one)'))} END")
    expand = "exists(near, s -> s.line IS NOT NULL) AND (own IS NULL OR length(own) < 24 OR size(near) = 1)"
    return bind("near", f"filter({_near(ids)}, s -> s.ok)", bind(
        "own", _span_text("near"), f"CASE WHEN size(near) = 0 THEN CAST(NULL AS string) WHEN {expand} THEN {wide} ELSE own END"))


def _common(items: str) -> str:
    """The only distinct prompt, else null."""
    return bind("c_", _ids(f"transform({items}, x_ -> x_.prompt)"), "CASE WHEN size(c_) = 1 THEN c_[0] END")


def _item(id_: str, prompt: str, label: str = "CAST(NULL AS string)", size: str = "1") -> str:
    return f"named_struct('id', {id_}, 'prompt', {prompt}, 'label', {label}, 'size', {size})"


def _label(prompt: str) -> str:
    """Leading item label such as ``a)`` or ``3.`` (null without one)."""
    return rf"nullif(regexp_extract({_trim(prompt)}, r'^((?:[A-Za-z]|\d+)[.)])', 1), '')"


def _unlabelled(prompt: str, label: str) -> str:
    """A prompt without its label and repeated copies of it."""
    cut = rf"nullif(regexp_replace({_trim(prompt)}, concat(r'^(?:\Q', {label}, r'\E[{X.JS_SPACE}]*)+'), ''), '')"
    return f"CASE WHEN {prompt} <> '' THEN CASE WHEN {label} IS NULL THEN {_trim(prompt)} ELSE {cut} END END"


def _block(kind: str, **parts: str) -> str:
    """A block as text; A6: span, interaction and method lists are distinct."""
    parts["kind"] = f"'{kind}'"
    for name in ("span_ids", "interaction_ids", "methods"):
        parts[name] = _ids(parts[name])
    none = {n: f"CAST(array() AS {t})" if n in _EMPTY else f"CAST(NULL AS {t})" for n, t in FIELDS.items()}
    return f"named_struct({', '.join(f'{n!r}, {parts.get(n, none[n])}' for n in FIELDS)})"


def _with(block: str, **parts: str) -> str:
    """The block with some fields replaced."""
    return f"named_struct({', '.join(f'{n!r}, ' + parts.get(n, f'{block}.{n}') for n in FIELDS)})"


def _flat_ids(rows: str) -> str:
    return f"flatten(transform({rows}, x_ -> coalesce(x_.nearbyTextSpanIds, {_STRINGS})))"


def _evidence(rows: str, box: str) -> dict[str, str]:
    """Ids, spans, boxes, confidence and methods of a list of interactions."""
    each = lambda field: f"transform({rows}, x_ -> x_.{field})"
    return {"correction_ids": each("id"), "span_ids": _flat_ids(rows), "interaction_ids": each("id"), "bboxes": each(box),
            "source_y": f"array_min(transform({rows}, x_ -> x_.{box}.y))", "confidence": _mean(each("candidateScore")), "methods": each("detectionMethod"),
            "interaction_count": f"size({rows})", "item_count": f"size({rows})"}


def _page_id(tag: str, id_: str) -> str:
    return f"concat('page-', CAST(pageNumber AS string), '-{tag}-', {id_})"


def _runs(array: str, top: str, bottom: str, gap: float) -> str:
    """A sorted array cut where an element starts more than ``gap`` under the end of the one before."""
    starts = f"filter(sequence(0, size(a_) - 1), j_ -> j_ = 0 OR a_[j_].{top} - ({bottom.format('a_[j_ - 1]')}) > {gap}D)"
    runs = bind("c_", starts, "transform(c_, (f_, j_) -> slice(a_, f_ + 1, coalesce(get(c_, j_ + 1), size(a_)) - f_))")
    return bind("a_", array, f"CASE WHEN size(a_) = 0 THEN array() ELSE {runs} END")


def _blank_blocks() -> str:
    """Gap runs of blanks, every blank with its prompt."""
    prompt = bind("near", f"filter({_near('b.nearbyTextSpanIds')}, s -> s.ok)",
                   f"coalesce({_text_with_blank('near', 'b.interactionBbox')}, {_local_text('b.nearbyTextSpanIds', 'b.interactionBbox')})")
    item = bind("raw", prompt, bind("label", _label("raw"), _item("b.id", _unlabelled("raw", "label"), "label")))
    ordered = "transform(array_sort(transform(exerciseBlanks, (b, i) -> struct(b.interactionBbox.y AS y, i AS i, b AS b))), e -> e.b)"
    parts = _evidence("run", "interactionBbox")
    block = bind("items", f"transform(run, b -> {item})", _block(
        "fill-blank", id=_page_id("fill", "run[0].id"), prompt=_common("items"), items="items", **parts))
    runs = _runs(ordered, "interactionBbox.y", "{0}.interactionBbox.y + {0}.interactionBbox.height", INTERACTION_GAP)
    return f"transform({runs}, run -> {block})"


def _choice_blocks() -> str:
    key = "coalesce({0}.optionGroupId, concat('unmapped:', {0}.id))".format
    item = _item("t.id", _local_text("t.nearbyTextSpanIds", "t.interactionBbox"))
    group = "_groups[mine[0].optionGroupId]"
    block = bind("items", f"transform(mine, t -> {item})", bind("g", group, _block(
        "choice", id=_page_id("choice", "mine[0].id"), prompt=_common("items"), items="items", targets="mine", group_id="g.id", options="g.options",
        **_evidence("mine", "interactionBbox"))))
    return (f"transform(array_distinct(transform(choiceTargets, t -> {key('t')})), key -> "
            f"{bind('mine', f'filter(choiceTargets, t -> {key(chr(116))} = key)', block)})")


def _grid_blocks() -> str:
    item = _item("r.id", _local_text("r.nearbyTextSpanIds", "r.rowBbox"))
    block = bind("items", f"transform(c.rows, r -> {item})", bind("g", "_groups[c.optionGroupId]", _block(
        "choice-grid", id=_page_id("grid", "c.id"), prompt=_common("items"), items="items", group_id="g.id", options="g.options",
        source_y="c.gridBbox.y", item_count="size(c.rows)", interaction_count="size(c.rows)", correction_ids="array(c.id)", span_ids=_flat_ids("c.rows"),
        interaction_ids="concat(array(c.id), transform(c.rows, r -> r.id))", bboxes="concat(array(c.gridBbox), transform(c.rows, r -> r.rowBbox))",
        confidence="c.candidateScore", methods="array(c.detectionMethod)")))
    return f"transform(choiceGrids, c -> {block})"


def _ordering_blocks() -> str:
    parts = _evidence("mine", "bbox")
    ordered = "transform(array_sort(transform(mine, (o, i) -> struct(o.promptIndex AS p, i AS i, o.id AS id, size(o.items) AS n))), e -> {0})".format
    parts["correction_ids"] = ordered("e.id")
    block = _block("sentence-ordering", id=_page_id("ordering", "coalesce(key, 'null')"), prompt=f"CASE WHEN size(mine) = 1 THEN {_span_text(_near(_flat_ids('mine')))} END",
                   items=ordered(_item("e.id", "CAST(NULL AS string)", size="e.n")), exercise_id="key", **parts)
    return (f"transform(array_distinct(transform(sentenceOrderings, o -> o.exerciseId)), key -> "
            f"{bind('mine', 'filter(sentenceOrderings, o -> o.exerciseId <=> key)', block)})")


def _single(column: str, kind: str, tag: str, ids: str, prompt: str, count: str) -> str:
    block = _block(kind, id=_page_id(tag, "x.id"), prompt=prompt, items=f"array({_item('x.id', 'CAST(NULL AS string)', size=count)})", source_y="x.bbox.y",
                   item_count=count, interaction_count="1", correction_ids="array(x.id)", span_ids=ids, interaction_ids="array(x.id)",
                   bboxes="array(x.bbox)", confidence="x.candidateScore", methods="array(x.detectionMethod)")
    return f"transform({column}, x -> {block})"


def _matching_blocks() -> str:
    ids = f"concat(coalesce(x.nearbyTextSpanIds, {_STRINGS}), {_flat_ids('x.leftItems')}, {_flat_ids('x.rightItems')})"
    return _single("matchingInteractions", "matching", "matching", ids, "CAST(NULL AS string)", "size(x.leftItems)")


def _free_blocks() -> str:
    ids = f"coalesce(x.nearbyTextSpanIds, {_STRINGS})"
    return _single("freeTextInteractions", "free-text", "free", ids, _span_text(_near(ids)), "1")


def _assigned() -> str:
    """{id, span_id, text} per target: the nearest context span by centre height that no earlier target took."""
    cy = "(t.interactionBbox.y + t.interactionBbox.height / 2)"
    best = f"array_min(transform(filter(ctx, s -> NOT array_contains(a.used, s.id)), s -> struct(abs(s.cy - {cy}) AS d, s.k AS k, s.id AS id, s.t AS t)))"
    taken = "named_struct('used', array_append(a.used, best.id), 'out', array_append(a.out, named_struct('id', t.id, 'span_id', best.id, 'text', best.t)))"
    start = f"named_struct('used', {_STRINGS}, 'out', CAST(array() AS array<struct<id:string,span_id:string,text:string>>))"
    return f"aggregate(b.targets, {start}, (a, t) -> {bind('best', best, f'CASE WHEN best IS NULL THEN a ELSE {taken} END')}, a -> a.out)"


def _applied() -> str:
    """The block's exercise (J12): its copy, its context paragraphs, and prompts for choice targets.

    A block belongs to an exercise that owns all of its owned interactions
    (the last owner of an interaction counts).
    """
    owners = "filter(transform(b.interaction_ids, i -> _owner[i]), e -> e IS NOT NULL)"
    exercise = bind("o", owners, "CASE WHEN forall(o, e -> e.id = o[0].id) THEN get(o, 0) END")
    texts = "array(ex.number, ex.title, ex.instruction, concat_ws(' ', coalesce(ex.number, 'null'), coalesce(ex.title, 'null')))"
    options = f"CASE WHEN b.kind IN ('choice', 'choice-grid') THEN coalesce(b.options, {_STRINGS}) ELSE {_STRINGS} END"
    labels = (f"flatten(transform(filter(choiceTargets, t -> array_contains(ex.interactionIds, t.id)), t -> "
              f"coalesce(transform(get(filter(choiceGroups, g -> g.id = t.optionGroupId), 0).options, o -> o.label), {_STRINGS})))")
    # empty labels fold to '' and no kept span has an empty text
    copies = f"transform(concat(filter({texts}, v -> v <> ''), {options}, {labels}), v -> {_fold('v')})"
    context = (f"array_sort(filter(transform(coalesce(ex.contextSpanIds, {_STRINGS}), i -> _by[i]), s -> s.ok AND NOT array_contains(b.span_ids, s.id) "
               r"AND NOT (length(s.t) <= longest AND array_contains(copies, lower(s.t))) AND NOT s.t RLIKE r'^\([^)]{1,30}\)$'))")
    given = f"CASE WHEN b.kind = 'choice' THEN {_assigned()} ELSE CAST(array() AS array<struct<id:string,span_id:string,text:string>>) END"
    items = f"transform(b.items, x -> {_item('x.id', 'coalesce(get(filter(given, g -> g.id = x.id), 0).text, x.prompt)', 'x.label', 'x.size')})"
    paragraphs = ("transform(filter(ctx, s -> NOT exists(given, g -> g.span_id = s.id)), s -> named_struct('id', concat('paragraph-', s.id), 'text', s.t))")
    owned = _with("b", items=items, paragraphs=paragraphs, exercise_id="ex.id", exercise_number="ex.number", exercise_title="ex.title",
                  instruction="ex.instruction", source_order="ex.sourceOrder")
    # a text gets no shorter in lower case, so one longer than all copies needs no look
    longest = "array_max(transform(copies, v -> length(v)))"
    whole = bind("copies", copies, bind("longest", longest, bind("ctx", context, bind("given", given, owned))))
    return f"transform(_raw, b -> {bind('ex', exercise, f'CASE WHEN ex IS NULL THEN b ELSE {whole} END')})"


def _coalesced() -> str:
    """Choice blocks of one exercise become one block; everything else passes through."""
    semantic = "({0}.kind = 'choice' AND coalesce({0}.exercise_id <> '', false))".format
    flat = lambda f: f"flatten(transform(mine, b -> b.{f}))"
    prompts = f"transform(filter(items, x -> x.prompt <> ''), x -> {_fold('x.prompt')})"
    labels = f"transform(flatten(transform(mine, b -> coalesce(b.options, {_STRINGS}))), o -> {_fold('o')})"
    listed = f"flatten(transform(mine, b -> coalesce(b.paragraphs, CAST(array() AS array<{_PARAGRAPH}>))))"
    left = bind("gone", f"concat({prompts}, {labels})", f"filter({listed}, p -> NOT array_contains(gone, {_fold('p.text')}))")
    # equal texts count once, where they stand first
    paragraphs = bind("ps", left, "transform(array_distinct(transform(ps, p -> p.text)), t -> filter(ps, p -> p.text = t)[0])")
    shared = "forall(mine, b -> b.group_id <=> first.group_id)"
    merged = _with("first", id="key", source_y="array_min(transform(mine, b -> b.source_y))", items="items", item_count="size(items)",
                   interaction_count="size(items)", paragraphs=paragraphs, group_id=f"CASE WHEN {shared} THEN first.group_id END",
                   options=f"CASE WHEN {shared} THEN first.options END", confidence="array_min(transform(mine, b -> b.confidence))",
                   **{f: flat(f) for f in ("targets", "correction_ids", "bboxes")},
                   **{f: f"array_distinct({flat(f)})" for f in ("span_ids", "interaction_ids", "methods")})
    one = bind("first", "mine[0]", bind("items", flat("items"), f"CASE WHEN size(mine) = 1 THEN first ELSE {merged} END"))
    groups = f"transform(array_distinct(transform(filter(_applied, b -> {semantic('b')}), b -> b.exercise_id)), key -> " + bind(
        "mine", f"filter(_applied, b -> {semantic('b')} AND b.exercise_id = key)", one) + ")"
    return f"concat(filter(_applied, b -> NOT {semantic('b')}), {groups})"


def _context_blocks() -> str:
    """J15 + W5: unused meaningful spans in gap runs of at most six."""
    free = bind("used", "flatten(transform(_blocks, b -> b.span_ids))", bind(
        "boxes", "flatten(transform(_blocks, b -> b.bboxes))",
        "filter(_s, s -> s.ok AND NOT array_contains(used, s.id) AND NOT exists(boxes, x -> s.cy BETWEEN x.y - 0.012D AND x.y + x.height + 0.012D))"))
    runs = _runs(free, "y", "{0}.b", CONTEXT_GAP)
    parts = f"flatten(transform({runs}, r -> transform(sequence(0, (size(r) - 1) div 6), n -> slice(r, CAST(n AS int) * 6 + 1, 6))))"
    word = "(?iu)(?<![A-Za-z0-9_])(?:%s)(?![A-Za-z0-9_])"
    example, instruction = (word % w for w in X.VARIANT_WORDS)
    variant = f"CASE WHEN text RLIKE r'{example}' THEN 'example' WHEN text RLIKE r'{instruction}' THEN 'instruction' ELSE 'theory' END"
    block = bind("text", "array_join(transform(run, s -> s.t), ' ')", _block(
        "context", id=_page_id("context", "run[0].id"), source_y="run[0].y", span_ids="transform(run, s -> s.id)", interaction_ids=_STRINGS,
        bboxes="transform(run, s -> s.bbox)", confidence=_mean("transform(run, s -> s.conf)"), methods="array('ocr')", variant=variant,
        paragraphs="transform(run, s -> named_struct('id', concat('paragraph-', s.id), 'text', s.t))"))
    return f"transform({parts}, run -> {block})"


# ---- the operators -------------------------------------------------------------

def common_prompt(prompts: Column) -> Column:
    """The only distinct prompt, else null."""
    known = F.array_distinct(F.filter(prompts, lambda p: F.coalesce(p != "", F.lit(False))))
    return let(lambda k: F.when(F.size(k) == 1, F.get(k, F.lit(0))), known)


def lesson_title(spans: Column, page: Column, unit_title: Column | None = None) -> Column:
    """Unit title, else the tallest (then widest) page header of four characters or more, else ``Page n``."""
    heads = F.filter(spans, lambda s: (
        X.meaningful_span(s["text"], s["confidence"]) & (s["bbox"]["y"] < 0.2) & ~X.js_trim(s["text"]).rlike(r"(?iu)^(?:[ABC]\d|\d+|lektion\s+\d+)$")
        & ~X.js_trim(s["text"]).rlike(r"(?iu)deutsch\s+(?:entdecken|a1)") & (F.length(X.js_trim(s["text"])) >= 4)))
    best = F.get(sort_by(heads, lambda s: -s["bbox"]["height"], lambda s: -s["bbox"]["width"]), F.lit(0))
    own = let(lambda s: X.js_trim(s["text"]), best)
    unit = X.js_trim(unit_title) if unit_title is not None else F.lit(None).cast("string")
    return F.coalesce(F.when(unit != "", unit), own, F.concat(F.lit("Page "), page.cast("string")))


def project_lesson(pages: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """K4: one lesson per page: status, reason, title, blocks, block_count, interaction_count.

    ``pages``: keys plus typed document columns with defaults applied; a page
    without a document has null ``pageNumber``. ``unit_number`` and
    ``unit_title`` are used when present.
    """
    extra = [c for c in ("unit_number", "unit_title") if c in pages.columns]
    entries = "transform({0}, (e, i) -> named_struct('id', {1}, 'n', i, 'v', {2}))".format
    owned = entries("flatten(transform(semanticExercises, x -> transform(x.interactionIds, i -> struct(i AS id, x AS x))))", "e.id", "e.x")
    # one column per stage: a stage is computed once however often the next one refers to it
    df = pages.selectExpr("*", f"{_spans()} AS _s", f"{_last_by_id(entries('choiceGroups', 'e.id', 'struct(e.id AS id, transform(e.options, o -> o.label) AS options)'))} AS _groups",
                          f"{_last_by_id(owned)} AS _owner")
    df = df.selectExpr("*", f"{_last_by_id('transform(_s, s -> struct(s.id AS id, s.i AS n, s AS v))')} AS _by", f"{_lines()} AS _lines")
    families = [_blank_blocks(), _choice_blocks(), _grid_blocks(), _ordering_blocks(), _matching_blocks(), _free_blocks()]
    df = df.selectExpr("*", f"concat({', '.join(families)}) AS _raw")
    df = df.selectExpr("*", f"{_applied()} AS _applied")
    df = df.selectExpr("*", f"{_coalesced()} AS _blocks")
    df = df.selectExpr("*", f"{_context_blocks()} AS _contexts")
    # Without interactions, two theory or example paragraphs with 120 characters in total
    paragraphs = ("filter(flatten(transform(filter(_contexts, b -> b.variant IN ('theory', 'example')), b -> transform(b.paragraphs, p -> p.text))), t -> t <> '')")
    # Source order (missing last), position, id
    ordered = ("transform(array_sort(transform(CASE WHEN size(_blocks) > 0 THEN _blocks ELSE _contexts END, (b, i) -> "
               "struct(coalesce(b.source_order, 2147483647) AS o, b.source_y AS y, b.id AS id, i AS i, b AS b))), e -> e.b)")
    df = df.selectExpr("*", f"{ordered} AS _ordered", f"{bind('t', paragraphs, 'size(t) >= 2 AND length(array_join(t, chr(32))) >= 120')} AS _alone")
    df = df.selectExpr("*", """CASE WHEN pageNumber IS NULL THEN 'ANALYSIS_UNAVAILABLE' WHEN pageNumber <> page_number THEN 'SOURCE_MISMATCH'
        WHEN size(_ordered) = 0 OR (size(_blocks) = 0 AND NOT _alone) THEN 'NO_MEANINGFUL_CONTENT' END AS reason""")
    ok = F.col("reason").isNull()
    unit_title = F.col("unit_title") if "unit_title" in pages.columns else None
    return settle(df.select(
        *keys, *extra, F.when(ok, "AVAILABLE").otherwise("UNAVAILABLE").alias("status"), "reason",
        F.when(ok, F.concat_ws(":page:", *[F.col(k).cast("string") for k in keys])).alias("lesson_id"),
        F.when(ok, lesson_title(F.col("textSpans"), F.col("page_number"), unit_title)).alias("title"),
        F.when(ok, F.col("_ordered")).alias("blocks"), F.when(ok, F.size("_ordered")).alias("block_count"),
        F.when(ok, F.expr("aggregate(_ordered, 0, (a, b) -> a + b.interaction_count)")).alias("interaction_count")))


def lesson_steps(lessons: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """K5: ordered steps: contexts only without activities, one activity per block, one completion.

    ``sizes`` tells of every answer how many items it has to place.
    """
    step = "named_struct('id', {0}, 'kind', {1}, 'block_kind', {2}, 'activity_index', {3}, 'activity_count', size(acts), 'item_count', {4}, 'answer_ids', {5}, 'sizes', {6}, 'correction_ids', {7})".format
    no = lambda t: f"CAST(NULL AS {t})"
    rest = (no("array<string>"), no("array<int>"), no("array<string>"))
    contexts = f"transform(CASE WHEN size(acts) = 0 THEN blocks ELSE slice(blocks, 1, 0) END, b -> {step('b.id', chr(39) + 'context' + chr(39), 'b.kind', no('int'), no('int'), *rest)})"
    activities = "transform(acts, (b, i) -> " + step(
        "coalesce(nullif(b.exercise_id, ''), b.id)", "'activity'", "b.kind", "i", "b.item_count", "transform(b.items, x -> x.id)",
        "transform(b.items, x -> x.size)", "b.correction_ids") + ")"
    done = f"array({step('concat(lesson_id, ' + chr(39) + ':completion' + chr(39) + ')', chr(39) + 'completion' + chr(39), no('string'), no('int'), no('int'), *rest)})"
    steps = bind("acts", "filter(blocks, b -> b.kind <> 'context')", f"concat({contexts}, {activities}, {done})")
    rows = lessons.where("status = 'AVAILABLE'").select(*keys, "lesson_id", F.posexplode(F.expr(steps)).alias("step_index", "s"))
    return rows.select(*keys, "lesson_id", "step_index", "s.*")


def step_completion(lessons: DataFrame, answers: DataFrame, keys: Sequence[str] = PAGE, learner: str = "learner_id",
                    order: Sequence[str] = ("updated_at",)) -> DataFrame:
    """Per learner and activity step: whether every required answer is complete.

    ``answers``: learner, keys, interaction_id, value and order columns (a log;
    the last value counts). A learner of a page is who answered anything there;
    such a learner gets a row for every activity of the page, also for those
    without any answer. Sentence orderings and matchings are complete when all
    of their items are placed, all else when it is not blank.

    Answers become one row per learner and page, lessons are one row per page:
    the two meet in one join on the page, and the rest is work inside the row.
    """
    keys = list(keys)
    last = answers.groupBy(learner, *keys, "interaction_id").agg(F.max_by("value", F.struct(*order)).alias("value"))
    placed = last.select(learner, *keys, F.struct(
        F.col("interaction_id").alias("id"), (~X.is_blank(F.col("value"))).alias("some"), F.size(X.parse_ordered_answer(F.col("value"))).alias("ordered"),
        F.size(X.parse_matching_answer(F.col("value"))).alias("pairs")).alias("a")).groupBy(learner, *keys).agg(F.collect_list("a").alias("_given"))
    steps = lesson_steps(lessons, keys).where("kind = 'activity'").groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("step_index", "id", "block_kind", "answer_ids", "sizes"))).alias("_steps"))
    full = ("CASE s.block_kind WHEN 'sentence-ordering' THEN coalesce(g.ordered, 0) = coalesce(s.sizes[j], 0) "
            "WHEN 'matching' THEN coalesce(g.pairs, 0) = coalesce(s.sizes[j], 0) ELSE coalesce(g.some, false) END")
    done = f"forall(sequence(0, size(s.answer_ids)), j -> j = size(s.answer_ids) OR {bind('g', '_a[s.answer_ids[j]]', full)})"
    rows = placed.join(steps, keys).selectExpr(
        learner, *keys, "explode(" + bind("_a", "map_from_entries(transform(filter(_given, a -> a.id IS NOT NULL), a -> struct(a.id, a)))",
                                           f"transform(_steps, s -> struct(s.step_index AS step_index, s.id AS step_id, {done} AS complete))") + ") AS s")
    return rows.select(learner, *keys, "s.*")


def lesson_position(saved: DataFrame, steps: DataFrame, keys: Sequence[str] = PAGE, learner: str = "learner_id",
                    order: Sequence[str] = ("updated_at",)) -> DataFrame:
    """E10 + A17: current step (last saved if still valid, else the first) and progress in percent.

    ``saved``: learner, keys, step_id and order columns (a log).
    """
    keys = list(keys)
    last = saved.groupBy(learner, *keys).agg(F.max_by("step_id", F.struct(*order)).alias("step_id"))
    info = steps.groupBy(*keys).agg(
        F.min_by("id", "step_index").alias("first_id"), F.count_if(F.col("kind") == "activity").alias("activities"))
    position = F.when(F.col("kind") == "activity", F.col("activity_index") + 1).when(
        F.col("kind") == "completion", F.col("activity_count")).otherwise(F.lit(0))
    # a repeated step id means its first step
    places = steps.groupBy(*keys, "id").agg(F.min_by(position, "step_index").alias("position"))
    current = last.join(places.select(*keys, F.col("id").alias("step_id"), F.lit(True).alias("_valid")), [*keys, "step_id"], "left").join(
        info, keys)
    current = current.withColumn("step_id", F.when(F.col("_valid"), F.col("step_id")).otherwise(F.col("first_id"))).drop("_valid")
    placed = current.join(places.withColumnRenamed("id", "step_id"), [*keys, "step_id"], "left")
    return placed.select(learner, *keys, "step_id", F.when(F.col("activities") == 0, F.lit(0.0)).otherwise(
        F.col("position") / F.col("activities") * 100).alias("progress"))


def exercise_progress(answers: DataFrame, interactions: DataFrame, keys: Sequence[str] = PAGE, learner: str = "learner_id") -> DataFrame:
    """A5: ordered and total items per ordering exercise and learner."""
    keys = list(keys)
    mine = interactions.where("kind = 'sentence-ordering'").select(*keys, "exercise_id", F.col("id").alias("interaction_id"), "n_items")
    totals = mine.groupBy(*keys, "exercise_id").agg(F.sum("n_items").alias("total"))
    placed = mine.join(answers, [*keys, "interaction_id"]).groupBy(learner, *keys, "exercise_id").agg(
        F.sum(F.size(X.parse_ordered_answer(F.col("value")))).alias("ordered"))
    return placed.join(totals, [*keys, "exercise_id"])
