"""Fail-closed allocation of answer blocks to page interactions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafgrade.functions.arrays import let, no_strings

UNIT_KIND = ["book_id", "unit_number", "kind"]


def entry_order(entries: DataFrame, keys: Sequence[str], out: str = "block") -> DataFrame:
    """0-based block position: sub-exercise marker (nulls first, string order), then ordinal.

    Entries that tie in both keep their stored order when an ``entry_index``
    column is present.
    """
    order: list = [F.col("marker").asc_nulls_first(), "ordinal"]
    if "entry_index" in entries.columns:
        order.append("entry_index")
    return entries.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def _walk(capacities: Column, sizes: Column) -> Column:
    """Fold over the pages of one unit and kind: which blocks start on which page.

    ``capacities`` and ``sizes`` are arrays in page and block order. With the
    running sums of the sizes, the blocks a page takes from the cursor on are
    those that start before the page is full and end within it; the first that
    does not is found by bisection, since the sums never fall.
    """
    def sums(values: Column) -> Column:
        return F.aggregate(values, F.array(F.lit(0).cast("bigint")),
                           lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) + s.cast("bigint"))))
    empty = sums(F.transform(sizes, lambda s: F.when(s == 0, 1).otherwise(0)))
    # halvings that settle any place among the blocks
    halvings = F.sequence(F.lit(0), F.ceil(F.log2(F.size(sizes) + F.lit(1.0))).cast("int"))
    return let(lambda ends, zeros, steps, caps: _walk_pages(caps, ends, zeros, steps), sums(sizes), empty, halvings, capacities)


def _walk_pages(capacities: Column, ends: Column, zeros: Column, steps: Column) -> Column:
    blocks = F.size(ends) - 1

    def page(acc: Column, capacity: Column) -> Column:
        def first_misfit(cursor: Column, base: Column) -> Column:
            def halve(s: Column, _: Column) -> Column:
                mid = F.floor((s["low"] + s["high"]) / 2).cast("int")
                fits = lambda m: (F.get(ends, m) - base < capacity) & (F.get(ends, m + 1) - base <= capacity)
                return let(lambda m: F.when(s["low"] >= s["high"], s).when(fits(m), F.struct((m + 1).alias("low"), s["high"].alias("high")))
                           .otherwise(F.struct(s["low"].alias("low"), m.alias("high"))), mid)
            return F.aggregate(steps, F.struct(cursor.alias("low"), blocks.alias("high")), halve, lambda s: s["low"])

        def settle(cursor: Column, base: Column, after: Column) -> Column:
            used = F.get(ends, after) - base
            skipped_empty = F.get(zeros, after) > F.get(zeros, cursor)
            blocked = (after < blocks) & (used < capacity)
            row = F.struct(cursor.alias("first_block"), after.alias("next_block"), used.cast("bigint").alias("used"),
                           (skipped_empty | blocked).alias("ambiguous_rest"))
            return F.struct(after.alias("cursor"), F.concat(acc["pages"], F.array(row)).alias("pages"))

        return let(lambda cursor, base: let(lambda after: settle(cursor, base, after), first_misfit(cursor, base)),
                   acc["cursor"], F.get(ends, acc["cursor"]))

    start = F.struct(
        F.lit(0).alias("cursor"),
        F.array().cast("array<struct<first_block:int,next_block:int,used:bigint,ambiguous_rest:boolean>>").alias("pages"))
    return F.aggregate(capacities, start, page, lambda acc: acc["pages"])


def page_allocation(capacities: DataFrame, blocks: DataFrame) -> DataFrame:
    """K2 core: adds first_block, next_block, used, ambiguous_rest to each page capacity row.

    ``capacities``: book_id, unit_number, kind, page_number, capacity.
    ``blocks``: book_id, unit_number, kind, block, size.
    Only counts travel here: one unit of one book is bounded by its printed
    pages and its answer key, which is a single document.
    """
    pages = capacities.where("capacity > 0").groupBy(*UNIT_KIND).agg(
        F.array_sort(F.collect_list(F.struct("page_number", "capacity"))).alias("pages"))
    keys = blocks.groupBy(*UNIT_KIND).agg(F.array_sort(F.collect_list(F.struct("block", "size"))).alias("blocks"))
    both = pages.join(keys, UNIT_KIND, "left").withColumn(
        "blocks", F.coalesce("blocks", F.filter(F.array(F.struct(F.lit(0).alias("block"), F.lit(0).alias("size"))),
                                                lambda b: F.lit(False))))
    walked = both.withColumn("walk", _walk(F.col("pages.capacity"), F.col("blocks.size")))
    rows = walked.select(*UNIT_KIND, F.explode(F.arrays_zip("pages", "walk")).alias("z"))
    return rows.select(*UNIT_KIND, F.col("z.pages.page_number").alias("page_number"),
                       F.col("z.pages.capacity").alias("capacity"), "z.walk.*")


def allocate_blocks(capacities: DataFrame, entries: DataFrame) -> DataFrame:
    """K2: one slot per interaction: kind, ordinal, resolution and, when resolved, the entry item.

    ``entries``: book_id, unit_number, kind, block, items (array, may be
    empty) plus any payload columns. Output columns: the keys, page_number,
    ordinal, resolution, expected_value, item_index, block.
    Rules: a block goes to one page entirely; what does not fit leaves the rest
    of the page ambiguous and waits; a block without item split is skipped and
    leaves the rest ambiguous; an item with an unreadable character is
    ambiguous; interactions beyond all blocks are unmapped.
    """
    pages = capacities.where("capacity > 0").groupBy(*UNIT_KIND).agg(
        F.array_sort(F.collect_list(F.struct("page_number", "capacity"))).alias("pages"))
    sized = entries.select(*UNIT_KIND, "block", F.coalesce(F.size("items"), F.lit(0)).alias("size"), "items")
    keys = sized.groupBy(*UNIT_KIND).agg(F.array_sort(F.collect_list(F.struct("block", "size", "items")), lambda x, y: x["block"] - y["block"]).alias("blocks"))
    # a page's items are gathered in the row of its unit, so pages and entries are each dealt once
    items_of = lambda w: F.flatten(F.transform(
        F.slice("blocks", w["first_block"] + 1, w["next_block"] - w["first_block"]), lambda b: F.transform(
            F.when(b["size"] > 0, b["items"]).otherwise(no_strings()),
            lambda item, i: F.struct(b["block"].alias("block"), i.alias("item_index"), item.alias("item")))))
    both = pages.join(keys, UNIT_KIND, "left")
    sizes = F.coalesce("blocks.size", F.array().cast("array<int>"))
    walked = both.withColumn("walk", _walk(F.col("pages.capacity"), sizes))
    settled = F.transform(F.arrays_zip("pages", "walk"), lambda z: F.struct(
        z["pages"]["page_number"].alias("page_number"), z["pages"]["capacity"].alias("capacity"),
        z["walk"]["ambiguous_rest"].alias("ambiguous_rest"), items_of(z["walk"]).alias("items")))
    found = walked.select(*UNIT_KIND, F.explode(settled).alias("p")).select(*UNIT_KIND, "p.*")
    slots = found.select(*UNIT_KIND, "page_number", "ambiguous_rest", "items", F.explode(F.expr("sequence(0L, capacity - 1L)")).alias("ordinal"))
    joined = slots.withColumn("_i", F.get("items", F.col("ordinal").cast("int"))).select(
        *UNIT_KIND, "page_number", "ordinal", "ambiguous_rest", "_i.*")
    unreadable = F.col("item").contains("�")
    resolution = (
        F.when(F.col("item").isNotNull() & ~unreadable, "RESOLVED")
        .when(F.col("item").isNotNull() | F.col("ambiguous_rest"), "AMBIGUOUS")
        .otherwise("UNMAPPED")
    )
    done = joined.withColumn("resolution", resolution)
    solved = F.col("resolution") == "RESOLVED"
    return done.select(*UNIT_KIND, "page_number", "ordinal", "resolution",
                       F.when(solved, F.col("item")).alias("expected_value"),
                       F.when(solved, F.col("item_index")).alias("item_index"),
                       F.when(solved, F.col("block")).alias("block"))


def resolve_corrections(pages: DataFrame, interactions: DataFrame, entries: DataFrame) -> DataFrame:
    """The whole correction resolution: slots of every interaction of every page.

    ``pages``: book_id, page_number, unit_number (null = no unit).
    ``interactions``: book_id, page_number, kind, ordinal, id.
    ``entries``: book_id, unit_number, kind, marker, ordinal, items, ...
    Interactions outside any unit, or of units without entries, are UNMAPPED.
    """
    located = interactions.join(pages.select("book_id", "page_number", "unit_number"), ["book_id", "page_number"])
    capacities = located.where("unit_number IS NOT NULL").groupBy(*UNIT_KIND, "page_number").agg(
        F.count("*").cast("long").alias("capacity"))
    blocks = entry_order(entries.where("unit_number IS NOT NULL AND kind IS NOT NULL"), UNIT_KIND)
    slots = allocate_blocks(capacities, blocks)
    found = slots.select("book_id", "page_number", "kind", "ordinal", "resolution", "expected_value", "item_index",
                         "block")
    return located.join(found, ["book_id", "page_number", "kind", "ordinal"], "left").withColumn(
        "resolution", F.coalesce("resolution", F.lit("UNMAPPED")))


def page_status(slots: DataFrame, keys: Sequence[str] = ("book_id", "page_number")) -> DataFrame:
    """A3: RESOLVED if any slot is, else AMBIGUOUS if any, else UNMAPPED."""
    any_of = lambda v: F.coalesce(F.bool_or(F.col("resolution") == v), F.lit(False))
    return slots.groupBy(*keys).agg(
        F.when(any_of("RESOLVED"), "RESOLVED").when(any_of("AMBIGUOUS"), "AMBIGUOUS").otherwise("UNMAPPED").alias("status"))


def slot_join(interactions: DataFrame, slots: DataFrame, payload: Sequence[str] = ("entry",)) -> DataFrame:
    """Interactions with their slot; none means UNMAPPED, the entry is given only when RESOLVED.

    A repeated slot counts once, with its first row (``slot_index`` order).
    """
    key = ["book_id", "page_number", "kind", "ordinal"]
    rest = [c for c in slots.columns if c not in key]
    if "slot_index" in rest:
        slots = slots.groupBy(*key).agg(F.min_by(F.struct(*rest), "slot_index").alias("_s")).select(
            *key, *[F.col("_s")[c].alias(c) for c in rest])
    joined = interactions.join(slots, key, "left").withColumn("resolution", F.coalesce("resolution", F.lit("UNMAPPED")))
    for name in payload:
        joined = joined.withColumn(name, F.when(F.col("resolution") == "RESOLVED", F.col(name)))
    return joined


def nth_entry_lookup(entries: DataFrame, requests: DataFrame) -> DataFrame:
    """The n-th entry (0-based) of a page and kind, by entry ordinal."""
    order = ["ordinal"] + (["entry_index"] if "entry_index" in entries.columns else [])
    w = Window.partitionBy("book_id", "page_number", "kind").orderBy(*order)
    ranked = entries.withColumn("n", F.row_number().over(w) - 1).drop("ordinal")
    return requests.join(ranked, ["book_id", "page_number", "kind", "n"], "left")
