"""Page to unit resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN = 64


def _bin(c: Column) -> Column:
    return F.floor(c / BIN).cast("long")


def unit_ranges(profiles: DataFrame, units: DataFrame, excluded: DataFrame) -> DataFrame:
    """One row per profile: printed_offset and ``ranges``, the disjoint half-open printed ranges of its units, ascending.

    ``units``: profile_id, position, unit_number, title, printed_start (list
    order). ``profiles``: profile_id, printed_offset, solution_from. The lookup
    stops at the first later start in *list order*, so a unit owns
    [max of the starts so far, next start), and never reaches the solutions;
    excluded ranges are swept out of it. A profile is one document, so its units
    and exclusions meet in its row: the three tables are dealt by profile once.
    """
    unit = F.struct("position", "unit_number", "title", F.col("printed_start").alias("start"))
    out = F.struct(F.col("range_from").alias("first"), F.col("range_to").alias("last"))
    rows = profiles.select("profile_id", F.struct("printed_offset", "solution_from").alias("p")).unionByName(
        units.select("profile_id", unit.alias("u")), allowMissingColumns=True).unionByName(
        excluded.where("range_from <= range_to").select("profile_id", out.alias("e")), allowMissingColumns=True)
    # a profile that is listed twice counts with its least row
    own = rows.groupBy("profile_id").agg(F.min("p").alias("p"), F.sort_array(F.collect_list("u")).alias("u"), F.sort_array(F.collect_list("e")).alias("e"))
    solutions = "(p.solution_from + p.printed_offset)"
    low = "greatest(1, array_max(transform(slice(u, 1, i + 1), x -> x.start)))"
    high = f"least(coalesce(get(u, i + 1).start, {solutions}), {solutions})"
    spans = f"filter(transform(u, (x, i) -> struct({low} AS low, {high} AS high, x.unit_number AS unit_number, x.title AS title)), x -> x.low < x.high)"
    piece = "named_struct('low', {0}, 'high', {1}, 'unit_number', x.unit_number, 'title', x.title)".format
    start = f"named_struct('at', x.low, 'out', filter(array({piece('x.low', 'x.low')}), y -> false))"
    step = f"""CASE WHEN g.last < a.at OR g.first >= x.high THEN a ELSE named_struct('at', greatest(a.at, g.last + 1), 'out',
        CASE WHEN g.first > a.at THEN array_append(a.out, {piece('a.at', 'g.first')}) ELSE a.out END) END"""
    end = f"CASE WHEN a.at < x.high THEN array_append(a.out, {piece('a.at', 'x.high')}) ELSE a.out END"
    swept = f"flatten(transform({spans}, x -> aggregate(e, {start}, (a, g) -> {step}, a -> {end})))"
    return own.where("p IS NOT NULL").select("profile_id", F.col("p.printed_offset").alias("printed_offset"), F.expr(swept).alias("ranges"))


def resolve_unit(pages: DataFrame, profiles: DataFrame, units: DataFrame, excluded: DataFrame) -> DataFrame:
    """Adds printed_page, unit_number, unit_title (null = no unit) to pages (profile_id, page_number).

    Every page meets its profile's row once; the range that holds its printed
    page is looked up there. The profiles' rows are broadcast by the optimizer
    when they are small, else a profile with many pages is split like any skewed join.
    """
    joined = pages.join(unit_ranges(profiles, units, excluded), "profile_id", "left").withColumn(
        "printed_page", F.col("page_number") + F.col("printed_offset"))
    at = F.get(F.filter("ranges", lambda r: (r["low"] <= F.col("printed_page")) & (F.col("printed_page") < r["high"])), F.lit(0))
    found = joined.withColumn("_unit", at)
    return found.select(*pages.columns, "printed_page", F.col("_unit.unit_number").alias("unit_number"), F.col("_unit.title").alias("unit_title"))


def pages_for_unit(books: DataFrame, profiles: DataFrame, units: DataFrame, excluded: DataFrame) -> DataFrame:
    """(book_id, unit_number, page_number) for every page of every unit.

    ``books``: book_id, profile_id, page_count. A unit runs to the next start
    in list order (the last one to the solutions); excluded printed pages and
    pages outside 1..page_count are left out. A repeated unit number counts
    once, with its first position.
    """
    w = Window.partitionBy("profile_id").orderBy("position")
    first = Window.partitionBy("profile_id", "unit_number").orderBy("position")
    spans = units.withColumn("_next", F.lead("printed_start").over(w)).withColumn(
        "_rn", F.row_number().over(first)).where("_rn = 1")
    dims = spans.join(profiles.select("profile_id", "printed_offset", "solution_from"), "profile_id")
    end = F.coalesce(F.col("_next"), F.col("solution_from") + F.col("printed_offset"))
    dims = dims.withColumn("_end", end)
    joined = books.join(dims, "profile_id")
    low = F.greatest(F.col("printed_start"), F.col("printed_offset") + 1)
    high = F.least(F.col("_end") - 1, F.col("page_count") + F.col("printed_offset"))
    printed = joined.withColumn("_lo", low).withColumn("_hi", high).where("_lo <= _hi").withColumn(
        "printed_page", F.explode(F.sequence("_lo", "_hi")))
    gone = excluded.where("range_from <= range_to").select("profile_id", "range_from", "range_to", F.explode(
        F.sequence(_bin(F.col("range_from")), _bin(F.col("range_to")))).alias("_bin")).alias("g")
    p = printed.withColumn("_bin", _bin(F.col("printed_page"))).alias("p")
    kept = p.join(gone, (F.col("p.profile_id") == F.col("g.profile_id")) & (F.col("p._bin") == F.col("g._bin"))
                  & F.col("p.printed_page").between(F.col("g.range_from"), F.col("g.range_to")), "left_anti")
    return kept.select("book_id", "unit_number", (F.col("printed_page") - F.col("printed_offset")).alias("page_number"))


def attach_profile(books: DataFrame, profiles: DataFrame, checksum: str, edition_key: str) -> DataFrame:
    """Give books with the configured checksum (any case) the configured edition's profile.

    Books that already have a profile keep it; blank configuration attaches nothing.
    """
    if not checksum.strip() or not edition_key.strip():
        return books
    edition = profiles.where(F.col("edition_key") == edition_key).agg(F.min("profile_id")).scalar()
    given = F.when(F.lower("checksum") == checksum.lower(), edition)
    return books.withColumn("profile_id", F.coalesce("profile_id", given))


def extraction_range(books: DataFrame, profiles: DataFrame, last_pages: int = 30) -> DataFrame:
    """Pages to read the answer key from: the profile's solutions, else the last 30 pages."""
    known = profiles.select("profile_id", "solution_from", "solution_to")
    end = F.greatest(F.lit(1), F.col("page_count"))
    return books.join(known, "profile_id", "left").withColumn(
        "range_from", F.coalesce("solution_from", F.greatest(F.lit(1), end - (last_pages - 1)))).withColumn(
        "range_to", F.coalesce("solution_to", end)).drop("solution_from", "solution_to")


def pages_in_range(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """Page rows (book_id, page_number, ...) inside their book's extraction range."""
    bounds = ranges.select("book_id", "range_from", "range_to")
    return pages.join(bounds, "book_id").where("page_number BETWEEN range_from AND range_to").drop(
        "range_from", "range_to")
