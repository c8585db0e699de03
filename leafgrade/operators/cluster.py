"""Ordering and clustering on a page.

A page is one document row, so its spans fit one task; windows are keyed by
the page. Folds that depend on a running cluster state use ``aggregate`` over
the page's sorted array, which stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafgrade.functions.arrays import let, running_sums

PAGE = ["book_id", "page_number"]


def _window(keys: Sequence[str], order: Sequence[str | Column]) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def natural_key(c: Column) -> Column:
    """Sort key that compares digit runs as numbers (``blank-2`` before ``blank-10``)."""
    runs = F.regexp_extract_all(c, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.transform(runs, lambda r: F.when(
        r.rlike(r"^\d"), F.concat(F.lit("0"), F.lpad(F.regexp_replace(r, "^0+(?=.)", ""), 20, "0"))
    ).otherwise(F.concat(F.lit("1"), r)))


def reading_order(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], out: str = "reading_index") -> DataFrame:
    """1-based position by (y, x, id-like tie)."""
    return df.withColumn(out, F.row_number().over(_window(keys, order)).cast("long"))


def flag_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], starts: Column, out: str) -> DataFrame:
    """Number groups 0.. along the order; ``starts`` says where a new one begins (null on the first row)."""
    w = _window(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    flagged = df.withColumn("_new", F.coalesce(starts, F.lit(False)).cast("long"))
    return flagged.withColumn(out, F.sum("_new").over(w)).drop("_new")


def gap_cluster(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], low: Column, high: Column,
                max_gap: Column | float, out: str = "cluster") -> DataFrame:
    """New cluster when ``low`` lies more than ``max_gap`` after the previous row's ``high``."""
    w = _window(keys, order)
    gap = low - F.lag(high).over(w)
    limit = max_gap if isinstance(max_gap, Column) else F.lit(max_gap)
    return flag_groups(df.withColumn("_gap", gap), keys, order, F.col("_gap") > limit, out).drop("_gap")


def capped_gap_cluster(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], low: Column, high: Column,
                       max_gap: Column | float, cap: int = 6, out: str = "cluster") -> DataFrame:
    """Gap clusters cut after every ``cap`` members."""
    plain = gap_cluster(df, keys, order, low, high, max_gap, "_run")
    w = Window.partitionBy(*keys, "_run").orderBy(*order)
    cut = plain.withColumn("_pos", F.row_number().over(w) - 1)
    starts = (F.col("_pos") % cap == 0)
    total = _window(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return cut.withColumn(out, F.sum(starts.cast("long")).over(total) - 1).drop("_run", "_pos")


def line_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], line: Column, out: str = "line") -> DataFrame:
    """Consecutive rows with the same line id; an interleaved line is split."""
    prev = F.lag(line).over(_window(keys, order))
    return flag_groups(df.withColumn("_prev", prev), keys, order, F.col("_prev") != line, out).drop("_prev")


def _fold_to_rows(df: DataFrame, keys: Sequence[str], sort: Sequence[Column], fields: dict[str, Column]) -> DataFrame:
    """One array of rows per page, sorted by ``sort``; fields s0.. sN then the payload."""
    row = F.struct(*[c.alias(f"s{i}") for i, c in enumerate(sort)], *[c.alias(n) for n, c in fields.items()])
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("rows"))


def anchored_cluster(df: DataFrame, keys: Sequence[str], order: Sequence[Column], position: Column,
                     max_gap: float, out: str = "cluster") -> DataFrame:
    """New cluster when the row lies more than ``max_gap`` after its cluster's *first* row."""
    payload = {"_row": F.struct(*df.columns), "_p": position.cast("double")}
    pages = _fold_to_rows(df, keys, order, payload)
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(-1).cast("long").alias("n"),
                     F.array().cast("array<bigint>").alias("ids"))

    def step(acc: Column, r: Column) -> Column:
        new = acc["anchor"].isNull() | (r["_p"] - acc["anchor"] > max_gap)
        n = acc["n"] + new.cast("long")
        return F.struct(F.when(new, r["_p"]).otherwise(acc["anchor"]).alias("anchor"), n.alias("n"),
                        F.concat(acc["ids"], F.array(n)).alias("ids"))

    ids = F.aggregate("rows", start, step, lambda acc: acc["ids"])
    zipped = pages.select(F.explode(F.arrays_zip(F.col("rows").alias("rows"), ids.alias("ids"))).alias("z"))
    return zipped.select(*[F.col("z.rows._row")[c].alias(c) for c in df.columns], F.col("z.ids").alias(out))


def column_clusters(df: DataFrame, keys: Sequence[str], order: Sequence[Column], x: Column, tolerance: float = 0.15,
                    out: str = "column") -> DataFrame:
    """W7 (seeds): a row joins the first seed whose x is closer than ``tolerance``, else it seeds a column.

    Taking rows in order and comparing with seeds only is the same as letting
    each seed collect its still unassigned neighbours.
    """
    payload = {"_row": F.struct(*df.columns), "_x": x.cast("double")}
    pages = _fold_to_rows(df, keys, order, payload)
    start = F.array().cast("array<double>")

    def step(seeds: Column, r: Column) -> Column:
        known = F.exists(seeds, lambda s: F.abs(s - r["_x"]) < tolerance)
        return F.when(known, seeds).otherwise(F.concat(seeds, F.array(r["_x"])))

    seeded = pages.withColumn("seeds", F.aggregate("rows", start, step))
    rows = seeded.select("seeds", F.explode("rows").alias("r"))
    index = F.array_position(F.transform("seeds", lambda s: F.abs(s - F.col("r._x")) < tolerance), True) - 1
    return rows.select(*[F.col("r._row")[c].alias(c) for c in df.columns], index.cast("long").alias(out))


def running_average_rules(df: DataFrame, keys: Sequence[str], order: Sequence[Column], pos: Column, lo: Column,
                          hi: Column, max_gap: float) -> DataFrame:
    """Merge rules closer than ``max_gap`` to the running position; the merged position is the mean of both."""
    pages = _fold_to_rows(df, keys, order, {"p": pos.cast("double"), "lo": lo.cast("double"), "hi": hi.cast("double")})
    empty = F.array().cast("array<struct<p:double,lo:double,hi:double>>")

    def step(acc: Column, r: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        merged = F.struct(((last["p"] + r["p"]) / 2).alias("p"), F.least(last["lo"], r["lo"]).alias("lo"),
                          F.greatest(last["hi"], r["hi"]).alias("hi"))
        one = F.struct(r["p"].alias("p"), r["lo"].alias("lo"), r["hi"].alias("hi"))
        joins = F.coalesce(r["p"] - last["p"] <= max_gap, F.lit(False))
        head = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(joins, F.concat(head, F.array(merged))).otherwise(F.concat(acc, F.array(one)))

    return pages.select(*keys, F.posexplode(F.aggregate("rows", empty, step)).alias("rule", "r")).select(
        *keys, F.col("rule").cast("long"), F.col("r.p").alias("position"), F.col("r.lo").alias("low"),
        F.col("r.hi").alias("high"))


def rule_groups(df: DataFrame, keys: Sequence[str], order: Sequence[Column], y: Column, x: Column,
                max_gap: float = 0.06, edge: float = 0.04, min_size: int = 3, out: str = "rule_group") -> DataFrame:
    """A rule joins the first group whose last rule is near in y and left edge; small groups are dropped."""
    payload = {"_row": F.struct(*df.columns), "_y": y.cast("double"), "_x": x.cast("double")}
    pages = _fold_to_rows(df, keys, order, payload)
    start = F.struct(F.array().cast("array<struct<y:double,x:double>>").alias("tails"),
                     F.array().cast("array<bigint>").alias("ids"))

    def step(acc: Column, r: Column) -> Column:
        near = F.transform(acc["tails"], lambda t: (r["_y"] - t["y"] <= max_gap) & (F.abs(r["_x"] - t["x"]) <= edge))
        at = F.array_position(near, True)
        slot = F.when(at > 0, at).otherwise(F.size(acc["tails"]) + 1).cast("long")
        tail = F.struct(r["_y"].alias("y"), r["_x"].alias("x"))
        replaced = F.transform(acc["tails"], lambda t, i: F.when(i + 1 == slot, tail).otherwise(t))
        tails = F.when(at > 0, replaced).otherwise(F.concat(acc["tails"], F.array(tail)))
        return F.struct(tails.alias("tails"), F.concat(acc["ids"], F.array(slot - 1)).alias("ids"))

    ids = F.aggregate("rows", start, step, lambda acc: acc["ids"])
    rows = pages.select(F.explode(F.arrays_zip(F.col("rows").alias("rows"), ids.alias("ids"))).alias("z")).select(
        *[F.col("z.rows._row")[c].alias(c) for c in df.columns], F.col("z.ids").alias(out))
    size = F.count("*").over(Window.partitionBy(*keys, out))
    return rows.withColumn("_n", size).where(F.col("_n") >= min_size).drop("_n")


def dot_columns(dots: DataFrame, keys: Sequence[str] = PAGE, x: str = "x", tie: Sequence[str] = ("y", "id"),
                tolerance: float = 0.003, spread: float = 0.003, low: float = 0.08, high: float = 0.92) -> DataFrame:
    """X-sorted chains of at least two dots with a tight spread; adds ``column`` and ``column_x``."""
    chained = gap_cluster(dots, keys, [x, *tie], F.col(x), F.col(x), tolerance, "column")
    w = Window.partitionBy(*keys, "column")
    lo, hi = F.min(x).over(w), F.max(x).over(w)
    measured = chained.withColumn("_n", F.count("*").over(w)).withColumn("_lo", lo).withColumn("_hi", hi)
    centre = F.col("_lo") + (F.col("_hi") - F.col("_lo")) / 2
    kept = (F.col("_n") >= 2) & (F.col("_hi") - F.col("_lo") <= spread) & centre.between(low, high)
    return measured.where(kept).withColumn("column_x", centre).drop("_n", "_lo", "_hi")


def row_split(rows: DataFrame, keys: Sequence[str], y: str = "y", tie: Sequence[str] = (), ratio: float = 1.8,
              min_gap: float = 0.025, min_rows: int = 3, out: str = "row_group") -> DataFrame:
    """Split rows at gaps of at least max(ratio x median gap, min_gap); fewer than three rows stay whole."""
    order = [y, *tie]
    gaps = rows.withColumn("_gap", F.col(y) - F.lag(y).over(_window(keys, order)))
    whole = Window.partitionBy(*keys)
    gaps = gaps.withColumn("_ref", F.percentile(F.when(F.col("_gap") > 0, F.col("_gap")), F.lit(0.5)).over(whole))
    gaps = gaps.withColumn("_n", F.count("*").over(whole))
    limit = F.greatest(F.col("_ref") * ratio, F.lit(min_gap))
    starts = (F.col("_n") >= min_rows) & F.col("_ref").isNotNull() & (F.col("_gap") >= limit)
    return flag_groups(gaps, keys, order, starts, out).drop("_gap", "_ref", "_n")


def stack_cluster(lines: DataFrame, keys: Sequence[str] = PAGE, max_gap: float = 0.025, min_overlap: float = 0.5,
                  page_height: Column | None = None) -> DataFrame:
    """Writing stacks: same column first (overlap with the previous line), then tight vertical gaps.

    Needs x, y, width, height, id columns; adds ``stack_column`` and ``stack``.
    """
    order = ["x", "y", "id"]
    w = _window(keys, order)
    prev = F.lag(F.struct("x", "width")).over(w)
    shared = F.greatest(F.lit(0.0), F.least(F.col("_p.x") + F.col("_p.width"), F.col("x") + F.col("width"))
                        - F.greatest(F.col("_p.x"), F.col("x")))
    apart = ~(shared >= F.least(F.col("_p.width"), F.col("width")) * min_overlap)
    cols = flag_groups(lines.withColumn("_p", prev), keys, order, F.col("_p").isNotNull() & apart, "stack_column").drop("_p")
    limit = F.lit(max_gap) if page_height is None else page_height * max_gap
    return gap_cluster(cols, [*keys, "stack_column"], ["y", "x", "id"], F.col("y"), F.col("y") + F.col("height"),
                       limit, "stack")


def proportional_boundaries(fragments: Column, x0: Column, x1: Column) -> Column:
    """Inner borders of fragments, in proportion to their text lengths."""
    def borders(lengths: Column, total: Column) -> Column:
        inner = F.slice(lengths, F.lit(1), F.greatest(F.size(lengths) - 1, F.lit(0)))
        return F.when(total > 0, F.transform(running_sums(inner), lambda c: x0 + (c / total) * (x1 - x0))).otherwise(
            F.array().cast("array<double>"))

    return let(lambda n: let(lambda total: borders(n, total), F.aggregate(n, F.lit(0.0), lambda a, v: a + v)),
               F.transform(fragments, lambda f: F.length(f).cast("double")))


def kind_ordinal(ordered: DataFrame, requests: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """0-based ordinal of an id inside its kind, -1 when absent."""
    positions = ordered.select(*keys, "kind", "id", "ordinal")
    return requests.join(positions, [*keys, "kind", "id"], "left").withColumn(
        "ordinal", F.coalesce("ordinal", F.lit(-1)))


def upper_median(values: Column) -> Column:
    """The upper median of an array: ``sorted[n // 2]``."""
    s = F.array_sort(values)
    return F.try_element_at(s, (F.floor(F.size(s) / 2) + 1).cast("int"))
