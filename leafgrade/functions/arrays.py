"""Array helpers for work inside one document row (no shuffle)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The same rows behind a one-row generator; no shuffle.

    Filters are not pushed through it and columns are not inlined over it, so
    an expensive in-row result is computed once, not once per later reference
    or once per element of a lambda that looks into it. Columns to ``keep`` stay
    outside, so rows dealt by them need not be dealt again.
    """
    rest = [c for c in df.columns if c not in keep]
    return df.select(*keep, F.explode(F.array(F.struct(*rest))).alias("_row")).select(*keep, "_row.*").select(*df.columns)


def let(fn: Callable[..., Column], *values: Column) -> Column:
    """``fn(values)`` with every value computed once per row.

    Higher-order functions re-evaluate an expression wherever a lambda repeats
    it; binding it as a lambda variable of a one-element array avoids that.
    Values may refer to earlier ones only through nesting.
    """
    if not values:
        return fn()
    head, rest = values[0], values[1:]
    return F.get(F.transform(F.array(head), lambda v: let(lambda *more: fn(v, *more), *rest)), F.lit(0))


def bind(name: str, value: str, body: str) -> str:
    """SQL text of ``body`` with ``name`` standing for ``value``, computed once: ``let`` for expressions written as text."""
    return f"transform(array({value}), {name} -> {body})[0]"


def sort_by(array: Column, *keys: Callable[[Column], Column]) -> Column:
    """Stable sort by the given key functions."""
    ranked = F.transform(array, lambda e, i: F.struct(
        *[k(e).alias(f"k{n}") for n, k in enumerate(keys)], i.alias("i"), e.alias("e")))
    return F.sort_array(ranked)["e"]


def chain(array: Column, joins: Callable[[Column, Column], Column], element: str) -> Column:
    """Cut an array into runs: an element joins the last run when ``joins(last element, element)``.

    ``element`` is the element type in DDL form.
    """
    def add(acc: Column, e: Column, run: Column) -> Column:
        ok = F.coalesce(joins(F.try_element_at(run, F.lit(-1)), e), F.lit(False)) & (F.size(acc) > 0)
        head = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(ok, F.concat(head, F.array(F.concat(run, F.array(e))))).otherwise(F.concat(acc, F.array(F.array(e))))

    return F.aggregate(array, F.array().cast(f"array<array<{element}>>"),
                       lambda acc, e: let(lambda run: add(acc, e, run), F.try_element_at(acc, F.lit(-1))))


def first_match(array: Column, test: Callable[[Column], Column]) -> Column:
    """First element that passes the test, or null."""
    return F.get(F.filter(array, test), F.lit(0))


def last_match(array: Column, test: Callable[[Column], Column]) -> Column:
    """Last element that passes the test, or null."""
    return F.try_element_at(F.filter(array, test), F.lit(-1))


def pick(array: Column, ids: Column) -> Column:
    """Elements by id in the order of ``ids`` (repeated and unknown ids dropped; the last of equal ids counts)."""
    def look_up(elements: Column) -> Column:
        found = F.transform(F.array_distinct(F.filter(ids, lambda i: F.coalesce(i != "", F.lit(False)))),
                            lambda i: last_match(elements, lambda e: e["id"] == i))
        return F.filter(found, lambda e: e.isNotNull())
    return let(look_up, array)


def mean(array: Column) -> Column:
    """Average of a double array, null when empty."""
    return let(lambda a: F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda t, v: t + v) / F.size(a)), array)


def running_sums(numbers: Column) -> Column:
    """Sums up to every place of a double array of whole numbers.

    A fold that appends would copy the list at every step. Here a place adds the
    numbers of its block of eight to the sum of the blocks before.
    """
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda t, v: t + v)

    def sums(n: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.shiftright(F.greatest(F.size(n) - 1, F.lit(0)), 3)), lambda b: total(F.slice(n, b * 8 + 1, F.lit(8))))
        before = let(lambda s: F.transform(s, lambda v, b: total(F.slice(s, F.lit(1), b))), blocks)
        return let(lambda s: F.transform(n, lambda v, i: F.get(s, F.shiftright(i, 3)) + total(F.slice(n, F.shiftright(i, 3) * 8 + 1, i % 8 + 1))), before)
    return let(sums, numbers)


def no_strings() -> Column:
    return F.array().cast("array<string>")
