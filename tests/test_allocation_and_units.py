"""Unit lookup and allocation against plain step-by-step replays."""

import random

from pyspark.sql import functions as F

from leafgrade.operators import allocate as K
from leafgrade.operators import units as U

PROFILE = [("p", 2, 18, 20)]
UNITS = [("p", i, i + 1, f"U{i + 1}", s) for i, s in enumerate((3, 7, 10, 14))]
EXCLUDED = [("p", 5, 6), ("p", 12, 13)]


def dims(spark):
    return (spark.createDataFrame(PROFILE, "profile_id string, printed_offset int, solution_from int, solution_to int"),
            spark.createDataFrame(UNITS, "profile_id string, position int, unit_number int, title string, printed_start int"),
            spark.createDataFrame(EXCLUDED, "profile_id string, range_from int, range_to int"))


def test_unit_of_page(spark):
    pages = spark.createDataFrame([("p", n) for n in range(-3, 22)] + [(None, 1), ("q", 1)], "profile_id string, page_number int")
    got = {(r.profile_id, r.page_number): r.unit_number for r in U.resolve_unit(pages, *dims(spark)).collect()}
    assert got[("p", 1)] == 1 and got[("p", 2)] == 1 and got[("p", 3)] is None and got[("p", 5)] == 2
    assert got[("p", 8)] == 3 and got[("p", 10)] is None and got[("p", 12)] == 4 and got[("p", 17)] == 4
    assert got[("p", 18)] is None and got[("p", 0)] is None and got[("p", -2)] is None
    assert got[(None, 1)] is None and got[("q", 1)] is None
    assert len(got) == 27


def test_pages_of_unit_agree_with_lookup(spark):
    books = spark.createDataFrame([("b", "p", 16)], "book_id string, profile_id string, page_count int")
    got = {(r.unit_number, r.page_number) for r in U.pages_for_unit(books, *dims(spark)).collect()}
    pages = spark.createDataFrame([("p", n) for n in range(1, 17)], "profile_id string, page_number int")
    want = {(r.unit_number, r.page_number) for r in U.resolve_unit(pages, *dims(spark)).collect() if r.unit_number}
    assert got == want


def replay(pages, blocks):
    """Slots of one unit and kind: pages = [(page, capacity)], blocks = [items]."""
    out, cursor = {}, 0
    for page, capacity in pages:
        used, rest = 0, "UNMAPPED"
        while cursor < len(blocks) and used < capacity:
            items = blocks[cursor]
            if not items:
                cursor, rest = cursor + 1, "AMBIGUOUS"
                continue
            if used + len(items) > capacity:
                rest = "AMBIGUOUS"
                break
            for n, item in enumerate(items):
                out[(page, used + n)] = ("AMBIGUOUS", None) if "�" in item else ("RESOLVED", item)
            used, cursor = used + len(items), cursor + 1
        for n in range(used, capacity):
            out[(page, n)] = (rest, None)
    return out


def test_allocation_equals_replay(spark):
    rng = random.Random(7)
    caps, entries, want = [], [], {}
    for unit in range(60):
        pages = [(p, rng.randint(0, 6)) for p in range(1, rng.randint(2, 7))]
        blocks = [[f"{unit}.{b}.{i}" + ("�" if rng.random() < 0.1 else "") for i in range(rng.choice([0, 1, 1, 2, 3, 5]))]
                  for b in range(rng.randint(0, 8))]
        caps += [("b", unit, "choice", p, c) for p, c in pages]
        entries += [("b", unit, "choice", n, items) for n, items in enumerate(blocks)]
        want.update({(unit, *k): v for k, v in replay([x for x in pages if x[1]], blocks).items()})
    c = spark.createDataFrame(caps, "book_id string, unit_number int, kind string, page_number int, capacity long")
    e = spark.createDataFrame(entries, "book_id string, unit_number int, kind string, block int, items array<string>")
    got = {(r.unit_number, r.page_number, r.ordinal): (r.resolution, r.expected_value) for r in K.allocate_blocks(c, e).collect()}
    assert got == want


def test_marker_order_and_resolution(spark):
    entries = spark.createDataFrame(
        [("b", 1, "choice", m, o, [v]) for m, o, v in (("2", 1, "d"), ("10", 1, "c"), (None, 2, "b"), (None, 1, "a"))],
        "book_id string, unit_number int, kind string, marker string, ordinal int, items array<string>")
    pages = spark.createDataFrame([("b", 1, 1), ("b", 2, None)], "book_id string, page_number int, unit_number int")
    found = spark.createDataFrame([("b", 1, "choice", n, f"c{n}") for n in range(5)] + [("b", 2, "choice", 0, "z"), ("b", 1, "matching", 0, "m")],
                                  "book_id string, page_number int, kind string, ordinal int, id string")
    got = {r.id: (r.resolution, r.expected_value) for r in K.resolve_corrections(pages, found, entries).collect()}
    assert [got[f"c{n}"][1] for n in range(4)] == ["a", "b", "c", "d"]
    assert got["c4"] == got["z"] == got["m"] == ("UNMAPPED", None)
    status = {r.page_number: r.status for r in K.page_status(K.resolve_corrections(pages, found, entries)).collect()}
    assert status == {1: "RESOLVED", 2: "UNMAPPED"}


def test_profile_attachment_and_range(spark):
    profiles, _, _ = dims(spark)
    books = spark.createDataFrame([("a", "ABC", None, 50), ("b", "x", None, 10), ("c", "abc", "other", 0)],
                                  "book_id string, checksum string, profile_id string, page_count int")
    attached = U.attach_profile(books, profiles.withColumn("edition_key", F.lit("ed")), "aBc", "ed")
    assert {r.book_id: r.profile_id for r in attached.collect()} == {"a": "p", "b": None, "c": "other"}
    ranges = {r.book_id: (r.range_from, r.range_to) for r in U.extraction_range(attached, profiles).collect()}
    assert ranges == {"a": (18, 20), "b": (1, 10), "c": (1, 1)}
    assert U.attach_profile(books, profiles, " ", "ed") is books
