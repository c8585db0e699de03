"""Answer-key extraction on hand-made solution pages."""

import pytest
from pyspark.sql import functions as F

from leafgrade.functions.geometry import box
from leafgrade.operators import answer_key as AK


def spans(spark, rows, page=4):
    """rows: (text, x, y[, confidence])."""
    data = [("b", page, i, f"span-{page}-{i}", r[0], float(r[3]) if len(r) > 3 else 0.995, float(r[1]), float(r[2])) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, "book_id string, page_number int, idx int, id string, text string, confidence double, x double, y double")
    return df.withColumn("parent_line_id", F.lit(None).cast("string")).withColumn("bbox", box(F.col("x"), F.col("y"), 0.3, 0.015)).drop("x", "y")


def entries(spark, rows, page=4):
    out = AK.extract_answer_key(spans(spark, rows, page), "Cornelsen").orderBy("entry_index").collect()
    return [(r.unit_number, r.marker, r.expected_value) for r in out], out


def test_headers_items_and_continuations(spark):
    got, rows = entries(spark, [
        ("9 Vorher", 0.1, 0.01), ("Lösungen", 0.1, 0.05), ("10 Relativsätze", 0.1, 0.10), ("1 1. rot – 2. blau", 0.1, 0.12),
        ("und grün", 0.1, 0.14, 0.8), ("2a 1C-2D-3B", 0.1, 0.16), ("12", 0.1, 0.20), ("Zuordnen", 0.2, 0.201), ("11C-2D-3B-4A", 0.1, 0.22),
        ("9 Zurück", 0.1, 0.24), ("13 Weiter", 0.1, 0.95), ("3. Heute — Morgen", 0.1, 0.30)])
    # "11C-..." is marker 1 with the items "1C-...": the items must begin with a digit
    assert got[:2] == [(10, "1", "1. rot – 2. blau und grün"), (10, "2a", "1C-2D-3B")] and got[2] == (12, "1", "1C-2D-3B-4A")
    assert rows[0]["items"] == ["rot", "blau   und grün"] and rows[0]["warnings"] == ["continuation_low_confidence"]
    assert rows[0]["raw_text"] == "1 1. rot – 2. blau | und grün"
    assert rows[2]["unit_number"] == 12 and rows[2]["key_kind"] == "Matching" and rows[2]["payload"]["type"] == "Matching"
    assert rows[3]["expected_value"] == "Heute" and rows[3]["alternatives"] == ["Morgen"] and rows[3]["ordinal"] == 2
    assert all(r["source_page"] == 4 and r["exercise_number"] == str(r["unit_number"]) for r in rows)


def test_standalone_marker_before_and_after_content(spark):
    got, _ = entries(spark, [("Lösungen", 0.1, 0.05), ("3 Artikel", 0.1, 0.1), ("2", 0.1, 0.2), ("1. der — 2. die", 0.2, 0.201),
                             ("4/5 Hauses", 0.2, 0.3), ("7", 0.3, 0.301)])
    assert got[0][:2] == (3, "2") and got[1][:2] == (3, "7")


def test_numbered_line_continues_block(spark):
    got, rows = entries(spark, [("Lösungen", 0.1, 0.05), ("3 Artikel", 0.1, 0.1), ("1 1. der", 0.1, 0.2), ("2. die", 0.1, 0.22), ("5. das", 0.1, 0.24)])
    assert [m for _, m, _ in got] == ["1", "5"] and rows[0]["items"] == ["der", "die"]


def test_nothing_without_heading_and_small_columns_vanish(spark):
    assert entries(spark, [("3 Artikel", 0.1, 0.1), ("1 1. a 2. b", 0.1, 0.2)])[0] == []
    left = [("Lösungen", 0.1, 0.05), ("3 Artikel", 0.1, 0.1), ("1 1. a", 0.1, 0.2)]
    right = [("5 Verben", 0.6, 0.1), ("1 1. b", 0.6, 0.2), ("2 1. c", 0.6, 0.3)]
    assert [u for u, _, _ in entries(spark, left + right)[0]] == [3, 5, 5]
    # three lines left, two right: one column, read across in (y, x) order
    assert [u for u, _, _ in entries(spark, left + right[:2])[0]] == [5, 5]


def test_registry(spark):
    with pytest.raises(ValueError, match="Available"):
        AK.extract_answer_key(spans(spark, [("x", 0.1, 0.1)]), "nobody")
    stub = AK.extract_answer_key(spans(spark, [("x", 0.1, 0.1)]), "stub").collect()
    assert len(stub) == 1 and stub[0]["expected_value"] == "Beispielantwort"
    AK.register_key_parser("Mine", lambda df: df.select("book_id", F.lit(1).alias("source_page")))
    assert AK.extract_answer_key(spans(spark, [("x", 0.1, 0.1)]), "mine").count() == 1
