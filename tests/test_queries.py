"""Registered queries against their SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from leafgrade.plans.registry import QUERIES
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if q.sql))
def test_query_equals_sql(spark, duck, name):
    ok, note = compare(spark, duck, QUERIES[name].build, QUERIES[name].sql, SF)
    assert ok, note


@pytest.fixture()
def generated(spark):
    """Code generation as in production, which the session of the tests turns off."""
    spark.conf.set("spark.sql.codegen.wholeStage", "true")
    spark.conf.set("spark.sql.codegen.factoryMode", "FALLBACK")
    yield spark
    spark.conf.set("spark.sql.codegen.wholeStage", "false")
    spark.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")


@pytest.mark.parametrize("name", ["unit_totals", "verdict_kinds", "rounded_values", "cache_replay", "quota_today", "writing_boxes", "row_bands", "span_texts"])
def test_query_equals_sql_with_generated_code(generated, duck, name):
    ok, note = compare(generated, duck, QUERIES[name].build, QUERIES[name].sql, SF)
    assert ok, note


def test_entry_points(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.queries()[entry.FLAGSHIP] is QUERIES[entry.FLAGSHIP].build
