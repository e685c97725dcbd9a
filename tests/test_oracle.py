"""Every registered query against its DuckDB statement on sf0.001."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from compare import diff_rows, digest, duck
from hashtrend.plans.catalog import registry

SF = "/root/testdata/sf0.001"
NAMES = sorted(entry.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_trend_query_has_an_oracle():
    """Training-data queries have one where SQL can say them on whole tables; tests/llm holds the others to brute force."""
    assert set(registry()) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    sp = entry.queries()[name](spark, SF).toPandas()
    dk = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(sp.columns) == sorted(dk.columns)
    assert len(sp) == len(dk)
    assert digest(sp) == digest(dk), diff_rows(sp, dk)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns[:2] == ["w_end", "tag"]


SPARK_TO_DUCK = {
    "LongType()": "BIGINT",
    "IntegerType()": "INTEGER",
    "StringType()": "VARCHAR",
    "DoubleType()": "DOUBLE",
    "BooleanType()": "BOOLEAN",
    "TimestampNTZType()": "TIMESTAMP",
}


@pytest.mark.parametrize("name", NAMES)
def test_column_types_match_oracle(spark, con, name):
    sp = {f.name: SPARK_TO_DUCK.get(str(f.dataType), str(f.dataType)) for f in entry.queries()[name](spark, SF).schema.fields}
    rel = con.sql(entry.oracle_sql()[name])
    dk = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    assert sp == dk
