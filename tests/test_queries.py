"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["split", "metric", "value"] and df.count() > 0


def test_sql_has_no_strangers():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    got = entry.queries()[name](spark, SF)
    if name not in entry.oracle_sql():
        assert got.count() > 0
        return
    compare(got, con, entry.oracle_sql()[name])


SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "3",
    "spark.sql.execution.arrow.useLargeVarTypes": "true",
    "spark.sql.ansi.enabled": "false",
    "spark.sql.adaptive.enabled": "false",
}


@pytest.mark.parametrize("key", sorted(SETTINGS))
def test_results_do_not_depend_on_settings(spark, con, key):
    before = spark.conf.get(key)
    spark.conf.set(key, SETTINGS[key])
    try:
        for name in ("masked_maxsim_topk", "gate_linear_gradient", "embedded_queries", "resolve_by_id"):
            compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name])
    finally:
        spark.conf.set(key, before)
