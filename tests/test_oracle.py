"""Differential check: every registered query against its DuckDB oracle (sf0.001)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from oracle_check import duck, rows_of  # noqa: E402
from quarry.plans.catalog import QUERIES  # noqa: E402
from quarry.plans.oracle import ORACLE_SQL as SQL  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = con.execute(SQL[name]).df()
    assert rows_of(got) == rows_of(want)


def test_only_the_converter_has_no_oracle():
    assert set(QUERIES) - set(SQL) == {"html_sidecars", "html_table_stats", "table_prose_chunks"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_converter_queries_cover_every_page(spark, name):
    pages = spark.read.parquet(f"{SF}/pages.parquet").count()
    key = "page_id" if name == "html_sidecars" else "filename"
    assert QUERIES[name](spark, SF).select(key).distinct().count() == pages


def test_registry_holds_the_library():
    assert set(QUERIES) <= set(E.queries()) and set(SQL) <= set(E.oracle_sql())


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and rows[0].n_records > 0
    assert df.columns[:3] == ["model", "n_records", "f1_overall"]
