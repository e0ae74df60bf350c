"""Registered queries against their SQL on DuckDB, and the pipeline against its parts."""
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.join(ROOT, "tools"))

from oracle_check import duck, rows_of  # noqa: E402

from quarry.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    got = rows_of(QUERIES[name](spark, SF).toPandas())
    want = rows_of(duck(SF).execute(ORACLE_SQL[name]).df())
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_every_operator_is_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{n}" for n in range(1, 14)}


def test_pipeline_stages(spark):
    import corpus_pipeline as cp
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, None
    for name, stage in cp.STAGES[:-1]:
        out = cp.materialise(stage(spark, docs, SF), "test-stage")
        assert out.columns == columns
        now = {r[0] for r in out.select("doc_id").collect()}
        assert ids is None or now <= ids
        ids, docs = now, out
    texts = [r[0] for r in docs.select("text").collect()]
    assert len(texts) == len(set(texts))
    items = [r[0] for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()]
    assert not any(i in t for i in items for t in texts)
    pieces = cp.STAGES[-1][1](spark, docs, SF).toPandas()
    assert set(pieces.doc_id) == ids
