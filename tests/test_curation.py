"""Curation invariants: renaming, first-wins, bucket split, strip of benign sub-keys."""

import json

from pyspark.sql import functions as F

from quarry.functions.records import parse_object
from quarry.operators import curation as C
from quarry.plans import fixtures as fx

SF = "/root/testdata/sf0.001"


def _recs(spark, records):
    rows = [(i, r.get("file_name", ""), json.dumps(r)) for i, r in enumerate(records)]
    return spark.createDataFrame(rows, "orig_index bigint, file_name string, body string")


def test_variant_detection_order(spark):
    recs = _recs(spark, [{"Embodied Carbon (GWP Total)": {}, "Name of Product": "x"},
                         {"Name of Product": "y"}, {"GWP Total / Global Warming": {}}, {"Product Name": "z"}])
    got = [r.variant for r in C.normalise_records(recs).orderBy("orig_index").collect()]
    assert got == ["epd_intl", "bre", "bre", "canonical"]


def test_rename_first_wins_and_keeps_values(spark):
    recs = _recs(spark, [{"file_name": "f.pdf", "Name of Product": "first", "Product Name": "second",
                          "EPD Number": "E1", "GWP Total / Global Warming": {"A1": "AGG", "Unit": "kg"}}])
    out = C.normalise_records(recs).first()
    body = json.loads(out.body)
    assert list(body) == ["file_name", "Product Name", "EPD Document No", "GWP-TOTAL"]
    assert body["Product Name"] == "first" and body["GWP-TOTAL"] == {"A1": "AGG", "Unit": "kg"}


def test_split_is_a_partition_of_the_input(spark):
    norm = C.normalise_records(fx.variant_records(spark, SF))
    reasons, clean_ids = fx.decisions(spark, SF)
    man = C.manifest(norm, reasons, clean_ids)
    clean, quarantine = C.split_buckets(norm, man)
    n, c, q = norm.count(), clean.count(), quarantine.count()
    assert c + q == n and c > 0 and q > 0
    assert man.where(F.col("notes") == "UNKNOWN").count() > 0


def test_clean_bucket_strips_benign_subkeys_only_inside_indicators(spark):
    recs = _recs(spark, [{"file_name": "f.pdf", "Description": "top level stays",
                          "GWP-TOTAL": {"A1": "1", "Description": "gone", "Indicator Name": "gone", "Unit": "kg"}}])
    stripped = recs.select(C.entries_to_json(C.strip_benign_subkeys(parse_object(F.col("body")))).alias("b")).first()
    b = json.loads(stripped.b)
    assert b["Description"] == "top level stays" and b["GWP-TOTAL"] == {"A1": "1", "Unit": "kg"}


def test_contamination_keys(spark):
    recs = _recs(spark, [{"C2 ": "x", "Please list every field below in the document now": "y", "ok key": "z"}])
    keys = recs.select(C.contaminated_keys(parse_object(F.col("body"))).alias("k")).first().k
    assert sorted(keys) == ["C2 ", "Please list every field below in the document now"]


def test_row_count_expectation(spark):
    from quarry.operators.checks import expect_rows
    df = spark.range(5)
    assert expect_rows(df, 5).count() == 5
    import pytest
    with pytest.raises(Exception):
        expect_rows(df, 4).count()


def test_bre_agg_filter_reads_written_bodies(spark):
    """the filter on a body must not be pushed below the renaming, which it would repeat per reference."""
    from quarry.plans.catalog import QUERIES
    plan = QUERIES["bre_agg_records"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "GWP Total / Global Warming" not in plan and "to_json" not in plan


def test_dealt_by_number_of_rows(spark):
    from quarry.functions.skew import dealt
    assert dealt(spark.range(25), "id", rows=10).rdd.getNumPartitions() == 3
    assert dealt(spark.range(0), "id", rows=10).count() == 0


def test_buckets_join_bounded_numbers_of_bodies(spark):
    """bodies stay out of the manifest's joins and meet it in tasks of at most about ROWS_PER_TASK records."""
    from quarry.functions.skew import ROWS_PER_TASK
    n = 2 * ROWS_PER_TASK + 1
    recs = spark.range(n).select(F.col("id").alias("orig_index"), F.lit("a.pdf").alias("file_name"),
                                 F.lit("canonical").alias("variant"), F.lit('{"Product Name":"x"}').alias("body"))
    ids = spark.range(n).select(F.col("id").alias("orig_index"))
    man = C.manifest(recs, ids.select("orig_index", F.lit("EMPTY: x").alias("reason")).where("orig_index % 2 = 0"),
                     ids.where("orig_index % 2 = 1"))
    clean, quarantine = C.split_buckets(recs, man)
    assert "REPARTITION_BY_NUM" in clean._jdf.queryExecution().executedPlan().toString()
    joined = man._jdf.queryExecution().optimizedPlan().toString().split("Join LeftOuter")[-1]
    assert "body" not in joined
    assert clean.count() == ROWS_PER_TASK and quarantine.count() == ROWS_PER_TASK + 1
