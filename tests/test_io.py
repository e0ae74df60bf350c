"""Sources and sinks round trips (S1-S10) on scratch folders."""

import json
import os

import pytest
from pyspark.sql import functions as F

from quarry.operators import scoring
from quarry.operators.checks import expect_rows
from quarry.sources import readers as R
from quarry.sources import sinks as W


def test_record_array_positions(spark, scratch):
    recs = [{"file_name": "a.pdf", "X": "1"}, {"X": "2"}, {"file_name": "c.pdf", "Y": {"A1": "3"}}]
    path = os.path.join(scratch, "recs.json")
    with open(path, "w") as f:
        json.dump(recs, f, indent=2)
    df = R.read_record_array(spark, path).orderBy("orig_index").collect()
    assert [(r.orig_index, r.file_name) for r in df] == [(0, "a.pdf"), (1, ""), (2, "c.pdf")]
    assert json.loads(df[2].body) == recs[2]


def test_record_arrays_of_several_files_number_on(spark, scratch):
    for name, n in (("a.json", 2), ("b.json", 3)):
        with open(os.path.join(scratch, name), "w") as f:
            json.dump([{"file_name": f"{name}{k}"} for k in range(n)], f)
    got = R.read_record_array(spark, scratch).orderBy("orig_index").collect()
    assert [(r.orig_index, r.file_name) for r in got] == [
        (0, "a.json0"), (1, "a.json1"), (2, "b.json0"), (3, "b.json1"), (4, "b.json2")]


def test_record_lines_keep_their_numbers(spark, scratch):
    rows = spark.createDataFrame([(5, '{"file_name": "x.pdf",\n "A": "1"}'), (6, '{"file_name": "x.pdf",\n "A": "1"}'), (7, "{}")],
                                 "orig_index bigint, body string")
    W.write_records(rows, os.path.join(scratch, "lines"))
    back = R.read_record_lines(spark, os.path.join(scratch, "lines")).orderBy("orig_index").collect()
    assert [(r.orig_index, r.file_name) for r in back] == [(5, "x.pdf"), (6, "x.pdf"), (7, "")]
    spark.createDataFrame([('{"file_name": "y"}',)], "value string").write.text(os.path.join(scratch, "bare"))
    with pytest.raises(Exception, match="without _orig_index"):
        R.read_record_lines(spark, os.path.join(scratch, "bare")).collect()


@pytest.mark.parametrize("order", [[0, 1, 2], [2, 1, 0], [1, 2, 0]])
def test_last_prediction_wins_by_its_number(spark, scratch, order):
    gold = spark.createDataFrame([(0, "x.pdf", '{"file_name": "x.pdf", "Product Name": "third"}')],
                                 "orig_index bigint, file_name string, body string")
    names = ["first", "second", "third"]
    preds = spark.createDataFrame([(k, '{"file_name": "x.pdf", "Product Name": "%s"}' % names[k]) for k in order], "seq bigint, body string")
    W.write_records(preds.repartition(3), os.path.join(scratch, "p"), "seq", "_seq")
    back = R.read_prediction_lines(spark, os.path.join(scratch, "p"))
    assert scoring.score_records(gold, back).first().f1_metadata == 1.0


def test_row_expectations_also_fail_on_nothing(spark):
    assert expect_rows(spark.range(5), 5).count() == 5
    assert expect_rows(spark.range(0), 0).count() == 0
    for df, n in ((spark.range(0), 5), (spark.range(4), 5)):
        with pytest.raises(Exception, match="expected 5"):
            expect_rows(df, n).count()


def test_buckets_round_trip_as_lines(spark, scratch):
    clean = spark.createDataFrame([(0, "a.pdf", '{"_orig_index":0,"file_name":"a.pdf"}')],
                                  "orig_index bigint, file_name string, body string")
    quarantine = spark.createDataFrame([(1, "b.pdf", '{"_orig_index":1,"file_name":"b.pdf"}')],
                                       "orig_index bigint, file_name string, body string")
    out = os.path.join(scratch, "buckets")
    W.write_buckets(clean, quarantine, out)
    back = R.read_record_lines(spark, out).orderBy("orig_index").collect()
    assert [(r.orig_index, r.file_name) for r in back] == [(0, "a.pdf"), (1, "b.pdf")]
    assert sorted(os.listdir(out))[:2] == ["_SUCCESS", "bucket=CLEAN"] or "bucket=CLEAN" in os.listdir(out)


def test_manifest_and_scores_csv(spark, scratch):
    man = spark.createDataFrame([(0, "CLEAN", "a.pdf", "Tile", "1.61 E-01", "")],
                                "orig_idx int, bucket string, file_name string, product_name string, "
                                "gwp_a1a3 string, notes string")
    W.write_manifest(man, os.path.join(scratch, "man"))
    back = R.read_manifest(spark, os.path.join(scratch, "man")).first()
    assert back.gwp_a1a3 == "1.61 E-01" and back.orig_idx == 0
    scores = spark.createDataFrame([("m", "a.pdf", 0, 2 / 3, True)],
                                   "model string, file_name string, orig_index int, f1_overall double, schema_valid boolean")
    W.write_scores(scores, os.path.join(scratch, "scores"))
    row = spark.read.option("header", True).csv(os.path.join(scratch, "scores")).first()
    assert row.f1_overall == "0.6667"


def test_ledger_appends(spark, scratch):
    path = os.path.join(scratch, "ledger")
    row = spark.createDataFrame([("m", 1)], "model string, n_records int")
    W.append_ledger(row, path)
    W.append_ledger(row, path)
    assert spark.read.parquet(path).count() == 2


def test_listing_and_sidecars(spark, scratch):
    docs = os.path.join(scratch, "docs")
    os.makedirs(os.path.join(docs, "sub"))
    for n in ("a.pdf", "B.PDF", "c.txt", os.path.join("sub", "d.pdf")):
        with open(os.path.join(docs, n), "wb") as f:
            f.write(b"%PDF-1.4")
    names = sorted(r.filename for r in R.list_documents(spark, docs).collect())
    assert names == ["B.PDF", "a.pdf"]
    side = os.path.join(scratch, "side")
    os.makedirs(side)
    with open(os.path.join(side, "000623.json"), "w") as f:
        json.dump({"filename": "000623.pdf", "success": False, "text": "", "tables": [], "page_count": 0,
                   "processing_time_s": 124.1, "error": "Pipeline StandardPdfPipeline failed"}, f, indent=2)
    r = R.read_sidecars(spark, side).first()
    assert r.stem == "000623" and r.success is False and r.processing_time_s == 124.1


def test_only_filter_is_pushed_down(spark, scratch):
    path = os.path.join(scratch, "names")
    spark.createDataFrame([("a.pdf",), ("b.pdf",), ("c.pdf",)], "file_name string").write.parquet(path)
    df = R.only(spark.read.parquet(path), " a.pdf, c.pdf ")
    assert sorted(r.file_name for r in df.collect()) == ["a.pdf", "c.pdf"]
    assert "PushedFilters: [In(file_name" in df._jdf.queryExecution().executedPlan().toString() or \
        "In(file_name" in df._jdf.queryExecution().executedPlan().toString()


def test_html_tables_become_markdown(spark):
    from quarry.operators.convert import convert_documents
    page = ("<html><head><script>var x='<table>';</script></head><body><h1>Title &amp; more</h1>"
            "<table><tr><th>Stage</th><th>GWP</th></tr><tr><td>A1</td><td>1.5</td></tr></table>"
            "<p>After</p></body></html>")
    df = spark.createDataFrame([("p1", page), ("p2", None)], "name string, html string")
    rows = {r.filename: r for r in convert_documents(df, "name", "html").collect()}
    ok, bad = rows["p1"], rows["p2"]
    assert ok.success and ok.text == "Title & more\nAfter"
    assert ok.tables[0].markdown == "| Stage | GWP |\n| --- | --- |\n| A1 | 1.5 |"
    assert not bad.success and bad.error == "empty document"


def test_readme_usage_example(spark, scratch):
    from quarry.operators import scoring
    gold = [{"file_name": "a.pdf", "Product Name": "Tile", "GWP-TOTAL": {"A1-A3": "4.39", "Unit": "kg CO2e"}},
            {"file_name": "b.pdf", "Product Name": "Paint", "Standard List": ["EN 15804"]}]
    os.makedirs(os.path.join(scratch, "gold"))
    os.makedirs(os.path.join(scratch, "run"))
    with open(os.path.join(scratch, "gold", "clean.json"), "w") as f:
        json.dump(gold, f, indent=2)
    with open(os.path.join(scratch, "run", "part.jsonl"), "w") as f:
        f.write(json.dumps({"_orig_index": 1, "file_name": "a.pdf", "Product Name": "tile",
                            "GWP-TOTAL": {"A1-A3": "4.4", "Unit": "kg CO2e"}}) + "\n")
    g = R.read_record_array(spark, os.path.join(scratch, "gold", "clean.json"))
    p = R.read_record_lines(spark, os.path.join(scratch, "run")).selectExpr(
        "file_name", "coalesce(orig_index, 0) AS seq", "body")
    records = scoring.score_records(g, p)
    got = {r.file_name: r for r in records.collect()}
    assert got["a.pdf"].f1_overall == 1.0 and not got["a.pdf"].schema_valid
    assert got["b.pdf"].f1_overall == 0.0 and not got["b.pdf"].has_prediction
    summary = scoring.summary_row(records, "m", 0.0, 812.0).first()
    assert summary.f1_overall == 0.5 and summary.latency_s_per_record == 406.0


def test_a_run_written_twice_has_one_row(spark, scratch):
    path = os.path.join(scratch, "ledger")
    one = spark.createDataFrame([("m", 1)], "model string, n_records int")
    two = spark.createDataFrame([("m", 2)], "model string, n_records int")
    W.append_ledger(one, path, "run/a b")
    W.append_ledger(one, path, "run/a b")
    W.append_ledger(two, path, "other")
    led = W.read_ledger(spark, path)
    assert sorted((r.run_id, r.model, r.n_records) for r in led.collect()) == [("other", "m", 2), ("run/a b", "m", 1)]
    W.append_ledger(two, path, "run/a b")  # corrected rows replace those of the run
    assert {(r.run_id, r.n_records) for r in W.read_ledger(spark, path).collect()} == {("other", 2), ("run/a b", 2)}


def test_a_run_that_died_before_its_commit_is_not_shown(spark, scratch):
    path = os.path.join(scratch, "ledger")
    row = spark.createDataFrame([("m", 1)], "model string, n_records int")
    W.append_ledger(row, path, "good")
    row.write.parquet(f"{path}/run_id=dead/attempt=1")  # rows without a commit record
    assert [r.run_id for r in W.read_ledger(spark, path).collect()] == ["good"]


def test_buckets_keep_the_quarantine_reason(spark, scratch):
    from quarry.functions.records import parse_object
    schema = "orig_index bigint, file_name string, body string"
    clean = spark.createDataFrame([(0, "a.pdf", '{"_orig_index":0,"file_name":"a.pdf"}')], schema)
    bad = spark.createDataFrame([(1, "b.pdf", '{"_orig_index":1,"file_name":"b.pdf","_quarantine_reason":"EMPTY: \\"x\\""}')], schema)
    W.write_buckets(clean, bad, os.path.join(scratch, "b"))
    back = R.read_buckets(spark, os.path.join(scratch, "b")).withColumn("why", parse_object(F.col("body"))["_quarantine_reason"])
    assert sorted((r.orig_index, r.bucket, r.file_name, r.why) for r in back.collect()) == [
        (0, "CLEAN", "a.pdf", None), (1, "QUARANTINE", "b.pdf", 'EMPTY: "x"')]


def test_sidecar_lines_round_trip(spark, scratch):
    rows = spark.createDataFrame([("a.pdf", True, "t\nx", 1, 0.5, "", "de"), ("b.pdf", False, "", 0, 1.5, "bad", "en")],
                                 "filename string, success boolean, text string, page_count int, processing_time_s double, error string, lang string")
    W.write_sidecars(rows, os.path.join(scratch, "s"), "lang")
    back = R.read_sidecars(spark, os.path.join(scratch, "s"), lines=True)
    assert sorted((r.stem, r.success, r.text, r.lang) for r in back.collect()) == [("a", True, "t\nx", "de"), ("b", False, "", "en")]
