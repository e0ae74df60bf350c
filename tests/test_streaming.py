"""Incremental processing: one run over all input equals two runs over split input."""

import os

from pyspark.sql import functions as F

from quarry.streaming import incremental


def test_resume_equals_single_run(spark, scratch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "n_chars")
    src = os.path.join(scratch, "src")
    docs.where(F.col("doc_id") % 2 == 0).write.parquet(os.path.join(src, "part_a"))
    schema = "doc_id bigint, n_chars bigint"

    def transform(b):
        return b.select("doc_id", (F.col("n_chars") * 2).alias("x"))

    ck, out = os.path.join(scratch, "ck"), os.path.join(scratch, "out")
    run = lambda: incremental.process_new(spark, os.path.join(src, "*"), schema, ck, out, transform)
    run()
    docs.where(F.col("doc_id") % 2 == 1).write.parquet(os.path.join(src, "part_b"))
    run()
    first = spark.read.parquet(out).drop("batch_id").orderBy("doc_id").collect()
    run()  # nothing new: no batch, no duplicate
    again = spark.read.parquet(out).drop("batch_id").orderBy("doc_id").collect()
    expected = transform(docs).orderBy("doc_id").collect()
    assert first == expected and again == expected


def test_table_stored_as_a_folder_over_several_batches(spark, scratch):
    from quarry.plans import catalog
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.repartition(6).write.parquet(os.path.join(scratch, "documents.parquet"))
    source, glob = incremental.table_source(spark, scratch, "documents.parquet")
    assert glob is None and source.endswith("documents.parquet")
    batches = []
    incremental.process_new(spark, source, "doc_id bigint, n_chars bigint", os.path.join(scratch, "ck"), os.path.join(scratch, "out"),
                            lambda b: batches.append(1) or b, max_files_per_trigger=2)
    assert len(batches) == 3 and spark.read.parquet(os.path.join(scratch, "out")).count() == docs.count()
    one = catalog.incremental_profile(spark, "/root/testdata/sf0.001").orderBy("filename").collect()
    assert catalog.incremental_profile(spark, scratch).orderBy("filename").collect() == one
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(os.path.join(scratch, "events.parquet"))
    want = catalog.incremental_summary(spark, "/root/testdata/sf0.001").orderBy("event_type").collect()
    assert catalog.incremental_summary(spark, scratch).orderBy("event_type").collect() == want


DOCS = "name string, x bigint"


def _docs(spark, path, rows):
    spark.createDataFrame(rows, DOCS).coalesce(1).write.mode("append").parquet(path)


def _run(spark, scratch, checkpoint="ck", seen=None):
    def transform(batch):
        if seen is not None:
            seen.append(sorted(r.name or "" for r in batch.select("name").collect()))
        return batch.select(F.col("name").alias("filename"), (F.col("x") * 2).alias("y"))

    incremental.process_documents(spark, os.path.join(scratch, "src"), DOCS, os.path.join(scratch, checkpoint),
                                  os.path.join(scratch, "out"), transform, F.col("name"), max_files_per_trigger=1)
    return sorted((r.filename or "", r.y) for r in incremental.read_documents(spark, os.path.join(scratch, "out")).collect())


def test_a_document_that_comes_again_has_one_row(spark, scratch):
    src = os.path.join(scratch, "src")
    _docs(spark, src, [("a", 1), ("b", 2), ("b", 1), (None, 5)])  # twice in one file: the least row
    assert _run(spark, scratch) == [("", 10), ("a", 2), ("b", 2)]
    _docs(spark, src, [("a", 7), ("c", 3)])
    _docs(spark, src, [("c", 4), ("d", 4), ("a", 9)])
    seen = []
    got = _run(spark, scratch, seen=seen)  # a restart with two more files, each a batch
    assert [g[0] for g in got] == ["", "a", "b", "c", "d"] and ("a", 2) in got
    assert all("a" not in batch for batch in seen)  # no work is done on a document that has its row
    assert _run(spark, scratch) == got
    # a lost checkpoint: every file is read again, no row is added or changed, unnamed rows cannot be recognised
    again = _run(spark, scratch, checkpoint="other")
    assert [g for g in again if g[0]] == [g for g in got if g[0]]


def test_a_replayed_batch_replaces_its_rows(spark, scratch):
    src, out, ck = (os.path.join(scratch, n) for n in ("src", "out", "ck"))
    _docs(spark, src, [("a", 1), ("b", 2)])
    want = _run(spark, scratch)
    write = incremental.document_batch(lambda b: b.select(F.col("name").alias("filename"), (F.col("x") * 2).alias("y")),
                                       F.col("name"), "filename", out, ck)
    write(spark.read.schema(DOCS).parquet(src), 0)  # the same batch once more, as after a failure before its commit
    assert sorted((r.filename, r.y) for r in incremental.read_documents(spark, out).collect()) == want


def test_a_name_on_most_rows_is_reduced_before_it_is_compared(spark, scratch):
    src = os.path.join(scratch, "src")
    spark.range(4000).select(F.when(F.col("id") < 3000, "hot").otherwise(F.col("id").cast("string")).alias("name"),
                             F.col("id").alias("x")).coalesce(1).write.parquet(src)
    got = _run(spark, scratch)
    assert len(got) == 1001 and ("hot", 0) in got


def test_reading_what_is_not_there(spark, scratch):
    assert incremental.read_if_there(spark, os.path.join(scratch, "nothing")) is None
    with open(os.path.join(scratch, "broken.parquet"), "w") as f:
        f.write("not parquet")
    import pytest
    with pytest.raises(Exception):
        incremental.read_if_there(spark, os.path.join(scratch, "broken.parquet")).count()
