"""End-to-end jobs on small fixtures: evaluate a (stub) model, audit a corpus, build a gold set."""

import os

from pyspark.sql import functions as F

from quarry.plans import fixtures as fx
from quarry.plans import workflows as W

SF = "/root/testdata/sf0.001"


def test_evaluate_model_end_to_end(spark, scratch):
    def _echo_model():  # defined locally so workers receive it by value
        def model(prompt: str) -> str:
            doc = prompt.split("EPD DOCUMENT:\n", 1)[1].split("\n\nTABLE DATA:\n", 1)[0]
            return "Here you go:\n```json\n" + doc + "\n```"
        return model

    gold = fx.gold_records(spark, SF)
    # sidecars exist for even orders (odd ones are skipped); their "text" is the gold body
    side = gold.where(F.col("orig_index") % 2 == 0).select(
        F.regexp_extract("file_name", r"^(.*)\.pdf$", 1).alias("stem"), F.lit(True).alias("success"),
        F.col("body").alias("text"), F.array().cast("array<struct<index:int,markdown:string>>").alias("tables"),
        F.lit("").alias("error"))
    ledger = os.path.join(scratch, "ledger")
    ev = W.evaluate_model(spark, gold, side, _echo_model, "org/Echo-1B-Instruct", fx.FIXTURE_SPEC,
                          ledger_path=ledger, scores_path=os.path.join(scratch, "scores"))
    n_even = gold.where(F.col("orig_index") % 2 == 0).count()
    s = ev.summary.first()
    assert s.model == "echo-1b-zero-shot" and s.n_records == n_even
    assert s.f1_overall == 1.0 and s.f1_populated == 1.0
    assert ev.skipped.count() == gold.count() - n_even
    assert spark.read.parquet(ledger).count() == 1
    assert set(r.rule for r in ev.predictions.select("rule").distinct().collect()) == {"fenced"}


def test_audit_resumes_without_duplicates(spark, scratch):
    docs = fx.doc_facts(spark, SF)
    out = os.path.join(scratch, "audit")
    names = fx.audit_gold_names(spark, SF)
    first, _ = W.audit_corpus(docs.where(F.col("doc_id") % 2 == 0), names, out)
    n1 = first.count()
    both, summary = W.audit_corpus(docs, names, out)
    again, _ = W.audit_corpus(docs, names, out)
    assert both.count() == docs.count() == again.count() and n1 < docs.count()
    assert summary.first().n_total == docs.count()


def test_build_gold_set_with_expectations(spark, scratch):
    recs = fx.variant_records(spark, SF)
    reasons, clean_ids = fx.decisions(spark, SF)
    n, c = recs.count(), clean_ids.count()
    man, clean, quarantine = W.build_gold_set(recs, reasons, clean_ids, os.path.join(scratch, "gold"),
                                              expected={"input": n, "clean": c, "quarantine": n - c})
    assert man.count() == n
    assert os.path.isdir(os.path.join(scratch, "gold", "records", "bucket=CLEAN"))
    import pytest
    with pytest.raises(Exception):
        W.build_gold_set(recs, reasons, clean_ids, expected={"clean": c + 1})[1].count()
