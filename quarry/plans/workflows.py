"""End-to-end jobs composed from the operators.

* ``evaluate_model``  — sidecars -> prompts -> model hook -> parse -> score -> ledger
* ``audit_corpus``    — per-document profile + gold-name match + summary
* ``build_gold_set``  — normalise variants -> manifest -> clean/quarantine buckets

Each is one lazy plan per output except where a stage is expensive and not
repeatable (model output): that stage is written to a fresh folder under the
session's shared ``spark.checkpoint.dir`` and read back, which also cuts the
lineage so a lost executor never re-runs the model.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.skew import materialise
from quarry.operators import corpus, curation, prompts, scoring
from quarry.operators.checks import expect_rows
from quarry.session import shared_dir
from quarry.sources import sinks
from quarry.streaming.incremental import read_if_there


@dataclass
class Evaluation:
    predictions: DataFrame   # file_name, seq, body, raw_text, rule, seconds
    skipped: DataFrame       # gold_name, status, reason
    records: DataFrame       # per-record F1 slices
    summary: DataFrame       # one ledger row


def evaluate_model(spark: SparkSession, gold: DataFrame, sidecars: DataFrame,
                   make_model: Callable[[], Callable[[str], str]], model_id: str,
                   spec: scoring.ScoringSpec = scoring.ScoringSpec(),
                   ledger_path: str | None = None, scores_path: str | None = None,
                   run_id: str | None = None) -> Evaluation:
    """Score a model on the gold set (the baseline-run lifecycle).

    ``gold``: ``orig_index, file_name, body``; ``sidecars``: ``stem, success,
    text, tables, error``. Fields for the prompt come from *all* gold records;
    only documents with a usable sidecar are attempted, and only attempted
    gold records are scored (skips do not lower the score). A run repeated under the same
    ``run_id`` has one row in the ledger.
    """
    names = gold.select(F.col("file_name").alias("gold_name")).distinct()
    usable = corpus.usable_sidecars(corpus.resolve_stems(names, sidecars), sidecars)
    skipped = usable.where(F.col("status") != "usable")
    ff = prompts.flat_fields(gold, indicators=spec.indicators, skip=spec.skip_fields)
    todo = (usable.where(F.col("status") == "usable")
            .join(sidecars.select(F.col("stem").alias("resolved_stem"), "text", "tables"), "resolved_stem"))
    asks = prompts.with_field_block(todo, ff, "gold_name").select(
        F.col("gold_name").alias("file_name"),
        prompts.build_prompt(F.col("fields_block"), F.col("text"), F.col("tables")).alias("prompt"))
    raw = prompts.run_extractor(asks, "prompt", "file_name", make_model)
    # Generation is costly and not repeatable: persist before anything reads it twice.
    path = shared_dir(spark, "model-output")
    raw.write.mode("overwrite").parquet(path)
    raw = spark.read.parquet(path)
    parsed = prompts.parse_responses(raw)
    preds = parsed.select(F.col("key").alias("file_name"), F.lit(1).cast("bigint").alias("seq"),
                          F.col("parsed").alias("body"), "raw_text", "rule", "seconds")
    attempted = scoring.restrict_to_attempted(gold, preds)
    # scored once; the scores, the ledger row and the caller read the written table
    records = materialise(scoring.score_records(attempted, preds.select("file_name", "seq", "body"), spec,
                                                names=attempted.select("file_name")), "record-scores")
    latency = raw.select(F.sum("seconds")).scalar()
    short = prompts.short_model_name(F.lit(model_id))
    summary = scoring.summary_row(records, short, 0.0, F.coalesce(latency, F.lit(0.0)))
    if scores_path:
        sinks.write_scores(scoring.scores_export(records, short), scores_path)
    if ledger_path:
        sinks.append_ledger(summary, ledger_path, run_id)
    return Evaluation(preds, skipped, records, summary)


def audit_corpus(docs: DataFrame, gold_names: DataFrame, out_path: str | None = None
                 ) -> tuple[DataFrame, DataFrame]:
    """Profile a corpus (the audit lifecycle): audit rows with gold match, and the summary.

    ``docs`` carries the per-document facts a converter reports (see
    ``corpus.profile``). Documents already in ``out_path`` are left out before any work is
    done on them; the rest is appended.
    """
    spark = docs.sparkSession
    done = read_if_there(spark, out_path) if out_path else None
    if done is not None:
        docs = corpus.remaining(docs, done.select("filename"))
    prof = corpus.profile(docs)
    matched = prof.join(corpus.match_names(prof, gold_names), "filename", "left")
    if out_path:
        matched.write.mode("append").parquet(out_path)
        matched = spark.read.parquet(out_path)
    return matched, corpus.corpus_summary(matched)


def build_gold_set(records: DataFrame, decisions: DataFrame, clean_ids: DataFrame,
                   out_dir: str | None = None, expected: dict[str, int] | None = None
                   ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Normalise, split and write the gold set (the curation lifecycle).

    Returns (manifest, clean, quarantine). ``expected`` may hold ``input``,
    ``clean`` and ``quarantine`` counts that must hold, or the job fails.
    """
    norm = curation.normalise_records(records)
    if expected and "input" in expected:
        norm = expect_rows(norm, expected["input"], "input records")
    man = curation.manifest(norm, decisions, clean_ids)
    clean, quarantine = curation.split_buckets(norm, man)
    if expected and "clean" in expected:
        clean = expect_rows(clean, expected["clean"], "clean records")
    if expected and "quarantine" in expected:
        quarantine = expect_rows(quarantine, expected["quarantine"], "quarantine records")
    if out_dir:
        sinks.write_buckets(clean, quarantine, f"{out_dir}/records")
        sinks.write_manifest(man, f"{out_dir}/manifest")
    return man, clean, quarantine
