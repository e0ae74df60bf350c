"""Sinks: record buckets, manifest and score CSVs, the append-only ledger.

Writers take whole DataFrames (one dataset, many files), never one file per
row. Rounding happens only here, at presentation (T7).
"""

from __future__ import annotations

import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMITS = "_commits"  # beside the rows; readers of the whole folder pass over it


def write_buckets(clean: DataFrame, quarantine: DataFrame, path: str) -> None:
    """Clean and quarantine record sets, partitioned by bucket, as JSON Lines of bodies."""
    both = (clean.select("orig_index", "body", F.lit("CLEAN").alias("bucket"))
            .unionByName(quarantine.select("orig_index", "body", F.lit("QUARANTINE").alias("bucket"))))
    both.select(F.col("body").alias("value"), "bucket").write.mode("overwrite").partitionBy("bucket").text(path)


def write_records(records: DataFrame, path: str, number: str = "orig_index", key: str = "_orig_index") -> None:
    """JSON Lines of record bodies, each with its number stored under ``key`` as the first field."""
    inner = F.regexp_extract("body", r"(?s)^\s*\{(.*)$", 1)
    rest = F.when(F.trim(inner) == "}", inner).otherwise(F.concat(F.lit(","), inner))
    line = F.concat(F.lit('{"' + key + '":'), F.col(number).cast("string"), rest)
    flat = F.regexp_replace(line, r"[\r\n]+", " ")  # bodies may be pretty-printed
    records.select(flat.alias("value")).write.mode("overwrite").text(path)


def write_sidecars(sidecars: DataFrame, path: str, by: str | None = None) -> None:
    """Sidecars as JSON Lines, in one folder per value of ``by`` where given."""
    writer = sidecars.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).json(path)


def write_manifest(manifest: DataFrame, path: str) -> None:
    """Manifest CSV with header."""
    (manifest.select("orig_idx", "bucket", "file_name", "product_name", "gwp_a1a3", "notes")
     .write.mode("overwrite").option("header", True).csv(path))


def write_scores(scores: DataFrame, path: str, digits: int = 4) -> None:
    """Per-record scores CSV; F1 values rounded for presentation only."""
    f1 = [c for c in scores.columns if c.startswith("f1_")]
    out = scores.select(*[F.round(c, digits).alias(c) if c in f1 else F.col(c) for c in scores.columns])
    out.write.mode("overwrite").option("header", True).csv(path)


def append_ledger(row: DataFrame, path: str, run_id: str | None = None) -> None:
    """Append a run's summary rows to a Parquet ledger (schema travels with the data).

    Every attempt writes its own folder and, when that is whole, a commit record for the run.
    ``read_ledger`` shows only the last committed attempt of each run, so a run that is
    repeated, or dies half-way, leaves one set of rows. Without ``run_id`` the rows are a new run.
    """
    attempt = uuid.uuid4().hex
    run = run_id or attempt
    row.write.parquet(f"{path}/run_id={quote(run, safe='')}/attempt={attempt}")
    commit = row.sparkSession.range(1).select(F.lit(run).alias("run_id"), F.lit(attempt).alias("attempt"),
                                              F.current_timestamp().alias("committed_at"))
    commit.write.mode("append").parquet(f"{path}/{COMMITS}")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The rows of committed runs, with their ``run_id``; of a repeated run the last committed attempt."""
    commits = spark.read.parquet(f"{path}/{COMMITS}").groupBy("run_id").agg(
        F.max_by("attempt", F.struct("committed_at", "attempt")).alias("attempt"))
    rows = spark.read.parquet(path).drop("run_id")
    return rows.join(commits, "attempt").drop("attempt")


def write_results(df: DataFrame, path: str) -> None:
    """S10 + S11: per-document results (parsed record beside its raw text) as JSON Lines."""
    df.write.mode("overwrite").json(path)
