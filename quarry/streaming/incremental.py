"""Resumable, incremental processing with Structured Streaming (ST1-ST3).

A file source with a checkpoint remembers which files were read, so a killed job resumes
where it stopped. ``foreachBatch`` writes each micro-batch into its own ``batch_id=<n>``
folder with overwrite, so a replayed batch replaces its own output instead of duplicating it.

``process_documents`` remembers documents as well: the sink itself is the record of what is
done. A micro-batch is joined against the names in all other batches' folders, so a document
that comes again (in a later file, after a restart, or after the checkpoint was lost and the
stream began anew) gets no second row.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.skew import materialise


def idempotent_append(transform: Callable[[DataFrame], DataFrame], sink: str,
                      fmt: str = "parquet") -> Callable[[DataFrame, int], None]:
    """ST2: a ``foreachBatch`` function writing ``transform(batch)`` to ``sink/batch_id=<n>``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").format(fmt).save(f"{sink}/batch_id={batch_id}")
    return write


def read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at ``path``, or None where nothing was written yet; other failures are raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def table_source(spark: SparkSession, folder: str, name: str) -> tuple[str, str | None]:
    """(source, glob) of a stored table that is one file ``name`` or a folder of part files.

    One row says which: the name of the file it lies in.
    """
    path = f"{folder.rstrip('/')}/{name}"
    row = spark.read.parquet(path).select(F.col("_metadata.file_name").alias("file")).first()
    return (folder, name) if row is not None and row["file"] == name else (path, None)


def process_new(spark: SparkSession, source: str, schema: str, checkpoint: str, sink: str,
                transform: Callable[[DataFrame], DataFrame], fmt: str = "parquet",
                max_files_per_trigger: int | None = None, glob: str | None = None) -> None:
    """ST1 + ST2: process every not-yet-seen input file once, then stop (availableNow).

    ``source`` is a directory; ``glob`` narrows it to matching file names.
    """
    reader = spark.readStream.format(fmt).schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    q = (reader.load(source).writeStream.foreachBatch(idempotent_append(transform, sink))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def _run_id(spark: SparkSession, checkpoint: str) -> str:
    """The stream's own id, which its checkpoint keeps over restarts."""
    return json.loads(spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()[0])["id"]


def done_names(spark: SparkSession, sink: str, key: str, run: str, batch_id: int) -> DataFrame | None:
    """Names with a row in ``sink``, but for what this batch (or a later one) of this run has written."""
    written = read_if_there(spark, sink)
    if written is None:
        return None
    own = (F.col("run") == run) & (F.col("batch_id") >= batch_id)
    return written.where(~own).select(key).where(F.col(key).isNotNull())


def document_batch(transform: Callable[[DataFrame], DataFrame], name: Column, key: str, sink: str,
                   checkpoint: str) -> Callable[[DataFrame, int], None]:
    """ST2: a ``foreachBatch`` function that writes one row per document not yet in ``sink``.

    ``name`` is a document's name, computed from the input; ``transform`` gives the row with
    the name in column ``key``. Names are reduced to one row each before they are compared,
    so a name on very many rows is no hot key, and documents that are done are left out
    before any work is done on them. Rows of one name within a batch give the least row.
    Documents without a name cannot be recognised: each gets its row.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        run = _run_id(spark, checkpoint)
        done = done_names(spark, sink, key, run, batch_id)
        todo = batch
        if done is not None:
            names = batch.select(name.alias("_name")).where("_name is not null").groupBy("_name").agg(F.count(F.lit(1)).alias("_n"))
            # as many rows as the batch has names; written, so that the planner knows its size
            seen = materialise(names.join(done.select(F.col(key).alias("_name")), "_name", "left_semi").select("_name"), "names-seen")
            todo = batch.withColumn("_name", name).join(seen, "_name", "left_anti").drop("_name")
        rows = transform(todo)
        rest = [c for c in rows.columns if c != key]
        one = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*rest)).alias("_row"))
        out = one.select(key, "_row.*").select(*rows.columns).unionByName(rows.where(F.col(key).isNull()))
        out.write.mode("overwrite").parquet(f"{sink}/run={run}/batch_id={batch_id}")
    return write


def process_documents(spark: SparkSession, source: str, schema: str, checkpoint: str, sink: str,
                      transform: Callable[[DataFrame], DataFrame], name: Column, key: str = "filename", fmt: str = "parquet",
                      max_files_per_trigger: int | None = None, glob: str | None = None) -> None:
    """ST1 + ST2: process every document that has no row yet, once, then stop (availableNow).

    Read the result with ``read_documents``. One stream at a time may write to ``sink``.
    """
    reader = spark.readStream.format(fmt).schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    write = document_batch(transform, name, key, sink, checkpoint)
    q = reader.load(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def read_documents(spark: SparkSession, sink: str) -> DataFrame:
    """The rows that ``process_documents`` wrote."""
    return spark.read.parquet(sink).drop("run", "batch_id")


def append_summary(spark: SparkSession, source: str, schema: str, checkpoint: str, ledger: str,
                   summarise: Callable[[DataFrame], DataFrame], fmt: str = "parquet",
                   max_files_per_trigger: int | None = None, glob: str | None = None) -> None:
    """ST3: summary rows per micro-batch appended to the ledger (replay-safe)."""
    process_new(spark, source, schema, checkpoint, ledger, summarise, fmt, max_files_per_trigger, glob)
