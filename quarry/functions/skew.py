"""Written tables in the shared folder, joins that split hot keys, exact ranks."""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import shared_dir


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, executors may be lost."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_batches(df: DataFrame, rows: int = 2_000) -> DataFrame:
    """``df``, with the session's Arrow batches held to ``rows`` rows where they would be larger.

    Rows here are whole documents; at the default of 10,000 a batch and its copies in the
    executor and the Python worker take hundreds of MB. The session setting stays changed,
    because the plan runs after this call.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= rows:
        conf.set(key, str(rows))
    return df


ROWS_PER_TASK = 10_000  # records of some KB each, with JSON to parse


def dealt(df: DataFrame, *keys: str, rows: int = ROWS_PER_TASK) -> DataFrame:
    """``df`` dealt by the hash of ``keys`` to one task per ``rows`` rows.

    The number of tasks follows the rows, not the bytes of a small file or of a well-packed
    shuffle: JSON text grows many times when it is unpacked, parsed and sorted.
    """
    return df.repartition(-(-df.count() // rows) or 1, *keys)


def salted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], spread: Sequence[Column],
                rows: str, total: int, how: str = "inner", parts: int = 4096, floor: int = 500) -> DataFrame:
    """Join ``left`` (many rows per key) to ``right`` (one row per key), hot keys split.

    ``right[rows]`` holds the number of left rows of each key and ``total`` their sum. A key
    with more than ``max(total / parts, floor)`` rows is hot; there are fewer than ``parts``
    of them, so their list is broadcast with that bound. A hot key gets one salt per such
    share of rows: its right row is repeated once per salt and its left rows are dealt over
    the salts by the hash of ``spread``, so no join key holds more than about one share.
    """
    share = max(total / parts, floor, 1)
    hot = (right.where(F.col(rows) > F.lit(share))
           .select(*keys, F.ceil(F.col(rows) / F.lit(share)).cast("int").alias("_salts")))
    salts = F.when(F.col(rows) > F.lit(share), F.ceil(F.col(rows) / F.lit(share))).otherwise(1).cast("int")
    dealt = (left.join(F.broadcast(hot), list(keys), "left")
             .withColumn("_salt", F.pmod(F.xxhash64(*spread), F.coalesce("_salts", F.lit(1))).cast("int"))
             .drop("_salts"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return dealt.join(copies, [*keys, "_salt"], how).drop("_salt")


def sorted_rows(df: DataFrame, order: Sequence[str | Column], name: str) -> DataFrame:
    """``df`` sorted by range over written files, with ``_file`` (name), ``_row`` (in the file) and ``rank`` (from 0, over all).

    No window runs over the whole table: files are counted (one row per file), and a row's
    rank is the size of the files before its own plus its place there.
    """
    path = shared_dir(df.sparkSession, name)
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)
    rows = df.sparkSession.read.schema(df.schema).parquet(path).select(
        "*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    files = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("_size"))
    before = files.select("_file", F.coalesce(F.sum("_size").over(
        Window.orderBy(F.length("_file"), "_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(before), "_file").select(  # as many rows as files
        *df.columns, "_file", "_row", (F.col("_before") + F.col("_row")).alias("rank"))


def exact_quantiles(df: DataFrame, groups: Sequence[str], value: str, quantiles: Sequence[float],
                    weight: str | None = None) -> DataFrame:
    """(groups, n, q0, q1, ...): the value of rank ceil(q * n) in each group, exact at any size.

    ``weight`` names the column that tells how many times a row counts (default: once).

    Rows are counted per (group, value) first. The counts are range-partitioned by group and
    value and written; each file's group totals (a few rows per file) give the rank offset of
    the files before it, so ranks are running sums inside one file and no group is gathered.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(
        (F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("_c"))
    path = shared_dir(df.sparkSession, "ranked-counts")
    (counts.repartitionByRange(*groups, value).sortWithinPartitions(*groups, value).write.parquet(path))
    ranked = df.sparkSession.read.parquet(path).withColumn("_file", F.col("_metadata.file_name"))
    per_file = ranked.groupBy(*groups, "_file").agg(F.sum("_c").alias("_sum"))
    # one row per group and file; files of a group are ordered by their number
    order = Window.partitionBy(*groups).orderBy(F.length("_file"), "_file")
    per_file = (per_file.withColumn("_before", F.coalesce(F.sum("_sum").over(
        order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("n", F.sum("_sum").over(Window.partitionBy(*groups))).drop("_sum"))
    inside = Window.partitionBy("_file", *groups).orderBy(value)
    last = ranked.withColumn("_upto", F.sum("_c").over(inside)).join(per_file, [*groups, "_file"])
    first = F.col("_before") + F.col("_upto") - F.col("_c")
    until = F.col("_before") + F.col("_upto")
    picks = []
    for k, q in enumerate(quantiles):
        rank = F.greatest(F.lit(1), F.ceil(F.lit(float(q)) * F.col("n")))
        picks.append(F.max(F.when((first < rank) & (rank <= until), F.col(value))).alias(f"q{k}"))
    return last.groupBy(*groups, "n").agg(*picks)


# Named by code that runs inside Python workers: ship this module's functions by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
