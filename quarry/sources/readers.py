"""Sources: record files, sidecars, audit/manifest CSVs, document listings.

Schemas are declared, never inferred. Record bodies stay JSON text; the
record position in its file is the only unique key (``orig_index``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.records import parse_object
from quarry.functions.text import file_stem

SIDECAR_SCHEMA = ("filename string, success boolean, text string, "
                  "tables array<struct<index:int,markdown:string>>, page_count int, "
                  "processing_time_s double, error string")
AUDIT_SCHEMA = ("filename string, page_count int, text_length int, chars_per_page double, "
                "native_vs_scanned string, tagged boolean, language string, docling_success boolean, "
                "table_count int, docling_table_text_len int, docling_text_len int, docling_seconds double, "
                "complexity_tier string, gold_standard_match string, pymupdf_error string, docling_error string")
SCORES_SCHEMA = ("model string, file_name string, orig_index bigint, f1_overall double, f1_populated double, f1_na double, "
                 "f1_metadata double, f1_lca double, schema_valid boolean")
MANIFEST_SCHEMA = "orig_idx int, bucket string, file_name string, product_name string, gwp_a1a3 string, notes string"


def _with_name(df: DataFrame) -> DataFrame:
    name = parse_object(F.col("body"))[F.lit("file_name")]
    return df.withColumn("file_name", F.coalesce(name, F.lit("")))


def read_record_array(spark: SparkSession, path: str) -> DataFrame:
    """JSON arrays of records; ``orig_index`` is the position over all files in name order.

    A whole-array file is necessarily one task; convert it once with ``sinks.write_records``
    for large inputs and use ``read_record_lines``.
    """
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("_file"), "value")
    recs = raw.select("_file", F.posexplode(F.from_json("value", "array<string>")).alias("_pos", "body"))
    sizes = recs.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))  # one row per file
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    recs = recs.join(sizes.select("_file", before.alias("_before")), "_file")
    return _with_name(recs.select((F.col("_before") + F.col("_pos")).cast("bigint").alias("orig_index"), "body")) \
        .select("orig_index", "file_name", "body")


def read_record_lines(spark: SparkSession, path: str, index_key: str = "_orig_index") -> DataFrame:
    """S1 (scalable form): JSON Lines, one record per line, ``orig_index`` taken from ``index_key``.

    The index is stored by the writer (``sinks.write_records``). A line without it fails the
    read: two equal lines could not be told apart, and records would merge.
    """
    return _numbered_lines(spark, path, index_key, "orig_index")


def read_prediction_lines(spark: SparkSession, path: str, seq_key: str = "_seq") -> DataFrame:
    """Predictions as JSON Lines: ``seq, file_name, body``; the highest ``seq`` of a name wins in scoring."""
    return _numbered_lines(spark, path, seq_key, "seq")


def _numbered_lines(spark: SparkSession, path: str, key: str, name: str) -> DataFrame:
    raw = spark.read.text(path).where(F.trim("value") != "")
    number = parse_object(F.col("value"))[F.lit(key)].try_cast("bigint")
    missing = F.raise_error(F.concat(F.lit(f"record line without {key}: "), F.substring("value", 1, 80))).cast("bigint")
    recs = raw.select(F.when(number.isNotNull(), number).otherwise(missing).alias(name), F.col("value").alias("body"))
    return _with_name(recs).select(name, "file_name", "body")


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    """Records of both buckets as ``sinks.write_buckets`` wrote them: orig_index, bucket, file_name, body."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    number = parse_object(F.col("value"))[F.lit("_orig_index")].try_cast("bigint")
    return _with_name(raw.select(number.alias("orig_index"), "bucket", F.col("value").alias("body")))


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """Per-record scores CSV with typed columns."""
    return spark.read.schema(SCORES_SCHEMA).option("header", True).csv(path)


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Per-document results as JSON Lines, schema declared."""
    return spark.read.schema(schema).json(path)


def read_sidecars(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One JSON document per file (``lines``: per line, the scalable form); ``stem`` is the name without its suffix.

    The stem is that of the file, with ``lines`` that of the sidecar's own ``filename``.
    """
    df = spark.read.schema(SIDECAR_SCHEMA).option("multiLine", not lines).json(path)
    stem = file_stem(F.col("filename")) if lines else F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
    return df.withColumn("stem", stem)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """S3: audit CSV with typed columns (the reference reads every field as text)."""
    return spark.read.schema(AUDIT_SCHEMA).option("header", True).csv(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """S3: manifest CSV."""
    return spark.read.schema(MANIFEST_SCHEMA).option("header", True).csv(path)


def list_documents(spark: SparkSession, path: str, suffix: str = "pdf") -> DataFrame:
    """Documents by suffix (any case), top level only, content never read."""
    glob = "*." + "".join(f"[{c.lower()}{c.upper()}]" for c in suffix)
    df = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
          .option("recursiveFileLookup", "false").load(path))
    return df.select("path", "length", "modificationTime",
                     F.element_at(F.split("path", "/"), -1).alias("filename"))


def only(df: DataFrame, names: str | None, col: str = "file_name") -> DataFrame:
    """Keep rows whose ``col`` is in a comma-separated list (None keeps all); pushed into the scan."""
    wanted = [n.strip() for n in (names or "").split(",") if n.strip()]
    return df.where(F.col(col).isin(wanted)) if wanted else df
