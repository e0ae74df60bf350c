"""Text cleaning, chunking and retrieval over whole documents.

Chunks are generated per row with ``sequence`` + ``substring`` and cover the
whole text (never a prefix). Retrieval ranks with a window bounded by ``k``,
which Spark turns into a per-partition group limit before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.skew import salted_join
from quarry.functions.text import py_strip

# Page markers and newline runs removed by cleaning.
PAGE_MARKER = r"Page \d+ of \d+"
NEWLINE_RUN = r"\n{3,}"


def clean_text(text: Column) -> Column:
    """Collapse 3+ newlines to 2, then drop ``Page n of m`` anywhere, strip."""
    return py_strip(F.regexp_replace(F.regexp_replace(text, NEWLINE_RUN, "\n\n"), PAGE_MARKER, ""))


def overlapping_chunks(df: DataFrame, text_col: str, size: int = 1000, overlap: int = 150) -> DataFrame:
    """Fixed-size chunks with overlap (15 % by default) covering the whole text."""
    step = size - overlap
    starts = F.when(F.length(text_col) > 0, F.sequence(F.lit(0), F.length(text_col) - 1, F.lit(step))) \
        .otherwise(F.array().cast("array<int>"))
    ex = df.select("*", F.posexplode(starts).alias("chunk_idx", "start"))
    return ex.withColumn("chunk", F.substring(F.col(text_col), F.col("start") + 1, F.lit(size)))


def page_groups(df: DataFrame, text_col: str, page_chars: int = 1800, pages_per_group: int = 20) -> DataFrame:
    """Page-range chunks — groups of ``pages_per_group`` pages of ``page_chars`` characters."""
    n_pages = F.greatest(F.lit(1), F.ceil(F.length(text_col) / F.lit(page_chars))).cast("int")
    n_groups = F.ceil(n_pages / F.lit(pages_per_group)).cast("int")
    ex = df.select("*", n_pages.alias("n_pages"), F.explode(F.sequence(F.lit(0), n_groups - 1)).alias("group_idx"))
    first = F.col("group_idx") * pages_per_group + 1
    last = F.least((F.col("group_idx") + 1) * pages_per_group, F.col("n_pages"))
    return ex.select("*", first.alias("first_page"), last.alias("last_page")).withColumn(
        "chunk", F.substring(F.col(text_col), (F.col("first_page") - 1) * page_chars + 1,
                             (F.col("last_page") - F.col("first_page") + 1) * page_chars))


def table_and_prose_chunks(sidecars: DataFrame, size: int = 1000, overlap: int = 150) -> DataFrame:
    """D3: every table becomes its own chunk; prose is chunked separately."""
    tables = sidecars.select("filename", F.explode("tables").alias("t")).select(
        "filename", F.lit("table").alias("chunk_type"), F.col("t.index").alias("chunk_idx"),
        F.col("t.markdown").alias("chunk"))
    prose = overlapping_chunks(sidecars.select("filename", "text"), "text", size, overlap).select(
        "filename", F.lit("prose").alias("chunk_type"), "chunk_idx", "chunk")
    return tables.unionByName(prose)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two equal-length numeric arrays."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                      lambda acc, v: acc + v)
    na = F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))
    nb = F.sqrt(F.aggregate(b, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))
    return dot / (na * nb)


def centroids(vectors: DataFrame, key: str, vec: str) -> DataFrame:
    """Element-wise mean vector per key (one row per key and dimension, then reassembled)."""
    dims = vectors.select(key, F.posexplode(vec).alias("pos", "x"))
    means = dims.groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s.m).alias("centroid"))


def top_k_by_query(candidates: DataFrame, queries: DataFrame, key: str, vec: str, query_vec: str,
                   id_col: str, rows: str, k: int = 5) -> DataFrame:
    """Per query key, the ``k`` candidates most similar to the query vector.

    Candidates are matched to queries on ``key`` (an equi-join, not all pairs), a key with
    many candidates (``queries[rows]``) over salts. ``row_number() <= k`` lets Spark keep
    only k rows per group per partition before the shuffle.
    """
    total = queries.agg(F.coalesce(F.sum(rows), F.lit(0))).first()[0]
    j = salted_join(candidates, queries, [key], [F.col(id_col)], rows, total)
    scored = j.select(key, id_col, cosine(F.col(vec), F.col(query_vec)).alias("score"))
    w = Window.partitionBy(key).orderBy(F.col("score").desc(), F.col(id_col))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


PAGE_RANGE = r"(?i)pages?\s+(\d+)(?:\s*[-–]\s*(\d+))?"


def pages_from_provenance(text: Column, provenance: Column, page_chars: int = 1800) -> tuple[Column, Column, Column]:
    """The page range named in provenance text ("pages 3-5", "page 4") and its text.

    Returns (first_page, last_page, chunk); no range named gives nulls.
    """
    first = F.nullif(F.regexp_extract(provenance, PAGE_RANGE, 1), F.lit("")).cast("int")
    last = F.coalesce(F.nullif(F.regexp_extract(provenance, PAGE_RANGE, 2), F.lit("")).cast("int"), first)
    chunk = F.substring(text, (first - 1) * page_chars + 1, (last - first + 1) * page_chars)
    return first, last, chunk
