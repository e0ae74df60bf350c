"""Exact deduplication by 128-bit content hash, with byte comparison inside groups.

Texts are equal when their bytes are equal (null counts as empty). Rows are grouped by
MD5; one row of each group is the keeper, and every other row of the group is compared with
the keeper's bytes, so a hash collision never merges different texts. Only digests are
shuffled for the whole table; texts move only to rows that share a digest.

Defined cases: a null id never wins against an id; rows that repeat both id and text are
copies like any other, each returned with the same decision; an empty table gives an empty
result; other columns are ignored and may have any name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.skew import key_bitmap, materialise, maybe_in, salted_join


def content_digest(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min",
                 digest: Callable[[Column], Column] = content_digest) -> DataFrame:
    """One row per input row: id, digest, keep_id, group_size, kept, text_sha256.

    ``keep`` is "min" (smallest id stays) or "max". ``digest`` may be replaced by a weaker
    one; the result stays the same, because equality is decided on bytes.
    """
    best = {"min": F.min, "max": F.max}[keep]
    base = docs.select(docs[id_col].alias("_id"), F.coalesce(docs[text_col], F.lit("")).alias("_text"))
    keyed = base.withColumn("_h", digest(F.col("_text")))
    light = materialise(keyed.select("_id", "_h", F.sha2(F.col("_text").cast("binary"), 256).alias("_sha")), "digests")
    groups = materialise(light.groupBy("_h").agg(F.count(F.lit(1)).alias("_n"), best("_id").alias("_keep"))
                         .where("_n > 1"), "digest-groups")
    total = groups.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    spread = [F.col("_id")]
    rows = salted_join(light, groups, ["_h"], spread, "_n", total, how="left")

    differing = materialise(_differing(keyed, groups, total, spread), "digest-collisions")
    if not differing.isEmpty():
        rows = _split_collisions(rows, differing, best)
    return rows.select(
        F.col("_id").alias(id_col), F.col("_h").alias("digest"),
        F.when(F.col("_n").isNull(), F.col("_id")).otherwise(F.col("_keep")).alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("_n").isNull(), F.lit(True)).otherwise(F.col("_id").eqNullSafe(F.col("_keep"))).alias("kept"),
        F.col("_sha").alias("text_sha256"))


def _differing(keyed: DataFrame, groups: DataFrame, total: int, spread: list[Column]) -> DataFrame:
    """Rows whose bytes differ from those of their group's keeper (hash collisions)."""
    thinned = maybe_in(keyed, "_h", key_bitmap(groups, "_h"))  # texts of single rows stay where they are
    shared = materialise(salted_join(thinned, groups, ["_h"], spread, "_n", total), "digest-copies")
    keepers = (shared.where(F.col("_id").eqNullSafe(F.col("_keep"))).groupBy("_h", "_n")
               .agg(F.min("_text").alias("_kept_text")))
    return (salted_join(shared.drop("_n", "_keep"), keepers, ["_h"], spread, "_n", total)
            .where(F.col("_text") != F.col("_kept_text")).select("_id", "_h", "_text"))


def _split_collisions(rows: DataFrame, differing: DataFrame, best: Callable) -> DataFrame:
    """Regroup colliding rows by (digest, bytes) and take them out of their first group."""
    own = differing.groupBy("_h", "_text").agg(F.count(F.lit(1)).alias("_own_n"), best("_id").alias("_own_keep"))
    moved = (differing.join(own, ["_h", "_text"]).withColumn("_own_sha", F.sha2(F.col("_text").cast("binary"), 256))
             .select("_h", F.col("_id").alias("_mid"), "_own_sha", "_own_n", "_own_keep").distinct())
    gone = differing.groupBy("_h").agg(F.count(F.lit(1)).alias("_gone"))
    m = moved.withColumnRenamed("_h", "_mh")
    joined = rows.join(m, (rows["_h"] == m["_mh"]) & rows["_id"].eqNullSafe(m["_mid"])
                       & (rows["_sha"] == m["_own_sha"]), "left").join(gone, "_h", "left")
    return (joined.withColumn("_n", F.coalesce("_own_n", F.col("_n") - F.coalesce("_gone", F.lit(0))))
            .withColumn("_keep", F.when(F.col("_own_n").isNotNull(), F.col("_own_keep")).otherwise(F.col("_keep"))))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """``docs`` with one row of each distinct text, all columns as they were."""
    decided = materialise(exact_groups(docs, id_col, text_col, keep), "exact-decisions")
    gone = decided.where(~F.col("kept")).select(F.col(id_col).alias("_id"), F.col("text_sha256").alias("_sha"))
    sha = F.sha2(F.coalesce(docs[text_col], F.lit("")).cast("binary"), 256)
    left = docs.withColumn("_row_sha", sha)
    stay = left.join(gone, left[id_col].eqNullSafe(gone["_id"]) & (left["_row_sha"] == gone["_sha"]), "left_anti")
    again = decided.where("kept").groupBy(id_col, "text_sha256").count().where("count > 1")
    if not again.isEmpty():  # rows that repeat id and text
        stay = stay.dropDuplicates([id_col, "_row_sha"])
    return stay.drop("_row_sha")
