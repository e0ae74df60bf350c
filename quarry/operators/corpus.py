"""Corpus profiling: per-document features, tiering, name matching, resume.

Profiles are row-local projections; summaries are one conditional aggregate;
name matching is an equi-join on a normalised key (never a nested loop).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import name_key, py_strip, stem_candidates, truncate

# --------------------------------------------------------------------------
# Fixed values of the profiling rules (must equal the reference).
# --------------------------------------------------------------------------
SCAN_CHAR_THRESHOLD = 80       # chars per page below which a document is "scanned"
LANG_MIN_CHARS = 50            # a language is only reported for a stripped text longer than this
LANG_ESCAPES = ("en", "unknown", "insufficient_text")
TIERS = ("Simple", "Medium", "Hard")
HARD_PAGES, MEDIUM_PAGES, MEDIUM_TABLES = 15, 8, 4
REASON_CHARS = 80              # error preview in a skip listing


def native_vs_scanned(chars_per_page: Column, read_ok: Column) -> Column:
    """``native`` at >= 80 characters per page, else ``scanned``; ``unknown`` if unread."""
    return (F.when(~read_ok, F.lit("unknown"))
            .when(chars_per_page >= SCAN_CHAR_THRESHOLD, F.lit("native")).otherwise(F.lit("scanned")))


def gated_language(text: Column, detected: Column, read_ok: Column) -> Column:
    """Detected language only when the whole stripped text is long enough."""
    return (F.when(~read_ok, F.lit("unknown"))
            .when(F.length(py_strip(text)) > LANG_MIN_CHARS, F.coalesce(detected, F.lit("unknown")))
            .otherwise(F.lit("insufficient_text")))


def non_english(language: Column) -> Column:
    """P20: a determined language other than English."""
    return ~language.isin(*LANG_ESCAPES)


def complexity_tier(scan: Column, success: Column, language: Column, pages: Column, tables: Column) -> Column:
    """Hard (scanned, failed, > 15 pages, non-English), Medium (> 8 pages or > 4 tables), else Simple."""
    return (F.when((scan == "scanned") | ~success | (pages > HARD_PAGES), F.lit("Hard"))
            .when(non_english(language), F.lit("Hard"))
            .when((pages > MEDIUM_PAGES) | (tables > MEDIUM_TABLES), F.lit("Medium"))
            .otherwise(F.lit("Simple")))


def profile(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """M7 audit rows from per-document facts.

    Expects ``filename, text, page_count, tagged, detected_lang, read_ok,
    docling_success, table_count, docling_error, pymupdf_error``; ``keep``
    names extra columns to pass through.
    """
    text_len = F.when(F.col("read_ok"), F.length("text")).otherwise(F.lit(0))
    cpp = text_len / F.greatest(F.col("page_count"), F.lit(1))
    out = docs.select(
        *keep, "filename", F.col("page_count").cast("int").alias("page_count"), text_len.cast("int").alias("text_length"),
        cpp.alias("chars_per_page"),
        native_vs_scanned(cpp, F.col("read_ok")).alias("native_vs_scanned"),
        F.col("tagged"),
        gated_language(F.col("text"), F.col("detected_lang"), F.col("read_ok")).alias("language"),
        F.col("docling_success"), F.col("table_count").cast("int").alias("table_count"),
        F.col("pymupdf_error"),
        F.col("docling_error"),
    )
    return out.withColumn("complexity_tier", complexity_tier(
        F.col("native_vs_scanned"), F.col("docling_success"), F.col("language"),
        F.col("page_count"), F.col("table_count")))


AUDIT_COLUMNS = (  # the audit row, in file order
    "filename", "page_count", "text_length", "chars_per_page", "native_vs_scanned", "tagged", "language",
    "docling_success", "table_count", "docling_table_text_len", "docling_text_len", "docling_seconds",
    "complexity_tier", "gold_standard_match", "pymupdf_error", "docling_error")


def audit_rows(docs: DataFrame, gold_names: DataFrame) -> DataFrame:
    """M7: the whole audit row: profile, converter sizes and time, gold name match."""
    prof = profile(docs, keep=("docling_table_text_len", "docling_text_len", "docling_seconds"))
    return prof.join(match_names(prof, gold_names), "filename", "left").select(*AUDIT_COLUMNS)


def corpus_summary(prof: DataFrame) -> DataFrame:
    """One pass of conditional counts; native = total - scanned (unknown counts as native)."""
    n = F.count(F.lit(1))
    scanned = F.count_if(F.col("native_vs_scanned") == "scanned")
    return prof.agg(
        n.alias("n_total"), (n - scanned).alias("n_native"), scanned.alias("n_scanned"),
        F.count_if("tagged").alias("n_tagged"),
        F.count_if(non_english(F.col("language"))).alias("n_non_english"),
        F.count_if(~F.col("docling_success")).alias("n_docling_failed"),
        *[F.count_if(F.col("complexity_tier") == t).alias(f"n_{t.lower()}") for t in TIERS],
    ).select(*[F.col(c).cast("bigint").alias(c) for c in
               ["n_total", "n_native", "n_scanned", "n_tagged", "n_non_english", "n_docling_failed",
                "n_simple", "n_medium", "n_hard"]])


def tier_listing(prof: DataFrame) -> DataFrame:
    """O1: per tier, pages descending (name breaks ties) — a range-partitioned global sort."""
    return (prof.select("complexity_tier", "filename", "page_count", "table_count", "docling_success", "language")
            .orderBy("complexity_tier", F.desc("page_count"), "filename"))


def match_names(docs: DataFrame, gold_names: DataFrame) -> DataFrame:
    """J5 + P15: exact name, else the least gold name with the same normalised key.

    Two one-to-one joins — against the distinct gold names, and against one
    (least) gold name per normalised key — so a popular key never pairs every
    document with every gold name.
    """
    g = gold_names.where(F.col("gold_name") != "").select("gold_name")
    exact = g.distinct().select(F.col("gold_name").alias("filename"), F.col("gold_name").alias("exact"))
    by_key = g.groupBy(name_key(F.col("gold_name")).alias("nk")).agg(F.min("gold_name").alias("fuzzy"))
    d = docs.select("filename", name_key(F.col("filename")).alias("nk"))
    j = d.join(exact, "filename", "left").join(by_key, "nk", "left")
    return j.select("filename", F.coalesce("exact", "fuzzy", F.lit("")).alias("gold_standard_match"))


def resolve_stems(gold_names: DataFrame, sidecars: DataFrame) -> DataFrame:
    """J6 + P16: first candidate stem (exact, colon stripped, zeros stripped) that has a sidecar."""
    cand = gold_names.select("gold_name", F.posexplode(stem_candidates(F.col("gold_name"))).alias("pos", "stem"))
    hits = cand.join(sidecars.select("stem").distinct(), "stem")
    best = hits.groupBy("gold_name").agg(F.min_by("stem", "pos").alias("resolved_stem"))
    return gold_names.select("gold_name").distinct().join(best, "gold_name", "left")


def remaining(candidates: DataFrame, done: DataFrame, key: str = "filename") -> DataFrame:
    """Items not yet processed (failed results count as done)."""
    return candidates.join(done.select(key).distinct(), key, "left_anti")


def usable_sidecars(resolved: DataFrame, sidecars: DataFrame) -> DataFrame:
    """usable = resolved stem with a successful sidecar; skips keep a reason.

    ``reason`` previews the error, ``error`` keeps all of it. Names without a stem pass
    around the join, so they are not gathered under the null key.
    """
    s = sidecars.select("stem", "success", "error")
    found = resolved.where(F.col("resolved_stem").isNotNull())
    j = found.join(s, found.resolved_stem == s.stem, "left").select("gold_name", "resolved_stem", "success", "error")
    none = resolved.where(F.col("resolved_stem").isNull()).select(
        "gold_name", "resolved_stem", F.lit(None).cast("boolean").alias("success"), F.lit(None).cast("string").alias("error"))
    j = j.unionByName(none)
    status = (F.when(F.col("resolved_stem").isNull(), F.lit("no_sidecar"))
              .when(~F.col("success"), F.lit("failed_sidecar")).otherwise(F.lit("usable")))
    reason = (F.when(F.col("resolved_stem").isNull(), F.lit("PDF missing or not preprocessed"))
              .when(~F.col("success"), F.concat(F.lit("success=False: "), truncate(F.col("error"), REASON_CHARS))))
    return j.select("gold_name", "resolved_stem", status.alias("status"), reason.alias("reason"), "error")


def table_stats(sidecars: DataFrame) -> DataFrame:
    """Table count and total markdown length per sidecar."""
    return sidecars.select(
        "filename", F.size("tables").cast("int").alias("table_count"),
        F.aggregate("tables", F.lit(0).cast("bigint"),
                    lambda acc, t: acc + F.coalesce(F.length(t.markdown), F.lit(0))).alias("table_text_len"))
