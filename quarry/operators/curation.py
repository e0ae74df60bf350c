"""Gold-set curation: schema variants, key renaming, clean/quarantine split.

Records are ``orig_index BIGINT, file_name STRING, body STRING`` (JSON text).
Renaming and first-wins de-duplication happen inside each row against a
fixed-size literal map, so normalisation is a narrow projection (no join,
no shuffle). Roll-ups are single-pass conditional aggregates.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.records import RECORD_MAP, parse_object
from quarry.functions.skew import dealt
from quarry.functions.text import bind
from quarry.operators.scoring import LCA_INDICATORS, LCA_STAGES

# --------------------------------------------------------------------------
# Fixed values that must equal the reference (key names are data, typos kept).
# --------------------------------------------------------------------------
EPD_INTL_MAP = {
    "Embodied Carbon (GWP Total)": "GWP-TOTAL",
    "Embodied Carbon (GWP Fossil)": "GWP-FOSSIL",
    "Embodied Carbon (GWP Biogenic)": "GWP-BIOGENIC",
    "Embodied Energy (PERT - Renewable)": "PERT",
    "Embodied Energy (PENRT - Non-Renewable)": "PENRT",
    "Freshwater Use (FW)": "FRESH WATER",
    "Eutrophication Potential (EP)": "EUTROFICATION",
    "Acidification Potential (AP)": "ACIDIFICATION",
    "Name of products": "Product Name",
    "Epd product name": "Product Name",
    "Expiry Date yyyy-mm-dd": "Expiry Date",
    "Durable Data Value: Life Expectancy": "Durbale Data Value: Life Expectancy",
    "Durable Data Value: Warranty": "Durbale Data Value: Warranty",
    "Acoustic (Impact) Value": "Acoustic (Impact) Value (in dB)",
    "Acoustic (Airborne) Value": "Acoustic (Airborne) Value (in dB)",
}
BRE_MAP = {
    "Name of Product": "Product Name",
    "EPD Number": "EPD Document No",
    "EPD Program Operator": "EPD Certification Body /Publisher/Program operator",
    "Verification Method": "EPD Verification Method",
    "Functional Unit/Declared Unit": "Functional Unit",
    "EPD Type": "EPD Certificated Type",
    "GWP Total / Global Warming": "GWP-TOTAL",
    "GWP-fossil": "GWP-FOSSIL",
    "GWP Biogenic": "GWP-BIOGENIC",
    "Net use of fresh water(FW)": "FRESH WATER",
    "Eutrophication Potential(EP)": "EUTROFICATION",
    "Acidification Potential(AP)": "ACIDIFICATION",
    "Fire Class": "Fire class",
}
EPD_INTL_MARKER = "Embodied Carbon (GWP Total)"
BRE_MARKERS = ("GWP Total / Global Warming", "Name of Product")
VARIANTS = ("canonical", "epd_intl", "bre")
AGGREGATED = "AGG"  # a stage that is reported in another one
BENIGN_SUBKEYS = ("Description", "Indicator Name")
SHOWN_INDICATORS = ("GWP-TOTAL", "PERT", "PENRT", "FRESH WATER", "ACIDIFICATION", "EUTROFICATION")  # P27 listing


def detect_variant(m: Column) -> Column:
    """P10: key-presence test; epd_intl is checked before bre."""
    return (F.when(F.map_contains_key(m, F.lit(EPD_INTL_MARKER)), F.lit("epd_intl"))
            .when(F.map_contains_key(m, F.lit(BRE_MARKERS[0])) | F.map_contains_key(m, F.lit(BRE_MARKERS[1])),
                  F.lit("bre"))
            .otherwise(F.lit("canonical")))


def _rename_literal() -> Column:
    """``variant|old -> canonical`` as one folded literal map (fixed size)."""
    entries = {f"epd_intl|{k}": v for k, v in EPD_INTL_MAP.items()}
    entries.update({f"bre|{k}": v for k, v in BRE_MAP.items()})
    return F.from_json(F.lit(json.dumps(entries)), RECORD_MAP)


def json_value(v: Column) -> Column:
    """Render a map value back as JSON: nested objects/arrays stay raw, scalars are quoted."""
    nested = v.rlike(r"^\s*[\{\[]") & F.from_json(F.concat(F.lit("["), v, F.lit("]")), "array<string>").isNotNull()
    return F.when(v.isNull(), F.lit("null")).when(nested, v).otherwise(F.to_json(F.array(v)).substr(F.lit(2), F.length(F.to_json(F.array(v))) - 2))


def entries_to_json(entries: Column) -> Column:
    """array<struct<key,value>> -> JSON object text, preserving entry order."""
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(
        F.to_json(F.array(e.key)).substr(F.lit(2), F.length(F.to_json(F.array(e.key))) - 2),
        F.lit(":"), json_value(e.value))), ","), F.lit("}"))


def renamed_entries(m: Column, variant: Column) -> Column:
    """P11 + J9: rename keys by variant, first occurrence of a canonical key wins."""
    rename = _rename_literal()
    renamed = F.transform(F.map_entries(m), lambda e, i: F.struct(
        F.coalesce(rename[F.concat(variant, F.lit("|"), e.key)], e.key).alias("key"),
        e.key.alias("source_key"), e.value.alias("value"), (i + 1).alias("pos")))

    def first_wins(arr: Column) -> Column:
        keys = F.transform(arr, lambda x: x.key)
        return F.filter(arr, lambda e, i: F.array_position(keys, e.key) == i + 1)

    return bind(renamed, first_wins)


def normalise_records(records: DataFrame) -> DataFrame:
    """P10 + P11 over records: adds ``variant`` and rewrites ``body`` canonically."""
    parsed = records.select("orig_index", "file_name", parse_object(F.col("body")).alias("m"))
    with_variant = parsed.withColumn("variant", detect_variant(F.col("m")))
    return with_variant.select(
        "orig_index", "file_name", "variant",
        entries_to_json(renamed_entries(F.col("m"), F.col("variant"))).alias("body"))


def strip_benign_subkeys(m: Column, indicators: tuple[str, ...] = LCA_INDICATORS) -> Column:
    """Drop annotation sub-keys inside indicator objects (clean bucket only)."""
    def fix(e: Column) -> Column:
        inner = parse_object(e.value)
        kept = F.filter(F.map_entries(inner), lambda s: ~s.key.isin(list(BENIGN_SUBKEYS)))
        return F.struct(e.key.alias("key"),
                        F.when(e.key.isin(list(indicators)) & inner.isNotNull(), entries_to_json(kept))
                        .otherwise(e.value).alias("value"))
    return F.transform(F.map_entries(m), fix)


def manifest(normalised: DataFrame, decisions: DataFrame, clean_ids: DataFrame) -> DataFrame:
    """J8 + P13 + P14 + U2: one manifest row per record, clean or quarantined.

    ``decisions``: ``orig_index, reason``; ``clean_ids``: ``orig_index``.
    Both grow with the data, so the join strategy is left to AQE's runtime
    size check instead of a forced broadcast. An index in neither set is
    quarantined with reason ``UNKNOWN``. Bodies stay out of the joins: only the few
    texts taken from them are shuffled and sorted.
    """
    m = parse_object(F.col("body"))
    gwp = parse_object(m[F.lit("GWP-TOTAL")])
    a1a3 = F.coalesce(F.when(F.map_contains_key(gwp, F.lit("A1-A3")), F.coalesce(gwp[F.lit("A1-A3")], F.lit("None"))),
                      F.lit("N/A"))
    product = F.when(F.map_contains_key(m, F.lit("Product Name")), F.coalesce(m[F.lit("Product Name")], F.lit(""))).otherwise(F.lit(""))
    shown = normalised.select("orig_index", "file_name", product.alias("product_name"), a1a3.alias("a1a3"))
    joined = (shown.join(clean_ids.select("orig_index", F.lit(True).alias("is_clean")), "orig_index", "left")
              .join(decisions.select("orig_index", "reason"), "orig_index", "left"))
    clean = F.coalesce(F.col("is_clean"), F.lit(False))
    reason = F.coalesce(F.col("reason"), F.lit("UNKNOWN"))
    return joined.select(
        F.col("orig_index").alias("orig_idx"),
        F.when(clean, F.lit("CLEAN")).otherwise(F.lit("QUARANTINE")).alias("bucket"),
        "file_name", "product_name",
        F.when(clean, F.col("a1a3")).otherwise(F.lit("N/A")).alias("gwp_a1a3"),
        F.when(clean, F.lit("")).otherwise(F.split_part(reason, F.lit(":"), F.lit(1))).alias("notes"),
        F.when(clean, F.lit(None).cast("string")).otherwise(reason).alias("quarantine_reason"),
    )


def split_buckets(normalised: DataFrame, man: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S6 inputs: clean records (benign sub-keys stripped, ``_orig_index`` added)
    and quarantine records (kept whole, plus ``_quarantine_reason``).

    Bodies are dealt by their number, so a task sorts a bounded number of them."""
    j = dealt(normalised, "orig_index").join(man.select(F.col("orig_idx").alias("orig_index"), "bucket", "quarantine_reason"),
                        "orig_index")
    m = parse_object(F.col("body"))
    idx = F.struct(F.lit("_orig_index").alias("key"), F.col("orig_index").cast("string").alias("value"))
    clean = j.where(F.col("bucket") == "CLEAN").select(
        "orig_index", "file_name",
        entries_to_json(F.concat(strip_benign_subkeys(m), F.array(idx))).alias("body"))
    reason = F.struct(F.lit("_quarantine_reason").alias("key"), F.col("quarantine_reason").alias("value"))
    quarantine = j.where(F.col("bucket") == "QUARANTINE").select(
        "orig_index", "file_name",
        entries_to_json(F.concat(F.map_entries(m), F.array(idx, reason))).alias("body"))
    return clean, quarantine


def _domain_rows(counts: list[tuple[str, Column]], df: DataFrame, col: str, name: str) -> DataFrame:
    """(col, name): one conditional count per value of a fixed domain, in one pass."""
    totals = df.agg(*[c.alias(f"c{i}") for i, (_, c) in enumerate(counts)])
    pairs = [x for i, (value, _) in enumerate(counts) for x in (F.lit(value), F.col(f"c{i}").cast("bigint"))]
    return totals.select(F.stack(F.lit(len(counts)), *pairs).alias(col, name))


def count_rows_by(df: DataFrame, col: str, values: tuple[str, ...], name: str = "n") -> DataFrame:
    """Counts for a fixed domain in one pass, zero rows included."""
    return _domain_rows([(v, F.count_if(F.col(col) == v)) for v in values], df, col, name)


def field_presence(records: DataFrame) -> DataFrame:
    """Per raw key, the number of records holding it and whether all do."""
    total = records.select(F.count(F.lit(1))).scalar()
    keys = records.select(F.explode(F.array_distinct(F.map_keys(parse_object(F.col("body"))))).alias("field"))
    counts = keys.groupBy("field").agg(F.count(F.lit(1)).cast("bigint").alias("n_records"))
    # O2: most common first, name as the stable tiebreak (a sort over distinct keys only).
    return (counts.select("field", "n_records", (F.col("n_records") == total).alias("in_all"))
            .orderBy(F.desc("n_records"), "field"))


def coverage(normalised: DataFrame, fields: tuple[str, ...] = LCA_INDICATORS) -> DataFrame:
    """Number of records holding each canonical field (absent -> 0)."""
    m = parse_object(F.col("body"))
    return _domain_rows([(f, F.count_if(F.map_contains_key(m, F.lit(f)))) for f in fields], normalised, "field", "n_records")


def contaminated_keys(m: Column, max_words: int = 6) -> Column:
    """Keys that read like sentences (> ``max_words`` words) or carry padding."""
    return F.filter(F.map_keys(m), lambda k: (F.size(F.split(F.trim(k), " ")) > max_words) | (k != F.trim(k)))


def _leaf_values(m: Column, indicators: tuple[str, ...], skip: tuple[str, ...], unit_key: str = "Unit") -> Column:
    """Flat values, one entry per list field, and non-Unit indicator sub-values."""
    def per_entry(e: Column) -> Column:
        inner = F.map_entries(parse_object(e.value))
        sub = F.transform(F.filter(inner, lambda s: s.key != unit_key), lambda s: s.value)
        is_list = e.value.rlike(r"^\s*\[")
        listed = F.array(F.when(F.size(F.from_json(e.value, "array<string>")) > 0, F.lit("x")).otherwise(F.lit("N/A")))
        return (F.when(e.key.isin(list(indicators)), F.coalesce(sub, F.array().cast("array<string>")))
                .when(is_list, listed).otherwise(F.array(e.value)))
    kept = F.filter(F.map_entries(m), lambda e: ~e.key.isin(list(skip)))
    return F.flatten(F.transform(kept, per_entry))


def fill_ratio(normalised: DataFrame, empty_below: float = 0.25) -> DataFrame:
    """Populated (not N/A) share of each record's leaves; flags near-empty ones."""
    from quarry.functions.text import is_na
    from quarry.operators.scoring import SKIP_FIELDS
    vals = _leaf_values(parse_object(F.col("body")), LCA_INDICATORS, SKIP_FIELDS)
    df = normalised.select("orig_index", vals.alias("v")).select(
        "orig_index", F.size("v").cast("bigint").alias("n_leaves"),
        F.size(F.filter("v", lambda x: ~F.coalesce(is_na(x), F.lit(False)))).cast("bigint").alias("n_populated"))
    ratio = F.when(F.col("n_leaves") > 0, F.col("n_populated") / F.col("n_leaves")).otherwise(F.lit(0.0))
    return df.select("orig_index", "n_leaves", "n_populated", ratio.alias("fill_ratio"),
                     (ratio < empty_below).alias("near_empty"))


def indicator_objects(normalised: DataFrame, indicators: tuple[str, ...] = LCA_INDICATORS) -> DataFrame:
    """(orig_index, indicator, stages): one row per indicator that a record reports as an object."""
    body = normalised.select("orig_index", parse_object(F.col("body")).alias("_m"))
    named = F.array(*[F.struct(F.lit(x).alias("indicator"), F.col("_m")[F.lit(x)].alias("_text")) for x in indicators])
    each = body.select("orig_index", F.inline(F.filter(named, lambda e: e["_text"].isNotNull())))
    return each.select("orig_index", "indicator", parse_object(F.col("_text")).alias("stages")).where(F.col("stages").isNotNull())


def sum_consistency(normalised: DataFrame, rtol: float = 1e-3, atol: float = 1e-4,
                    indicators: tuple[str, ...] = LCA_INDICATORS) -> DataFrame:
    """``A1-A3`` against ``A1 + A2 + A3`` of every indicator that a record reports.

    A stage that is absent, not reported or marked as aggregated makes the check incomplete;
    one whose text is no number makes it unparseable.
    """
    from quarry.functions.text import is_na, parse_numeric
    stages = (("A1", "a1"), ("A2", "a2"), ("A3", "a3"), ("A1-A3", "total"))
    value = {n: F.col("stages")[F.lit(s)] for s, n in stages}
    nums = indicator_objects(normalised, indicators).select(
        "orig_index", "indicator", *[parse_numeric(v).alias(n) for n, v in value.items()],
        *[(v.isNotNull() & ~is_na(v) & (v != AGGREGATED)).alias(f"has_{n}") for n, v in value.items()])
    junk, missing = F.lit(False), F.lit(False)
    for _, n in stages:
        junk = junk | (F.col(f"has_{n}") & F.col(n).isNull())
        missing = missing | F.col(n).isNull()
    parts = F.col("a1") + F.col("a2") + F.col("a3")
    status = (F.when(junk, F.lit("unparseable")).when(missing, F.lit("incomplete"))
              .when(F.abs(parts - F.col("total")) <= F.lit(atol) + F.lit(rtol) * F.abs(F.col("total")), F.lit("consistent"))
              .otherwise(F.lit("inconsistent")))
    return nums.select("orig_index", "indicator", status.alias("status"))


NOTATION_CLASSES = ("clean", "spaced_exponent", "not_reported", "aggregated", "unparseable")


def notation_class(v: Column) -> Column:
    """Class of one value: a clean number, an exponent with a space (``1.61 E-01``), N/A, the aggregated marker, or other text."""
    from quarry.functions.text import is_na
    return (F.when(v.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.lit("clean"))
            .when(v.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)\s+[eE]\s*[+-]?\d+$"), F.lit("spaced_exponent"))
            .when(is_na(v), F.lit("not_reported")).when(v == AGGREGATED, F.lit("aggregated")).otherwise(F.lit("unparseable")))


def notation_classes(normalised: DataFrame, indicators: tuple[str, ...] = LCA_INDICATORS,
                     stages: tuple[str, ...] = tuple(s for s in LCA_STAGES if s != "Unit")) -> DataFrame:
    """Per indicator and stage, records by value class; ``n_missing`` counts those without the value.

    All pairs of the fixed domain are returned, those that never occur with zeros.
    """
    each = indicator_objects(normalised, indicators).select("indicator", F.explode("stages").alias("stage", "value")).where(
        F.col("value").isNotNull() & F.col("stage").isin(list(stages)))
    found = each.withColumn("_class", notation_class(F.col("value"))).groupBy("indicator", "stage").agg(
        *[F.count_if(F.col("_class") == c).alias(f"n_{c}") for c in NOTATION_CLASSES], F.count(F.lit(1)).alias("_present"))
    pairs = F.array(*[F.struct(F.lit(i).alias("indicator"), F.lit(s).alias("stage")) for i in indicators for s in stages])
    domain = normalised.agg(F.count(F.lit(1)).alias("_records")).select("_records", F.inline(pairs))
    out = domain.join(found, ["indicator", "stage"], "left")
    counts = [F.coalesce(f"n_{c}", F.lit(0)).cast("bigint").alias(f"n_{c}") for c in NOTATION_CLASSES]
    return out.select("indicator", "stage", *counts,
                      (F.col("_records") - F.coalesce("_present", F.lit(0))).cast("bigint").alias("n_missing"))
