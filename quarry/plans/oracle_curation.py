"""DuckDB oracle SQL for the curation group (variant records from ``part``)."""

# Stated here again, so that a change of the fixture shows as a difference.
CONTAMINATION_KEY = "Please extract all of the fields listed below from the document"
REASON_TEXT = {
    0: "UNVERIFIED: nobody has compared it with its source yet",
    1: "CONTAMINATED: some keys are sentences",
    2: "DUPLICATE: another record covers the same product",
    3: "EMPTY: no indicator has a value",
}

OP_KEY = "EPD Certification Body /Publisher/Program operator"

PART_FACTS = r"""
pf AS (
  SELECT p_partkey AS k,
    CASE WHEN p_partkey % 10 = 0 THEN 'epd_intl' WHEN p_partkey % 10 IN (1, 2) THEN 'bre' ELSE 'canonical' END AS variant,
    'EPD-' || lpad(CAST(p_partkey % 500 AS VARCHAR), 4, '0') || '.pdf' AS file_name,
    p_name AS product, 'DOC-' || CAST(p_partkey AS VARCHAR) AS doc_no,
    CASE WHEN p_partkey % 4 = 0 THEN lower(p_brand) ELSE p_brand END AS operator,
    p_partkey % 2 = 0 AS a2std,
    CAST(p_retailprice AS DECIMAL(18,2)) AS price,
    CAST(p_size AS VARCHAR) AS fw,
    (p_partkey % 37 = 0) AS collide, (p_partkey % 53 = 0) AS contaminated, p_partkey % 7 AS code,
    (p_partkey % 11 = 0) AS off, (p_partkey % 13 = 0) AS spaced
  FROM part),
pt AS (
  SELECT *,
    CAST(price * CAST('0.5' AS DECIMAL(1,1)) AS VARCHAR) AS a1,
    CAST(price * CAST('0.2' AS DECIMAL(1,1)) AS VARCHAR) AS a2,
    CAST(price * CAST('0.3' AS DECIMAL(1,1)) AS VARCHAR) AS a3,
    CASE WHEN spaced THEN CAST(CAST(price / 100 AS DECIMAL(18,4)) AS VARCHAR) || ' E+02'
         WHEN off THEN CAST(price + 1 AS VARCHAR) ELSE CAST(price AS VARCHAR) END AS a1a3,
    CASE WHEN variant <> 'canonical' AND collide THEN 1 ELSE 0 END AS shift
  FROM pf),
gj AS (
  SELECT *,
    CASE WHEN variant = 'bre' THEN '{"A1":"AGG","A1-A3":"' || a1a3 || '","Unit":"kg CO2e"}'
         ELSE '{"A1":"' || a1 || '","A2":"' || a2 || '","A3":"' || a3 || '","A1-A3":"' || a1a3
              || '","Unit":"kg CO2e","Description":"Global warming"}' END AS gwp_json,
    '{"A1-A3":"' || fw || '","Unit":"m3","Indicator Name":"FW"}' AS fw_json
  FROM pt)
"""

SLOTS = f"""
slots(slot, key, src_canonical, src_epd, src_bre) AS (VALUES
  (1, 'file_name', 'file_name', 'file_name', 'file_name'),
  (2, 'Product Name', 'Product Name', 'Name of products', 'Name of Product'),
  (3, 'EPD Document No', 'EPD Document No', 'EPD Document No', 'EPD Number'),
  (4, '{OP_KEY}', '{OP_KEY}', '{OP_KEY}', 'EPD Program Operator'),
  (5, 'Standard List', 'Standard List', 'Standard List', 'Standard List'),
  (6, 'GWP-TOTAL', 'GWP-TOTAL', 'Embodied Carbon (GWP Total)', 'GWP Total / Global Warming'),
  (7, 'FRESH WATER', 'FRESH WATER', 'Freshwater Use (FW)', 'Net use of fresh water(FW)'),
  (8, '{CONTAMINATION_KEY}', '{CONTAMINATION_KEY}', '{CONTAMINATION_KEY}', '{CONTAMINATION_KEY}'),
  (9, 'C2 ', 'C2 ', 'C2 ', 'C2 ')),
entries AS (
  SELECT pt.*, s.slot, s.key,
    CASE pt.variant WHEN 'canonical' THEN s.src_canonical WHEN 'epd_intl' THEN s.src_epd ELSE s.src_bre END AS source_key,
    s.slot + CASE WHEN s.slot >= 3 THEN pt.shift ELSE 0 END AS pos,
    CASE s.slot WHEN 1 THEN pt.file_name WHEN 2 THEN pt.product WHEN 3 THEN pt.doc_no WHEN 4 THEN pt.operator
                WHEN 5 THEN CASE WHEN pt.a2std THEN '["EN 15804+A2"]' ELSE '["EN 15804+A1","ISO 14025"]' END
                WHEN 6 THEN pt.gwp_json WHEN 7 THEN pt.fw_json WHEN 8 THEN 'x' WHEN 9 THEN 'N/A' END AS value
  FROM gj pt CROSS JOIN slots s
  WHERE s.slot <= 7 OR pt.contaminated)
"""

CLEAN = "code IN (4, 5)"
REASON_CASE = ("CASE code " + " ".join(f"WHEN {c} THEN '{t}'" for c, t in REASON_TEXT.items())
               + " ELSE 'UNKNOWN' END")
NOTE_CASE = ("CASE code " + " ".join(f"WHEN {c} THEN '{t.split(':')[0]}'" for c, t in REASON_TEXT.items())
             + " ELSE 'UNKNOWN' END")
INDICATORS_12 = ("GWP-TOTAL", "GWP-FOSSIL", "GWP-BIOGENIC", "FRESH WATER", "ACIDIFICATION", "EUTROFICATION",
                 "PERT", "PENRT", "PERE", "PERM", "PENRE", "PENRM")
STAGES_21 = ("A1", "A2", "A3", "A1-A3", "A4", "A5", "A4-A5", "B1", "B2", "B3", "B4", "B5", "B6", "B7", "B1-B7",
             "C1", "C2", "C3", "C4", "C1-C4", "D")
NOTATIONS = ("clean", "spaced_exponent", "not_reported", "aggregated", "unparseable")

W = "WITH " + PART_FACTS

SQL = {
    "variant_counts": W + """
SELECT v.variant, CAST(count(pf.k) AS BIGINT) AS n
FROM (VALUES ('canonical'), ('epd_intl'), ('bre')) v(variant) LEFT JOIN pf ON pf.variant = v.variant
GROUP BY v.variant""",
    "normalised_fields": W + "," + SLOTS + """
SELECT CAST(k AS BIGINT) AS orig_index, CAST(pos AS BIGINT) AS pos, key, source_key, value FROM entries""",
    "field_presence": W + "," + SLOTS + """,
raw AS (
  SELECT k, source_key AS field FROM entries
  UNION ALL SELECT k, CASE variant WHEN 'epd_intl' THEN 'Epd product name' ELSE 'Product Name' END
  FROM pt WHERE shift = 1)
SELECT field, CAST(count(*) AS BIGINT) AS n_records, count(*) = (SELECT count(*) FROM part) AS in_all
FROM raw GROUP BY field""",
    "field_coverage": W + """
SELECT f.field, CAST(CASE WHEN f.field IN ('GWP-TOTAL', 'FRESH WATER') THEN (SELECT count(*) FROM part)
                          ELSE 0 END AS BIGINT) AS n_records
FROM (VALUES """ + ", ".join(f"('{x}')" for x in INDICATORS_12) + """) f(field)""",
    "gold_manifest": W + f"""
SELECT CAST(k AS BIGINT) AS orig_idx, CASE WHEN {CLEAN} THEN 'CLEAN' ELSE 'QUARANTINE' END AS bucket,
       file_name, product AS product_name,
       CASE WHEN {CLEAN} THEN a1a3 ELSE 'N/A' END AS gwp_a1a3,
       CASE WHEN {CLEAN} THEN '' ELSE {NOTE_CASE} END AS notes,
       CASE WHEN {CLEAN} THEN NULL ELSE {REASON_CASE} END AS quarantine_reason
FROM pt""",
    "manifest_csv": W + f"""
SELECT CAST(k AS INTEGER) AS orig_idx, CASE WHEN {CLEAN} THEN 'CLEAN' ELSE 'QUARANTINE' END AS bucket,
       file_name, product AS product_name, CASE WHEN {CLEAN} THEN a1a3 ELSE 'N/A' END AS gwp_a1a3,
       CASE WHEN {CLEAN} THEN '' ELSE {NOTE_CASE} END AS notes
FROM pt""",
    "bucket_files": W + f"""
SELECT CAST(k AS BIGINT) AS orig_index, CASE WHEN {CLEAN} THEN 'CLEAN' ELSE 'QUARANTINE' END AS bucket, file_name, product,
       CASE WHEN {CLEAN} THEN NULL ELSE {REASON_CASE} END AS quarantine_reason FROM pt""",
    "quarantine_breakdown": W + f"""
SELECT {NOTE_CASE} AS notes, CAST(count(*) AS BIGINT) AS n FROM pt WHERE NOT ({CLEAN}) GROUP BY 1""",
    "clean_subkeys": W + f"""
SELECT CAST(k AS BIGINT) AS orig_index, 'GWP-TOTAL' AS indicator, s.subkey
FROM pt CROSS JOIN (VALUES ('A1'), ('A2'), ('A3'), ('A1-A3'), ('Unit')) s(subkey)
WHERE {CLEAN} AND (variant <> 'bre' OR s.subkey IN ('A1', 'A1-A3', 'Unit'))
UNION ALL
SELECT CAST(k AS BIGINT), 'FRESH WATER', s.subkey
FROM pt CROSS JOIN (VALUES ('A1-A3'), ('Unit')) s(subkey) WHERE {CLEAN}""",
    "bre_agg_records": W + """
SELECT CAST(k AS BIGINT) AS orig_index, file_name, gwp_json AS gwp_total, '{}' AS pert, '{}' AS penrt,
       fw_json AS fresh_water, '{}' AS acidification, '{}' AS eutrofication
FROM gj WHERE variant = 'bre'""",
    "record_listing": W + """
SELECT CAST(k AS BIGINT) AS orig_index, file_name, substr(gwp_json, 1, 70) AS gwp_preview FROM gj""",
    "record_file_names": W + """
SELECT DISTINCT file_name FROM pf""",
    "contamination": W + """
SELECT CAST(k AS BIGINT) AS orig_index, CAST(2 AS BIGINT) AS n_bad_keys FROM pf WHERE contaminated""",
    "fill_ratio": W + """,
c AS (
  SELECT k, CASE WHEN variant = 'bre' THEN 8 ELSE 11 END + CASE WHEN contaminated THEN 2 ELSE 0 END AS n_leaves,
            CASE WHEN variant = 'bre' THEN 8 ELSE 11 END + CASE WHEN contaminated THEN 1 ELSE 0 END AS n_populated
  FROM pf)
SELECT CAST(k AS BIGINT) AS orig_index, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(n_populated AS BIGINT) AS n_populated,
       CAST(n_populated AS DOUBLE) / CAST(n_leaves AS DOUBLE) AS fill_ratio,
       CAST(n_populated AS DOUBLE) / CAST(n_leaves AS DOUBLE) < 0.25 AS near_empty
FROM c""",
    "multi_product": W + """
SELECT file_name, CAST(count(*) AS BIGINT) AS n_records, CAST(count(DISTINCT product) AS BIGINT) AS n_products
FROM pf GROUP BY file_name HAVING count(DISTINCT product) > 1""",
    "operator_rollup": W + """
SELECT upper(trim(operator)) AS operator, CAST(count(*) AS BIGINT) AS n FROM pf GROUP BY 1""",
    "standard_version": W + """
SELECT CASE WHEN a2std THEN 'A2' ELSE 'A1' END AS version, CAST(count(*) AS BIGINT) AS n FROM pf GROUP BY 1""",
    "sum_consistency": W + """
SELECT CAST(k AS BIGINT) AS orig_index, 'GWP-TOTAL' AS indicator,
  CASE WHEN spaced THEN 'unparseable' WHEN variant = 'bre' THEN 'incomplete'
       WHEN abs(((CAST(a1 AS DOUBLE) + CAST(a2 AS DOUBLE)) + CAST(a3 AS DOUBLE)) - CAST(a1a3 AS DOUBLE))
            <= CAST(1e-4 AS DOUBLE) + CAST(1e-3 AS DOUBLE) * abs(CAST(a1a3 AS DOUBLE)) THEN 'consistent'
       ELSE 'inconsistent' END AS status
FROM pt UNION ALL SELECT CAST(k AS BIGINT), 'FRESH WATER', 'incomplete' FROM pt""",
    "sci_notation": W + f""",
vals AS (
  SELECT 'GWP-TOTAL' AS indicator, s.stage, CASE WHEN s.stage = 'A1' AND variant = 'bre' THEN 'aggregated'
           WHEN s.stage = 'A1-A3' AND spaced THEN 'spaced_exponent' ELSE 'clean' END AS class
  FROM pt, (VALUES ('A1'), ('A2'), ('A3'), ('A1-A3')) s(stage) WHERE variant <> 'bre' OR s.stage IN ('A1', 'A1-A3')
  UNION ALL SELECT 'FRESH WATER', 'A1-A3', 'clean' FROM pt),
grid AS (SELECT i.indicator, s.stage FROM (VALUES {", ".join(f"('{x}')" for x in INDICATORS_12)}) i(indicator),
                (VALUES {", ".join(f"('{x}')" for x in STAGES_21)}) s(stage))
SELECT g.indicator, g.stage, {", ".join(f"CAST(count(*) FILTER (class = '{c}') AS BIGINT) AS n_{c}" for c in NOTATIONS)},
       CAST((SELECT count(*) FROM part) - count(class) AS BIGINT) AS n_missing
FROM grid g LEFT JOIN vals v ON v.indicator = g.indicator AND v.stage = g.stage GROUP BY g.indicator, g.stage""",
}
