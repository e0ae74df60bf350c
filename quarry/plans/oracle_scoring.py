"""DuckDB oracle SQL for the scoring group.

Written in long form (one row per leaf, no JSON), independently of the Spark
path which parses nested JSON bodies: the two agree only if the record
reshaping, the matchers and the F1 arithmetic agree.
"""

# Fixture leaves: gold text, predicted text (or MISSING) and the fixture facts.
SCORING_LEAVES_CTE = r"""
li AS (
  SELECT l_orderkey AS k, l_linenumber AS line,
         max(l_quantity) AS x1, max(l_extendedprice) AS x2, max(l_discount) AS x3, max(l_tax) AS x4
  FROM lineitem GROUP BY l_orderkey, l_linenumber),
fl AS (SELECT l_orderkey AS k, list_sort(list(DISTINCT l_returnflag)) AS flags
       FROM lineitem GROUP BY l_orderkey),
ord AS (
  SELECT o.o_orderkey AS k, o.o_orderstatus AS status, o.o_orderpriority AS priority,
         coalesce(fl.flags, []::VARCHAR[]) AS flags,
         'ORD-' || lpad(CAST(o.o_orderkey AS VARCHAR), 6, '0') || '.pdf' AS file_name,
         (o.o_orderkey % 50 <> 0) AS has_pred
  FROM orders o LEFT JOIN fl ON fl.k = o.o_orderkey),
meas AS (SELECT * FROM (VALUES (1, 'QTY', 'pcs'), (2, 'PRICE', 'USD'),
                               (3, 'DISC', 'fraction'), (4, 'TAX', 'fraction')) t(mi, measure, unit)),
cell AS (
  SELECT o.k, o.file_name, o.has_pred, m.mi, m.measure, s.line,
         CASE m.mi WHEN 1 THEN li.x1 WHEN 2 THEN li.x2 WHEN 3 THEN li.x3 ELSE li.x4 END AS x
  FROM ord o CROSS JOIN meas m CROSS JOIN (SELECT range AS line FROM range(1, 8)) s
  LEFT JOIN li ON li.k = o.k AND li.line = s.line),
raw_leaf AS (
  SELECT k, file_name, has_pred, measure || '.L' || CAST(line AS VARCHAR) AS field,
         'lca_numeric' AS category,
         CASE WHEN x IS NULL THEN 'N/A' ELSE CAST(CAST(x AS DECIMAL(18,4)) AS VARCHAR) END AS gold_value,
         CASE (k * 31 + (mi * 10 + line) * 7) % 10
           WHEN 0 THEN 'MISSING'
           WHEN 1 THEN CASE WHEN x IS NULL THEN 'N/A'
                ELSE CAST(CAST(x AS DECIMAL(18,4)) * CAST('1.05' AS DECIMAL(3,2)) AS VARCHAR) END
           WHEN 2 THEN CASE WHEN x IS NULL THEN 'N/A'
                ELSE CAST(CAST(x AS DECIMAL(18,4)) * CAST('1.005' AS DECIMAL(4,3)) AS VARCHAR) END
           WHEN 3 THEN 'N/A'
           ELSE CASE WHEN x IS NULL THEN 'N/A' ELSE CAST(CAST(x AS DECIMAL(18,4)) AS VARCHAR) END
         END AS pred_value,
         0 AS n_flags, -1 AS h
  FROM cell
  UNION ALL
  SELECT o.k, o.file_name, o.has_pred, m.measure || '.Unit', 'lca_unit', m.unit,
         CASE (o.k * 31 + (m.mi * 10 + 8) * 7) % 10 WHEN 0 THEN 'MISSING' WHEN 1 THEN m.unit || '-x'
              WHEN 2 THEN ' ' || upper(m.unit) || ' ' WHEN 3 THEN 'N/A' ELSE m.unit END,
         0, (o.k * 31 + (m.mi * 10 + 8) * 7) % 10
  FROM ord o CROSS JOIN meas m
  UNION ALL
  SELECT k, file_name, has_pred, 'Order Status', 'metadata', status,
         CASE (k * 31 + 7) % 10 WHEN 0 THEN 'MISSING' WHEN 1 THEN status || '-x'
              WHEN 2 THEN ' ' || upper(status) || ' ' WHEN 3 THEN 'N/A' ELSE status END, 0, -1
  FROM ord
  UNION ALL
  SELECT k, file_name, has_pred, 'Order Priority', 'metadata', priority,
         CASE (k * 31 + 14) % 10 WHEN 0 THEN 'MISSING' WHEN 1 THEN priority || '-x'
              WHEN 2 THEN ' ' || upper(priority) || ' ' WHEN 3 THEN 'N/A' ELSE priority END, 0, -1
  FROM ord
  UNION ALL
  SELECT k, file_name, has_pred, 'Return Flags', 'list', CAST(to_json(flags) AS VARCHAR),
         CASE (k * 31 + 21) % 10 WHEN 0 THEN '[]'
              WHEN 1 THEN CAST(to_json(list_concat(flags, ['Z'])) AS VARCHAR)
              WHEN 2 THEN CAST(to_json(list_transform(flags, lambda f: lower(f))) AS VARCHAR)
              WHEN 3 THEN '["N/A"]'
              ELSE CAST(to_json(flags) AS VARCHAR) END,
         len(flags), (k * 31 + 21) % 10
  FROM ord),
num AS (
  SELECT *,
    CASE WHEN has_pred THEN pred_value WHEN category = 'list' THEN '[]' ELSE 'MISSING' END AS pv,
    CASE WHEN has_pred THEN h ELSE 0 END AS hp
  FROM raw_leaf),
parsed AS (
  SELECT *,
    CASE WHEN regexp_full_match(trim(gold_value), '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?')
         THEN CAST(trim(gold_value) AS DOUBLE) END AS g,
    CASE WHEN regexp_full_match(trim(pv), '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?')
         THEN CAST(trim(pv) AS DOUBLE) END AS p,
    CAST(n_flags AS DOUBLE) / CAST(n_flags + 1 AS DOUBLE) AS prec_extra
  FROM num),
leaf AS (
  SELECT k AS orig_index, file_name, field, category, gold_value, pv AS pred_value,
    CASE WHEN category = 'list' THEN n_flags = 0 ELSE upper(trim(gold_value)) = 'N/A' END AS gold_is_na,
    CASE
      WHEN category = 'list' THEN
        CASE WHEN hp = 0 THEN CASE WHEN n_flags = 0 THEN 1.0 ELSE 0.0 END
             WHEN hp = 1 THEN CASE WHEN n_flags = 0 THEN 0.0
                  ELSE (CAST(2.0 AS DOUBLE) * prec_extra * CAST(1.0 AS DOUBLE)) / (prec_extra + CAST(1.0 AS DOUBLE)) END
             WHEN hp = 3 THEN 0.0
             ELSE 1.0 END
      WHEN category = 'lca_numeric' AND g IS NOT NULL AND p IS NOT NULL THEN
        CASE WHEN abs(p - g) <= CAST(1e-4 AS DOUBLE) + CAST(0.01 AS DOUBLE) * abs(g) THEN 1.0 ELSE 0.0 END
      ELSE CASE WHEN lower(trim(pv)) = lower(trim(gold_value)) THEN 1.0 ELSE 0.0 END
    END AS match
  FROM parsed),
validity AS (
  SELECT orig_index, bool_and(category <> 'lca_unit' OR pred_value <> 'MISSING') AS schema_valid,
         bool_or(pred_value <> 'MISSING' AND pred_value <> '[]') AS any_pred
  FROM leaf GROUP BY orig_index)
"""


def _slice(name: str, cond: str) -> str:
    n1 = f"count_if(({cond}) AND match = 1.0)"
    n0 = f"count_if(({cond}) AND match = 0.0)"
    fs = f"coalesce(sum(CASE WHEN ({cond}) AND match > 0 AND match < 1 THEN match END), 0.0)"
    fc = f"coalesce(sum(CASE WHEN ({cond}) AND match > 0 AND match < 1 THEN 1.0 - match END), 0.0)"
    tp = f"(CAST({n1} AS DOUBLE) + {fs})"
    fp = f"(CAST({n0} AS DOUBLE) + {fc})"
    p = f"(CASE WHEN {tp} + {fp} > 0 THEN {tp} / ({tp} + {fp}) ELSE 0.0 END)"
    return (f"CASE WHEN count_if({cond}) = 0 THEN CAST(0.0 AS DOUBLE) WHEN {p} + {p} = 0 THEN CAST(0.0 AS DOUBLE) "
            f"ELSE (CAST(2.0 AS DOUBLE) * {p} * {p}) / ({p} + {p}) END AS f1_{name}")


SLICE_CONDS = (
    ("overall", "TRUE"),
    ("populated", "NOT gold_is_na"),
    ("na", "gold_is_na"),
    ("metadata", "category = 'metadata'"),
    ("lca", "category IN ('lca_numeric', 'lca_unit')"),
    ("list", "category = 'list'"),
)

SCORE_RECORDS_CTE = SCORING_LEAVES_CTE + r""",
record_scores AS (
  SELECT l.orig_index, l.file_name, v.schema_valid AND (l.orig_index % 50 <> 0) AS schema_valid,
         (l.orig_index % 50 <> 0) AS has_prediction,
         CAST(count(*) AS BIGINT) AS n_fields,
         """ + ",\n         ".join(_slice(n, c) for n, c in SLICE_CONDS) + r"""
  FROM leaf l JOIN validity v USING (orig_index)
  GROUP BY l.orig_index, l.file_name, v.schema_valid)
"""

SQL = {
    "score_leaves": "WITH " + SCORING_LEAVES_CTE + """
SELECT CAST(orig_index AS BIGINT) AS orig_index, file_name, field, category, gold_value, pred_value,
       gold_is_na, CAST(match AS DOUBLE) AS match FROM leaf""",
    "score_records": "WITH " + SCORE_RECORDS_CTE + """
SELECT CAST(orig_index AS BIGINT) AS orig_index, file_name, schema_valid, has_prediction, n_fields,
       f1_overall, f1_populated, f1_na, f1_metadata, f1_lca, f1_list FROM record_scores""",
    "score_summary": "WITH " + SCORE_RECORDS_CTE + """
SELECT 'fixture-model' AS model, CAST(count(*) AS BIGINT) AS n_records,
       CAST(sum(CAST(f1_overall AS DECIMAL(38,15))) AS DOUBLE) / CAST(count(f1_overall) AS DOUBLE) AS f1_overall, CAST(sum(CAST(f1_populated AS DECIMAL(38,15))) AS DOUBLE) / CAST(count(f1_populated) AS DOUBLE) AS f1_populated, CAST(sum(CAST(f1_na AS DECIMAL(38,15))) AS DOUBLE) / CAST(count(f1_na) AS DOUBLE) AS f1_na,
       CAST(sum(CAST(f1_metadata AS DECIMAL(38,15))) AS DOUBLE) / CAST(count(f1_metadata) AS DOUBLE) AS f1_metadata, CAST(sum(CAST(f1_lca AS DECIMAL(38,15))) AS DOUBLE) / CAST(count(f1_lca) AS DOUBLE) AS f1_lca,
       CAST(count_if(schema_valid) AS DOUBLE) * CAST(100.0 AS DOUBLE) / CAST(count(*) AS DOUBLE) AS schema_valid_pct,
       CAST(0.0 AS DOUBLE) AS cost_usd_total, CAST(0.0 AS DOUBLE) AS cost_usd_per_record,
       CAST(0.0 AS DOUBLE) AS latency_s_total, CAST(0.0 AS DOUBLE) AS latency_s_per_record
FROM record_scores""",
    "score_report": "WITH " + SCORE_RECORDS_CTE + """
SELECT 'record' AS row_kind, file_name AS label, CAST(orig_index AS BIGINT) AS orig_index,
       f1_overall, f1_populated, f1_na, f1_metadata, f1_lca,
       CASE WHEN schema_valid THEN 'yes' ELSE 'no' END AS schema_ok
FROM record_scores
UNION ALL
SELECT 'average', 'AVERAGE', CAST(-1 AS BIGINT), CAST(sum(CAST(f1_overall AS DECIMAL(38,15))) AS DOUBLE) / CAST(count(f1_overall) AS DOUBLE), CAST(sum(CAST(f1_populated AS DECIMAL(38,15))) AS DOUBLE) / CAST(count(f1_populated) AS DOUBLE), CAST(sum(CAST(f1_na AS DECIMAL(38,15))) AS DOUBLE) / CAST(count(f1_na) AS DOUBLE),
       CAST(sum(CAST(f1_metadata AS DECIMAL(38,15))) AS DOUBLE) / CAST(count(f1_metadata) AS DOUBLE), CAST(sum(CAST(f1_lca AS DECIMAL(38,15))) AS DOUBLE) / CAST(count(f1_lca) AS DOUBLE),
       CAST(count_if(schema_valid) AS VARCHAR) || '/' || CAST(count(*) AS VARCHAR)
FROM record_scores""",
    "unmatched_predictions": """
SELECT 'XTRA-' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') || '.pdf' AS file_name
FROM orders WHERE o_orderkey % 45 = 0""",
    "attempted_summary": "WITH " + SCORE_RECORDS_CTE + """
SELECT CAST(count(*) AS BIGINT) AS n_records,
       """ + ",\n       ".join(f"CAST(sum(CAST(f1_{s} AS DECIMAL(38,15))) AS DOUBLE) / CAST(count(f1_{s}) AS DOUBLE) AS f1_{s}"
                               for s in ("overall", "populated", "na", "metadata", "lca", "list")) + """
FROM record_scores WHERE has_prediction""",
}
