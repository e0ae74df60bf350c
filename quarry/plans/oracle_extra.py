"""DuckDB oracle SQL for divergence, strict tolerance, described prompts, ST3."""

from quarry.plans import oracle_scoring as OS
from quarry.plans.oracle_prompts import PROMPT_SUFFIX, RESPONSES, lit, prompt_prefix

DESCRIPTIONS = {"Order Status": "single-letter order state", "Order Priority": "priority class",
                "Return Flags": "list of return flags"}
FIELDS = ("Order Status", "Order Priority", "Return Flags")
BLOCK = "{\n" + "\n".join(f'  "{f}": "..."  // {DESCRIPTIONS[f]}' for f in FIELDS) + "\n}\n\n"
PREFIX = prompt_prefix(BLOCK)
PROMPT = f"{lit(PREFIX)} || text || {lit(PROMPT_SUFFIX)}"

STRICT = OS.SCORE_RECORDS_CTE.replace(
    "abs(p - g) <= CAST(1e-4 AS DOUBLE) + CAST(0.01 AS DOUBLE) * abs(g)",
    "(abs(p - g) <= CAST(0.01 AS DOUBLE) * abs(g) OR abs(p - g) <= CAST(0.001 AS DOUBLE))")
assert STRICT != OS.SCORE_RECORDS_CTE

SQL = {
    "score_summary_strict": "WITH " + STRICT + """
SELECT 'fixture-model-strict' AS model, CAST(count(*) AS BIGINT) AS n_records,
       CAST(sum(CAST(f1_overall AS DECIMAL(38,15))) AS DOUBLE) / CAST(count(f1_overall) AS DOUBLE) AS f1_overall, CAST(sum(CAST(f1_populated AS DECIMAL(38,15))) AS DOUBLE) / CAST(count(f1_populated) AS DOUBLE) AS f1_populated, CAST(sum(CAST(f1_na AS DECIMAL(38,15))) AS DOUBLE) / CAST(count(f1_na) AS DOUBLE) AS f1_na,
       CAST(sum(CAST(f1_metadata AS DECIMAL(38,15))) AS DOUBLE) / CAST(count(f1_metadata) AS DOUBLE) AS f1_metadata, CAST(sum(CAST(f1_lca AS DECIMAL(38,15))) AS DOUBLE) / CAST(count(f1_lca) AS DOUBLE) AS f1_lca,
       CAST(count_if(schema_valid) AS DOUBLE) * CAST(100.0 AS DOUBLE) / CAST(count(*) AS DOUBLE) AS schema_valid_pct,
       CAST(0.0 AS DOUBLE) AS cost_usd_total, CAST(0.0 AS DOUBLE) AS cost_usd_per_record,
       CAST(0.0 AS DOUBLE) AS latency_s_total, CAST(0.0 AS DOUBLE) AS latency_s_per_record
FROM record_scores""",
    "pass_divergence": "WITH " + OS.SCORING_LEAVES_CTE + """,
present AS (
  SELECT k, file_name, field, pred_value
  FROM raw_leaf
  WHERE has_pred AND k % 40 = 0 AND CASE WHEN category = 'list' THEN h <> 0 ELSE pred_value <> 'MISSING' END),
agg AS (
  SELECT o.o_orderkey AS k, 'ORD-' || lpad(CAST(o.o_orderkey AS VARCHAR), 6, '0') || '.pdf' AS file_name,
         count(p.field) AS n_last,
         count_if(p.field = 'Order Status') AS has_status,
         count_if(p.field = 'Order Status' AND p.pred_value = 'N/A') AS status_same
  FROM orders o LEFT JOIN present p ON p.k = o.o_orderkey
  WHERE o.o_orderkey % 40 = 0 AND o.o_orderkey % 50 <> 0
  GROUP BY o.o_orderkey)
SELECT file_name, CAST(2 AS BIGINT) AS pass, CAST(n_last + 1 - has_status AS BIGINT) AS n_paths,
       CAST(n_last + 1 - has_status - status_same AS BIGINT) AS n_diff,
       CAST(n_last + 1 - has_status - status_same AS DOUBLE) / CAST(n_last + 1 - has_status AS DOUBLE) AS divergence
FROM agg""",
    "described_prompts": f"""
SELECT doc_id, CAST(length({PROMPT}) AS INTEGER) AS prompt_chars, sha256({PROMPT}) AS prompt_sha FROM documents""",
    "exact_duplicates": """
WITH f AS (SELECT sha256(text) AS h, min(doc_id) AS first_doc_id FROM documents GROUP BY 1)
SELECT d.doc_id, f.first_doc_id FROM documents d JOIN f ON sha256(d.text) = f.h WHERE d.doc_id <> f.first_doc_id""",
    "scores_csv": "WITH " + OS.SCORE_RECORDS_CTE + """
SELECT 'fixture-1b-zero-shot' AS model, file_name, orig_index, round(f1_overall, 4) AS f1_overall, round(f1_populated, 4) AS f1_populated,
       round(f1_na, 4) AS f1_na, round(f1_metadata, 4) AS f1_metadata, round(f1_lca, 4) AS f1_lca, schema_valid
FROM record_scores""",
    "results_json": "WITH " + RESPONSES + """
SELECT k AS o_orderkey, 'ORD-' || lpad(CAST(k AS VARCHAR), 6, '0') || '.pdf' AS file_name, rule,
       sha256(parsed) AS parsed_sha, sha256(raw_text) AS raw_sha FROM p""",
    "sidecar_files": """
SELECT 'DOC-' || lpad(CAST(doc_id AS VARCHAR), 6, '0') || '.pdf' AS filename, lang, doc_id % 23 <> 0 AS success,
       CAST(CASE WHEN doc_id % 97 <> 0 THEN greatest(1, ceil(n_chars / 1800)) ELSE 0 END AS INTEGER) AS page_count,
       n_chars / CAST(1024 AS DOUBLE) AS processing_time_s, CAST(length(text) AS INTEGER) AS text_length,
       CASE WHEN doc_id % 23 <> 0 THEN '' ELSE 'Pipeline StandardPdfPipeline failed' END AS error
FROM documents WHERE lang IN ('de', 'en')""",
    "document_listing": """
SELECT lang, CAST(count(*) AS BIGINT) AS n_documents, true AS listed FROM documents GROUP BY lang""",
    "vector_search": """
WITH e AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * v))) AS size FROM embeddings),
s AS (SELECT q.vec_id AS query, r.vec_id AS id,
             round(list_sum(list_transform(list_zip(q.embedding, r.embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))
                   / (q.size * r.size), 12) AS score
      FROM e q JOIN e r ON r.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s)
SELECT query, id, score, rank FROM o WHERE rank <= 5""",
    "incremental_summary": """
SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value_total
FROM events GROUP BY event_type""",
}
