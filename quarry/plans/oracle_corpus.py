"""DuckDB oracle SQL for the corpus group (documents as a converted corpus)."""

STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"

# a profile of hashed trigrams per language, from all labelled documents
LANGUAGES = r"""
lt AS (
  SELECT doc_id, lang, string_split(' ' || trim(regexp_replace(lower(text), '[^\p{L}]+', ' ', 'g')) || ' ', '') AS c
  FROM documents WHERE text IS NOT NULL),
lg AS (
  SELECT doc_id, lang, unnest(list_transform(range(1, len(c) - 1),
           lambda i: (unicode(c[i]) * 5003 + unicode(c[i + 1]) * 2711 + unicode(c[i + 2]) * 17) % 8192)) AS b
  FROM lt WHERE len(c) > 2),
lc AS (SELECT lang, b, count(*) AS n FROM lg WHERE lang IS NOT NULL GROUP BY lang, b),
lp AS (
  SELECT t.lang, a.b, CAST(round(1000000 * ln(CAST(coalesce(n, 0) + 1 AS DOUBLE) / CAST(total + 8192 AS DOUBLE))) AS BIGINT) AS s
  FROM (SELECT lang, sum(n) AS total FROM lc GROUP BY lang) t CROSS JOIN (SELECT unnest(range(8192)) AS b) a
  LEFT JOIN lc ON lc.lang = t.lang AND lc.b = a.b),
detected AS (
  SELECT doc_id, arg_max(lang, (score, lang)) AS detected
  FROM (SELECT doc_id, lp.lang, sum(k * s) AS score
        FROM (SELECT doc_id, b, count(*) AS k FROM lg GROUP BY doc_id, b) JOIN lp USING (b) GROUP BY doc_id, lp.lang)
  GROUP BY doc_id),
"""

DOCS = LANGUAGES + r"""
df AS (
  SELECT doc_id, text, coalesce(detected, 'unknown') AS lang, n_chars,
    'DOC-' || lpad(CAST(doc_id AS VARCHAR), 6, '0') || '.pdf' AS filename,
    doc_id % 97 <> 0 AS read_ok, doc_id % 23 <> 0 AS success
  FROM documents LEFT JOIN detected USING (doc_id)),
pr0 AS (
  SELECT doc_id, filename, success AS docling_success,
    CAST(CASE WHEN read_ok THEN greatest(1, CAST(ceil(n_chars / 1800) AS BIGINT)) ELSE 0 END AS INTEGER) AS page_count,
    CAST(CASE WHEN read_ok THEN length(text) ELSE 0 END AS INTEGER) AS text_length,
    read_ok AND doc_id % 3 = 0 AS tagged,
    CASE WHEN NOT read_ok THEN 'unknown'
         WHEN length(regexp_replace(text, '^\s+|\s+$', '', 'g')) > 50 THEN lang
         ELSE 'insufficient_text' END AS language,
    CAST(CASE WHEN success THEN n_chars % 9 ELSE 0 END AS INTEGER) AS table_count,
    CASE WHEN read_ok THEN '' ELSE 'cannot open broken document' END AS pymupdf_error,
    CASE WHEN success THEN '' ELSE 'Pipeline StandardPdfPipeline failed' END AS docling_error,
    read_ok
  FROM df),
pr AS (
  SELECT *, CAST(text_length AS DOUBLE) / CAST(greatest(page_count, 1) AS DOUBLE) AS chars_per_page,
    CASE WHEN NOT read_ok THEN 'unknown'
         WHEN CAST(text_length AS DOUBLE) / CAST(greatest(page_count, 1) AS DOUBLE) >= 80 THEN 'native'
         ELSE 'scanned' END AS native_vs_scanned
  FROM pr0),
prof AS (
  SELECT *,
    CASE WHEN native_vs_scanned = 'scanned' OR NOT docling_success OR page_count > 15 THEN 'Hard'
         WHEN language NOT IN ('en', 'unknown', 'insufficient_text') THEN 'Hard'
         WHEN page_count > 8 OR table_count > 4 THEN 'Medium' ELSE 'Simple' END AS complexity_tier
  FROM pr)
"""

GOLD_NAMES = r"""
lab AS (SELECT doc_id, 'DOC-' || lpad(CAST(doc_id AS VARCHAR), 6, '0') || '.pdf' AS fn FROM labels),
g AS (
  SELECT CASE doc_id % 4 WHEN 0 THEN fn WHEN 1 THEN lower(fn) WHEN 2 THEN replace(fn, '-', ' - ') END AS gold_name
  FROM lab WHERE doc_id % 4 <> 3),
matched AS (
  SELECT p.filename,
    coalesce(max(CASE WHEN g.gold_name = p.filename THEN g.gold_name END), min(g.gold_name), '') AS gold_standard_match
  FROM prof p LEFT JOIN g
    ON lower(replace(replace(replace(g.gold_name, ':', ''), '/', ''), ' ', ''))
     = lower(replace(replace(replace(p.filename, ':', ''), '/', ''), ' ', ''))
  GROUP BY p.filename)
"""

SIDECARS = r"""
side AS (
  SELECT CASE WHEN doc_id % 2 = 0 THEN 'DOC-' || lpad(CAST(doc_id AS VARCHAR), 6, '0') ELSE CAST(doc_id AS VARCHAR) END AS stem,
         doc_id % 23 <> 0 AS success,
         CASE WHEN doc_id % 23 <> 0 THEN '' ELSE 'Pipeline StandardPdfPipeline failed' END AS error
  FROM documents),
rg AS (
  SELECT CASE doc_id % 3
           WHEN 0 THEN 'DOC-' || lpad(CAST(doc_id AS VARCHAR), 6, '0') || '.pdf'
           WHEN 1 THEN 'DOC-' || substr(lpad(CAST(doc_id AS VARCHAR), 6, '0'), 1, 3) || ':'
                        || substr(lpad(CAST(doc_id AS VARCHAR), 6, '0'), 4, 3) || '.pdf'
           ELSE lpad(CAST(doc_id AS VARCHAR), 6, '0') || '.pdf' END AS gold_name
  FROM labels),
rs AS (SELECT DISTINCT gold_name, regexp_replace(gold_name, '\.[^.]+$', '') AS stem FROM rg),
cand AS (
  SELECT gold_name, 1 AS pos, stem FROM rs
  UNION ALL SELECT gold_name, 2, replace(stem, ':', '') FROM rs
  UNION ALL SELECT gold_name, 3, coalesce(nullif(ltrim(stem, '0'), ''), '0') FROM rs),
hit AS (
  SELECT c.gold_name, arg_min(c.stem, c.pos) AS resolved_stem
  FROM cand c JOIN (SELECT DISTINCT stem FROM side) s ON s.stem = c.stem GROUP BY c.gold_name),
resolved AS (SELECT rs.gold_name, hit.resolved_stem FROM (SELECT DISTINCT gold_name FROM rs) rs
             LEFT JOIN hit USING (gold_name))
"""

W = "WITH " + DOCS

SQL = {
    "doc_profile": W + """
SELECT filename, page_count, text_length, chars_per_page, native_vs_scanned, tagged, language,
       docling_success, table_count, pymupdf_error, docling_error, complexity_tier FROM prof""",
    "audit_csv": W + "," + GOLD_NAMES + """
SELECT p.filename, page_count, text_length, chars_per_page, native_vs_scanned, tagged, language, docling_success, table_count,
       CAST(CASE WHEN docling_success THEN d.n_chars % 9 * 10 ELSE 0 END AS INTEGER) AS docling_table_text_len,
       CAST(CASE WHEN docling_success THEN length(d.text) ELSE 0 END AS INTEGER) AS docling_text_len,
       d.n_chars / CAST(1024 AS DOUBLE) AS docling_seconds, complexity_tier,
       nullif(m.gold_standard_match, '') AS gold_standard_match, nullif(pymupdf_error, '') AS pymupdf_error,
       nullif(docling_error, '') AS docling_error
FROM prof p JOIN documents d USING (doc_id) JOIN matched m ON m.filename = p.filename""",
    "language_detect": "WITH " + LANGUAGES.rstrip().rstrip(",") + """
SELECT doc_id, lang, detected FROM documents LEFT JOIN detected USING (doc_id)""",
    "corpus_summary": W + """
SELECT CAST(count(*) AS BIGINT) AS n_total,
       CAST(count(*) - count_if(native_vs_scanned = 'scanned') AS BIGINT) AS n_native,
       CAST(count_if(native_vs_scanned = 'scanned') AS BIGINT) AS n_scanned,
       CAST(count_if(tagged) AS BIGINT) AS n_tagged,
       CAST(count_if(language NOT IN ('en', 'unknown', 'insufficient_text')) AS BIGINT) AS n_non_english,
       CAST(count_if(NOT docling_success) AS BIGINT) AS n_docling_failed,
       CAST(count_if(complexity_tier = 'Simple') AS BIGINT) AS n_simple,
       CAST(count_if(complexity_tier = 'Medium') AS BIGINT) AS n_medium,
       CAST(count_if(complexity_tier = 'Hard') AS BIGINT) AS n_hard
FROM prof""",
    "tier_listing": W + """
SELECT complexity_tier, filename, page_count, table_count, docling_success, language FROM prof""",
    "gold_name_match": W + "," + GOLD_NAMES + """
SELECT filename, gold_standard_match FROM matched""",
    "match_counts": W + "," + GOLD_NAMES + """
SELECT CAST(count_if(gold_standard_match <> '') AS BIGINT) AS n_matched,
       CAST(count_if(gold_standard_match = '') AS BIGINT) AS n_unmatched FROM matched""",
    "sidecar_resolve": "WITH " + SIDECARS + """
SELECT gold_name, resolved_stem FROM resolved""",
    "usable_sidecars": "WITH " + SIDECARS + """
SELECT r.gold_name, r.resolved_stem,
  CASE WHEN r.resolved_stem IS NULL THEN 'no_sidecar' WHEN NOT s.success THEN 'failed_sidecar' ELSE 'usable' END AS status,
  CASE WHEN r.resolved_stem IS NULL THEN 'PDF missing or not preprocessed'
       WHEN NOT s.success THEN 'success=False: ' || substr(s.error, 1, 80) END AS reason, s.error
FROM resolved r LEFT JOIN side s ON s.stem = r.resolved_stem""",
    "resume_remaining": """
SELECT 'DOC-' || lpad(CAST(doc_id AS VARCHAR), 6, '0') || '.pdf' AS filename FROM documents WHERE doc_id % 4 <> 0""",
    "run_outcomes": """
SELECT CAST(count_if(doc_id % 23 <> 0) AS BIGINT) AS n_ok, CAST(count_if(doc_id % 23 = 0) AS BIGINT) AS n_failed
FROM documents""",
    "page_stats": """
SELECT doc_id, CAST(greatest(1, ceil(length(text) / 1800)) AS INTEGER) AS n_pages,
       CAST(length(text) AS INTEGER) AS text_length,
       CAST(length(text) AS DOUBLE) / CAST(greatest(1, ceil(length(text) / 1800)) AS DOUBLE) AS chars_per_page
FROM documents""",
    "silent_failures": """
SELECT doc_id, CAST(length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS INTEGER) AS stripped_len FROM documents
WHERE length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) < 100""",
    "doc_routing": W + """
SELECT CASE WHEN native_vs_scanned = 'scanned' THEN 'vision'
            WHEN complexity_tier IN ('Hard', 'Medium') THEN 'layout' ELSE 'text' END AS route,
       CAST(count(*) AS BIGINT) AS n FROM prof GROUP BY 1""",
    "stratified_sample": W + """,
ranked AS (
  SELECT complexity_tier, filename,
    row_number() OVER (PARTITION BY complexity_tier ORDER BY (doc_id * 2654435761) % 4294967296, doc_id) AS rank
  FROM prof)
SELECT complexity_tier, filename, CAST(rank AS BIGINT) AS rank FROM ranked WHERE rank <= 5""",
}
