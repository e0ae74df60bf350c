"""DuckDB oracle SQL for cleaning, chunking, retrieval and leaf analyses."""

from quarry.plans.oracle_prompts import PROMPT_DOC, PROMPT_HEAD, PROMPT_STAGE_NOTE, PROMPT_STAGES, PROMPT_SUFFIX, STAGES, lit
from quarry.plans.oracle_scoring import SCORING_LEAVES_CTE

NL = "chr(10)"
STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
CLEAN = STRIP.format(x="regexp_replace(regexp_replace(src, '\\n{3,}', chr(10) || chr(10), 'g'), "
                       "'Page \\d+ of \\d+', '', 'g')")

GROUP_TERMS = {"Order Status": "state of the order", "Order Priority": "priority class", "Return Flags": "list of return flags",
               "QTY": "number of pieces", "PRICE": "price to be paid", "DISC": "what is taken from the price", "TAX": "tax for the sale"}
GROUPS = {"fields-1": ("Order Status", "Order Priority"), "fields-2": ("Return Flags",),
          "indicators-1": ("DISC", "PRICE"), "indicators-2": ("QTY", "TAX")}


def _block(fields: tuple[str, ...]) -> str:
    return "{\n" + "\n".join(f'  "{f}": "..."' for f in fields) + "\n}\n\n"


def _group_head(name: str, members: tuple[str, ...]) -> str:
    if name.startswith("fields"):
        return PROMPT_HEAD + _block(members) + PROMPT_DOC
    return ("Extract these nested LCA indicator objects from the EPD passages below (" + ", ".join(members) + PROMPT_STAGES
            + STAGES + PROMPT_STAGE_NOTE + PROMPT_DOC)


def _group_row(name: str, members: tuple[str, ...]) -> str:
    terms = sorted({w for m in members for w in (m + " " + GROUP_TERMS[m]).lower().split()})
    return f"({lit(name)}, {lit(_group_head(name, members))}, [{', '.join(map(lit, terms))}])"


GROUP_ROWS = ", ".join(_group_row(*item) for item in GROUPS.items())

SQL = {
    "clean_text": f"""
WITH s AS (SELECT doc_id, replace(replace(text, chr(10), chr(10) || chr(10) || chr(10) || chr(10) || 'Page 1 of 9' || chr(10)),
                                  ', ', ', see Page 2 of 9 ') AS src
           FROM documents)
SELECT doc_id, CAST(length({CLEAN}) AS INTEGER) AS clean_chars, sha256({CLEAN}) AS clean_sha FROM s""",
    "text_chunks": """
WITH c AS (SELECT doc_id, text, unnest(range(0, length(text), 850)) AS start FROM documents WHERE length(text) > 0)
SELECT doc_id, CAST(start // 850 AS BIGINT) AS chunk_idx, CAST(start AS INTEGER) AS start,
       CAST(length(substr(text, start + 1, 1000)) AS INTEGER) AS chunk_chars,
       sha256(substr(text, start + 1, 1000)) AS chunk_sha
FROM c""",
    "page_chunks": """
WITH d AS (SELECT doc_id, text, CAST(greatest(1, ceil(length(text) / 1800)) AS INTEGER) AS n_pages FROM documents),
g AS (SELECT doc_id, text, n_pages, unnest(range(0, CAST(ceil(n_pages / 20) AS BIGINT))) AS group_idx FROM d),
r AS (SELECT doc_id, text, CAST(group_idx AS INTEGER) AS group_idx, CAST(group_idx * 20 + 1 AS INTEGER) AS first_page,
             CAST(least((group_idx + 1) * 20, n_pages) AS INTEGER) AS last_page FROM g)
SELECT doc_id, group_idx, first_page, last_page,
       CAST(length(substr(text, (first_page - 1) * 1800 + 1, (last_page - first_page + 1) * 1800)) AS INTEGER) AS chunk_chars
FROM r""",
    "retrieval_topk": """
WITH dims AS (SELECT label, vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
c AS (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS m FROM dims GROUP BY label, pos),
cent AS (SELECT label, list(m ORDER BY pos) AS centroid FROM c GROUP BY label),
s AS (SELECT e.label, e.vec_id,
        list_sum(list_transform(list_zip(e.embedding, cent.centroid), lambda z: CAST(z[1] AS DOUBLE) * z[2]))
        / (sqrt(list_sum(list_transform(e.embedding, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE))))
           * sqrt(list_sum(list_transform(cent.centroid, lambda v: v * v)))) AS score
      FROM embeddings e JOIN cent USING (label)),
r AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT label, vec_id, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 5""",
    "fuzzy_names": """
WITH p AS (SELECT p_partkey, p_name AS g,
             CASE WHEN p_partkey % 3 = 0 THEN replace(p_name, 'e', 'a') WHEN p_partkey % 3 = 1 THEN upper(p_name)
                  ELSE p_name END AS q FROM part),
t AS (SELECT *, list_distinct(string_split(lower(g), ' ')) AS tg, list_distinct(string_split(lower(q), ' ')) AS tq FROM p)
SELECT p_partkey, CAST(levenshtein(g, q) AS BIGINT) AS distance,
       1.0 - CAST(levenshtein(g, q) AS DOUBLE) / CAST(greatest(length(g), length(q)) AS DOUBLE) AS lev_sim,
       CAST(len(list_intersect(tg, tq)) AS DOUBLE) / CAST(len(list_distinct(list_concat(tg, tq))) AS DOUBLE) AS jaccard
FROM t""",
    "leaf_count": "WITH " + SCORING_LEAVES_CTE + """
SELECT orig_index, CAST(count(*) AS BIGINT) AS n_leaves FROM leaf GROUP BY orig_index""",
    "true_prf": "WITH " + SCORING_LEAVES_CTE + """,
c AS (
  SELECT category,
    CAST(count_if(pred_value NOT IN ('MISSING', '[]') AND upper(trim(pred_value)) <> 'N/A') AS BIGINT) AS n_extracted,
    CAST(count_if(pred_value NOT IN ('MISSING', '[]') AND upper(trim(pred_value)) <> 'N/A'
                  AND NOT gold_is_na AND match = 1.0) AS BIGINT) AS n_correct,
    CAST(count_if(NOT gold_is_na) AS BIGINT) AS n_gold
  FROM leaf GROUP BY category),
pr AS (SELECT *, CASE WHEN n_extracted > 0 THEN CAST(n_correct AS DOUBLE) / n_extracted ELSE 0.0 END AS precision,
              CASE WHEN n_gold > 0 THEN CAST(n_correct AS DOUBLE) / n_gold ELSE 0.0 END AS recall FROM c)
SELECT category, n_extracted, n_correct, n_gold, precision, recall,
       CASE WHEN precision + recall > 0 THEN (CAST(2.0 AS DOUBLE) * precision * recall) / (precision + recall)
            ELSE 0.0 END AS f1
FROM pr""",
    "failure_taxonomy": "WITH " + SCORING_LEAVES_CTE + """
SELECT category,
  CASE WHEN match = 1.0 THEN 'ok' WHEN pred_value IN ('MISSING', '[]') THEN 'missing'
       WHEN gold_is_na AND upper(trim(pred_value)) <> 'N/A' THEN 'hallucinated'
       WHEN NOT gold_is_na AND upper(trim(pred_value)) = 'N/A' THEN 'false_na'
       ELSE 'wrong_value' END AS error_type,
  CAST(count(*) AS BIGINT) AS n
FROM leaf GROUP BY 1, 2""",
    "unit_outliers": "WITH " + SCORING_LEAVES_CTE + """,
v AS (SELECT n.indicator, CASE WHEN n.indicator = 'QTY' AND n.orig_index % 3 = 0 THEN 'dozen' ELSE u.unit END AS unit, n.x
      FROM (SELECT orig_index, split_part(field, '.', 1) AS indicator, CAST(gold_value AS DOUBLE) AS x
            FROM leaf WHERE category = 'lca_numeric' AND gold_value <> 'N/A') n
      JOIN (SELECT DISTINCT split_part(field, '.', 1) AS indicator, gold_value AS unit FROM leaf WHERE category = 'lca_unit') u
      USING (indicator)),
med AS (SELECT indicator, unit, quantile_disc(x, 0.5) AS median FROM v GROUP BY indicator, unit),
d AS (SELECT v.indicator, v.unit, median, abs(v.x - median) AS d FROM v JOIN med USING (indicator, unit)),
mad AS (SELECT indicator, unit, median, quantile_disc(d, 0.5) AS mad FROM d GROUP BY indicator, unit, median)
SELECT m.indicator, m.unit, m.median, m.mad, CAST(count(*) FILTER (d.d > 5.0 * m.mad) AS BIGINT) AS n_outliers
FROM mad m JOIN d USING (indicator, unit) GROUP BY m.indicator, m.unit, m.median, m.mad""",
    "provenance_pages": r"""
WITH p AS (SELECT doc_id, text,
             CASE WHEN doc_id % 4 = 0 THEN 'see page ' || CAST(doc_id % 5 + 1 AS VARCHAR)
                  ELSE 'Values taken from pages ' || CAST(doc_id % 3 + 1 AS VARCHAR) || '–' || CAST(doc_id % 3 + 2 AS VARCHAR)
             END AS prov FROM documents),
r AS (SELECT doc_id, text,
        CAST(nullif(regexp_extract(prov, '(?i)pages?\s+(\d+)(?:\s*[-–]\s*(\d+))?', 1), '') AS INTEGER) AS first_page,
        nullif(regexp_extract(prov, '(?i)pages?\s+(\d+)(?:\s*[-–]\s*(\d+))?', 2), '') AS last_txt FROM p)
SELECT doc_id, first_page, coalesce(CAST(last_txt AS INTEGER), first_page) AS last_page,
       CAST(length(substr(text, (first_page - 1) * 1800 + 1,
                          (coalesce(CAST(last_txt AS INTEGER), first_page) - first_page + 1) * 1800)) AS INTEGER) AS chunk_chars
FROM r""",
    "train_eval_split": """
SELECT conv_id, turn, CASE WHEN conv_id % 100 < 80 THEN 'train' ELSE 'eval' END AS split, role,
       CAST(length(text) AS INTEGER) AS n_chars FROM conversations""",
    "schema_chunked_prompts": f"""
WITH groups(field_group, head, terms) AS (VALUES {GROUP_ROWS}),
chunks AS (SELECT doc_id, CAST(start // 850 AS BIGINT) AS chunk_idx, substr(text, start + 1, 1000) AS chunk
           FROM (SELECT doc_id, text, unnest(range(0, length(text), 850)) AS start FROM documents WHERE length(text) > 0)),
postings AS (SELECT doc_id, chunk_idx, term, count(*) AS tf
             FROM (SELECT doc_id, chunk_idx, unnest(regexp_extract_all(lower(chunk), '[a-z0-9]+')) AS term FROM chunks)
             GROUP BY doc_id, chunk_idx, term),
scored AS (SELECT doc_id, field_group, chunk_idx, row_number() OVER (PARTITION BY doc_id, field_group
                    ORDER BY count(*) DESC, sum(tf) DESC, chunk_idx) AS place
           FROM postings p JOIN (SELECT field_group, unnest(terms) AS term FROM groups) g USING (term)
           GROUP BY doc_id, field_group, chunk_idx),
shown AS (SELECT s.doc_id, s.field_group, count(*) AS n, string_agg(chunk, chr(10) || '...' || chr(10) ORDER BY s.chunk_idx) AS passages
          FROM scored s JOIN chunks c USING (doc_id, chunk_idx) WHERE place <= 3 GROUP BY s.doc_id, s.field_group),
t AS (SELECT d.doc_id, g.field_group, CAST(coalesce(n, 0) AS BIGINT) AS n_chunks,
             head || coalesce(nullif(passages, ''), '(no passage found)') || {lit(PROMPT_SUFFIX)} AS p
      FROM documents d CROSS JOIN groups g LEFT JOIN shown s ON s.doc_id = d.doc_id AND s.field_group = g.field_group)
SELECT doc_id, field_group, n_chunks, CAST(length(p) AS INTEGER) AS prompt_chars, sha256(p) AS prompt_sha FROM t""",
}
