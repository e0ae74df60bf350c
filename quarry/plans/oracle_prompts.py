"""DuckDB oracle SQL for prompt assembly and response parsing."""

# The prompt's fixed wording, stated here again, so that a change of the operator shows as a difference.
SYSTEM_PROMPT = ('You are an expert EPD data extraction assistant. Extract structured data from EPD documents and'
    ' return valid JSON only.')
PROMPT_HEAD = ('Extract all fields from the EPD document below.\n'
    '\n'
    'Return a JSON object with EXACTLY these flat string fields (use "N/A" for any field not found i'
    'n the document):\n')
PROMPT_INDICATORS = ('Also include these 12 nested LCA indicator objects (')
PROMPT_STAGES = ('),\n'
    'each containing lifecycle stage keys: ')
PROMPT_STAGE_NOTE = ('\n'
    '(use "N/A" for stages not reported; Unit should be the exact string from the document).\n'
    '\n')
PROMPT_DOC = ('EPD DOCUMENT:\n')
PROMPT_TABLES = ('\n'
    '\n'
    'TABLE DATA:\n')
PROMPT_TAIL = ('\n'
    '\n'
    'Respond with ONLY the JSON object, no markdown fences or explanation.')
NO_TABLES = ('(no tables extracted)')
INDICATORS = ('ACIDIFICATION, EUTROFICATION, FRESH WATER, GWP-BIOGENIC, GWP-FOSSIL, GWP-TOTAL, PENRE, PENRM, P'
    'ENRT, PERE, PERM, PERT')
STAGES = ('A1, A2, A3, A1-A3, A4, A5, A4-A5, B1, B2, B3, B4, B5, B6, B7, B1-B7, C1, C2, C3, C4, C1-C4, D, '
    'Unit')


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


FIELDS = ("Order Status", "Order Priority", "Return Flags")
FIELD_BLOCK = "{\n" + "\n".join(f'  "{f}": "..."' for f in FIELDS) + "\n}\n\n"


def prompt_prefix(block: str) -> str:
    return PROMPT_HEAD + block + PROMPT_INDICATORS + INDICATORS + PROMPT_STAGES + STAGES + PROMPT_STAGE_NOTE + PROMPT_DOC


PROMPT_PREFIX = prompt_prefix(FIELD_BLOCK)
PROMPT_SUFFIX = PROMPT_TABLES + NO_TABLES + PROMPT_TAIL
PROMPT = f"{lit(PROMPT_PREFIX)} || text || {lit(PROMPT_SUFFIX)}"

RESPONSES = r"""
o AS (
  SELECT o_orderkey AS k,
    '{"order":' || CAST(o_orderkey AS VARCHAR) || ',"status":"' || o_orderstatus || '","priority":"'
      || o_orderpriority || '"}' AS body
  FROM orders),
r AS (
  SELECT k, CASE k % 5
      WHEN 0 THEN body
      WHEN 1 THEN '```json' || chr(10) || body || CASE WHEN k % 3 = 0 THEN ' x' ELSE '' END || chr(10) || '```'
      WHEN 2 THEN '```' || chr(10) || body || chr(10) || '```'
      WHEN 3 THEN 'Here is the result: ' || body || ' Hope this helps.'
      ELSE substr(body, 1, length(body) - 5) END AS raw_text
  FROM o),
x AS (
  SELECT k, raw_text, regexp_extract(raw_text, '```(?:json)?\s*(\{[\s\S]*?\})\s*```', 1) AS fenced,
            regexp_extract(raw_text, '\{[\s\S]*\}', 0) AS braces
  FROM r),
p AS (
  SELECT k, raw_text,
    CASE WHEN fenced <> '' AND json_valid(fenced) THEN 'fenced'
         WHEN braces <> '' AND json_valid(braces) THEN 'braces' ELSE 'none' END AS rule,
    CASE WHEN fenced <> '' AND json_valid(fenced) THEN fenced
         WHEN braces <> '' AND json_valid(braces) THEN braces ELSE '{}' END AS parsed
  FROM x)
"""

SQL = {
    "flat_fields": """
SELECT f.field, (SELECT min(o_orderkey) FROM orders) AS first_index, CAST(f.pos AS BIGINT) AS first_pos,
       CAST(f.rank AS BIGINT) AS rank
FROM (VALUES ('Order Status', 2, 1), ('Order Priority', 3, 2), ('Return Flags', 4, 3)) f(field, pos, rank)""",
    "document_prompts": f"""
WITH t AS (SELECT doc_id, {lit(PROMPT_PREFIX)} || text || {lit(PROMPT_TABLES)} || CASE doc_id % 3
             WHEN 0 THEN {lit(NO_TABLES)}
             WHEN 1 THEN '| chars |' || chr(10) || '| ' || n_chars || ' |'
             ELSE '| chars |' || chr(10) || '| ' || n_chars || ' |' || chr(10) || chr(10) || '| lang |' || chr(10) || '| ' || lang || ' |' END
             || {lit(PROMPT_TAIL)} AS p FROM documents)
SELECT doc_id, CAST(length(p) AS INTEGER) AS prompt_chars, sha256(p) AS prompt_sha FROM t""",
    "chat_messages": f"""
SELECT doc_id, '[{{"role":"system","content":' || to_json({lit(SYSTEM_PROMPT)}) || '}},{{"role":"user","content":'
       || to_json({PROMPT}) || '}}]' AS messages FROM documents""",
    "stub_extraction": f"""
WITH w AS (SELECT doc_id, regexp_extract_all(text || {lit(PROMPT_SUFFIX)}, '\\S+') AS w FROM documents)
SELECT doc_id, 'fenced' AS rule, '{{"Order Status": ' || to_json(w[1]) || ', "n_words": "' || len(w) || '"}}' AS parsed FROM w""",
    "chat_export": """
SELECT CASE WHEN conv_id % 100 < 80 THEN 'train' ELSE 'eval' END AS split,
       '{"conv_id":' || conv_id || ',"messages":[' || string_agg('{"role":' || to_json(role) || ',"content":' || to_json(text) || '}',
         ',' ORDER BY turn) || ']}' AS line
FROM conversations GROUP BY conv_id""",
    "few_shot": f"""
WITH pool AS (SELECT doc_id AS example, row_number() OVER (ORDER BY (doc_id * 2654435761) % 4294967296, doc_id) - 1 AS rank,
                     count(*) OVER () AS n
              FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
asked AS (SELECT d.doc_id, p.place, (((d.doc_id + 7) * 2654435761) % 4294967296 % n + p.place) % n AS rank
          FROM documents d, (SELECT max(n) AS n FROM pool), (VALUES (0), (1), (2)) p(place) WHERE p.place < n),
drawn AS (SELECT a.doc_id, example, row_number() OVER (PARTITION BY a.doc_id ORDER BY place) AS place
          FROM asked a JOIN pool USING (rank) WHERE example <> a.doc_id),
shown AS (SELECT k.doc_id, string_agg('EXAMPLE DOCUMENT:' || chr(10) || e.text || chr(10) || chr(10), '' ORDER BY k.place) AS shots,
                 list(k.example ORDER BY k.place) AS examples
          FROM drawn k JOIN documents e ON e.doc_id = k.example WHERE k.place <= 2 GROUP BY k.doc_id),
t AS (SELECT d.doc_id, coalesce(array_to_string(examples, ','), '') AS example_ids, coalesce(shots, '') || {PROMPT} AS p
      FROM documents d LEFT JOIN shown USING (doc_id))
SELECT doc_id, example_ids, CAST(length(p) AS BIGINT) AS prompt_chars, sha256(p) AS prompt_sha FROM t""",
    "response_parse": "WITH " + RESPONSES + """
SELECT k AS o_orderkey, 'ORD-' || lpad(CAST(k AS VARCHAR), 6, '0') || '.pdf' AS file_name, rule,
       CAST(CASE WHEN parsed = '{}' THEN 0 ELSE len(json_keys(parsed)) END AS BIGINT) AS n_keys,
       json_extract_string(parsed, '$.status') AS status, sha256(raw_text) AS raw_sha
FROM p""",
}
