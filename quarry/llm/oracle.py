"""DuckDB SQL for the queries that SQL can express, written from their contracts."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP8 = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""

OP10 = """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
marked AS (
  SELECT *, replace(replace(replace(role, '\\', '\\s'), '##', '\\h#'), '</turn>', '\\l/turn>') AS erole,
            replace(replace(replace(text, '\\', '\\s'), '##', '\\h#'), '</turn>', '\\l/turn>') AS etext FROM rows)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(erole) + length(etext) + 4 + 1 + 8)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""


def _spans(kind: int, pattern: str, group: int = 0, least: int = 0) -> str:
    p = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, {kind} AS kind, length(m[i]) AS n, m[i] AS value,
         list_sum(list_transform(gaps[1:i], lambda x: length(x)))
         + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS start
  FROM (SELECT doc_id, m, parts, gaps, unnest(range(1, len(m) + 1)) AS i
        FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {group}) AS parts,
                     string_split_regex(t, '{p}') AS gaps FROM texts))
  WHERE length(parts[i]) >= {least}"""


def _entropy(kind: int, run: str, window: int, bits: float) -> str:
    return f"""
  SELECT doc_id, {kind} AS kind, (start + min(pos) - 1)::BIGINT AS start, (start + max(pos) - 1 + {window})::BIGINT AS stop
  FROM (SELECT doc_id, start, value, unnest(range(1, n - {window} + 2)) AS pos FROM ({_spans(kind, run)})
        WHERE NOT regexp_matches(value, '^([A-Za-z]+|[0-9]+|[A-Za-z]+([/_=+-]+[A-Za-z]*)+|[-=_+/]+)$')
          AND NOT regexp_matches(lower(value), 'example|sample|placeholder|xxxx')
          AND NOT regexp_matches(value, '^[0-9A-Fa-f]{{8}}-[0-9A-Fa-f]{{4}}-[0-9A-Fa-f]{{4}}-[0-9A-Fa-f]{{4}}-[0-9A-Fa-f]{{12}}$'))
  WHERE list_aggregate(string_split(substr(value, pos, {window}), ''), 'entropy') >= {bits} - 1e-9
  GROUP BY doc_id, start, value"""


OP3 = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS (
  SELECT doc_id, kind, start::BIGINT AS start, (start + n)::BIGINT AS stop FROM (
  {_spans(0, r'''((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)''', 2, 6)}
  UNION ALL {_spans(1, 'AKIA[A-Z0-9]{16,}')}
  UNION ALL {_spans(2, '[0-9a-f]{24,}')})),
found AS (
  SELECT * FROM base
  UNION ALL {_entropy(3, '[0-9A-Fa-f]{24,}', 24, 3.05)}
  UNION ALL {_entropy(4, '[A-Za-z0-9+/=_-]{20,}', 20, 3.65)}),
named AS (
  SELECT *, (['assign', 'access', 'hex', 'entropy_hex', 'entropy_base64'])[kind + 1] || ':' || start || ':' || stop AS span
  FROM found),
one AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
         count(*) FILTER (kind = 2) AS n_hex,
         coalesce(string_agg(span, ',' ORDER BY start, kind) FILTER (kind < 3), '') AS base_spans,
         string_agg(span, ',' ORDER BY start, kind, stop) AS spans
  FROM named GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts t LEFT JOIN one USING (doc_id)
"""

OP4 = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS s FROM words),
each AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM each a JOIN each b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
both_ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (
  SELECT u AS node, v AS other FROM both_ways
  UNION SELECT r.node, b.v FROM reach r JOIN both_ways b ON b.u = r.other),
least_one AS (SELECT node, min(other) AS m FROM reach GROUP BY node)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(m, s.doc_id)) AS component_id,
       s.doc_id <= coalesce(m, s.doc_id) AS kept
FROM sets s LEFT JOIN least_one ON node = s.doc_id
"""

OP5 = """
WITH lines AS (
  SELECT doc_id, line, t, (sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY line) - length(t) - 1)::BIGINT AS pos
  FROM (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) AS line
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
cut AS (
  SELECT doc_id, line, pos, unnest(u) AS unit, generate_subscripts(u, 1) AS k
  FROM (SELECT *, regexp_extract_all(t, '[^.!?]+[.!?]*|[.!?]') AS u FROM lines)),
placed AS (
  SELECT *, (pos + sum(length(unit)) OVER (PARTITION BY doc_id, line ORDER BY k))::BIGINT AS stop,
         regexp_extract_all(lower(unit), '\\S+') AS w FROM cut),
sentences AS (
  SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY line, k) AS place, stop - length(unit) AS start, stop,
         len(w) AS words, array_to_string(w, ' ') AS norm, count(*) OVER (PARTITION BY doc_id, line) AS n
  FROM placed WHERE len(w) > 1 OR (len(w) = 1 AND w[1] NOT IN ('.', '!', '?', '.!', '!?', '.!?'))),
paragraphs AS (
  SELECT doc_id, line, pos AS start, pos + length(t) AS stop, len(w) AS words, array_to_string(w, ' ') AS norm
  FROM (SELECT *, regexp_extract_all(lower(t), '\\S+') AS w FROM lines)),
units AS (
  SELECT s.doc_id, s.line, s.place, CASE WHEN alone THEN p_start ELSE s.start END AS start,
         CASE WHEN alone THEN p_stop ELSE s.stop END AS stop, s.words, s.norm, alone AS whole
  FROM (SELECT s.*, p.start AS p_start, p.stop AS p_stop, n = 1 AND s.norm = p.norm AS alone
        FROM sentences s JOIN paragraphs p USING (doc_id, line)) s
  UNION ALL
  SELECT doc_id, line, 0, start, stop, words, norm, true FROM paragraphs p
  WHERE EXISTS (SELECT 1 FROM sentences s WHERE s.doc_id = p.doc_id AND s.line = p.line AND (s.n > 1 OR s.norm <> p.norm))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY doc_id, start) AS r FROM units),
repeats AS (
  SELECT *, CASE WHEN place - lag(place) OVER (PARTITION BY doc_id ORDER BY place) <= 1 THEN 0 ELSE 1 END AS fresh
  FROM ranked WHERE r > 1 AND place > 0),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY place) AS run FROM repeats),
weighed AS (SELECT *, sum(stop - start) OVER (PARTITION BY doc_id, run) AS chars FROM runs),
lost AS (
  SELECT doc_id, start, stop, words FROM ranked WHERE r > 1 AND place = 0
  UNION ALL
  SELECT doc_id, start, stop, words FROM weighed w WHERE (whole OR chars >= 150)
    AND NOT EXISTS (SELECT 1 FROM ranked p WHERE p.r > 1 AND p.place = 0 AND p.doc_id = w.doc_id AND p.line = w.line)),
gone AS (
  SELECT doc_id, count(*) AS n, sum(words)::BIGINT AS words, string_agg(start || ':' || stop, ',' ORDER BY start) AS spans,
         max(stop) AS last FROM lost GROUP BY doc_id),
gaps AS (
  SELECT l.doc_id, string_agg(substr(text, before + 1, start - before), '' ORDER BY start) AS t
  FROM (SELECT *, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY start), 0) AS before FROM lost) l
  JOIN documents d ON d.doc_id = l.doc_id GROUP BY l.doc_id),
done AS (
  SELECT d.doc_id, n, words, spans, coalesce(CASE WHEN last IS NULL THEN text ELSE t || substr(text, last + 1) END, '') AS kept
  FROM documents d LEFT JOIN gone USING (doc_id) LEFT JOIN gaps USING (doc_id))
SELECT doc_id, coalesce(n, 0) AS n_removed, coalesce(words, 0) AS removed_words, coalesce(spans, '') AS spans,
       length(kept)::BIGINT AS kept_chars, sha256(kept) AS kept_sha256
FROM done
"""

OP9 = f"""
WITH RECURSIVE cut AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN
         regexp_replace(substr(url, instr(url, '://') + 3), '[?#].*$', '', 's') END AS rest FROM pages),
parts AS (
  SELECT page_id, url, coalesce({_LOWER.format("string_split(rest, '/')[1]")}, '') AS host,
         CASE WHEN contains(rest, '/') THEN substr(rest, instr(rest, '/')) ELSE '' END AS path FROM cut),
tokens AS (
  SELECT *, CASE WHEN contains(url, '://') THEN list_sort(list_distinct(
    list_transform(range(1, len(labels) + 1), lambda i: 'host=' || array_to_string(labels[i:], '.'))
    || list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: 'path=' || regexp_replace(lower(x), '[0-9]+', '0', 'g'))
    || list_transform(list_filter([regexp_extract(path, '\\.([A-Za-z0-9]{{1,5}})$', 1)], lambda x: x <> ''), lambda x: 'ending=' || lower(x))
    || list_transform(regexp_extract_all(url, '[?&]([^=&#]+)', 1), lambda x: 'query=' || lower(x))
    || ['scheme=' || lower(string_split(url, '://')[1])])) ELSE []::VARCHAR[] END AS items
  FROM (SELECT *, list_filter(string_split(host, '.'), lambda x: x <> '') AS labels FROM parts)),
known AS (SELECT doc_id, bool_or(coalesce(toxic, 0) = 1 OR coalesce(quality, 1) = 0) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
train AS (SELECT row_number() OVER () AS row_id, items, bad FROM tokens JOIN known ON doc_id = page_id),
size AS (SELECT count(*) AS n, greatest(ceil(0.002 * count(*)), 20) AS least_rows FROM train),
sets AS (
  SELECT row_id, bad, items, [items[i]] AS s, i FROM (SELECT *, unnest(range(1, len(items) + 1)) AS i FROM train)
  UNION ALL
  SELECT row_id, bad, items, s || [items[j]], j
  FROM (SELECT *, unnest(range(i + 1, len(items) + 1)) AS j FROM sets WHERE len(s) < 4)),
counted AS (SELECT s, count(*) AS seen, count(*) FILTER (bad) AS hits FROM sets GROUP BY s),
good AS (
  SELECT s, hits / seen AS confidence, array_to_string(s, ' ') AS rule_id FROM counted, size
  WHERE hits >= least_rows AND hits / seen >= 0.6),
rules AS (
  SELECT * FROM good g WHERE NOT EXISTS (
    SELECT 1 FROM good h WHERE len(h.s) = len(g.s) - 1 AND len(h.s) > 0 AND list_has_all(g.s, h.s) AND h.confidence >= g.confidence)),
best AS (
  SELECT page_id, url, arg_max(rule_id, (confidence, rule_id)) AS mined_rule
  FROM (SELECT DISTINCT page_id, url, items FROM tokens) t JOIN rules r ON list_has_all(t.items, r.s) GROUP BY page_id, url),
judged AS (
  SELECT t.page_id, host, path, mined_rule,
    CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
         WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
         WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
         WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
         WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule
  FROM tokens t LEFT JOIN best b ON b.page_id = t.page_id AND b.url IS NOT DISTINCT FROM t.url)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN mined_rule IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, mined_rule
FROM judged
"""

OP12 = """
WITH convs AS (
  SELECT DISTINCT conv_id AS c, conv_id - conv_id % 5 AS base FROM conversations WHERE conv_id IS NOT NULL),
heads AS (  -- CRC-32 of the decimal id, bit by bit
  SELECT c, base, (xor(list_reduce(list_prepend(4294967295::UBIGINT,
             list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::UBIGINT)),
           lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[],
             lambda r, z: xor(r >> 1, CASE WHEN r % 2 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END))),
           4294967295::UBIGINT) % 9)::BIGINT AS h FROM convs),
own AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
turns AS (
  SELECT k.c, 0 AS part, o.p, o.role, o.text FROM heads k JOIN own o ON o.c = k.base AND o.p <= k.h
  UNION ALL SELECT k.c, 1, o.p, o.role, o.text FROM heads k JOIN own o ON o.c = k.c AND o.p > k.h),
paths AS (
  SELECT c, row_number() OVER w AS depth, text, list([role, text]) OVER w AS path FROM turns
  WINDOW w AS (PARTITION BY c ORDER BY part, p)
  UNION ALL SELECT c, 0, '', [] FROM convs),
last AS (SELECT c, max(depth) AS n FROM paths GROUP BY c),
nodes AS (
  SELECT depth, path, min(c) AS conv_id, count(*) AS n_convs, any_value(text) AS text,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (depth = n), '')) AS ends_sha256
  FROM paths JOIN last USING (c) GROUP BY depth, path),
kids AS (SELECT path[1:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
sized AS (
  SELECT a.*, coalesce(k.n, 0) AS n_children, p.conv_id AS parent_conv_id
  FROM nodes a LEFT JOIN kids k ON k.path = a.path
  LEFT JOIN nodes p ON a.depth > 0 AND p.depth = a.depth - 1 AND p.path = a.path[1:a.depth - 1]),
sums AS (
  SELECT path[1:up] AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * strlen(text)) AS saved
  FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM sized) GROUP BY 1)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved::BIGINT AS saved_tokens, ends_sha256
FROM sized JOIN sums USING (path)
"""

ORACLE_SQL = {
    "op3_secret_scan": OP3, "op4_near_dedup": OP4, "op5_unit_dedup": OP5, "op8_exact_dedup": OP8,
    "op9_url_filter": OP9, "op10_chat_format": OP10, "op12_prefix_trie": OP12,
}
