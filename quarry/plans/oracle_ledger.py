"""DuckDB oracle SQL for the ledger group (events as model attempts)."""

from quarry.plans.oracle_corpus import DOCS

PRICES = {1: "0.0001", 2: "0.0005", 3: "0.0020", 4: "0.0100", 5: "0.0500"}  # fixture price per attempt, by tier
PRICE_CASE = "CASE tier " + " ".join(f"WHEN {t} THEN CAST('{p}' AS DECIMAL(10,4))" for t, p in PRICES.items()) + " END"

ATTEMPTS = f"""
a0 AS (
  SELECT event_id, user_id, event_type, CAST(floor(event_id / 5) AS BIGINT) AS doc,
         CAST(event_id % 5 + 1 AS INTEGER) AS tier, value / (value + CAST(50.0 AS DOUBLE)) AS confidence,
         CAST(json_extract_string(props, '$.k') AS INTEGER) % 3 <> 0 AS correct,
         CAST(value AS DECIMAL(18,2)) AS latency
  FROM events),
a AS (SELECT *, {PRICE_CASE} AS price FROM a0)
"""

SWEEP = """,
orders(tier_order, seq) AS (VALUES ('all', [1, 2, 3, 4, 5]), ('odd', [1, 3, 5]), ('large first', [5, 4, 3, 2, 1])),
points AS (SELECT tier_order, CAST(s.i AS DOUBLE) / 10 AS threshold, CAST(p.place AS INTEGER) AS place, seq[p.place] AS tier,
                  greatest(CAST(s.i AS DOUBLE) / 10 - CAST(0.05 AS DOUBLE) * (p.place - 1), 0) AS least_conf
           FROM orders, (SELECT range AS i FROM range(0, 11)) s, (SELECT range AS place FROM range(1, 6)) p WHERE p.place <= len(seq)),
one AS (SELECT doc, tier, max(confidence) AS confidence, arg_max(correct, confidence) AS correct, arg_max(price, confidence) AS price
        FROM a GROUP BY doc, tier),
tried AS (SELECT p.*, o.doc, o.confidence, o.correct, o.price,
                 coalesce(min(CASE WHEN confidence > least_conf THEN place END) OVER (PARTITION BY tier_order, threshold, doc),
                          max(place) OVER (PARTITION BY tier_order, threshold, doc)) AS stop
          FROM points p JOIN one o ON o.tier = p.tier),
pd AS (SELECT tier_order, threshold, doc, bool_or(CASE WHEN place = stop THEN correct END) AS correct,
              sum(CASE WHEN place <= stop THEN price END) AS cost
       FROM tried GROUP BY tier_order, threshold, doc),
sw AS (SELECT tier_order, threshold, CAST(count(*) AS BIGINT) AS n_docs,
              CAST(count_if(correct) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS accuracy,
              CAST(sum(cost) AS DOUBLE) AS total_cost
       FROM pd GROUP BY tier_order, threshold),
sweep AS (SELECT *, total_cost / CAST(n_docs AS DOUBLE) AS cost_per_doc FROM sw)
"""

SQL = {
    "cascade_routing": "WITH " + ATTEMPTS + """,
c AS (SELECT *, coalesce(min(CASE WHEN confidence > CASE tier WHEN 1 THEN 0.9::DOUBLE WHEN 2 THEN 0.8::DOUBLE WHEN 3 THEN 0.7::DOUBLE
                                                        WHEN 4 THEN 0.5::DOUBLE ELSE 0 END THEN tier END) OVER (PARTITION BY doc),
                         max(tier) OVER (PARTITION BY doc)) AS accepted_tier FROM a)
SELECT doc, CAST(max(accepted_tier) AS INTEGER) AS accepted_tier,
       bool_or(CASE WHEN tier = accepted_tier THEN correct END) AS correct,
       CAST(sum(CASE WHEN tier <= accepted_tier THEN price END) AS DOUBLE) AS cost,
       CAST(sum(CASE WHEN tier <= accepted_tier THEN latency END) AS DOUBLE) AS latency
FROM c GROUP BY doc""",
    "threshold_sweep": "WITH " + ATTEMPTS + SWEEP + """
SELECT tier_order, threshold, n_docs, accuracy, total_cost, cost_per_doc, cost_per_doc <= 0.03 AS within_budget FROM sweep""",
    "pareto_frontier": "WITH " + ATTEMPTS + SWEEP + """,
ranked AS (SELECT *, max(accuracy) OVER (ORDER BY cost_per_doc, accuracy DESC, tier_order, threshold
                                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM sweep)
SELECT tier_order, threshold, cost_per_doc, accuracy FROM ranked WHERE best IS NULL OR accuracy > best""",
    "latency_percentiles": """
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn,
                  count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, CAST(max(n) AS BIGINT) AS n,
       max(CASE WHEN rn = greatest(1, CAST(ceil(0.5 * n) AS BIGINT)) THEN value END) AS p50,
       max(CASE WHEN rn = greatest(1, CAST(ceil(0.95 * n) AS BIGINT)) THEN value END) AS p95
FROM r GROUP BY event_type""",
    "self_consistency": """
WITH c AS (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY 1, 2)
SELECT user_id, arg_min(event_type, (-c, event_type)) AS answer, CAST(sum(c) AS BIGINT) AS n_samples,
       CAST(max(c) AS DOUBLE) / CAST(sum(c) AS DOUBLE) AS agreement
FROM c GROUP BY user_id""",
    "semantic_entropy": """
WITH c AS (SELECT user_id, lower(event_type) AS cluster, count(*) AS c FROM events GROUP BY 1, 2),
p AS (SELECT user_id, CAST(c AS DOUBLE) / CAST(sum(c) OVER (PARTITION BY user_id) AS DOUBLE) AS p FROM c)
SELECT user_id, CAST(count(*) AS BIGINT) AS n_clusters, CAST(sum(CAST(-p * ln(p) AS DECIMAL(38,12))) AS DOUBLE) AS entropy FROM p GROUP BY user_id""",
    "calibration_bins": """
WITH x AS (SELECT least(d.n_chars / CAST(5000.0 AS DOUBLE), CAST(0.999 AS DOUBLE)) AS conf, l.quality = 1 AS ok
           FROM labels l JOIN documents d USING (doc_id)),
b AS (SELECT CAST(least(floor(conf * 10), 9) AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS n, avg(conf) AS avg_conf,
             avg(CAST(ok AS DOUBLE)) AS accuracy FROM x GROUP BY 1)
SELECT bin, n, avg_conf, accuracy, abs(accuracy - avg_conf) AS gap FROM b""",
    "calibration_ece": """
WITH x AS (SELECT least(d.n_chars / CAST(5000.0 AS DOUBLE), CAST(0.999 AS DOUBLE)) AS conf, l.quality = 1 AS ok
           FROM labels l JOIN documents d USING (doc_id)),
b AS (SELECT CAST(least(floor(conf * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(conf) AS avg_conf,
             avg(CAST(ok AS DOUBLE)) AS accuracy FROM x GROUP BY 1)
SELECT CAST(sum(CAST(n * abs(accuracy - avg_conf) AS DECIMAL(38,9))) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS ece, CAST(sum(n) AS BIGINT) AS n FROM b""",
    "doc_costs": "WITH " + DOCS + """,
t AS (SELECT p.doc_id, p.complexity_tier, CAST(ceil(d.n_chars / 4) AS BIGINT) AS tokens
      FROM prof p JOIN documents d USING (doc_id))
SELECT doc_id, tokens, CAST(tokens * CAST('0.000003' AS DECIMAL(7,6)) AS DOUBLE) AS cloud_cost,
       CAST(tokens * CAST('0.0000002' AS DECIMAL(8,7)) AS DOUBLE) AS local_cost,
       CASE WHEN complexity_tier = 'Hard' THEN CAST(tokens * CAST('0.000003' AS DECIMAL(7,6)) AS DOUBLE)
            ELSE CAST(tokens * CAST('0.0000002' AS DECIMAL(8,7)) AS DOUBLE) END AS routed_cost
FROM t""",
    "mean_logprob": """
SELECT vec_id, CAST(len(embedding) AS BIGINT) AS n_tokens,
       list_reduce(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), lambda a, b: a + b) / len(embedding) AS mean_logprob
FROM embeddings""",
    "mode_delta": "WITH " + ATTEMPTS + """,
q AS (SELECT user_id,
        CAST(count_if(event_id % 2 = 1 AND correct) AS DOUBLE) / CAST(count_if(event_id % 2 = 1) AS DOUBLE) AS native_quality,
        CAST(count_if(event_id % 2 = 0 AND correct) AS DOUBLE) / CAST(count_if(event_id % 2 = 0) AS DOUBLE) AS text_quality
      FROM a GROUP BY user_id)
SELECT user_id, native_quality, text_quality, native_quality - text_quality AS delta FROM q""",
    "energy_totals": "WITH " + ATTEMPTS + """
SELECT user_id, CAST(sum(latency) AS DOUBLE) AS total,
       CAST(coalesce(sum(CASE WHEN event_type = 'view' THEN latency END), 0) AS DOUBLE) AS router,
       CAST(sum(latency) - coalesce(sum(CASE WHEN event_type = 'view' THEN latency END), 0) AS DOUBLE) AS net
FROM a GROUP BY user_id""",
    "ledger_append": "WITH " + ATTEMPTS + """
SELECT event_type AS model, CAST(event_id % 2 AS BIGINT) AS run, CAST(count(*) AS BIGINT) AS n_records, avg(CAST(correct AS DOUBLE)) AS quality,
       CAST(sum(price) AS DOUBLE) AS cost_usd_total, CAST(sum(price) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS cost_usd_per_record,
       CAST(sum(latency) AS DOUBLE) AS latency_s_total, CAST(sum(latency) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS latency_s_per_record
FROM a GROUP BY event_type, event_id % 2""",
    "run_ledger": "WITH " + ATTEMPTS + """
SELECT lower(upper(substr(event_type, 1, 1)) || lower(substr(event_type, 2)) || '-7B') || '-zero-shot' AS model,
       CAST(count(*) AS BIGINT) AS n_records, avg(CAST(correct AS DOUBLE)) AS quality,
       CAST(sum(price) AS DOUBLE) AS cost_usd_total,
       CAST(sum(price) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS cost_usd_per_record,
       CAST(sum(latency) AS DOUBLE) AS latency_s_total,
       CAST(sum(latency) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS latency_s_per_record
FROM a GROUP BY event_type""",
}
