"""All oracle SQL strings (DuckDB dialect) keyed like ``catalog.QUERIES``."""

from quarry.plans import oracle_chunks, oracle_corpus, oracle_curation, oracle_extra, oracle_ledger, oracle_prompts, oracle_scoring

ORACLE_SQL: dict[str, str] = {}
for _group in (oracle_scoring, oracle_curation, oracle_corpus, oracle_prompts, oracle_ledger, oracle_chunks, oracle_extra):
    ORACLE_SQL.update(_group.SQL)

# The streamed profile must equal the batch profile.
ORACLE_SQL["incremental_profile"] = ORACLE_SQL["doc_profile"]
