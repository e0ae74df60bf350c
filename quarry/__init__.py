"""quarry — Spark-native extraction-quality analytics.

Profile document corpora, normalise and curate extracted records, assemble
prompts and parse model responses, score predictions against gold records
leaf by leaf, and roll scores up into a run ledger — all as DataFrame plans.
"""

__version__ = "0.1.0"
