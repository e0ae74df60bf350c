"""Training-data operators: cleaning, deduplication, packing and formatting of text corpora."""
