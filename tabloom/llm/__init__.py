"""Operators of a training-data pipeline over the corpus tables. Nothing else in the library imports this package."""

MODULES = "sharding toxicity ngram_join quality neighbours token_counts warc language bpe decontaminate filter_audit quality_rules divergence".split()
