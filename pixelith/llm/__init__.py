"""Training-data operators: tokenizers, mixing, dedup, scoring, sharding, media and search.

Nothing else in the library imports this subpackage.
"""
