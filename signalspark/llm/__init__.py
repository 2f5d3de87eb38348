"""Operators for training-data corpora: near and exact dedup, mixing, packing, language ID, media, tokens, licenses."""
