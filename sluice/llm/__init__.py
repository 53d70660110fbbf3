"""Operators for large training-data corpora: each module holds one operator, queries.py registers them."""
