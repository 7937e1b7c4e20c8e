"""Operators for large-scale training-data pipelines (ten operators and their queries)."""
