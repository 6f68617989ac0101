"""Operators of a training-data pipeline.

Nothing else in the library imports this subpackage. Each module holds one
operator with its own interface; ``registry`` holds the thin ``opN_`` queries
and their SQL.
"""
