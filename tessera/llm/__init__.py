"""Operators for large training-data pipelines.

Self-contained: nothing else in the library imports this subpackage, and it can be removed whole.
Each module holds one operator with a general interface; `queries` registers the thin digest queries.
"""
