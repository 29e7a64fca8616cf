"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage.  Each module holds one operator
(its general interface) and the thin ``opN_*`` query that applies it to a whole table.
"""
