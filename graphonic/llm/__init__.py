"""Operators of a large-scale training-data pipeline, one module each.

Nothing else in the library imports this subpackage.  ``registry.QUERIES``
and ``registry.ORACLE_SQL`` hold the queries that ``__spark_entry__`` adds.
"""
