"""Operators for large-scale training-data pipelines.

Nothing outside this package imports it. ``queries.QUERIES`` and
``queries.ORACLES`` hold what ``__spark_entry__`` registers.
"""
