"""Operators of a large-scale training-data pipeline.

Nothing else in the package imports this subpackage; its queries are
registered by ``__spark_entry__.py`` through :mod:`evalframe.llm.queries`.
"""
