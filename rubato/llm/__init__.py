"""Operators for preparing large text corpora.

``QUERIES`` maps query names to callables ``(spark, sf_dir) -> DataFrame`` and
``ORACLE_SQL`` maps a subset of those names to equivalent DuckDB SQL.
"""
