"""All registered queries but those of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glyphmill.plans import data_queries, extension_queries, rule_queries, text_queries

_RULES = rule_queries.QUERIES | extension_queries.QUERIES
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: query.run for name, query in _RULES.items()} | text_queries.QUERIES | data_queries.QUERIES
ORACLE: dict[str, str] = {name: sql for name, query in _RULES.items() if (sql := query.oracle())} | text_queries.ORACLE | data_queries.ORACLE
