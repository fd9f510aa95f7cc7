"""Queries over the driver's tables and the SQL that gives the same rows.

Keys follow the operators' names; each query is a plan over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import events, formats, graphs, tables, texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**texts.QUERIES, **tables.QUERIES, **events.QUERIES, **graphs.QUERIES, **formats.QUERIES}
ORACLE_SQL: dict[str, str] = {**texts.ORACLE_SQL, **tables.ORACLE_SQL, **events.ORACLE_SQL, **graphs.ORACLE_SQL, **formats.ORACLE_SQL}
