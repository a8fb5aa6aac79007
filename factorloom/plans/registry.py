"""Registered queries over the supplied tables, with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factorloom.plans import flow_queries, panel_queries, text_queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return panel_queries.QUERIES | text_queries.QUERIES | flow_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return panel_queries.SQL | text_queries.SQL | flow_queries.SQL
