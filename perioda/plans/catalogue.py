"""Registered queries of the time-series and model operators with the SQL they are compared with."""

from __future__ import annotations

from . import model_queries, series_queries


def queries() -> dict:
    return series_queries.QUERIES | model_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return series_queries.ORACLE | model_queries.ORACLE
