"""Registered queries, each with the SQL that gives the same rows from the test tables' columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# The rendered address and second of every event, as SQL.
EVENTS_SQL = """
e AS (
  SELECT event_id, user_id, event_type, value,
         date_trunc('second', ts) AS seen,
         CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS sec,
         strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS at_text,
         '10.' || (user_id // 65536 % 256) || '.' || (user_id // 256 % 256) || '.' || (user_id % 256) AS ip
  FROM events
)"""


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with its SQL if there is one."""

    def add(fn: Query) -> Query:
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return add


def load_all() -> None:
    from emberlog.plans.queries import (  # noqa: F401
        alerting, chunking, detection, formats, intel, parsing, responses, streams,
    )
