"""Registered queries and the SQL that states the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The ordered stream that most oracles start from.
EVENTS = """ev AS (
  SELECT user_id AS stream_id, event_id, epoch_us(ts)::BIGINT AS at_us,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq,
         event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
         CAST(round(value * 3600000000) AS BIGINT) AS service_us
  FROM events)"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; in its SQL, ``{ev}`` stands for the ordered stream."""

    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql.replace("{ev}", EVENTS)
        return f

    return register
