"""Registration of queries with the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tapeloom.functions.scalars import micros
from tapeloom.sources import read_table

HOUR, MINUTE, DAY = 3_600_000_000, 60_000_000, 86_400_000_000
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Events with integer microseconds and cents, as SQL.
EVENTS = "e AS (SELECT *, epoch_us(ts) AS t, CAST(round(value * 100) AS BIGINT) AS c, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"


def tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with ``t`` in microseconds, ``c`` in cents and the property ``k``."""
    e = read_table(spark, sf_dir, "events")
    return e.withColumns({"t": micros("ts"), "c": F.round(F.col("value") * 100).cast("long"), "k": F.get_json_object("props", "$.k").cast("long")})


def query(sql: str | None, name: str | None = None):
    """Register a function of (spark, sf_dir), with its SQL; ``e`` in it is the tape, and a WITH in front goes on from there."""

    def put(fn):
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            text = sql.strip()
            text = text.replace("WITH RECURSIVE ", "WITH ", 1) if (recursive := text.startswith("WITH RECURSIVE ")) else text
            ORACLE_SQL[key] = f"WITH {EVENTS}, {text[5:]}" if text.startswith("WITH ") and "e AS (SELECT *, epoch_us" not in text else text if text.startswith("WITH ") else f"WITH {EVENTS} {text}"
            if recursive:
                ORACLE_SQL[key] = ORACLE_SQL[key].replace("WITH ", "WITH RECURSIVE ", 1)
        return fn

    return put


def kind(e: DataFrame, name: str) -> DataFrame:
    """Events of one type."""
    return e.where(F.col("event_type") == name)
