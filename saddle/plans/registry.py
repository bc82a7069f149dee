"""The list of queries, each beside the SQL that must give the same rows."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def r(column: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, digits)


def rs(expression: str, digits: int = 6) -> str:
    """Rounded SQL without a negative zero."""
    return f"(CASE WHEN round({expression}, {digits}) = 0 THEN 0.0 ELSE round({expression}, {digits}) END)"


def vec_rows(df: DataFrame, keys: list[str], v: str, digits: int = 6) -> DataFrame:
    """An array column as ``(keys, pos, value)`` rows."""
    return df.select(*keys, F.posexplode(v).alias("pos", "value")).select(
        *keys, "pos", F.round("value", digits).alias("value"))


def vec_rows_sql(source: str, keys: list[str], v: str, digits: int = 6) -> str:
    """The same rows in SQL from a relation ``source``."""
    ks = ", ".join(keys)
    return (f"SELECT {ks}, CAST(pos - 1 AS INTEGER) AS pos, {rs('val', digits)} AS value FROM ("
            f"SELECT {ks}, unnest({v}) AS val, generate_subscripts({v}, 1) AS pos FROM {source}) AS exploded")
