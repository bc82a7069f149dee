"""Joins and per-key ranks that hold when one key owns a large share of the rows.

There is one plan at every size and nobody looks for hot keys. Lookups are plain joins: adaptive
execution splits a partition that a hot key makes large (``spark.sql.adaptive.skewJoin``, and with
``forceOptimizeSkewedJoin`` also where a later shuffle follows). Ranks sort by ranges of the whole
order, which cut a key's rows over as many tasks as they need.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saddle.ordering import counted


#: Rows that a task sorts or sums at most, on average; none for the session's setting ``spark.saddle.taskRows``, or its default.
TASK_ROWS: int | None = None


def _task_rows(df: DataFrame) -> int:
    return TASK_ROWS or int(df.sparkSession.conf.get("spark.saddle.taskRows", "2000000"))


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df``, of about ``rows`` rows, hash partitioned by ``keys`` into tasks of at most ``TASK_ROWS`` rows, so a task's memory does not grow
    with the table. Where the session's number of partitions does that, the next operator deals the rows itself."""
    n = -(-rows // _task_rows(df))
    return df if n <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(n, *keys)


def lookup_join(big: DataFrame, small: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Join ``big`` to ``small``, which has one row per ``on``; the columns of ``big`` come first."""
    extra = [] if how in ("left_semi", "left_anti") else [c for c in small.columns if c != on]
    return big.join(small, on, how).select(*big.columns, *extra)


def null_safe_join(big: DataFrame, small: DataFrame, on: str) -> DataFrame:
    """As an inner ``lookup_join``, but null is a key like any other."""
    right = small.withColumnRenamed(on, "_on")
    return big.join(right, F.col(on).eqNullSafe(F.col("_on"))).drop("_on")


def grouped_rank(df: DataFrame, keys: list[str], order: list, name: str = "rank", start: int = 0) -> DataFrame:
    """Row number inside each key, from ``start``; null keys are a group."""
    numbered = counted(df, keys, list(order), name)
    return numbered if start == 1 else numbered.withColumn(name, F.col(name) + F.lit(start - 1))


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in ascending ``order``; map-side combined, so skew is harmless."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.struct(*order, *rest)
    best = df.groupBy(*keys).agg(F.min_by(packed, F.struct(*order)).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)
