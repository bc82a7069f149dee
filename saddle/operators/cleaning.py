"""Row filters, deduplication and small projections."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saddle.skew import first_per_key, lookup_join


def dedup_pairs(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key pair: the first in ``order``."""
    return first_per_key(df, keys, order)


def dedup_ids(df: DataFrame, id_col: str, order: list[str], keep: list[str]) -> DataFrame:
    wanted = [id_col, *dict.fromkeys([*order, *keep])]
    return first_per_key(df.select(*wanted), [id_col], order).select(id_col, *keep)


def exclude_ids(df: DataFrame, bad: DataFrame, id_col: str) -> DataFrame:
    return lookup_join(df, bad.select(id_col), id_col, "left_anti")


def subtract_by_key(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of ``left`` whose key is absent from ``right``; duplicates in ``left`` stay."""
    return lookup_join(left, right.select(key), key, "left_anti")


def drop_single_token_sentences(tokens: DataFrame, sentence: str = "sentence_id") -> DataFrame:
    """Keep the tokens of sentences with two tokens or more."""
    sizes = tokens.groupBy(sentence).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(sentence)
    return lookup_join(tokens, sizes, sentence, "left_semi")


def fillna_const(df: DataFrame, vector: str, d: int, value: float = 10.0) -> DataFrame:
    """Missing vectors, and missing coordinates of present ones, become ``value``."""
    filled = F.transform(F.col(vector), lambda v: F.coalesce(v, F.lit(value)))
    return df.withColumn(vector, F.coalesce(filled, F.array_repeat(F.lit(value), d)))


def cast_labels(df: DataFrame, columns: list[str], kind: str = "int") -> DataFrame:
    return df.withColumns({c: F.col(c).cast(kind) for c in columns})


def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*columns)


def map_category(column: str, mapping: dict) -> Column:
    """A fixed lookup; values outside the mapping become null."""
    result = F.when(F.lit(False), F.lit(None).cast("int"))
    for key, value in mapping.items():
        result = result.when(F.col(column) == key, F.lit(value))
    return result


def age_decade(age: str | Column, max_cat: int) -> Column:
    age = F.col(age) if isinstance(age, str) else age
    return F.least(F.floor(age / 10).cast("int"), F.lit(max_cat))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def assert_unique_key(df: DataFrame, key: str) -> DataFrame:
    """Return ``df`` unchanged, or fail when a key repeats."""
    if not duplicate_keys(df, key).isEmpty():
        raise ValueError(f"{key} is not unique")
    return df
