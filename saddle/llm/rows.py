"""Keys that name a row of a corpus by its id and text, whatever else it holds."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_columns(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """Two hashes (96 bits) of id and text, never null. Equal rows share them."""
    return [F.xxhash64(id_col, text_col).alias("key_1"), F.hash(text_col, id_col).alias("key_2")]


def _free(df: DataFrame, base: str) -> str:
    while base in df.columns:
        base += "_"
    return base


def _keyed(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str):
    """``docs`` with its keys, ``keys`` with its own under other names, the join's condition and all four names."""
    mine = [_free(docs, "row_key_1"), _free(docs, "row_key_2")]
    for name, column in zip(mine, key_columns(id_col, text_col)):
        docs = docs.withColumn(name, column)
    theirs = [_free(docs, "their_key_1"), _free(docs, "their_key_2")]
    keys = keys.withColumnsRenamed(dict(zip(("key_1", "key_2"), theirs)))
    return docs, keys, (F.col(mine[0]) == F.col(theirs[0])) & (F.col(mine[1]) == F.col(theirs[1])), [*mine, *theirs]


def drop_rows(docs: DataFrame, keys: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows named by ``keys(key_1, key_2)``."""
    keyed, names, on, _ = _keyed(docs, keys.select("key_1", "key_2"), id_col, text_col)
    return keyed.join(names, on, "left_anti").select(*docs.columns)


def keep_once(docs: DataFrame, keys: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each of the distinct ``keys(key_1, key_2)``."""
    keyed, names, on, used = _keyed(docs, keys.select("key_1", "key_2"), id_col, text_col)
    return keyed.join(names, on, "left_semi").dropDuplicates(used[:2]).select(*docs.columns)


def attach(docs: DataFrame, values: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` beside the other columns of ``values``, which has at most one row per ``(key_1, key_2)``."""
    keyed, named, on, used = _keyed(docs, values, id_col, text_col)
    return keyed.join(named, on, "left").drop(*used)
