"""Reproducible folds and train/test splits as columns."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saddle.functions.uniform import uniform
from saddle.ordering import global_index
from saddle.skew import grouped_rank, null_safe_join


def stratified_kfold(df: DataFrame, y: str, id_col: str, k: int, seed: str = "fold") -> DataFrame:
    """``fold`` in 0..k-1, dealt out in random order inside every class."""
    keyed = df.withColumn("_u", uniform(seed, id_col))
    ranked = grouped_rank(keyed, [y], [F.col("_u"), F.col(id_col)], "_r", 0)
    return ranked.withColumn("fold", F.pmod("_r", F.lit(k)).cast("int")).drop("_u", "_r")


def kfold(df: DataFrame, id_col: str, k: int, seed: str = "fold") -> DataFrame:
    """``fold`` dealt out over all rows in random order."""
    keyed = df.withColumn("_u", uniform(seed, id_col))
    placed = global_index(keyed, ["_u", id_col], "_r")
    return placed.withColumn("fold", F.pmod("_r", F.lit(k)).cast("int")).drop("_u", "_r")


def train_test_split_stratified(df: DataFrame, y: str, id_col: str, train: float | int,
                                seed: str = "split") -> DataFrame:
    """``is_train``: the same share of every class, or of all rows when a class is too small.

    A whole number for ``train`` is a row count. Rows without a class are a class.
    """
    counts = df.groupBy(y).agg(F.count(F.lit(1)).alias("_n"))
    facts = counts.agg(F.sum("_n").alias("n"), F.min("_n").alias("least"), F.count(F.lit(1)).alias("classes")).first()
    share = train / facts["n"] if isinstance(train, int) else train
    # a training share of all rows is cut down to whole rows; last-bit noise of the product is dropped
    n_train = int(round(share * facts["n"], 9))
    keyed = df.withColumn("_u", uniform(seed, id_col))
    if facts["least"] < 2 or min(n_train, facts["n"] - n_train) < facts["classes"]:
        placed = global_index(keyed, ["_u", id_col], "_r")
        return placed.withColumn("is_train", F.col("_r") < n_train).drop("_u", "_r")
    ranked = grouped_rank(keyed, [y], [F.col("_u"), F.col(id_col)], "_r", 0)
    # one row per class: a class count is bounded by the label domain
    quota = counts.select(y, F.round(F.round(F.col("_n") * F.lit(share), 9)).cast("bigint").alias("_q"))
    return null_safe_join(ranked, quota, y).withColumn("is_train", F.col("_r") < F.col("_q")).drop("_u", "_r", "_q")


def bernoulli_split(df: DataFrame, id_col: str, share: float = 0.8, seed: str = "mask") -> DataFrame:
    return df.withColumn("is_train", uniform(seed, id_col) < F.lit(share))
