"""Tabular features: rare categories, dummies, scaling, class balancing."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saddle.functions.uniform import uniform
from saddle.operators.cleaning import assert_unique_key
from saddle.ordering import global_index, running_total
from saddle.skew import grouped_rank, lookup_join, null_safe_join
from saddle.storage import materialise


def frequent_categories(df: DataFrame, column: str, pct: float) -> list:
    """Categories holding at least ``pct`` of all rows, nulls counted below the line: at most 1/pct."""
    n = df.select(F.count(F.lit(1))).scalar()
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    kept = counts.where(F.col(column).isNotNull() & (F.col("_n") / n >= pct))
    return sorted(r[0] for r in kept.select(column).collect())


def rare_to_other(df: DataFrame, column: str, pct: float, label: str = "Other") -> DataFrame:
    """Nulls and categories below ``pct`` of all rows become ``label``."""
    keep = frequent_categories(df, column, pct)
    value = F.when(F.col(column).isin(keep), F.col(column)).otherwise(F.lit(label))
    return df.withColumn(column, value)


def dummies(df: DataFrame, categories: dict[str, list]) -> DataFrame:
    """One 0/1 column per given category, named ``column_category``; a plain projection. A null matches no category."""
    out = df
    for column, values in categories.items():
        flags = {f"{column}_{v}": F.coalesce((F.col(column) == F.lit(v)).cast("int"), F.lit(0)) for v in values}
        out = out.withColumns(flags).drop(column)
    return out


def category_dictionary(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, value, pos)``: every value of every column as a string, numbered from 0 by column and value; null is no value."""
    return global_index(_long(df, columns).select("column", "value").distinct(), ["column", "value"], "pos")


def _long(df: DataFrame, columns: list[str], *keep: str) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(*keep, pairs.alias("p")).select(*keep, "p.*").where("value IS NOT NULL")


def dummy_positions(df: DataFrame, key: str, columns: list[str], dictionary: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``df`` with ``ones`` in place of ``columns``: the dictionary's positions of the row's values, ascending; and the dictionary.

    However many values there are, they stay in tables: rows meet the dictionary in a join and hold at most one position a column.
    Values that a given dictionary lacks have none. ``key`` is unique.
    """
    known = materialise(category_dictionary(df, columns)) if dictionary is None else dictionary
    # at most one entry a column
    ones = _long(df, columns, key).join(known, ["column", "value"]).groupBy(key).agg(F.sort_array(F.collect_list("pos")).alias("ones"))
    joined = lookup_join(df.drop(*columns), ones, key, "left")
    return joined.withColumn("ones", F.coalesce("ones", F.array().cast("array<bigint>"))), known


def dense_ones(width: int, ones: str = "ones") -> Column:
    """The 0/1 vector of a model that takes ``width`` dummies."""
    return F.transform(F.sequence(F.lit(0), F.lit(max(width, 1) - 1)), lambda i: F.array_contains(ones, i.cast("bigint")).cast("double")) if width else F.array().cast("array<double>")


def preprocess_features(df: DataFrame, key: str, country: str, gender: str, pct: float = 0.05) -> tuple[DataFrame, DataFrame]:
    checked = assert_unique_key(df, key)
    return dummy_positions(rare_to_other(checked, country, pct), key, [country, gender])


# fixed values: target columns of the customer table
TARGETS = ["target_sales_value", "target_returned_value", "target_net_value", "target_churned"]


def classification_xy(df: DataFrame, key: str, country: str, gender: str, pct: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """Features with ``ones`` and ``y`` for churn, the target columns gone; and the dictionary of ``dummy_positions``."""
    ready, known = preprocess_features(df, key, country, gender, pct)
    return ready.withColumn("y", F.col("target_churned").cast("int")).drop(*TARGETS), known


def min_rank_share(df: DataFrame, column: str, out: str) -> DataFrame:
    """Smallest rank among equal values, over the number of rows; nulls come first and share the least rank."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    run = running_total(counts, "_n", [column], "_run")
    total = df.select(F.count(F.lit(1))).scalar()
    share = run.select(column, ((F.col("_run") - F.col("_n") + 1) / total).alias(out))
    return null_safe_join(df, share, column)


def regression_xy(df: DataFrame, key: str, country: str, gender: str, pct: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """Features with ``ones`` and ``y``, the percentile of the net value; and the dictionary of ``dummy_positions``."""
    ready, known = preprocess_features(df, key, country, gender, pct)
    return min_rank_share(ready, "target_net_value", "y").drop(*TARGETS), known


def standard_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """Zero mean, unit population variance; constant columns are only centred. One aggregation."""
    moments = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns],
                     *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    return df.withColumns({
        c: (F.col(c) - F.lit(moments[f"m_{c}"])) / F.lit(moments[f"s_{c}"] or 1.0) for c in columns
    })


def column_l2_normalize(df: DataFrame, columns: list[str]) -> DataFrame:
    """Divide each column by its own L2 norm."""
    norms = df.agg(*[F.sqrt(F.sum(F.col(c) * F.col(c))).alias(c) for c in columns]).first()
    return df.withColumns({c: F.col(c) / F.lit(norms[c] or 1.0) for c in columns})


def vector_l2_normalize(df: DataFrame, v: str, d: int) -> DataFrame:
    """Column-wise normalisation of an array column."""
    norms = df.agg(*[F.sqrt(F.sum(F.col(v)[i] * F.col(v)[i])).alias(f"n{i}") for i in range(d)]).first()
    return df.withColumn(v, F.array(*[F.col(v)[i] / F.lit(norms[i] or 1.0) for i in range(d)]))


def select_features(df: DataFrame, v: str, label: str, d: int, keep: int) -> DataFrame:
    """Keep the ``keep`` coordinates that best separate the classes (ANOVA F value)."""
    from pyspark.ml.feature import UnivariateFeatureSelector
    from pyspark.ml.functions import array_to_vector, vector_to_array

    packed = df.withColumn("_f", array_to_vector(v)).withColumn("_y", F.col(label).cast("double"))
    selector = UnivariateFeatureSelector(featuresCol="_f", labelCol="_y", outputCol="_kept", selectionMode="numTopFeatures")
    selector.setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(keep)
    model = selector.fit(packed)
    return model.transform(packed).withColumn(v, vector_to_array("_kept")).drop("_f", "_y", "_kept")


def _class_rank(df: DataFrame, cls: str, id_col: str, seed: str) -> DataFrame:
    keyed = df.withColumn("_u", uniform(seed, id_col))
    return grouped_rank(keyed, [cls], [F.col("_u"), F.col(id_col)], "_r", 1).drop("_u")


def balance_classes(df: DataFrame, cls: str, id_col: str, caps: dict, seed: str = "10") -> DataFrame:
    """At most ``caps[class]`` random rows of the named classes; all rows of the others.

    Only the capped classes are ranked.
    """
    named = F.col(cls).isin(list(caps))
    limit: Column = F.lit(None).cast("bigint")
    for value, cap in caps.items():
        limit = F.when(F.col(cls) == value, F.lit(cap)).otherwise(limit)
    capped = _class_rank(df.where(named), cls, id_col, seed).where(F.col("_r") <= limit).drop("_r")
    return df.where(~F.coalesce(named, F.lit(False))).unionByName(capped)


def stratified_sample_n(df: DataFrame, cls: str, id_col: str, n: int, seed: str = "sample") -> DataFrame:
    """Exactly ``n`` random rows of each class; fails when a class has fewer."""
    small = df.groupBy(cls).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") < n)
    if not small.isEmpty():
        raise ValueError(f"a class of {cls} has fewer than {n} rows")
    return _class_rank(df, cls, id_col, seed).where(F.col("_r") <= n).drop("_r")
