"""Lookups, blocks of pairs and sums over embedding tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saddle.skew import lookup_join


def embedding_lookup(pairs: DataFrame, emb: DataFrame, x: str = "x", y: str = "y",
                     left: str = "w_in", right: str = "w_out") -> DataFrame:
    """Put both ends' vectors beside each pair. Hot ends meet a broadcast of only their rows."""
    ins = emb.select(F.col("id").alias(x), F.col(left).alias("vx"))
    outs = emb.select(F.col("id").alias(y), F.col(right).alias("vy"))
    return lookup_join(lookup_join(pairs, ins, x), outs, y)


def pairwise_block(left: DataFrame, right: DataFrame) -> DataFrame:
    """All pairs of two vector sets inside each batch ``(batch_id, id, v)``.

    Batches have a fixed size by construction (``make_batches``, ``negative_samples``), so this
    is an equi-join whose groups cannot grow with the data.
    """
    a = left.select("batch_id", F.col("id").alias("x"), F.col("v").alias("vx"))
    b = right.select("batch_id", F.col("id").alias("y"), F.col("v").alias("vy"))
    return a.join(b, "batch_id")


def embedding_align(targets: DataFrame, emb: DataFrame, key: str = "id") -> DataFrame:
    """Embedding rows for every target id; missing ones are null."""
    return lookup_join(targets, emb, key, "left")


# -- sums ----------------------------------------------------------------------------------

def sum_vectors(df: DataFrame, key: str, v: str, d: int, weight: Column | None = None) -> DataFrame:
    """Per key the coordinate-wise sum, combined before the shuffle."""
    w = F.lit(1.0) if weight is None else weight
    sums = df.groupBy(key).agg(*[F.sum(F.col(v)[i] * w).alias(f"_s{i}") for i in range(d)])
    return sums.select(key, F.array(*[f"_s{i}" for i in range(d)]).alias(v))


def prod2cust_sum(views: DataFrame, emb: DataFrame, d: int) -> DataFrame:
    """Customer vector = sum of the vectors of viewed products, repeats included."""
    seen = views.select("customer_id", F.col("product_id").alias("id"))
    return sum_vectors(lookup_join(seen, emb.select("id", "v"), "id", "inner"), "customer_id", "v", d)


def first_label(labels: DataFrame) -> DataFrame:
    return labels.groupBy("id").agg(F.min("label").alias("label"))


def one_hot(df: DataFrame, column: str, out: str = "hot") -> DataFrame:
    """Integer classes as 0/1 arrays; classes starting at 1 or above shift down by one."""
    span = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    width = int(span["hi"]) + 1 if span["lo"] == 0 else int(span["hi"])
    index = F.col(column) if span["lo"] == 0 else F.col(column) - 1
    return df.withColumn(out, F.transform(F.sequence(F.lit(0), F.lit(width - 1)),
                                          lambda i: F.when(i == index, 1).otherwise(0)))


def not_hot(df: DataFrame, column: str = "hot", out: str = "cls") -> DataFrame:
    return df.withColumn(out, (F.array_position(F.col(column), 1) - 1).cast("int"))


