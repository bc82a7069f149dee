"""Contiguous shards of nearly equal bytes from global prefix sums.

Rows are put in the order (doc_id, checksum, size) by a range partitioning and written once. Each
partition's total is one number; prefix sums of these totals place every partition on the line of
all bytes, and a running sum inside the partition places every row. The line is cut at equal
targets, and a row belongs to the shard in which its middle lies, so a shard misses its target by
at most half a row at either end.

Null texts have no bytes and the checksum of the empty text. Every row counts one byte more than
its text, so empty texts have a place of their own. Repeated rows are kept and spread by a row
number, so any share of the rows may be equal. An empty table gives an empty result. Only the id
and text columns are read, so other columns of any name do no harm.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from saddle.ordering import ordered
from saddle.storage import materialise


def byte_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, shard, slot``; slots run from 0 in each shard."""
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.coalesce(F.col(text_col), F.lit(""))
    sizes = materialise(docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("bigint") + F.lit(1)).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )).withColumn("tie", F.monotonically_increasing_id())
    line = ordered(sizes, ["doc_id", "text_crc32", "size", "tie"]).drop("tie")

    # one row per partition
    totals = line.groupBy("_pid").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    earlier = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    places = totals.select(
        "_pid",
        F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("_bytes"),
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("_rows"),
        F.sum("bytes").over(Window.partitionBy()).alias("_all"),
    )
    before = Window.partitionBy("_pid").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_bytes") + F.coalesce(F.sum("size").over(before), F.lit(0))
    middle = (start * 2 + F.col("size")) * F.lit(shards)
    placed = materialise(line.join(F.broadcast(places), "_pid").select(
        "doc_id", "size", "text_crc32",
        F.least(F.lit(shards - 1), F.floor(middle / (F.col("_all") * 2))).cast("int").alias("shard"),
        (F.col("_rows") + F.col("_pos")).alias("index"),
    ))
    # one row per shard
    first = placed.groupBy("shard").agg(F.min("index").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("index") - F.col("first")).alias("slot"))
