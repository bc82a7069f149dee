"""Readers and writers for logs, edge lists, walks, sentences, embeddings, vocabularies, results.

Every reader names its schema or parses plain text lines; nothing is inferred. All files are
written in parallel as folders of parts.
"""
from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: the 23 columns of a product view log, in file order
VIEW_COLUMNS = [
    "customerId", "productId", "variantId", "divisionId", "sourceId", "itemQty", "dateViewed", "origin",
    "price", "discountType", "useForRecs", "dateModified", "viewonly", "changeThumbnail", "imageZoom",
    "watchVideo", "view360", "sizeGuide", "device", "userTime", "misc1", "misc2", "misc3",
]


def read_interactions(spark: SparkSession, path: str, sep: str = ",", columns: list[str] | None = None,
                      header: bool = True, epoch: bool = True) -> DataFrame:
    """``(customer_id, product_id, date_viewed)`` from delimited view logs.

    ``columns`` is the file's column order and must name customerId, productId and dateViewed;
    the others are never parsed into the result. ``dateViewed`` holds epoch seconds or a timestamp.
    """
    names = columns or ["customerId", "productId", "dateViewed"]
    schema = ", ".join(f"`{c}` string" for c in names)
    raw = spark.read.schema(schema).option("enforceSchema", True).csv(path, sep=sep, header=header)
    when = F.timestamp_seconds(F.col("dateViewed").cast("double")) if epoch else F.to_timestamp("dateViewed")
    return raw.select(
        F.col("customerId").cast("bigint").alias("customer_id"),
        F.col("productId").cast("bigint").alias("product_id"),
        when.alias("date_viewed"),
    )


def write_interactions(views: DataFrame, path: str, sep: str = ",", header: bool = True) -> None:
    stamp = F.unix_micros(F.col("date_viewed").cast("timestamp")) / F.lit(1e6)
    views.select(F.col("customer_id").alias("customerId"), F.col("product_id").alias("productId"),
                 stamp.cast("decimal(20,6)").alias("dateViewed")).write.csv(path, sep=sep, header=header)


def read_edge_list(spark: SparkSession, path: str, sep: str = " ") -> DataFrame:
    return spark.read.schema("src bigint, dst bigint").csv(path, sep=sep)


def write_edge_list(edges: DataFrame, path: str, sep: str = " ") -> None:
    edges.select("src", "dst").write.csv(path, sep=sep, header=False)


def read_walks(spark: SparkSession, path: str) -> DataFrame:
    """``(path array<bigint>)``, one per line, split on commas or spaces; lengths may differ."""
    parts = F.filter(F.split("value", "[, ]+"), lambda t: t != "")
    return spark.read.text(path).select(parts.cast("array<bigint>").alias("path"))


def write_walks(walks: DataFrame, path: str, sep: str = ",") -> None:
    walks.select(F.array_join(F.col("path").cast("array<string>"), sep).alias("value")).write.text(path)


#: Tokens on a line of a sentence file.
LINE_TOKENS = 4096


def write_sentences(tokens: DataFrame, path: str) -> None:
    """Sentences as lines ``sentence_id <tab> line number <tab> tokens``, space-joined, ``LINE_TOKENS`` a line.

    A short sentence is one line; a sentence of any length is several, each small enough for a task.
    """
    line = F.expr(f"pos div {LINE_TOKENS}").alias("line")
    held = F.sort_array(F.collect_list(F.struct("pos", F.col("token").cast("string").alias("token"))))
    lines = tokens.groupBy("sentence_id", line).agg(held.alias("s"))
    lines.select(F.concat_ws("\t", F.col("sentence_id").cast("string"), F.col("line").cast("string"),
                             F.array_join("s.token", " ")).alias("value")).write.text(path)


def read_sentences(spark: SparkSession, path: str) -> DataFrame:
    """``(sentence_id, pos, token)`` as strings and place, every sentence whole."""
    parts = F.split("value", "\t", 3)
    lines = spark.read.text(path).select(parts[0].alias("sentence_id"), parts[1].cast("bigint").alias("line"), F.split(parts[2], " ").alias("t"))
    each = lines.select("sentence_id", "line", F.posexplode("t").alias("at", "token"))
    return each.select("sentence_id", (F.col("line") * LINE_TOKENS + F.col("at")).alias("pos"), "token")


def read_embedding_text(spark: SparkSession, path: str, sep: str = r"\s+", sort: bool = False) -> DataFrame:
    """``(id, v)`` from word2vec text.

    A ``count width`` header is known by its content: two whole numbers that are the number of the
    other lines and their width. Blank lines are skipped.
    """
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.split(F.trim("value"), sep).alias("f"))
    size = rows.agg(F.max(F.size("f")).alias("widest"), F.count(F.lit(1)).alias("lines")).first()
    if size["lines"]:
        top = [str(size["lines"] - 1), str(size["widest"] - 1)]
        rows = rows.where(F.col("f") != F.array(*[F.lit(x) for x in top]))
    out = rows.select(F.col("f")[0].cast("bigint").alias("id"),
                      F.slice("f", F.lit(2), F.size("f") - 1).cast("array<double>").alias("v"))
    return out.orderBy("id") if sort else out


def write_embedding_text(emb: DataFrame, path: str, sep: str = " ", header: bool = True) -> None:
    """word2vec text: ``id v1 .. vd`` lines, with the header as one more part file."""
    line = F.concat_ws(sep, F.col("id").cast("string"), F.array_join(F.col("v").cast("array<string>"), sep))
    emb.select(line.alias("value")).write.text(path)
    if header:
        top = emb.agg(F.concat_ws(" ", F.count(F.lit(1)), F.first(F.size("v"))).alias("value"))
        top.write.mode("append").text(path)


def write_vocab(vocab: DataFrame, path: str) -> None:
    vocab.write.parquet(path)


def run_stamp() -> str:
    return datetime.now(timezone.utc).strftime("%Y%m%d-%H%M%S")


def write_results(results: DataFrame, path: str, stamp: str | None = None) -> None:
    """Score tables appended under their run's time stamp."""
    results.withColumn("run_ts", F.lit(stamp or run_stamp())).write.mode("append").partitionBy("run_ts").parquet(path)
