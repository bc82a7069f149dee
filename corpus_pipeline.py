"""A corpus pipeline of five stages: quality, near copies, benchmark passages, secrets, tokens.

Each stage is a function of (spark, docs, sf_dir). ``run`` writes every stage's rows to the shared
folder and reads them again as the next one's documents, so a lost executor costs one stage. All but
the last stage keep the columns of documents, whatever else these are; stages read ``doc_id``, ``text`` and
``n_chars``. A null text counts as empty. An empty table passes every stage.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saddle.llm import bpe, credentials, quality, rows, simhash, tiling
from saddle.llm.queries_text import VOCABULARY, token_digests
from saddle.storage import materialise


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, does not reject."""
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near copies: 3-word fingerprints linked at 3 or fewer differing bits.

    Repeated rows stay once; texts without words are one group.
    """
    return simhash.first_of_groups(docs, size=3, radius=3)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return rows.drop_rows(docs, tiling.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of every credential; ``n_chars`` counts the new text."""
    clean = credentials.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document and the digests of ids and decoded text."""
    config = bpe.read_config(spark, VOCABULARY)
    return token_digests(bpe.encode(docs, config), config)


STAGES = [
    ("quality", good_quality),
    ("near copies", without_copies),
    ("benchmark", without_benchmark),
    ("secrets", without_secrets),
    ("tokens", as_tokens),
]

#: No SQL: the classifier and the fingerprint groups cannot be expressed; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
