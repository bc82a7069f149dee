"""op1, op8, op9 and op10 over documents."""
from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saddle.llm import bpe, quality
from saddle.llm.registry import query, table
from saddle.llm.simhash import near_groups
from saddle.llm.tiling import contaminated


@query("op8_simhash_groups")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    groups = near_groups(table(spark, sf, "documents"), size=3, radius=3)
    return groups.select("doc_id", F.lower(F.lpad(F.hex(F.get("fp", F.lit(0))), 16, "0")).alias("fingerprint"), "component_id")


@query("op1_string_tiling")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold at least half of a benchmark item, in whatever order."""
    return contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark")).drop("key_1", "key_2")


#: The vocabulary file of op9 and the pipeline.
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def token_digests(encoded: DataFrame, config: str) -> DataFrame:
    """``doc_id, n_tokens, ids, ids_sha256, decoded_sha256`` of encoded rows; the digest of the text is of the decoded ids."""
    kind = encoded.schema["doc_id"].dataType.simpleString()
    shared = encoded.sparkSession.sparkContext.broadcast(config)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = bpe.Tokenizer(shared.value)
        for batch in batches:
            n, ids, texts = [], [], []
            for row in batch["ids"]:
                own = row.values.to_numpy()
                n.append(len(own))
                ids.append(sha256(own.astype("<u4").tobytes()).hexdigest())
                texts.append(sha256(tokenizer.decode(own.tolist()).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.array(n, dtype=np.int64)), batch["ids"], pa.array(ids, pa.string()),
                                              pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"])

    return encoded.select("doc_id", "ids").mapInArrow(
        work, f"doc_id {kind}, n_tokens bigint, ids array<int>, ids_sha256 string, decoded_sha256 string")


@query("op9_bpe_automaton")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    config = bpe.read_config(spark, VOCABULARY)
    return token_digests(bpe.encode(table(spark, sf, "documents"), config), config).drop("ids")


@query("op10_byte_convolution")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf, "labels")))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))
