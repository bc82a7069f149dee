"""Token sequences: co-views, per-customer views, sessions and random walks.

Sequences are kept long, one row per token ``(sentence_id, pos, token)``, so a product that
a third of all customers viewed is many rows and never one value. Arrays appear only where
a parameter bounds them (walks).
"""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from saddle.functions.uniform import uniform
from saddle.operators.graph import degree
from saddle.ordering import counted, global_index
from saddle.skew import grouped_rank, lookup_join
from saddle.storage import bucketed, materialise


# -- ids -----------------------------------------------------------------------------------

def index_ids(df: DataFrame, id_col: str, time_col: str) -> DataFrame:
    """``(id, idx)`` with contiguous idx from 0 by first appearance, ties by id."""
    first = df.groupBy(id_col).agg(F.min(time_col).alias("first_seen"))
    return global_index(first, ["first_seen", id_col], "idx").select(F.col(id_col).alias("id"), "idx")


def id2idx(df: DataFrame, index: DataFrame, id_col: str) -> DataFrame:
    return lookup_join(df, index.withColumnRenamed("id", id_col), id_col, "inner")


def idx2id(df: DataFrame, index: DataFrame, idx_col: str = "idx") -> DataFrame:
    return lookup_join(df, index.withColumnRenamed("idx", idx_col), idx_col, "inner")


# -- co-views ------------------------------------------------------------------------------

def token_sequences(views: DataFrame, key: str, token: str, order: list[str], drop_single: bool = True) -> DataFrame:
    """``(sentence_id, pos, token)``: the tokens of each key in ``order``, from position 0."""
    rows = views.select(F.col(key).alias("sentence_id"), F.col(token).alias("token"),
                        *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    ranked = counted(rows, ["sentence_id"], [F.col(f"_o{i}") for i in range(len(order))], "_at", last="_last" if drop_single else None)
    if drop_single:
        ranked = ranked.where(~((F.col("_at") == 1) & F.col("_last")))
    return ranked.select("sentence_id", (F.col("_at") - 1).alias("pos"), "token")


def coview_sentences(views: DataFrame) -> DataFrame:
    """Per product, the customers who viewed it in time order; single views carry no information."""
    return token_sequences(views, "product_id", "customer_id", ["date_viewed", "customer_id"], True)


def customer_sentences(views: DataFrame) -> DataFrame:
    """Per customer, the products viewed in time order."""
    return token_sequences(views, "customer_id", "product_id", ["date_viewed", "product_id"], False)


# -- sessions ------------------------------------------------------------------------------

def sessionize(events: DataFrame, user: str, ts: str, tie: str, gap_seconds: float = 3600.0) -> DataFrame:
    """Adds ``session_no`` (from 1 per user): a gap of more than ``gap_seconds`` opens a session.

    Events are sorted by ranges of (user, time), so a user's events may fill many tasks.
    """
    return counted(events, [user], [F.col(ts), F.col(tie)], "session_no", F.unix_micros(F.col(ts).cast("timestamp")), math.floor(gap_seconds * 1_000_000))


def session_sentences(sessions: DataFrame, user: str, ts: str, tie: str, token: str) -> DataFrame:
    """Tokens of each session in order, sessions of one token dropped."""
    keyed = sessions.withColumn("_session", F.concat_ws(":", F.col(user), F.col("session_no")))
    return token_sequences(keyed, "_session", token, [ts, tie], True)


# -- random walks --------------------------------------------------------------------------

def walk_table(edges: DataFrame) -> DataFrame:
    """``(src, nbr, dst, dst_deg)``: numbered neighbours that also carry the neighbour's degree.

    A walk that knows its vertex' degree picks its neighbour number by itself, so each step is one
    join on ``(src, nbr)``. On an undirected graph that key is hit evenly however large a hub is.
    """
    ranked = grouped_rank(edges, ["src"], [F.col("dst")], "nbr", 0)
    degrees = degree(edges).select(F.col("src").alias("dst"), F.col("deg").alias("dst_deg"))
    return lookup_join(ranked, degrees, "dst", "left")


def random_walks(edges: DataFrame, num_walks: int, walk_length: int, seed: str = "walk",
                 block: int = 8) -> DataFrame:
    """``(start, walk_no, path)``: uniform walks of ``walk_length`` vertices from every vertex.

    Steps run in blocks; after each block the walks are written and only their current vertex
    goes on, so rows stay narrow and lineage short.
    """
    table = materialise(walk_table(materialise(edges.select("src", "dst").distinct())))
    if not table.where("dst_deg is null").isEmpty():
        raise ValueError("every vertex needs an out-edge; prune_disconnected first")
    state = degree(table).select(
        F.col("src").alias("start"), F.explode(F.sequence(F.lit(0), F.lit(num_walks - 1))).alias("walk_no"),
        F.col("src").alias("cur"), F.col("deg").alias("cur_deg"), F.array("src").alias("path"),
    )
    # stored by the step's key, so a step moves walks and never edges
    steps = bucketed(table.select(F.col("src").alias("cur"), F.col("nbr").alias("pick"),
                                  F.col("dst").alias("next"), F.col("dst_deg").alias("next_deg")), "cur", "pick")
    blocks = []
    for step in range(1, walk_length):
        u = uniform(seed, "start", "walk_no", F.lit(step))
        state = (
            state.withColumn("pick", F.floor(u * F.col("cur_deg")).cast("bigint"))
            .join(steps, ["cur", "pick"])
            .select("start", "walk_no", F.col("next").alias("cur"), F.col("next_deg").alias("cur_deg"),
                    F.concat("path", F.array("next")).alias("path"))
        )
        if step % block == 0 and step < walk_length - 1:
            written = materialise(state)
            blocks.append(written.select("start", "walk_no", F.lit(len(blocks)).alias("b"), "path"))
            state = written.withColumn("path", F.slice("path", 1, 0))
    tail = state.select("start", "walk_no", F.lit(len(blocks)).alias("b"), "path")
    if not blocks:
        return tail.select("start", "walk_no", "path")
    for part in blocks:
        tail = tail.unionByName(part)
    packed = tail.groupBy("start", "walk_no").agg(F.sort_array(F.collect_list(F.struct("b", "path"))).alias("p"))
    return packed.select("start", "walk_no", F.flatten(F.col("p.path")).alias("path"))


def walk_tokens(walks: DataFrame) -> DataFrame:
    """Walks as long token rows, named ``start:walk_no``."""
    named = walks.select(F.concat_ws(":", "start", "walk_no").alias("sentence_id"), "path")
    return named.select("sentence_id", F.posexplode("path").alias("pos", "token")).withColumn(
        "pos", F.col("pos").cast("bigint")
    )


def shuffle_walks(walks: DataFrame, seed: str = "shuffle") -> DataFrame:
    """A reproducible random order, as the column ``place``."""
    keyed = walks.withColumn("_u", uniform(seed, "start", "walk_no"))
    return global_index(keyed, ["_u", "start", "walk_no"], "place").drop("_u")


def walk_prefixes(walks: DataFrame, length: int, per_vertex: int) -> DataFrame:
    """The first ``per_vertex`` walks of every vertex, cut to ``length`` vertices."""
    return walks.where(F.col("walk_no") < per_vertex).withColumn("path", F.slice("path", 1, length))
