"""Exact nearest neighbours through pivots and the triangle inequality.

A bounded sample of rows are pivots. Every row belongs to its nearest pivot; rows are written in the order of
(pivot, distance to it), so ``BLOCK`` rows in a row are a ring around a pivot, and the least and greatest
distance of a ring's rows to the pivot bound every distance to them from both sides. A query first meets its own
block, which bounds the distance of its k-th neighbour; the rings that cannot hold anything nearer are left out,
and only the rest is compared. Angle, Poincare and hyperboloid distance are metrics, so nothing is lost. How much is left out depends
on the data: clusters save nearly everything, near-uniform directions in many dimensions nearly nothing.

Queries, rings and blocks meet in groups of bounded size; a task hands on ``k`` rows a query.
"""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from saddle.ordering import global_index
from saddle.skew import lookup_join
from saddle.storage import materialise

BLOCK = 1024
#: Rows a pivot stands for on average, and the most pivots there are.
ROWS_PER_PIVOT, PIVOTS = 512, 2048
#: Queries and rings whose bounds are compared in one group; queries that meet a block together.
QUERIES, RINGS = 1024, 8192
#: Distances differ from exact ones by less than this.
SLACK = 1e-6


def _angle(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(-_cosine_cost(q, m), -1.0, 1.0))


def _cosine_cost(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    qn = np.linalg.norm(q, axis=1, keepdims=True)
    mn = np.linalg.norm(m, axis=1, keepdims=True)
    return -(q @ m.T) / np.maximum(qn * mn.T, 1e-300)


def _poincare_cost(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    q2, m2 = (q * q).sum(1)[:, None], (m * m).sum(1)[None, :]
    gap = np.maximum(q2 + m2 - 2 * (q @ m.T), 0.0)
    room = (1 - q2) * (1 - m2)
    e = np.where((q2 < 1) & (m2 < 1), 2 * gap / np.where(room > 0, room, 1.0), np.inf)
    return np.log1p(e + np.sqrt(e * (e + 2)))


def _lorentz_cost(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    dot = q @ m.T - 2 * np.outer(q[:, 0], m[:, 0])
    return np.arccosh(np.maximum(-dot, 1.0))


Cost = Callable[[np.ndarray, np.ndarray], np.ndarray]
#: By metric, what rows are ranked by, and a distance that rises with it.
COSTS: dict[str, tuple[Cost, Cost]] = {
    "cosine": (_cosine_cost, _angle), "poincare": (_poincare_cost, _poincare_cost), "lorentz": (_lorentz_cost, _lorentz_cost),
}


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


# -- the index -----------------------------------------------------------------------------

class Index:
    """Rows ``(idx, cell, dist, id, v)`` in order, their rings ``(block, cell, near, far, n)``, the pivots and the number of rows."""

    def __init__(self, emb: DataFrame, metric: str):
        rows = emb.select("id", "v")
        self.size, self.distance = rows.count(), COSTS[metric][1]
        wanted = min(PIVOTS, -(-self.size // ROWS_PER_PIVOT))
        sample = rows.orderBy(F.xxhash64("id"), "id").limit(max(1, wanted)).collect()  # at most PIVOTS rows
        self.pivots = emb.sparkSession.sparkContext.broadcast(np.array([r["v"] for r in sample], dtype=np.float64))
        pivots, distance = self.pivots, self.distance

        def assign(batches):
            for rows in batches:
                if not len(rows):
                    continue
                far = distance(_stack(rows["v"]), pivots.value)
                cell = far.argmin(axis=1)
                yield rows.assign(cell=cell.astype(np.int32), dist=far[np.arange(len(rows)), cell])

        kind = rows.schema["v"].dataType.simpleString()
        dealt = rows.mapInPandas(assign, f"id bigint, v {kind}, cell int, dist double")
        self.rows = global_index(dealt, ["cell", "dist", "id"])
        block = F.floor(F.col("idx") / BLOCK)
        self.rings = materialise(self.rows.groupBy(block.alias("block"), "cell").agg(
            F.min("dist").alias("near"), F.max("dist").alias("far"), F.count(F.lit(1)).alias("n")))


def blocks_to_read(index: Index, bounded: DataFrame) -> DataFrame:
    """``(query, block)`` for ``bounded(query, own, reach)``: the blocks with a ring that may hold a row within ``reach``."""
    counts = index.rings.agg(F.count(F.lit(1)).alias("n")).first()["n"], bounded.count()
    ring_parts, query_parts = (max(1, -(-n // size)) for n, size in zip(counts, (RINGS, QUERIES)))

    def each(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = bounded.withColumn("qp", F.pmod(F.xxhash64("query"), F.lit(query_parts)).cast("int")).withColumn("rp", each(ring_parts))
    right = index.rings.withColumn("rp", F.pmod(F.xxhash64("block", "cell"), F.lit(ring_parts)).cast("int")).withColumn("qp", each(query_parts))
    pivots, distance = index.pivots, index.distance

    def choose(ours: pd.DataFrame, rings: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(ours) and len(rings):
            cell, near, far, block = (rings[c].to_numpy() for c in ("cell", "near", "far", "block"))
            for at in range(0, len(ours), 128):
                part = ours.iloc[at:at + 128]
                with np.errstate(invalid="ignore"):
                    to = distance(_stack(part["own"]), pivots.value)[:, cell]
                    # not nearer than this to any row of the ring; without a number nothing is known
                    least = np.nan_to_num(np.maximum(to - far, near - to), nan=0.0, posinf=np.inf)
                q, z = np.nonzero(~(least > part["reach"].to_numpy()[:, None] + SLACK))
                found.append(pd.DataFrame({"query": part["query"].to_numpy()[q], "block": block[z]}))
        return pd.concat(found).drop_duplicates() if found else pd.DataFrame({"query": np.zeros(0, np.int64), "block": np.zeros(0, np.int64)})

    return left.groupBy("qp", "rp").cogroup(right.groupBy("qp", "rp")).applyInPandas(choose, "query long, block long").distinct()


def _meet(rows: DataFrame, asked: DataFrame, k: int, cost: Cost, slices: int) -> DataFrame:
    """``(query, id, cost)``: for ``asked(query, own, block)`` the ``k`` nearest other rows of each block."""
    asked = asked.withColumn("slice", F.pmod(F.xxhash64("query"), F.lit(slices)).cast("int"))
    # names of their own, as both sides come from the same rows
    wanted = asked.select(F.col("block").alias("held"), F.col("slice").alias("by")).distinct()
    held = rows.select(F.floor(F.col("idx") / BLOCK).alias("held"), "id", "v").join(wanted, "held")

    def best(ours: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if not len(ours) or not len(theirs):
            return pd.DataFrame({"query": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "cost": np.zeros(0)})
        qid, ids = ours["query"].to_numpy(), theirs["id"].to_numpy()
        c = cost(_stack(ours["own"]), _stack(theirs["v"]))
        c[qid[:, None] == ids[None, :]] = np.inf
        last = np.partition(c, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1]
        row, col = np.nonzero(~(c > last[:, None]) & (qid[:, None] != ids[None, :]))  # ties of the last one too
        order = np.lexsort((ids[col], c[row, col], row))
        row, col = row[order], col[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        row, col = row[nth < k], col[nth < k]
        return pd.DataFrame({"query": qid[row], "id": ids[col], "cost": c[row, col]})

    return asked.groupBy("block", "slice").cogroup(held.groupBy("held", "by")).applyInPandas(best, "query long, id long, cost double")


def nearest(emb: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine") -> DataFrame:
    """``(query, id, score, rank)``: for every id of ``queries(id)`` the ``k`` nearest other rows of ``emb(id, v)``.

    Score is the cosine, or the curved distance; ties go to smaller ids.
    """
    cost = COSTS[metric][0]
    index = Index(emb, metric)
    own = lookup_join(index.rows, queries.select("id").distinct(), "id", "left_semi")
    asked = own.select(F.col("id").alias("query"), F.col("v").alias("own"), F.floor(F.col("idx") / BLOCK).alias("block"))
    slices = max(1, -(-asked.count() // QUERIES))
    first = materialise(_meet(index.rows, asked, k, cost, slices))
    # the k-th of the first k rows found bounds the search, as a distance; fewer leave it open
    found = F.count(F.lit(1)) >= k
    reach = F.when(found, F.acos(F.greatest(F.least(-F.max("cost"), F.lit(1.0)), F.lit(-1.0))) if metric == "cosine" else F.max("cost")).otherwise(F.lit(float("inf")))
    bounded = asked.join(first.groupBy("query").agg(reach.alias("reach")), "query", "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf"))))
    rest = blocks_to_read(index, bounded.select("query", "own", "reach")).join(asked.select("query", "own", F.col("block").alias("seen")), "query")
    more = _meet(index.rows, rest.where("block <> seen").select("query", "own", "block"), k, cost, slices)
    window = Window.partitionBy("query").orderBy("cost", "id")
    score = -F.col("cost") if metric == "cosine" else F.col("cost")
    return (
        first.unionByName(more).withColumn("rank", F.row_number().over(window))
        .where(F.col("rank") <= k)
        .select("query", "id", score.alias("score"), "rank")
    )
