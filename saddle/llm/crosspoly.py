"""Near-equal vectors by cross-polytope hashing.

A vector is turned by random signs and fast Hadamard transforms, three times over, and hashed to the
nearest of the 2 d signed axes. A table's code joins ``JOINED`` such hashes; a vector stands in the
bucket of its code and in those where one hash is replaced by the second-nearest axis. The number of
tables is chosen by simulation: pairs of exactly the threshold's cosine must share a bucket with a
probability of ``RECALL``; closer pairs do so more often. Where that needs more than ``MOST_TABLES``
tables, the search is refused.

Only a sketch of signs goes into the buckets at first. Rows that have a partner there within four
deviations of the threshold's angle then get their vectors, and all pairs of these in a bucket are
compared by cosine in double precision. Equal vectors are one class, and only classes are compared. A
pair is counted in the first bucket that it shares, known from both codes, and nowhere else: numbers
of links need no list of pairs. From a bucket come these numbers and star edges over what it connects. Buckets of
more than ``BLOCK`` classes are compared in pairs of blocks, each a group of its own.

Vectors that are null, zero, empty or hold null or non-finite numbers link with nothing, nor do
vectors of different lengths. Repeated rows and ids are kept and link as equal vectors. Other columns
are not read. An empty table gives an empty result.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saddle.llm.buckets import by_runs, forest, run_pairs
from saddle.llm.components import connected_components
from saddle.storage import materialise

JOINED = 2
RECALL = 0.999
MOST_TABLES = 64
#: Longs of signs that rows of a bucket are first compared by.
WORDS = 2
BLOCK = 2048
SEED = 20


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of every row; the width is a power of two."""
    n, width = x.shape
    half = 1
    while half < width:
        pairs = x.reshape(n, width // (2 * half), 2, half)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, width)
        half *= 2
    return x


def codes(x: np.ndarray, table: int) -> np.ndarray:
    """(rows, 1 + JOINED): a row's own code in a table and its probes."""
    width = 1 << max(0, int(x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    best, second = [], []
    for part in range(JOINED):
        rng = np.random.default_rng([SEED, table, part])
        y = x
        for _ in range(3):
            y = hadamard(y * rng.choice([-1.0, 1.0], width))
        size = np.abs(y)
        for out in (best, second):
            axis = size.argmax(axis=1)
            at = np.arange(len(y)), axis
            out.append(2 * axis + (y[at] > 0))
            size[at] = -1
    own = [best, *[[second[q] if q == p else best[q] for q in range(JOINED)] for p in range(JOINED)]]
    return np.stack([sum(h.astype(np.int64) * (2 * width) ** q for q, h in enumerate(hashes)) for hashes in own], axis=1)


def tables_needed(dim: int, cosine: float, recall: float = RECALL, pairs: int = 2000) -> int:
    """Tables after which a pair of exactly this cosine shares a bucket with probability ``recall``."""
    rng = np.random.default_rng(SEED)
    a, b = rng.normal(size=(2, pairs, dim))
    a /= np.linalg.norm(a, axis=1)[:, None]
    if dim > 1:
        b -= (a * b).sum(axis=1)[:, None] * a
        b = cosine * a + np.sqrt(1 - cosine ** 2) * b / np.linalg.norm(b, axis=1)[:, None]
    else:
        b = a
    met = np.mean([(codes(a, t)[:, :, None] == codes(b, t)[:, None, :]).any(axis=(1, 2)).mean() for t in range(4)])
    needed = int(np.ceil(np.log(1 - recall) / np.log(1 - np.clip(met, 1e-6, 0.999))))
    if needed > MOST_TABLES:
        raise ValueError(f"a cosine of {cosine} in {dim} dimensions needs {needed} tables for a recall of {recall}; at most {MOST_TABLES} are built")
    return max(1, needed)


def _first_shared(x: np.ndarray, y: np.ndarray, bucket: np.ndarray, each: int) -> np.ndarray:
    """Whether ``bucket`` is the pair's first shared one, over tables in order and codes within a table by size."""
    table = bucket // (1 << 40)
    first = np.ones(len(x), dtype=bool)
    for t in range(x.shape[1] // each):
        own = slice(t * each, (t + 1) * each)
        same = x[:, own][:, :, None] == y[:, own][:, None, :]
        least = np.where(same.any(axis=2), x[:, own], np.iinfo(np.int64).max).min(axis=1)
        first &= np.where(table > t, least == np.iinfo(np.int64).max, np.where(table == t, least == bucket, True))
    return first


def _close(unit: np.ndarray, starts: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows of a run with at least this cosine."""
    ends = np.append(starts[1:], len(unit))
    wide = ends - starts > 48
    for lo, hi in zip(starts[wide].tolist(), ends[wide].tolist()):
        for at in range(lo, hi, 512):
            to = min(at + 512, hi)
            near = unit[at:to] @ unit[lo:to].T >= cosine
            i, j = np.nonzero(near)
            i, j = i + at, j + lo
            yield i[j < i], j[j < i]
    if not wide.all():
        # the small runs side by side
        keep = np.flatnonzero(np.repeat(~wide, ends - starts))
        sizes = (ends - starts)[~wide]
        for i, j in run_pairs(np.cumsum(sizes) - sizes, len(keep), 1 << 15):
            i, j = keep[i], keep[j]
            ok = np.einsum("ij,ij->i", unit[i], unit[j]) >= cosine
            yield i[ok], j[ok]


def sketches(x: np.ndarray) -> np.ndarray:
    """(rows, WORDS) of 64 signs each, of inner products with random directions."""
    plane = np.random.default_rng([SEED, x.shape[1]]).normal(size=(x.shape[1], 64 * WORDS))
    return np.packbits(x @ plane > 0, axis=1).view(np.int64).reshape(len(x), WORDS)


def sketch_limit(cosine: float) -> int:
    """Signs that a pair of this cosine may differ in: four deviations above the mean, so that about one pair in thirty thousand is beyond."""
    p = np.arccos(cosine) / np.pi
    return int(np.ceil(64 * WORDS * p + 4 * np.sqrt(64 * WORDS * p * (1 - p))))


def _matrix(batch: pa.RecordBatch | pa.Table, dim: int) -> np.ndarray:
    lists = batch["vector"]
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    return lists.flatten().to_numpy().astype(np.float64).reshape(-1, dim)


def _all_codes(x: np.ndarray, tables: int) -> np.ndarray:
    return np.concatenate([codes(x, t) + (t << 40) for t in range(tables)], axis=1)


def _links(classes: DataFrame, dim: int, cosine: float) -> DataFrame:
    """``(a, b, n)``: star edges with n = 0, and (a, a, n) for n rows linked to class a."""
    tables, each, limit = tables_needed(dim, cosine), 1 + JOINED, sketch_limit(cosine)
    signs = [f"s{w}" for w in range(WORDS)]

    def hashed(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                x = _matrix(part, dim)
                found = np.sort(_all_codes(x, tables), axis=1)
                fresh = np.concatenate([np.ones((len(x), 1), bool), found[:, 1:] != found[:, :-1]], axis=1)
                row = np.nonzero(fresh)[0]
                sketch = sketches(x)[row]
                yield pa.RecordBatch.from_arrays([pa.array(found[fresh]), part["node"].take(pa.array(row)), *[pa.array(np.ascontiguousarray(c)) for c in sketch.T]],
                                                 ["bucket", "node", *signs])

    standing = materialise(classes.select("node", "vector").mapInArrow(hashed, "bucket bigint, node bigint, " + ", ".join(f"{c} bigint" for c in signs)))
    crowded = (standing.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"))
               .where(F.col("rows") > BLOCK).select("bucket", F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks")))
    dealt = standing.join(crowded, "bucket", "left")
    dealt = dealt.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("bucket", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", *signs)

    def partnered(table, starts):
        """The rows of runs that have a partner by sketch; vectors come for these only."""
        low, high, own = (table[c].to_numpy() for c in ("low", "high", "own"))
        sketch = [table[c].to_numpy().view(np.uint64) for c in signs]
        kept = np.zeros(table.num_rows, dtype=bool)
        for i, j in run_pairs(starts, table.num_rows):
            far = sum(np.bitwise_count(c[i] ^ c[j]).astype(np.int32) for c in sketch)
            ok = (far <= limit) & ((low[i] == high[i]) | (own[i] != own[j]))
            kept[i[ok]] = kept[j[ok]] = True
        if kept.any():
            yield table.select(["bucket", "low", "high", "own", "node"]).filter(pa.array(kept)).combine_chunks().to_batches()[0]

    def compare(table, starts):
        bucket, low, high, own, node, n = (table[c].to_numpy() for c in ("bucket", "low", "high", "own", "node", "n"))
        x = _matrix(table, dim)
        unit = x / np.linalg.norm(x, axis=1)[:, None]
        code, coded = np.zeros((len(x), tables * each), dtype=np.int64), np.zeros(len(x), dtype=bool)
        for i, j in _close(unit, starts, cosine):
            ok = (low[i] == high[i]) | (own[i] != own[j])
            i, j = i[ok], j[ok]
            # codes of rows that have a link, made again here, as they would outweigh the vectors on the way
            fresh = np.unique(np.concatenate([i, j]))
            fresh = fresh[~coded[fresh]]
            code[fresh], coded[fresh] = _all_codes(x[fresh], tables), True
            fresh = np.zeros(len(i), dtype=bool)
            for at in range(0, len(i), 1 << 14):
                part = slice(at, at + (1 << 14))
                fresh[part] = _first_shared(code[i[part]], code[j[part]], bucket[i[part]], each)
            i, j = i[fresh], j[fresh]
            if not len(i):
                continue
            a, b = forest(node[i], node[j])
            rows, back = np.unique(np.concatenate([i, j]), return_inverse=True)
            total = np.bincount(back, np.concatenate([n[j], n[i]])).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([a, node[rows]])), pa.array(np.concatenate([b, node[rows]])),
                 pa.array(np.concatenate([np.zeros(len(a), np.int64), total]))], ["a", "b", "n"])

    keys = ["bucket", "low", "high"]
    light = dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(
        lambda batches: by_runs(batches, keys, partnered), "bucket bigint, low int, high int, own int, node bigint")
    runs = light.join(classes.select("node", "n", "vector"), "node").repartition(*keys).sortWithinPartitions(*keys)
    return runs.mapInArrow(lambda batches: by_runs(batches, keys, compare), "a bigint, b bigint, n bigint")


def near_vectors(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    ``n_links`` counts the other rows with at least this cosine, ``component_id`` is the smallest id
    reachable by links and ``kept`` marks the row that has it.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    usable = F.coalesce((F.size("vector") > 0) & finite & F.exists("vector", lambda v: v != 0), F.lit(False))
    rows = rows.withColumn("usable", usable)
    classes = materialise(rows.where("usable").groupBy("vector").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("n"))
                          .withColumn("node", F.monotonically_increasing_id()))
    dims = [r[0] for r in classes.select(F.size("vector")).distinct().collect()]  # lengths, not vectors
    if dims:
        found = materialise(reduce(DataFrame.unionByName, [_links(classes.where(F.size("vector") == d), d, cosine) for d in dims]))
        links = found.where("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("linked"))
        named = connected_components(found.where("a != b").select("a", "b"))
        lows = named.join(classes.select("node", "low"), "node").groupBy("root").agg(F.min("low").alias("least"))
        groups = classes.join(links, "node", "left").join(named.join(lows, "root").select("node", "least"), "node", "left")
        groups = groups.select("vector", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                               F.coalesce("least", "low").alias("component_id"))
    else:
        groups = classes.select("vector", F.lit(0).cast("bigint").alias("n_links"), F.col("low").alias("component_id"))
    linked = rows.where("usable").join(groups, "vector").select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT usable").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
