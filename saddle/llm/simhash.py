"""Near copies by SimHash fingerprints, found through a generalised pigeonhole index.

A fingerprint has 64 bits for each word of it; a bit is set if it is set in over half of the
hashes of a text's word shingles. Texts with equal fingerprints are one class, and only classes are
compared.

The index cuts the bits into partitions of ``WIDTH`` bits. Bits that go together over the corpus
are put into the same partition, so that the others differ freely. A partition with threshold e
brings two classes together when they differ there in at most e bits; a pair within ``radius`` is
always found when the sum of (e + 1) exceeds ``radius``, as at least one partition must then hold a
small enough part of its differing bits. Dynamic programming gives the thresholds the least
estimated work, from the sizes that every bucket would have under each threshold; a partition whose
keys are too crowded gets none and others take over its share.

A class stands in the bucket of its key and of every key with up to e further bits set. Two keys
that differ in at most e bits meet in the bucket of their union, so all pairs of a bucket are
compared, and nothing else needs probing. Bucket sizes are known from the same statistics: a bucket
of more than ``BLOCK`` classes is compared in pairs of blocks, each a group of its own. From a
bucket come star edges over what it connects, never all its pairs.

Null and empty texts have the fingerprint zero and are linked like any other. Repeated rows and
ids are kept. Other columns are not read. An empty table gives an empty result.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saddle.llm.buckets import by_runs, forest, run_pairs
from saddle.llm.components import connected_components
from saddle.llm.rows import keep_once, key_columns
from saddle.llm.textbytes import Words, remix, slices, xxh64
from saddle.storage import materialise

WIDTH = 16
BLOCK = 4096
#: Work of standing in a bucket, in comparisons.
ROW_COST = 40
MOST = 2  # largest threshold of a partition
SHINGLES_AT_ONCE = 1 << 16


# -- fingerprints --------------------------------------------------------------------------

def fingerprint(texts: pa.Array, size: int, words: int = 1) -> np.ndarray:
    """(rows, words) of unsigned 64-bit numbers. Word 0 is made from XXH64 itself, the others from remixed hashes."""
    found = Words(texts)
    doc, start, end = found.shingles(size)
    votes = np.zeros((found.rows, 64 * words), dtype=np.int64)
    for lo in range(0, len(doc), SHINGLES_AT_ONCE):
        part = slice(lo, lo + SHINGLES_AT_ONCE)
        h, own = xxh64(found.buf, start[part], end[part]), doc[part]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        for w in range(words):
            bits = np.unpackbits((remix(h, w) if w else h).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            votes[own[first], 64 * w:64 * (w + 1)] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    total = np.bincount(doc, minlength=found.rows)[:, None]
    return np.packbits(2 * votes > total, axis=1).view(">u8").astype(np.uint64).reshape(found.rows, words)


def fingerprints(docs: DataFrame, size: int, words: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``key_1, key_2, doc_id, fp`` (an array of ``words`` longs)."""
    rows = docs.select(*key_columns(id_col, text_col), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch["text"]):
                fp = fingerprint(texts, size, words).view(np.int64).ravel()
                part = batch.slice(at, len(texts))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(fp) + 1, words), pa.int32()), pa.array(fp))
                yield pa.RecordBatch.from_arrays([part["key_1"], part["key_2"], part["doc_id"], lists], ["key_1", "key_2", "doc_id", "fp"])

    return rows.mapInArrow(work, f"key_1 bigint, key_2 int, doc_id {kind}, fp array<bigint>")


# -- the index -----------------------------------------------------------------------------

def _matrix(batch: pa.RecordBatch, words: int) -> np.ndarray:
    return batch["fp"].flatten().to_numpy().view(np.uint64).reshape(-1, words)


def _bits(fp: np.ndarray) -> np.ndarray:
    """(rows, 64 * words), bit 0 the lowest of word 0."""
    return np.unpackbits(fp.astype("<u8").view(np.uint8).reshape(len(fp), -1), axis=1, bitorder="little")


def _keys(bits: np.ndarray, members: tuple[int, ...]) -> np.ndarray:
    return bits[:, list(members)].astype(np.int32) @ (1 << np.arange(len(members), dtype=np.int32))


@dataclass(frozen=True)
class Index:
    partitions: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]
    blocks: np.ndarray  # (partitions, keys): groups that a bucket's rows are dealt over


def bit_counts(classes: DataFrame, words: int) -> np.ndarray:
    """Over all classes, how often two bits are both set."""
    n = 64 * words

    def work(batches):
        total = np.zeros((n, n), dtype=np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                bits = _bits(_matrix(batch.slice(lo, 4096), words)).astype(np.float32)
                total += (bits.T @ bits).astype(np.int64)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.int64()))], ["n"])

    sums = classes.select("fp").mapInArrow(work, "n array<bigint>").select(F.posexplode("n").alias("at", "n"))
    out = np.zeros(n * n, dtype=np.int64)
    found = sums.groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # one row per pair of bits
    out[found["at"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(n, n)


def group_bits(together: np.ndarray, rows: int, width: int = WIDTH) -> tuple[tuple[int, ...], ...]:
    """Partitions of ``width`` bits; each starts at the free bit with the strongest tie and takes the bits most tied to it."""
    share = together / max(rows, 1)
    p = np.diag(share)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    tie = np.abs(share - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(tie, 0)
    free, out = list(range(len(p))), []
    while free:
        own = tie[np.ix_(free, free)]
        members = [free[int(own.max(axis=1).argmax())]]
        while len(members) < min(width, len(free)):
            rest = [b for b in free if b not in members]
            members.append(rest[int(tie[np.ix_(members, rest)].mean(axis=0).argmax())])
        out.append(tuple(sorted(members)))
        free = [b for b in free if b not in members]
    return tuple(out)


def key_counts(classes: DataFrame, words: int, partitions) -> np.ndarray:
    """Over all classes, rows per key of each partition."""
    def work(batches):
        total = np.zeros((len(partitions), 1 << WIDTH), dtype=np.int64)
        for batch in batches:
            bits = _bits(_matrix(batch, words))
            for i, members in enumerate(partitions):
                total[i] += np.bincount(_keys(bits, members), minlength=1 << WIDTH)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total.ravel()[at])], ["at", "n"])

    sums = classes.select("fp").mapInArrow(work, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n"))
    found = sums.toArrow()  # at most one row per key and partition
    out = np.zeros(len(partitions) << WIDTH, dtype=np.int64)
    out[found["at"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(len(partitions), -1)


def bucket_sizes(counts: np.ndarray, width: int, threshold: int) -> np.ndarray:
    """Rows per bucket when every key stands in all buckets with up to ``threshold`` more bits set."""
    by_level = [counts] + [np.zeros_like(counts) for _ in range(threshold)]
    keys = np.arange(len(counts))
    for bit in range(width):
        has = keys[(keys >> bit) & 1 == 1]
        for level in range(threshold, 0, -1):
            by_level[level] = by_level[level].copy()
            by_level[level][has] += by_level[level - 1][has ^ (1 << bit)]
    return sum(by_level)


def allocate(costs: np.ndarray, radius: int) -> tuple[int, ...]:
    """Thresholds (-1: unused) with the least total cost whose (e + 1) add up to ``radius`` + 1; ``costs[i][e + 1]``."""
    need = radius + 1
    best = np.full(need + 1, np.inf)
    best[0], choice = 0.0, []
    for row in costs:
        new, took = np.full(need + 1, np.inf), np.zeros(need + 1, dtype=int)
        for units, cost in enumerate(row):
            for have in range(need + 1):
                to = min(need, have + units)
                if best[have] + cost < new[to]:
                    new[to], took[to] = best[have] + cost, units * (need + 1) + have
        best = new
        choice.append(took)
    if not np.isfinite(best[need]):
        raise ValueError(f"thresholds up to {MOST} in {len(costs)} partitions cannot cover a radius of {radius}")
    out, at = [], need
    for took in reversed(choice):
        units, at = divmod(int(took[at]), need + 1)
        out.append(units - 1)
    return tuple(reversed(out))


def build_index(classes: DataFrame, words: int, radius: int) -> Index:
    rows = classes.count()
    partitions = group_bits(bit_counts(classes, words), rows)
    counts = key_counts(classes, words, partitions)
    sizes, costs = [], np.zeros((len(partitions), MOST + 2))
    for i, members in enumerate(partitions):
        sizes.append([bucket_sizes(counts[i], len(members), e) for e in range(MOST + 1)])
        for e in range(MOST + 1):
            n = sizes[i][e].astype(float)
            costs[i][e + 1] = (n * (n - 1) / 2).sum() + ROW_COST * n.sum()
    thresholds = allocate(costs, radius)
    blocks = np.array([np.ceil(sizes[i][max(e, 0)] / BLOCK) for i, e in enumerate(thresholds)])
    return Index(partitions, thresholds, np.maximum(blocks, 1).astype(np.int32))


# -- links ---------------------------------------------------------------------------------

def _deal(bucket: np.ndarray, nodes: np.ndarray, fp: np.ndarray, blocks: np.ndarray) -> pa.RecordBatch:
    """Rows (bucket, pair of blocks, own block, node, fp); a bucket of one block has the pair (0, 0)."""
    mine = (nodes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % blocks
    copies = np.repeat(np.arange(len(bucket)), blocks)
    other = np.arange(len(copies)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    own = mine[copies]
    pair = (np.minimum(own, other) << 16) | np.maximum(own, other)
    columns = [bucket[copies].astype(np.int32), pair.astype(np.int32), own.astype(np.int32), nodes[copies],
               *[fp[copies, w].view(np.int64) for w in range(fp.shape[1])]]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns],
                                      ["bucket", "pair", "own", "node", *[f"f{w}" for w in range(fp.shape[1])]])


def links(classes: DataFrame, index: Index, words: int, verify: int) -> DataFrame:
    """Edges ``(a, b)`` between nodes of ``classes(node, fp)`` that connect all found pairs within ``verify`` bits."""
    shared = classes.sparkSession.sparkContext.broadcast((index.partitions, index.thresholds, index.blocks))
    fields = [f"f{w}" for w in range(words)]

    def deal(batches):
        partitions, thresholds, blocks = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                fp, nodes = _matrix(part, words), part["node"].to_numpy()
                bits = _bits(fp)
                for i, (members, e) in enumerate(zip(partitions, thresholds)):
                    keys = _keys(bits, members)
                    for n in range(e + 1):
                        for flips in combinations(range(len(members)), n):
                            mask = sum(1 << f for f in flips)
                            at = np.flatnonzero(keys & mask == 0)
                            if len(at):
                                yield _deal((i << WIDTH) + (keys[at] | mask), nodes[at], fp[at], blocks[i][keys[at] | mask])

    def merged(batches):
        held, rows = [], 0
        for batch in deal(batches):
            held.append(batch)
            rows += batch.num_rows
            if rows >= 1 << 16:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, rows = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    def compare(table, starts):
        pair, own, node = (table[c].to_numpy() for c in ("pair", "own", "node"))
        fp = [table[f].to_numpy().view(np.uint64) for f in fields]
        across = (pair >> 16) != (pair & 0xFFFF)
        for left, right in run_pairs(starts, table.num_rows):
            far = np.bitwise_count(fp[0][left] ^ fp[0][right])
            ok = far <= verify
            if across.any():
                ok &= ~across[left] | (own[left] != own[right])
            left, right, far = left[ok], right[ok], far[ok].astype(np.int32)
            for word in fp[1:]:
                far += np.bitwise_count(word[left] ^ word[right])
            left, right = left[far <= verify], right[far <= verify]
            if len(left):
                a, b = forest(node[left], node[right])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    dealt = classes.select("node", "fp").mapInArrow(
        merged, "bucket int, pair int, own int, node bigint, " + ", ".join(f"{f} bigint" for f in fields))
    sorted_runs = dealt.repartition("bucket", "pair").sortWithinPartitions("bucket", "pair")
    return sorted_runs.mapInArrow(lambda batches: by_runs(batches, ["bucket", "pair"], compare), "a bigint, b bigint")


def near_groups(docs: DataFrame, size: int, radius: int, words: int = 1, verify: int | None = None,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``key_1, key_2, doc_id, fp, group, component_id``.

    Classes are linked when they differ in at most ``verify`` bits (``radius`` if not given). All
    pairs within ``radius`` are found; of pairs between ``radius`` and ``verify`` those that some
    partition brings together. ``component_id`` is the smallest doc_id of all linked documents,
    ``group`` a number of theirs that also tells groups without any id apart.
    """
    rows = materialise(fingerprints(docs, size, words, id_col, text_col))
    classes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("low")).withColumn("node", F.monotonically_increasing_id()))
    found = links(classes, build_index(classes, words, radius), words, radius if verify is None else verify)
    named = connected_components(found)
    lows = named.join(classes.select("node", "low"), "node").groupBy("root").agg(F.min("low").alias("least"))
    linked = named.join(lows, "root").select("node", "root", "least")
    groups = classes.join(linked, "node", "left").select(
        "fp", F.coalesce("root", "node").alias("group"), F.when(F.col("root").isNull(), F.col("low")).otherwise(F.col("least")).alias("component_id"))
    return rows.join(groups, "fp").select("key_1", "key_2", "doc_id", "fp", "group", "component_id")


def first_of_groups(docs: DataFrame, size: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row of the smallest id of each group of near copies, with the columns of ``docs``; repeated rows stay once.

    Groups are those of ``near_groups``: fingerprints of ``size``-word shingles linked at ``radius`` or fewer differing bits. Texts
    without words share the fingerprint zero and are one group; rows without an id come before the others of their group.
    """
    groups = near_groups(docs, size, radius, id_col=id_col, text_col=text_col)
    first = groups.groupBy("group").agg(F.min(F.struct("doc_id", "key_1", "key_2")).alias("first"))
    return keep_once(docs, first.select("first.key_1", "first.key_2"), id_col, text_col)
