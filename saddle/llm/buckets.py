"""Sorted runs of rows inside a task, and the pairs of a run, in bounded memory."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Pairs compared at once.
PAIRS = 1 << 21


def by_runs(batches: Iterator[pa.RecordBatch], keys: list[str], work: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]]):
    """Calls ``work(table, starts)`` on whole runs of equal ``keys``; rows come sorted by them. One run and one batch are held."""
    held: list[pa.RecordBatch] = []

    def cut(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, dtype=bool)
        new[:1] = True
        for k in keys:
            v = table[k].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if len(held) > 1 and all(batch[k][-1] == held[0][k][-1] for k in keys):
            continue  # the run that is open goes on through the whole batch
        table = pa.Table.from_batches(held).combine_chunks()
        starts = cut(table)
        if len(starts) > 1:
            yield from work(table.slice(0, int(starts[-1])).combine_chunks(), starts[:-1])
        held = table.slice(int(starts[-1])).to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield from work(table, cut(table))


def run_pairs(starts: np.ndarray, rows: int, limit: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (later, earlier) of rows of the same run, about ``limit`` at a time."""
    index = np.arange(rows)
    first = np.repeat(starts, np.diff(np.append(starts, rows)))
    earlier = index - first
    part = np.cumsum(earlier) // limit
    edges = np.flatnonzero(np.diff(part)) + 1
    for lo, hi in zip(np.concatenate([[0], edges]), np.append(edges, rows)):
        n = earlier[lo:hi]
        total = int(n.sum())
        if total:
            left = np.repeat(index[lo:hi], n)
            right = np.repeat(first[lo:hi] - np.cumsum(n) + n, n) + np.arange(total)
            yield left, right


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (member, centre) that connect what the edges ``a``-``b`` connect."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[:len(a)], flat[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]
