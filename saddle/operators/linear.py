"""Many linear classifiers over the same rows, fitted side by side.

Rows are ``(ds, id, v array<double>, labels array<int>, train array<boolean>, test array<boolean>)``:
``ds`` numbers the data set, ``train[j]`` and ``test[j]`` say whether the row is learnt from or judged in fit j of
its data set. All fits of all data sets take each step together: one pass over the rows multiplies them
with the weights of all models and returns one gradient a model, summed by Spark; the driver holds
weights only, whose number is data sets x fits x classes x dimensions and does not grow with the rows.

A fit takes a fixed number of accelerated proximal gradient steps, so its result is a function of its rows
alone and can be written out in SQL (``plans/linear_sql.py``). The loss is a sum over rows plus the penalty
of the weights over C; the intercept is not penalised. Steps come from the curvature's bound: the largest
eigenvalue of a fit's rows, by power iteration, for the weights, and the number of rows for the intercept.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saddle.storage import materialise

#: Columns of a row of sums.
_LANES = 16
#: Numbers of a product held at once.
_HELD = 1 << 20
#: The curvature's bound over the last power step, and over each of the two blocks (weights, intercept).
SLACK, BLOCKS = 1.2, 2.0

COLUMNS = ["ds", "id", "v", "labels", "train", "test"]


@dataclass(frozen=True)
class Linear:
    """One model a class (``multinomial``: one softmax), with penalty L2 or L1 of strength 1/C."""

    c: float = 1.0
    l1: bool = False
    multinomial: bool = False
    steps: int = 40
    power: int = 6

    @property
    def curvature(self) -> float:
        return 0.5 if self.multinomial else 0.25


class Rows:
    """Written rows of some data sets, with their widths, numbers of fits and classes."""

    def __init__(self, rows: DataFrame, classes: int):
        self.table, self.classes = materialise(rows.select(*COLUMNS)), classes
        sizes = self.table.groupBy("ds").agg(F.max(F.size("v")).alias("d"), F.max(F.size("train")).alias("j")).collect()  # one row a data set
        self.shapes = {r["ds"]: (r["d"], r["j"]) for r in sizes}


def _blocks(batch: pa.RecordBatch, classes: int) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(data set, its rows, matrix with a leading 1, truth) in slices that keep products small."""
    ds = batch["ds"].to_numpy()
    for one in np.unique(ds).tolist():
        whole = batch.filter(pa.array(ds == one))
        fits = max(1, len(whole["train"][0]))
        step = max(1, _HELD // (fits * classes))
        for at in range(0, whole.num_rows, step):
            own = whole.slice(at, step)
            x = own["v"].flatten().to_numpy().reshape(len(own), -1)
            truth = np.zeros((len(own), classes))
            counts = np.asarray(pa.compute.list_value_length(own["labels"]))
            truth[np.repeat(np.arange(len(own)), counts), own["labels"].flatten().to_numpy()] = 1
            yield one, own, np.concatenate([np.ones((len(x), 1)), x], axis=1), truth


def _marks(own: pa.RecordBatch, name: str) -> np.ndarray:
    return own[name].flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)


def _summed(rows: Rows, part: Callable, sizes: dict[int, int]) -> dict[int, np.ndarray]:
    """``part(ds, x, truth, train)`` summed over all rows; ``sizes`` gives its length by data set."""
    first, total = {}, 0
    for ds in sorted(sizes):
        first[ds] = total
        total += -(-sizes[ds] // _LANES)
    classes = rows.classes
    names = [f"c{i}" for i in range(_LANES)]

    def work(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for ds, own, x, truth in _blocks(batch, classes):
                value = part(ds, x, truth, _marks(own, "train"))
                sums[ds] = sums[ds] + value if ds in sums else value
        for ds, value in sums.items():
            lanes = np.pad(value, (0, -len(value) % _LANES)).reshape(-1, _LANES)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(lanes)) + first[ds]), *[pa.array(c) for c in np.ascontiguousarray(lanes.T)]], ["at", *names])

    partial = rows.table.mapInArrow(work, "at bigint, " + ", ".join(f"{n} double" for n in names))
    found = partial.groupBy("at").agg(*[F.sum(n).alias(n) for n in names]).toArrow()  # as many rows as the models need
    lanes = np.zeros((total, _LANES))
    lanes[found["at"].to_numpy()] = np.stack([found[n].to_numpy() for n in names], axis=1) if found.num_rows else 0
    return {ds: lanes[first[ds]:first[ds] - (-size // _LANES)].ravel()[:size] for ds, size in sizes.items()}


def _probabilities(x: np.ndarray, own: np.ndarray, multinomial: bool) -> np.ndarray:
    """Of rows ``x`` by weights ``own`` (fits, classes, 1 + dimensions), as (classes, rows, fits), so that no inner loop runs over a few classes; one model a class gives probabilities that need not add up to 1."""
    z = np.stack([x @ own[:, c].T for c in range(own.shape[1])])
    if multinomial:
        z -= z.max(axis=0)
        e = np.exp(z, out=z)
        e /= e.sum(axis=0)
        return e
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _spectrum(rows: Rows, steps: int) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
    """By data set, each fit's number of training rows and the largest eigenvalue of their weights' part."""
    v = {ds: np.ones((j, d)) / np.sqrt(max(d, 1)) for ds, (d, j) in rows.shapes.items()}
    size = {ds: j * (d + 1) for ds, (d, j) in rows.shapes.items()}
    count = {}
    top = {ds: np.zeros(j) for ds, (d, j) in rows.shapes.items()}
    for _ in range(steps):
        now = rows.table.sparkSession.sparkContext.broadcast(v)

        def part(ds, x, truth, train, now=now):
            seen = train * (x[:, 1:] @ now.value[ds].T)
            return np.concatenate([train.sum(axis=0)[:, None], seen.T @ x[:, 1:]], axis=1).ravel()

        for ds, flat in _summed(rows, part, size).items():
            d, j = rows.shapes[ds]
            flat = flat.reshape(j, d + 1)
            count[ds], u = flat[:, 0], flat[:, 1:]
            top[ds] = np.linalg.norm(u, axis=1)
            v[ds] = u / np.maximum(top[ds], 1e-300)[:, None]
        now.destroy()
    return count, top


def fit(rows: Rows, specs: list[Linear]) -> list[dict[int, np.ndarray]]:
    """By model and data set, weights (fits, classes, 1 + dimensions), the intercept first."""
    sc, k = rows.table.sparkSession.sparkContext, rows.classes
    if not rows.shapes:
        return [{} for _ in specs]
    count, top = _spectrum(rows, max(s.power for s in specs))
    rate, w, z = [], [], []
    for spec in specs:
        bound = {}
        for ds, (d, j) in rows.shapes.items():
            weights = spec.curvature * BLOCKS * SLACK * top[ds] + (0.0 if spec.l1 else 1 / spec.c)
            bound[ds] = 1 / np.maximum(np.concatenate([spec.curvature * BLOCKS * count[ds][:, None], np.repeat(weights[:, None], d, axis=1)], axis=1), 1e-12)
        rate.append(bound)
        w.append({ds: np.zeros((j, k, d + 1)) for ds, (d, j) in rows.shapes.items()})
        z.append({ds: np.zeros((j, k, d + 1)) for ds, (d, j) in rows.shapes.items()})
    size = {ds: len(specs) * j * k * (d + 1) for ds, (d, j) in rows.shapes.items()}
    kinds = [s.multinomial for s in specs]
    for step in range(max(s.steps for s in specs)):
        now = sc.broadcast(z)

        def part(ds, x, truth, train, now=now):
            out = []
            for multinomial, at in zip(kinds, now.value):
                p = _probabilities(x, at[ds], multinomial)
                for c, gap in enumerate(p):
                    gap -= truth[:, c, None]
                    gap *= train
                out.append(np.stack([gap.T @ x for gap in p], axis=1).ravel())
            return np.concatenate(out)

        for ds, flat in _summed(rows, part, size).items():
            d, j = rows.shapes[ds]
            for s, (spec, slope) in enumerate(zip(specs, flat.reshape(len(specs), j, k, d + 1))):
                if step >= spec.steps:
                    continue
                at, by = z[s][ds], rate[s][ds][:, None, :]
                if not spec.l1:
                    slope = slope.copy()
                    slope[..., 1:] += at[..., 1:] / spec.c
                moved = at - by * slope
                if spec.l1:
                    moved[..., 1:] = np.sign(moved[..., 1:]) * np.maximum(np.abs(moved[..., 1:]) - by[..., 1:] / spec.c, 0)
                z[s][ds] = moved + step / (step + 3) * (moved - w[s][ds])
                w[s][ds] = moved
        now.destroy()
    return w


def _judged(rows: Rows, specs: list[Linear], weights: list[dict[int, np.ndarray]], emit: Callable, schema: str) -> DataFrame:
    shared = rows.table.sparkSession.sparkContext.broadcast(weights)
    classes, kinds = rows.classes, [s.multinomial for s in specs]

    def work(batches):
        for batch in batches:
            for ds, own, x, truth in _blocks(batch, classes):
                test = _marks(own, "test")
                for s, at in enumerate(shared.value):
                    yield emit(ds, s, own, truth, test, np.moveaxis(_probabilities(x, at[ds], kinds[s]), 0, 2))

    return rows.table.mapInArrow(work, schema)


def predictions(rows: Rows, specs: list[Linear], weights: list[dict[int, np.ndarray]]) -> DataFrame:
    """``(ds, model, fit, id, y, pred, p)`` of every tested row; ``p`` is the share of the predicted class."""
    kind = rows.table.schema["id"].dataType.simpleString()

    def emit(ds, s, own, truth, test, p):
        row, at = np.nonzero(test)
        best = p[row, at].argmax(axis=1)
        share = p[row, at, best] / p[row, at].sum(axis=1)
        full = lambda x: pa.array(np.full(len(row), x, np.int32))
        return pa.RecordBatch.from_arrays(
            [full(ds), full(s), pa.array(at.astype(np.int32)), own["id"].take(pa.array(row)), pa.array(truth[row].argmax(axis=1).astype(np.int32)),
             pa.array(best.astype(np.int32)), pa.array(share)], ["ds", "model", "fit", "id", "y", "pred", "p"])

    return _judged(rows, specs, weights, emit, f"ds int, model int, fit int, id {kind}, y int, pred int, p double")


def label_scores(rows: Rows, spec: Linear, weights: list[dict[int, np.ndarray]]) -> DataFrame:
    """``(ds, fit, id, label, p)`` of every tested row and class."""
    kind = rows.table.schema["id"].dataType.simpleString()
    classes = rows.classes

    def emit(ds, s, own, truth, test, p):
        row, at = np.nonzero(test)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(row) * classes, ds, np.int32)), pa.array(np.repeat(at, classes).astype(np.int32)),
             own["id"].take(pa.array(np.repeat(row, classes))), pa.array(np.tile(np.arange(classes), len(row)).astype(np.int32)),
             pa.array(p[row, at].ravel())], ["ds", "fit", "id", "label", "p"])

    return _judged(rows, [spec], weights, emit, f"ds int, fit int, id {kind}, label int, p double")


def outcomes(rows: Rows, specs: list[Linear], weights: list[dict[int, np.ndarray]]) -> DataFrame:
    """``(ds, model, fit, y, pred, n)``: how often each class of the tested rows was taken for each; counted before the shuffle."""
    classes = rows.classes

    def emit(ds, s, own, truth, test, p):
        row, at = np.nonzero(test)
        cell = (at * classes + truth[row].argmax(axis=1)) * classes + p[row, at].argmax(axis=1)
        found, n = np.unique(cell, return_counts=True)
        full = lambda x: pa.array(np.full(len(found), x, np.int32))
        whole = lambda x: pa.array(x.astype(np.int32))
        return pa.RecordBatch.from_arrays([full(ds), full(s), whole(found // classes ** 2), whole(found // classes % classes), whole(found % classes),
                                           pa.array(n.astype(np.int64))], ["ds", "model", "fit", "y", "pred", "n"])

    cells = _judged(rows, specs, weights, emit, "ds int, model int, fit int, y int, pred int, n bigint")
    return cells.groupBy("ds", "model", "fit", "y", "pred").agg(F.sum("n").alias("n"))
