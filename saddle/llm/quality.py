"""A text quality score by a small convolutional network over bytes, trained and run in numpy.

Bytes become vectors of ``DIM`` numbers. Filters look at ``GROUPS`` x ``STRIDE`` bytes in steps of
``STRIDE``; their values are max-pooled over chunks of ``CHUNK`` blocks of ``BLOCK`` steps that
overlap by a block and cover the whole document. A hidden layer turns a chunk's maxima and its
filling into one number; the mean over all chunks, weighted by their bytes, goes through a fitted
line and a sigmoid to one probability.

Training takes a bounded sample of labelled rows: at most ``SAMPLE`` documents a label, those with
the smallest hash of their id, of at most ``SAMPLE_BYTES`` bytes. Scoring takes every whole text, in
slices of a few MB. Null and empty texts are a chunk of padding and get a score of their own.
Repeated rows are scored each; a document labelled twice counts with its lowest label. Other columns
are not read. With fewer than two labels every score is the share of label 1 (0.5 without labels).
An empty table gives an empty result.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saddle.llm.rows import key_columns
from saddle.llm.textbytes import raw, slices

DIM, STRIDE, GROUPS, FILTERS, HIDDEN = 6, 4, 3, 48, 16
BLOCK, CHUNK = 64, 4
BYTES = BLOCK * STRIDE
SAMPLE, SAMPLE_BYTES = 2000, 1 << 16
#: Training: passes over the sample, chunks of a document in a pass, chunks in a step.
PASSES, CHUNKS_EACH, STEP = 12, 5, 96

Model = dict[str, np.ndarray]


def _padded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, each text filled up with zeros to whole blocks; blocks before each text; bytes of each text."""
    data, ends = raw(texts)
    sizes = np.diff(ends)
    # the zeros are wide enough that no filter looks from one text into the next one's bytes unnoticed
    blocks = (sizes + (GROUPS - 1) * STRIDE) // BYTES + 1
    first = np.concatenate([[0], np.cumsum(blocks)])
    out = np.zeros(int(first[-1]) * BYTES, dtype=np.uint8)
    out[np.arange(len(data)) + np.repeat(first[:-1] * BYTES - ends[:-1], sizes)] = data
    return out, first, sizes


def _maxima(model: Model, data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(blocks, FILTERS): the filters' largest values in each block, 256 KB of text at a time."""
    total = len(data) // BYTES
    out = np.empty((total, FILTERS), dtype=np.float32)
    closing = np.zeros(total, dtype=bool)
    closing[first[1:] - 1] = True
    width = 1024
    for lo in range(0, total, width):
        hi = min(lo + width, total)
        own = data[lo * BYTES:min((hi + 1) * BYTES, len(data))]
        steps = model["emb"][own].reshape(-1, STRIDE * DIM)
        n = (hi - lo) * BLOCK
        value = steps[:n] @ model["w0"]
        for g in range(1, GROUPS):
            more = steps[g:n + g] @ model[f"w{g}"]
            value[:len(more)] += more
        value = value.reshape(hi - lo, BLOCK, FILTERS)
        value[closing[lo:hi], -(GROUPS - 1):] = -np.inf
        out[lo:hi] = value.max(axis=1)
    return out


def _chunks(first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first block, end block, bytes of text) of every chunk; a row's chunks cover all its blocks."""
    blocks = np.diff(first)
    step = CHUNK - 1
    n = np.maximum(1, -(-(blocks - 1) // step))
    row = np.repeat(np.arange(len(blocks)), n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    start = first[row] + place * step
    end = np.minimum(start + CHUNK, first[row + 1])
    held = np.clip(sizes[row] - place * step * BYTES, 0, CHUNK * BYTES)
    return row, start, end, held


def _pool(maxima: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    value = maxima[start]
    for k in range(1, CHUNK):
        value = np.maximum(value, maxima[np.minimum(start + k, end - 1)])
    return value


def _head(model: Model, pooled: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    seen = np.concatenate([np.maximum(pooled + model["b"], 0), (held / (CHUNK * BYTES))[:, None].astype(np.float32)], axis=1)
    hidden = np.tanh(seen @ model["h"] + model["hb"])
    return seen, hidden, hidden @ model["o"] + model["ob"][0]


def raw_scores(model: Model, texts: pa.Array) -> np.ndarray:
    """The mean of the chunks' numbers for every text."""
    data, first, sizes = _padded(texts)
    row, start, end, held = _chunks(first, sizes)
    value = _head(model, _pool(_maxima(model, data, first), start, end), held)[2].astype(np.float64)
    weight = held + 1.0
    return np.bincount(row, value * weight, len(sizes)) / np.bincount(row, weight, len(sizes))


def scores(model: Model, texts: pa.Array) -> np.ndarray:
    if "share" in model:
        return np.full(len(texts), float(model["share"][0]))
    return 1 / (1 + np.exp(-(model["line"][0] * raw_scores(model, texts) + model["line"][1])))


# -- training ------------------------------------------------------------------------------

def _line(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression on one number by Newton steps, lightly penalised."""
    a = np.array([1.0, 0.0])
    z = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ a, -30, 30)))
        slope = z.T @ (p - y) + 1e-2 * a
        bend = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2)
        move = np.linalg.solve(bend, slope)
        a -= np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-9:
            break
    return a


def train(texts: list[str], labels: np.ndarray, share: float, seed: int = 7) -> Model:
    """``share`` is the share of label 1 among all labelled rows; the sample may be balanced."""
    if len(set(labels.tolist())) < 2:
        return {"share": np.array([share])}
    rng = np.random.default_rng(seed)

    def some(*shape, scale):
        return rng.normal(0, scale, shape).astype(np.float32)

    wide = STRIDE * DIM
    model: Model = {"emb": some(256, DIM, scale=1.0), "b": np.zeros(FILTERS, np.float32),
                    "h": some(FILTERS + 1, HIDDEN, scale=FILTERS ** -0.5), "hb": np.zeros(HIDDEN, np.float32),
                    "o": some(HIDDEN, scale=HIDDEN ** -0.5), "ob": np.zeros(1, np.float32)}
    for g in range(GROUPS):
        model[f"w{g}"] = some(wide, FILTERS, scale=(wide * GROUPS) ** -0.5)
    data, first, sizes = _padded(pa.array(texts))
    row, start, _, held = _chunks(first, sizes)
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    mean = {k: np.zeros_like(v) for k, v in model.items()}
    square = {k: np.zeros_like(v) for k, v in model.items()}
    tail = np.concatenate([data, np.zeros(CHUNK * BYTES, np.uint8)])
    steps, turn = CHUNK * BLOCK, 0
    # the line that turns numbers into probabilities is fitted on documents that no step has seen
    apart = rng.random(len(labels)) < 0.2
    for done in range(PASSES):
        order = rng.permutation(len(row))
        # at most CHUNKS_EACH chunks of a document in a pass
        nth = np.zeros(len(sizes), dtype=int)
        picked = []
        for c in order.tolist():
            if nth[row[c]] < CHUNKS_EACH and not apart[row[c]]:
                nth[row[c]] += 1
                picked.append(c)
        for lo in range(0, len(picked), STEP):
            c = np.array(picked[lo:lo + STEP])
            # of some chunks only a piece is taken, as if the text were shorter
            cut = rng.random(len(c)) < 0.4
            kept = np.where(cut, np.minimum(held[c], rng.integers(24, CHUNK * BYTES, len(c))), held[c])
            shift = (rng.random(len(c)) * (held[c] - kept + 1)).astype(np.int64)
            own = np.stack([tail[s:s + CHUNK * BYTES] for s in (start[c] * BYTES + shift).tolist()])
            own = np.where(np.arange(CHUNK * BYTES)[None] < kept[:, None], own, 0)
            left = np.minimum((kept // BYTES + 1) * BLOCK, steps)
            look = model["emb"][own].reshape(len(c), steps, wide)
            n = steps - GROUPS + 1
            value = sum(look[:, g:n + g] @ model[f"w{g}"] for g in range(GROUPS))
            value = np.where((np.arange(n)[None] < (left - GROUPS + 1)[:, None])[..., None], value, -np.inf)
            best = value.argmax(axis=1)
            pooled = np.take_along_axis(value, best[:, None], axis=1)[:, 0]
            seen, hidden, out = _head(model, pooled, kept)
            d_out = ((1 / (1 + np.exp(-out)) - labels[row[c]]) * weight[row[c]] / len(c)).astype(np.float32)
            d_hidden = np.outer(d_out, model["o"]) * (1 - hidden ** 2)
            d_pool = (d_hidden @ model["h"].T)[:, :FILTERS] * (seen[:, :FILTERS] > 0)
            grad = {"o": hidden.T @ d_out, "ob": d_out.sum(keepdims=True), "h": seen.T @ d_hidden, "hb": d_hidden.sum(0), "b": d_pool.sum(0)}
            emb = np.zeros_like(model["emb"])
            at = np.arange(len(c))[:, None]
            for g in range(GROUPS):
                at_best = look[at, best + g]  # chunk, filter, values under the filter
                grad[f"w{g}"] = np.einsum("cfi,cf->if", at_best, d_pool)
                d_look = d_pool[..., None] * model[f"w{g}"].T[None]
                under = own.reshape(len(c), steps, STRIDE)[at, best + g]
                np.add.at(emb, under.ravel(), d_look.reshape(-1, DIM))
            grad["emb"] = emb
            turn += 1
            rate = 0.01 * (1 - done / PASSES)
            for k, g in grad.items():
                mean[k] += 0.1 * (g - mean[k])
                square[k] += 0.01 * (g * g - square[k])
                model[k] -= rate * (mean[k] / (1 - 0.9 ** turn)) / (np.sqrt(square[k] / (1 - 0.99 ** turn)) + 1e-7)
    fresh = np.flatnonzero(apart)
    if len(set(labels[fresh].tolist())) < 2:
        fresh = np.arange(len(labels))
    x = np.concatenate([raw_scores(model, pa.array([texts[i] for i in fresh[lo:lo + 256]])) for lo in range(0, len(fresh), 256)])
    y = labels[fresh].astype(float)
    line = _line(x, y)
    odds = np.log(np.clip(share, 1e-6, 1 - 1e-6) / np.clip(1 - share, 1e-6, 1)) - np.log(y.mean() / (1 - y.mean()))
    model["line"] = np.array([line[0], line[1] + odds])  # the sample's balance taken back
    return model


def held_out(id_col: str) -> Column:
    """Rows whose label is never learnt from: crc32 of the id as text leaves no remainder by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` documents a label."""
    marks = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
    marks = marks.groupBy(F.col(id_col).alias("doc_id")).agg(F.min(label_col).alias("label"))
    counts = {r["label"]: r["n"] for r in marks.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    if not counts:
        return {"share": np.array([0.5])}
    share = counts.get(1, 0) / sum(counts.values())
    texts = docs.where(F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) <= SAMPLE_BYTES)
    texts = texts.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = []
    for label in (0, 1):
        # twice as many ids as documents, for those that are missing or too long
        ids = marks.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * sample)
        found = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
        found = found.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        rows += [(r["text"], label) for r in found.select("text").collect()]
    return train([t for t, _ in rows], np.array([x for _, x in rows], dtype=np.int64), share)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``key_1, key_2, doc_id, held_out, score``."""
    rows = docs.select(*key_columns(id_col, text_col), F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"),
                       F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["key_1", "key_2", "doc_id", "held_out"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at, texts in slices(batch["text"], 1 << 20):
                part = batch.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([*[part[n] for n in names], pa.array(scores(model, texts))], [*names, "score"])

    return rows.mapInArrow(work, f"key_1 bigint, key_2 int, doc_id {kind}, held_out boolean, score double")


#: Scores below it are rejected.
THRESHOLD = 0.3


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``threshold``, in one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at, texts in slices(batch.column(place), 1 << 20):
                yield batch.slice(at, len(texts)).filter(pa.array(scores(model, texts) >= threshold))

    return docs.mapInArrow(work, docs.schema)
