"""The language of a text by string kernels: Nyström landmarks and kernel ridge regression, one against the rest.

Bytes are folded to 64 signs: letters without case, one sign for all digits, one for everything else
of ASCII, and the bytes beyond ASCII by their last bits. The blended spectrum of a text is the set of
its runs of 1 to ``LONGEST`` signs, over the whole text; the kernel of two texts is the number of runs
that both hold, divided by the root of the product of what each holds.

Some training texts of every language are landmarks. A text's kernels with all landmarks are one row
of a matrix product of presences; times the inverse root of the landmarks' own kernels they are its
Nyström features, on which ridge regression gives every language a line. Both products are folded
into one matrix, so a batch of texts is scored by two products. The highest value wins (equal values:
the first language by name) and, cut to 0 to 1, is the score.

Training takes a bounded sample: at most ``SAMPLE`` distinct texts a language (and ``TOTAL`` of all,
but one a language at least), those with the smallest hash, of at most ``SAMPLE_BYTES`` bytes, each
whole and once more as a short piece, so short texts are judged well too. Null texts and those without a letter are
``und`` with score 0 and are not learnt from, nor are rows without a language. Without anything to
learn from every text is ``und``. Repeated rows are each predicted. Other columns are not read. An
empty table gives an empty result.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saddle.llm.rows import key_columns
from saddle.llm.textbytes import raw, slices
from saddle.storage import materialise

LONGEST, BITS = 3, 6
SAMPLE, TOTAL, SAMPLE_BYTES = 400, 4000, 1 << 16
#: Landmarks of all languages together, texts of a matrix product, weight of the penalty.
LANDMARKS, ROWS, PENALTY = 160, 256, 1e-3
UNKNOWN = "und"
#: Bits that a hash is shifted by to give its range.
RANGES = 48

Model = dict[str, np.ndarray]

_SIGN = np.zeros(256, dtype=np.int32)
_SIGN[65:91] = _SIGN[97:123] = np.arange(1, 27)
_SIGN[48:58] = 27
_SIGN[128:] = 28 + np.arange(128) % 36
#: Where the runs of each length begin among all codes.
_FIRST = [sum(1 << BITS * n for n in range(1, length)) for length in range(1, LONGEST + 1)]
CODES = sum(1 << BITS * n for n in range(1, LONGEST + 1))


def spectra(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted codes of the runs that each text holds."""
    data, ends = raw(texts)
    signs = _SIGN[data]
    by_length = [signs]
    for n in range(2, LONGEST + 1):
        by_length.append((by_length[-1][:-1] << BITS) | signs[n - 1:] if len(signs) >= n else signs[:0])
    held = np.zeros(CODES, dtype=bool)
    for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist()):
        for n, (first, runs) in enumerate(zip(_FIRST, by_length)):
            held[first + runs[lo:max(hi - n, lo)]] = True
        found = np.flatnonzero(held)
        held[found] = False
        yield found


def kernels(place: np.ndarray, marks: np.ndarray, texts: list[np.ndarray]) -> np.ndarray:
    """(texts, landmarks): ``place`` gives a code's column (or -1), ``marks`` the landmarks' presences over their roots."""
    held = np.zeros((len(texts), marks.shape[1]), dtype=np.float32)
    for row, codes in enumerate(texts):
        at = place[codes]
        held[row, at[at >= 0]] = 1
    size = np.array([max(1, len(codes)) for codes in texts], dtype=np.float32)
    return (held @ marks.T) / np.sqrt(size)[:, None]


def train(texts: list[str], langs: list[str], landmarks: int = LANDMARKS, penalty: float = PENALTY, seed: int = 12) -> Model:
    """Landmarks are dealt evenly over the languages, in the order of the texts."""
    names = sorted(set(langs))
    if not names:
        return {"names": np.array([], dtype=str)}
    rng = np.random.default_rng(seed)
    order, seen = [], dict.fromkeys(names, 0)
    for at, lang in enumerate(langs):
        order.append((seen[lang], at))
        seen[lang] += 1
    pieces = []
    for text in texts:
        size = int(rng.integers(8, 80))
        start = int(rng.integers(0, max(1, len(text) - size)))
        pieces.append(text[start:start + size])
    found = list(spectra(pa.array(texts)))
    chosen = [at for _, at in sorted(order)[:landmarks]]
    columns = np.unique(np.concatenate([found[at] for at in chosen]))
    place = np.full(CODES, -1, dtype=np.int32)
    place[columns] = np.arange(len(columns))
    marks = np.zeros((len(chosen), len(columns)), dtype=np.float32)
    for row, at in enumerate(chosen):
        marks[row, place[found[at]]] = 1 / np.sqrt(max(1, len(found[at])))
    own = kernels(place, marks, [found[at] for at in chosen]).astype(float)
    value, vector = np.linalg.eigh((own + own.T) / 2)
    keep = value > 1e-6 * value[-1]
    root = vector[:, keep] / np.sqrt(value[keep])
    all_texts = found + list(spectra(pa.array(pieces)))
    seen_by = np.concatenate([kernels(place, marks, all_texts[lo:lo + ROWS]) for lo in range(0, len(all_texts), ROWS)])
    feature = np.concatenate([seen_by.astype(float) @ root, np.ones((len(all_texts), 1))], axis=1)
    target = np.array([[name == lang for name in names] for lang in langs + langs], dtype=float)
    # every language weighs the same, and so do whole texts and pieces
    weight = 1 / target.sum(axis=0)[target.argmax(axis=1)]
    bend = (feature * weight[:, None]).T @ feature
    bend[np.arange(len(bend) - 1), np.arange(len(bend) - 1)] += penalty * len(names)
    lines = np.linalg.solve(bend, (feature * weight[:, None]).T @ target)
    return {"names": np.array(names), "place": place, "marks": marks, "lines": (root @ lines[:-1]).astype(np.float32), "shift": lines[-1].astype(np.float32)}


def values(model: Model, texts: pa.Array) -> np.ndarray:
    """(texts, languages): the ridge regressions' values."""
    out, held = [], []
    for codes in spectra(texts):
        held.append(codes)
        if len(held) == ROWS:
            out.append(kernels(model["place"], model["marks"], held) @ model["lines"] + model["shift"])
            held = []
    if held:
        out.append(kernels(model["place"], model["marks"], held) @ model["lines"] + model["shift"])
    return np.concatenate(out) if out else np.zeros((0, len(model["names"])), np.float32)


# -- tables --------------------------------------------------------------------------------

def held_out(id_col: str) -> Column:
    """Rows that are never learnt from: crc32 of the id as text leaves no remainder by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _has_letter(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, total: int = TOTAL) -> Model:
    """A model from at most ``sample`` distinct texts a language and about ``total`` of all."""
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"), F.hash(text_col).alias("g")).where(
        F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col) & _has_letter(text_col) & (F.octet_length(text_col) <= SAMPLE_BYTES))
    names = materialise(rows.select("lang", "h", "g").distinct().withColumn("range", F.shiftrightunsigned("h", RANGES)))
    counted = names.groupBy("lang", "range").agg(F.count(F.lit(1)).alias("n"))  # at most 2^16 rows a language
    quota = max(1, min(sample, total // max(1, names.select("lang").distinct().count())))
    upto = Window.partitionBy("lang").orderBy("range")
    # the ranges of hashes that hold the quota; only their texts are put in order
    first = counted.withColumn("before", F.sum("n").over(upto) - F.col("n")).where(F.col("before") < quota).select("lang", "range")
    place = Window.partitionBy("lang").orderBy("range", "h", "g")
    chosen = names.join(F.broadcast(first), ["lang", "range"]).withColumn("at", F.row_number().over(place)).where(F.col("at") <= quota).select("lang", "h", "g")
    # at most ``total`` keys, or one a language
    found = rows.join(F.broadcast(chosen), ["lang", "h", "g"]).groupBy("lang", "h", "g").agg(F.min("text").alias("text")).select("lang", "h", "g", "text").collect()
    found = sorted(found, key=lambda r: (r["h"] % (1 << 64), r["g"], r["lang"]))
    return train([r["text"] for r in found], [r["lang"] for r in found])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``key_1, key_2, doc_id, held_out, lang_pred, score``."""
    rows = docs.select(*key_columns(id_col, text_col), F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"),
                       F.when(_has_letter(text_col), F.col(text_col)).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = ["key_1", "key_2", "doc_id", "held_out"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at, texts in slices(batch["text"]):
                part = batch.slice(at, len(texts))
                known = np.asarray(texts.is_valid()) & bool(len(model["names"]))
                if len(model["names"]):
                    value = values(model, texts)
                    best = value.argmax(axis=1)
                    lang = np.where(known, model["names"][best], UNKNOWN)
                    score = np.where(known, np.clip(value[np.arange(len(best)), best], 0, 1), 0.0)
                else:
                    lang, score = np.full(len(texts), UNKNOWN), np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([*[part[c] for c in kept], pa.array(lang.tolist(), pa.string()), pa.array(score.astype(float))],
                                                 [*kept, "lang_pred", "score"])

    return rows.mapInArrow(work, f"key_1 bigint, key_2 int, doc_id {kind}, held_out boolean, lang_pred string, score double")
