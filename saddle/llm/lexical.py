"""Ranked lexical search by scanning documents with an Aho-Corasick automaton; no document index.

Terms are the longest runs of letters, digits and characters beyond ASCII, with A-Z lower-cased. All
terms of the items make one automaton, whose patterns carry a guard on both sides (a blank, which is
what every character outside terms becomes in a scanned text), so a pattern matches whole terms only
and neighbours may share a guard. Every task gets the automaton and counts term frequencies in one
pass over its texts. What a document holds of the items' terms is written once; its document
frequencies, lengths and numbers come from there.

A document's weighted frequencies meet the items through the terms' item lists: a slice of documents
times a block of items is one matrix product over whole numbers below 2^53, added up in 64 bits. A
task keeps ``k`` documents an item and sends no more than these; a shuffle by item ranks them.

Items are dealt over groups of about ``TERM_BYTES`` bytes of terms by a hash of their id, and each
group has its own automaton and scan, so what is sent to tasks is bounded whatever the number of items
(but for one item that alone has more). The rows of one item id, repeated or not, are one item.
Null and empty texts have no terms: such documents do not count and such items rank nothing. Repeated
documents are ranked each. A null document id comes after the others among equal scores; a null item
id is an id. Other columns are not read. Without documents or items the result is empty.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saddle.llm.rows import key_columns
from saddle.llm.textbytes import raw, slices
from saddle.storage import materialise

#: What separates terms.
GAPS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TERM_BYTES = 1 << 21
#: Documents and items of a matrix product, and its terms.
DOCS, ITEMS, TERMS = 512, 256, 4096
#: Constants of the score: whole numbers, so that it is the same everywhere.
SCALE, LENGTH_SHARE, SATURATION, UNIT = 1000, 90, 8, 1_000_000_000

_GUARD = " "
_TABLE = bytes(b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else b + 32 if 65 <= b < 91 else 32 for b in range(256))


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id, term``: the distinct terms of each item."""
    terms = F.regexp_extract_all(_lower(F.col(text_col)), F.lit(GAPS), F.lit(0))
    return items.select(F.col(id_col).alias("item_id"), F.explode(terms).alias("term")).distinct()


def automaton(terms: list[str]) -> ahocorasick.Automaton:
    """Patterns with guards over the bytes of terms; a match gives the term's place in the list."""
    made = ahocorasick.Automaton()
    for at, term in enumerate(terms):
        made.add_word(_GUARD + term.encode().decode("latin-1") + _GUARD, at)
    if terms:
        made.make_automaton()
    return made


def scan(made: ahocorasick.Automaton, texts: pa.Array) -> Iterator[tuple[int, Counter]]:
    """(number of all terms, count by term of the automaton) of each text."""
    data, ends = raw(texts)
    flat = data.tobytes().translate(_TABLE)
    word = np.frombuffer(flat, dtype=np.uint8) != 32
    starts = word.copy()
    starts[1:] &= ~word[:-1]
    inner = ends[:-1][ends[:-1] < len(data)]
    starts[inner] = word[inner]
    before = np.concatenate([[0], np.cumsum(starts)])
    counts = before[ends[1:]] - before[ends[:-1]]
    for n, lo, hi in zip(counts.tolist(), ends[:-1].tolist(), ends[1:].tolist()):
        text = _GUARD + flat[lo:hi].decode("latin-1") + _GUARD
        yield n, Counter(map(itemgetter(1), made.iter(text))) if n and len(made) else Counter()


def frequencies(docs: DataFrame, terms: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with a term: ``key_1, key_2, doc_id, n, terms, tfs``, the last two over places in ``terms``."""
    rows = docs.select(*key_columns(id_col, text_col), F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    names = ["key_1", "key_2", "doc_id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = automaton(shared.value)
        for batch in batches:
            for at, texts in slices(batch["text"]):
                n, ends, found, tfs = [], [0], [], []
                for total, counted in scan(made, texts):
                    n.append(total)
                    found.extend(counted.keys())
                    tfs.extend(counted.values())
                    ends.append(len(found))
                ends = pa.array(ends, pa.int32())
                part = batch.slice(at, len(texts))
                out = pa.RecordBatch.from_arrays(
                    [*[part[c] for c in names], pa.array(n, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(found, pa.int32())),
                     pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int64()))], [*names, "n", "terms", "tfs"])
                yield out.filter(pa.compute.greater(out["n"], 0))

    return rows.mapInArrow(work, "key_1 bigint, key_2 int, doc_id bigint, n bigint, terms array<int>, tfs array<bigint>")


def term_weights(documents: int, holding: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * np.log((2.0 * documents + 2) / (2.0 * holding + 1))).astype(np.int64)


# -- scores --------------------------------------------------------------------------------

class _Block:
    """Some items: their terms in pieces, each a dense matrix of (terms, items), and the best rows so far."""

    def __init__(self, item: np.ndarray, term: np.ndarray, first: int, items: int, k: int):
        self.first, self.items, self.k = first, items, k
        own = np.unique(term)
        self.pieces = []
        for lo in range(0, len(own), TERMS):
            piece = own[lo:lo + TERMS]
            at = np.searchsorted(piece, term)
            inside = (at < len(piece)) & (piece[np.minimum(at, len(piece) - 1)] == term)
            hold = np.zeros((len(piece), items))
            hold[at[inside], item[inside] - first] = 1
            self.pieces.append((piece, hold))
        self.least = np.ones(items, dtype=np.int64)
        self.best = np.zeros((6, 0), dtype=np.int64)  # item, score, id is null, id, key_1, key_2

    def add(self, docs: int, doc: np.ndarray, term: np.ndarray, value: np.ndarray, names: np.ndarray) -> None:
        scores = np.zeros((docs, self.items), dtype=np.int64)
        for piece, hold in self.pieces:
            at = np.minimum(np.searchsorted(piece, term), len(piece) - 1)
            own = piece[at] == term
            part = np.zeros((docs, len(piece)))
            part[doc[own], at[own]] = value[own]
            scores += (part @ hold).astype(np.int64)
        d, i = np.nonzero(scores >= self.least)
        if not len(d):
            return
        rows = np.concatenate([self.best, np.vstack([i, scores[d, i], names[:, d]])], axis=1)
        rows = rows[:, np.lexsort((rows[5], rows[4], rows[3], rows[2], -rows[1], rows[0]))]
        starts = np.flatnonzero(np.diff(rows[0], prepend=-1))
        place = np.arange(rows.shape[1]) - np.repeat(starts, np.diff(starts, append=rows.shape[1]))
        self.best = rows[:, place < self.k]
        last = place == self.k - 1
        self.least[rows[0, last]] = rows[1, last]


def _ranked(stored: DataFrame, postings: pa.Table, weights: np.ndarray, documents: int, length: int, k: int) -> DataFrame:
    """``item, doc_id, score, key_1, key_2``: at most ``k`` rows an item from every task."""
    shared = stored.sparkSession.sparkContext.broadcast((postings["item"].to_numpy(), postings["term"].to_numpy(), weights))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item, term, weights = shared.value  # sorted by item
        blocks = []
        for first in range(0, int(item[-1]) + 1, ITEMS):
            lo, hi = np.searchsorted(item, [first, first + ITEMS])
            blocks.append(_Block(item[lo:hi], term[lo:hi], first, min(ITEMS, int(item[-1]) + 1 - first), k))
        for whole in batches:
            for at in range(0, whole.num_rows, DOCS):
                batch = whole.slice(at, DOCS)
                n = batch["n"].to_numpy()
                m = 100 - LENGTH_SHARE + (LENGTH_SHARE * n * documents) // length
                doc = np.repeat(np.arange(len(n)), np.asarray(pa.compute.list_value_length(batch["terms"])))
                found, tf = batch["terms"].flatten().to_numpy(), batch["tfs"].flatten().to_numpy()
                value = weights[found] * ((UNIT * tf) // (SCALE * tf + SATURATION * m[doc]))
                ids = batch["doc_id"]
                names = np.vstack([np.asarray(ids.is_null()), ids.fill_null(0).to_numpy(), batch["key_1"].to_numpy(), batch["key_2"].to_numpy()]).astype(np.int64)
                for block in blocks:
                    block.add(len(n), doc, found, value, names)
        for block in blocks:
            i, score, null, ids, key_1, key_2 = block.best
            yield pa.RecordBatch.from_arrays(
                [pa.array((i + block.first).astype(np.int32)), pa.array(ids, mask=null.astype(bool)), pa.array(score), pa.array(key_1),
                 pa.array(key_2.astype(np.int32))], ["item", "doc_id", "score", "key_1", "key_2"])

    return stored.mapInArrow(work, "item int, doc_id bigint, score bigint, key_1 bigint, key_2 int")


def _search(docs: DataFrame, own: pa.Table, k: int, id_col: str, text_col: str) -> DataFrame | None:
    """The best documents for the items of one group; ``own`` has their ``item_id, term``."""
    spark = docs.sparkSession
    terms = sorted(set(own["term"].to_pylist()))
    place = {t: i for i, t in enumerate(terms)}
    ids = pa.compute.unique(own["item_id"])
    number = pa.compute.index_in(own["item_id"], ids)
    postings = pa.table({"item": number, "term": pa.array([place[t] for t in own["term"].to_pylist()], pa.int32())}).sort_by("item")
    stored = materialise(frequencies(docs, terms, id_col, text_col))
    totals = stored.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("length")).first()
    if not totals["documents"]:
        return None
    counted = stored.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).toArrow()  # one row per term
    holding = np.zeros(len(terms), dtype=np.int64)
    holding[counted["term"].to_numpy()] = counted["n"].to_numpy()
    found = _ranked(stored, postings, term_weights(totals["documents"], holding), totals["documents"], totals["length"], k)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "key_1", "key_2")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    named = spark.createDataFrame(pa.table({"item": pa.array(range(len(ids)), pa.int32()), "item_id": ids}))
    return best.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score", "key_1", "key_2")


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score, key_1, key_2``: the ``k`` documents with the highest score above 0 for each item."""
    spark = docs.sparkSession
    terms = materialise(item_terms(items, item_col, item_text))
    size = terms.agg(F.sum(F.octet_length("term") + 2)).first()[0] or 0
    groups = -(-size // TERM_BYTES)
    kind = terms.schema["item_id"].dataType.simpleString()
    found = []
    for g in range(groups):
        own = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g).toArrow()  # about TERM_BYTES of terms
        if own.num_rows:
            found.append(_search(docs, own, k, id_col, text_col))
    found = [f for f in found if f is not None]
    if not found:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint, key_1 bigint, key_2 int")
    return reduce(DataFrame.unionByName, found)
