"""Benchmark passages in a corpus by greedy string tiling.

Texts are words (runs of letters and digits, lower case). A seed is the hash of ``minimum`` words in
a row. The benchmark's seeds make a bitmap of bounded size that every task holds; documents are
scanned once, and only their stretches whose seeds pass it go on. They meet the exact seeds in a
join, which gives candidate pairs of document and item; a pair goes on when its shared seeds could
cover enough of the item.

For each candidate the tiles are found greedily: over falling lengths, Karp-Rabin hashes of all
windows of unmarked words give the matches; the longest is marked first, and what a marked word cuts
from another match is looked at again. Tiles overlap in neither text, so moved and reordered
sentences still count and a phrase that is said twice counts once. An item is in a document when its
tiles cover at least ``coverage`` of the item's words.

Null and empty texts have no seeds. Items of fewer than ``minimum`` words cannot be told from chance
and are never found. Repeated rows (same id and text) give one row an item. Other columns are not
read. Without documents or items the result is empty.
"""
from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saddle.llm.rows import key_columns
from saddle.llm.textbytes import Words, slices
from saddle.storage import materialise

MINIMUM = 4
COVERAGE = 0.5
#: The bitmap has 64 bits a seed, between these bounds (8 MB at most).
LEAST_BITS, MOST_BITS = 1 << 22, 1 << 26
#: Matches looked at together.
MATCHES = 1 << 18
_STEP = 0xD6E8FEB86659FD93

_NOT_WORD = np.ones(256, dtype=bool)
_NOT_WORD[48:58] = _NOT_WORD[65:91] = _NOT_WORD[97:123] = _NOT_WORD[128:] = False


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """(hash, row) of every word of the texts, and the number of rows."""
    words = Words(pa.compute.utf8_lower(pa.compute.fill_null(texts, "")), _NOT_WORD)
    return (words.hashes() if len(words.doc) else np.zeros(0, np.uint64)), words.doc, words.rows


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` words in a row."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out, factor = words[:n].copy(), 1
        for j in range(1, size):
            factor = factor * _STEP % (1 << 64)
            out += words[j:j + n] * np.uint64(factor)
        return out ^ (out >> np.uint64(29))


# -- tiles of one pair ---------------------------------------------------------------------

def _prefix(words: np.ndarray, powers: np.ndarray) -> np.ndarray:
    out = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * powers[:len(words)], out=out[1:])
    return out


def _free_windows(marked: np.ndarray, size: int) -> np.ndarray:
    """Starts of windows without a marked word."""
    seen = np.concatenate([[0], np.cumsum(marked)])
    return np.flatnonzero(seen[size:] == seen[:-size])


def _grow(a: np.ndarray, b: np.ndarray, a_marked: np.ndarray, b_marked: np.ndarray, i: int, j: int) -> int:
    """Length of the match of unmarked words that starts at (i, j)."""
    length, step = 0, 16
    while True:
        n = min(step, len(a) - i - length, len(b) - j - length)
        if n <= 0:
            return length
        x, y = slice(i + length, i + length + n), slice(j + length, j + length + n)
        ok = (a[x] == b[y]) & ~a_marked[x] & ~b_marked[y]
        if not ok.all():
            return length + int(ok.argmin())
        length, step = length + n, step * 2


def tiles(text: np.ndarray, closed: np.ndarray, item: np.ndarray, minimum: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in text, place in item, length); ``closed`` words of the text match nothing."""
    a_marked, b_marked = closed.copy(), np.zeros(len(item), dtype=bool)
    out: list[tuple[int, int, int]] = []
    size = minimum
    while size * 2 <= min(len(text), len(item)):
        size *= 2
    longest = max(len(text), len(item)) + 1
    with np.errstate(over="ignore"):
        base = np.full(longest, _STEP, dtype=np.uint64)
        base[0] = 1
        powers = np.multiply.accumulate(base)
        turned = np.full(longest, pow(_STEP, -1, 1 << 64), dtype=np.uint64)
        turned[0] = 1
        back = np.multiply.accumulate(turned)
        a_sum, b_sum = _prefix(text, powers), _prefix(item, powers)
        while size >= minimum:
            whole = True
            if min(len(text), len(item)) >= size:
                at, bt = _free_windows(a_marked, size), _free_windows(b_marked, size)
                a_hash = (a_sum[at + size] - a_sum[at]) * back[at]
                b_hash = (b_sum[bt + size] - b_sum[bt]) * back[bt]
                order = np.argsort(b_hash, kind="stable")
                lo, hi = np.searchsorted(b_hash[order], a_hash, "left"), np.searchsorted(b_hash[order], a_hash, "right")
                upto = np.cumsum(hi - lo)
                held = max(1, int(np.searchsorted(upto, MATCHES, "right"))) if len(upto) else 0
                whole = held >= len(at)
                at, lo, hi = at[:held], lo[:held], hi[:held]
                n = hi - lo
                i = np.repeat(at, n)
                j = bt[order[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]] if len(i) else i
                inner = (i > 0) & (j > 0)
                inner[inner] = (text[i[inner] - 1] == item[j[inner] - 1]) & ~a_marked[i[inner] - 1] & ~b_marked[j[inner] - 1]
                heap = []
                for x, y in zip(i[~inner].tolist(), j[~inner].tolist()):
                    length = _grow(text, item, a_marked, b_marked, x, y)
                    if length >= size:
                        heap.append((-length, x, y))
                heapq.heapify(heap)
                while heap:
                    length, x, y = heapq.heappop(heap)
                    length = -length
                    used = a_marked[x:x + length] | b_marked[y:y + length]
                    if not used.any():
                        a_marked[x:x + length] = b_marked[y:y + length] = True
                        out.append((x, y, length))
                        continue
                    edges = np.flatnonzero(np.diff(np.concatenate([[True], used, [True]]).astype(np.int8)))
                    for begin, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
                        if end - begin >= size:
                            heapq.heappush(heap, (-(end - begin), x + begin, y + begin))
            if whole:
                size = size // 2 if size // 2 >= minimum else (minimum if size > minimum else 0)
    return out


# -- the join ------------------------------------------------------------------------------

def _items(benchmark: DataFrame, minimum: int, id_col: str, text_col: str) -> DataFrame:
    rows = benchmark.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text"))
    kind = rows.schema["item_id"].dataType.simpleString()

    def work(batches):
        for batch in batches:
            for at, texts in slices(batch["text"]):
                words, row, n = word_hashes(texts)
                cuts = np.searchsorted(row, np.arange(n + 1))
                lists = [words[cuts[r]:cuts[r + 1]].view(np.int64) for r in range(n)]
                seeds = [windows(words[cuts[r]:cuts[r + 1]], minimum).view(np.int64) for r in range(n)]
                kind = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([batch["item_id"].slice(at, n), pa.array(lists, kind), pa.array(seeds, kind)],
                                                 ["item_id", "words", "seeds"])

    found = rows.mapInArrow(work, f"item_id {kind}, words array<bigint>, seeds array<bigint>")
    # items of equal ids stay apart
    return materialise(found.where(F.size("seeds") > 0).withColumn("item", F.monotonically_increasing_id()))


def _bitmap(items: DataFrame) -> np.ndarray:
    """One bit per seed hash, in a power of two of bits that is bounded whatever the benchmark's size."""
    seeds = items.select(F.explode("seeds").alias("seed"))
    bits = LEAST_BITS
    count = seeds.count()
    while bits < MOST_BITS and bits < 64 * count:
        bits *= 2
    at = F.col("seed").bitwiseAND(F.lit(bits - 1))
    words = seeds.select(F.shiftright(at, 6).alias("word"), F.expr("shiftleft(1L, cast(seed & 63 AS int))").alias("mask"))
    out = np.zeros(bits // 64, dtype=np.uint64)
    found = words.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()  # at most MOST_BITS / 64 rows
    out[found["word"].to_numpy()] = found["mask"].to_numpy().view(np.uint64)
    return out


def _stretches(docs: DataFrame, bitmap: np.ndarray, minimum: int, id_col: str, text_col: str) -> DataFrame:
    """Runs of words whose seeds pass the bitmap: ``key_1, key_2, doc_id, start, words, seeds``."""
    rows = docs.select(*key_columns(id_col, text_col), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def work(batches):
        bitmap = shared.value
        low = np.uint64(len(bitmap) * 64 - 1)
        for batch in batches:
            for at, texts in slices(batch["text"]):
                words, row, _ = word_hashes(texts)
                seeds = windows(words, minimum)
                own = row[:len(seeds)] == row[minimum - 1:] if len(seeds) else np.zeros(0, bool)
                passed = own & ((bitmap[(seeds & low) >> np.uint64(6)] >> (seeds & np.uint64(63))) & np.uint64(1)).astype(bool)
                hits = np.flatnonzero(passed)
                if not len(hits):
                    continue
                new = np.concatenate([[True], (np.diff(hits) > 1) | (row[hits[1:]] != row[hits[:-1]])])
                first = hits[new]
                last = hits[np.append(np.flatnonzero(new)[1:] - 1, len(hits) - 1)]
                of = pa.array(row[first] + at)
                begin = np.searchsorted(row, row[first])
                lists = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([
                    batch["key_1"].take(of), batch["key_2"].take(of), batch["doc_id"].take(of), pa.array(first - begin),
                    pa.array([words[f:e + minimum].view(np.int64) for f, e in zip(first, last)], lists),
                    pa.array([seeds[f:e + 1].view(np.int64) for f, e in zip(first, last)], lists),
                ], ["key_1", "key_2", "doc_id", "start", "words", "seeds"])

    found = rows.mapInArrow(work, f"key_1 bigint, key_2 int, doc_id {kind}, start bigint, words array<bigint>, seeds array<bigint>")
    return materialise(found)


def contaminated(docs: DataFrame, benchmark: DataFrame, minimum: int = MINIMUM, coverage: float = COVERAGE,
                 id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and item in it: ``key_1, key_2, doc_id, item_id, n_tiles, covered, item_words, coverage``."""
    items = _items(benchmark, minimum, item_col, item_text)
    runs = _stretches(docs, _bitmap(items), minimum, id_col, text_col)
    key = ["key_1", "key_2"]
    runs = runs.dropDuplicates([*key, "start"])
    targets = items.select("item", F.size("words").alias("n"), F.posexplode("seeds").alias("place", "seed"))
    shared = runs.select(*key, F.explode("seeds").alias("seed")).distinct().join(targets, "seed")
    # each shared seed covers at most ``minimum`` words of the item
    pairs = (shared.groupBy(*key, "item").agg(F.count(F.lit(1)).alias("hits"), F.first("n").alias("n"))
             .where(F.col("hits") * minimum >= F.col("n") * coverage).select(*key, "item"))
    sides = (runs.select(*key, "doc_id", "start", "words").join(pairs, key)
             .join(items.select("item", "item_id", F.col("words").alias("wanted")), "item"))
    kinds = {f.name: f.dataType.simpleString() for f in sides.schema}

    def work(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("start")
        # stretches lie side by side with a closed word between them
        text = np.concatenate([x for w in part["words"] for x in (np.asarray(w, dtype=np.int64), [0])]).view(np.uint64)
        closed = np.zeros(len(text), dtype=bool)
        closed[np.cumsum([len(w) + 1 for w in part["words"]]) - 1] = True
        head = part.iloc[0]
        item = np.asarray(head["wanted"], dtype=np.int64).view(np.uint64)
        found = tiles(text, closed, item, minimum)
        covered = sum(length for _, _, length in found)
        return pd.DataFrame({"key_1": [head["key_1"]], "key_2": [head["key_2"]], "doc_id": [head["doc_id"]], "item_id": [head["item_id"]],
                             "n_tiles": [len(found)], "covered": [covered], "item_words": [len(item)], "coverage": [covered / len(item)]})

    schema = (f"key_1 bigint, key_2 int, doc_id {kinds['doc_id']}, item_id {kinds['item_id']}, "
              "n_tiles int, covered int, item_words int, coverage double")
    return sides.groupBy(*key, "item").applyInPandas(work, schema).where(F.col("coverage") >= coverage)
