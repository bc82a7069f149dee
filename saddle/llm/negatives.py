"""Hard negatives from blocks of vectors in Hilbert order, chosen by zone maps and interval arithmetic.

Vectors become whole numbers, floor(``UNIT`` times a component). Rows are put in the order of (label,
place on a Hilbert curve, id) and written as Parquet in this order; the curve runs over all dimensions,
widest first. ``ZONE`` rows in a row are a block, and a block's rows of one label have a zone map: the
least and greatest value in every dimension. For an anchor, interval arithmetic over a zone map bounds
the inner products of all its rows from both sides.

Two searches read blocks. The first looks for the anchor's positives: of the zones of its own label it
leaves out those whose upper bound lies under a score that enough rows of other zones are known to
reach by their lower bounds. The second looks for negatives: a positive with score p has the window
from ``low`` p to ``high`` p, and of the zones of other labels only those go on whose bounds meet one
of the anchor's windows, and none that rows known to lie inside a window leave behind. A search sends an
anchor to the pages (``PAGE`` rows in order) of the zones that it must read, and there it meets their
rows by matrix products of whole numbers; the first ``k`` of a page go on. Rows move once, sorted by page;
a page's anchors pass it in batches, so any number of them may ask for it.

Bounds only ever leave out rows that cannot be among the first: results are exact. How much they leave
out depends on the data: in near-uniform directions nearly every zone must be read.

Rows with a null label, a null vector or a null or non-finite component take no part, nor do labels
that are no whole numbers. Vectors of different lengths never meet. Each repeated row is a row of its
own. A null id is no anchor and comes after the others among equal scores. Whole numbers are cut to
``MOST`` (components of 16,384), so that no score of up to 4,096 dimensions leaves 64 bits. Other columns
are not read. Without anchors, positives or negatives the result is empty.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saddle.ordering import global_index
from saddle.storage import materialise

UNIT, MOST = 256, 1 << 22
ZONE, PAGE = 256, 4096
#: Anchors and zones whose bounds are looked at in one task: of so many rows in order each.
ANCHOR_SPAN, ZONE_SPAN = 1 << 17, 1 << 18
BITS = 2
#: Anchors compared at once.
AT_ONCE = 256


# -- order ---------------------------------------------------------------------------------

def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """(rows, bytes): places on the Hilbert curve through cells of 2^``bits`` a dimension, as big-endian numbers."""
    x = np.ascontiguousarray(cells.T.astype(np.int64))
    dims = len(x)
    if not dims:
        return np.zeros((len(cells), 1), np.uint8)
    # from axes to the transposed place: undo the turns of every level, then Gray code across the dimensions
    for level in range(bits - 1, 0, -1):
        turn = (1 << level) - 1
        for d in range(dims):
            upper = (x[d] >> level) & 1 == 1
            swap = np.where(upper, 0, (x[0] ^ x[d]) & turn)
            x[0] ^= np.where(upper, turn, swap)
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flips = np.zeros(x.shape[1], dtype=np.int64)
    for level in range(bits - 1, 0, -1):
        flips ^= np.where((x[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= flips
    planes = (x[None] >> np.arange(bits - 1, -1, -1)[:, None, None]) & 1
    return np.packbits(planes.reshape(bits * dims, -1).T.astype(np.uint8), axis=1)


def whole(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(UNIT * values.astype(np.float64)), -MOST, MOST).astype(np.int64)


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    return np.asarray(lists.flatten()).reshape(len(lists), dim)


def _by_dim(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    sizes = np.asarray(pa.compute.list_value_length(batch[column]))
    for dim in np.unique(sizes).tolist():
        yield int(dim), batch.filter(pa.array(sizes == dim))


def _spreads(rows: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By vector length: dimensions by falling variance, means and deviations."""
    def work(batches):
        for batch in batches:
            for dim, own in _by_dim(batch, "v"):
                x = whole(_matrix(own["v"], dim)).astype(np.float64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(dim, dim, np.int32)), pa.array(np.arange(dim, dtype=np.int32)), pa.array(np.full(dim, len(x), np.int64)),
                     pa.array(x.sum(axis=0)), pa.array((x * x).sum(axis=0))], ["dim", "at", "n", "s", "q"])

    sums = rows.select("v").mapInArrow(work, "dim int, at int, n bigint, s double, q double").groupBy("dim", "at").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).toPandas()  # one row per dimension
    out = {}
    for dim, own in sums.groupby("dim"):
        own = own.sort_values("at")
        mean = (own.s / own.n).to_numpy()
        # rounded, so that the order of the sums does not decide between dimensions
        spread = np.sqrt(np.maximum((own.q / own.n).to_numpy() - mean ** 2, 0)).round(3)
        out[int(dim)] = np.argsort(-spread, kind="stable"), mean, np.maximum(spread, 1e-3)
    return out


def ordered_rows(vectors: DataFrame, anchor: Column, id_col: str, vector_col: str, label: Column) -> tuple[DataFrame, int]:
    """The rows that take part, written in Hilbert order inside (dim, label): ``idx, dim, label, node, vec_id, anchor, x``, and their number."""
    finite = F.forall(vector_col, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = vectors.where(F.coalesce(finite, F.lit(False))).select(
        label.cast("bigint").alias("label"), F.col(id_col).cast("bigint").alias("vec_id"), F.coalesce(anchor, F.lit(False)).alias("anchor"),
        F.monotonically_increasing_id().alias("node"), F.col(vector_col).cast("array<double>").alias("v")).where("label IS NOT NULL")
    shared = vectors.sparkSession.sparkContext.broadcast(_spreads(rows))
    kept = ["label", "vec_id", "anchor", "node"]

    def work(batches):
        for batch in batches:
            for dim, own in _by_dim(batch, "v"):
                order, mean, spread = shared.value.get(dim, (np.zeros(0, int),) * 3)
                x = whole(_matrix(own["v"], dim))
                cells = np.clip(np.floor((x - mean) / spread + (1 << BITS - 1)), 0, (1 << BITS) - 1).astype(np.int64)[:, order]
                place = hilbert(cells)
                yield pa.RecordBatch.from_arrays(
                    [*[own[c] for c in kept], pa.array(np.full(len(x), dim, np.int32)), pa.array([p.tobytes() for p in place], pa.binary()), _lists(x)],
                    [*kept, "dim", "place", "x"])

    keyed = rows.mapInArrow(work, "label bigint, vec_id bigint, anchor boolean, node bigint, dim int, place binary, x array<bigint>")
    stored = global_index(keyed, ["dim", "label", "place", "vec_id", "node"]).drop("place")
    return stored, stored.count()


# -- bounds --------------------------------------------------------------------------------

def zone_maps(stored: DataFrame) -> DataFrame:
    """``block, label, dim, n, low, high``; a block read by two tasks has two zone maps, each over a part of its rows."""
    def work(batches):
        for batch in batches:
            for dim, own in _by_dim(batch, "x"):
                block, label = own["idx"].to_numpy() // ZONE, own["label"].to_numpy()
                order = np.lexsort((label, block))
                block, label, x = block[order], label[order], _matrix(own["x"], dim)[order]
                starts = np.flatnonzero((np.diff(block, prepend=-1) != 0) | (np.diff(label, prepend=label[0]) != 0))
                low, high = np.minimum.reduceat(x, starts, axis=0), np.maximum.reduceat(x, starts, axis=0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block[starts]), pa.array(label[starts]), pa.array(np.full(len(starts), dim, np.int32)),
                     pa.array(np.diff(starts, append=len(x))), _lists(low), _lists(high)], ["block", "label", "dim", "n", "low", "high"])

    return stored.select("idx", "label", "x").mapInArrow(work, "block bigint, label bigint, dim int, n bigint, low array<bigint>, high array<bigint>")


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchors, zones): the least and the greatest inner product that an anchor can have with rows between ``low`` and ``high``."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return _products(up, low) + _products(down, high), _products(up, high) + _products(down, low)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact: in floating point where no sum can pass 2^53."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2 ** 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _reached(lower: np.ndarray, rows: np.ndarray, usable: np.ndarray, wanted: int) -> np.ndarray:
    """For each line of ``lower``, the greatest value that ``wanted`` rows of usable zones reach for certain, else the least number."""
    least = np.iinfo(np.int64).min
    value = np.where(usable, lower, least)
    order = np.argsort(-value, axis=1, kind="stable")
    enough = np.cumsum(np.where(np.take_along_axis(usable, order, 1), rows[order], 0), axis=1) >= wanted
    first = enough.argmax(axis=1)
    at = np.arange(len(value))
    return np.where(enough.any(axis=1), value[at, order[at, first]], least)


def _needed(anchors: pa.Table, zones: pa.Table, k: int, share: tuple[int, int] | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(anchor, zone) pairs that must be read; ``share`` (percent) turns positives' scores into windows."""
    dim = int(zones["dim"][0].as_py())
    x, low, high = _matrix(anchors["x"], dim), _matrix(zones["low"], dim), _matrix(zones["high"], dim)
    mine, theirs, rows = anchors["label"].to_numpy(), zones["label"].to_numpy(), zones["n"].to_numpy()
    for at in range(0, len(x), AT_ONCE):
        part = slice(at, at + AT_ONCE)
        lower, upper = bounds(x[part], low, high)
        same = mine[part][:, None] == theirs
        if share is None:
            # one row more, as the anchor itself is no positive
            need = same & (upper >= _reached(lower, rows, same, k + 1)[:, None])
        else:
            need = np.zeros(same.shape, dtype=bool)
            for score, known in _windows(anchors.slice(at, AT_ONCE)):
                inside = ~same & known[:, None] & (100 * upper >= share[0] * score[:, None]) & (100 * lower <= share[1] * score[:, None])
                sure = inside & (100 * lower >= share[0] * score[:, None]) & (100 * upper <= share[1] * score[:, None])
                need |= inside & (upper >= _reached(lower, rows, sure, k)[:, None])
        i, z = np.nonzero(need)
        yield i + at, z


def _windows(anchors: pa.Table | pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(score, whether there is one) of the anchors' first positive, then of their second, and so on."""
    lists = anchors["scores"].combine_chunks() if isinstance(anchors["scores"], pa.ChunkedArray) else anchors["scores"]
    sizes = np.asarray(pa.compute.list_value_length(lists))
    flat, first = np.asarray(lists.flatten()), np.cumsum(sizes) - sizes
    for p in range(int(sizes.max(initial=0))):
        known = sizes > p
        score = np.zeros(len(sizes), dtype=np.int64)
        score[known] = flat[first[known] + p]
        yield score, known


def choose(anchors: DataFrame, zones: DataFrame, rows: int, k: int, share: tuple[int, int] | None) -> DataFrame:
    """The columns of ``anchors`` for every page with a zone that the anchor must read, and ``zones``, these zones' bits in the page.

    Anchors in parts of the order meet zones in parts of it, each pair of parts a task's group of bounded size.
    """
    spark = anchors.sparkSession
    parts, others = -(-rows // ANCHOR_SPAN), -(-rows // ZONE_SPAN)
    left = anchors.withColumn("part", F.floor(F.col("idx") / ANCHOR_SPAN)).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(max(others, 1) - 1))))
    right = zones.withColumn("other", F.floor(F.col("block") * ZONE / ZONE_SPAN)).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.lit(max(parts, 1) - 1))))
    per_page = PAGE // ZONE
    fields = anchors.columns

    def work(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        out = []
        for dim in np.intersect1d(mine["dim"].to_numpy(), theirs["dim"].to_numpy()).tolist() if mine.num_rows and theirs.num_rows else []:
            a, z = (t.filter(pa.compute.equal(t["dim"], dim)).combine_chunks() for t in (mine, theirs))
            block = z["block"].to_numpy()
            for i, j in _needed(a, z, k, share):
                if not len(i):
                    continue
                pair = np.unique(np.stack([i, block[j]]), axis=1)  # two zone maps of a block and label count once
                page, bit = pair[1] // per_page, pair[1] % per_page
                starts = np.flatnonzero((np.diff(pair[0], prepend=-1) != 0) | (np.diff(page, prepend=-1) != 0))
                bits = np.bitwise_or.reduceat(1 << bit, starts)
                out.append(a.select(fields).take(pa.array(pair[0][starts])).append_column("page", pa.array(page[starts])).append_column("zones", pa.array(bits)))
        return pa.concat_tables(out) if out else empty.slice(0, 0)

    made = spark.createDataFrame([], anchors.schema).withColumn("page", F.lit(0).cast("bigint")).withColumn("zones", F.lit(0).cast("bigint"))
    empty = made.toArrow()
    return left.groupBy("part", "other").cogroup(right.groupBy("part", "other")).applyInArrow(work, made.schema)


# -- reading -------------------------------------------------------------------------------

def _first(line: np.ndarray, score: np.ndarray, null: np.ndarray, ids: np.ndarray, node: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of every line: higher scores, then smaller ids."""
    order = np.lexsort((node, ids, null, -score, line))
    starts = np.flatnonzero(np.diff(line[order], prepend=-1))
    place = np.arange(len(order)) - np.repeat(starts, np.diff(starts, append=len(order)))
    return order[place < k]


_ROW = "page bigint, asks boolean, idx bigint, dim int, label bigint, node bigint, vec_id bigint, x array<bigint>, zones bigint, scores array<bigint>"
_FOUND = "node bigint, window int, score bigint, found_id bigint, found_node bigint"


def read(stored: DataFrame, asked: DataFrame, k: int, share: tuple[int, int] | None) -> DataFrame:
    """``node, window, score, found_id, found_node``: for each asking anchor, the first ``k`` rows of each page it must read.

    Window is the place of the positive whose window it is (0 where positives are looked for).
    """
    asks = asked.withColumn("asks", F.lit(True))
    if "scores" not in asks.columns:
        asks = asks.withColumn("scores", F.lit(None).cast("array<bigint>"))
    held = stored.withColumns({"asks": F.lit(False), "page": F.floor(F.col("idx") / PAGE), "zones": F.lit(None).cast("bigint"),
                               "scores": F.lit(None).cast("array<bigint>")})
    names = [f.split()[0] for f in _ROW.split(", ")]
    # the rows of a page come before the anchors that ask for it
    runs = held.select(names).unionByName(asks.select(names)).repartition("page").sortWithinPartitions("page", "asks", "idx")
    per_page = PAGE // ZONE

    def meet(rows: pa.Table, anchors: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        dims = np.intersect1d(rows["dim"].to_numpy(), anchors["dim"].to_numpy())
        for dim in dims.tolist():
            own = rows.filter(pa.compute.equal(rows["dim"], dim)).combine_chunks()
            asking = anchors.filter(pa.compute.equal(anchors["dim"], dim))
            x, label, node, bit = _matrix(own["x"], dim), own["label"].to_numpy(), own["node"].to_numpy(), own["idx"].to_numpy() // ZONE % per_page
            null, ids = np.asarray(own["vec_id"].combine_chunks().is_null()), np.asarray(pa.compute.fill_null(own["vec_id"], 0))
            for at in range(0, asking.num_rows, AT_ONCE):
                part = asking.slice(at, AT_ONCE)
                mine, who = part["label"].to_numpy(), part["node"].to_numpy()
                must = (part["zones"].to_numpy()[:, None] >> bit) & 1 == 1
                score = _products(_matrix(part["x"], dim), x)
                if share is None:
                    wanted = [(0, must & (mine[:, None] == label) & (who[:, None] != node))]
                else:
                    other = must & (mine[:, None] != label)
                    wanted = [(p, other & known[:, None] & (100 * score >= share[0] * s[:, None]) & (100 * score <= share[1] * s[:, None]))
                              for p, (s, known) in enumerate(_windows(part))]
                for window, ok in wanted:
                    i, j = np.nonzero(ok)
                    if len(i):
                        best = _first(i, score[i, j], null[j], ids[j], node[j], k)
                        i, j = i[best], j[best]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(who[i]), pa.array(np.full(len(i), window, np.int32)), pa.array(score[i, j]), pa.array(ids[j], mask=null[j]),
                             pa.array(node[j])], ["node", "window", "score", "found_id", "found_node"])

    def work(batches):
        page, parts, rows = None, [], None
        for batch in batches:
            pages, asks = batch["page"].to_numpy(), np.asarray(batch["asks"])
            starts = np.flatnonzero((np.diff(pages, prepend=-1) != 0) | (np.diff(asks.astype(np.int8), prepend=0) != 0))
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(pages)]):
                if pages[lo] != page:
                    page, parts, rows = pages[lo], [], None
                if not asks[lo]:
                    parts.append(batch.slice(lo, hi - lo))
                elif parts or rows is not None:
                    if rows is None:
                        rows, parts = pa.Table.from_batches(parts), []
                    yield from meet(rows, batch.slice(lo, hi - lo))

    return runs.mapInArrow(work, _FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("node", "window").orderBy(F.desc("score"), F.asc_nulls_last("found_id"), "found_node")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100),
                   id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchor`` marks the anchors, ``label`` is the column ``label`` if not given; a negative's score lies between
    the two ``share`` percentages of its positive's.
    """
    stored, rows = ordered_rows(vectors, anchor, id_col, vector_col, F.col("label") if label is None else label)
    zones = materialise(zone_maps(stored))
    anchors = stored.where("anchor").select("idx", "dim", "label", "node", "vec_id", "x")
    stored = stored.drop("anchor")
    near = materialise(_best(read(stored, choose(anchors, zones, rows, positives, None), positives, None), positives).select(
        "node", (F.col("rank") - 1).alias("window"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score")))
    # at most ``positives`` values an anchor
    scores = near.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("window", "positive_score"))).alias("all")).select(
        "node", F.col("all.positive_score").alias("scores"))
    windows = anchors.join(scores, "node").select(*anchors.columns, "scores")
    far = _best(read(stored, choose(windows, zones, rows, negatives, share), negatives, share), negatives)
    named = near.join(anchors.select("node", F.col("vec_id").alias("anchor_id")), "node")
    return far.join(named, ["node", "window"]).select(
        "anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
