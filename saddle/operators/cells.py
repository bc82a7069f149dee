"""Gradient sums of one round over a grid of cells.

Vertices are dealt into blocks by hash. A cell holds a round's rows ``(x, t, w, label)`` between one block of centres and one
of targets and meets these two blocks' vectors, so rows travel without vectors, once, and a vector travels once per cell of
its line of the grid. Both travel packed: what a task holds for one cell is one value of sorted, compressed columns. A cell
sums its gradients before they move on. A hub's rows spread over a whole line of cells.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from saddle.operators import nce
from saddle.skew import lookup_join

#: Rows of a cell, on average; cells that are cut for work to go round; rows below which a cell is not worth cutting.
CELL_ROWS, CELLS, LEAST_ROWS = 2_000_000, 48, 50_000
#: Rows that a task packs at a time.
PACKED = 1 << 19
#: Numbers of a table of gathered vectors, few enough for a processor's cache.
GATHERED = 1 << 16


def blocks_for(rows: int, runs: int) -> int:
    """Blocks a side for ``rows`` rows of a round and run."""
    side = lambda cells: math.ceil(math.sqrt(max(1.0, cells)))
    return max(side(rows / CELL_ROWS), min(side(CELLS / runs), side(rows / LEAST_ROWS)))


def _scored(logit: nce.Logit, u: np.ndarray, v: np.ndarray, b: np.ndarray, w: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``xent``, ``err`` and the gradients of ``u`` and ``v`` (coordinates by rows); see ``nce.scored`` and ``nce.row_gradients``."""
    dot = lambda p, q: np.einsum("ij,ij->j", p, q)
    if logit.geometry == "euclidean":
        z = dot(u, v) + b
    elif logit.geometry.startswith("polar"):
        gap = u[1] - v[1]
        z = u[0] * v[0] * np.cos(gap) + b
    elif logit.geometry == "poincare":
        xy, x2, y2, gap = dot(u, v), dot(u, u), dot(v, v), dot(u - v, u - v)
        alpha, beta = 1.0 - x2, 1.0 - y2
        e = 2.0 * gap / (alpha * beta)
        near = np.maximum(e, 0.0)
        far = np.where(gap == 0, 0.0, np.inf)
        z = logit.sign * np.where((x2 < 1) & (y2 < 1), np.log1p(near + np.sqrt(near * (near + 2.0))), far) + b
    else:
        xy = dot(u, v) - 2.0 * u[0] * v[0]
        z = logit.sign * np.arccosh(np.maximum(-xy, 1.0 + logit.margin)) + b
    xent = w * (np.maximum(z, 0.0) - z * label + np.log1p(np.exp(-np.abs(z))))
    err = w * (1.0 / (1.0 + np.exp(-z)) - label)

    if logit.geometry == "euclidean":
        return xent, err, err * v, err * u
    if logit.geometry.startswith("polar"):
        cosg, turn = np.cos(gap) * err, u[0] * v[0] * np.sin(gap) * err
        return xent, err, np.stack([v[0] * cosg, -turn]), np.stack([u[0] * cosg, turn])
    if logit.geometry == "poincare":
        safe = lambda n, m: np.where(m == 0, 0.0, n / m)
        root, edge, pull = np.sqrt(e * (e + 2.0)), alpha * beta == 0, logit.sign * err * 4.0
        kx, ky = np.where(edge, 0.0, safe(pull, beta * root)), np.where(edge, 0.0, safe(pull, alpha * root))
        gx = safe(kx * (y2 - 2 * xy + 1), alpha * alpha) * u + safe(-kx, alpha) * v
        return xent, err, gx, safe(-ky, beta) * u + safe(ky * (x2 - 2 * xy + 1), beta * beta) * v
    # flat inside the margin; not-a-number counts as outside
    root = np.sqrt(xy * xy - 1.0)
    k = np.where((-xy <= 1.0 + logit.margin) | (root == 0), 0.0, -logit.sign * err / root)
    return xent, err, k * v, k * u


def _body(part: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(part.combine_chunks())
    return sink.getvalue().to_pybytes()


def _opened(bodies: pa.ChunkedArray) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(b.as_buffer()).read_all() for b in bodies]).combine_chunks()


def _held(batches: Iterator[pa.RecordBatch], by: str, then: str) -> Iterator[pa.Table]:
    """The task's rows, ``PACKED`` or a few more at a time, in the order of ``by``, and of ``then`` where that is a whole number."""
    held, n = [], 0

    def table() -> pa.Table:
        whole = pa.Table.from_batches(held).combine_chunks()
        first, second = whole[by].to_numpy(), whole[then]
        keys = (second.to_numpy(), first) if pa.types.is_integer(second.type) and not second.null_count else (first,)
        if len(keys) == 2 and int(first.max() + 1) * (span := int(keys[0].max()) - int(keys[0].min()) + 1) < 1 << 62:
            order = np.argsort(first.astype(np.int64) * span + (keys[0] - keys[0].min()))  # one sort of one number
        else:
            order = np.lexsort(keys)
        order = pa.array(order)
        return pa.table([c.combine_chunks().take(order) for c in whole.columns], whole.column_names)

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= PACKED:
            yield table()
            held, n = [], 0
    if n:
        yield table()


def _runs_of(codes: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Each value of sorted ``codes`` with the rows it takes."""
    cuts = np.flatnonzero(np.diff(codes)) + 1
    for a, z in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(codes)]])):
        yield int(codes[a]), int(a), int(z - a)


def _packed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(cell, x, t, w)`` in, ``(cell, body)`` out."""
    for table in _held(batches, "cell", "x"):
        parts = [(cell, _body(table.select(["x", "t", "w"]).slice(a, n))) for cell, a, n in _runs_of(table["cell"].to_numpy())]
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in parts], pa.int32()), pa.array([b for _, b in parts], pa.binary())], ["cell", "body"])


def _packed_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(slice, x, ...)`` in, ``(slice, body)`` out."""
    for table in _held(batches, "slice", "x"):
        parts = [(at, _body(table.drop_columns("slice").slice(a, n))) for at, a, n in _runs_of(table["slice"].to_numpy())]
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in parts], pa.int32()), pa.array([b for _, b in parts], pa.binary())], ["slice", "body"])


def _opened_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for body in batch.column("body"):
            yield from pa.ipc.open_stream(body.as_buffer()).read_all().to_batches(max_chunksize=10_000)


def dealt_packed(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """``rows(x, ...)`` in ``n`` partitions by hash of ``keys``, as ``repartition`` deals them; they travel as sorted, compressed columns."""
    slices = rows.select(F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int").alias("slice"), "*").mapInArrow(_packed_slices, "slice int, body binary")
    return slices.repartitionById(n, "slice").mapInArrow(_opened_slices, rows.schema)


def _packed_state(blocks: int):
    """State ``(home, id, w_in, w_out, b)`` in, where ``home`` is run and block; ``(cell, centre, body)`` out, once a cell of the two lines of the block."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _held(batches, "home", "id"):
            for home, a, n in _runs_of(table["home"].to_numpy()):
                own, (run, at) = table.slice(a, n), divmod(home, blocks)
                bodies = [_body(own.select(["id", "w_in"]).rename_columns(["id", "v"])), _body(own.select(["id", "w_out", "b"]).rename_columns(["id", "v", "b"]))]
                cells = [(run * blocks + at) * blocks + k for k in range(blocks)] + [(run * blocks + k) * blocks + at for k in range(blocks)]
                columns = [pa.array(cells, pa.int32()), pa.array([True] * blocks + [False] * blocks), pa.array([bodies[0]] * blocks + [bodies[1]] * blocks, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["cell", "centre", "body"])

    return work


def _sums(logit: nce.Logit, per_run: int, kind: pa.DataType):
    """The work of a cell: packed rows and vectors of both sides in, ``(run, id, centre, block, c, err, w, xent, pairs)`` out."""
    d, cut = logit.width, nce.BLOCK
    names = ["run", "id", "centre", "block", "c", "err", "w", "xent", "pairs"]
    kinds = [pa.int32(), kind, pa.bool_(), pa.int32(), pa.list_(pa.float64()), *[pa.float64()] * 4]

    def side(state: pa.Table, centre: bool) -> tuple[pa.Array, np.ndarray, np.ndarray | None]:
        bodies = state.filter(state["centre"] if centre else pc.invert(state["centre"]))["body"]
        if not len(bodies):
            return pa.array([], kind), np.zeros((d, 0)), np.zeros(0)
        own = _opened(bodies)
        flat = pc.list_flatten(own["v"]).to_numpy()
        return own["id"].combine_chunks(), np.ascontiguousarray(flat.reshape(-1, d).T), None if centre else own["b"].to_numpy()

    def work(key: tuple, rows: pa.Table, state: pa.Table) -> pa.Table:
        empty = pa.schema(list(zip(names, kinds))).empty_table()
        if not rows.num_rows or not state.num_rows:
            return empty
        rows, (xs, vx, _), (ts, vy, bias) = _opened(rows["body"]), side(state, True), side(state, False)
        place = lambda name, ids: pc.fill_null(pc.index_in(rows[name], value_set=ids), -1).to_numpy()
        x, t = place("x", xs), place("t", ts)
        known = (x >= 0) & (t >= 0)
        x, t, w = x[known], t[known], rows["w"].to_numpy()[known]
        w, label = np.abs(w), np.where(np.signbit(w), 0.0, 1.0)
        gx, gy = np.zeros((d, len(xs))), np.zeros((d, len(ts)))
        more_x, more_y = np.zeros((4, len(xs))), np.zeros((4, len(ts)))  # err, w, xent, pairs
        step = max(4096, GATHERED // d, len(xs), len(ts))  # a step's sums are as long as a side
        for a in range(0, len(x), step):
            xi, ti, wi, li = x[a:a + step], t[a:a + step], w[a:a + step], label[a:a + step]
            with np.errstate(all="ignore"):
                xent, err, du, dv = _scored(logit, vx[:, xi], vy[:, ti], bias[ti], wi, li)
            for i in range(d):
                gx[i] += np.bincount(xi, du[i], len(xs))
                gy[i] += np.bincount(ti, dv[i], len(ts))
            for i, values in enumerate((wi, xent, wi * (li == 1.0)), 1):
                more_x[i] += np.bincount(xi, values, len(xs))
            more_y[0] += np.bincount(ti, err, len(ts))
            more_y[1] += np.bincount(ti, wi, len(ts))
        parts = [empty]
        for ids, index, sums, more, centre in ((xs, x, gx, more_x, True), (ts, t, gy, more_y, False)):
            met = np.flatnonzero(np.bincount(index, minlength=len(ids)))
            for block in range(-(-d // cut)):
                c = np.ascontiguousarray(sums[block * cut:(block + 1) * cut, met].T)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(met) + 1, dtype=np.int32) * c.shape[1]), pa.array(c.ravel()))
                same = lambda value, k: pa.array(np.full(len(met), value), k)
                columns = [same(key[0].as_py() // per_run, pa.int32()), ids.take(pa.array(met)), same(centre, pa.bool_()), same(block, pa.int32()), lists]
                parts.append(pa.Table.from_arrays(columns + [pa.array(m[met]) for m in more], names))
        return pa.concat_tables(parts)

    return work


def summed_in_cells(rows: DataFrame, state: DataFrame, logit: nce.Logit, blocks: int) -> DataFrame:
    """As ``nce.summed_gradients`` by run, from ``rows(run, x, t, w, label)`` and ``state(run, id, w_in, w_out, b)``; rows without a vector take no part."""
    kind = state.schema["id"].dataType
    block = lambda c: F.pmod(F.xxhash64(F.col(c).cast(kind)), F.lit(blocks)).cast("int")
    cell = ((F.col("run") * blocks + block("x")) * blocks + block("t")).cast("int").alias("cell")
    # a row travels with its label as its weight's sign
    weight = F.when(F.col("label") == 1, F.col("w").cast("double")).otherwise(-F.col("w").cast("double")).alias("w")
    laid = rows.where("x IS NOT NULL AND t IS NOT NULL").select(cell, F.col("x").cast(kind).alias("x"), F.col("t").cast(kind).alias("t"), weight)
    homes = state.where("id IS NOT NULL").select((F.col("run") * blocks + block("id")).cast("int").alias("home"), "id", "w_in", "w_out", "b")
    laid, vectors = laid.mapInArrow(_packed_rows, "cell int, body binary"), homes.mapInArrow(_packed_state(blocks), "cell int, centre boolean, body binary")
    schema = f"run int, id {kind.simpleString()}, centre boolean, block int, c array<double>, err double, w double, xent double, pairs double"
    parts = laid.groupBy("cell").cogroup(vectors.groupBy("cell")).applyInArrow(_sums(logit, blocks * blocks, to_arrow_type(kind)), schema)
    if logit.unrolled is None:
        wide = parts.groupBy("run", "id", "centre", "block").agg(
            F.array(*[F.sum(F.get("c", F.lit(i))) for i in range(nce.BLOCK)]).alias("g"), *[F.sum(c).alias(c) for c in ("err", "w", "xent", "pairs")])
        return nce.joined_blocks(wide, logit, ["run"])
    at_x, at_y = F.col("centre"), ~F.col("centre")
    add = lambda cond, e: F.sum(F.when(cond, e).otherwise(F.lit(0.0)))

    def side(cond: Column) -> Column:
        sums = [add(cond, F.col("c")[i]) for i in range(logit.width)]
        return F.array(*[-s if logit.geometry == "lorentz" and i == 0 else s for i, s in enumerate(sums)])

    return parts.groupBy("run", "id").agg(
        side(at_x).alias("g_in"), side(at_y).alias("g_out"), add(at_y, F.col("err")).alias("g_b"), add(at_x, F.col("w")).alias("n_in"),
        add(at_y, F.col("w")).alias("n_out"), add(at_x, F.col("xent")).alias("xent"), add(at_x, F.col("pairs")).alias("pairs"))


#: Pairs of the mini-batches that one call works on, on average.
BATCHED = 1 << 14


def _batch_sums(logit: nce.Logit, batch_size: int, kind: pa.DataType):
    """The work of a few whole mini-batches: pairs with their vectors and the batches' negatives in, ``(batch_id, id, g_in, g_out, g_b)`` out."""
    d = logit.width
    names = ["batch_id", "id", "g_in", "g_out", "g_b"]
    empty = pa.schema(list(zip(names, [pa.int64(), kind, pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64()]))).empty_table()
    wide = lambda c: np.ascontiguousarray(pc.list_flatten(c).to_numpy().reshape(-1, d).T)

    def work(key: tuple, pairs: pa.Table, drawn: pa.Table) -> pa.Table:
        if not pairs.num_rows:
            return empty
        real = pairs["vy"].is_valid()
        true, drawn = pairs.filter(real), drawn.sort_by("batch_id")
        n, m, own = pairs.num_rows, drawn.num_rows, np.flatnonzero(real.to_numpy())
        # one place for each (batch, id)
        coded = pa.chunked_array([*pairs["x"].chunks, *true["t"].chunks, *drawn["t"].chunks], kind).combine_chunks().dictionary_encode()
        batch, other = pairs["batch_id"].to_numpy(), drawn["batch_id"].to_numpy()
        ids, code = len(coded.dictionary), coded.indices.to_numpy().astype(np.int64)
        least = int(batch.min())
        spots, at = np.unique((np.concatenate([batch, batch[own], other]) - least) * ids + code, return_inverse=True)
        at_x, at_t, at_n = at[:n], at[n:n + len(own)], at[n + len(own):]
        # every pair meets its batch's negatives
        first, last = np.searchsorted(other, batch, "left"), np.searchsorted(other, batch, "right")
        count = last - first
        p = np.repeat(np.arange(n), count)
        q = np.arange(len(p)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
        vx = wide(pairs["vx"])
        met = [(at_x[own], at_t, vx[:, own], wide(true["vy"]), true["b"].to_numpy(), 1.0)]
        if m:
            met.append((at_x[p], at_n[q], vx[:, p], wide(drawn["vy"])[:, q], drawn["b"].to_numpy()[q], 0.0))
        g_in, g_out, g_b, touched = np.zeros((d, len(spots))), np.zeros((d, len(spots))), np.zeros(len(spots)), np.zeros(len(spots), bool)
        for xi, ti, u, v, b, label in met:
            with np.errstate(all="ignore"):
                _, err, du, dv = _scored(logit, u, v, b, np.ones(len(xi)), np.full(len(xi), label))
            touched[xi] = touched[ti] = True
            g_b += np.bincount(ti, err, len(spots))
            for i in range(d):
                mirror = -1.0 if logit.geometry == "lorentz" and i == 0 else 1.0
                g_in[i] += mirror * np.bincount(xi, du[i], len(spots))
                g_out[i] += mirror * np.bincount(ti, dv[i], len(spots))
        kept, k = np.flatnonzero(touched), 1.0 / batch_size
        lists = lambda g: pa.ListArray.from_arrays(pa.array(np.arange(len(kept) + 1, dtype=np.int32) * d), pa.array((g[:, kept] * k).T.ravel()))
        columns = [pa.array(spots[kept] // ids + least), coded.dictionary.take(pa.array(spots[kept] % ids)), lists(g_in), lists(g_out), pa.array(g_b[kept] * k)]
        return pa.Table.from_arrays(columns, names)

    return work


def batch_gradients(batches: DataFrame, negatives: DataFrame, state: DataFrame, logit: nce.Logit, batch_size: int) -> DataFrame:
    """``nce.nce_gradients`` of ``nce.nce_rows``: pairs travel with their vectors, their rows with the batch's negatives are made where they are summed.

    A call gets a few whole batches, which have a fixed size, so its sums are whole and move no further.
    """
    kind = state.schema["id"].dataType
    ins = state.select(F.col("id").alias("x"), F.col("w_in").alias("vx"))
    outs = lambda: state.select(F.col("id").alias("t"), F.col("w_out").alias("vy"), F.col("b").alias("b"))
    pairs = lookup_join(lookup_join(batches.select("batch_id", "x", F.col("y").alias("t")), ins, "x"), outs(), "t", "left")
    drawn = lookup_join(negatives.select("batch_id", F.col("id").alias("t")), outs(), "t")
    few = max(1, BATCHED // batch_size)
    schema = f"batch_id bigint, id {kind.simpleString()}, g_in array<double>, g_out array<double>, g_b double"
    grouped = lambda df: df.withColumn("_few", F.expr(f"batch_id div {few}")).groupBy("_few")
    return grouped(pairs).cogroup(grouped(drawn)).applyInArrow(_batch_sums(logit, batch_size, to_arrow_type(kind)), schema)
