"""Positions and running sums over whole tables without moving a table to one task.

Rows are range partitioned on the full order, sorted inside each partition and written
once. A position is then (rows in earlier partitions) + (place in the own partition); only
one number per partition reaches the driver. Equal leading keys spread over several
partitions, so one key may hold any share of the rows.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from saddle.storage import materialise

_MASK = (1 << 33) - 1


def ordered(df: DataFrame, order: list) -> DataFrame:
    """The rows of ``df`` written in ``order``, with ``_pid`` (range) and ``_pos`` (place in it)."""
    ranged = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    stored = materialise(ranged)
    return stored.withColumn("_pid", F.shiftright("_mid", 33)).withColumn(
        "_pos", F.col("_mid").bitwiseAND(F.lit(_MASK))
    ).drop("_mid")


def exclusive_prefix(stored: DataFrame, total: Column) -> Column:
    """Per row, the sum of the whole-number ``total`` over all earlier ranges."""
    per_range = {r[0]: r[1] for r in stored.groupBy("_pid").agg(total).collect()}
    running, values = 0, []
    for pid in range(max(per_range, default=-1) + 1):
        values.append(running)
        running += per_range.get(pid) or 0
    literal = ",".join(f"{v}L" for v in values) or "0L"
    return F.expr(f"array({literal})")[F.col("_pid").cast("int")]


def global_index(df: DataFrame, order: list, name: str = "idx", start: int = 0) -> DataFrame:
    """Contiguous positions from ``start`` in ``order`` (which must break all ties that matter)."""
    stored = ordered(df, order)
    before = exclusive_prefix(stored, F.count(F.lit(1)))
    return stored.withColumn(name, before + F.col("_pos") + F.lit(start)).drop("_pid", "_pos")


def running_total(df: DataFrame, value: str, order: list, name: str) -> DataFrame:
    """Inclusive running sum of the whole-number column ``value`` in ``order``."""
    stored = ordered(df, order)
    before = exclusive_prefix(stored, F.sum(value))
    inside = Window.partitionBy("_pid").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    return stored.withColumn(name, before + F.sum(value).over(inside)).drop("_pid", "_pos")


def _changes(array: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before it; null equals null, and NaN NaN."""
    later, earlier = array[1:], array[:-1]
    differ = pc.not_equal(later, earlier)
    if pa.types.is_floating(array.type):
        differ = pc.and_(differ, pc.invert(pc.and_(pc.is_nan(later), pc.is_nan(earlier))))
    one_null = pc.xor(pc.is_null(later), pc.is_null(earlier))
    return np.asarray(pc.if_else(pc.is_null(differ), one_null, differ))


def _numbered(names: list[str], gap: int | None):
    """Adds to a range's sorted rows ``_pid``, ``_pos``, ``_run`` (openings of the key so far) and ``_ends`` (the key's last row)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, pos, run = TaskContext.get().partitionId(), 0, 0
        held, last = None, None

        def out(batch: pa.RecordBatch, runs: np.ndarray, ends: np.ndarray, at: int) -> pa.RecordBatch:
            more = [pa.array(np.full(len(runs), pid, np.int32)), pa.array(np.arange(at, at + len(runs))), pa.array(runs), pa.array(ends)]
            return pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "_pid", "_pos", "_run", "_ends"])

        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.ones(batch.num_rows, dtype=bool)
            seen = batch if last is None else pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
            first = int(last is None)
            change = np.zeros(seen.num_rows - 1, dtype=bool)
            for name in names:
                change |= _changes(seen[name])
            new[first:] = change
            opens = np.ones(batch.num_rows, dtype=bool)
            if gap is not None:
                known, at = np.asarray(seen["_at"].is_valid()), np.asarray(pc.fill_null(seen["_at"], 0))
                opens[first:] = change | ~known[:-1] | (np.diff(at) > gap)
            total = np.cumsum(opens) + run
            # openings before the key's first row, carried along its rows
            base = np.maximum.accumulate(np.where(new, total - 1, 0))
            runs = total - np.where(np.maximum.accumulate(new), base, 0)
            if held is not None:
                held[2][-1] = new[0]
                yield out(*held)
            ends = np.append(new[1:], True)
            held, last = (batch, runs, ends, pos), batch.slice(batch.num_rows - 1)
            pos, run = pos + batch.num_rows, int(runs[-1])
        if held is not None:
            yield out(*held)

    return work


def counted(df: DataFrame, keys: list[str], order: list, name: str, at: Column | None = None, gap: int | None = None, last: str | None = None) -> DataFrame:
    """Adds ``name``: the row's number from 1 inside its key in ``order``, null being a key.

    With ``gap``, only rows whose whole number ``at`` is more than ``gap`` past that of the row before count, those behind a null
    and each key's first. ``last`` names a column that is true on each key's last row.

    Rows are sorted by ranges of (keys, order), so a key fills as many ranges as it needs, and are numbered while they are
    written; only a range's first key goes on from earlier ranges, with one number per range.
    """
    by = [*[F.col(k) for k in keys], *order]
    ranged = df.withColumn("_at", F.lit(0).cast("bigint") if at is None else at.cast("bigint")).repartitionByRange(*by).sortWithinPartitions(*by)
    fields = [*ranged.schema.fields, *[StructField(n, t) for n, t in (("_pid", IntegerType()), ("_pos", LongType()), ("_run", LongType()), ("_ends", BooleanType()))]]
    stored = materialise(ranged.mapInArrow(_numbered(keys, gap), StructType(fields)))

    key, row = F.struct(*keys), Window.orderBy("_pid")
    side = F.struct(key.alias("key"), "_at", "_run", "_pos")
    edges = stored.groupBy("_pid").agg(F.min_by(side, "_pos").alias("a"), F.max_by(side, "_pos").alias("z"))  # one row a range
    before, after = F.lag("z").over(row), F.lead("a.key").over(row)
    goes_on = before["key"].eqNullSafe(F.col("a.key")) & before.isNotNull()
    joined = F.coalesce(F.lit(False) if gap is None else goes_on & (F.col("a._at") - before["_at"] <= gap), F.lit(False)).cast("int")
    edges = edges.withColumns({"_joined": joined, "_stops": ~(after.eqNullSafe(F.col("z.key")) & after.isNotNull())})
    own = F.col("z._run") - F.when(F.col("a.key").eqNullSafe(F.col("z.key")), F.col("_joined")).otherwise(0)
    gathered = edges.select("_pid", F.col("z.key").alias("_key"), own.alias("_n"), F.lit(False).alias("_asks"), "_joined", "_stops", F.col("z._pos").alias("_last"))
    asked = edges.select("_pid", F.col("a.key").alias("_key"), F.lit(0).cast("bigint").alias("_n"), F.lit(True).alias("_asks"), "_joined", "_stops", F.col("z._pos").alias("_last"))
    earlier = Window.partitionBy("_key").orderBy("_pid").rangeBetween(Window.unboundedPreceding, -1)
    carried = gathered.unionByName(asked).withColumn("_carry", F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_joined")).where("_asks")
    # one row a range, written, so no reader of the result works the edges out anew
    whole = stored.join(F.broadcast(materialise(carried.select("_pid", "_key", "_carry", "_stops", "_last"))), "_pid")
    number = F.col("_run") + F.when(key.eqNullSafe(F.col("_key")), F.col("_carry")).otherwise(0)
    out = [*df.columns, number.cast("bigint").alias(name)]
    if last is not None:
        out.append(F.when(F.col("_pos") == F.col("_last"), F.col("_stops")).otherwise(F.col("_ends")).alias(last))
    return whole.select(*out)


def _followed(keys: int, window: int):
    """Pairs inside a range of sorted rows ``(keys, value)``, and the range's first and last rows, whose pairs may cross its ends."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, rows = TaskContext.get().partitionId(), 0
        head, tail = None, None
        names = ["x", "y", "k", "_pid", "_pos", *[f"_k{i}" for i in range(keys)]]

        def at_end(part: pa.RecordBatch, first: int) -> pa.RecordBatch:
            n, values = part.num_rows, part.column(keys)
            more = [pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, pid, np.int32)), pa.array(np.arange(first, first + n))]
            return pa.RecordBatch.from_arrays([values, pa.nulls(n, values.type), *more, *part.columns[:keys]], names)

        def joined(a: pa.RecordBatch | None, b: pa.RecordBatch) -> pa.RecordBatch:
            return b if a is None else pa.Table.from_batches([a, b]).combine_chunks().to_batches()[0]

        for batch in batches:
            if not batch.num_rows:
                continue
            seen = joined(tail, batch)
            n, carried, values = seen.num_rows, seen.num_rows - batch.num_rows, seen.column(keys)
            change = np.zeros(n - 1, dtype=bool)
            for i in range(keys):
                change |= _changes(seen.column(i))
            group = np.concatenate([[0], np.cumsum(change)])
            for k in range(1, min(window, n - 1) + 1):
                a = max(0, carried - k)  # pairs of two carried rows are out already
                here = np.flatnonzero(group[a:n - k] == group[a + k:]) + a
                empty = [pa.nulls(len(here), t) for t in (pa.int32(), pa.int64(), *[c.type for c in seen.columns[:keys]])]
                pair = [values.take(pa.array(here)), values.take(pa.array(here + k)), pa.array(np.full(len(here), k, np.int32))]
                yield pa.RecordBatch.from_arrays([*pair, *empty], names)
            if rows < window:
                head = joined(head, batch.slice(0, window - rows))
            rows, tail = rows + batch.num_rows, seen.slice(max(0, n - window))
        if head is not None:
            yield at_end(head, 0)
            first = max(head.num_rows, rows - tail.num_rows)
            yield at_end(tail.slice(tail.num_rows - (rows - first)), first)

    return work


def followers(df: DataFrame, keys: list[str], order: list, value: str, window: int) -> DataFrame:
    """``(x, y, k)``: each row's ``value`` beside that of the row ``k`` places on, up to ``window``, inside its key in ``order``, null being a key.

    Rows are sorted by ranges of (keys, order), as in ``counted``, and pairs are made while a range is written, so nothing is numbered or dealt
    by key. Pairs across the ends of ranges come from the first and last ``window`` rows of each.
    """
    by = [*[F.col(k) for k in keys], *order]
    ranged = df.repartitionByRange(*by).sortWithinPartitions(*by).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(value).alias("x"))
    kinds = [f.dataType for f in ranged.schema.fields]
    fields = [("x", kinds[-1]), ("y", kinds[-1]), ("k", IntegerType()), ("_pid", IntegerType()), ("_pos", LongType()), *[(f"_k{i}", t) for i, t in enumerate(kinds[:-1])]]
    stored = materialise(ranged.mapInArrow(_followed(len(keys), window), StructType([StructField(n, t) for n, t in fields])))

    row = Window.orderBy("_pid", "_pos")  # at most 2 * window rows a range
    own = F.struct(*[f"_k{i}" for i in range(len(keys))])
    ends = stored.where("k = 0").withColumn("_row", F.struct(F.col("_pid").alias("pid"), own.alias("key"), F.col("x").alias("y")))
    later = F.array(*[F.struct(F.lit(k).alias("k"), F.lead("_row", k).over(row).alias("row")) for k in range(1, window + 1)])
    crossed = ends.withColumn("_later", later).select("x", "_pid", own.alias("key"), F.explode("_later").alias("n")).where(
        (F.col("n.row.pid") != F.col("_pid")) & F.col("n.row.key").eqNullSafe(F.col("key")))
    crossing = materialise(crossed.select("x", F.col("n.row.y").alias("y"), F.col("n.k").alias("k")))
    return stored.where("k > 0").select("x", "y", "k").unionByName(crossing)
