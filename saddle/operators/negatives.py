"""Noise distribution and negative samples.

Weights are whole numbers (``freq ** power`` in millionths), so their running sums are exact and
do not depend on the partitioning. A draw is a whole number below the total weight; it finds its
id by an equi-join on equal slices of the weight line.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saddle.functions.uniform import uniform
from saddle.ordering import running_total
from saddle.storage import materialise

UNIT = 1_000_000
FAN = 1024


def _weighted(vocab: DataFrame, power: float, id_col: str, *keep: str) -> DataFrame:
    return vocab.select(
        *keep, F.col(id_col).alias("id"),
        F.round(F.pow(F.col("freq").cast("double"), F.lit(power)) * F.lit(float(UNIT))).cast("bigint").alias("weight"))


def noise_lines(vocab: DataFrame, by: str, power: float = 0.75, id_col: str = "idx") -> DataFrame:
    """``(by, id, weight, lo, hi)``: the lines of all values of ``by`` one after another, each in index order."""
    run = running_total(_weighted(vocab, power, id_col, by), "weight", [by, "id"], "hi")
    return run.select(by, "id", "weight", (F.col("hi") - F.col("weight")).alias("lo"), "hi")


def noise_distribution(vocab: DataFrame, power: float = 0.75, id_col: str = "idx") -> DataFrame:
    """``(id, weight, lo, hi, p, cum)``: P proportional to ``freq ** power`` in index order."""
    weighted = _weighted(vocab, power, id_col)
    run = running_total(weighted, "weight", ["id"], "hi")
    total = weighted.select(F.sum("weight")).scalar()
    return run.select("id", "weight", (F.col("hi") - F.col("weight")).alias("lo"), "hi",
                      (F.col("weight") / total).alias("p"), (F.col("hi") / total).alias("cum"))


def locate_draws(draws: DataFrame, noise: DataFrame, total: int, size: int, heaviest: int) -> DataFrame:
    """Attach to each draw ``at`` in [0, total) the id whose ``[lo, hi)`` holds it, and these bounds.

    The line is cut into about as many slices as there are ids. An id that would cover more than
    ``FAN`` slices moves to a grid ``FAN`` times coarser, and so on, so no id is copied more often
    and a slice of any grid meets two ids on average. A draw looks into each grid in use.
    """
    width = max(1, total // max(1, size))
    grids = [width]
    while heaviest > grids[-1] * FAN:
        grids.append(grids[-1] * FAN)
    grid = F.lit(len(grids) - 1)
    for level in reversed(range(len(grids) - 1)):
        grid = F.when(F.col("weight") <= grids[level] * FAN, F.lit(level)).otherwise(grid)
    step = F.array(*[F.lit(w).cast("bigint") for w in grids])
    spans = (
        noise.where("weight > 0").withColumn("_grid", grid).withColumn("_step", step[F.col("_grid")])
        .select("id", "lo", "hi", "_grid", F.explode(F.expr("sequence(lo div _step, (hi - 1) div _step)")).alias("_slice"))
    )
    looks = draws.select("*", F.posexplode(step).alias("_grid", "_step")).withColumn("_slice", F.expr("at div _step"))
    return (
        looks.drop("_step").join(spans, ["_grid", "_slice"])
        .where((F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi")))
        .drop("_grid", "_slice")
    )


def _place(total: int, seed: str, *keys: str | Column) -> Column:
    return F.floor(uniform(seed, *keys) * F.lit(float(total))).cast("bigint")


def _line(noise: DataFrame) -> tuple[int, int, int]:
    """Total weight, number of ids that have any, and the largest weight."""
    row = noise.agg(F.max("hi").alias("total"), F.count_if(F.col("weight") > 0).alias("size"), F.max("weight").alias("heaviest")).first()
    return int(row["total"]), int(row["size"]), int(row["heaviest"])


def _shifted(at: Column, found: Column) -> Column:
    """``at`` on the line without the intervals ``found`` (sorted), moved to its place on the whole line."""
    return F.aggregate(found, at, lambda a, f: F.when(a >= f["lo"], a + f["hi"] - f["lo"]).otherwise(a))


def _segments(noise: DataFrame, by: str) -> DataFrame:
    """``(by, base, length, ids)``: where each line begins, its total weight and its number of ids with any; one row a line."""
    return noise.where("weight > 0").groupBy(by).agg(F.min("lo").alias("base"), F.sum("weight").alias("length"), F.count(F.lit(1)).alias("ids"))


def negative_samples(batches: DataFrame, noise: DataFrame, n: int, seed: str | Column = "neg", block: int = 1, by: str | None = None) -> DataFrame:
    """``(batch_id, rank, id)``: per batch ``n`` distinct ids, in the order drawn.

    A batch's next id is drawn from what its earlier ids leave of the line, which is the law of
    drawing until ``n`` distinct ids have come, in exactly ``n`` draws however heavy one id is. With
    fewer than ``n`` ids, all are returned. Draws are written every ``block`` steps; steps that run as one stage grow past what the JVM compiles.
    With ``by``, batches are ``(by, batch_id)`` and each value of it draws from its own line of ``noise_lines``.
    """
    noise = materialise(noise)
    total, size, heaviest = _line(noise)
    keys = ["batch_id"] if by is None else [by, "batch_id"]
    kind = "array<struct<lo:bigint,hi:bigint,id:%s,rank:int>>" % noise.schema["id"].dataType.simpleString()
    slices = int(noise.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    state = batches.select(*keys).repartition(slices, *keys).distinct().withColumn("found", F.array().cast(kind))
    if by is None:
        state = state.withColumns({"base": F.lit(0).cast("bigint"), "length": F.lit(total).cast("bigint"), "ids": F.lit(size).cast("bigint")})
        fewest = most = size
    else:
        lines = materialise(_segments(noise, by))
        state = state.join(F.broadcast(lines), by)  # one row a line
        fewest, most = lines.agg(F.min("ids"), F.max("ids")).first()
    noise, steps = noise.select("id", "weight", "lo", "hi"), min(n, most or 0)
    # hashed once and written: filters and joins of the steps would each work them out anew
    state = materialise(state.withColumn("u", F.array(*[uniform(seed, "batch_id", F.lit(k)) for k in range(steps)]).cast("array<double>")))
    line = ["base", "length", "ids", "u"]
    for k in range(steps):
        used = F.aggregate("found", F.lit(0).cast("bigint"), lambda a, f: a + f["hi"] - f["lo"])
        at = F.col("base") + F.floor(F.get("u", F.lit(k)) * (F.col("length") - used).cast("double")).cast("bigint")
        asking = state if k < fewest else state.where(F.col("ids") > k)
        drawn = locate_draws(asking.withColumn("at", _shifted(at, F.col("found"))), noise, total, size, heaviest)
        one = F.struct("lo", "hi", "id", F.lit(k + 1).alias("rank"))
        moved = drawn.select(*keys, F.sort_array(F.concat("found", F.array(one))).alias("found"), *line)
        state = moved if k < fewest else moved.unionByName(state.where(F.col("ids") <= k))
        if (k + 1) % block == 0 and k + 1 < steps:
            state = materialise(state)
    return state.select(*keys, F.explode("found").alias("f")).select(*keys, "f.rank", "f.id")


#: Draws of a counted pair that are made from one row.
DRAWS = 1024


def drawn_negatives(pairs: DataFrame, noise: DataFrame, n: int, keys: list[str], centre: str, label: str, seed: str | Column = "neg",
                    by: str | None = None) -> DataFrame:
    """``(by, centre, id)``: for counted pairs ``(by, keys, n)`` the ``n`` x count draws with replacement, one row a draw, without those of a pair's own label.

    A pair that stands for many is cut into rows of ``DRAWS`` draws and dealt anew, so it fills as many tasks as it needs.
    """
    noise = materialise(noise)
    total, size, heaviest = _line(noise)
    if by is None:
        placed = pairs.withColumns({"base": F.lit(0).cast("bigint"), "length": F.lit(total).cast("bigint")})
    else:
        placed = pairs.join(F.broadcast(_segments(noise, by).drop("ids")), by)  # one row a line
    cut = placed.withColumn("_cut", F.explode(F.expr(f"sequence(0L, (n * {n} - 1) div {DRAWS})"))).repartition(*keys, "_cut")
    drawn = cut.withColumn("draw", F.explode(F.expr(f"sequence(_cut * {DRAWS}, least((_cut + 1) * {DRAWS}, n * {n}) - 1)")))
    at = F.col("base") + F.floor(uniform(seed, *keys, "draw") * F.col("length").cast("double")).cast("bigint")
    own = [by] if by else []
    found = locate_draws(drawn.select(*own, centre, label, at.alias("at")), noise.select("id", "weight", "lo", "hi"), total, size, heaviest)
    return found.where(F.col("id") != F.col(label)).select(*own, centre, "id")


def counted_negatives(pairs: DataFrame, noise: DataFrame, n: int, keys: list[str], centre: str, label: str, seed: str | Column = "neg",
                      by: str | None = None) -> DataFrame:
    """``(by, centre, id, w)``: how often each centre draws each id in ``drawn_negatives``."""
    return drawn_negatives(pairs, noise, n, keys, centre, label, seed, by).groupBy(*([by] if by else []), centre, "id").agg(F.count(F.lit(1)).alias("w"))


def negative_samples_per_pair(pairs: DataFrame, noise: DataFrame, n: int, keys: list[str],
                              label: str, seed: str = "neg") -> DataFrame:
    """``n`` draws with replacement per pair; draws that hit the pair's own label are skipped."""
    noise = materialise(noise)
    total, size, heaviest = _line(noise)
    draws = pairs.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn(
        "at", _place(total, seed, *keys, "draw"))
    drawn = locate_draws(draws, noise, total, size, heaviest)
    return drawn.where(F.col("id") != F.col(label)).drop("at", "lo", "hi")


def batch_cross_negatives(examples: DataFrame, negatives: DataFrame) -> DataFrame:
    """Every example beside its batch's shared negatives: an equi-join on ``batch_id``.

    A batch holds a fixed number of examples and ``n`` negatives, so no batch can grow hot.
    """
    return examples.join(negatives.select("batch_id", F.col("id").alias("neg")), "batch_id")
