"""Noise-contrastive loss and gradients in five geometries.

Rows are ``(x, t, vx, vy, b, label, w)``: centre, target, their vectors, the target's bias, whether
the pair is real, and how many equal pairs the row stands for. Every geometry states its logit
and how one row's gradient follows from a few scalars, so a row stays narrow until the sums.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saddle.functions import geometry as g
from saddle.functions.vectors import euclidean_sq, vec_dot, vec_norm_sq
from saddle.skew import lookup_join

GEOMETRIES = ("euclidean", "polar", "polar_hyperbolic", "poincare", "lorentz")

#: Coordinates that are summed by one row. Wider vectors are cut into blocks, so generated code does not grow with the width.
BLOCK = 16


@dataclass(frozen=True)
class Logit:
    """A geometry with the width of its stored vectors."""

    geometry: str
    size: int = 2
    sign: float = -1.0  # a distance enters as sign * distance; -1 pulls true pairs together
    margin: float = 0.0

    @property
    def width(self) -> int:
        if self.geometry == "lorentz":
            return self.size + 1
        return 2 if self.geometry.startswith("polar") else self.size

    @property
    def unrolled(self) -> int | None:
        """The width where products are written out; none for wide vectors."""
        return self.width if self.width <= BLOCK else None


def scored(rows: DataFrame, logit: Logit) -> DataFrame:
    """Adds ``logit``, ``xent`` (weighted cross entropy) and ``err`` (weighted sigmoid minus label)."""
    vx, vy, d = F.col("vx"), F.col("vy"), logit.unrolled
    if logit.geometry == "euclidean":
        out = rows.withColumn("logit", vec_dot(vx, vy, d) + F.col("b"))
    elif logit.geometry.startswith("polar"):
        out = rows.withColumn("logit", g.polar_inner(vx[0], vx[1], vy[0], vy[1]) + F.col("b"))
    elif logit.geometry == "poincare":
        out = rows.withColumns({"xy": vec_dot(vx, vy, d), "x2": vec_norm_sq(vx, d), "y2": vec_norm_sq(vy, d)})
        out = out.withColumn("gap", euclidean_sq(vx, vy, d))
        out = out.withColumn("logit", F.lit(logit.sign) * g.poincare_from_parts(F.col("gap"), F.col("x2"), F.col("y2")) + F.col("b"))
    else:
        out = rows.withColumn("xy", g.minkowski_dot(vx, vy, d))
        out = out.withColumn("logit", F.lit(logit.sign) * g.lorentz_from_dot(F.col("xy"), logit.margin) + F.col("b"))
    return out.withColumns({
        "xent": F.col("w") * g.sigmoid_xent("logit", "label"),
        "err": F.col("w") * (g.sigmoid("logit") - F.col("label")),
    })


def _coefficients(rows: DataFrame, logit: Logit) -> DataFrame:
    """Scalars with gradient of x = cxx x + cxy y and gradient of y = cyx x + cyy y."""
    zero, one = F.lit(0.0), F.lit(1.0)
    if logit.geometry == "euclidean":
        return rows.withColumns({"cxx": zero, "cxy": F.col("err"), "cyx": F.col("err"), "cyy": zero})
    if logit.geometry == "poincare":
        alpha, beta = one - F.col("x2"), one - F.col("y2")
        # sqrt(gamma^2 - 1) with gamma = 1 + e, without cancellation
        e = F.try_divide(F.lit(2.0) * F.col("gap"), alpha * beta)
        root = F.sqrt(e * (e + F.lit(2.0)))
        rows = rows.withColumns({"alpha": alpha, "beta": beta, "root": root})
        pull = F.lit(logit.sign) * F.col("err") * F.lit(4.0)
        kx = F.coalesce(F.try_divide(pull, F.col("beta") * F.col("root")), zero)
        ky = F.coalesce(F.try_divide(pull, F.col("alpha") * F.col("root")), zero)
        rows = rows.withColumns({"kx": kx, "ky": ky})
        a, b, xy = F.col("alpha"), F.col("beta"), F.col("xy")
        safe = lambda n, m: F.coalesce(F.try_divide(n, m), zero)
        return rows.withColumns({
            "cxx": safe(F.col("kx") * (F.col("y2") - 2 * xy + 1), a * a), "cxy": safe(-F.col("kx"), a),
            "cyx": safe(-F.col("ky"), b), "cyy": safe(F.col("ky") * (F.col("x2") - 2 * xy + 1), b * b)})
    # Lorentz: d(dist)/du = -J v / sqrt(dot^2 - 1), flat inside the margin
    active = -F.col("xy") > F.lit(1.0 + logit.margin)
    k = F.when(active, F.try_divide(F.lit(-logit.sign) * F.col("err"), F.sqrt(F.col("xy") * F.col("xy") - one)))
    k = F.coalesce(k, zero)
    return rows.withColumns({"cxx": zero, "cxy": k, "cyx": k, "cyy": zero})


def row_gradients(rows: DataFrame, logit: Logit) -> tuple[DataFrame, list[Column], list[Column]]:
    """Rows ready to sum, with the coordinates of the gradients of ``vx`` and ``vy``."""
    vx, vy = F.col("vx"), F.col("vy")
    if logit.geometry.startswith("polar"):
        gap = vx[1] - vy[1]
        rows = rows.withColumns({"cosg": F.cos(gap) * F.col("err"), "turn": vx[0] * vy[0] * F.sin(gap) * F.col("err")})
        return rows, [vy[0] * F.col("cosg"), -F.col("turn")], [vx[0] * F.col("cosg"), F.col("turn")]
    rows = _coefficients(rows, logit)
    mirror = [-1.0 if logit.geometry == "lorentz" and i == 0 else 1.0 for i in range(logit.width)]

    def mix(a: str, b: str) -> list[Column]:
        return [(F.col(a) * vx[i] + F.col(b) * vy[i]) * F.lit(mirror[i]) for i in range(logit.width)]

    return rows, mix("cxx", "cxy"), mix("cyx", "cyy")


def summed_gradients(rows: DataFrame, logit: Logit, by: list[str] | None = None) -> DataFrame:
    """Per vertex ``(id, g_in, g_out, g_b, w_in_sum, w_out_sum, xent)``: one pass, one shuffle.

    Each row feeds its centre and its target; sums combine before the shuffle, so a vertex may
    take part in any number of rows.
    """
    by = by or []
    if logit.unrolled is None:
        return _summed_in_blocks(rows, logit, by)
    ready, gx, gy = row_gradients(scored(rows, logit), logit)
    side_x = F.struct(F.col("x").alias("id"), F.lit(True).alias("centre"))
    side_y = F.struct(F.col("t").alias("id"), F.lit(False).alias("centre"))
    both = ready.withColumn("side", F.explode(F.array(side_x, side_y)))
    at_x, at_y = F.col("side.centre"), ~F.col("side.centre")
    add = lambda cond, e: F.sum(F.when(cond, e).otherwise(F.lit(0.0)))
    sums = both.groupBy(*by, F.col("side.id").alias("id")).agg(
        *[add(at_x, e).alias(f"gx{i}") for i, e in enumerate(gx)],
        *[add(at_y, e).alias(f"gy{i}") for i, e in enumerate(gy)],
        add(at_y, F.col("err")).alias("g_b"),
        add(at_x, F.col("w").cast("double")).alias("n_in"),
        add(at_y, F.col("w").cast("double")).alias("n_out"),
        add(at_x, F.col("xent")).alias("xent"),
        add(at_x & (F.col("label") == 1.0), F.col("w").cast("double")).alias("pairs"),
    )
    d = logit.width
    return sums.select(*by, "id", F.array(*[f"gx{i}" for i in range(d)]).alias("g_in"),
                       F.array(*[f"gy{i}" for i in range(d)]).alias("g_out"), "g_b", "n_in", "n_out", "xent", "pairs")


def _summed_in_blocks(rows: DataFrame, logit: Logit, by: list[str]) -> DataFrame:
    """As ``summed_gradients`` for wide vectors: sums per (vertex, side, block of coordinates), then one row per vertex."""
    ready = _coefficients(scored(rows, logit), logit)
    blocks = F.sequence(F.lit(0), F.lit(-(-logit.width // BLOCK) - 1))

    def cut(b: Column) -> Column:
        return F.struct(b.alias("block"), F.slice("vx", b * BLOCK + 1, BLOCK).alias("u"), F.slice("vy", b * BLOCK + 1, BLOCK).alias("v"))

    scalars = ["err", "w", "xent", "label"]
    sides = F.array(
        F.struct(F.col("x").alias("id"), F.lit(True).alias("centre"), F.col("cxx").alias("ku"), F.col("cxy").alias("kv")),
        F.struct(F.col("t").alias("id"), F.lit(False).alias("centre"), F.col("cyx").alias("ku"), F.col("cyy").alias("kv")))
    pieces = ready.select(*by, sides.alias("sides"), *scalars, F.explode(F.transform(blocks, cut)).alias("cut"))
    each = pieces.select(*by, "cut.*", *scalars, F.explode("sides").alias("side")).select(*by, "side.*", "block", "u", "v", *scalars)
    coordinates = [F.sum(F.col("ku") * F.get("u", F.lit(i)) + F.col("kv") * F.get("v", F.lit(i))) for i in range(BLOCK)]
    sums = each.groupBy(*by, "id", "centre", "block").agg(
        F.array(*coordinates).alias("g"), F.sum("err").alias("err"), F.sum(F.col("w").cast("double")).alias("w"), F.sum("xent").alias("xent"),
        F.sum(F.when(F.col("label") == 1.0, F.col("w").cast("double")).otherwise(F.lit(0.0))).alias("pairs"))
    return joined_blocks(sums, logit, by)


def joined_blocks(sums: DataFrame, logit: Logit, by: list[str]) -> DataFrame:
    """One row per vertex from its sums ``(by, id, centre, block, g, err, w, xent, pairs)``."""
    at_x, at_y = (F.col("block") == 0) & F.col("centre"), (F.col("block") == 0) & ~F.col("centre")
    add = lambda cond, e: F.sum(F.when(cond, F.col(e)).otherwise(F.lit(0.0)))
    # two sides of a fixed number of blocks
    whole = sums.groupBy(*by, "id").agg(
        F.sort_array(F.collect_list(F.struct("centre", "block", "g"))).alias("cuts"), add(at_y, "err").alias("g_b"), add(at_x, "w").alias("n_in"),
        add(at_y, "w").alias("n_out"), add(at_x, "xent").alias("xent"), add(at_x, "pairs").alias("pairs"))

    def side(centre: bool) -> Column:
        own = F.filter("cuts", lambda c: c["centre"] == F.lit(centre))
        found = F.slice(F.flatten(F.transform(own, lambda c: c["g"])), 1, logit.width)
        return F.when(F.size(own) > 0, g.metric_transform(found) if logit.geometry == "lorentz" else found).otherwise(
            F.array_repeat(F.lit(0.0), logit.width))

    return whole.select(*by, "id", side(True).alias("g_in"), side(False).alias("g_out"), "g_b", "n_in", "n_out", "xent", "pairs")


def nce_rows(batches: DataFrame, negatives: DataFrame, state: DataFrame) -> DataFrame:
    """Rows of mini-batches ``(batch_id, x, y)`` with the batch's negatives ``(batch_id, id)``."""
    ins = state.select(F.col("id").alias("x"), F.col("w_in").alias("vx"))
    outs = state.select(F.col("id").alias("t"), F.col("w_out").alias("vy"), "b")
    centres = lookup_join(batches.select("batch_id", "x", F.col("y").alias("t")), ins, "x")
    positive = lookup_join(centres, outs, "t").withColumn("label", F.lit(1.0))
    noise = lookup_join(negatives.select("batch_id", F.col("id").alias("t")), outs, "t")
    # batches have a fixed size, so this join's groups do too
    negative = centres.drop("t").join(noise, "batch_id").withColumn("label", F.lit(0.0))
    return positive.unionByName(negative.select(*positive.columns)).withColumn("w", F.lit(1.0))


def nce_loss(rows: DataFrame, logit: Logit, batch_size: int) -> DataFrame:
    """Summed cross entropy of each batch over the batch size."""
    return scored(rows, logit).groupBy("batch_id").agg((F.sum("xent") / F.lit(float(batch_size))).alias("loss"))


def nce_gradients(rows: DataFrame, logit: Logit, batch_size: int) -> DataFrame:
    """Per batch and vertex the summed gradients over the batch size."""
    sums = summed_gradients(rows, logit, ["batch_id"])
    k = 1.0 / batch_size
    return sums.select("batch_id", "id", F.transform("g_in", lambda v: v * k).alias("g_in"),
                       F.transform("g_out", lambda v: v * k).alias("g_out"), (F.col("g_b") * k).alias("g_b"))
