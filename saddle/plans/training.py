"""Synchronous training of vertex embeddings.

Equal pairs are counted once and carry their count. An epoch runs in rounds; each round is one
job: bring pairs and shared negatives together with both vectors in the cells of a grid, sum gradients
per vertex, step on the manifold, write the new state. The state table is the only thing that passes from round to
round, so a lost executor costs at most one round's tasks. A round's state goes when the next is written; the pairs,
negatives and all else that is written on the way go with the last.
"""
from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saddle.functions import geometry as g
from saddle.functions.uniform import uniform, uniform_bin
from saddle.functions.vectors import clip_by_norm, combine
from saddle.operators.cells import blocks_for, dealt_packed, summed_in_cells
from saddle.operators.corpus import cooccurrence, learning_rate, mixed_schedule
from saddle.operators.negatives import drawn_negatives, negative_samples, noise_lines
from saddle.operators.nce import Logit
from saddle.operators.sentences import random_walks, walk_tokens
from saddle.storage import bucketed, drop, materialise, new_name, passing, shared_folder, shuffles_go


@dataclass(frozen=True)
class Params:
    geometry: str = "poincare"
    size: int = 2
    window: int = 5
    negatives: int = 5
    epochs: int = 5
    rounds: int = 4  # state updates per epoch
    batch_size: int = 64  # distinct pairs per drawn set of negatives
    sets: int = 8  # sets of negatives a centre meets in one round
    learning_rate: float = 0.2
    max_norm: float = 1.0
    sign: float = -1.0
    margin: float = 0.0
    power: float = 0.75
    per_pair: bool = False  # every pair draws its own negatives, in place of sets drawn for many pairs
    seed: str = "0"

    @property
    def logit(self) -> Logit:
        return Logit(self.geometry, self.size, self.sign, self.margin)


@dataclass
class Trained:
    state: DataFrame  # (id, w_in, w_out, b, e_out)
    params: Params
    log: list[dict] = field(default_factory=list)

    def stats(self, spark: SparkSession) -> DataFrame:
        """One row per round: epoch, step, lr, loss, pairs and pairs per second."""
        kinds = "epoch int, step int, lr double, loss double, pairs double, pairs_per_second double"
        return spark.createDataFrame(self.log, kinds)

    def vectors(self) -> DataFrame:
        """``(id, v)``: the input embedding; polar and hyperboloid points as points of the unit ball."""
        w = F.col("w_in")
        if self.params.geometry == "lorentz":
            w = g.hyperboloid_to_poincare(w)
        elif self.params.geometry == "polar_hyperbolic":
            w = g.polar_to_poincare(w[0], w[1])
        elif self.params.geometry == "polar":
            w = g.polar_to_cartesian(w[0], w[1])
        return self.state.select("id", w.alias("v"))


# -- start and step ------------------------------------------------------------------------

def initial_state(ids: DataFrame, runs: list[Params]) -> DataFrame:
    """Start vectors of ``ids(run, id)``; Euclidean output vectors start at zero."""
    params = runs[0]
    width = 0.5 / params.size

    def start(side: str) -> Column:
        seed = _seeds(runs, side)
        if params.geometry == "lorentz":
            return g.init_hyperboloid(seed, "id", params.size)
        if params.geometry == "polar":
            return g.init_polar(seed, "id", width, 0.0)
        if params.geometry == "polar_hyperbolic":
            return g.init_polar(seed, "id", width, 1.0)
        return g.init_uniform(seed, "id", params.size)

    out = F.array_repeat(F.lit(0.0), params.size) if params.geometry == "euclidean" else start("out")
    return ids.select("run", "id", start("in").alias("w_in"), out.alias("w_out"), F.lit(0.0).alias("b"))


def warm_state(ids: DataFrame, runs: list[Params], init: DataFrame) -> DataFrame:
    """Given vectors where ``init(run, id, w_in, w_out, b)`` has them, start vectors elsewhere."""
    known = init.select("run", "id", F.struct("w_in", "w_out", "b").alias("old"))
    fresh = initial_state(ids, runs).join(known, ["run", "id"], "left")
    return fresh.select("run", "id", *[F.coalesce(F.col(f"old.{c}"), F.col(c)).alias(c) for c in ("w_in", "w_out", "b")])


def step(w: str, grad: str, params: Params, lr: float) -> Column:
    """One vertex' move against its gradient, staying on the manifold."""
    safe = g.remove_nan_grad(grad)
    if params.geometry == "lorentz":
        return g.rsgd_lorentz(w, safe, lr, params.max_norm)
    if params.geometry == "poincare":
        scaled = clip_by_norm(g.poincare_grad_scale(w, safe), params.max_norm)
        return g.project_to_ball(combine(w, scaled, F.lit(1.0), F.lit(-lr)))
    clipped = clip_by_norm(safe, params.max_norm)
    if params.geometry == "euclidean":
        return combine(w, clipped, F.lit(1.0), F.lit(-lr))
    # polar: the angular part is a gradient per unit of arc
    r, theta = F.col(w)[0], F.col(w)[1]
    turn = F.coalesce(g.polar_theta_grad_scale(clipped[1], r, params.geometry == "polar_hyperbolic"), F.lit(0.0))
    bound = F.greatest(F.least(turn, F.lit(params.max_norm)), F.lit(-params.max_norm))
    return F.array(F.greatest(r - F.lit(lr) * clipped[0], F.lit(1e-6)), theta - F.lit(lr) * bound)


def _mean(grad: str, count: str) -> Column:
    return F.transform(F.col(grad), lambda v: F.coalesce(F.try_divide(v, F.col(count)), F.lit(0.0)))


# -- the loop ------------------------------------------------------------------------------

#: What the runs that are trained together may differ in.
FREE = ("seed", "batch_size", "sets", "window")


def _per_run(values: list) -> Column:
    """The value of the row's run."""
    return F.lit(values[0]) if len(values) == 1 else F.array(*[F.lit(v) for v in values])[F.col("run")]


def _seeds(runs: list[Params], name: str) -> Column:
    return _per_run([f"{p.seed}-{name}" for p in runs])


#: Pairs, or what makes them: then all that is written to make them goes once the pairs are stored.
Pairs = DataFrame | Callable[[], DataFrame]


def _made(pairs: Pairs) -> DataFrame:
    return pairs if isinstance(pairs, DataFrame) else pairs()


def train(pairs: Pairs, params: Params, init: DataFrame | None = None, save_to: str | None = None,
          start_step: int = 0) -> Trained:
    """Train on counted pairs ``(x, y, n)``. ``save_to`` keeps every round's state for ``resume``.

    Pairs are dealt over the rounds of an epoch by a hash. With a column ``round`` (0 to ``params.rounds`` - 1) the pairs are a
    schedule: each round trains on its own rows.
    """
    one = None if init is None else init.withColumn("run", F.lit(0))
    return train_many(lambda: _made(pairs).withColumn("run", F.lit(0)), [params], one, save_to, start_step)[0]


def each_run(pairs: DataFrame, n: int) -> DataFrame:
    """``pairs(x, y, n)`` for each of ``n`` runs."""
    return pairs.withColumn("run", F.explode(F.array(*[F.lit(i) for i in range(n)])))


def train_many(pairs: Pairs, runs: list[Params], init: DataFrame | None = None, save_to: str | None = None,
               start_step: int = 0) -> list[Trained]:
    """Train runs side by side on counted pairs ``(run, x, y, n)``: state, pairs and negatives are keyed by run, and a round is one job for all.

    ``runs[i]`` has the settings of run i; they may differ in ``FREE`` only. Pairs without ``run`` are those of every run.
    """
    return train_widths(pairs, runs, [runs[0].size], init, save_to, start_step)[0]


def train_widths(pairs: Pairs, runs: list[Params], widths: list[int], init: DataFrame | None = None, save_to: str | None = None,
                 start_step: int = 0) -> list[list[Trained]]:
    """As ``train_many`` for each of ``widths``: pairs, noise, sets and negatives are the same for all, so they are made and written once."""
    spark, params = SparkSession.active(), runs[0]
    for other in runs:
        if replace(other, **{f: getattr(params, f) for f in FREE}) != params:
            raise ValueError(f"runs trained together may differ in {', '.join(FREE)} only")
    scratch = [new_name(), new_name(), new_name()]  # pairs, negatives and sets
    with passing(spark):
        trained = _trained(pairs, runs, widths, init, save_to, start_step, scratch)
    for name in scratch:
        drop(spark, name)
    return trained


def _trained(pairs: Pairs, runs: list[Params], widths: list[int], init: DataFrame | None, save_to: str | None, start_step: int,
             scratch: list[str]) -> list[list[Trained]]:
    spark, params = SparkSession.active(), runs[0]
    with passing(spark):
        pairs = _made(pairs)
        # dealt before the runs part, so a centre's pairs are together and travel once
        pairs = dealt_packed(pairs, _slices(spark), *[c for c in ("run", "x") if c in pairs.columns])
        # runs that share pairs, rounds and sets share what is written of them, and part where rows meet negatives
        shared = "run" not in pairs.columns and len({(p.seed, p.sets) for p in runs}) == 1
        if "run" not in pairs.columns:
            pairs = pairs.withColumn("run", F.lit(0)) if shared else each_run(pairs, len(runs))
        kinds = runs[:1] if shared else runs
        spread = (lambda df: each_run(df.drop("run"), len(runs))) if shared else (lambda df: df)
        if "round" not in pairs.columns:
            pairs = pairs.withColumn("round", uniform_bin(params.rounds, _seeds(kinds, "round"), "x", "y").cast("int"))
        stored = _by_round(pairs, scratch[0])

    # written: sizes, noise, expected weights and ids come from these counts, so the pairs are read for them once
    met = materialise(stored.groupBy("run", F.col("y").alias("id")).agg(F.sum("n").alias("freq"), F.count(F.lit(1)).alias("rows")))
    counts = spread(met)
    sizes = {r["run"]: r for r in counts.groupBy("run").agg(F.sum("freq").alias("pairs"), F.sum("rows").alias("rows")).collect()}  # one row a run
    groups = [max(1, -(-(sizes[i]["rows"] if i in sizes else 0) // (p.rounds * p.batch_size))) for i, p in enumerate(runs)]
    drawn_pairs = _per_run([float(params.negatives * (sizes[i]["pairs"] if i in sizes else 0)) for i in range(len(runs))])
    noise = materialise(noise_lines(counts, "run", params.power, "id"))
    whole = noise.groupBy("run").agg(F.sum("weight").alias("whole"))
    ids = spread(materialise(stored.select("run", F.col("x").alias("id")).distinct().unionByName(met.select("run", "id")).distinct()))
    # weight a target meets per round on average: its own pairs and its draws as a negative
    weights = counts.join(noise, ["run", "id"]).join(F.broadcast(whole), "run")  # one row a run
    expected = weights.select("run", "id", ((F.col("freq") + F.col("weight") / F.col("whole") * drawn_pairs) / params.rounds).alias("e_out"))

    steps = params.epochs * params.rounds
    sets = negatives = None
    # rows of a round and run: its pairs with the draws of each, or with those of each set that a centre meets
    if params.per_pair:
        most = max([sizes[i]["pairs"] * params.negatives // params.rounds for i in sizes], default=0)
    else:
        written = _sets(stored, kinds, range(start_step, steps), scratch[2])
        met_by = written.groupBy("run", "step").agg(F.count(F.lit(1)).alias("n"))
        parts = {r["run"]: r["n"] for r in met_by.groupBy("run").agg(F.max("n").alias("n")).collect()}  # one row a run
        most = max([sizes[i]["rows"] // params.rounds + parts.get(0 if shared else i, 0) * params.negatives for i in sizes], default=0)
        sets = _placed(spread(written), groups)
        with passing(spark):
            # only the sets that a centre meets are drawn
            asked = sets.select("run", (F.col("step").cast("bigint") * _per_run(groups) + F.col("g")).alias("batch_id")).distinct()
            negatives = _by_step(negative_samples(materialise(asked), noise, params.negatives, _seeds(runs, "neg"), by="run"), groups, scratch[1])
    blocks = blocks_for(most, len(runs))

    def run_width(size: int) -> list[Trained]:
        own = [replace(p, size=size) for p in runs]
        one, latest = own[0], new_name()
        start = initial_state(ids, own) if init is None else warm_state(ids, own, init)
        state = bucketed(start.join(expected, ["run", "id"], "left"), "run", "id", name=latest)
        logs: list[list[dict]] = [[] for _ in runs]
        for at in range(start_step, steps):
            began = time.time()
            lr = learning_rate(params.learning_rate, at, steps)
            rows = _round_rows(spread(stored.where(F.col("round") == at % params.rounds)), sets, negatives, noise, own, at)
            moved = _update(state, summed_in_cells(rows, state, one.logit, blocks), one, lr)
            target = None if save_to is None else f"{save_to}/step={at + 1:06d}"
            earlier, latest = latest, new_name()
            written = bucketed(moved, "run", "id", path=target, name=latest)
            drop(spark, earlier)
            totals = {r["run"]: r for r in written.groupBy("run").agg(F.sum("xent").alias("xent"), F.sum("pairs").alias("pairs")).collect()}  # one row a run
            spent = time.time() - began
            state = written.select("run", "id", "w_in", "w_out", "b", "e_out")
            for i, log in enumerate(logs):
                done = (totals[i]["pairs"] if i in totals else None) or 0.0
                log.append({"epoch": at // params.rounds + 1, "step": at + 1, "lr": lr,
                            "loss": ((totals[i]["xent"] if i in totals else None) or 0.0) / max(done, 1.0), "pairs": done,
                            "pairs_per_second": done / max(spent, 1e-9)})
        return [Trained(state.where(F.col("run") == i).drop("run"), p, log) for i, (p, log) in enumerate(zip(own, logs))]

    return [run_width(size) for size in widths]


def _sets(pairs: DataFrame, runs: list[Params], steps: range, name: str) -> DataFrame:
    """``(run, x, u, w, step)`` in one folder per step: the parts that a centre's pairs fall into in a step, each with its weight and its place on the sets drawn."""
    spark, rounds = pairs.sparkSession, runs[0].rounds
    folder = f"{shared_folder(spark)}/{name}"
    at = F.array(*[F.array(*[F.lit(s) for s in steps if s % rounds == r]).cast("array<int>") for r in range(rounds)])
    met = pairs.select("run", "x", "y", "n", F.explode(F.get(at, F.col("round").cast("int"))).alias("step"))
    seed, each = _seeds(runs, "set"), [p.sets for p in runs]
    part = uniform_bin(each[0], seed, "y", "step") if len(set(each)) == 1 else F.floor(uniform(seed, "y", "step") * _per_run(each))
    summed = met.groupBy("run", "x", "step", part.alias("part")).agg(F.sum("n").alias("w"))
    placed = summed.select("run", "x", uniform(_seeds(runs, "group"), "x", "part", "step").alias("u"), "w", "step")
    with shuffles_go(spark):
        placed.write.partitionBy("step").parquet(folder)
    return spark.read.schema(placed.schema).parquet(folder)


def _placed(sets: DataFrame, groups: list[int]) -> DataFrame:
    """The drawn set ``g`` of a step that each of ``_sets`` meets."""
    return sets.select("run", "x", F.floor(F.col("u") * _per_run(groups)).alias("g"), "w", "step")


def _by_round(pairs: DataFrame, name: str) -> DataFrame:
    """Pairs ``(run, x, y, n, round)``, dealt by centre, in one folder per round."""
    spark = pairs.sparkSession
    folder = f"{shared_folder(spark)}/{name}"
    kept = pairs.select("run", "x", "y", "n", "round")
    with shuffles_go(spark):
        kept.write.partitionBy("round").parquet(folder)
    return spark.read.schema(kept.schema).parquet(folder)


def _by_step(drawn: DataFrame, groups: list[int], name: str) -> DataFrame:
    """Negatives ``(run, g, id, step)`` in one folder per step, so a round reads its own only."""
    spark = drawn.sparkSession
    folder = f"{shared_folder(spark)}/{name}"
    split = drawn.withColumn("_n", _per_run(groups)).select("run", (F.col("batch_id") % F.col("_n")).alias("g"), "id", F.expr("cast(batch_id div _n AS int)").alias("step"))
    with shuffles_go(spark):
        split.repartition("step", F.pmod(F.xxhash64("run", "g"), F.lit(_slices(spark)))).write.partitionBy("step").parquet(folder)
    return spark.read.schema(split.schema).parquet(folder)


def _slices(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _round_rows(pairs: DataFrame, sets: DataFrame | None, negatives: DataFrame | None, noise: DataFrame, runs: list[Params], at: int) -> DataFrame:
    """``(run, x, t, w, label)``: the pairs of the round, and each centre's weight per negative group (or per own draw) beside its negatives."""
    positive = pairs.select("run", "x", F.col("y").alias("t"), F.col("n").cast("double").alias("w"), F.lit(1.0).alias("label"))
    if negatives is None:
        # draws are summed where they are scored, so none is counted before
        negative = drawn_negatives(pairs.select("run", "x", "y", F.lit(at).alias("step"), "n"), noise, runs[0].negatives, ["x", "y", "step"], "x", "y",
                                   _seeds(runs, "neg"), by="run").select("run", "x", F.col("id").alias("t"), F.lit(1.0).alias("w"))
    else:
        # a centre's pairs fall into a few sets, so their negatives are scored once per set and weighted
        met = negatives.where(F.col("step") == at).select("run", "g", F.col("id").alias("t"))
        # groups are hashed, so the join on g is even
        negative = sets.where(F.col("step") == at).drop("step").join(met, ["run", "g"])
    return positive.unionByName(negative.select("run", "x", "t", F.col("w").cast("double").alias("w"), F.lit(0.0).alias("label")))


def _update(state: DataFrame, grads: DataFrame, params: Params, lr: float) -> DataFrame:
    """Step every touched vertex by its mean gradient; the others keep their vectors.

    A centre's weight in the round is known. A target's depends on the draws, so its sum is divided
    by the expected weight, which keeps true pairs and negatives in balance for rare vertices.
    """
    joined = state.join(grads, ["run", "id"], "left")
    mean = joined.withColumns({"m_in": _mean("g_in", "n_in"), "m_out": _mean("g_out", "e_out")})
    slope = F.coalesce(F.try_divide(F.col("g_b"), F.col("e_out")), F.lit(0.0))
    bound = F.greatest(F.least(slope, F.lit(params.max_norm)), F.lit(-params.max_norm))
    bias = F.col("b") - F.lit(lr) * bound
    return mean.select(
        "run", "id",
        F.when(F.col("n_in") > 0, step("w_in", "m_in", params, lr)).otherwise(F.col("w_in")).alias("w_in"),
        F.when(F.col("n_out") > 0, step("w_out", "m_out", params, lr)).otherwise(F.col("w_out")).alias("w_out"),
        bias.alias("b"), "e_out", "xent", "pairs")


def saved_state(spark: SparkSession, folder: str, at: int | None = None) -> tuple[DataFrame, int]:
    """The state of a single run after step ``at`` (the last by default) and its step number."""
    kinds = "id bigint, w_in array<double>, w_out array<double>, b double, step int"
    states = spark.read.schema(kinds).option("basePath", folder).parquet(folder)
    last = at or states.select(F.max("step")).first()[0]
    return states.where(F.col("step") == last).drop("step"), last


def resume(pairs: DataFrame, params: Params, folder: str) -> Trained:
    """Go on after the last saved round; the same as never having stopped."""
    state, done = saved_state(pairs.sparkSession, folder)
    return train(pairs, params, init=state, save_to=folder, start_step=done)


# -- what to train on ----------------------------------------------------------------------

def train_tokens(tokens: DataFrame, params: Params, **kw) -> Trained:
    """Embed the tokens of sentences ``(sentence_id, pos, token)``."""
    return train(cooccurrence(tokens, params.window), params, **kw)


def train_deepwalk(edges: DataFrame, params: Params, num_walks: int = 10, walk_length: int = 80, **kw) -> Trained:
    """Random walks as sentences, flat skip-gram with negative sampling."""
    walks = materialise(random_walks(edges, num_walks, walk_length, f"{params.seed}-walk"))
    return train_tokens(walk_tokens(walks), replace(params, geometry="euclidean"), **kw)


def train_mixed(edges: DataFrame, pairs: DataFrame, params: Params, batch_size: int, **kw) -> Trained:
    """Train the first half of ``params.rounds`` on ``edges(x, y)`` and the rest on ``pairs(x, y)``, ``batch_size`` rows a round.

    Each source is read in its own random order and wraps around on its own.
    """
    rows = mixed_schedule(edges, pairs, batch_size, params.rounds, ["x", "y"])
    counted = rows.groupBy(F.col("batch_id").cast("int").alias("round"), "x", "y").agg(F.count(F.lit(1)).alias("n"))
    return train(counted, replace(params, epochs=1), **kw)
