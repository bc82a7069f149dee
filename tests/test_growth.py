"""Work and memory of a task that must not grow with the table, on rows built here."""
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from saddle import ordering, skew
from saddle.functions.uniform import _firsts, uniform, uniform_bin
from saddle.operators import corpus, graph, linear, negatives, sentences
from saddle.plans import sweeps, training




def test_pairs_fill_tasks_by_their_number(spark, monkeypatch):
    """Many tokens fill more tasks than the session asks for, with the same counts."""
    tokens = spark.range(3000).selectExpr("id div 30 AS sentence_id", "id % 30 AS pos", "id * 7 % 11 AS token")
    few = corpus.cooccurrence(tokens, 2)
    monkeypatch.setattr(skew, "TASK_ROWS", 100)
    many = corpus.cooccurrence(tokens, 2)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) and few.count() == 44
    assert few.rdd.getNumPartitions() <= 4 and many.rdd.getNumPartitions() == 60


def test_edges_fill_tasks_by_their_number(spark, monkeypatch):
    edges = spark.range(2000).selectExpr("id AS src", "(id + 1) % 2000 AS dst")
    ends = spark.range(0, 2000, 1).where("id % 5 <> 0")
    monkeypatch.setattr(skew, "TASK_ROWS", 100)
    inner = graph.induced_subgraph(edges, ends)
    assert sorted(map(tuple, inner.collect())) == [(i, i + 1) for i in range(1999) if i % 5 and (i + 1) % 5]
    assert inner.rdd.getNumPartitions() == 20


def test_reach_is_drawn_once_a_token(spark):
    """The hash stands below the window, where a token is one row, and not above it, where it is many pairs."""
    stream = spark.range(500).selectExpr("id div 100 AS sentence_id", "id % 100 AS pos", "id * 13 % 17 AS token")
    plan = corpus.skipgram_pairs_dynamic(stream, 5)._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan[:plan.rindex("Window [")], plan[plan.rindex("Window ["):]
    assert "md5" not in above and "md5" in below


@pytest.mark.parametrize("multinomial", [False, True])
def test_classes_lead_the_probabilities(multinomial):
    """No inner loop over a few classes; the values are those of the plain form."""
    rng = np.random.default_rng(1)
    x, w = rng.normal(size=(50, 4)), rng.normal(size=(7, 3, 4))
    z = np.einsum("nd,jkd->njk", x, w)
    plain = np.exp(z) / np.exp(z).sum(axis=2, keepdims=True) if multinomial else 1 / (1 + np.exp(-z))
    found = linear._probabilities(x, w, multinomial)
    assert found.shape == (3, 50, 7) and np.allclose(np.moveaxis(found, 0, 2), plain, atol=1e-12)


def test_training_counts_its_pairs_once(spark, monkeypatch):
    """Sizes, noise, expected weights and ids come from one written count of the pairs."""
    written, real = [], training.materialise
    monkeypatch.setattr(training, "materialise", lambda df, *rest: (written.append(df.columns), real(df, *rest))[1])
    pairs = spark.createDataFrame([(1, 2, 3), (2, 1, 3), (3, 1, 1)], "x bigint, y bigint, n bigint")  # 3 is a centre only
    run = training.train(pairs, training.Params(epochs=1, rounds=1, negatives=1))
    assert written.count(["run", "id", "freq", "rows"]) == 1
    assert sorted(r["id"] for r in run.state.select("id").collect()) == [1, 2, 3] and run.log[0]["pairs"] == 7.0


def test_runs_share_their_pairs_and_draw_only_sets_they_meet(spark, monkeypatch):
    """Pairs of all runs are stored once, and a run with more sets than its centres can meet draws those they meet."""
    stored, asked = [], []
    by_round, drawn = training._by_round, training.negative_samples
    monkeypatch.setattr(training, "_by_round", lambda pairs, name: (stored.append(pairs.count()), by_round(pairs, name))[1])
    monkeypatch.setattr(training, "negative_samples", lambda batches, *rest, **kw: (asked.append(batches.count()), drawn(batches, *rest, **kw))[1])
    pairs = spark.range(400).selectExpr("id % 4 AS x", "id AS y", "1L AS n")
    runs = [training.Params(epochs=1, rounds=1, negatives=2, batch_size=b, sets=3) for b in (1, 400)]
    both = training.train_many(pairs, runs)
    assert stored == [400] and asked[0] <= 4 * 3 + 1  # of 401 sets
    for run, params in zip(both, runs):
        alone = training.train(pairs, params)
        assert run.log[0]["loss"] == pytest.approx(alone.log[0]["loss"]) and run.log[0]["pairs"] == 400.0


def test_draws_are_hashed_once_and_step_by_step(spark, monkeypatch):
    """No step hashes again, and no two steps run as one stage."""
    written, real = [], negatives.materialise
    monkeypatch.setattr(negatives, "materialise", lambda df: (written.append(df._jdf.queryExecution().optimizedPlan().toString()), real(df))[1])
    noise = negatives.noise_distribution(spark.range(50).selectExpr("id AS idx", "id + 1 AS freq"))
    got = negatives.negative_samples(spark.range(30).withColumnRenamed("id", "batch_id"), noise, 4)
    steps = [plan for plan in written if "_slice" in plan]
    assert len(steps) == 3 and not any("md5" in plan for plan in steps)
    assert got.count() == 120 and got.select("batch_id", "id").distinct().count() == 120


def test_cut_pairs_are_made_once(spark):
    """The pairs of every cut are those of its own walks, and all cuts come from one aggregation of pairs."""
    edges = spark.range(60).selectExpr("id % 12 AS src", "(id * 5 + id div 12) % 12 AS dst")
    walks = sentences.random_walks(edges.unionByName(edges.selectExpr("dst AS src", "src AS dst")), 3, 6, "w")
    cuts = [(1, 3), (3, 3), (1, 6), (3, 6)]
    made = sweeps.cut_pairs(walks, 2, cuts)
    for i, (n, length) in enumerate(cuts):
        own = corpus.cooccurrence(sentences.walk_tokens(sentences.walk_prefixes(walks, length, n)), 2)
        assert sorted(map(tuple, made.where(made.run == i).select("x", "y", "n").collect())) == sorted(map(tuple, own.collect()))
    assert made._jdf.queryExecution().optimizedPlan().toString().count("count") <= 2 * len(cuts)


def test_widths_share_pairs_and_negatives(spark, monkeypatch):
    stored, by_round = [], training._by_round
    monkeypatch.setattr(training, "_by_round", lambda pairs, name: (stored.append(name), by_round(pairs, name))[1])
    pairs = spark.range(100).selectExpr("id % 10 AS x", "id * 3 % 11 AS y", "1L AS n").groupBy("x", "y").sum("n").withColumnRenamed("sum(n)", "n")
    params = training.Params(epochs=1, rounds=1, negatives=2)
    found = training.train_widths(pairs, [params], [2, 3])
    assert len(stored) == 1
    for (run,), size in zip(found, (2, 3)):
        alone = training.train(pairs, replace(params, size=size))
        assert run.params.size == size and [r["loss"] for r in run.log] == pytest.approx([r["loss"] for r in alone.log])


@pytest.mark.parametrize("window", [1, 2, 5])
def test_followers_cross_batches_and_ranges(spark, window):
    """A key that fills ranges, keys of one row, a null key, null values and ranges of fewer rows than the window; all pairs by brute force."""
    rows = [(0, at, at * 7 % 5) for at in range(40)] + [(k, 0, k) for k in range(1, 4)] + [(None, at, at % 2 or None) for at in range(6)] + [(9, at, at) for at in range(7)]
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "3", "spark.sql.shuffle.partitions": "24"}
    before = {name: spark.conf.get(name) for name in held}
    try:
        for name, value in held.items():
            spark.conf.set(name, value)
        found = ordering.followers(spark.createDataFrame(rows[::-1], "key int, at int, v int"), ["key"], [F.col("at")], "v", window)
        got = [tuple(r) for r in found.collect()]
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    sentences_of = {}
    for key, at, v in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        sentences_of.setdefault(key, []).append(v)
    want = [(s[i], s[i + k], k) for s in sentences_of.values() for k in range(1, window + 1) for i in range(len(s) - k)]
    order = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(got, key=order) == sorted(want, key=order)


def test_view_pairs_are_those_of_sentences(spark):
    """The same counts as from numbered sentences, without a number or a window by customer."""
    views = spark.range(400).selectExpr("id % 7 % 5 AS customer_id", "id * 13 % 17 AS product_id", "timestamp_seconds(id * 31 % 90) AS date_viewed")
    plain = corpus.cooccurrence(sentences.customer_sentences(views), 3)
    made = corpus.view_cooccurrence(views, 3)
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, plain.collect())) and made.count() > 100
    assert "Window" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_few_bins_make_no_number(spark):
    """Bins are those of the number, to the last digit, and no digest is converted for them."""
    drawn = spark.range(3000).select(*[uniform_bin(n, "s", "id").alias(f"b{n}") for n in (1, 2, 3, 7, 8, 16, 40)],
                                     *[F.floor(uniform("s", "id") * n).alias(f"f{n}") for n in (1, 2, 3, 7, 8, 16, 40)])
    assert all(r[f"b{n}"] == r[f"f{n}"] for r in drawn.collect() for n in (1, 2, 3, 7, 8, 16, 40))
    for n in range(2, 17):
        for k, first in enumerate(_firsts(n), 1):
            at = int(first, 16)
            assert at / 2.0 ** 52 * n // 1 == k and (at - 1) / 2.0 ** 52 * n // 1 == k - 1
    assert "conv(" not in spark.range(1).select(uniform_bin(8, "s", "id"))._jdf.queryExecution().optimizedPlan().toString()


def test_written_tables_leave_no_shuffle_files(spark):
    """The shuffle files of a job that wrote a table go with it, as do the tables of a block that is over."""
    import time

    from saddle import storage

    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: sum(manager.getAllFiles().apply(i).getName().startswith("shuffle_") for i in range(manager.getAllFiles().size()))
    spark.sparkContext._jvm.System.gc()
    time.sleep(2)
    before = files()
    with storage.passing(spark):
        table = storage.materialise(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
        path = table.inputFiles()[0].rsplit("/", 1)[0]
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        assert len(table.collect()) == 7 and store.exists(folder)
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.2)
    assert files() <= before and not store.exists(folder) and storage.CLEANUP not in spark.conf.getAll


def test_training_leaves_its_state_only(spark):
    """Noise, draws and all that makes the pairs go; the grid follows the rows that there are, not a bound."""
    from pathlib import Path
    from urllib.parse import urlparse

    from saddle.storage import materialise, shared_folder

    folder = Path(urlparse(shared_folder(spark)).path)
    left = {p.name for p in folder.iterdir()}
    views = spark.range(400).selectExpr("id div 20 AS customer_id", "id * 7 % 31 AS product_id", "timestamp_seconds(id) AS date_viewed")
    run = training.train(lambda: corpus.view_cooccurrence(materialise(views), 2), training.Params(epochs=1, rounds=2))
    assert len({p.name for p in folder.iterdir()} - left) == 1 and run.state.count() == 31


def test_the_grid_is_for_the_rows_that_are_met(spark, monkeypatch):
    """A centre draws for the sets it meets, so its draws do not grow with its pairs."""
    asked, real = [], training.blocks_for
    monkeypatch.setattr(training, "blocks_for", lambda rows, runs: (asked.append(rows), real(rows, runs))[1])
    pairs = spark.range(4000).selectExpr("id % 4 AS x", "id AS y", "1L AS n")
    training.train(pairs, training.Params(epochs=1, rounds=1, negatives=5, sets=2))
    assert asked == [4000 + 4 * 2 * 5]
