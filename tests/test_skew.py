"""Ranks, sessions, pairs and draws give what plain windows and loops give, also under large keys and long sentences."""
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from saddle import skew
from saddle.operators import corpus, graph, metrics, negatives, sentences, splits
from saddle.ordering import global_index, running_total


@pytest.fixture(scope="module")
def views(spark):
    """900 views; customer 0 and product 7 own a third each."""
    rng = random.Random(5)
    start = datetime(2024, 1, 1)
    rows = []
    for i in range(900):
        customer = 0 if i % 3 == 0 else rng.randrange(1, 40)
        product = 7 if i % 3 == 1 else rng.randrange(0, 60)
        rows.append((i, customer, product, start + timedelta(minutes=rng.randrange(0, 40_000))))
    return spark.createDataFrame(rows, "n bigint, customer_id bigint, product_id bigint, date_viewed timestamp").cache()


def same(a, b):
    cols = a.columns
    return sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.select(*cols).collect()), key=repr)


def test_lookup_join(spark, views):
    small = spark.range(0, 50).select(F.col("id").alias("customer_id"), (F.col("id") * 2).alias("twice"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        small_ = small.where("customer_id % 5 <> 0") if how != "left" else small.where("customer_id <> 0")
        assert same(skew.lookup_join(views, small_, "customer_id", how), views.join(small_, "customer_id", how))


@pytest.fixture(params=[1, 7, 64])
def ranges(spark, request):
    """Few and many ranges: with many, the large keys fill several and small ones begin and end inside."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", old)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_grouped_rank(views, ranges):
    views = views.withColumn("key", F.when(F.col("customer_id") == 3, None).otherwise(F.col("customer_id")))
    window = Window.partitionBy("key").orderBy("date_viewed", F.col("n").desc())
    plain = views.withColumn("k", F.row_number().over(window).cast("bigint") + 4)
    assert same(plain, skew.grouped_rank(views, ["key"], [F.col("date_viewed"), F.col("n").desc()], "k", 5))


def test_token_sequences(views, ranges):
    for build, key, token, single in ((sentences.coview_sentences, "product_id", "customer_id", True),
                                      (sentences.customer_sentences, "customer_id", "product_id", False)):
        views_ = views.unionByName(views.limit(1).withColumn(key, F.lit(999).cast("bigint")))
        order = Window.partitionBy(key).orderBy("date_viewed", token)
        plain = views_.select(F.col(key).alias("sentence_id"), (F.row_number().over(order) - 1).cast("bigint").alias("pos"),
                              F.col(token).alias("token"), F.count("*").over(Window.partitionBy(key)).alias("size"))
        plain = plain.where("size > 1").drop("size") if single else plain.drop("size")
        assert same(plain, build(views_))


@pytest.mark.parametrize("gap", [60.0, 3600.0, 36_000.0])
def test_sessionize(views, ranges, gap):
    by = Window.partitionBy("customer_id").orderBy("date_viewed", "n")
    wait = F.unix_micros("date_viewed") - F.unix_micros(F.lag("date_viewed").over(by))
    opened = views.withColumn("o", F.when(wait.isNull() | (wait / 1e6 > gap), 1).otherwise(0))
    plain = opened.withColumn("session_no", F.sum("o").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("o")
    assert same(plain, sentences.sessionize(views.repartition(6), "customer_id", "date_viewed", "n", gap))


def test_no_plan_depends_on_a_size():
    """Nothing in the library compares bytes, rows or shares with a constant to choose a plan."""
    import inspect

    assert not [n for n, v in vars(skew).items() if isinstance(v, (int, float))]
    assert "sizeInBytes" not in inspect.getsource(skew)


def test_session_gap_is_strict(spark):
    t = datetime(2024, 1, 1)
    rows = [(1, i, t + timedelta(minutes=m)) for i, m in enumerate((0, 60, 121))]
    df = spark.createDataFrame(rows, "u bigint, i bigint, ts timestamp")
    got = {r["i"]: r["session_no"] for r in sentences.sessionize(df, "u", "ts", "i").collect()}
    assert got == {0: 1, 1: 1, 2: 2}


def brute_pairs(rows, window, equal_ok):
    out = []
    by = {}
    for s, p, t in rows:
        by.setdefault(s, {})[p] = t
    for s in by.values():
        for i in s:
            for j in range(i - window, i + window + 1):
                if j != i and j in s and (equal_ok or s[i] != s[j]):
                    out.append((s[i], s[j]))
    return sorted(out)


def test_pairs_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(corpus, "CHUNK", 8)
    rng = random.Random(1)
    rows = [(s, p, rng.randrange(6)) for s, n in ((1, 50), (2, 1), (3, 8), (4, 9), (5, 17)) for p in range(n)]
    tokens = spark.createDataFrame(rows, "sentence_id bigint, pos bigint, token bigint")
    for w in (1, 3, 5):
        assert sorted(map(tuple, corpus.skipgram_pairs(tokens, w).select("x", "y").collect())) == brute_pairs(rows, w, False)
        assert sorted(map(tuple, corpus.skipgram_pairs_positional(tokens, w).select("x", "y").collect())) == brute_pairs(rows, w, True)
    counts = {(r["x"], r["y"]): r["n"] for r in corpus.cooccurrence(tokens, 3).collect()}
    want = {}
    for pair in brute_pairs(rows, 3, False):
        want[pair] = want.get(pair, 0) + 1
    assert counts == want


def test_skipgram_example(spark):
    tokens = spark.createDataFrame([(0, i, t) for i, t in enumerate((1, 2, 1, 3))], "sentence_id bigint, pos bigint, token bigint")
    got = sorted(map(tuple, corpus.skipgram_pairs(tokens, 1).select("x", "y").collect()))
    assert got == sorted([(1, 2), (2, 1), (2, 1), (1, 2), (1, 3), (3, 1)])


def test_global_index_and_running_total(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice((1, 1, 1, 2, 9)), rng.randrange(100)) for i in range(1000)]
    df = spark.createDataFrame(rows, "id bigint, k bigint, val bigint").repartition(9)
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    got = {r["id"]: r["idx"] for r in global_index(df, ["k", "id"]).collect()}
    assert got == {r[0]: i for i, r in enumerate(ordered)}
    total, want = 0, {}
    for r in ordered:
        total += r[2]
        want[r[0]] = total
    assert {r["id"]: r["s"] for r in running_total(df, "val", ["k", "id"], "s").collect()} == want


def test_negatives_return_all_when_too_few(spark):
    tokens = [0, 0, 0, 1, 1, 0, 2, 2, 1, 2, 3, 3, 3, 1]
    vocab = corpus.vocabulary(spark.createDataFrame([(t,) for t in tokens], "token bigint"))
    noise = negatives.noise_distribution(vocab, id_col="token")
    got = negatives.negative_samples(spark.range(3).withColumnRenamed("id", "batch_id"), noise, 5).collect()
    for b in range(3):
        assert sorted(r["id"] for r in got if r["batch_id"] == b) == [0, 1, 2, 3]


@pytest.mark.parametrize("fan", [2, 3, 1024])
def test_draws_find_their_id_on_every_grid(spark, monkeypatch, fan):
    """One id owns most of the line; coarser grids hold the heavy ids."""
    monkeypatch.setattr(negatives, "FAN", fan)
    weights = [500, 1, 1, 40, 0, 3, 90, 1, 7, 1, 1, 1]
    rows, at = [], 0
    for i, w in enumerate(weights):
        rows.append((i, w, at, at + w))
        at += w
    noise = spark.createDataFrame(rows, "id bigint, weight bigint, lo bigint, hi bigint")
    draws = spark.range(at).withColumnRenamed("id", "at")
    got = {r["at"]: r["id"] for r in negatives.locate_draws(draws, noise, at, len(weights), max(weights)).collect()}
    assert got == {p: i for i, w, lo, hi in rows for p in range(lo, hi)}


def test_negatives_follow_the_noise(spark):
    vocab = spark.createDataFrame([(0, 1_000_000), (1, 10_000), (2, 10_000), (3, 1)], "idx bigint, freq bigint")
    noise = negatives.noise_distribution(vocab)
    got = negatives.negative_samples(spark.range(2000).withColumnRenamed("id", "batch_id"), noise, 1)
    share = {r["id"]: r["n"] / 2000 for r in got.groupBy("id").agg(F.count("*").alias("n")).collect()}
    for r in noise.collect():
        assert share.get(r["id"], 0) == pytest.approx(r["p"], abs=0.02)


def test_walks_follow_edges_and_blocks_do_not_matter(spark):
    edges = spark.createDataFrame([(0, i) for i in range(1, 30)] + [(1, 2), (2, 3)], "src bigint, dst bigint")
    both = graph.edges_symmetrize(edges).cache()
    known = {tuple(r) for r in both.collect()}
    a = {(r["start"], r["walk_no"]): r["path"] for r in sentences.random_walks(both, 3, 9, block=2).collect()}
    b = {(r["start"], r["walk_no"]): r["path"] for r in sentences.random_walks(both, 3, 9, block=50).collect()}
    assert a == b and len(a) == 90
    for (start, _), path in a.items():
        assert path[0] == start and len(path) == 9 and all((p, q) in known for p, q in zip(path, path[1:]))


def test_walks_need_out_edges(spark):
    with pytest.raises(ValueError):
        sentences.random_walks(spark.createDataFrame([(0, 1)], "src bigint, dst bigint"), 1, 3)


def test_adjacency_example(spark):
    edges = spark.createDataFrame([(0, 2), (1, 2), (2, 1), (2, 0)], "src bigint, dst bigint")
    assert sorted(map(tuple, graph.adjacency_list(edges).select("src", "nbr", "dst").collect())) == [
        (0, 0, 2), (1, 0, 2), (2, 0, 0), (2, 1, 1)]


def test_splits(spark):
    rows = spark.createDataFrame([(i, 0 if i < 90 else 1) for i in range(100)], "id bigint, y int")
    folds = splits.stratified_kfold(rows, "y", "id", 5).groupBy("fold", "y").count().collect()
    assert {r["count"] for r in folds if r["y"] == 1} == {2} and {r["count"] for r in folds if r["y"] == 0} == {18}
    assert splits.train_test_split_stratified(rows, "y", "id", 0.5).where("is_train").groupBy("y").count().count() == 2
    assert splits.train_test_split_stratified(rows, "y", "id", 30).where("is_train").count() == 30
    lone = rows.unionByName(spark.createDataFrame([(1000, 7)], "id bigint, y int"))
    assert splits.train_test_split_stratified(lone, "y", "id", 0.5).where("is_train").count() == 50


def test_auc_under_ties(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(2), rng.randrange(5)) for _ in range(300)]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    got = metrics.roc_auc(spark.createDataFrame([(y, float(s)) for y, s in rows], "y int, score double")).first()["auc"]
    assert got == pytest.approx(want)


def test_heavy_heads_take_n_draws(spark):
    """One id with nearly all the weight: every batch still gets all five others, in exactly six draws."""
    vocab = spark.createDataFrame([(0, 10**9)] + [(i, 1) for i in range(1, 6)], "idx bigint, freq bigint")
    noise = negatives.noise_distribution(vocab, 1.0)
    got = negatives.negative_samples(spark.range(50).withColumnRenamed("id", "batch_id"), noise, 6, block=2).collect()
    for b in range(50):
        mine = sorted((r["rank"], r["id"]) for r in got if r["batch_id"] == b)
        assert [k for k, _ in mine] == [1, 2, 3, 4, 5, 6] and sorted(i for _, i in mine) == list(range(6)) and mine[0][1] == 0


def test_no_row_is_lost(spark, tmp_path):
    from pyspark.ml.functions import array_to_vector  # noqa: F401

    from saddle.operators import features
    from saddle.plans import evaluation as ev
    from saddle.sources import text

    ranked = features.min_rank_share(spark.createDataFrame([(1, None), (2, 5.0), (3, 5.0)], "id bigint, v double"), "v", "y")
    assert {r["id"]: r["y"] for r in ranked.collect()} == {1: pytest.approx(1 / 3), 2: pytest.approx(2 / 3), 3: pytest.approx(2 / 3)}
    rows = spark.createDataFrame([(i, None if i % 10 == 0 else i % 2) for i in range(100)], "id bigint, y int")
    split = splits.train_test_split_stratified(rows, "y", "id", 0.5)
    assert split.count() == 100 and split.where("y is null and is_train").count() == 5
    tokens = spark.createDataFrame([("a", i, f"t{i}") for i in range(10_000)] + [("b", 0, "x")], "sentence_id string, pos bigint, token string")
    text.write_sentences(tokens, f"{tmp_path}/s")
    assert same(tokens, text.read_sentences(spark, f"{tmp_path}/s"))
    for width, header in ((1, True), (1, False), (3, True), (3, False)):
        emb = spark.createDataFrame([(i, [float(i)] * width) for i in range(1, 4)], "id bigint, v array<double>")
        text.write_embedding_text(emb, f"{tmp_path}/e{width}{header}", header=header)
        assert same(emb, text.read_embedding_text(spark, f"{tmp_path}/e{width}{header}"))
    data = spark.createDataFrame([(i, [float(i % 4), 1.0]) for i in range(40)], "id bigint, v array<double>")
    truth = spark.createDataFrame([(i, 0) for i in range(0, 40, 4)], "id bigint, label int")
    scored = ev.one_vs_rest_scores(data, truth, 1, ev.CLASSIFIERS["one_vs_rest"]).collect()
    # trained on labelled rows only, every row would look like label 0
    assert len(scored) == 40 and all((r["p"] > 0.5) == (r["id"] % 4 == 0) for r in scored)


@pytest.mark.parametrize("parts,batch", [(1, 10_000), (5, 3), (40, 7)])
def test_numbers_inside_keys_over_ranges_and_batches(spark, parts, batch):
    """Keys that fill many ranges, null and NaN keys, keys of one row, gaps that fall between ranges."""
    import random

    from saddle.ordering import counted

    rng = random.Random(2)
    rows = [(rng.choice([1.0, 1.0, 1.0, 2.0, None, float("nan"), float(i)]), rng.choice(["a", None]), rng.randrange(500), i) for i in range(600)]
    order = lambda r: (r[0] is not None, r[0] if r[0] == r[0] and r[0] is not None else 1e9, r[1] is not None, r[1] or "", r[2], r[3])
    same = lambda r: (repr(r[0]), r[1])
    want, number, sessions, before = {}, 0, 0, None
    ordered = sorted(rows, key=order)
    for i, r in enumerate(ordered):
        new = before is None or same(before) != same(r)
        number = 1 if new else number + 1
        sessions = 1 if new else sessions + (r[2] - before[2] > 9)
        want[r[3]] = (number, sessions, i + 1 == len(ordered) or same(ordered[i + 1]) != same(r))
        before = r
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        for k, v in zip(old, (str(parts), "false", str(batch))):
            spark.conf.set(k, v)
        df = spark.createDataFrame(rows, "a double, b string, t bigint, id bigint")
        got = counted(df, ["a", "b"], [F.col("t"), F.col("id")], "n", last="z").select("id", "n", "z").collect()
        assert {r["id"]: (r["n"], r["z"]) for r in got} == {i: (n, z) for i, (n, _, z) in want.items()}
        got = counted(df, ["a", "b"], [F.col("t"), F.col("id")], "n", at=F.col("t"), gap=9).select("id", "n").collect()
        assert {r["id"]: r["n"] for r in got} == {i: s for i, (_, s, _) in want.items()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
