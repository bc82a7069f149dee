"""Cleaning, features, scores and files on small hand-made tables."""
import math

import pytest
from pyspark.sql import functions as F

from saddle.operators import cleaning, features, graph, metrics, vectors
from saddle.sources import text


def test_subtract_by_key(spark):
    a = spark.createDataFrame([(k,) for k in (1, 2, 2, 3, 4)], "k bigint")
    b = spark.createDataFrame([(k,) for k in (1, 5, 3, 6)], "k bigint")
    assert sorted(r["k"] for r in cleaning.subtract_by_key(a, b, "k").collect()) == [2, 2, 4]


@pytest.mark.parametrize("values,shape", [([1, 1, 3, 4, 6], (5, 6)), ([0, 1, 1, 3, 4, 6], (6, 7)), ([0, 0, 0, 0], (4, 1))])
def test_one_hot(spark, values, shape):
    out = vectors.one_hot(spark.createDataFrame([(x,) for x in values], "c int"), "c").collect()
    assert (len(out), len(out[0]["hot"])) == shape
    low = 0 if min(values) == 0 else 1
    assert all(r["hot"].index(1) == r["c"] - low and sum(r["hot"]) == 1 for r in out)


def test_rare_to_other_and_dummies(spark):
    rows = [("a",)] * 6 + [("b",)] * 3 + [("c",)] + [(None,)] * 2
    df = spark.createDataFrame([(i, *r, "x") for i, r in enumerate(rows)], "id bigint, k string, s string")
    out = features.rare_to_other(df, "k", 0.2)
    assert sorted(r["k"] for r in out.collect()) == ["Other"] * 3 + ["a"] * 6 + ["b"] * 3
    wide = features.dummies(out, {"k": ["Other", "a", "b"], "s": ["x"]})
    assert {"k_a", "k_b", "k_Other", "s_x"} <= set(wide.columns) and wide.agg(F.sum("k_Other")).first()[0] == 3


def test_dummy_positions_of_nulls_and_unknown_values(spark):
    df = spark.createDataFrame([(1, "b", 5), (2, None, 5), (3, "a", None), (4, None, None)], "id bigint, k string, n int")
    rows, known = features.dummy_positions(df, "id", ["k", "n"])
    assert sorted((r["column"], r["value"], r["pos"]) for r in known.collect()) == [("k", "a", 0), ("k", "b", 1), ("n", "5", 2)]
    assert {r["id"]: r["ones"] for r in rows.collect()} == {1: [1, 2], 2: [2], 3: [0], 4: []}
    later = spark.createDataFrame([(9, "c", 5)], "id bigint, k string, n int")
    again, _ = features.dummy_positions(later, "id", ["k", "n"], known)
    assert [r["ones"] for r in again.collect()] == [[2]]
    dense = rows.select("id", features.dense_ones(3).alias("v")).collect()
    assert {r["id"]: r["v"] for r in dense} == {1: [0.0, 1.0, 1.0], 2: [0.0, 0.0, 1.0], 3: [1.0, 0.0, 0.0], 4: [0.0, 0.0, 0.0]}


def test_unique_key(spark):
    with pytest.raises(ValueError):
        cleaning.assert_unique_key(spark.createDataFrame([(1,), (1,)], "k int"), "k")


def test_stratified_sample_fails_on_small_class(spark):
    df = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "id bigint, c int")
    with pytest.raises(ValueError):
        features.stratified_sample_n(df, "c", "id", 2)


def test_prune_once(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "src bigint, dst bigint")
    labels = spark.createDataFrame([(i, 0) for i in range(4)], "id bigint, cat int")
    kept, left = graph.prune_disconnected(edges, labels)
    assert sorted(map(tuple, kept.collect())) == [(0, 1), (1, 2)] and sorted(r["id"] for r in left.collect()) == [0, 1, 2]


def test_tree_counts(spark):
    """Three children per vertex, three levels: 13 vertices, 12 edges."""
    one = spark.createDataFrame([(0,)], "k bigint")
    two = spark.createDataFrame([(i, 0) for i in range(3)], "k bigint, up bigint")
    three = spark.createDataFrame([(i, i // 3) for i in range(9)], "k bigint, up bigint")
    counts = {r["level"]: (r["vertices"], r["edges"]) for r in graph.hierarchy_counts(
        [(one, "k"), (two, "k"), (three, "k")], [None, two, three]).collect()}
    assert counts == {0: (1, 0), 1: (3, 3), 2: (9, 9)}
    edges = graph.hierarchy_edges([(two, "k", "up"), (three, "k", "up")])
    assert edges.count() == 24 and graph.is_symmetric(edges).first()["symmetric"]


def test_f1_by_hand(spark):
    truth = [(0, 0), (0, 1), (1, 1), (2, 2), (3, 0)]
    guess = [(0, 0), (0, 2), (1, 1), (2, 2), (3, 1)]
    frame = lambda rows: spark.createDataFrame(rows, "id bigint, label int")
    counts = metrics.confusion_counts(frame(truth), frame(guess))
    assert {r["label"]: (r["tp"], r["fp"], r["fn"]) for r in counts.collect()} == {0: (1, 0, 1), 1: (1, 1, 1), 2: (1, 1, 0)}
    out = metrics.f1_macro_micro(counts).first()
    assert out["macro"] == pytest.approx((2 / 3 + 0.5 + 2 / 3) / 3) and out["micro"] == pytest.approx(0.6)


def test_topn_takes_the_true_number(spark):
    truth = spark.createDataFrame([(0, 1), (0, 4), (0, 3)], "id bigint, label int")
    order = [3, 2, 4, 1, 5]
    scores = spark.createDataFrame([(0, c, 1.0 - 0.1 * i) for i, c in enumerate(order)], "id bigint, label int, p double")
    assert sorted(r["label"] for r in metrics.topn_multilabel(scores, truth).collect()) == [2, 3, 4]


@pytest.mark.parametrize("t,df,p", [(0.0, 5, 1.0), (1.0, 1, 0.5), (2.015048372669157, 5, 0.1), (2.2281388519649385, 10, 0.05),
                                    (12.706204736432095, 1, 0.05), (4.604094871415897, 4, 0.01), (1.959963984540054, 1e7, 0.05)])
def test_student_p(t, df, p):
    assert metrics.student_t_two_sided(t, df) == pytest.approx(p, abs=1e-6)
    assert metrics.student_t_two_sided(-t, df) == pytest.approx(p, abs=1e-6)


def test_paired_test_undefined_without_spread(spark):
    rows = [(m, str(f), s + f * 0.1, 0.0) for m, s in (("a", 0.1), ("b", 0.1)) for f in range(4)]
    res = spark.createDataFrame(rows, "model string, fold string, macro double, micro double")
    out = metrics.with_p_value(metrics.t_test_paired(res)).first()
    assert out["t"] is None and out["p"] is None


def test_paired_and_welch_by_hand(spark):
    a, b = [0.5, 0.6, 0.7, 0.65], [0.4, 0.55, 0.5, 0.6]
    rows = [("a", str(i), x, 0.0) for i, x in enumerate(a)] + [("b", str(i), x, 0.0) for i, x in enumerate(b)]
    res = spark.createDataFrame(rows + [("a", "train", 1.0, 1.0)], "model string, fold string, macro double, micro double")
    gap = [x - y for x, y in zip(a, b)]
    mean = lambda z: sum(z) / len(z)
    var = lambda z: sum((q - mean(z)) ** 2 for q in z) / (len(z) - 1)
    assert metrics.t_test_paired(res).first()["t"] == pytest.approx(mean(gap) / math.sqrt(var(gap) / 4))
    assert metrics.t_test_welch(res).first()["t"] == pytest.approx((mean(a) - mean(b)) / math.sqrt(var(a) / 4 + var(b) / 4))


# -- files ---------------------------------------------------------------------------------

def test_wide_view_log(spark, tmp_path):
    line = ["x"] * 23
    line[0], line[1], line[6] = "5", "77", "2017-03-01 10:00:00"
    (tmp_path / "views.tab").write_text("|".join(line) + "\n")
    row = text.read_interactions(spark, str(tmp_path), sep="|", columns=text.VIEW_COLUMNS, header=False, epoch=False).first()
    assert (row["customer_id"], row["product_id"], str(row["date_viewed"])) == (5, 77, "2017-03-01 10:00:00")


def test_ragged_walks(spark, tmp_path):
    (tmp_path / "w.csv").write_text("1,2,3\n4 5\n6\n")
    assert sorted(r["path"] for r in text.read_walks(spark, str(tmp_path)).collect()) == [[1, 2, 3], [4, 5], [6]]


def test_long_sentences_are_kept_whole(spark, tmp_path, monkeypatch):
    """A sentence beyond ``LINE_TOKENS`` tokens is several lines and one sentence again when it is read."""
    monkeypatch.setattr(text, "LINE_TOKENS", 5)
    rows = [("0", i, f"a{i}") for i in range(3)] + [("1", i, f"b{i}") for i in range(9)]
    tokens = spark.createDataFrame(rows, "sentence_id string, pos bigint, token string")
    path = str(tmp_path / "s")
    text.write_sentences(tokens, path)
    lines = sorted(r["value"] for r in spark.read.text(path).collect())
    assert lines == ["0\t0\ta0 a1 a2", "1\t0\tb0 b1 b2 b3 b4", "1\t1\tb5 b6 b7 b8"]
    assert sorted(tuple(r) for r in text.read_sentences(spark, path).collect()) == sorted(rows)


def test_written_sessions_are_counted_by_their_text(spark, tmp_path):
    """The query's result is whole sentences and how often each was written, sessions of one event left out."""
    from datetime import datetime, timedelta

    from saddle.plans import catalog

    first = datetime(2024, 1, 1)
    seen = [(1, 0, "view"), (1, 1, "buy"), (1, 20, "view"), (2, 0, "view"), (2, 2, "buy"), (3, 0, "buy"), (3, 0, "view"), (None, 0, "view"), (None, 5, "buy"),
            (4, 0, None), (4, 1, None), (5, 0, "view"), (5, 1, None), (5, 2, "buy")]
    rows = [(i, user, first + timedelta(hours=h), kind) for i, (user, h, kind) in enumerate(seen)]
    spark.createDataFrame(rows, "event_id bigint, user_id bigint, ts timestamp_ntz, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    got = {r["sentence"]: r["n"] for r in catalog.QUERIES["write_sentences"](spark, str(tmp_path)).collect()}
    assert got == {"view buy": 4, "buy view": 1, None: 1}


@pytest.mark.parametrize("body,sort", [("2 3\n7 1.0 2.0 3.0\n4 0.5 0.25 0\n", True), ("7  1.0   2.0 3.0\n4 0.5 0.25 0\n", True)])
def test_embedding_text(spark, tmp_path, body, sort):
    (tmp_path / "e.emd").write_text(body)
    got = [(r["id"], r["v"]) for r in text.read_embedding_text(spark, str(tmp_path), sort=sort).collect()]
    assert got == [(4, [0.5, 0.25, 0.0]), (7, [1.0, 2.0, 3.0])]
