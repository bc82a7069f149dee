"""Ranked search, languages and hard negatives against slow forms, and on odd tables."""
import math
import re
import string
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from saddle.llm import language, lexical, negatives

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


# -- ranked search -------------------------------------------------------------------------

def slow_search(docs, items, k=10):
    held = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    held = [(i, t) for i, t in held if t]
    n, length = len(held), sum(len(t) for _, t in held)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(TERM.findall((t or "").translate(LOWER)))
    out = []
    for item, terms in wanted.items():
        weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * sum(t in d for _, d in held) + 1))) for t in terms}
        rows = []
        for doc, words in held:
            m = 10 + (90 * len(words) * n) // length
            score = sum(w * ((10**9 * words.count(t)) // (1000 * words.count(t) + 8 * m)) for t, w in weight.items())
            if score > 0:
                rows.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -score) for rank, (score, _, _, doc) in enumerate(sorted(rows, key=lambda r: r[:3])[:k], 1)]
    return sorted(out, key=repr)


ODD = ["Ab ab AB, ñandú-1 x", None, "", "...", "ÀÉ àé Àé", "a" * 5000, "ab " * 400 + "z", "z\x00ab\x7fz", "ab\nz", "ab ab", "ab ab", "٣ ab ３", "İ ſ K"]


def found(df):
    return sorted([(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.select("item_id", "rank", "doc_id", "score").collect()], key=repr)


def test_search_against_slow(rows):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(60)]
    texts = ODD + [" ".join(rng.choice(words, int(rng.integers(1, 40)))) for _ in range(150)]
    data = [(i if i != 7 else None, t, "x", 5) for i, t in enumerate(texts)] + [(20, texts[20], "x", 5)] * 3
    docs = rows("doc_id bigint, text string, item_id string, score int", data)
    asked = [(0, "AB z"), (1, None), (2, "àé ñandú"), (3, " ".join(words[:30])), (3, "w50 w51"), (3, "w50 w51"), (None, "w1 w2"), (4, "absent"), (5, "3 ３ ٣ ſ")]
    items = rows("item_id bigint, text string", asked)
    want = slow_search([(r[0], r[1]) for r in data], asked)
    assert found(lexical.search(docs, items)) == want
    # many groups, small products and many partitions change nothing
    old = lexical.TERM_BYTES, lexical.DOCS, lexical.ITEMS, lexical.TERMS
    lexical.TERM_BYTES, lexical.DOCS, lexical.ITEMS, lexical.TERMS = 40, 7, 2, 3
    try:
        assert found(lexical.search(docs.repartition(5), items)) == want
    finally:
        lexical.TERM_BYTES, lexical.DOCS, lexical.ITEMS, lexical.TERMS = old


def test_search_keeps_k_of_many_equal_documents(rows):
    docs = rows("doc_id bigint, text string", [(i, "same words here") for i in range(3000)] + [(5000 + i, "other") for i in range(6000)])
    out = found(lexical.search(docs, rows("item_id int, text string", [(1, "same here")]), k=4))
    assert [(r[1], r[2]) for r in out] == [(1, 0), (2, 1), (3, 2), (4, 3)]


def test_search_of_nothing(rows):
    docs, items = rows("doc_id bigint, text string", []), rows("item_id bigint, text string", [(1, "a")])
    assert found(lexical.search(docs, items)) == []
    some = rows("doc_id bigint, text string", [(1, "a")])
    assert found(lexical.search(some, items.limit(0))) == [] and found(lexical.search(some, rows("item_id bigint, text string", [(1, None), (2, "..")]))) == []


def test_scan_is_whole(rows):
    made = lexical.automaton(["a", "b", "ab"])
    got = list(lexical.scan(made, pa.array(["a b  ab a", None, "aab", "A,b", "b" * 9 + " ab"])))
    assert [n for n, _ in got] == [4, 0, 1, 2, 2]
    assert [dict(c) for _, c in got] == [{0: 2, 1: 1, 2: 1}, {}, {}, {0: 1, 1: 1}, {2: 1}]


# -- languages -----------------------------------------------------------------------------

def test_language_of_planted_documents(spark, rows):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs, sample=60)
    out = language.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(out) > 150 and np.mean([r["lang_pred"] == r["lang"] for r in out]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in out)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)


def test_kernels_by_hand():
    a, b = language.spectra(pa.array(["Ab1", "abc ab"]))
    grams = lambda s: {s[i:i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1)}
    x, y = grams("ab1"), grams("abc ab")
    assert len(a) == len(x) and len(b) == len(y)
    place = np.full(language.CODES, -1)
    place[b] = np.arange(len(b))
    marks = np.full((1, len(b)), 1 / np.sqrt(len(b)))
    assert language.kernels(place, marks, [a])[0, 0] == pytest.approx(len(x & y) / np.sqrt(len(x) * len(y)))


def test_languages_of_odd_rows(spark, rows):
    schema = "doc_id bigint, text string, lang string, score double"
    texts = [None, "", "123 ...", "x", "Ж" * 70_000, "ab " * 50_000]
    odd = rows(schema, [(i, t, None, 1.0) for i, t in enumerate(texts)] + [(None, "hello", "en", 1.0)])
    blank = language.predict(odd, language.fit(odd)).collect()
    assert len(blank) == 7 and {(r["lang_pred"], r["score"]) for r in blank} == {("und", 0.0)}
    learnt = rows(schema, [(i, w * 5, lang, 1.0) for i in range(60) for w, lang in (("the dog ran ", "en"), ("der hund lief ", "de"))])
    model = language.fit(learnt.unionByName(odd))
    out = {(r["doc_id"], r["lang_pred"]) for r in language.predict(odd, model).collect()}
    assert {(0, "und"), (1, "und"), (2, "und")} < out and len(out) == 7 and all(p != "und" for i, p in out if i not in (0, 1, 2))
    assert language.predict(odd.limit(0), model).count() == 0
    # copies of one text, and how rows are dealt, do not move the model
    copies = learnt.unionByName(learnt.where("doc_id = 1")).unionByName(learnt.where("doc_id = 1")).unionByName(odd).repartition(7)
    again = {(r["doc_id"], r["lang_pred"], round(r["score"], 4)) for r in language.predict(odd, language.fit(copies)).collect()}
    assert again == {(r["doc_id"], r["lang_pred"], round(r["score"], 4)) for r in language.predict(odd, model).collect()}


# -- hard negatives ------------------------------------------------------------------------

def slow_negatives(data, modulus, k=5):
    kept = [(i, lab, [math.floor(256 * x) for x in v], node) for node, (i, v, lab) in enumerate(data)
            if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    first = lambda rows: sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1] or 0))
    out = []
    for i, lab, v, node in kept:
        if i is None or i % modulus:
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), j, other, n) for j, other, w, n in kept if n != node and len(w) == len(v)]
        for p, pid, *_ in first([s for s in scored if s[2] == lab])[:5]:
            inside = [s for s in scored if s[2] != lab and 80 * p <= 100 * s[0] <= 100 * p]
            out += [(i, pid, rank, s[1], p, s[0]) for rank, s in enumerate(first(inside)[:k], 1)]
    return sorted(out, key=repr)


def mined(df, modulus):
    got = negatives.hard_negatives(df, F.col("vec_id") % modulus == 0)
    return sorted([tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()], key=repr)


def clusters(n, dim, seed, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    label = rng.integers(0, 12, n)
    return [(i, (centres[label[i]] + rng.normal(scale=spread, size=dim)).tolist(), int(label[i]) % 4) for i in range(n)]


SCHEMA = "vec_id bigint, embedding array<double>, label int"


def test_negatives_against_slow(rows, monkeypatch):
    monkeypatch.setattr(negatives, "ZONE", 8)
    monkeypatch.setattr(negatives, "PAGE", 32)
    monkeypatch.setattr(negatives, "ANCHOR_SPAN", 64)
    monkeypatch.setattr(negatives, "ZONE_SPAN", 128)
    for spread in (0.05, 1.0):
        data = clusters(300, 6, 1, spread)
        data += [data[4]] * 20 + [(None, data[10][1], 1), (400, None, 1), (401, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (402, [float("nan")] * 6, 1), (410, data[3][1], None)]
        data += [(420, [1.0, 1.0], 1), (421, [1.0, 0.9], 1), (422, [0.9, 1.0], 2), (430, [], 1), (431, [], 1), (432, [], 2), (440, [-3.0] * 6, 0)]
        assert mined(rows(SCHEMA, data).withColumn("node", F.lit("x")).withColumn("page", F.lit(1)), 10) == slow_negatives(data, 10)


def test_negatives_of_equal_rows(rows):
    data = [(i, [0.5, 0.5], i % 2) for i in range(400)]
    assert mined(rows(SCHEMA, data), 100) == slow_negatives(data, 100)
    assert mined(rows(SCHEMA, data), 1000) == slow_negatives(data, 1000)
    assert mined(rows(SCHEMA, []), 10) == [] and mined(rows(SCHEMA, [(1, [1.0], 1)]), 10) == [] and mined(rows(SCHEMA, [(0, [1.0], 1)]), 10) == []


def test_bounds_hold_and_prune(spark, rows, monkeypatch):
    rng = np.random.default_rng(3)
    x, low = rng.integers(-9, 9, (40, 5)), rng.integers(-9, 9, (20, 5))
    high = low + rng.integers(0, 5, low.shape)
    inside = rng.integers(low, high + 1, (50, *low.shape))
    least, most = negatives.bounds(x, low, high)
    products = np.einsum("ad,rzd->raz", x, inside)
    assert (products >= least).all() and (products <= most).all()
    # tight clusters: most pages are never read
    monkeypatch.setattr(negatives, "ZONE", 16)
    monkeypatch.setattr(negatives, "PAGE", 16)
    df = rows(SCHEMA, clusters(2000, 6, 5, 0.01))
    stored, n = negatives.ordered_rows(df, F.col("vec_id") % 10 == 0, "vec_id", "embedding", F.col("label"))
    anchors = stored.where("anchor").select("idx", "dim", "label", "node", "vec_id", "x")
    asked = negatives.choose(anchors, negatives.zone_maps(stored), n, 5, None).count()
    assert asked < anchors.count() * (n / 16) * 0.12  # a cluster is a twelfth of the rows


def test_hilbert_neighbours_touch():
    side = np.stack(np.meshgrid(*[np.arange(4)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    order = side[np.argsort([p.tobytes() for p in negatives.hilbert(side)])]
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()
