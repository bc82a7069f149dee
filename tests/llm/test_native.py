"""op2, op3 and op7: the queries against their SQL, and the edges of the operators."""
import re

import pytest
from pyspark.sql import functions as F

from oracle import compare, connect
from saddle.llm import catalog
from saddle.llm.credentials import redact, secret_spans
from saddle.llm.shards import byte_shards
from saddle.llm.urlfilter import build_cascade, judge_urls, mark_listed


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows_as_sql(spark, con, small, name):
    assert compare(spark, con, small, name, catalog.QUERIES[name], catalog.ORACLES[name]) is None


# -- secrets -------------------------------------------------------------------------------

KEY = "AKIA" + "Q7" * 8
MIXED = "aB3" + "x9Zk" * 9 + "q"


def spans(df):
    return {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in df.collect()}


def test_weak_parts_need_their_complements(rows):
    texts = [
        (1, f"user: alice99 and password = hunter2hunter"),   # id beside a strong secret
        (2, "user: alice99 was here"),                        # alone
        (3, f"{KEY} {MIXED}"),                                # mixed token beside an access id
        (4, MIXED),                                           # alone
        (5, f"see https://a.example/x {KEY} secret: {'s' * 9}"),
        (6, f"see https://a.example/x {KEY}"),                # an endpoint needs both
        (7, f"user: alice99\n\npassword = hunter2hunter"),    # another scope
        (8, "user: alice99" + " x" * 300 + " password = hunter2hunter"),  # too far
        (9, "login=bob1 token=abcd"),                         # two weak parts complete each other
    ]
    found = spans(secret_spans(rows("doc_id long, text string", texts)))
    kinds = {d: [k for k, _, _ in s] for d, s in found.items()}
    assert kinds == {1: ["id", "assign"], 2: [], 3: ["access", "key"], 4: [], 5: ["url", "access", "assign"], 6: ["access"],
                     7: ["assign"], 8: ["assign"], 9: ["id", "key"]}
    assert texts[2][1][found[3][1][1]:found[3][1][2]] == MIXED


def test_base_spans_as_regular_expressions_find_them(rows):
    text = f"é ü PASSWORD='{'p' * 8}' x{KEY}y api-key apikey:\"abc\" api_key: 12345678 " + "0af" * 12 + "g" + "f" * 31 + " token=token=12345678"
    want = []
    for kind, pattern, ok in (("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 8),
                              ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16), ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 32)):
        want += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text) if ok(m)]
    got = spans(secret_spans(rows("doc_id long, text string", [(1, text)])))[1]
    assert [s for s in got if s[0] in ("assign", "access", "hex")] == sorted(want, key=lambda s: s[1])


def test_secrets_of_odd_rows(rows):
    data = [(1, None, "a"), (1, None, "a"), (None, f"{KEY}", "b"), (2, "", None), (3, "word " * 50_000 + KEY, "c"), (3, f"{KEY}", "d")]
    df = rows("doc_id long, text string, spans string", data).withColumn("row", F.lit(1)).withColumn("key_1", F.lit("x"))
    got = secret_spans(df)
    assert got.count() == 6 and got.where(F.size("spans") > 0).count() == 3
    clean = redact(df)
    assert clean.columns == df.columns and clean.count() == 6
    texts = [r["text"] for r in clean.collect()]
    assert sum(t is None for t in texts) == 2 and texts.count("<SECRET>") == 2 and not any(KEY in (t or "") for t in texts)
    assert secret_spans(df.limit(0)).count() == 0 and redact(df.limit(0)).count() == 0


def test_overlapping_spans_share_one_mark(rows):
    text = "a token=" + "0123456789abcdef" * 3 + " b"
    got = redact(rows("doc_id long, text string", [(1, text)])).first()["text"]
    assert got == "a <SECRET> b"


# -- shards --------------------------------------------------------------------------------

def test_shards_are_balanced_and_gapless_with_a_hot_row(rows):
    data = [(7, "same")] * 4000 + [(i, "x" * (i % 90)) for i in range(8000)]
    got = byte_shards(rows("doc_id long, text string", data).withColumn("shard", F.lit("clash")), 16).toPandas()
    assert len(got) == len(data) and got["size"].sum() == sum(len(t) + 1 for _, t in data)
    per = got.groupby("shard").agg(total=("size", "sum"), n=("slot", "size"), top=("slot", "max"), low=("slot", "min"), ids=("slot", "nunique"))
    assert len(per) == 16 and per["total"].max() - per["total"].min() <= 2 * 91
    assert (per["low"] == 0).all() and (per["top"] == per["n"] - 1).all() and (per["ids"] == per["n"]).all()
    spans_ = got.groupby("shard")["doc_id"].agg(["min", "max"]).sort_index()
    assert (spans_["max"].to_numpy()[:-1] <= spans_["min"].to_numpy()[1:]).all()


def test_shards_of_odd_tables(rows):
    empty = rows("doc_id long, text string", [])
    assert byte_shards(empty, 16).count() == 0
    got = byte_shards(rows("doc_id long, text string", [(None, None), (1, ""), (1, "é" * 100_000)]), 4).toPandas()
    assert sorted(got["size"]) == [1, 1, 200_001] and sorted(got["text_crc32"])[:2] == [0, 0]
    with pytest.raises(ValueError):
        byte_shards(empty, 0)


# -- urls ----------------------------------------------------------------------------------

def test_cascade_is_exact_on_its_universe(spark):
    universe = spark.range(30_000).selectExpr("cast(id * 7919 AS string) AS key", "id % 9 = 0 AS listed")
    cascade = build_cascade(universe)
    assert len(cascade.levels) >= 2
    assert universe.where(cascade.member(F.col("key")) != F.col("listed")).count() == 0


@pytest.mark.parametrize("keys,scan", [(300, 2), (300, 16), (700, 1)])
def test_segments_of_a_long_list(spark, monkeypatch, keys, scan):
    from saddle.llm import urlfilter

    monkeypatch.setattr(urlfilter, "SEGMENT_KEYS", keys)
    monkeypatch.setattr(urlfilter, "SEGMENTS", scan)
    table = spark.range(3000).selectExpr("CASE WHEN id % 50 = 1 THEN NULL ELSE concat('k', id) END AS key", "id")
    got = mark_listed(table, "key", spark.range(0, 6000, 3).selectExpr("concat('k', id) AS key"))
    assert got.count() == 3000
    assert got.where("listed != (key IS NOT NULL AND id % 3 = 0)").count() == 0


def test_segments_follow_the_keys_that_pass_by_chance(spark, monkeypatch):
    """Also a short list over very many keys gets segments, so that level 1 stays small."""
    from saddle.llm import urlfilter

    built = []
    monkeypatch.setattr(urlfilter, "SEGMENT_KEYS", 100)
    monkeypatch.setattr(urlfilter, "build_cascade", lambda u, real=build_cascade: built.append(u) or real(u))
    table = spark.range(40_000).selectExpr("concat('k', id) AS key", "id")
    got = mark_listed(table, "key", spark.range(20).selectExpr("concat('k', id) AS key"))
    assert got.where("listed != (id < 20)").count() == 0 and len(built) == 4


def test_rules_and_odd_urls(rows):
    urls = {
        "http://A.example.NET/en/1": ("a.example.net", "/en/1", "example.net/en/", "allow"),
        "http://example.net/fr/1": ("example.net", "/fr/1", "net/", "block"),
        "http://a.net": ("a.net", "", None, "allow"),
        "x://b.example.com/de/?q#f": ("b.example.com", "/de/", "example.com/de/", "block"),
        "http://notexample.com/de/x": ("notexample.com", "/de/x", None, "allow"),
        "http://z.org/fr/": ("z.org", "/fr/", "org/fr/", "allow"),
        "http://deep.bad.example.com?x": ("deep.bad.example.com", "", None, "block"),
        "mailto:x": ("", "", None, "allow"), "": ("", "", None, "allow"), None: ("", "", None, "allow"),
    }
    data = [(i, u, "k") for i, u in enumerate(urls)]
    pages = rows("page_id long, url string, key string", data + data[:2])
    domains = rows("key string", [("bad.example.com",), (None,), ("bad.example.com",)])
    got = judge_urls(pages, domains).collect()
    assert len(got) == len(data) + 2
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == list(urls.values())[r["page_id"]]
    assert judge_urls(pages.limit(0), domains).count() == 0
    assert judge_urls(pages, domains.limit(0)).where("verdict = 'block'").count() == 3
