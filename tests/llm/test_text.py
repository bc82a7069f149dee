"""op1, op8, op9, op10 and the pipeline against brute force, a public tokenizer and held-out labels."""
import random
import re
import zlib
from hashlib import sha256

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer as Public

import corpus_pipeline
from saddle.llm import bpe, quality, simhash, tiling
from saddle.llm.catalog import QUERIES
from saddle.llm.queries_text import VOCABULARY
from saddle.llm.textbytes import Words, xxh64

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def some_texts(n, seed=0, alphabet=" \t\nAbéÉ ,xyz"):
    rng = random.Random(seed)
    return [None, "", " ", "a", "  a b", "A b\tC  d "] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(n)]


def shingles(text, size):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(ASCII_LOWER))
    return [" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


# -- bytes and fingerprints ----------------------------------------------------------------

@pytest.mark.parametrize("size", [1, 3, 5])
def test_shingle_hashes(size):
    texts = some_texts(300) + ["w" * 100 + " x " + "y" * 70]
    words = Words(pa.array(texts))
    doc, start, end = words.shingles(size)
    got = {}
    for d, h in zip(doc.tolist(), xxh64(words.buf, start, end).tolist()):
        got.setdefault(d, []).append(h)
    for i, text in enumerate(texts):
        assert got.get(i, []) == [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(text, size)]


def slow_fingerprint(text, size=3):
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(text, size)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(fps, ids, far=3):
    up = list(range(len(fps)))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= far:
                up[find(i)] = find(j)
    low = {}
    for i, d in enumerate(ids):
        low[find(i)] = min(low.get(find(i), d), d)
    return [low[find(i)] for i in range(len(fps))]


def test_op8_against_all_pairs(spark, small):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op8_simhash_groups"](spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    fps, ids = [slow_fingerprint(r["text"]) for r in docs], [r["doc_id"] for r in docs]
    assert got == {d: (f"{f:016x}", c) for d, f, c in zip(ids, fps, slow_groups(fps, ids))}


@pytest.mark.parametrize("radius,block", [(3, 4096), (3, 40), (7, 60)])
def test_crowded_fingerprints_in_blocks(spark, monkeypatch, radius, block):
    """Clouds of fingerprints around few centres, with bits that go together and a partition that hardly varies."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(4)
    fps = []
    for centre in rng.integers(0, 1 << 63, 12).tolist():
        for _ in range(40):
            f = centre & ~0xFFFF
            for b in rng.integers(16, 64, int(rng.integers(0, 7))).tolist():
                f ^= 1 << b
            fps.append(f)
    fps = sorted(set(fps))
    classes = spark.createDataFrame([(i, [f - (1 << 64) if f >> 63 else f]) for i, f in enumerate(fps)], "node long, fp array<long>")
    index = simhash.build_index(classes, 1, radius)
    assert sum(e + 1 for e in index.thresholds) >= radius + 1
    assert sorted(b for p in index.partitions for b in p) == list(range(64))
    from saddle.llm.components import connected_components

    named = {r["node"]: r["root"] for r in connected_components(simhash.links(classes, index, 1, radius)).collect()}
    groups = {}
    for i in range(len(fps)):
        groups.setdefault(named.get(i, i), set()).add(i)
    low = {i: min(g) for g in groups.values() for i in g}
    assert [low[i] for i in range(len(fps))] == slow_groups(fps, list(range(len(fps))), radius)


def test_thresholds_cost_least():
    rng = np.random.default_rng(0)
    for _ in range(20):
        costs = np.concatenate([np.zeros((4, 1)), np.cumsum(rng.random((4, 3)), axis=1)], axis=1)
        got = simhash.allocate(costs, 3)
        best = min((sum(costs[i][e + 1] for i, e in enumerate(t)) for t in np.ndindex(4, 4, 4, 4)
                    for t in [tuple(x - 1 for x in t)] if sum(x + 1 for x in t) >= 4))
        assert sum(e + 1 for e in got) >= 4 and np.isclose(sum(costs[i][e + 1] for i, e in enumerate(got)), best)


def test_near_groups_of_odd_rows(rows):
    long = " ".join(f"w{i}" for i in range(30_000))
    data = [(5, None), (4, ""), (4, ""), (9, " \n"), (None, "solo text of its own kind"), (7, long), (2, long + " tail"), (7, long)]
    df = rows("doc_id long, text string", data).withColumn("fp", F.lit("x")).withColumn("key_1", F.lit(0)).withColumn("node", F.lit(0))
    got = simhash.near_groups(df, 3, 3).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"]) for r in got if r["component_id"] is not None) == [
        (2, 2), (4, 4), (4, 4), (5, 4), (7, 2), (7, 2), (9, 4)]
    kept = simhash.first_of_groups(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 2, 4]
    assert simhash.near_groups(df.limit(0), 3, 3).count() == 0 and simhash.first_of_groups(df.limit(0)).count() == 0


# -- tiling --------------------------------------------------------------------------------

def slow_tiles(a, b, minimum):
    """Greedy string tiling by trying every pair of places."""
    a_marked, b_marked, covered = [False] * len(a), [False] * len(b), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not a_marked[i + n] and not b_marked[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < minimum:
            return covered
        for k in range(n):
            a_marked[i + k] = b_marked[j + k] = True
        covered += n


def test_tiles_cover_what_slow_tiling_covers(monkeypatch):
    rng = np.random.default_rng(6)
    for case in range(60):
        monkeypatch.setattr(tiling, "MATCHES", 1 << 18 if case % 2 else 50)
        words = int(rng.integers(2, 40))
        item = rng.integers(1, words, int(rng.integers(3, 30)))
        parts = [item[s:s + int(rng.integers(1, 12))] for s in rng.integers(0, len(item), 4)] + [rng.integers(1, words, 5)]
        text = np.concatenate([parts[i] for i in rng.permutation(5)])
        found = tiling.tiles(text.astype(np.uint64), np.zeros(len(text), bool), item.astype(np.uint64), 3)
        used_a = [i + k for i, _, n in found for k in range(n)]
        used_b = [j + k for _, j, n in found for k in range(n)]
        assert len(set(used_a)) == len(used_a) and len(set(used_b)) == len(used_b)
        assert all((text[i:i + n] == item[j:j + n]).all() and n >= 3 for i, j, n in found)
        # equal lengths may be marked in another order
        if case % 2 and words > 20:
            assert sum(n for _, _, n in found) == slow_tiles(text.tolist(), item.tolist(), 3)


def test_op1_finds_planted_passages_and_nothing_else(spark, small):
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op1_string_tiling"](spark, small).collect()}

    def norm(text):
        return " " + " ".join(re.findall(r"[^\W_]+", text.lower())) + " "

    items = [(r["item_id"], norm(r["text"])) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    assert got == {(r["doc_id"], i) for r in docs for i, b in items if b in norm(r["text"])}


def test_reordered_passages_and_odd_rows(rows):
    item = "The quick brown fox jumps over the lazy dog. Pack my box with five dozen liquor jugs! How vexingly quick daft zebras jump at night."
    turned = "HOW vexingly quick daft zebras   jump at night -- filler words here. pack my BOX with five dozen liquor jugs; the quick brown fox jumps over the lazy dog"
    part = "intro the quick brown fox jumps over the lazy dog outro"
    filler = "ä word " * 60_000
    data = [(1, turned), (2, filler + item + filler), (3, part), (3, part), (4, None), (5, ""), (6, "pack my box"), (None, item), (7, item), (7, item)]
    docs = rows("doc_id long, text string", data).withColumn("item_id", F.lit("x")).withColumn("seeds", F.lit(1))
    bench = rows("item_id long, text string", [(10, item), (11, "too short"), (12, None), (10, "other words entirely, not found in any text")]).withColumn("words", F.lit(2))
    got = tiling.contaminated(docs, bench).collect()
    assert sorted((r["doc_id"] or -1, r["item_id"]) for r in got) == [(-1, 10), (1, 10), (2, 10), (7, 10)]
    assert {r["doc_id"]: r["n_tiles"] for r in got}[1] == 3 and {r["doc_id"]: r["coverage"] for r in got}[2] == 1.0
    assert tiling.contaminated(docs.limit(0), bench).count() == 0 and tiling.contaminated(docs, bench.limit(0)).count() == 0


# -- tokens --------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def public():
    t = Public.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def odd_tokens():
    texts = some_texts(1500, 3, "abcdeés'tΣΑσ̀ \n\t12٣İ一🙂ﬁ-_!?​")
    return texts + ["ΟΔΥΣΣΕΥΣ", "<|endoftext|>a<|startoftext|> B <|ENDOFTEXT|>", "aaaaaaaaaaaaaaaaa", "x\x1cy\x85z", "don't we'll I'd", "é " * 400_000]


def test_op9_equals_the_public_tokenizer(spark, rows, small, as_table, public):
    texts = odd_tokens()
    docs = rows("doc_id long, text string", list(enumerate(texts)) + [(0, "again"), (None, "null id")]).withColumn("ids", F.lit("x"))
    folder = as_table(documents=docs.unionByName(spark.read.parquet(f"{small}/documents.parquet").selectExpr("doc_id + 1000000 AS doc_id", "text", "'x' AS ids")))
    want = {}
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        ids = public.encode(r["text"] or "", add_special_tokens=False).ids
        want.setdefault(r["doc_id"], []).append((len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                                                 sha256(public.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = {}
    for r in QUERIES["op9_bpe_automaton"](spark, folder).collect():
        got.setdefault(r["doc_id"], []).append((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    config = bpe.read_config(spark, VOCABULARY)
    assert bpe.encode(docs.limit(0), config).count() == 0


def test_decoded_text(rows, spark):
    config = bpe.read_config(spark, VOCABULARY)
    encoded = bpe.encode(rows("doc_id long, text string", [(1, "Hello world"), (2, None)]), config)
    got = {r["doc_id"]: r["decoded"] for r in bpe.decode(encoded, config).collect()}
    assert got == {1: "hello</w> world</w>", 2: ""}


def test_automaton_accepts_one_path_per_string():
    """On a small vocabulary, arcs allow exactly the tokenizations that merging gives."""
    merges = [("a", "b"), ("b", "a"), ("ab", "a"), ("a", "a"), ("aa", "b"), ("ba", "ba"), ("b", "b"), ("ab", "ab")]
    tokens = ["a", "b", *(x + y for x, y in merges)]
    number = {t: i for i, t in enumerate(tokens)}
    auto = bpe.Automaton(len(tokens), [(number[x], number[y], number[x + y]) for x, y in merges])

    def merged(s):
        parts = list(s)
        for x, y in merges:
            i = 0
            while i < len(parts) - 1:
                if parts[i] == x and parts[i + 1] == y:
                    parts[i:i + 2] = [x + y]
                i += 1
        return parts

    def paths(s, last=-1):
        if not s:
            yield []
        for t in tokens:
            if s.startswith(t) and auto.live[number[t]] and auto.allows(last, number[t]):
                for rest in paths(s[len(t):], number[t]):
                    yield [t, *rest]

    for length in range(1, 9):
        for bits in range(1 << length):
            s = "".join("ab"[bits >> i & 1] for i in range(length))
            assert list(paths(s)) == [merged(s)]


# -- quality -------------------------------------------------------------------------------

def test_op10_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    got = QUERIES["op10_byte_convolution"](spark, folder).toPandas()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert len(got) == docs.count() and got["score"].between(0, 1).all()
    assert (got["predicted"] == (got["score"] >= 0.3)).all()
    assert (got["held_out"] == [zlib.crc32(str(d).encode()) % 5 == 0 for d in got["doc_id"]]).all()
    both = got.merge(spark.read.parquet(f"{folder}/labels.parquet").toPandas(), on="doc_id")
    fresh = both[both["held_out"]]
    rank = fresh["score"].rank()
    good = fresh["quality"] == 1
    auc = (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc > 0.98 and (fresh["predicted"] == fresh["quality"]).mean() > 0.95


def test_whole_texts_count_and_odd_rows(spark, rows):
    """Chunks cover every byte: what a text says at its end changes its score."""
    rng = np.random.default_rng(0)
    model = {"emb": rng.normal(size=(256, quality.DIM)).astype(np.float32), "b": np.zeros(quality.FILTERS, np.float32),
             "h": rng.normal(size=(quality.FILTERS + 1, quality.HIDDEN)).astype(np.float32), "hb": np.zeros(quality.HIDDEN, np.float32),
             "o": rng.normal(size=quality.HIDDEN).astype(np.float32), "ob": np.zeros(1, np.float32), "line": np.array([1.0, 0.0])}
    for g in range(quality.GROUPS):
        model[f"w{g}"] = rng.normal(size=(quality.STRIDE * quality.DIM, quality.FILTERS)).astype(np.float32)
    texts = ["", "a", "word " * 1000, "x" * 255, "y" * 256, "é" * 70_000, "tail " * 3000 + "!!" * 200]
    alone = np.concatenate([quality.raw_scores(model, pa.array([t])) for t in texts])
    assert np.allclose(quality.raw_scores(model, pa.array(texts)), alone, atol=1e-4)
    # one chunk by hand: every place of the filters, the largest value of each, then the head
    padded = np.frombuffer(texts[2][:900].encode() + b"\0" * 200, np.uint8)
    steps = model["emb"][padded[:1100 // 4 * 4]].reshape(-1, quality.STRIDE * quality.DIM)
    n = 1024 // 4 - quality.GROUPS + 1
    top = sum(steps[g:n + g] @ model[f"w{g}"] for g in range(quality.GROUPS)).max(axis=0)
    seen = np.append(np.maximum(top, 0), 900 / 1024)
    assert np.isclose(quality.raw_scores(model, pa.array([texts[2][:900]]))[0], np.tanh(seen @ model["h"]) @ model["o"], atol=1e-3)
    df = rows("doc_id long, text string", [(None, None), (1, ""), (1, ""), (2, "x" * 200_000)]).withColumn("score", F.lit("s")).withColumn("label", F.lit(1))
    got = quality.score(df, model).collect()
    assert len(got) == 4 and all(0 <= r["score"] <= 1 for r in got)
    assert quality.keep_good(df, model, 0.0).columns == df.columns and quality.keep_good(df, model, 0.0).count() == 4
    labels = rows("doc_id long, quality int", [(1, 1), (1, 1), (2, None), (None, 0)])
    one = quality.fit(df, labels)
    assert quality.scores(one, pa.array(["a", None])).tolist() == [1.0, 1.0]
    assert quality.scores(quality.fit(df, labels.limit(0)), pa.array(["a"])).tolist() == [0.5]
    assert quality.score(df.limit(0), model).count() == 0


# -- the pipeline --------------------------------------------------------------------------

def test_pipeline_against_brute_force(spark, small, public):
    """Every stage's decisions on its own input, and the whole against the stages."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept, before = [], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, small)
        rows = after.toPandas()
        assert list(rows.columns) == docs.columns and rows["doc_id"].is_unique
        kept.append((name, before.toPandas(), rows))
        before = spark.createDataFrame(rows, docs.schema)
    labels = dict(spark.read.parquet(f"{small}/labels.parquet").select("doc_id", "quality").collect())
    _, inn, out = kept[0]
    known = [d for d in inn["doc_id"] if labels.get(d) == 1]
    assert np.mean([d in set(out["doc_id"]) for d in known]) > 0.97
    assert np.mean([d in set(out["doc_id"]) for d in inn["doc_id"] if labels.get(d) == 0]) < 0.35

    _, inn, out = kept[1]
    ids = [int(d) for d in inn["doc_id"]]
    assert sorted(out["doc_id"]) == sorted(set(slow_groups([slow_fingerprint(t) for t in inn["text"]], ids))) and len(out) < len(inn)

    _, inn, out = kept[2]
    items = [" ".join(re.findall(r"[^\W_]+", r["text"].lower())) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    hit = {d for d, t in zip(inn["doc_id"], inn["text"]) for b in items if f" {b} " in " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "}
    assert set(inn["doc_id"]) - set(out["doc_id"]) == hit

    _, inn, out = kept[3]
    assert set(inn["doc_id"]) == set(out["doc_id"])
    pattern = re.compile(r"AKIA[A-Z0-9]{12,}|[0-9a-f]{32,}")
    assert not any(pattern.search(t) for t in out["text"])
    assert (out["n_chars"] == out["text"].str.len()).all()

    final = corpus_pipeline.run(spark, small).toPandas().set_index("doc_id")
    assert set(final.index) == set(out["doc_id"])
    for d, text in zip(out["doc_id"], out["text"]):
        assert final.loc[d, "ids"].tolist() == public.encode(text, add_special_tokens=False).ids
