"""op4, op5 and op6: round trips and brute force."""
import gzip
import io
import zlib
from hashlib import sha1, sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from saddle.llm import chat, crosspoly, warc
from saddle.llm.buckets import forest, run_pairs
from saddle.llm.components import connected_components

# -- chat ----------------------------------------------------------------------------------

NASTY = ["", None, "<|im_end|>\n<|im_start|>user\nhi<|im_end|>\n", "<\\|im_end|>", "<\\\\|", "<<|<\\", "$1 \\1 |>", "|im_start|>", "<", "é😀<|"]


def test_conversations_read_back(rows):
    data = [(c, t, ("user", "assistant")[t % 2], NASTY[(c + t) % len(NASTY)]) for c in range(len(NASTY)) for t in range(4)]
    data += [(99, 0, "odd\nrole \\n<|im_start|>", "x"), (None, 0, "user", "a"), (None, 1, "assistant", "b"), (50, 3, "assistant", "z"), (50, 3, "assistant", "z"),
             (51, None, None, None), (52, 0, "user", "w " * 100_000)]
    turns = rows("conv_id long, turn long, role string, text string", data).withColumn("legal", F.lit("clash")).withColumn("segments", F.lit(1))
    formatted = chat.segments(turns)
    got = {r["conv_id"]: r for r in chat.read_back(formatted).collect()}
    convs = {}
    for c, t, role, text in data:
        convs.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(convs)
    for c, turns_ in convs.items():
        turns_.sort()
        assert got[c]["n_turns"] == len(turns_)
        assert got[c]["turns_sha256"] == sha256("".join(f"{r}\n{x}\n" for _, r, x in turns_).encode()).hexdigest()
        learnt = "".join(x for _, r, x in turns_ if r == "assistant")
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(learnt), sha256(learnt.encode()).hexdigest())
    whole = formatted.select(F.sum(F.aggregate("segments", F.lit(0), lambda n, s: n + F.length(s["text"])))).first()[0]
    assert whole == sum(r["formatted_chars"] for r in got.values())
    assert chat.read_back(chat.segments(turns.limit(0))).count() == 0


@pytest.mark.parametrize("roles,valid", [
    ("system user assistant", True), ("user assistant user", True), ("user", True), ("assistant user", False), ("system", False),
    ("user user", False), ("user assistant tool assistant", True), ("user assistant tool", False), ("system system user", False), ("user bot", False)])
def test_machine(rows, roles, valid):
    df = rows("conv_id long, turn long, role string, text string", [(1, i, r, "x") for i, r in enumerate(roles.split())])
    assert chat.read_back(chat.segments(df)).first()["valid"] == valid


# -- archives ------------------------------------------------------------------------------

def _read(data: bytes, start: int, end: int):
    found = [(at, list(records)) for at, records in warc.members(io.BytesIO(data), len(data), start, end)]
    return [(at, records) for at, records in found if records]


def test_every_split_finds_every_record_once():
    """Also where payloads hold whole archives, stored so that their bytes lie open in the file."""
    rng = np.random.default_rng(3)
    inner = b"".join(warc.member(warc.record(i, "http://x/", b"in" * i, "0", 2 * i, None), 5) for i in range(3))
    plain = b"".join(gzip.compress(warc.record(i, "http://x/", b"in" * i, "0", 2 * i, None)) for i in range(3))
    data, want = b"", []
    for i in range(40):
        payload = rng.bytes(int(rng.integers(0, 3000))) + (inner + plain if i % 5 == 0 else b"") + warc.MAGIC
        want.append(len(data))
        data += warc.member(warc.record(i, None, payload, "0", len(payload), None), len(data))
    for split in (97, 1000, 4096, len(data)):
        found = [r for s in range(0, len(data), split) for r in _read(data, s, min(s + split, len(data)))]
        if split >= 1000:  # open nested members can stand at their own place only by chance
            assert [at for at, _ in found if at in set(want)] == want
        assert {at for at, _ in found} >= set(want)


def test_foreign_members_and_damage():
    records = [warc.record(i, f"http://x/{i}", b"p" * i * 50, "0", i * 50, None) for i in range(20)]
    data, places = b"", []
    for r in records:
        places.append(len(data))
        data += gzip.compress(r)
    found = [x for s in range(0, len(data), 64) for x in _read(data, s, min(s + 64, len(data)))]
    assert [a for a, _ in found] == places and [warc.payload_of(*c[0]) for _, c in found] == [b"p" * i * 50 for i in range(20)]
    broken = bytearray(data)
    broken[places[7] + 30] ^= 0xFF
    assert [a for a, _ in _read(bytes(broken), 0, len(broken))] == places[:7] + places[8:]
    assert [a for a, _ in _read(data[:-5], 0, len(data) - 5)] == places[:-1]
    assert zlib.decompress(data[:places[1]], 31) == records[0]


def test_members_of_many_records_and_long_headers():
    """A member may hold several records or the whole archive; gzip headers may be long."""
    records = [warc.record(i, f"http://x/{i}", bytes([i]) * (i * 977), "0", i * 977, None) for i in range(30)]
    want = [bytes([i]) * (i * 977) for i in range(30)]
    for cut in (2, 7, 30):
        data = b"".join(gzip.compress(b"".join(records[i:i + cut])) for i in range(0, 30, cut))
        for split in (50, len(data)):
            found = [x for s in range(0, len(data), split) for x in _read(data, s, min(s + split, len(data)))]
            assert [warc.payload_of(*r) for _, c in found for r in c] == want
    # an extra field of 10 KB, and a name of 200 KB
    body = gzip.compress(records[3])[10:]
    long = warc.MAGIC + b"\x04" + b"\0" * 6 + (10_000).to_bytes(2, "little") + b"XX" + (9_996).to_bytes(2, "little") + b"\x1f\x8b\x08" * 3332 + body
    named = warc.MAGIC + b"\x08" + b"\0" * 6 + b"n" * 200_000 + b"\0" + body
    found = _read(long + named, 0, len(long + named))
    assert [a for a, _ in found] == [0, len(long)] and all(warc.payload_of(*c[0]) == want[3] for _, c in found)
    # what follows a record and is none ends the member
    odd = gzip.compress(records[1] + b"something else" * 100) + gzip.compress(records[2])
    assert [warc.payload_of(*r) for _, c in _read(odd, 0, len(odd)) for r in c] == want[1:3]


@pytest.mark.parametrize("url", ["http://a.org/x%20y?q=%2Fz", "http://a/ä b", " http://a/", "a\r\nContent-Length: 0", "%", ""])
def test_urls_come_back_as_written(spark, rows, url):
    files = warc.write_archives(rows("page_id long, url string, html string", [(1, url, "x")]), warc.archive_folder(spark))
    assert [(r["url"], r["payload"]) for r in warc.read_archives(files).collect()] == [(url, b"x")]


def test_archives_of_odd_rows(spark, rows, monkeypatch):
    same, small = "x" * 1000, "y" * 999
    data = [(i, "http://a/ä b\r\n%20", same, "q") for i in range(200)] + [(500 + i, None, small, "q") for i in range(3)]
    data += [(900, "u", None, "q"), (901, "u", "", "q"), (None, "u", "z" * 5000, None), (950, "u", "é" * 400_000, "q"), (199, "http://a/ä b\r\n%20", same, "q")]
    pages = rows("page_id long, url string, html string, digest string", data).withColumn("size", F.lit(1))
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20_000)
    files = warc.write_archives(pages, warc.archive_folder(spark))
    assert files.agg(F.sum("records")).first()[0] == len(data)
    got = warc.read_archives(files, 4096).drop("payload").collect()
    assert len(got) == len(data)
    for r in got:
        if r["page_id"] is not None and r["page_id"] < 199:
            assert (r["record_type"], r["refers_to"]) == ("revisit", 199)
        else:
            assert (r["record_type"], r["refers_to"]) == ("response", None)
        text = {d[0]: d[2] or "" for d in data}[r["page_id"]]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(text.encode()), sha1(text.encode()).hexdigest())
        assert r["url"] == {d[0]: d[1] for d in data}[r["page_id"]]
    assert warc.read_archives(files, 100).rdd.getNumPartitions() > 8  # however small the list of ranges is
    none = warc.write_archives(pages.limit(0), warc.archive_folder(spark))
    assert warc.read_archives(none).count() == 0


# -- graphs and vectors --------------------------------------------------------------------

def components(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        up[find(a)] = find(b)
    out = {}
    for x in up:
        out.setdefault(find(x), set()).add(x)
    return {frozenset(v) for v in out.values() if len(v) > 1}


def test_components_of_chains_stars_and_noise(spark):
    rng = np.random.default_rng(1)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 400)] + [(5000, 5000), (1, 0), (1, 0)]
    edges += [(int(a), int(b)) for a, b in rng.integers(10_000, 10_300, (200, 2))]
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    groups = {}
    for r in got:
        groups.setdefault(r["root"], set()).add(r["node"])
    assert {frozenset(v) for v in groups.values()} == components(edges)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_forest_and_run_pairs():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 400, (2, 250))
    x, y = forest(a, b)
    assert components(zip(x.tolist(), y.tolist())) == components(zip(a.tolist(), b.tolist()))
    starts = np.array([0, 1, 5, 9])
    pairs = {(int(i), int(j)) for l, r in run_pairs(starts, 12, 7) for i, j in zip(l, r)}
    runs = [range(0, 1), range(1, 5), range(5, 9), range(9, 12)]
    assert pairs == {(i, j) for r in runs for i in r for j in r if j < i}


def test_links_of_vectors_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    dim = 24
    centre = rng.normal(size=dim)
    near = centre + rng.normal(size=(150, dim)) * 0.12          # one dense group, larger than a block
    spread = rng.normal(size=(40, 1, dim)) + rng.normal(size=(40, 3, dim)) * 0.3
    vectors = [*near.tolist(), *spread.reshape(-1, dim).tolist(), *rng.normal(size=(100, dim)).tolist()]
    vectors += [near[0].tolist()] * 70 + [(near[0] * 3).tolist()]
    odd = [None, [], [0.0] * dim, [float("nan")] + [1.0] * (dim - 1), [float("inf")] * dim, [None] + [1.0] * (dim - 1), [1.0, 2.0], [2.0, 4.0]]
    data = [(i, v, "x") for i, v in enumerate([*vectors, *odd])]
    data += [(3, vectors[3], "x"), (None, vectors[160], "x")]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, node string")
    monkeypatch.setattr(crosspoly, "BLOCK", 32)
    got = crosspoly.near_vectors(df).collect()
    assert len(got) == len(data)
    x = np.array([v for _, v, _ in data if v and len(v) == dim and None not in v and np.isfinite(v).all() and any(v)])
    ids = [i for i, v, _ in data if v and len(v) == dim and None not in v and np.isfinite(v).all() and any(v)]
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    found, true = 0, int(linked.sum())
    total = {}
    for i, n in zip(ids, linked.sum(axis=1)):
        total.setdefault(i, []).append(int(n))
    for r in got:
        if r["vec_id"] in total:
            found += r["n_links"]
            assert r["n_links"] <= max(total[r["vec_id"]])
    assert true >= found >= 0.99 * true
    by_id = {r["vec_id"]: r for r in got}
    assert by_id[len(vectors) + 6]["n_links"] == by_id[len(vectors) + 7]["n_links"] == 1  # two dimensions
    for k in range(6):
        r = by_id[len(vectors) + k]
        assert (r["n_links"], r["component_id"], r["kept"]) == (0, len(vectors) + k, True)
    assert by_id[1]["component_id"] == 0 and by_id[0]["kept"] and not by_id[1]["kept"]
    assert crosspoly.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("dim,most", [(64, 12), (256, 16), (1024, 22)])
def test_recall_at_the_threshold_by_width(dim, most):
    """Pairs of exactly the threshold's cosine, other pairs than the number of tables was chosen by."""
    rng = np.random.default_rng(9)
    a, b = rng.normal(size=(2, 600, dim))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (a * b).sum(axis=1)[:, None] * a
    b = 0.9 * a + np.sqrt(1 - 0.81) * b / np.linalg.norm(b, axis=1)[:, None]
    tables = crosspoly.tables_needed(dim, 0.9)
    assert tables <= most
    met = (crosspoly._all_codes(a, tables)[:, :, None] == crosspoly._all_codes(b, tables)[:, None, :]).any(axis=(1, 2))
    far = np.bitwise_count((crosspoly.sketches(a) ^ crosspoly.sketches(b)).view(np.uint64)).sum(axis=1)
    assert met.mean() >= 0.99 and (far <= crosspoly.sketch_limit(0.9)).mean() > 0.998


def test_too_many_tables_are_refused():
    with pytest.raises(ValueError, match="tables"):
        crosspoly.tables_needed(256, 0.3)


def test_few_links_are_missed_at_the_threshold():
    """Over 64 dimensions, pairs of exactly the threshold's cosine."""
    assert 5 <= crosspoly.tables_needed(64, 0.9) <= 12
