"""Sentences, walks, vocabularies, pairs and negatives."""
from __future__ import annotations

from pyspark.sql import functions as F

from saddle.functions.uniform import uniform_sql
from saddle.operators import corpus as c
from saddle.operators import negatives as neg
from saddle.operators import sentences as s
from saddle.operators.graph import edges_bipartite_offset
from saddle.plans.negatives_sql import batches_sql, negatives_sql, noise_sql
from saddle.plans.registry import query, r, rs
from saddle.plans.tables import (
    COVIEW_SENTENCES, CUSTOMER_SENTENCES, EDGES, GRAPH, OFFSET, PRODUCT_VOCAB, VIEWS, coviews,
    product_sentences, product_vocab, table, view_edges, view_graph, views,
)
from saddle.plans.walks_sql import walks_sql
from saddle.storage import materialise

# -- sentences -----------------------------------------------------------------------------


@query("index_ids", f"WITH {VIEWS} SELECT customer_id AS id, row_number() OVER (ORDER BY min(date_viewed), customer_id) - 1 AS idx "
       "FROM views GROUP BY customer_id")
def _index(spark, sf):
    return s.index_ids(views(spark, sf), "customer_id", "date_viewed")


@query("coview_sentences", f"WITH {VIEWS}, {COVIEW_SENTENCES} SELECT sentence_id, pos, token FROM cov")
def _coview(spark, sf):
    return coviews(spark, sf)


@query("customer_sentences", f"WITH {VIEWS}, {CUSTOMER_SENTENCES} SELECT sentence_id, pos, token FROM sent")
def _customer(spark, sf):
    return product_sentences(spark, sf)


def _sessions_sql(gap_hours: int) -> str:
    micros = gap_hours * 3_600_000_000
    return f"""gaps AS (SELECT user_id, ts, event_id, event_type, CASE WHEN lag(ts) OVER w IS NULL
   OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > {micros} THEN 1 ELSE 0 END AS opens
   FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 sess AS (SELECT user_id, ts, event_id, event_type, CAST(sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id
   ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no FROM gaps)"""


@query("sessionize", f"WITH {_sessions_sql(1)} SELECT user_id, event_id, session_no FROM sess")
def _sessionize(spark, sf):
    return s.sessionize(table(spark, sf, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "session_no")


@query("session_sentences", f"""WITH {_sessions_sql(12)}, sized AS (SELECT *, count(*) OVER (PARTITION BY user_id, session_no) AS n,
   row_number() OVER (PARTITION BY user_id, session_no ORDER BY ts, event_id) - 1 AS pos FROM sess)
 SELECT user_id || ':' || session_no AS sentence_id, pos, event_type AS token FROM sized WHERE n > 1""")
def _session_sentences(spark, sf):
    sessions = s.sessionize(table(spark, sf, "events"), "user_id", "ts", "event_id", 12 * 3600.0)
    return s.session_sentences(sessions, "user_id", "ts", "event_id", "event_type")


_GRAPH = f"{VIEWS}, {EDGES}, {OFFSET}, {GRAPH}"
_WALKS = walks_sql(_GRAPH, 2, 8)


@query("random_walks", f"{_WALKS} SELECT start, walk_no, array_to_string(path, ',') AS walk FROM walks")
def _walks(spark, sf):
    walks = s.random_walks(view_graph(spark, sf), 2, 8, block=3)
    return walks.select("start", F.col("walk_no").cast("bigint").alias("walk_no"),
                        F.array_join(F.col("path").cast("array<string>"), ",").alias("walk"))


@query("shuffle_walks", f"{walks_sql(_GRAPH, 2, 3)} SELECT start, walk_no, row_number() OVER (ORDER BY "
       f"{uniform_sql('shuffle', 'start', 'walk_no')}, start, walk_no) - 1 AS place FROM walks")
def _shuffle(spark, sf):
    return s.shuffle_walks(s.random_walks(view_graph(spark, sf), 2, 3)).select(
        "start", F.col("walk_no").cast("bigint").alias("walk_no"), "place")


@query("walk_prefixes", f"{_WALKS} SELECT start, walk_no, array_to_string(path[1:4], ',') AS walk FROM walks WHERE walk_no < 1")
def _prefixes(spark, sf):
    walks = s.walk_prefixes(s.random_walks(view_graph(spark, sf), 2, 8), 4, 1)
    return walks.select("start", F.col("walk_no").cast("bigint").alias("walk_no"),
                        F.array_join(F.col("path").cast("array<string>"), ",").alias("walk"))


# -- vocabulary ----------------------------------------------------------------------------

_WORDS = ("words AS (SELECT doc_id AS sentence_id, unnest(list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\x0B\\f\\r]+'), "
          "lambda w: w <> '')) AS token, "
          "generate_subscripts(list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> ''), 1) - 1 AS pos "
          "FROM documents)")
_WCOUNTS = "wcounts AS (SELECT token, count(*) AS freq FROM words GROUP BY token)"


@query("vocabulary", f"WITH {VIEWS}, {PRODUCT_VOCAB} SELECT token, freq, idx FROM vocab")
def _vocabulary(spark, sf):
    return product_vocab(spark, sf)


_UNK = (f"{_WORDS}, {_WCOUNTS}, uvocab AS (SELECT 'UNK' AS token, CAST(coalesce(sum(freq), 0) AS BIGINT) AS freq, 0::BIGINT AS idx FROM wcounts "
        "WHERE freq < 5 UNION ALL SELECT token, freq, row_number() OVER (ORDER BY freq DESC, token) FROM wcounts WHERE freq >= 5)")


@query("vocabulary_unk", f"WITH {_UNK} SELECT token, freq, idx FROM uvocab")
def _vocabulary_unk(spark, sf):
    return c.vocabulary_unk(c.document_tokens(table(spark, sf, "documents")), 5)


@query("encode_corpus", f"WITH {_UNK} SELECT sentence_id, pos, coalesce(idx, 0) AS idx FROM words w LEFT JOIN uvocab v "
       "ON w.token = v.token AND v.idx > 0")
def _encode(spark, sf):
    tokens = materialise(c.document_tokens(table(spark, sf, "documents")))
    vocab = c.vocabulary_unk(tokens, 5).where("idx > 0")
    return c.encode_corpus(tokens, vocab, unknown=0)


@query("encode_corpus_known", f"WITH {_WORDS}, {_WCOUNTS}, known AS (SELECT token, row_number() OVER (ORDER BY freq DESC, token) - 1 AS idx "
       "FROM wcounts WHERE freq >= 5) SELECT sentence_id, pos, idx FROM words w JOIN known k ON w.token = k.token")
def _encode_known(spark, sf):
    """Words below the count leave the corpus instead of becoming the unknown token."""
    tokens = materialise(c.document_tokens(table(spark, sf, "documents")))
    return c.encode_corpus(tokens, c.vocabulary(tokens, 5))


@query("unigram_counts", f"WITH {VIEWS} SELECT row_number() OVER (ORDER BY min(date_viewed), customer_id) - 1 AS idx, count(*) AS n "
       "FROM views GROUP BY customer_id")
def _unigrams(spark, sf):
    v = views(spark, sf)
    return c.unigram_counts(v, "customer_id", s.index_ids(v, "customer_id", "date_viewed"))


# -- pairs ---------------------------------------------------------------------------------

def _pairs_sql(window: int, source: str = "sent", other: str = "a.token <> b.token") -> str:
    return (f"pairs AS (SELECT a.token AS x, b.token AS y FROM {source} a JOIN {source} b ON a.sentence_id = b.sentence_id "
            f"AND abs(a.pos - b.pos) <= {window} AND a.pos <> b.pos WHERE {other})")


def _near_sql(window: int, source: str, other: str) -> str:
    """Pairs from the next and previous tokens of each place."""
    order = "OVER (PARTITION BY sentence_id ORDER BY pos)"
    steps = [k for k in range(-window, window + 1) if k]
    seen = ", ".join(f"{'lead' if k > 0 else 'lag'}(token, {abs(k)}) {order} AS t{i}" for i, k in enumerate(steps))
    near = f"near AS (SELECT sentence_id, pos, token, {seen} FROM {source})"
    return near + " " + " UNION ALL ".join(
        f"SELECT sentence_id, pos, CAST({k} AS INTEGER) AS k, token AS x, t{i} AS y FROM near WHERE t{i} IS NOT NULL AND {other.format(i)}"
        for i, k in enumerate(steps))


@query("skipgram_pairs", f"WITH {VIEWS}, {CUSTOMER_SENTENCES}, {_near_sql(2, 'sent', 'token <> t{}')}")
def _skipgram(spark, sf):
    return c.skipgram_pairs(product_sentences(spark, sf), 2)


@query("skipgram_pairs_positional", f"WITH {VIEWS}, {COVIEW_SENTENCES}, {_near_sql(2, 'cov', 'true')}")
def _positional(spark, sf):
    return c.skipgram_pairs_positional(coviews(spark, sf), 2)


_STREAM = (f"{VIEWS}, {CUSTOMER_SENTENCES}, placed AS (SELECT token, row_number() OVER (ORDER BY sentence_id, pos) - 1 AS spot FROM sent), "
           "stream AS (SELECT spot // 1000 AS sentence_id, spot % 1000 AS pos, token FROM placed)")


@query("skipgram_pairs_dynamic", f"WITH {_STREAM} SELECT a.token AS x, b.token AS y FROM stream a JOIN stream b "
       "ON a.sentence_id = b.sentence_id AND a.pos <> b.pos AND abs(a.pos - b.pos) <= "
       f"floor({uniform_sql('window', 'a.sentence_id', 'a.pos')} * 5) + 1")
def _dynamic(spark, sf):
    return c.skipgram_pairs_dynamic(c.stream_chunks(product_sentences(spark, sf), 1000), 5)


_BUDGET = "(0.001 * (SELECT sum(freq) FROM wcounts)::DOUBLE)"


@query("subsample_tokens", f"WITH {_WORDS}, {_WCOUNTS} SELECT sentence_id, pos, w.token FROM words w JOIN wcounts k ON w.token = k.token "
       f"WHERE {uniform_sql('keep', 'sentence_id', 'pos')} <= (sqrt(freq / {_BUDGET}) + 1) * {_BUDGET} / freq")
def _subsample(spark, sf):
    tokens = c.document_tokens(table(spark, sf, "documents"))
    return c.subsample_tokens(tokens, materialise(c.token_counts(tokens)), 1e-3)


_KEPT = (f"{VIEWS}, {CUSTOMER_SENTENCES}, wcounts AS (SELECT token, count(*) AS freq FROM sent GROUP BY token), kept AS (SELECT sentence_id, pos, s.token "
         f"FROM sent s JOIN wcounts k ON s.token = k.token WHERE {uniform_sql('keep', 'sentence_id', 'pos')} <= (sqrt(freq / {_BUDGET}) + 1) * {_BUDGET} / freq), "
         "placed AS (SELECT token, row_number() OVER (ORDER BY sentence_id, pos) - 1 AS spot FROM kept), "
         "stream AS (SELECT spot // 100 AS sentence_id, spot % 100 AS pos, token FROM placed)")


@query("skipgram_pairs_kept_stream", f"WITH {_KEPT} SELECT a.token AS x, b.token AS y, count(*) AS n FROM stream a JOIN stream b "
       "ON a.sentence_id = b.sentence_id AND a.pos <> b.pos AND abs(a.pos - b.pos) <= "
       f"floor({uniform_sql('window', 'a.sentence_id', 'a.pos')} * 5) + 1 GROUP BY 1, 2")
def _kept_stream(spark, sf):
    """Frequent tokens are thinned first; windows run over what is kept."""
    tokens = materialise(product_sentences(spark, sf))
    # written once: ranking samples its rows first, and each look would draw them anew
    kept = materialise(c.subsample_tokens(tokens, materialise(c.token_counts(tokens)), 1e-3))
    pairs = c.skipgram_pairs_dynamic(c.stream_chunks(kept, 100), 5)
    return pairs.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))


@query("edge_pairs", f"WITH {VIEWS}, {EDGES}, {OFFSET}, {GRAPH} SELECT src AS x, dst AS y, CAST(e AS INTEGER) AS epoch FROM graph, range(3) t(e)")
def _edge_pairs(spark, sf):
    return c.edge_pairs(edges_bipartite_offset(view_edges(spark, sf)), 3)


_MIX = f"""WITH {VIEWS}, {EDGES}, {OFFSET}, {GRAPH}, {CUSTOMER_SENTENCES}, {_pairs_sql(1)},
 sizes AS (SELECT CAST(count(*) // 64 AS BIGINT) AS steps FROM graph),
 fe AS (SELECT src AS x, dst AS y, row_number() OVER (ORDER BY {uniform_sql('batch', 'src', 'dst')}, src, dst) - 1 AS spot FROM graph),
 fw AS (SELECT x, y, row_number() OVER (ORDER BY {uniform_sql('batch', 'x', 'y')}, x, y) - 1 AS spot FROM pairs),
 places AS (SELECT unnest(range(CAST((SELECT steps FROM sizes) * 64 AS BIGINT))) AS place)
 SELECT x, y, CAST(place // 64 AS BIGINT) AS batch_id, 'edge' AS source FROM places JOIN fe ON spot = place % (SELECT count(*) FROM fe)
   WHERE place // 64 < (SELECT steps FROM sizes) // 2
 UNION ALL SELECT x, y, CAST(place // 64 AS BIGINT), 'walk' FROM places JOIN fw
   ON spot = (place - ((SELECT steps FROM sizes) // 2) * 64) % (SELECT count(*) FROM fw) WHERE place // 64 >= (SELECT steps FROM sizes) // 2"""


@query("mixed_schedule", _MIX)
def _mixed(spark, sf):
    seen = materialise(views(spark, sf))
    edges = view_graph(spark, sf, seen).select(F.col("src").alias("x"), F.col("dst").alias("y"))
    steps = edges.count() // 64
    pairs = c.skipgram_pairs(product_sentences(spark, sf, seen), 1).select("x", "y")
    return c.mixed_schedule(edges, pairs, 64, steps, ["x", "y"])


@query("cooccurrence", f"WITH {VIEWS}, {CUSTOMER_SENTENCES}, {_pairs_sql(2)} SELECT x, y, count(*) AS n FROM pairs GROUP BY x, y")
def _cooccurrence(spark, sf):
    return c.cooccurrence(product_sentences(spark, sf), 2)


# -- noise and batches ---------------------------------------------------------------------

@query("noise_distribution", f"WITH {VIEWS}, {PRODUCT_VOCAB}, {noise_sql('idx')} SELECT id, weight, "
       f"{rs('weight / (SELECT sum(weight) FROM noise)', 9)} AS p, {rs('hi / (SELECT sum(weight) FROM noise)', 9)} AS cum FROM noise")
def _noise(spark, sf):
    noise = neg.noise_distribution(product_vocab(spark, sf))
    return noise.select("id", "weight", r("p", 9).alias("p"), r("cum", 9).alias("cum"))


@query("negative_samples", f"WITH {VIEWS}, {EDGES}, {PRODUCT_VOCAB}, {batches_sql(256)}, {negatives_sql(5)} "
       "SELECT batch_id, CAST(rank AS INTEGER) AS rank, id FROM negatives")
def _negatives(spark, sf):
    edges = view_edges(spark, sf).select(F.col("src").alias("x"), F.col("dst").alias("y"))
    batches = c.make_batches(edges, 256, ["x", "y"])
    return neg.negative_samples(batches, neg.noise_distribution(product_vocab(spark, sf), id_col="token"), 5)


@query("negative_samples_per_pair", f"WITH {VIEWS}, {EDGES}, {PRODUCT_VOCAB}, {noise_sql()}, drawn AS (SELECT src, dst, CAST(draw AS INTEGER) AS draw, "
       f"CAST(floor({uniform_sql('neg', 'src', 'dst', 'draw')} * (SELECT max(hi) FROM noise)::DOUBLE) AS BIGINT) AS spot "
       "FROM edges, range(3) t(draw)) SELECT src, dst, draw, id FROM drawn JOIN noise ON spot >= hi - weight AND spot < hi WHERE id <> dst")
def _negatives_pair(spark, sf):
    seen = materialise(views(spark, sf))
    noise = neg.noise_distribution(product_vocab(spark, sf, seen), id_col="token")
    out = neg.negative_samples_per_pair(view_edges(spark, sf, seen), noise, 3, ["src", "dst"], "dst")
    return out.select("src", "dst", "draw", "id")


@query("make_batches", f"WITH {VIEWS}, {EDGES}, {batches_sql(256)} SELECT x, y, batch_id FROM batches")
def _batches(spark, sf):
    edges = view_edges(spark, sf).select(F.col("src").alias("x"), F.col("dst").alias("y"))
    return c.make_batches(edges, 256, ["x", "y"])


@query("random_batch", "WITH placed AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS spot FROM embeddings), "
       f"draws AS (SELECT draw, CAST(floor({uniform_sql('draw', 'draw')} * (SELECT count(*) FROM placed)) AS BIGINT) AS spot "
       "FROM range(1000) t(draw)) SELECT draw, vec_id, label FROM draws JOIN placed USING (spot)")
def _random_batch(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", "label")
    return c.random_batch(rows, ["vec_id"], 1000)


@query("learning_rate", f"WITH {VIEWS}, {EDGES}, {batches_sql(256)}, sizes AS (SELECT batch_id, count(*) AS n FROM batches GROUP BY 1), "
       "run AS (SELECT batch_id, CAST(sum(n) OVER (ORDER BY batch_id) - n AS BIGINT) AS done FROM sizes) "
       f"SELECT batch_id, done, {rs('0.2 * greatest(0.0001, 1 - done / (SELECT sum(n) FROM sizes))')} AS lr FROM run")
def _lr(spark, sf):
    edges = view_edges(spark, sf).select(F.col("src").alias("x"), F.col("dst").alias("y"))
    sizes = c.make_batches(edges, 256, ["x", "y"]).groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))
    return c.learning_rate_schedule(sizes, 0.2).withColumn("lr", r("lr"))

