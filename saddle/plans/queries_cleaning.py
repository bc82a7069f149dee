"""Cleaning and joins over the given tables."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from saddle.functions.uniform import uniform, uniform_sql
from saddle.operators import cleaning as c
from saddle.operators.corpus import make_batches
from saddle.operators.negatives import batch_cross_negatives, negative_samples, noise_distribution
from saddle.operators.sentences import id2idx, idx2id, index_ids, walk_table
from saddle.operators.vectors import embedding_lookup, pairwise_block
from saddle.plans.negatives_sql import batches_sql, negatives_sql
from saddle.plans.registry import query, r, rs, vec_rows, vec_rows_sql
from saddle.plans.tables import (
    CUSTOMER_SENTENCES, EDGES, FEATURES, GRAPH, OFFSET, PRODUCT_VOCAB, VIEWS, customer_classes, customer_features,
    product_sentences, product_vocab, start_sql, start_vectors, table, vectors, vectors_sql, view_edges, view_graph, views,
)
from saddle.skew import first_per_key, lookup_join


@query("dedup_pairs", "SELECT o_custkey, o_orderpriority, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER "
       "(PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS k FROM orders) WHERE k = 1")
def _dedup_pairs(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice")
    return c.dedup_pairs(o, ["o_custkey", "o_orderpriority"], ["o_orderkey"])


@query("dedup_ids", "SELECT o_custkey, o_orderstatus FROM (SELECT *, row_number() OVER "
       "(PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) WHERE k = 1")
def _dedup_ids(spark, sf):
    return c.dedup_ids(table(spark, sf, "orders"), "o_custkey", ["o_orderkey"], ["o_orderstatus"])


@query("exclude_ids", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN "
       "(SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def _exclude_ids(spark, sf):
    bad = table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return c.exclude_ids(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), bad, "o_custkey")


@query("subtract_by_key", "SELECT user_id, event_id FROM events e WHERE NOT EXISTS "
       "(SELECT 1 FROM customer WHERE c_custkey = e.user_id AND c_mktsegment = 'BUILDING')")
def _subtract_by_key(spark, sf):
    gone = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    return c.subtract_by_key(table(spark, sf, "events").select("user_id", "event_id"), gone, "user_id")


@query("drop_single_token_sentences", f"WITH {VIEWS}, d AS (SELECT customer_id, date_viewed, product_id, count(*) OVER "
       "(PARTITION BY customer_id, date_viewed) AS n FROM views) SELECT customer_id, product_id AS token FROM d WHERE n > 1")
def _drop_single(spark, sf):
    day = views(spark, sf).select(
        F.concat_ws("|", "customer_id", F.col("date_viewed").cast("string")).alias("sentence_id"),
        "customer_id", F.col("product_id").alias("token"))
    return c.drop_single_token_sentences(day).select("customer_id", "token")


@query("fillna_const", f"WITH {vectors_sql()}, filled AS (SELECT c_custkey AS id, coalesce(v, list_transform(range(64), lambda i: 10.0::DOUBLE)) AS v "
       f"FROM customer LEFT JOIN vecs ON c_custkey = id) {vec_rows_sql('filled', ['id'], 'v')}")
def _fillna(spark, sf):
    left = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    return vec_rows(c.fillna_const(lookup_join(left, vectors(spark, sf), "id", "left"), "v", 64), ["id"], "v")


@query("cast_labels", "SELECT CAST(doc_id AS INTEGER) AS doc_id, CAST(quality AS INTEGER) AS cat FROM labels")
def _cast_labels(spark, sf):
    rows = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("doc_id"),
                                             F.col("quality").cast("string").alias("cat"))
    return c.cast_labels(rows, ["doc_id", "cat"])


@query("drop_columns", f"WITH {FEATURES} SELECT id, \"shippingCountry\", gender, balance, n_orders FROM features")
def _drop_columns(spark, sf):
    return c.drop_columns(customer_features(spark, sf),
                          ["target_sales_value", "target_returned_value", "target_net_value", "target_churned"])


@query("map_category", "SELECT doc_id, CAST(CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN 2 END AS INTEGER) "
       "AS cat FROM documents")
def _map_category(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", c.map_category("lang", {"en": 0, "de": 1, "fr": 2}).alias("cat"))


@query("age_decade", "SELECT p_partkey, CAST(least(floor(p_size / 10), 3) AS INTEGER) AS decade FROM part")
def _age_decade(spark, sf):
    return table(spark, sf, "part").select("p_partkey", c.age_decade("p_size", 3).alias("decade"))


@query("assert_unique_key", "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def _unique(spark, sf):
    c.assert_unique_key(table(spark, sf, "orders"), "o_orderkey")
    return c.duplicate_keys(table(spark, sf, "lineitem"), "l_orderkey")


# -- joins ---------------------------------------------------------------------------------

def _joined_sql(how):
    """Whole vectors; a row without one keeps a single row with nulls."""
    return (f"WITH {FEATURES}, {vectors_sql()}, both_ AS (SELECT f.id, f.balance, e.label, CASE WHEN e.v IS NULL THEN [NULL::DOUBLE] ELSE e.v END AS v "
            f"FROM features f {how} JOIN vecs e ON e.id = f.id) {vec_rows_sql('both_', ['id', 'balance', 'label'], 'v')}")


def _features_emb(spark, sf, how):
    f = customer_features(spark, sf).select("id", "balance")
    joined = lookup_join(f, vectors(spark, sf), "id", how)
    joined = joined.withColumn("v", F.coalesce("v", F.array(F.lit(None).cast("double"))))
    return vec_rows(joined, ["id", "balance", "label"], "v")


@query("join_features_emb_inner", _joined_sql("INNER"))
def _join_inner(spark, sf):
    return _features_emb(spark, sf, "inner")


@query("join_features_emb_left", _joined_sql("LEFT"))
def _join_left(spark, sf):
    return _features_emb(spark, sf, "left")


@query("restrict_to_embedded", f"WITH {FEATURES} SELECT id, balance, n_orders FROM features WHERE id IN "
       "(SELECT vec_id FROM embeddings)")
def _restrict(spark, sf):
    ids = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"))
    return lookup_join(customer_features(spark, sf).select("id", "balance", "n_orders"), ids, "id", "left_semi")


_INDEX = ("cidx AS (SELECT customer_id AS id, row_number() OVER (ORDER BY min(date_viewed), customer_id) - 1 AS idx "
          "FROM views GROUP BY customer_id)")


@query("attach_index", f"WITH {VIEWS}, {_INDEX} SELECT idx, product_id, count(*) AS n FROM views JOIN cidx ON id = customer_id "
       "GROUP BY 1, 2")
def _attach_index(spark, sf):
    v = views(spark, sf)
    joined = id2idx(v.select("customer_id", "product_id"), index_ids(v, "customer_id", "date_viewed"), "customer_id")
    return joined.groupBy("idx", "product_id").agg(F.count(F.lit(1)).alias("n"))


@query("id2idx", f"WITH {VIEWS}, {_INDEX} SELECT o_orderkey, idx FROM orders JOIN cidx ON o_custkey = id")
def _id2idx(spark, sf):
    index = index_ids(views(spark, sf), "customer_id", "date_viewed")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return id2idx(orders, index, "o_custkey").select("o_orderkey", "idx")


@query("idx2id", f"WITH {VIEWS}, {_INDEX} SELECT event_id, id FROM events JOIN cidx ON user_id = idx")
def _idx2id(spark, sf):
    index = index_ids(views(spark, sf), "customer_id", "date_viewed")
    events = table(spark, sf, "events").select("event_id", "user_id")
    return idx2id(events, index, "user_id").select("event_id", "id")


@query("label_join", "SELECT o_orderkey, c_nationkey AS cat, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey")
def _label_join(spark, sf):
    data = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("id"), "o_totalprice")
    return lookup_join(data, customer_classes(spark, sf), "id").select("o_orderkey", "cat", "o_totalprice")


@query("first_per_group_join", f"WITH {vectors_sql()}, firsts AS (SELECT o_custkey AS id, arg_min(o_totalprice, (o_orderdate, o_orderkey)) "
       f"AS target FROM orders GROUP BY 1), both_ AS (SELECT e.id, target, v FROM vecs e JOIN firsts f ON e.id = f.id) "
       f"{vec_rows_sql('both_', ['id', 'target'], 'v')}")
def _first_join(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), "o_orderdate", "o_orderkey",
                                          F.col("o_totalprice").alias("target"))
    firsts = first_per_key(o, ["id"], ["o_orderdate", "o_orderkey"]).select("id", "target")
    return vec_rows(vectors(spark, sf).join(firsts, "id"), ["id", "target"], "v")


@query("embedding_lookup", f"WITH {VIEWS}, {CUSTOMER_SENTENCES}, {start_sql()}, pairs AS (SELECT DISTINCT token AS x, y FROM "
       "(SELECT token, lead(token) OVER (PARTITION BY sentence_id ORDER BY pos) AS y FROM sent) WHERE y IS NOT NULL) "
       f"SELECT x, y, {rs('a.w_in[1]')} AS x1, {rs('a.w_in[2]')} AS x2, {rs('b.w_out[1]')} AS y1, {rs('b.w_out[2]')} AS y2 "
       "FROM pairs JOIN state a ON a.id = x JOIN state b ON b.id = y")
def _lookup(spark, sf):
    after = F.lead("token").over(Window.partitionBy("sentence_id").orderBy("pos"))
    pairs = product_sentences(spark, sf).select(F.col("token").alias("x"), after.alias("y")).where("y is not null").distinct()
    both = embedding_lookup(pairs, start_vectors(spark, sf))
    return both.select("x", "y", r(F.col("vx")[0]).alias("x1"), r(F.col("vx")[1]).alias("x2"),
                       r(F.col("vy")[0]).alias("y1"), r(F.col("vy")[1]).alias("y2"))


@query("adjacency_step", f"""WITH {VIEWS}, {EDGES}, {OFFSET}, {GRAPH},
 adj AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS nbr, count(*) OVER (PARTITION BY src) AS deg FROM graph)
 SELECT src AS start, dst AS next FROM adj WHERE nbr = CAST(floor({uniform_sql('step', 'src')} * deg) AS BIGINT)""")
def _adjacency_step(spark, sf):
    table_ = walk_table(view_graph(spark, sf))
    starts = table_.groupBy("src").agg(F.count(F.lit(1)).alias("deg")).select(
        "src", F.floor(uniform("step", "src") * F.col("deg")).cast("bigint").alias("nbr"))
    return starts.join(table_, ["src", "nbr"]).select(F.col("src").alias("start"), F.col("dst").alias("next"))


def _batched(spark, sf, size=256):
    edges = view_edges(spark, sf).select(F.col("src").alias("x"), F.col("dst").alias("y"))
    return make_batches(edges, size, ["x", "y"])


def _batch_negatives(spark, sf, batches, n=5):
    noise = noise_distribution(product_vocab(spark, sf), id_col="token")
    return negative_samples(batches, noise, n)


@query("batch_cross_negatives", f"WITH {VIEWS}, {EDGES}, {PRODUCT_VOCAB}, {batches_sql(256)}, {negatives_sql(5)} "
       "SELECT x, y, n.id AS neg FROM batches b JOIN negatives n ON b.batch_id = n.batch_id")
def _cross(spark, sf):
    batches = _batched(spark, sf)
    return batch_cross_negatives(batches, _batch_negatives(spark, sf, batches)).select("x", "y", "neg")


@query("pairwise_block", f"WITH {VIEWS}, {EDGES}, {PRODUCT_VOCAB}, {start_sql()}, {batches_sql(256)}, {negatives_sql(5)} "
       f"SELECT x, y, n.id AS neg, {rs('p.w_in[1] * q.w_out[1] + p.w_in[2] * q.w_out[2]')} AS dot FROM batches b "
       "JOIN negatives n ON b.batch_id = n.batch_id JOIN state p ON p.id = b.y JOIN state q ON q.id = n.id")
def _block(spark, sf):
    state = start_vectors(spark, sf)
    batches = _batched(spark, sf)
    negatives = _batch_negatives(spark, sf, batches)
    left = lookup_join(batches.select("batch_id", "x", F.col("y").alias("id")), state, "id").select(
        "batch_id", F.struct("x", F.col("id").alias("y")).alias("id"), F.col("w_in").alias("v"))
    right = lookup_join(negatives, state, "id").select("batch_id", "id", F.col("w_out").alias("v"))
    pairs = pairwise_block(left, right)
    dot = F.col("vx")[0] * F.col("vy")[0] + F.col("vx")[1] * F.col("vy")[1]
    return pairs.select("x.x", F.col("x.y").alias("y"), F.col("y").alias("neg"), r(dot).alias("dot"))
