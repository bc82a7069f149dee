"""The given tables in the shapes the operators take, and the same shapes as SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saddle.functions.geometry import init_uniform
from saddle.functions.uniform import uniform_sql
from saddle.operators.corpus import skipgram_pairs, vocabulary
from saddle.operators.graph import both_directions, edges_bipartite, edges_bipartite_offset
from saddle.operators.sentences import coview_sentences, customer_sentences
from saddle.skew import dealt, lookup_join
from saddle.storage import materialise


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# -- product views -------------------------------------------------------------------------

def views(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as product views: who, what, when."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("order"), F.col("o_custkey").alias("customer_id"))
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("order"), F.col("l_partkey").alias("product_id"),
                                                F.col("l_shipdate").alias("date_viewed"))
    return lookup_join(lines, orders, "order").select("customer_id", "product_id", "date_viewed")


VIEWS = ("views AS (SELECT o_custkey AS customer_id, l_partkey AS product_id, l_shipdate AS date_viewed "
         "FROM lineitem JOIN orders ON l_orderkey = o_orderkey)")

CUSTOMER_SENTENCES = (
    "sent AS (SELECT customer_id AS sentence_id, "
    "row_number() OVER (PARTITION BY customer_id ORDER BY date_viewed, product_id) - 1 AS pos, "
    "product_id AS token FROM views)")

COVIEW_SENTENCES = (
    "cov AS (SELECT * FROM (SELECT product_id AS sentence_id, "
    "row_number() OVER (PARTITION BY product_id ORDER BY date_viewed, customer_id) - 1 AS pos, "
    "customer_id AS token, count(*) OVER (PARTITION BY product_id) AS n FROM views) WHERE n > 1)")


def product_sentences(spark: SparkSession, sf: str, seen: DataFrame | None = None) -> DataFrame:
    return customer_sentences(views(spark, sf) if seen is None else seen)


def coviews(spark: SparkSession, sf: str) -> DataFrame:
    return coview_sentences(views(spark, sf))


# -- graphs --------------------------------------------------------------------------------

def view_edges(spark: SparkSession, sf: str, seen: DataFrame | None = None) -> DataFrame:
    """Distinct customer-product edges."""
    return edges_bipartite(views(spark, sf) if seen is None else seen, "customer_id", "product_id")


def view_graph(spark: SparkSession, sf: str, seen: DataFrame | None = None) -> DataFrame:
    """The same graph undirected, products moved past the customers."""
    # written once: the offset needs all edges before the first is moved
    return both_directions(edges_bipartite_offset(materialise(view_edges(spark, sf, seen))))


EDGES = "edges AS (SELECT DISTINCT customer_id AS src, product_id AS dst FROM views)"
OFFSET = "shifted AS (SELECT src, dst + (SELECT max(src) FROM edges) + 1 AS dst FROM edges)"
GRAPH = "graph AS (SELECT src, dst FROM shifted UNION ALL SELECT dst, src FROM shifted)"


def customer_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Customers next to each other in a co-view sentence, both directions, distinct."""
    tokens = coviews(spark, sf)
    rows = tokens.count()
    pairs = skipgram_pairs(tokens, 1, rows)
    return dealt(pairs.select(F.col("x").alias("src"), F.col("y").alias("dst")), 2 * rows, "src", "dst").distinct()


CUSTOMER_GRAPH = (
    "half AS (SELECT token AS a, lead(token) OVER (PARTITION BY sentence_id ORDER BY pos) AS b FROM cov), "
    "cgraph AS (SELECT a AS src, b AS dst FROM half WHERE a <> b UNION SELECT b, a FROM half WHERE a <> b)")


# fixed values: market segments in the order of their label numbers
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
FIRST_SEGMENT_LABEL = 25


def customer_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Multi-label customers: the nation above zero balance, 25 + segment below 5000."""
    c = table(spark, sf, "customer")
    segment = F.array_position(F.array(*[F.lit(s) for s in SEGMENTS]), F.col("c_mktsegment")).cast("int") - 1
    both = F.array(F.when(F.col("c_acctbal") >= 0, F.col("c_nationkey")),
                   F.when(F.col("c_acctbal") < 5000, segment + FIRST_SEGMENT_LABEL))
    return c.select(F.col("c_custkey").alias("id"), F.explode(F.array_compact(both)).alias("label"))


CUSTOMER_LABELS = (
    "labelled AS (SELECT c_custkey AS id, c_nationkey AS label FROM customer WHERE c_acctbal >= 0 UNION ALL "
    "SELECT c_custkey, CAST(list_position(["
    + ", ".join(f"'{s}'" for s in SEGMENTS)
    + f"], c_mktsegment) AS INTEGER) - 1 + {FIRST_SEGMENT_LABEL} FROM customer WHERE c_acctbal < 5000)")


def customer_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Single-label customers ``(id, cat)``."""
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("cat"))


# -- customer features ---------------------------------------------------------------------

def customer_features(spark: SparkSession, sf: str) -> DataFrame:
    """One row per customer: categories, numbers and the four targets."""
    c = table(spark, sf, "customer")
    n = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("shippingCountry"))
    o = table(spark, sf, "orders")
    facts = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.round(F.sum("o_totalprice"), 2).alias("sales"),
        F.round(F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))), 2).alias("returned"),
        F.max("o_orderdate").alias("last"))
    zero = lambda x: F.coalesce(F.col(x), F.lit(0.0))
    return c.join(facts, "c_custkey", "left").join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("c_custkey").alias("id"), "shippingCountry", F.col("c_mktsegment").alias("gender"),
        F.col("c_acctbal").alias("balance"), F.coalesce("n_orders", F.lit(0)).alias("n_orders"),
        zero("sales").alias("target_sales_value"), zero("returned").alias("target_returned_value"),
        F.round(zero("sales") - zero("returned"), 2).alias("target_net_value"),
        F.coalesce(F.col("last") < F.lit("2001-01-01").cast("timestamp_ntz"), F.lit(True)).alias("target_churned"))


FEATURES = """facts AS (SELECT o_custkey, count(*) AS n_orders, round(sum(o_totalprice), 2) AS sales,
  round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 2) AS returned, max(o_orderdate) AS last_order
  FROM orders GROUP BY o_custkey),
features AS (SELECT c_custkey AS id, n_name AS "shippingCountry", c_mktsegment AS gender, c_acctbal AS balance,
  coalesce(n_orders, 0) AS n_orders, coalesce(sales, 0.0) AS target_sales_value,
  coalesce(returned, 0.0) AS target_returned_value,
  round(coalesce(sales, 0.0) - coalesce(returned, 0.0), 2) AS target_net_value,
  coalesce(last_order < TIMESTAMP '2001-01-01', true) AS target_churned
  FROM customer LEFT JOIN facts ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey)"""


# -- vectors -------------------------------------------------------------------------------

WIDTH = 64


def vectors(spark: SparkSession, sf: str, scale: float = 1.0) -> DataFrame:
    """The embeddings table as ``(id, v array<double>, label)``."""
    e = table(spark, sf, "embeddings")
    v = F.col("embedding").cast("array<double>")
    if scale != 1.0:
        v = F.transform(v, lambda a: a * F.lit(scale))
    return e.select(F.col("vec_id").alias("id"), v.alias("v"), "label")


def vectors_sql(scale: float = 1.0, name: str = "vecs") -> str:
    v = "CAST(embedding AS DOUBLE[])"
    if scale != 1.0:
        v = f"list_transform({v}, lambda a: a * {scale})"
    return f"{name} AS (SELECT vec_id AS id, {v} AS v, label FROM embeddings)"


def vector_pairs(spark: SparkSession, sf: str, scale: float = 1.0) -> DataFrame:
    """Each vector beside the next one by id: ``(id, x, y)``."""
    e = vectors(spark, sf, scale)
    nxt = e.select((F.col("id") - 1).alias("id"), F.col("v").alias("y"))
    return e.select("id", F.col("v").alias("x")).join(nxt, "id")


def vector_pairs_sql(scale: float = 1.0) -> str:
    return vectors_sql(scale) + ", vpairs AS (SELECT a.id, a.v AS x, b.v AS y FROM vecs a JOIN vecs b ON b.id = a.id + 1)"


# -- start vectors of products -------------------------------------------------------------

def product_vocab(spark: SparkSession, sf: str, seen: DataFrame | None = None) -> DataFrame:
    seen = views(spark, sf) if seen is None else seen
    return vocabulary(seen.select(F.col("product_id").alias("token")))


PRODUCT_VOCAB = (
    "counts AS (SELECT product_id AS token, count(*) AS freq FROM views GROUP BY product_id), "
    "vocab AS (SELECT token, freq, row_number() OVER (ORDER BY freq DESC, token) - 1 AS idx FROM counts)")


def start_vectors(spark: SparkSession, sf: str, d: int = 2, width: float = 0.5, seen: DataFrame | None = None) -> DataFrame:
    """Reproducible start state of every product: ``(id, w_in, w_out, b)``."""
    seen = views(spark, sf) if seen is None else seen
    parts = seen.select(F.col("product_id").alias("id")).distinct()
    return parts.select("id", init_uniform("in", "id", d, width).alias("w_in"),
                        init_uniform("out", "id", d, width).alias("w_out"), F.lit(0.0).alias("b"))


def uniform_array_sql(seed: str, key: str, d: int, width: float) -> str:
    items = ", ".join(f"({uniform_sql(seed, key, str(i))} * 2.0 - 1.0) * {width!r}" for i in range(1, d + 1))
    return f"[{items}]"


def start_sql(d: int = 2, width: float = 0.5) -> str:
    return (f"state AS (SELECT id, {uniform_array_sql('in', 'id', d, width)} AS w_in, "
            f"{uniform_array_sql('out', 'id', d, width)} AS w_out, 0.0::DOUBLE AS b "
            "FROM (SELECT DISTINCT product_id AS id FROM views))")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder for a query that writes and reads back."""
    import uuid

    from saddle.storage import shared_folder

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
