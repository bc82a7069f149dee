"""Graphs of customers and products, and the hierarchy of the sales tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from saddle.operators import graph as g
from saddle.plans.registry import query, r, rs
from saddle.plans.tables import (
    COVIEW_SENTENCES, CUSTOMER_GRAPH, CUSTOMER_LABELS, EDGES, FIRST_SEGMENT_LABEL, GRAPH, OFFSET, VIEWS,
    customer_classes, customer_graph, customer_labels, table, view_edges, view_graph, views,
)

_CG = f"{VIEWS}, {COVIEW_SENTENCES}, {CUSTOMER_GRAPH}"


@query("edges_bipartite", f"WITH {VIEWS}, {EDGES} SELECT src, dst FROM edges")
def _bipartite(spark, sf):
    return g.edges_bipartite(views(spark, sf), "customer_id", "product_id")


_SUPPLY = "pairs AS (SELECT l_suppkey AS src, l_partkey AS dst FROM lineitem)"


@query("edges_symmetrize", f"WITH {_SUPPLY} SELECT src, dst FROM pairs UNION SELECT dst, src FROM pairs")
def _symmetrize(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))
    return g.edges_symmetrize(lines)


@query("edges_upper", f"WITH {_CG} SELECT src, dst FROM cgraph WHERE src < dst")
def _upper(spark, sf):
    return g.edges_upper(customer_graph(spark, sf))


@query("edges_bipartite_offset", f"WITH {VIEWS}, {EDGES}, {OFFSET} SELECT src, dst FROM shifted")
def _offset(spark, sf):
    return g.edges_bipartite_offset(view_edges(spark, sf))


@query("is_symmetric", f"WITH {_CG}, {EDGES}, both_graphs AS (SELECT 'customers' AS graph, src, dst FROM cgraph UNION ALL "
       "SELECT 'views', src, dst FROM edges) SELECT graph, "
       "CAST(count(DISTINCT CASE WHEN src <> dst AND b.m IS NULL THEN (least(src, dst), greatest(src, dst)) END) AS BIGINT) AS one_way, "
       "count(CASE WHEN src <> dst AND b.m IS NULL THEN 1 END) = 0 AS symmetric FROM both_graphs a LEFT JOIN "
       "(SELECT graph AS m, src AS s2, dst AS d2 FROM both_graphs) b ON b.m = a.graph AND b.s2 = a.dst AND b.d2 = a.src "
       "GROUP BY graph")
def _symmetric(spark, sf):
    customers = g.is_symmetric(customer_graph(spark, sf)).withColumn("graph", F.lit("customers"))
    return customers.unionByName(g.is_symmetric(view_edges(spark, sf)).withColumn("graph", F.lit("views")))


@query("degree", f"WITH {VIEWS}, {EDGES}, {OFFSET}, {GRAPH} SELECT src, count(*) AS deg FROM graph GROUP BY src")
def _degree(spark, sf):
    return g.degree(view_graph(spark, sf))


@query("adjacency_list", f"WITH {VIEWS}, {EDGES}, {OFFSET}, {GRAPH} SELECT src, dst, "
       "row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS nbr FROM graph")
def _adjacency(spark, sf):
    return g.adjacency_list(view_graph(spark, sf))


_RAW = f"WITH {VIEWS}, {COVIEW_SENTENCES}, {CUSTOMER_GRAPH}, oneway AS (SELECT src, dst FROM cgraph WHERE src < dst)"


@query("prune_disconnected", f"{_RAW} SELECT 'edge' AS kind, src, dst FROM oneway WHERE dst IN (SELECT src FROM oneway) "
       "UNION ALL SELECT 'label', c_custkey, CAST(c_nationkey AS BIGINT) FROM customer WHERE c_custkey IN (SELECT src FROM oneway)")
def _prune(spark, sf):
    edges, labels = g.prune_disconnected(g.edges_upper(customer_graph(spark, sf)), customer_classes(spark, sf))
    return edges.withColumn("kind", F.lit("edge")).unionByName(
        labels.select(F.col("id").alias("src"), F.col("cat").cast("bigint").alias("dst"), F.lit("label").alias("kind")))


@query("induced_subgraph", f"WITH {_CG}, keep AS (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) "
       "SELECT src, dst FROM cgraph WHERE src IN (FROM keep) AND dst IN (FROM keep)")
def _induced(spark, sf):
    keep = table(spark, sf, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("id"))
    return g.induced_subgraph(customer_graph(spark, sf), keep)


@query("single_label_vertices", f"WITH {CUSTOMER_LABELS} SELECT id FROM labelled GROUP BY id HAVING count(*) = 1")
def _single(spark, sf):
    return g.single_label_vertices(customer_labels(spark, sf))


_SUBSET = (f"GROUP BY id HAVING bool_or(label >= {FIRST_SEGMENT_LABEL}) AND NOT bool_or(label < {FIRST_SEGMENT_LABEL})")


@query("label_subset_vertices", f"WITH {CUSTOMER_LABELS} SELECT id FROM labelled {_SUBSET}")
def _subset(spark, sf):
    return g.label_subset_vertices(customer_labels(spark, sf), FIRST_SEGMENT_LABEL)


@query("sample_graph", f"""WITH {_CG}, {CUSTOMER_LABELS},
 chosen AS (SELECT id, min(label) AS label FROM labelled GROUP BY id HAVING count(*) = 1 AND min(label) >= {FIRST_SEGMENT_LABEL}),
 inner_edges AS (SELECT src, dst FROM cgraph WHERE src IN (SELECT id FROM chosen) AND dst IN (SELECT id FROM chosen))
 SELECT 'edge' AS kind, src, dst FROM inner_edges WHERE dst IN (SELECT src FROM inner_edges)
 UNION ALL SELECT 'label', id, CAST(label AS BIGINT) FROM chosen WHERE id IN (SELECT src FROM inner_edges)""")
def _sample(spark, sf):
    edges, labels = g.sample_graph(customer_graph(spark, sf), customer_labels(spark, sf), FIRST_SEGMENT_LABEL)
    return edges.withColumn("kind", F.lit("edge")).unionByName(
        labels.select(F.col("id").alias("src"), F.col("label").cast("bigint").alias("dst"), F.lit("label").alias("kind")))


@query("remove_sparse_features", f"WITH {VIEWS}, {EDGES}, good AS (SELECT dst, count(*) AS observations FROM edges GROUP BY dst "
       "HAVING count(*) >= 30) SELECT src, e.dst, observations FROM edges e JOIN good g ON e.dst = g.dst")
def _sparse(spark, sf):
    kept, good = g.remove_sparse_features(view_edges(spark, sf), 30)
    return kept.join(good, "dst")


@query("network_profile", f"WITH {_CG} SELECT c_nationkey AS cat, (SELECT CAST(max(c_nationkey) - min(c_nationkey) + 1 AS BIGINT) "
       "FROM customer) AS n_classes, (SELECT CAST(count(*) // 2 AS BIGINT) FROM cgraph) AS n_edges, "
       f"{rs('count(*) / (SELECT count(*) FROM customer)')} AS share FROM customer GROUP BY 1")
def _profile(spark, sf):
    out = g.network_profile(customer_graph(spark, sf), customer_classes(spark, sf))
    return out.withColumn("share", r("share"))


@query("label_distribution", f"WITH {CUSTOMER_LABELS} SELECT label, count(*) AS n FROM labelled GROUP BY label")
def _distribution(spark, sf):
    return g.label_distribution(customer_labels(spark, sf))


@query("vocab_size_graph", f"WITH {_CG}, {EDGES} SELECT 'views' AS graph, count(DISTINCT src) + count(DISTINCT dst) AS vocab_size "
       "FROM edges UNION ALL SELECT 'customers', count(DISTINCT src) FROM cgraph")
def _vocab_size(spark, sf):
    a = g.vocab_size_graph(view_edges(spark, sf), True).withColumn("graph", F.lit("views"))
    return a.unionByName(g.vocab_size_graph(customer_graph(spark, sf), False).withColumn("graph", F.lit("customers")))


_LEVELS = [("nation", "n_nationkey", "n_regionkey"), ("customer", "c_custkey", "c_nationkey"), ("orders", "o_orderkey", "o_custkey")]


@query("hierarchy_edges", "WITH down AS (" + " UNION ALL ".join(
    f"SELECT '{i}:' || {p} AS src, '{i + 1}:' || {c} AS dst, {i + 1} AS level FROM {t}" for i, (t, c, p) in enumerate(_LEVELS))
    + ") SELECT src, dst, level FROM down UNION ALL SELECT dst, src, level FROM down")
def _hierarchy(spark, sf):
    return g.hierarchy_edges([(table(spark, sf, t), child, parent) for t, child, parent in _LEVELS])


@query("hierarchy_counts", " UNION ALL ".join(
    f"SELECT {i} AS level, count(DISTINCT {k}) AS vertices, {'count(*)' if i else 'CAST(0 AS BIGINT)'} AS edges FROM {t}"
    for i, (t, k) in enumerate([("region", "r_regionkey")] + [(t, c) for t, c, _ in _LEVELS])))
def _hierarchy_counts(spark, sf):
    names = [("region", "r_regionkey")] + [(t, child) for t, child, _ in _LEVELS]
    tables = [(table(spark, sf, t), k) for t, k in names]
    return g.hierarchy_counts(tables, [None] + [t for t, _ in tables[1:]])
