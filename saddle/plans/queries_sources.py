"""Sources and sinks: each query writes the given tables and reads them back."""
from __future__ import annotations

from pyspark.sql import functions as F

from saddle.operators.sentences import random_walks, session_sentences, sessionize
from saddle.operators.vectors import embedding_align
from saddle.plans.registry import query, r, rs, vec_rows, vec_rows_sql
from saddle.plans.tables import (
    EDGES, GRAPH, OFFSET, PRODUCT_VOCAB, VIEWS, product_vocab, scratch, table, vectors, vectors_sql, view_edges,
    view_graph, views,
)
from saddle.plans.walks_sql import walks_sql
from saddle.sources import text


@query("read_interactions", f"WITH {VIEWS} SELECT customer_id, product_id, "
       "CAST(epoch(date_viewed) AS BIGINT) AS viewed_at FROM views")
def _read_interactions(spark, sf):
    path = scratch(spark, "views")
    text.write_interactions(views(spark, sf), path, sep="|")
    back = text.read_interactions(spark, path, sep="|")
    return back.select("customer_id", "product_id", F.unix_seconds("date_viewed").alias("viewed_at"))


@query("read_edge_list", f"WITH {VIEWS}, {EDGES} SELECT src, dst FROM edges")
def _read_edge_list(spark, sf):
    path = scratch(spark, "edges")
    text.write_edge_list(view_edges(spark, sf), path, sep=",")
    return text.read_edge_list(spark, path, sep=",")


@query("write_edge_list", f"WITH {VIEWS}, {EDGES}, {OFFSET}, {GRAPH} SELECT src, dst FROM graph")
def _write_edge_list(spark, sf):
    path = scratch(spark, "edges")
    text.write_edge_list(view_graph(spark, sf), path)
    return text.read_edge_list(spark, path)


_WALKS = walks_sql(f"{VIEWS}, {EDGES}, {OFFSET}, {GRAPH}", 1, 5)


@query("read_walks", f"{_WALKS} SELECT array_to_string(path, '>') AS walk, len(path) AS steps FROM walks")
def _read_walks(spark, sf):
    path = scratch(spark, "walks")
    text.write_walks(random_walks(view_graph(spark, sf), 1, 5), path, sep=" ")
    back = text.read_walks(spark, path)
    return back.select(F.array_join(F.col("path").cast("array<string>"), ">").alias("walk"),
                       F.size("path").cast("bigint").alias("steps"))


@query("write_walks", f"{_WALKS} SELECT path[1] AS first_vertex, path[5] AS last_vertex, count(*) AS n "
       "FROM walks GROUP BY 1, 2")
def _write_walks(spark, sf):
    path = scratch(spark, "walks")
    text.write_walks(random_walks(view_graph(spark, sf), 1, 5), path)
    back = text.read_walks(spark, path)
    return back.groupBy(F.col("path")[0].alias("first_vertex"), F.col("path")[4].alias("last_vertex")).agg(
        F.count(F.lit(1)).alias("n"))


@query("write_sentences", """WITH gaps AS (SELECT user_id, ts, event_id, event_type,
   CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 43200000000 THEN 1 ELSE 0 END AS opens
   FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 sess AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM gaps)
 SELECT sentence, count(*) AS n FROM (
   SELECT string_agg(event_type, ' ' ORDER BY ts, event_id) AS sentence FROM sess GROUP BY user_id, s HAVING count(*) > 1)
 GROUP BY sentence""")
def _write_sentences(spark, sf):
    """Sessions written as lines, read back, put together again and counted by their text."""
    path = scratch(spark, "sentences")
    sessions = sessionize(table(spark, sf, "events"), "user_id", "ts", "event_id", 12 * 3600.0)
    text.write_sentences(session_sentences(sessions, "user_id", "ts", "event_id", "event_type"), path)
    back = text.read_sentences(spark, path).groupBy("sentence_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("s"))
    # a session of nulls only has no text
    sentences = back.select(F.nullif(F.array_join("s.token", " "), F.lit("")).alias("sentence"))
    return sentences.groupBy("sentence").agg(F.count(F.lit(1)).alias("n"))


@query("read_embedding_text", f"WITH {vectors_sql()} {vec_rows_sql('vecs', ['id'], 'v')}")
def _read_embedding_text(spark, sf):
    path = scratch(spark, "emb")
    text.write_embedding_text(vectors(spark, sf), path, header=False, sep="  ")
    return vec_rows(text.read_embedding_text(spark, path), ["id"], "v")


@query("write_embedding_text", f"WITH {vectors_sql()} SELECT id, len(v) AS width, {rs('list_sum(v)')} AS total FROM vecs")
def _write_embedding_text(spark, sf):
    path = scratch(spark, "emb")
    text.write_embedding_text(vectors(spark, sf), path)
    back = text.read_embedding_text(spark, path)
    return back.select("id", F.size("v").cast("bigint").alias("width"),
                       r(F.aggregate("v", F.lit(0.0), lambda a, b: a + b)).alias("total"))


@query("embedding_align", f"WITH {vectors_sql()}, aligned AS (SELECT c_custkey AS id, label, CASE WHEN v IS NULL THEN [NULL::DOUBLE] ELSE v END AS v "
       f"FROM customer LEFT JOIN vecs ON c_custkey = id) {vec_rows_sql('aligned', ['id', 'label'], 'v')}")
def _embedding_align(spark, sf):
    targets = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    aligned = embedding_align(targets, vectors(spark, sf))
    return vec_rows(aligned.withColumn("v", F.coalesce("v", F.array(F.lit(None).cast("double")))), ["id", "label"], "v")


@query("write_vocab", f"WITH {VIEWS}, {PRODUCT_VOCAB} SELECT token, freq, idx FROM vocab")
def _write_vocab(spark, sf):
    path = scratch(spark, "vocab")
    text.write_vocab(product_vocab(spark, sf), path)
    return spark.read.schema("token bigint, freq bigint, idx bigint").parquet(path)


@query("write_results", "SELECT o_orderpriority AS model, CAST(year(o_orderdate) AS INTEGER) AS fold, "
       f"{rs('avg(o_totalprice)', 4)} AS macro, {rs('min(o_totalprice)', 4)} AS micro, 'run-1' AS run_ts "
       "FROM orders GROUP BY 1, 2")
def _write_results(spark, sf):
    path = scratch(spark, "results")
    o = table(spark, sf, "orders")
    scores = o.groupBy(F.col("o_orderpriority").alias("model"), F.year("o_orderdate").alias("fold")).agg(
        r(F.avg("o_totalprice"), 4).alias("macro"), r(F.min("o_totalprice"), 4).alias("micro"))
    text.write_results(scores, path, "run-1")
    return spark.read.schema("model string, fold int, macro double, micro double, run_ts string").parquet(path)

