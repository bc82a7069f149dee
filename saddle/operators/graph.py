"""Edge tables ``(src, dst)``: building, pruning, sampling and counting."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saddle.skew import dealt, grouped_rank, lookup_join
from saddle.storage import materialise


def edges_bipartite(df: DataFrame, left: str, right: str) -> DataFrame:
    return df.select(F.col(left).alias("src"), F.col(right).alias("dst")).distinct()


def both_directions(edges: DataFrame) -> DataFrame:
    """Each edge and its reverse from a single scan."""
    ways = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return edges.select(F.explode(ways).alias("e")).select("e.src", "e.dst")


def edges_symmetrize(edges: DataFrame, dedup: bool = True) -> DataFrame:
    flipped = both_directions(edges)
    return flipped.distinct() if dedup else flipped


def edges_upper(edges: DataFrame) -> DataFrame:
    return edges.where("src < dst")


def edges_bipartite_offset(edges: DataFrame) -> DataFrame:
    """Shift the right-hand ids past the largest left-hand id."""
    highest = edges.select(F.max("src")).scalar()
    return edges.select("src", (F.col("dst") + highest + 1).alias("dst"))


def is_symmetric(edges: DataFrame) -> DataFrame:
    """One row: edges without their reverse, and whether there are none. One shuffle, no self-join."""
    pair = edges.where("src <> dst").groupBy(
        F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")
    ).agg(F.max(F.col("src") < F.col("dst")).alias("up"), F.max(F.col("src") > F.col("dst")).alias("down"))
    return pair.agg(F.count_if(~(F.col("up") & F.col("down"))).alias("one_way")).select(
        "one_way", (F.col("one_way") == 0).alias("symmetric")
    )


def degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))


def adjacency_list(edges: DataFrame) -> DataFrame:
    """Numbered neighbours ``(src, nbr, dst)``, ascending from 0.

    One row per neighbour rather than one array per vertex, so a hub of any degree fits.
    """
    return grouped_rank(edges, ["src"], [F.col("dst")], "nbr", 0)


def prune_disconnected(edges: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop vertices without an out-edge, once. An edge's source always has one."""
    keep = edges.select("src").distinct()
    kept_edges = lookup_join(edges, keep.withColumnRenamed("src", "dst"), "dst", "left_semi")
    return kept_edges, labels.join(keep.withColumnRenamed("src", "id"), "id", "left_semi")


def induced_subgraph(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges with both ends in ``vertices(id)``."""
    ends = vertices.select("id").distinct()
    # written, so that they are counted for their tasks without being made twice
    edges = materialise(edges)
    rows = edges.count()
    inner = lookup_join(dealt(edges, rows, "src"), ends.withColumnRenamed("id", "src"), "src", "left_semi")
    return lookup_join(dealt(inner, rows, "dst"), ends.withColumnRenamed("id", "dst"), "dst", "left_semi")


def single_label_vertices(labels: DataFrame) -> DataFrame:
    return labels.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("id")


def label_subset_vertices(labels: DataFrame, lowest: int) -> DataFrame:
    """Vertices with a label at or above ``lowest`` and none below it."""
    return (
        labels.groupBy("id")
        .agg(F.max(F.col("label") >= lowest).alias("wanted"), F.max(F.col("label") < lowest).alias("other"))
        .where("wanted and not other")
        .select("id")
    )


def sample_graph(edges: DataFrame, labels: DataFrame, lowest: int) -> tuple[DataFrame, DataFrame]:
    """Single-label vertices of the wanted labels, their subgraph, pruned once."""
    chosen = (
        labels.groupBy("id")
        .agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("label"))
        .where((F.col("n") == 1) & (F.col("label") >= lowest))
        .select("id", "label")
    )
    return prune_disconnected(induced_subgraph(edges, chosen), chosen)


def remove_sparse_features(edges: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """Edges into right-hand vertices seen at least ``threshold`` times, and those vertices."""
    good = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("observations")).where(
        F.col("observations") >= threshold
    )
    return lookup_join(edges, good.select("dst"), "dst", "left_semi"), good


def network_profile(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Per class: its share, beside the class range and the undirected edge count."""
    n_edges = edges.select((F.count(F.lit(1)) / 2).cast("bigint")).scalar()
    per_class = labels.groupBy("cat").agg(F.count(F.lit(1)).alias("n"))
    span = per_class.select((F.max("cat") - F.min("cat") + 1).cast("bigint")).scalar()
    everyone = labels.select(F.count(F.lit(1))).scalar()
    return per_class.select(
        "cat", span.alias("n_classes"), n_edges.alias("n_edges"), (F.col("n") / everyone).alias("share")
    )


def label_distribution(labels: DataFrame, label: str = "label") -> DataFrame:
    return labels.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def vocab_size_graph(edges: DataFrame, bipartite: bool) -> DataFrame:
    """Number of vertices; for a bipartite graph the two domains add up."""
    if bipartite:
        counted = edges.agg(F.countDistinct("src").alias("l"), F.countDistinct("dst").alias("r"))
        return counted.select((F.col("l") + F.col("r")).alias("vocab_size"))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("v"))
    return ends.agg(F.countDistinct("v").alias("vocab_size"))


def hierarchy_edges(levels: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """Parent-child edges of a hierarchy held in tables, both directions, with the child's level.

    ``levels`` lists ``(table, child column, parent column)`` from the top down; vertices are
    named ``level:id`` so the levels cannot collide.
    """
    parts = []
    for depth, (table, child, parent) in enumerate(levels, start=1):
        down = table.select(
            F.concat(F.lit(f"{depth - 1}:"), F.col(parent).cast("string")).alias("src"),
            F.concat(F.lit(f"{depth}:"), F.col(child).cast("string")).alias("dst"),
        )
        parts.append(both_directions(down).withColumn("level", F.lit(depth)))
    edges = parts[0]
    for part in parts[1:]:
        edges = edges.unionByName(part)
    return edges


def hierarchy_counts(tables: list[tuple[DataFrame, str]], linked: list[DataFrame | None]) -> DataFrame:
    """Vertices and edges per level; ``linked`` holds the rows that carry an edge upward."""
    parts = []
    for depth, ((table, key), up) in enumerate(zip(tables, linked)):
        row = table.agg(F.countDistinct(key).alias("vertices")).withColumn("level", F.lit(depth))
        edge = F.lit(0).cast("bigint") if up is None else up.select(F.count(F.lit(1))).scalar()
        parts.append(row.select("level", "vertices", edge.alias("edges")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
