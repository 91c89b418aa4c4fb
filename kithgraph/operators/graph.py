"""Property graphs as edge and node DataFrames."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Subclasses count as their class.
CLASSES = {"Account": ("Account", "User", "Organization"), "User": ("User",), "Organization": ("Organization",), "Repository": ("Repository",), "Language": ("Language",)}


@dataclass(frozen=True)
class Graph:
    """``edges`` (src, dst, attributes), ``nodes`` (type, id, attributes). Identity is type and id; an undirected edge is stored once, from ``src_type`` to ``dst_type``."""

    nodes: DataFrame
    edges: DataFrame
    src_type: str
    dst_type: str
    directed: bool = False


def edges(rows: DataFrame, src: Column, dst: Column, attributes: Mapping[str, Column] | None = None, rank: Column | None = None) -> DataFrame:
    """One row for each pair (src, dst): repeated pairs collapse, of each attribute the last value that isn't null counts; rows with a missing end are dropped."""
    picked = rows.select(src.alias("src"), dst.alias("dst"), *[c.alias(n) for n, c in (attributes or {}).items()], *([rank.alias("__rank")] if rank is not None else []))
    picked = picked.where(F.col("src").isNotNull() & F.col("dst").isNotNull())
    if not attributes:
        return picked.select("src", "dst").distinct()
    return picked.groupBy("src", "dst").agg(*[F.max_by(n, F.when(F.col(n).isNotNull(), F.col("__rank"))).alias(n) for n in attributes])


def graph(edge_rows: DataFrame, src_type: str, dst_type: str, directed: bool = False) -> Graph:
    """The graph of the edges; its nodes are the edges' ends."""
    ends = edge_rows.select(F.lit(src_type).alias("type"), F.col("src").alias("id")).unionAll(edge_rows.select(F.lit(dst_type), "dst"))
    return Graph(ends.distinct(), edge_rows, src_type, dst_type, directed)


def filter_edges(g: Graph, keep: Column) -> Graph:
    """The graph with only the edges where ``keep`` is true; all nodes stay."""
    return Graph(g.nodes, g.edges.where(keep), g.src_type, g.dst_type, g.directed)


def nodes_of(g: Graph, kind: str) -> DataFrame | None:
    """Nodes of a class or its subclasses; None for an unknown class."""
    return g.nodes.where(F.col("type").isin(*CLASSES[kind])) if kind in CLASSES else None


def with_attributes(g: Graph, kind: str, entities: DataFrame, key: str = "id") -> DataFrame:
    """Nodes of a class with the entities' columns. Of a column that nodes have already the entity's value counts, be it null; a node without entity keeps what it has, or nulls."""
    nodes, own = nodes_of(g, kind), entities.withColumnRenamed(key, "id").withColumn("__known", F.lit(True))
    both = nodes.alias("a").join(own.alias("b"), F.col("a.id") == F.col("b.id"), "left")
    new = [c for c in entities.columns if c != key]
    value = lambda c: F.when(F.col("b.__known"), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")) if c in nodes.columns else F.col(f"b.{c}")
    return both.select(F.col("a.id").alias("id"), *[F.col(f"a.{c}") for c in nodes.columns if c != "id" and c not in new], *[value(c).alias(c) for c in new])


def degrees(g: Graph, weight: Column | None = None) -> DataFrame:
    """``type``, ``id``, ``degree``: the sum of the weights of a node's edges (1 each without ``weight``; a null weight is 1), both directions; 0 for nodes without. A loop counts twice."""
    w = F.lit(1) if weight is None else F.coalesce(weight, F.lit(1))
    half = g.edges.select(F.lit(g.src_type).alias("type"), F.col("src").alias("id"), w.alias("w"))
    half = half.unionAll(g.edges.select(F.lit(g.dst_type), "dst", w))
    return g.nodes.select("type", "id").join(half.groupBy("type", "id").agg(F.sum("w").alias("w")), ["type", "id"], "left").select("type", "id", F.coalesce("w", F.lit(0)).cast("bigint").alias("degree"))


def degree_histogram(degree: DataFrame) -> DataFrame:
    """``degree`` and ``n`` nodes with it."""
    return degree.groupBy("degree").agg(F.count(F.lit(1)).alias("n"))


def out_degrees(edge_rows: DataFrame) -> DataFrame:
    """``id`` and number of edges that leave it."""
    return edge_rows.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("out_degree"))


def summary(g: Graph) -> DataFrame:
    """One row: kind of graph, nodes, edges, average degree (of a directed graph the average in- and out-degree, which are equal)."""
    counts = g.nodes.agg(F.count(F.lit(1)).alias("n_nodes")).crossJoin(g.edges.agg(F.count(F.lit(1)).alias("n_edges")))
    mean = F.try_divide(F.col("n_edges") * (1 if g.directed else 2), F.col("n_nodes"))
    return counts.select(F.lit("directed" if g.directed else "undirected").alias("kind"), "n_nodes", "n_edges", F.round(mean, 6).alias("average_degree"))


def typed(g: Graph) -> DataFrame:
    """Edges with the types of their ends."""
    return g.edges.select(F.lit(g.src_type).alias("src_type"), F.col("src"), F.lit(g.dst_type).alias("dst_type"), F.col("dst"))


def union(*graphs: Graph) -> DataFrame:
    """All graphs' typed edges, each once."""
    out = typed(graphs[0])
    for g in graphs[1:]:
        out = out.unionAll(typed(g))
    return out.distinct()


def both_ways(typed_edges: DataFrame) -> DataFrame:
    """Every edge in both directions, each once."""
    back = typed_edges.select(F.col("dst_type").alias("src_type"), F.col("dst").alias("src"), F.col("src_type").alias("dst_type"), F.col("src").alias("dst"))
    return typed_edges.unionAll(back).distinct()


def label(g: Graph) -> DataFrame:
    """Nodes with what a drawing needs: colour by class, and size ``degree`` scaled by log2 (2 where that is 0)."""
    colour = F.when(F.col("type") == "Repository", "red").when(F.col("type").isin(*CLASSES["Account"]), "green").otherwise("blue")
    size = F.log2(F.col("degree").cast("double"))
    return degrees(g).select("type", "id", "degree", colour.alias("colour"), F.round(F.when(size > 0, size).otherwise(2.0), 6).alias("size"))
