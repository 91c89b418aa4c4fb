"""Features of edges for learning: functions from edges to edges with more columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithgraph.operators import matrix, similarity

#: The attributes of users and repositories that are used.
USER_KEYS = ("public_repos", "public_gists", "followers", "following", "hireable")
REPOSITORY_KEYS = ("fork", "open_issues_count", "has_wiki", "has_downloads", "forks_count", "has_issues", "stargazers_count", "size")


def constant(edges: DataFrame, value: float = 1.0) -> DataFrame:
    """One column of a constant, not standardised."""
    return edges.select("src", "dst", F.lit(float(value)).alias("constant"))


def number(c: Column) -> Column:
    """The value as a double; null, false and nothing count 0."""
    return F.coalesce(c.cast("double"), F.lit(0.0))


def node_attributes(edges: DataFrame, end: str, nodes: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Attributes of the node (``nodes`` has id) at one ``end`` of each edge, missing ones 0, standardised over the edges."""
    own = nodes.select(F.col("id").alias(end), *[number(F.col(k)).alias(k) for k in keys])
    joined = edges.select("src", "dst").join(own, end, "left").select("src", "dst", *[F.coalesce(k, F.lit(0.0)).alias(k) for k in keys])
    return matrix.standardised(joined, list(keys))


def edge_attributes(edges: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Attributes of the edge, missing ones 1, standardised; no keys, no columns."""
    return matrix.standardised(edges.select("src", "dst", *[F.coalesce(F.col(k).cast("double"), F.lit(1.0)).alias(k) for k in keys]), list(keys)) if keys else edges.select("src", "dst")


def language(edges: DataFrame, features: DataFrame, end: str = "dst") -> DataFrame:
    """The language vector of the repository at one end, in long form: src, dst, col, w; each language standardised over all edges, so an edge without it has the language's lowest value and isn't listed if that is its standard."""
    total = edges.count()
    each = edges.select("src", "dst").join(features.withColumnRenamed("row", end), end).select("src", "dst", "col", "w")
    sums = each.groupBy("col").agg((F.sum("w") / total).alias("m"), (F.sum(F.col("w") * F.col("w")) / total).alias("q"))
    scale = sums.select("col", "m", F.sqrt(F.greatest(F.col("q") - F.col("m") * F.col("m"), F.lit(0.0))).alias("s"))
    return each.join(scale, "col").select("src", "dst", "col", ((F.col("w") - F.col("m")) / F.when(F.col("s") > 0, F.col("s")).otherwise(1.0)).alias("w"))


def combined(edges: DataFrame, *blocks: DataFrame) -> DataFrame:
    """All blocks' columns beside each other; no block, no columns."""
    return reduce(lambda a, b: a.join(b, ["src", "dst"]), blocks, edges.select("src", "dst"))


def similarities(edges: DataFrame, source: DataFrame, target: DataFrame, root: int) -> DataFrame:
    """For each edge the similarity of a root (a source node) to its source end and to its target end, from both sides' normalised features, standardised over the edges."""
    own = F.broadcast(source.where(F.col("row") == root))
    if source.where(F.col("row") == root).isEmpty():
        raise ValueError("the root isn't in the graph")
    near = lambda side, name: matrix.dot(own, side).select(F.col("b").alias(name), F.col("sim").alias(f"sim_{name}"))
    both = edges.select("src", "dst").join(near(source, "src"), "src", "left").join(near(target, "dst"), "dst", "left")
    return matrix.standardised(both.select("src", "dst", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("sim_src", "sim_dst")]), ["sim_src", "sim_dst"])


bigraph_features = similarity.bigraph_features
