"""Graphs and evaluation reports as files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithgraph.operators.graph import CLASSES, Graph
from kithgraph.operators.ordering import numbered

_NODE = "struct<id:struct<type:string,id:bigint>>"
_DOCUMENT = f"directed boolean, multigraph boolean, nodes array<{_NODE}>, links array<struct<source:bigint,target:bigint>>"


def write_graph(g: Graph, path: str) -> None:
    """Write a graph as Parquet: nodes, edges and one row of what it is."""
    g.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    g.edges.write.mode("overwrite").parquet(f"{path}/edges")
    g.nodes.sparkSession.createDataFrame([(g.src_type, g.dst_type, g.directed)], "src_type string, dst_type string, directed boolean").write.mode("overwrite").parquet(f"{path}/kind")


def read_graph(spark: SparkSession, path: str) -> Graph:
    """Read what ``write_graph`` wrote."""
    kind = spark.read.parquet(f"{path}/kind").first()
    return Graph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"), kind.src_type, kind.dst_type, kind.directed)


def write_json_graph(g: Graph, path: str) -> None:
    """Write a graph as one node-link JSON document of one file, a node or link a line (an exchange format; Parquet is for large graphs). Links name nodes by position.

    One task writes the lines as they come from an external sort; none holds the graph. Reading the document does hold it.
    """
    nodes = numbered(g.nodes.select("type", "id"), "type", "id")
    ends = nodes.select(F.col("type").alias("__t"), F.col("id").alias("__i"), F.col("n").alias("__n"))
    find = lambda df, t, c, out: df.join(ends.where(F.col("__t") == t), F.col(c) == F.col("__i")).drop("__t", "__i").withColumnRenamed("__n", out)
    links = find(find(g.edges.select("src", "dst"), g.src_type, "src", "source"), g.dst_type, "dst", "target").select("source", "target")
    links = numbered(links, "source", "target")
    line = lambda part, c: F.struct(F.lit(part).alias("part"), F.col("n").alias("n"), F.concat(F.when(F.col("n") > 0, ",").otherwise(""), F.to_json(c)).alias("value"))
    spark = nodes.sparkSession
    frame = [(0, 0, f'{{"directed": {json.dumps(g.directed)}, "multigraph": false, "nodes": ['), (2, 0, '], "links": ['), (4, 0, "]}")]
    lines = nodes.select(line(1, F.struct(F.struct("type", "id").alias("id"))).alias("l")).unionAll(links.select(line(3, F.struct("source", "target")).alias("l"))).select("l.*")
    lines = lines.unionAll(spark.createDataFrame(frame, "part int, n bigint, value string"))
    lines.repartition(1).sortWithinPartitions("part", "n").select("value").write.mode("overwrite").text(path)


def read_json_graph(spark: SparkSession, path: str, src_type: str, dst_type: str) -> Graph:
    """Read a node-link JSON document: nodes of unknown classes are dropped with their links; links are those from ``src_type`` to ``dst_type``, or the other way in an undirected graph."""
    doc = spark.read.schema(_DOCUMENT).json(path, multiLine=True)
    nodes = doc.select(F.posexplode("nodes").alias("n", "x")).select("n", F.col("x.id.type").alias("type"), F.col("x.id.id").alias("id")).where(F.col("type").isin(*CLASSES))
    links = doc.select("directed", F.inline("links"))
    end = lambda name: nodes.select(F.col("n").alias(name), F.col("type").alias(f"{name}_type"), F.col("id").alias(f"{name}_id"))
    both = links.join(end("source"), "source").join(end("target"), "target")
    forward = both.where((F.col("source_type") == src_type) & (F.col("target_type") == dst_type)).select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
    back = both.where(~F.coalesce("directed", F.lit(False)) & (F.col("source_type") == dst_type) & (F.col("target_type") == src_type) & F.lit(src_type != dst_type))
    directed = bool((doc.select(F.coalesce("directed", F.lit(False))).first() or [False])[0])
    return Graph(nodes.select("type", "id"), forward.unionAll(back.select("target_id", "source_id")).distinct(), src_type, dst_type, directed)


def write_report(path: str, parameters: dict, recs: DataFrame, train: DataFrame, test: DataFrame, items: DataFrame) -> None:
    """Write an evaluation report: Parquet tables of recommendations, training, test and items, and its parameters as JSON text."""
    for name, df in (("recs", recs), ("train", train), ("test", test), ("items", items)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    recs.sparkSession.createDataFrame([(json.dumps(parameters, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/parameters")


def read_report(spark: SparkSession, path: str) -> dict:
    """What ``write_report`` wrote, all of it: parameters, recs, train, test, items."""
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in ("recs", "train", "test", "items")}
    return {"parameters": json.loads(spark.read.text(f"{path}/parameters").first()[0])} | tables


def write_json_report(path: str, recs: DataFrame, train: DataFrame, test: DataFrame) -> None:
    """One JSON line for each user: training, recommended in order, ground truth."""
    of = lambda df, name: df.groupBy("user").agg(F.sort_array(F.collect_set("item")).alias(name))
    listed = recs.groupBy("user").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "item"))), lambda x: x.item).alias("recommended"))
    of(train, "training").join(listed, "user", "left").join(of(test, "groundtruth"), "user", "left").write.mode("overwrite").json(path)
