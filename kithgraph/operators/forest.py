"""Parent-child links to hierarchies: roots, depths, circles, paths and descendants."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithgraph.operators.skew import lookup_join
from kithgraph.session import cut, tasks

#: Most links that one task takes up at a level of the merge (about 100 bytes each while it runs).
TASK_LINKS = 1_000_000

_LINKS = "node bigint, up bigint, dist bigint, low bigint"
_FOUND = f"{_LINKS}, state int"
#: Fixed values of ``state``: the walk goes on outside this task or has ended; it goes round in a circle, whose least id is ``up``.
OPEN, CIRCLE = 0, 1


def jump(node: np.ndarray, up: np.ndarray, dist: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Weighted disjoint sets of one task's links, all paths compressed at once.

    ``node`` is sorted and unique; node[i] lies ``dist[i]`` steps below up[i], and ``low[i]`` is the least id on that stretch, up[i] excluded. Returns for each node the last id reached
    through these links, the steps to it, the least id on the way, and its state; for a walk into a circle, the circle's least id.
    """
    n = len(node)
    if not n:
        return up, dist, low, np.zeros(0, np.int32)
    at = np.searchsorted(node, up)
    at[at == n] = 0
    first = nxt = np.where(node[at] == up, at, -1)
    root, weight, least = up.copy(), dist.copy(), low.copy()
    for _ in range(int(n).bit_length() + 1):
        inner = nxt >= 0
        if not inner.any():
            break
        to = nxt[inner]
        step, seen, ahead = weight[to], least[to], nxt[to]
        root[inner] = root[to]
        weight[inner] += step
        least[inner] = np.minimum(least[inner], seen)
        nxt = nxt.copy()
        nxt[inner] = ahead
    caught = nxt >= 0
    if caught.any():
        circle = np.unique(nxt[caught])  # after so many steps a walk stands on its circle, and every place of it is stood on
        place = np.searchsorted(circle, first[circle])
        lowest = low[circle].copy()
        for _ in range(int(len(circle)).bit_length() + 1):
            lowest, place = np.minimum(lowest, lowest[place]), place[place]
        root[caught] = least[caught] = lowest[np.searchsorted(circle, nxt[caught])]
        weight[caught] = -1
    return root, weight, least, np.where(caught, CIRCLE, OPEN).astype(np.int32)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's links to what each node leads to."""
    own = list(batches)
    columns = [pa.chunked_array([b.column(i) for b in own], pa.int64()).to_numpy() for i in range(4)]
    order = np.argsort(columns[0], kind="stable")
    node, up, dist, low = (c[order] for c in columns)
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node, *jump(node, up, dist, low))], ["node", "up", "dist", "low", "state"])


def resolve(links: DataFrame, node: str = "node", parent: str = "parent", task_links: int = TASK_LINKS) -> DataFrame:
    """For each node with a parent: ``node``, ``root``, ``depth`` and ``parent``; a walk into a circle has depth -1 and the circle's least id as root.

    A node has one parent; of several the least is taken. Rows with a null are left out, repeated rows don't matter, other
    columns are ignored, an empty table gives an empty result. A node that is its own parent is a circle of one.

    Nodes without children only hang below the rest, so the rest alone is merged: its links are spread over tasks, each of
    which joins its own in a weighted disjoint-set forest (offset to the root); links that lead out of a task are joined to
    what that other task found, and so on upwards, with fewer tasks at each level, until what is still open fits in one.
    Each level at least doubles the distance covered, so there are at most log2(nodes) levels; links whose walk is over
    leave it. Childless nodes then look up their parent.
    """
    spark = links.sparkSession
    clean = links.select(F.col(node).cast("bigint").alias("node"), F.col(parent).cast("bigint").alias("parent")).dropna()
    clean = cut(clean.groupBy("node").agg(F.min("parent").alias("parent")))
    parents = clean.select(F.col("parent").alias("node")).distinct()
    inner = cut(clean.join(parents, "node", "left_semi"))
    solved = _solve(inner, task_links).select("node", F.col("up").alias("root"), F.when(F.col("state") == CIRCLE, -1).otherwise(F.col("dist")).cast("bigint").alias("depth"))
    up = solved.select(F.col("node").alias("parent"), F.col("root").alias("__root"), F.col("depth").alias("__depth"))
    leaves = lookup_join(clean.join(parents, "node", "left_anti"), up, "parent", "left").select(
        "node",
        F.coalesce("__root", "parent").alias("root"),
        F.when(F.col("__depth") == -1, F.lit(-1)).otherwise(F.coalesce("__depth", F.lit(0)) + 1).cast("bigint").alias("depth"),
        "parent",
    )
    return solved.join(inner, "node").select("node", "root", "depth", "parent").unionByName(leaves)


def _solve(inner: DataFrame, task_links: int) -> DataFrame:
    """``node``, ``up`` (root or least id of the circle), ``dist``, ``state`` of each of ``inner``'s nodes. ``solved`` are those whose walk is over; they still answer for others."""
    links = inner.select("node", F.col("parent").alias("up"), F.lit(1).cast("bigint").alias("dist"), F.col("node").alias("low"))
    total = links.count()
    if total <= task_links:
        return cut(links.repartition(1).mapInArrow(_merge, _FOUND).drop("low"))
    solved = links.where("false").withColumn("state", F.lit(OPEN))
    live, n, reach = links, total, 1
    while n > task_links and reach < 2 * total:
        asked = live.select(F.col("up").alias("node")).distinct()
        known = live.unionByName(_ends(solved)).join(asked, "node", "left_semi")
        found = known.repartition(tasks(inner.sparkSession, n, task_links), "node").mapInArrow(_merge, _FOUND)
        answers = found.select(F.col("node").alias("up"), *[F.col(c).alias(f"__{c}") for c in ("up", "dist", "low", "state")])
        step = cut(lookup_join(live, answers, "up", "left"))
        ended = step.where(F.col("__up").isNull()).select("node", "up", "dist", "low", F.lit(OPEN).alias("state"))
        round_trip = step.where(F.col("__state") == CIRCLE).select("node", F.col("__up").alias("up"), F.lit(-1).cast("bigint").alias("dist"), F.col("__up").alias("low"), F.lit(CIRCLE).alias("state"))
        onward = step.where(F.col("__state") == OPEN).select("node", F.col("__up").alias("up"), (F.col("dist") + F.col("__dist")).alias("dist"), F.least("low", "__low").alias("low"))
        solved, live = cut(solved.unionByName(ended).unionByName(round_trip)), cut(onward)
        n, reach = live.count(), 2 * reach
    if n > task_links:
        return cut(solved.drop("low").unionByName(_circles(live, solved)))
    if n:
        asked = live.select(F.col("up").alias("node")).distinct()
        helpers = _ends(solved).join(asked, "node", "left_semi")
        last = live.unionByName(helpers).repartition(1).mapInArrow(_merge, _FOUND)
        solved = solved.unionByName(last.join(live.select("node"), "node", "left_semi"))
    return cut(solved.drop("low"))


def _ends(solved: DataFrame) -> DataFrame:
    """Solved nodes as links. One that goes round stands for its circle, as a link to itself, since the circle's least id needn't be among the links it is merged with."""
    return solved.select("node", F.when(F.col("state") == CIRCLE, F.col("node")).otherwise(F.col("up")).alias("up"), "dist", "low")


def _circles(live: DataFrame, solved: DataFrame) -> DataFrame:
    """Walks of more steps than there are nodes stand on a circle, at a place whose own walk is as long or known to go round: the least id on that is the circle's."""
    places = live.select(F.col("node").alias("up"), F.col("low").alias("__low")).unionByName(solved.where(F.col("state") == CIRCLE).select(F.col("node").alias("up"), F.col("low").alias("__low")))
    return lookup_join(live, places, "up").select("node", F.col("__low").alias("up"), F.lit(-1).cast("bigint").alias("dist"), F.lit(CIRCLE).alias("state"))


def paths(forest: DataFrame) -> DataFrame:
    """``resolve``'s result with ``path``: the ids from the root down to the node, null for walks into a circle.

    Paths double in each round, so a chain of d nodes takes log2(d) joins; nodes without children take part only at the end.
    """
    forest = cut(forest)
    tree = forest.where(F.col("depth") > 0)
    parents = tree.select(F.col("parent").alias("node")).distinct()
    known = tree.join(parents, "node", "left_semi").select("node", F.array("node").alias("path"), F.col("parent").alias("ahead"))
    deepest = tree.agg(F.max("depth")).first()[0] or 0
    for _ in range(deepest.bit_length()):
        known = cut(known)
        above = known.select(F.col("node").alias("ahead"), F.col("path").alias("__path"), F.col("ahead").alias("__ahead"))
        known = lookup_join(known, above, "ahead", "left").select(
            "node",
            F.when(F.col("ahead").isNull(), F.col("path")).otherwise(F.concat(F.coalesce("__path", F.array("ahead")), "path")).alias("path"),
            F.when(F.col("__path").isNotNull(), F.col("__ahead")).alias("ahead"),
        )
    up = cut(known).select(F.col("node").alias("parent"), F.col("path").alias("__path"))
    below = lookup_join(tree, up, "parent", "left").withColumn("path", F.concat(F.coalesce("__path", F.array("parent")), F.array("node"))).drop("__path")
    return below.unionByName(forest.where(F.col("depth") < 0).withColumn("path", F.lit(None).cast("array<bigint>")))


def descendants(pathed: DataFrame) -> DataFrame:
    """Every (ancestor, node, distance) of ``paths``'s result: all nodes below each node, and how far below."""
    each = pathed.where(F.col("path").isNotNull()).select("node", "depth", F.posexplode("path").alias("pos", "ancestor"))
    return each.where(F.col("pos") < F.col("depth")).select("ancestor", "node", (F.col("depth") - F.col("pos")).alias("distance"))
