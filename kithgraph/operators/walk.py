"""Personalised random walks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithgraph.operators import packed
from kithgraph.operators.skew import DEAL_ROWS, lookup_join
from kithgraph.session import cut

#: Values of a block of walks that a task does side by side, and edges into a node beyond which they are summed for themselves.
CELLS, HUB = 4_000_000, 64


@dataclass(frozen=True)
class Steps:
    """alpha: chance of going back to the seed; most steps; greatest change below which a walk stops."""

    alpha: float = 0.15
    most: int = 10
    epsilon: float = 0.01


class Ways:
    """Directed edges between ``n`` numbered nodes, which are put in the order of their edges in, most first, so that the k-th edges into the nodes are those of the first so many."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, n: int) -> None:
        into = np.bincount(dst, minlength=n)
        self.n, self.nodes = n, np.argsort(-into, kind="stable")
        self.at = np.empty(n, np.int64)
        self.at[self.nodes] = np.arange(n)
        src, dst, into = self.at[src], self.at[dst], into[self.nodes]
        out = np.bincount(src, minlength=n)
        self.share = 1.0 / np.maximum(out, 1)
        by = packed.Sparse(dst, src, None, (n, n))
        self.hubs = [by.row(i) for i in range(np.count_nonzero(into > HUB))]
        cold = len(self.hubs)
        self.layers = [by.idx[by.ptr[cold : cold + m] + k] for k in range(HUB) if (m := np.count_nonzero(into[cold:] > k))]

    @property
    def width(self) -> int:
        """Walks that are done side by side."""
        return max(1, min(16, CELLS // max(1, self.n)))

    def place(self, ids: pa.Array, of: pa.Array) -> np.ndarray:
        """Where nodes are, -1 for those that aren't there; ``ids`` are those of the numbered nodes."""
        at = pc.fill_null(pc.index_in(of, value_set=ids), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        return np.where(at >= 0, self.at[at], -1) if self.n else at

    def spread(self, x: np.ndarray) -> np.ndarray:
        """For each node the sum of ``x`` (a column for each walk) over the edges into it."""
        y = np.zeros_like(x)
        cold = len(self.hubs)
        for i, src in enumerate(self.hubs):
            y[i] = x.take(src, axis=0).sum(axis=0)
        for src in self.layers:
            y[cold : cold + len(src)] += x.take(src, axis=0)
        return y


def walks(ways: Ways, roots: np.ndarray, steps: Steps) -> Iterator[tuple[int, np.ndarray]]:
    """Walks from each of the ``roots`` (places): which it is and the value of each node, as they end. A root that isn't a node (-1) is the last value, alone."""
    live = np.arange(len(roots))
    x = np.zeros((ways.n + 1, len(roots)))
    x[roots, live] = 1.0
    share = np.append((1 - steps.alpha) * ways.share, 0.0)[:, None]
    for _ in range(steps.most):
        y = np.zeros_like(x)
        if ways.n:
            y[:-1] = ways.spread((x * share)[:-1])
        y[roots[live], np.arange(len(live))] += steps.alpha
        stop = np.abs(y - x).max(axis=0) < steps.epsilon
        for k in np.flatnonzero(stop):
            yield int(live[k]), np.ascontiguousarray(x[:, k])
        if stop.all():
            return
        x, live = y[:, ~stop] if stop.any() else y, live[~stop]
    for k, own in enumerate(live):
        yield int(own), np.ascontiguousarray(x[:, k])


def personal_rank(edges: DataFrame, seeds: DataFrame, alpha: float = 0.15, max_steps: int = 10, epsilon: float = 0.01, digits: int | None = None) -> DataFrame:
    """Personalised PageRank: ``seed``, ``node``, ``x`` for each of the stated ``seeds`` (seed); nodes not reached are 0 and absent.

    ``edges`` (src, dst) are directed and unweighted, ids of any type that tells nodes of different types apart. Each step spreads
    (1-alpha) of a node's mass evenly over its edges and gives alpha to the seed; a node without edges loses its mass. A seed whose greatest change is below
    ``epsilon`` stops with the values *before* that step, as the others do after ``max_steps``. Each step is one join on the node and one sum
    that combines on the map side; the edges of a node with over DEAL_ROWS are dealt to several tasks, each of which gets the seeds that are there; stopped seeds leave the loop.
    Where the edges are few enough to be sent to every task, and nodes are strings, each task walks from its seeds over all of them instead. ``digits``: to which values are rounded.
    """
    if all(kind == "string" for _, kind in edges.select("src", "dst").dtypes + seeds.select("seed").dtypes) and packed.few(edges := cut(edges), seeds):
        return _packed(edges, seeds, Steps(alpha, max_steps, epsilon), digits)
    found = _joined(edges, seeds, alpha, max_steps, epsilon)
    return found if digits is None else found.withColumn("x", F.round("x", digits))


def _packed(edges: DataFrame, seeds: DataFrame, steps: Steps, digits: int | None) -> DataFrame:
    nodes, (src, dst) = packed.coded(*packed.gathered(edges, "src", "dst"))
    ways = Ways(src, dst, len(nodes))
    sent = seeds.sparkSession.sparkContext.broadcast((nodes, nodes.take(pa.array(ways.nodes)), ways))

    def of(asked: pa.Array) -> Iterator[tuple]:
        nodes, placed, ways = sent.value
        for k, x in walks(ways, ways.place(nodes, asked), steps):
            at = np.flatnonzero(x)
            names = placed.take(pa.array(at[at < ways.n]))
            if len(names) < len(at):  # the seed alone
                names = pa.concat_arrays([names, asked.slice(k, 1)])
            yield pa.array([asked[k].as_py()], pa.string()).take(pa.array(np.zeros(len(at), np.int64))), names, x[at] if digits is None else packed.rounded(x[at], digits) / 10.0**digits

    return packed.each(seeds, "seed", of, "seed string, node string, x double", ways.width)


def _joined(edges: DataFrame, seeds: DataFrame, alpha: float, max_steps: int, epsilon: float) -> DataFrame:
    share = edges.groupBy("src").agg(F.count(F.lit(1)).alias("__deg"))
    parts = F.ceil(F.col("__deg") / DEAL_ROWS).cast("int")
    degrees = share.select("src", (1.0 / F.col("__deg")).alias("__p"), parts.alias("__parts"))
    links = lookup_join(edges, cut(degrees), "src")
    links = cut(links.select(F.col("src").alias("node"), "dst", "__p", F.pmod(F.xxhash64("dst"), F.col("__parts")).cast("int").alias("__part")))
    hot = cut(degrees.where("__parts > 1").select(F.col("src").alias("node"), "__parts"))
    any_hot = not hot.isEmpty()
    live = seeds.select("seed", F.col("seed").alias("node"), F.lit(1.0).alias("x"))
    done = None
    for _ in range(max_steps):
        sent = live.withColumn("__part", F.lit(0))
        if any_hot:
            sent = live.join(hot, "node", "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1)))
        spread = sent.join(links, ["node", "__part"]).groupBy("seed", F.col("dst").alias("node")).agg(((1 - alpha) * F.sum(F.col("x") * F.col("__p"))).alias("y"), F.lit(0.0).alias("x"))
        back = live.select("seed").distinct().select("seed", F.col("seed").alias("node"), F.lit(float(alpha)).alias("y"), F.lit(0.0).alias("x"))
        old = live.select("seed", "node", F.lit(0.0).alias("y"), "x")
        step = cut(spread.unionAll(back).unionAll(old).groupBy("seed", "node").agg(F.sum("x").alias("x"), F.sum("y").alias("y")))
        still = cut(step.groupBy("seed").agg((F.max(F.abs(F.col("y") - F.col("x"))) < epsilon).alias("stop")))
        ended = step.join(still.where("stop"), "seed", "left_semi").where(F.col("x") != 0).select("seed", "node", "x")
        done = ended if done is None else done.unionAll(ended)
        live = step.join(still.where("not stop"), "seed", "left_semi").where(F.col("y") != 0).select("seed", "node", F.col("y").alias("x"))
        if still.where("not stop").isEmpty():
            return done
    return live if done is None else done.unionAll(live)
