"""Global order without bringing all rows to one task, and ranks within groups."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kithgraph.session import cut


def numbered(df: DataFrame, *order: Column | str, name: str = "n") -> DataFrame:
    """``df`` in the given order with ``name`` counting from 0. Rows are sorted by range; only the number of rows of each range is gathered."""
    parts = cut(df.sort(*order).withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = dict(parts.groupBy("__part").count().collect())
    order_of = sorted(sizes)
    starts = list(zip(order_of, [0, *accumulate(sizes[i] for i in order_of)][: len(order_of)]))
    begun = df.sparkSession.createDataFrame(starts, "__part int, __start bigint")
    return parts.join(F.broadcast(begun), "__part").withColumn(name, F.col("__start") + F.col("__row")).drop("__part", "__row", "__start")


def best(df: DataFrame, group: str | list[str], order: list[Column], n: int | None, name: str = "rank") -> DataFrame:
    """The first ``n`` rows (None: all) of each group in the given order, with their ``name`` from 1. Spark drops later rows before the shuffle."""
    w = Window.partitionBy(*([group] if isinstance(group, str) else group)).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(w))
    return out if n is None else out.where(F.col(name) <= n)


def slices(values: Column, size: int) -> Column:
    """All runs of ``size`` neighbours of an array, in order; none if it is shorter. Null for null."""
    last = F.size(values) - size
    return F.when(values.isNull(), None).otherwise(F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.slice(values, i + 1, F.lit(size)))).otherwise(F.array().cast("array<array<bigint>>")))


def slide(df: DataFrame, key: str, order: str, value: str, size: int) -> DataFrame:
    """Sliding tuples of ``value`` in each group by ``order``: ``key``, ``order`` of the first, and v1…vsize; groups shorter than ``size`` give none."""
    w = Window.partitionBy(key).orderBy(order)
    ahead = [F.lead(value, i).over(w).alias(f"v{i + 1}") for i in range(size)]
    return df.select(key, order, *ahead, F.lead(order, size - 1).over(w).alias("__last")).where(F.col("__last").isNotNull()).drop("__last")


def split_edges(edges: DataFrame, ratio: float = 0.8, seed: int = 42, src: str = "src", dst: str = "dst") -> DataFrame:
    """``edges`` with ``is_train``: exactly floor(n·ratio) edges, the first by the hash of seed and ends, are for training. Same seed, same split; nodes aren't touched."""
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), F.col(src).cast("string"), F.lit(":"), F.col(dst).cast("string")))
    rows = numbered(edges.withColumn("__hash", hashed), "__hash", src, dst, name="__n")
    total = rows.count()
    return rows.withColumn("is_train", F.col("__n") < int(total * ratio)).drop("__hash", "__n")
