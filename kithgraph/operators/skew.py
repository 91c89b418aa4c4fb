"""Joins and aggregates that hold when a few keys own most of the rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot if it owns more than one part in HOT_PARTS of the rows, so there are fewer hot keys than that, whatever the data.
HOT_PARTS = 500


def hot_keys(df: DataFrame, key: str, parts: int = HOT_PARTS) -> DataFrame:
    """The keys that own more than 1/``parts`` of the rows of ``df`` with a key: fewer than ``parts`` rows by construction."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n").alias("__total"))
    return counts.join(F.broadcast(total), F.col("__n") * parts > F.col("__total")).select(key)


def lookup_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", parts: int = HOT_PARTS) -> DataFrame:
    """Join ``left`` to ``right``, which has at most one row for a key, without sending a hot key's rows to one task.

    Rows with a hot key meet the hot keys' few right rows by broadcast (bounded by ``parts`` rows); the others are joined by
    an ordinary equi-join, whose largest group is below 1/``parts`` of the rows. ``how`` is inner or left. Null keys match
    nothing. The only column names in common must be ``key``.
    """
    hot = F.broadcast(hot_keys(left, key, parts))
    some = F.broadcast(right.join(hot, key, "left_semi"))
    cold = left.join(hot, key, "left_anti")
    warm = left.join(hot, key, "left_semi")
    return warm.join(some, key, how).unionByName(cold.join(right, key, how))


#: Rows of a key beyond which its rows are dealt to several tasks where each of them meets many others.
DEAL_ROWS = 100_000


def dealt_join(few: DataFrame, many: DataFrame, key: str, rows: int = DEAL_ROWS) -> DataFrame:
    """Inner join on ``key`` whose matches may be far more than the rows: a key with over ``rows`` rows in ``many`` is dealt to as many tasks as it needs, and its rows in ``few`` are sent to each of them.

    The table of such keys has at most one row for ``rows`` rows of ``many``. The only column name in common must be ``key``.
    """
    parts = many.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("__parts")).where("__parts > 1")
    number = F.coalesce("__parts", F.lit(1))
    rest = [c for c in many.columns if c != key]
    dealt = many.join(parts, key, "left").withColumn("__salt", F.pmod(F.xxhash64(*rest), number).cast("int")).drop("__parts")
    sent = few.join(parts, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), number - 1))).drop("__parts")
    return sent.join(dealt, [key, "__salt"]).drop("__salt")


#: Rows of a stated query set that are broadcast at once.
BLOCK_ROWS = 4_000


def in_blocks(asked: DataFrame, key: str, of: Callable[[DataFrame], DataFrame], rows: int = BLOCK_ROWS) -> DataFrame:
    """The union of ``of`` each block of a stated query set, of about ``rows`` rows dealt by the hash of ``key``, so that a block may be broadcast however large the set."""
    blocks = max(1, -(-asked.count() // rows))
    parts = [of(asked.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == i) if blocks > 1 else asked) for i in range(blocks)]
    return reduce(DataFrame.unionAll, parts)


#: Buckets of keys that are broadcast to leave out rows before a join.
BUCKETS = 1 << 18


def likely_in(df: DataFrame, keys: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    """The rows of ``df`` whose ``key`` shares a hash bucket with one of ``keys`` (which has ``key``): all that a join with it needs, and few others where keys are few.

    What is broadcast are the buckets, at most ``buckets`` numbers however many keys there are. Null keys are left out.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("__bucket")
    some = keys.where(F.col(key).isNotNull()).select(bucket).distinct()
    return df.where(F.col(key).isNotNull()).withColumn("__bucket", bucket).join(F.broadcast(some), "__bucket", "left_semi").drop("__bucket")


def distinct_others(df: DataFrame, keys: Sequence[str], other: str, n: str = "n") -> DataFrame:
    """For each key, the number of distinct values of ``other``; rows with a null key or other are left out.

    Both aggregates are algebraic and combine on the map side: a task keeps a bounded hash table (which spills) of the pairs
    it met and sends each once; the pairs are spread by key *and* other, so a key with a third of all rows is counted by all
    tasks; of the second aggregate only one partial count for each key and task is moved. The result has one row for each
    key, is empty for an empty table, and doesn't depend on repeated rows.
    """
    pairs = df.select(*keys, other).where(present(*(F.col(c) for c in (*keys, other))))
    return pairs.distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias(n))


def dominant(counts: DataFrame, group: str, n: str, parts: int) -> DataFrame:
    """Of ``counts`` (one row for each key in a group), the rows that own at least one part in ``parts`` of their group's ``n``.

    The groups must be few (such as the tables that were counted): their totals are broadcast.
    """
    totals = counts.groupBy(group).agg(F.sum(n).alias("__total"))
    return counts.join(F.broadcast(totals), group).where(F.col(n) * parts >= F.col("__total")).drop("__total")


def present(*columns: Column) -> Column:
    """True where none of the columns is null."""
    out = F.lit(True)
    for c in columns:
        out = out & c.isNotNull()
    return out
