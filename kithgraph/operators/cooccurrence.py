"""Languages that occur together, counted by line of the file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def language_totals(rows: DataFrame, languages: str = "languages") -> DataFrame:
    """For each language ``size``, the sum of its bytes, and ``occurrence``, the lines that list it; a repository listed twice counts twice."""
    each = rows.select(F.explode(languages).alias("language", "bytes"))
    return each.groupBy("language").agg(F.coalesce(F.sum("bytes"), F.lit(0)).cast("bigint").alias("size"), F.count(F.lit(1)).alias("occurrence"))


def language_pairs(rows: DataFrame, line: str, languages: str = "languages") -> DataFrame:
    """``a`` < ``b`` and ``weight``, the lines that list both. Lines of the same languages are put together first, so a common list costs once."""
    lists = rows.select(F.array_sort(F.map_keys(languages)).alias("names")).where(F.size("names") > 1).groupBy("names").agg(F.count(F.lit(1)).alias("n"))
    first = lists.select("names", "n", F.posexplode("names").alias("i", "a"))
    pairs = first.select("a", F.explode(F.slice("names", F.col("i") + 2, F.size("names"))).alias("b"), "n")
    return pairs.groupBy("a", "b").agg(F.sum("n").alias("weight"))


def top_languages(totals: DataFrame, pairs: DataFrame, n: int, by: str = "size") -> DataFrame:
    """The ``n`` languages of greatest size or occurrence with their weight to the first of them (0 if they never meet), in that order; ties by name."""
    top = totals.orderBy(F.desc(by), "language").limit(n)
    first = top.orderBy(F.desc(by), "language").limit(1).select(F.col("language").alias("first"))
    weights = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), "weight").unionAll(pairs.select("b", "a", "weight"))
    linked = top.crossJoin(F.broadcast(first)).join(weights, (F.col("first") == F.col("x")) & (F.col("language") == F.col("y")), "left")
    return linked.select("language", "size", "occurrence", F.coalesce("weight", F.lit(0)).cast("bigint").alias("weight_to_first"))


def language_matrix(pairs: DataFrame, top: DataFrame) -> DataFrame:
    """The pairs among ``top`` in both directions: ``a``, ``b``, ``weight``."""
    both = pairs.unionAll(pairs.select("b", "a", "weight"))
    names = top.select("language")
    return both.join(names.withColumnRenamed("language", "a"), "a", "left_semi").join(names.withColumnRenamed("language", "b"), "b", "left_semi").select("a", "b", "weight")
