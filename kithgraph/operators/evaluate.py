"""Offline evaluation of recommendations against held-out edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def evaluable(train: DataFrame, test: DataFrame) -> DataFrame:
    """Users with both training and test edges: ``user``. Edges have user and item."""
    return train.select("user").distinct().join(test.select("user").distinct(), "user", "left_semi")


def frequencies(recs: DataFrame, train: DataFrame, test: DataFrame, items: DataFrame, cutoffs: list[int]) -> DataFrame:
    """``user``, ``k``, ``tp``, ``tn``, ``fp``, ``fn`` for each evaluable user and cutoff.

    Recommended within rank k is positive; the items of training are left out, all others are negative. Items of the ground truth outside the universe ``items`` don't count.
    """
    users = evaluable(train, test)
    truth = test.join(items.select("item"), "item", "left_semi").select("user", "item").distinct()
    n_items = items.select("item").distinct().count()
    spark = recs.sparkSession
    ks = F.broadcast(spark.createDataFrame([(k,) for k in cutoffs], "k int"))
    hits = recs.join(truth.withColumn("hit", F.lit(1)), ["user", "item"], "left").select("user", "rank", F.coalesce("hit", F.lit(0)).alias("hit"))
    flags = [F.count_if(F.col("rank") <= k).alias(f"p{k}") for k in cutoffs] + [F.coalesce(F.sum(F.when(F.col("rank") <= k, F.col("hit"))), F.lit(0)).alias(f"t{k}") for k in cutoffs]
    counted = hits.groupBy("user").agg(*flags)
    sizes = truth.groupBy("user").agg(F.count(F.lit(1)).alias("n_truth"))
    trained = train.join(items.select("item"), "item", "left_semi").select("user", "item").distinct().groupBy("user").agg(F.count(F.lit(1)).alias("n_train"))
    base = users.join(counted, "user", "left").join(sizes, "user", "left").join(trained, "user", "left").crossJoin(ks)
    pick = lambda x: F.coalesce(*[F.when(F.col("k") == k, F.col(f"{x}{k}")) for k in cutoffs], F.lit(0))
    tp, pos = pick("t"), pick("p")
    fn = F.coalesce("n_truth", F.lit(0)) - tp
    tn = F.lit(n_items) - F.coalesce("n_train", F.lit(0)) - pos - fn
    return base.select("user", "k", tp.cast("bigint").alias("tp"), tn.cast("bigint").alias("tn"), (pos - tp).cast("bigint").alias("fp"), fn.cast("bigint").alias("fn"))


def rates(freq: DataFrame) -> DataFrame:
    """``k``, ``precision``, ``recall``, ``fallout`` over all users' sums; null where there is nothing to divide by."""
    sums = freq.groupBy("k").agg(*[F.sum(c).alias(c) for c in ("tp", "tn", "fp", "fn")])
    return sums.select(
        "k",
        F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        F.try_divide(F.col("fp"), F.col("fp") + F.col("tn")).alias("fallout"),
    )


def average_precision(recs: DataFrame, train: DataFrame, test: DataFrame) -> DataFrame:
    """``user``, ``ap``: the sum of the precisions at the ranks of hits, divided by all of the user's ground truth; 0 without hits."""
    users = evaluable(train, test)
    truth = test.select("user", "item").distinct()
    hits = recs.join(truth.withColumn("hit", F.lit(1)), ["user", "item"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    running = F.sum("hit").over(Window.partitionBy("user").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    at_hits = hits.withColumn("p", running / F.col("rank")).where("hit = 1").groupBy("user").agg(F.sum("p").alias("p"))
    sizes = truth.groupBy("user").agg(F.count(F.lit(1)).alias("n"))
    return users.join(sizes, "user").join(at_hits, "user", "left").select("user", F.coalesce(F.col("p") / F.col("n"), F.lit(0.0)).alias("ap"))


def mean_average_precision(ap: DataFrame) -> DataFrame:
    """One row ``map``, null without users."""
    return ap.agg(F.avg("ap").alias("map"))


def roc_auc(rate: DataFrame) -> DataFrame:
    """One row ``auc``: trapezoids under (fallout, recall), with (0,0) and (1,1) added where no point lies at that fallout. One row a cutoff, so one task will do."""
    points = rate.select(F.col("fallout").alias("x"), F.col("recall").alias("y")).where("x is not null and y is not null")
    spark = rate.sparkSession
    has = points.agg(F.coalesce(F.max((F.col("x") == 0).cast("int")), F.lit(0)).alias("zero"), F.coalesce(F.max((F.col("x") == 1).cast("int")), F.lit(0)).alias("one"))
    ends = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0)], "x double, y double").crossJoin(has).where("(x = 0 and zero = 0) or (x = 1 and one = 0)").select("x", "y")
    w = Window.orderBy("x", "y")
    all_points = points.unionAll(ends)
    area = (F.col("x") - F.lag("x").over(w)) * (F.col("y") + F.lag("y").over(w)) / 2
    return all_points.select(area.alias("a")).agg(F.coalesce(F.sum("a"), F.lit(0.0)).alias("auc"))


def curves(rate: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Data of the plots: (recall, precision) sorted by recall; (fallout, recall) with (0,0) and (1,1) added, sorted by fallout."""
    spark = rate.sparkSession
    ends = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0)], "fallout double, recall double")
    return rate.select("recall", "precision").orderBy("recall"), rate.select("fallout", "recall").unionAll(ends).orderBy("fallout")
