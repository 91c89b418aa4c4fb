"""Features of nodes in long form: (row, col, w)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: English stop words.
STOP_WORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from "
    "further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other "
    "our ours ourselves out over own same she should so some such than that the their theirs them themselves then there these they this those through to too under until up very was "
    "we were what when where which while who whom why will with would you your yours yourself yourselves"
).split()
#: Words of two or more letters, digits or underscores.
TERM = r"[\p{L}\p{N}_]{2,}"


def language_features(latest: DataFrame) -> DataFrame:
    """Bytes of each language of each repository, as they are; no bytes, no entry. ``latest`` has repo_id, language, bytes."""
    return latest.where(F.col("bytes") > 0).select(F.col("repo_id").alias("row"), F.col("language").alias("col"), F.col("bytes").cast("double").alias("w"))


def term_counts(texts: DataFrame, key: str, text: str, vocabulary: int | None = None) -> DataFrame:
    """Counts of each text's words but stop words; with ``vocabulary`` only of the so many commonest in the corpus, ties by word."""
    words = F.filter(F.regexp_extract_all(F.lower(F.col(text)), F.lit(TERM), F.lit(0)), lambda t: ~t.isin(STOP_WORDS))
    counts = texts.select(F.col(key).alias("row"), F.explode(words).alias("col")).groupBy("row", "col").agg(F.count(F.lit(1)).cast("double").alias("w"))
    if vocabulary is None:
        return counts
    kept = counts.groupBy("col").agg(F.sum("w").alias("n")).orderBy(F.desc("n"), "col").limit(vocabulary).select("col")
    return counts.join(kept, "col", "left_semi")


def tfidf(counts: DataFrame, n_texts: int) -> DataFrame:
    """Counts times ln((1+n)/(1+texts with the word)) + 1, each text to length 1."""
    df = counts.groupBy("col").agg(F.count(F.lit(1)).alias("__df"))
    weighed = counts.join(df, "col").select("row", "col", (F.col("w") * (F.log((1.0 + n_texts) / (1.0 + F.col("__df"))) + 1)).alias("w"))
    norms = weighed.groupBy("row").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("__norm"))
    return weighed.join(norms, "row").select("row", "col", (F.col("w") / F.col("__norm")).alias("w"))


def neighbour_features(follow: DataFrame, users: DataFrame, direction: str) -> DataFrame:
    """Binary vectors of a user's followers ('follower') or followees ('followee'); ``follow`` has src (follower) and dst; ``users`` has row."""
    row, col = ("dst", "src") if direction == "follower" else ("src", "dst")
    pairs = follow.select(F.col(row).alias("row"), F.col(col).alias("col")).distinct()
    return pairs.join(users.select("row"), "row", "left_semi").withColumn("w", F.lit(1.0))
