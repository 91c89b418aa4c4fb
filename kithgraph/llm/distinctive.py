"""How characteristic each term is of its record, compared with the whole collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithgraph.functions.text import words
from kithgraph.operators.skew import lookup_join
from kithgraph.session import cut


def term_scores(records: DataFrame, key: str, text: str, k1: float | None = 1.2, b: float = 0.75, idf: str = "probabilistic", min_records: int = 1) -> DataFrame:
    """``key``, ``term``, ``tf``, ``n_records`` and ``score`` of each term of each record.

    Terms are the longest runs of letters or digits of the lower-cased text. Score = weight of the term · saturated tf:
    tf·(k1+1) / (tf + k1·(1 - b + b·length/average length); ``k1=None`` is the limit of no saturation, tf itself. The weight is
    ln(1 + (N - n + 0.5)/(n + 0.5)) for ``idf='probabilistic'`` and ln(N/n) for 'ratio', where N is the number of rows whose text
    isn't null and n the records with the term. Terms in fewer than ``min_records`` records are left out.

    A row is a record; ``key`` should be unique (rows of equal key and length are counted together). Null texts give nothing; empty texts
    and those without terms count in N and in the average. All counts are algebraic; a term in most records is joined to its count by broadcast, so it is no
    group in one task.
    """
    docs = records.where(F.col(text).isNotNull()).select(F.col(key).alias("__key"), words(F.col(text)).alias("__terms"))
    tf = cut(docs.select("__key", F.size("__terms").alias("__len"), F.explode("__terms").alias("term")).groupBy("__key", "__len", "term").agg(F.count(F.lit(1)).alias("tf")))
    n, average = docs.agg(F.count(F.lit(1)), F.avg(F.size("__terms"))).first()
    counts = tf.groupBy("term").agg(F.count(F.lit(1)).alias("n_records")).where(F.col("n_records") >= min_records)
    each = lookup_join(tf, counts, "term")
    weight = F.log(F.lit(float(n)) / F.col("n_records")) if idf == "ratio" else F.log(1 + (n - F.col("n_records") + 0.5) / (F.col("n_records") + 0.5))
    if k1 is None:
        saturated = F.col("tf").cast("double")
    else:
        saturated = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("__len") / F.lit(float(average or 1) or 1.0)))
    return each.select(F.col("__key").alias(key), "term", "tf", "n_records", (saturated * weight).alias("score"))


def top_term(scores: DataFrame, key: str, digits: int = 9) -> DataFrame:
    """Of each record the term with the highest score rounded to ``digits``; on ties the first in code point order."""
    best = F.min(F.struct((-F.round("score", digits)).alias("low"), F.col("term"))).alias("__best")
    return scores.groupBy(key).agg(best).select(key, F.col("__best.term").alias("term"), (-F.col("__best.low")).alias("score"))
