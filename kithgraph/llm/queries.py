"""Queries of the training-data operators by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithgraph.functions.text import trimmed
from kithgraph.llm import canonical, cooccur, distinctive, leaks, mojibake, survivors, tokens
from kithgraph.llm.sql import SQL  # noqa: F401
from kithgraph.operators.current import current_values
from kithgraph.sources.tables import table


def _language_sets(spark: SparkSession, d: str) -> DataFrame:
    """The languages of each repository, from its row with the greatest line."""
    named = F.transform(F.filter(F.map_entries("languages"), lambda e: e.value > 0), lambda e: F.lower(trimmed(e.key)))
    rows = table(spark, d, "languages").where(F.col("repo.id").isNotNull())
    rows = rows.select(F.col("repo.id").alias("repo_id"), F.struct("line_no", F.array_sort(F.array_distinct(F.filter(named, lambda x: x != ""))).alias("items")).alias("row"))
    return rows.groupBy("repo_id").agg(F.max("row").alias("row")).select("repo_id", F.col("row.items").alias("items"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of languages in at least 5 and a two-hundredth of the repositories, at least twice as often as by chance."""
    pairs = cooccur.pair_counts(_language_sets(spark, d), "items", least=5, part=200)
    return cooccur.above_chance(pairs, 2).select(F.col("item_a").alias("language_a"), F.col("item_b").alias("language_b"))


def p1_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of languages with their counts, lift and odds ratio."""
    pairs = cooccur.pair_counts(_language_sets(spark, d), "items")
    return pairs.withColumns({c: F.round(c, 6) for c in ("lift", "odds_ratio")})


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The entries of the reference lists that locations and companies mean."""
    rows = table(spark, d, "account")
    places = canonical.match(rows, "line_no", "location", table(spark, d, "ref_place"), "place_id", "name", qualifiers=("country", "country_code"))
    firms = canonical.match(rows, "line_no", "company", table(spark, d, "ref_company"), "company_id", "name", alias="abbrev")
    return places.select("line_no", F.lit("location").alias("field"), "ref_id").unionAll(firms.select("line_no", F.lit("company").alias("field"), "ref_id"))


def _descriptions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "repository")
    now = current_values(rows, F.col("id"), {"description": F.col("description")}, F.col("updated_at"), F.col("item") == "Repository", F.col("line_no"))
    return now.where(F.col("description").isNotNull()).select(F.col("id").alias("repo_id"), "description")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The term of each description with the highest tf · ln(N/n), of the terms that two records share."""
    scores = distinctive.term_scores(_descriptions(spark, d), "repo_id", "description", k1=None, b=0.0, idf="ratio", min_records=2)
    return distinctive.top_term(scores, "repo_id").select("repo_id", "term")


def p6_bm25(spark: SparkSession, d: str) -> DataFrame:
    """Every term of every description with saturated frequency, length normalisation and probabilistic weight."""
    scores = distinctive.term_scores(_descriptions(spark, d), "repo_id", "description")
    return scores.select("repo_id", "term", "tf", "n_records", F.round("score", 6).alias("score"))


#: The fields that are filled.
FIELDS = {"account": ("name", "company", "blog", "location", "email"), "repository": ("description", "homepage", "language", "default_branch")}
_FULL = {"account": "Account", "repository": "Repository"}


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """For each id with several rows, the line that gives each field."""
    out = None
    for entity, fields in FIELDS.items():
        rows = table(spark, d, entity)
        best = survivors.surviving_lines(rows, F.col("id"), {f: F.col(f) for f in fields}, F.col("updated_at"), F.col("item") == _FULL[entity], F.col("line_no"))
        best = best.select(F.lit(entity).alias("entity"), "id", "field", "line_no")
        out = best if out is None else out.unionAll(best)
    return out


def p7_fused(spark: SparkSession, d: str) -> DataFrame:
    """The most probable value of each field of each entity; a source is the kind of item and the month of its crawl."""
    out = None
    for entity, fields in FIELDS.items():
        claims = table(spark, d, entity).select(
            "id",
            F.concat_ws("/", "item", F.date_format("crawled_at", "yyyy-MM")).alias("source"),
            F.struct(F.coalesce("updated_at", F.lit("0001-01-01").cast("timestamp_ntz")).alias("u"), F.col("line_no").alias("l")).alias("at"),
            F.inline(F.array(*[F.struct(F.lit(f).alias("field"), trimmed(F.col(f)).alias("value")) for f in fields])),
        )
        best = survivors.fuse(claims).select(F.lit(entity).alias("entity"), "id", "field", "value", "probability")
        out = best if out is None else out.unionAll(best)
    return out


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encode(table(spark, d, "documents"), "doc_id", "text")


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Every document's text from its token ids."""
    return tokens.decode(p8_ids(spark, d), "ids").select("doc_id", "text")


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "eval_id", "passage", "answer")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold 13 consecutive words of an item's passage."""
    return _leaks(spark, d).select("doc_id", F.col("item_id").alias("eval_id")).distinct()


def p9_spans(spark: SparkSession, d: str) -> DataFrame:
    """Where in the document the item's words stand."""
    return _leaks(spark, d).withColumnRenamed("item_id", "eval_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with text that was decoded with the wrong encoding."""
    return mojibake.garbled(table(spark, d, "documents"), "doc_id", "text").select("doc_id")


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    """The same documents as restored."""
    return mojibake.restored(table(spark, d, "documents"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p1_found, p1_pairs, p5_found, p6_found, p6_bm25, p7_found, p7_fused, p8_ids, p8_decoded, p9_found, p9_spans, p10_found, p10_restored)}
