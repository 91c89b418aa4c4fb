"""Queries on skewed keys, nested commits and hierarchies of forks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithgraph.functions.text import has_text
from kithgraph.operators import forest, shred, skew
from kithgraph.operators.current import current_values
from kithgraph.sources.tables import table

#: Table, the column whose id is counted for, the column whose ids are counted.
RELATIONS = (("stargazer", "repo", "user"), ("follow", "followee", "follower"), ("contributor", "repo", "user"))
#: A key is dominant if it owns a part in so many of its table's pairs.
DOMINANT_PARTS = 50


def _key_counts(spark: SparkSession, d: str) -> DataFrame:
    pairs = [
        table(spark, d, name).select(F.lit(i).cast("tinyint").alias("relation"), F.col(f"{key}.id").alias("key_id"), F.col(f"{other}.id").alias("other_id"))
        for i, (name, key, other) in enumerate(RELATIONS)
    ]
    return skew.distinct_others(reduce(DataFrame.unionAll, pairs), ["relation", "key_id"], "other_id", "n_others")


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("relation", F.element_at(F.array(*[F.lit(r[0]) for r in RELATIONS]), F.col("relation").cast("int") + 1))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The ids that own at least a fiftieth of the distinct pairs of their table."""
    return _named(skew.dominant(_key_counts(spark, d), "relation", "n_others", DOMINANT_PARTS).select("relation", "key_id"))


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    """The number of distinct others of every id."""
    return _named(_key_counts(spark, d))


#: Columns of the flat commit table and their places in a record.
COMMIT_PATHS = {
    "message": "commit.message",
    "tree_sha": "commit.tree.sha",
    "comment_count": "commit.comment_count",
    "verified": "commit.verification.verified",
    "verification_reason": "commit.verification.reason",
    "author_id": "author.id",
    "committer_id": "committer.id",
}
PERSON_PATHS = {f"{role}_{x}": f"commit.{role}.{x}" for role in ("author", "committer") for x in ("name", "email", "date")}
#: Where commit objects stand in a payload.
COMMIT_ROOTS = ("", "[]", "page.commits[]")


def _raw(spark: SparkSession, d: str, columns: dict[str, str], repeated: tuple[str, ...] = ()) -> DataFrame:
    """Commits of ``commit_raw`` that have a repository and a sha, as records with ``columns``."""
    columns = {"repo_id": "repo.id", "sha": "sha"} | columns
    records = shred.json_records(table(spark, d, "commit_raw"), "line_no", "payload", COMMIT_ROOTS, [*columns.values(), *repeated], {"repo.id": "repo.id"})
    return _identified(shred.root_columns(records, columns))


def _identified(records: DataFrame) -> DataFrame:
    flat = records.withColumn("repo_id", F.expr("try_cast(repo_id as bigint)"))
    return flat.where(F.col("repo_id").isNotNull() & has_text(F.col("sha")))


def _typed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "commits").where(F.col("repo.id").isNotNull() & has_text(F.col("sha")))



def _typed_keys() -> dict:
    return {"repo_id": F.col("repo.id"), "sha": F.col("sha")}


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The parent links of all commits, parsed or not."""
    own = {"repo_id": "repo.id", "sha": "sha"}
    typed = _identified(shred.root_columns(shred.typed_records(table(spark, d, "commits"), F.col("line_no"), [*own.values(), "parents[].sha"]), own))
    links = shred.group_table(typed.unionByName(_raw(spark, d, {}, ("parents[].sha",))), ["repo_id", "sha"], "parents[]", {"parent_sha": "parents[].sha"})
    return links.select("repo_id", "sha", F.col("ordinals")[0].cast("bigint").alias("pos"), "parent_sha").distinct()


def p3_commits(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of commits, one row for each delivery: its source, line, and place in the line's payload."""
    typed = shred.record_table(_typed(spark, d), {"source": F.lit("commits"), "line_no": F.col("line_no"), "record": F.lit(0)} | _typed_keys(), COMMIT_PATHS)
    raw = _raw(spark, d, COMMIT_PATHS).select(
        F.lit("commit_raw").alias("source"),
        F.col("key").alias("line_no"),
        "record",
        "repo_id",
        "sha",
        "message",
        "tree_sha",
        *[F.expr(f"try_cast({c} as bigint)").alias(c) for c in ("comment_count",)],
        F.expr("try_cast(verified as boolean)").alias("verified"),
        "verification_reason",
        *[F.expr(f"try_cast({c} as bigint)").alias(c) for c in ("author_id", "committer_id")],
    )
    return typed.unionByName(raw)


def p3_persons(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of a commit's persons: a row for each role with a name, an email or a date, tied to its commit."""
    typed = shred.record_table(_typed(spark, d), _typed_keys(), PERSON_PATHS)
    raw = _raw(spark, d, PERSON_PATHS).select("repo_id", "sha", *[F.expr(f"try_to_timestamp({c})").cast("timestamp_ntz").alias(c) if c.endswith("date") else c for c in PERSON_PATHS])
    dates = [c for c in PERSON_PATHS if c.endswith("date")]
    both = typed.withColumns({c: F.col(c).cast("timestamp_ntz") for c in dates}).unionByName(raw)
    roles = F.array(*[F.struct(F.lit(r).alias("role"), *[F.col(f"{r}_{x}").alias(x) for x in ("name", "email", "date")]) for r in ("author", "committer")])
    each = both.select("repo_id", "sha", F.inline(roles))
    return each.where(F.coalesce("name", "email", F.col("date").cast("string")).isNotNull()).distinct()


def _parents(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "repository")
    now = current_values(rows, F.col("id"), {"parent": F.col("parent.id")}, F.col("updated_at"), F.col("item") == "Repository", F.col("line_no"))
    return now.where(F.col("parent").isNotNull()).select(F.col("id").alias("node"), "parent")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Root and depth of every fork; -1 and the least id of the circle where parents run in one."""
    return forest.resolve(_parents(spark, d)).select(F.col("node").alias("repo_id"), F.col("root").alias("root_id"), "depth")


def p4_paths(spark: SparkSession, d: str) -> DataFrame:
    """The path of every fork from its root down, as text."""
    tree = forest.paths(forest.resolve(_parents(spark, d))).where(F.col("path").isNotNull())
    return tree.select(F.col("node").alias("repo_id"), F.array_join("path", "/").alias("path"))


def p4_forks_below(spark: SparkSession, d: str) -> DataFrame:
    """For every repository, each fork below it and how far below."""
    below = forest.descendants(forest.paths(forest.resolve(_parents(spark, d))))
    return below.select(F.col("ancestor").alias("repo_id"), F.col("node").alias("fork_id"), F.col("distance").cast("bigint").alias("distance"))


QUERIES = {f.__name__: f for f in (p2_found, p2_counts, p3_found, p3_commits, p3_persons, p4_found, p4_paths, p4_forks_below)}
