"""The test tables as the engine's relations, in the DataFrame API and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithgraph.operators import graph
from kithgraph.operators.ordering import split_edges
from kithgraph.session import cut
from kithgraph.sources.jsonl import entity_rows, merge_entities
from kithgraph.sources.tables import table

#: The stated query set: ids divisible by this.
QUERY_IDS = 50

CONTRIBUTOR = """contributor_edges AS (SELECT "user".id AS src, repo.id AS dst, arg_max(contributions, line_no) AS contributions
  FROM contributor WHERE "user".id IS NOT NULL AND repo.id IS NOT NULL GROUP BY ALL)"""
STARGAZER = """stargazer_edges AS (SELECT DISTINCT "user".id AS src, repo.id AS dst FROM stargazer WHERE "user".id IS NOT NULL AND repo.id IS NOT NULL)"""
FOLLOW = """follow_edges AS (SELECT DISTINCT follower.id AS src, followee.id AS dst FROM follow WHERE follower.id IS NOT NULL AND followee.id IS NOT NULL)"""
SPLIT = f"""{CONTRIBUTOR},
ordered AS (SELECT src, dst, row_number() OVER (ORDER BY md5('42:' || src || ':' || dst), src, dst) AS rn, count(*) OVER () AS n FROM contributor_edges),
train AS (SELECT src AS "user", dst AS item FROM ordered WHERE rn <= floor(n * 0.8)),
test AS (SELECT src AS "user", dst AS item FROM ordered WHERE rn > floor(n * 0.8)),
users AS (SELECT DISTINCT src AS "user" FROM contributor_edges), items AS (SELECT DISTINCT dst AS item FROM contributor_edges)"""
LATEST = """latest AS (SELECT repo.id AS repo_id, max(line_no) AS line_no FROM languages WHERE repo.id IS NOT NULL GROUP BY ALL),
language_bytes AS (SELECT repo_id, e.key AS language, e.value AS bytes FROM (SELECT latest.repo_id, unnest(map_entries(languages.languages)) AS e FROM languages JOIN latest USING (line_no)))"""
#: The fields that are merged.
USER_FIELDS = ("login", "type", "company", "public_repos", "public_gists", "followers", "following", "hireable")
REPO_FIELDS = ("name", "fork", "open_issues_count", "has_wiki", "has_downloads", "forks_count", "has_issues", "stargazers_count", "size")


def _merged_sql(name: str, rows: str, summary: str, fields: tuple[str, ...]) -> str:
    picks = ", ".join(f"arg_max({f}, o) AS {f}" for f in fields)
    return f"{name} AS (SELECT id, {picks} FROM (SELECT *, struct_pack(s := item = '{summary}', l := line_no) AS o FROM {rows}) WHERE id IS NOT NULL GROUP BY id)"


USERS_MERGED = _merged_sql("accounts_merged", "account", "AccountSummary", USER_FIELDS)
REPOS_MERGED = _merged_sql("repositories_merged", "repository", "RepositorySummary", REPO_FIELDS)


def contributor_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.edges(table(spark, d, "contributor"), F.col("user.id"), F.col("repo.id"), {"contributions": F.col("contributions")}, F.col("line_no"))


def stargazer_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.edges(table(spark, d, "stargazer"), F.col("user.id"), F.col("repo.id"))


def follow_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.edges(table(spark, d, "follow"), F.col("follower.id"), F.col("followee.id"))


def contributor_graph(spark: SparkSession, d: str) -> graph.Graph:
    return graph.graph(contributor_edges(spark, d), "User", "Repository")


def follow_graph(spark: SparkSession, d: str) -> graph.Graph:
    return graph.graph(follow_edges(spark, d), "User", "User", directed=True)


def latest_languages(spark: SparkSession, d: str) -> DataFrame:
    """repo_id, language, bytes of each repository's last line; repositories without languages have no row."""
    rows = table(spark, d, "languages").where(F.col("repo.id").isNotNull())
    last = rows.groupBy(F.col("repo.id").alias("repo_id")).agg(F.max_by(F.struct("languages"), "line_no").alias("v"))
    return last.select("repo_id", F.explode("v.languages").alias("language", "bytes"))


def users_merged(spark: SparkSession, d: str, mode: str = "both") -> DataFrame:
    rows = entity_rows(table(spark, d, "account"), "AccountSummary", mode)
    return merge_entities(rows.select("id", *USER_FIELDS, "rank"), "id", F.col("rank")).drop("rank")


def repos_merged(spark: SparkSession, d: str, mode: str = "both") -> DataFrame:
    rows = entity_rows(table(spark, d, "repository"), "RepositorySummary", mode)
    return merge_entities(rows.select("id", *REPO_FIELDS, "rank"), "id", F.col("rank")).drop("rank")


class Holdout:
    """The deterministic split of the contributor graph with its universe of users and items, each computed once."""

    def __init__(self, spark: SparkSession, d: str) -> None:
        edges = cut(split_edges(contributor_edges(spark, d).select("src", "dst")))
        self.edges = edges
        self.train = edges.where("is_train").select("src", "dst")
        self.test = edges.where("not is_train").select("src", "dst")
        self.users = edges.select(F.col("src").alias("user")).distinct()
        self.items = edges.select(F.col("dst").alias("item")).distinct()
        self.some_users = self.users.where(F.col("user") % QUERY_IDS == 0)
