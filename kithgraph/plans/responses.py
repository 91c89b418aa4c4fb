"""Queries on API responses. The tables are put into pages of JSON as the API has them, and parsed again."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kithgraph.operators import crawl, responses
from kithgraph.sources.tables import table

#: Rows of a table on one page.
PAGE = 50
SITE = "https://api.hub.example"


def _account(user: Column) -> Column:
    return F.struct(user.alias("id"), F.concat(F.lit("u"), user.cast("string")).alias("login"), F.when(user % 11 == 0, "Organization").otherwise("User").alias("type"))


def _page(body: Column, endpoint: str, parent: Column, rows: DataFrame) -> DataFrame:
    """Responses with up to PAGE rows each; all but every third page name a next one."""
    n = F.floor(F.col("line_no") / PAGE)
    pages = rows.groupBy(n.alias("page"), parent.cast("bigint").alias("parent_id")).agg(F.to_json(F.collect_list(body)).alias("body"))
    url = F.concat(F.lit(f"<{SITE}/{endpoint}?ids=1,2&page="), (F.col("page") + 1).cast("string"), F.lit(">; title=\"a, b\"; rel=next"))
    link = F.when(F.col("page") % 3 != 0, F.concat(F.lit(f'<{SITE}>; rel="first prev", '), url))
    return pages.select(F.concat_ws("/", "page", F.coalesce(F.col("parent_id").cast("string"), F.lit(""))).alias("n"), F.lit(endpoint).alias("endpoint"), "parent_id", F.lit(False).alias("start"), link.alias("link"), "body")


def _accounts(spark: SparkSession, d: str, endpoint: str) -> DataFrame:
    name, parent, user = {"follow": ("follow", "followee.id", "follower.id")}.get(_TABLES[endpoint], (_TABLES[endpoint], "repo.id", "user.id"))
    rows = table(spark, d, name)
    if name == "follow" and endpoint == "organization_members":
        parent, user = "follower.id", "followee.id"
    account = _account(F.col(user))
    if name == "contributor":
        account = F.struct(*[account[c].alias(c) for c in ("id", "login", "type")], "contributions")
    return _page(account, endpoint, F.col(parent), rows)


#: The table that stands for each list of accounts; whom a user follows stands for an organisation's members.
_TABLES = {
    "repository_stargazers": "stargazer", "repository_subscribers": "stargazer", "repository_contributors": "contributor", "repository_collaborators": "contributor", "user_followers": "follow", "organization_members": "follow",
}


def _relation(spark: SparkSession, d: str, endpoint: str) -> DataFrame:
    return responses.relation(responses.parsed(_accounts(spark, d, endpoint)), endpoint)


def _repository() -> Column:
    owner = F.when(F.col("owner.id").isNotNull(), _account(F.col("owner.id"))).alias("owner")
    return F.struct("id", "name", "full_name", "description", "fork", owner, "parent", "source", F.lit("x").alias("undeclared"))


def _lists(spark: SparkSession, d: str) -> DataFrame:
    return _page(_repository(), "repository_forks", F.lit(1), table(spark, d, "repository"))


def _single(spark: SparkSession, d: str) -> DataFrame:
    """Each row as the answer to a request for itself; the crawl began with forks."""
    rows = table(spark, d, "repository").where("item = 'Repository'")
    return rows.select(F.col("line_no").cast("string").alias("n"), F.lit("repository").alias("endpoint"), F.lit(None).cast("bigint").alias("parent_id"), F.coalesce("fork", F.lit(False)).alias("start"), F.lit(None).cast("string").alias("link"), F.to_json(_repository()).alias("body"))


def _commits(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "commits")
    account = lambda c: F.when(F.col(f"{c}.id").isNotNull(), _account(F.col(f"{c}.id"))).alias(c)
    return _page(F.struct("sha", "commit", account("author"), account("committer"), "parents"), "repository_commits", F.col("repo.id"), rows)


def response_languages(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "languages").select(F.col("line_no").cast("string").alias("n"), F.lit("repository_languages").alias("endpoint"), F.col("repo.id").alias("parent_id"), F.lit(False).alias("start"), F.lit(None).cast("string").alias("link"), F.to_json("languages").alias("body"))
    return responses.languages(responses.parsed(rows)).select("repo_id", F.explode("languages").alias("language", "bytes"))


def response_commits(spark: SparkSession, d: str) -> DataFrame:
    rows = responses.commits(responses.parsed(_commits(spark, d)))
    return rows.select("repo_id", "sha", "commit.message", "commit.author.email", F.col("author.id").alias("author_id"), F.col("committer.id").alias("committer_id"), F.size("parents").alias("n_parents"))


def response_details(spark: SparkSession, d: str) -> DataFrame:
    """Repositories that were asked for themselves, references reduced to ids."""
    rows = responses.details(responses.parsed(_single(spark, d)), "repository")
    return rows.select("id", "full_name", "fork", "description", F.col("owner.id").alias("owner_id"), F.col("parent.id").alias("parent_id"))


def response_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Repositories that lists and starting repositories name, parents and sources too."""
    both = responses.parsed(_lists(spark, d).unionAll(_single(spark, d)))
    return responses.named_repositories(both).select("id", "full_name", "fork", F.col("owner.login").alias("owner"))


def response_accounts(spark: SparkSession, d: str) -> DataFrame:
    """Accounts that lists of stargazers, commits and repositories name, with how often."""
    all_of = _accounts(spark, d, "repository_stargazers").unionAll(_commits(spark, d)).unionAll(_lists(spark, d)).unionAll(_single(spark, d))
    return responses.named_accounts(responses.parsed(all_of)).groupBy("id", "login", "type").agg(F.count(F.lit(1)).alias("n"))


def response_requests(spark: SparkSession, d: str) -> DataFrame:
    """How many requests of each endpoint come of lists of repositories and starting ones, those that the policy allows and others."""
    made = responses.requests(responses.parsed(_lists(spark, d).unionAll(_single(spark, d))), crawl.policy())
    return made.groupBy("endpoint", "visit", "fork").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first_path"), F.max("path").alias("last_path"))


def response_pages(spark: SparkSession, d: str) -> DataFrame:
    return responses.next_pages(_accounts(spark, d, "user_followers")).select("parent_id", "url", "has_previous_page")


QUERIES = {f"response_{e.split('_', 1)[1]}": partial(_relation, endpoint=e) for e in _TABLES} | {
    f.__name__: f for f in (response_languages, response_commits, response_details, response_summaries, response_accounts, response_requests, response_pages)
}
