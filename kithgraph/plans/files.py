"""Queries that write files and read them again, and reports over several recommenders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithgraph.operators import features, models, recommend
from kithgraph.plans import crawling
from kithgraph.plans import relations as R
from kithgraph.session import scratch
from kithgraph.sources import jsonl, queue, reports
from kithgraph.sources.tables import table


def graph_files(spark: SparkSession, d: str) -> DataFrame:
    """The contributor graph written as Parquet and read again."""
    path = scratch(spark)
    reports.write_graph(R.contributor_graph(spark, d), path)
    return reports.read_graph(spark, path).edges.select("src", "dst", "contributions")


def graph_nodes_files(spark: SparkSession, d: str) -> DataFrame:
    """The follow graph's nodes, written as a JSON document and read again."""
    path = scratch(spark)
    reports.write_json_graph(R.follow_graph(spark, d), path)
    return reports.read_json_graph(spark, path, "User", "User").nodes


def graph_json_files(spark: SparkSession, d: str) -> DataFrame:
    """The follow graph written as a JSON document and read again."""
    path = scratch(spark)
    reports.write_json_graph(R.follow_graph(spark, d), path)
    return reports.read_json_graph(spark, path, "User", "User").edges


def item_files(spark: SparkSession, d: str) -> DataFrame:
    """Contributors appended to a file of JSON lines in two parts, with a field that isn't declared, and read under the schema where contributions aren't missing."""
    path, rows = scratch(spark), table(spark, d, "contributor").withColumn("undeclared", F.lit(1))
    for part in (0, 1):
        jsonl.append_items(rows.where(F.pmod(F.xxhash64("line_no"), F.lit(2)) == part), path, "Contributor")
    read = jsonl.read_items(spark, path, "Contributor", F.col("contributions").isNotNull())
    return read.select(F.col("repo.id").alias("repo_id"), F.col("user.id").alias("user_id"), "contributions")


def _random(spark: SparkSession, d: str) -> tuple[R.Holdout, DataFrame]:
    h = R.Holdout(spark, d)
    return h, models.Random().fit(h.train, h.items).recommend_all(h.some_users)


def report_files(spark: SparkSession, d: str) -> DataFrame:
    """A report written as Parquet and read again: what was recommended, and training and test edges."""
    h, recs = _random(spark, d)
    path = scratch(spark)
    reports.write_report(path, models.Random().parameters(), recs, recommend.seen(h.train), recommend.seen(h.test), h.items)
    back = reports.read_report(spark, path)
    kinds = [back[k].select(F.lit(k).alias("kind"), "user", "item", (F.col("rank") if k == "recs" else F.lit(0)).cast("int").alias("rank")) for k in ("recs", "train", "test")]
    return kinds[0].unionAll(kinds[1]).unionAll(kinds[2]).withColumn("seed", F.lit(back["parameters"]["seed"]))


def report_json_files(spark: SparkSession, d: str) -> DataFrame:
    """A report written as JSON lines and read again: each user's lists, in order where they have one."""
    h, recs = _random(spark, d)
    path = scratch(spark)
    reports.write_json_report(path, recs, recommend.seen(h.train), recommend.seen(h.test))
    back = spark.read.schema("user bigint, training array<bigint>, recommended array<bigint>, groundtruth array<bigint>").json(path)
    each = [back.select("user", F.lit(k).alias("kind"), F.posexplode(k).alias("pos", "item")) for k in ("training", "recommended", "groundtruth")]
    return each[0].unionAll(each[1]).unionAll(each[2])


def merge_accounts_full(spark: SparkSession, d: str) -> DataFrame:
    return R.users_merged(spark, d, "full")


def merge_accounts_summary(spark: SparkSession, d: str) -> DataFrame:
    return R.users_merged(spark, d, "summary")


def merge_repositories_full(spark: SparkSession, d: str) -> DataFrame:
    return R.repos_merged(spark, d, "full")


def merge_repositories_summary(spark: SparkSession, d: str) -> DataFrame:
    return R.repos_merged(spark, d, "summary")


def merge_documents(spark: SparkSession, d: str) -> DataFrame:
    """Accounts as JSON documents: full ones write nulls down, summaries leave such fields out; written nulls overwrite."""
    rows = table(spark, d, "account")
    own = F.struct("id", "name", "company", "followers")
    text = F.when(F.col("item") == "Account", F.to_json(own, {"ignoreNullFields": "false"})).otherwise(F.to_json(own, {"ignoreNullFields": "true"}))
    merged = jsonl.merge_documents(rows.select(text.alias("text"), "line_no"), "text", F.col("line_no"))
    field = lambda k: F.try_element_at("fields", F.lit(k))
    return merged.select("id", field("name").alias("name"), field("company").alias("company"), field("followers").cast("bigint").alias("followers"))


def start_queue(spark: SparkSession, d: str) -> DataFrame:
    """Start requests that wait after those of repositories with even ids were done and the queue was filled once more, which changes nothing."""
    own = queue.StartQueue(spark, scratch(spark))
    starts = crawling.start_requests(spark, d)
    own.fill(starts, "path")
    own.done(own.waiting().where("item_id % 2 = 0"))
    queue.StartQueue(spark, own.folder).fill(starts.where("item_id % 2 = 0"), "path")
    return own.waiting().select("position", "path")


def _recommenders(spark: SparkSession, d: str) -> list[models.Recommender]:
    return [models.Random(), models.Random(seed=7), models.ContentBased("language", "target", features.language_features(R.latest_languages(spark, d)))]


def recommend_all(spark: SparkSession, d: str) -> DataFrame:
    """Two kinds of recommenders by one interface."""
    h = R.Holdout(spark, d)
    some = [r.fit(h.train, h.items).recommend_all(h.some_users).select(F.lit(r.name).alias("name"), "user", "rank", "item") for r in _recommenders(spark, d)[::2]]
    return some[0].unionAll(some[1])


def experiment_report(spark: SparkSession, d: str) -> DataFrame:
    """Three recommenders judged on the same split and users."""
    h = R.Holdout(spark, d)
    return models.experiment(_recommenders(spark, d), h.train, h.test, h.items, h.some_users, [5, 10])



QUERIES = {
    f.__name__: f
    for f in (
        graph_files, graph_nodes_files, graph_json_files, item_files, report_files, report_json_files, merge_accounts_full, merge_accounts_summary, merge_repositories_full, merge_repositories_summary,
        merge_documents, start_queue, recommend_all, experiment_report,
    )
}
