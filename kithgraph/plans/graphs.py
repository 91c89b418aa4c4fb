"""Queries on loading, filters, graphs, co-occurrence and matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithgraph.operators import cooccurrence, graph, matrix, ordering, similarity
from kithgraph.plans import relations as R
from kithgraph.sources.jsonl import last_rows
from kithgraph.sources.tables import table


def load_contributor_graph(spark: SparkSession, d: str) -> DataFrame:
    return R.contributor_edges(spark, d)


def load_stargazer_graph(spark: SparkSession, d: str) -> DataFrame:
    return R.stargazer_edges(spark, d)


def load_follow_graph(spark: SparkSession, d: str) -> DataFrame:
    return R.follow_edges(spark, d)


def load_membership_graph(spark: SparkSession, d: str) -> DataFrame:
    return graph.edges(table(spark, d, "customer"), F.col("c_custkey"), F.col("c_nationkey").cast("bigint"))


def load_language_graph(spark: SparkSession, d: str) -> DataFrame:
    each = table(spark, d, "languages").where(F.col("languages").isNotNull()).select("repo", "line_no", F.explode("languages").alias("language", "bytes"))
    return graph.edges(each, F.col("repo.id"), F.col("language"), {"bytes": F.col("bytes")}, F.col("line_no"))


def latest_languages(spark: SparkSession, d: str) -> DataFrame:
    return R.latest_languages(spark, d)


def merge_accounts(spark: SparkSession, d: str) -> DataFrame:
    return R.users_merged(spark, d)


def merge_repositories(spark: SparkSession, d: str) -> DataFrame:
    return R.repos_merged(spark, d)


def nonfork_descriptions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "repository").where((F.col("item") == "RepositorySummary") & ~F.coalesce("fork", F.lit(False)))
    last = last_rows(rows, F.col("id"), F.col("line_no"), description=F.col("description"))
    return last.select(F.col("key").alias("repo_id"), F.coalesce("description", F.lit("")).alias("description"))


def node_attributes(spark: SparkSession, d: str) -> DataFrame:
    g = R.contributor_graph(spark, d)
    users = graph.with_attributes(g, "Account", R.users_merged(spark, d).select("id", "login", "followers"))
    repos = graph.with_attributes(g, "Repository", R.repos_merged(spark, d).select("id", "name", "stargazers_count"))
    return users.select("type", "id", F.col("login").alias("label"), F.col("followers").alias("popularity")).unionAll(repos.select("type", "id", "name", "stargazers_count"))


def filter_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.filter_edges(R.contributor_graph(spark, d), F.col("contributions") >= 5).edges


def nodes_by_class(spark: SparkSession, d: str) -> DataFrame:
    return graph.nodes_of(R.contributor_graph(spark, d), "Account")


def commit_projection(spark: SparkSession, d: str) -> DataFrame:
    flat = table(spark, d, "commits").withColumn("commit", F.col("commit").dropFields("verification", "tree"))
    parents = F.array_join(F.transform("parents", lambda p: F.coalesce(p.sha, F.lit("?"))), " ")
    return flat.select("line_no", "sha", F.col("commit.message").alias("message"), F.col("commit.author.name").alias("author"), parents.alias("parents"))


def nested_pruning(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "repository").select("line_no", *[F.col(f"{c}.id").alias(f"{c}_id") for c in ("owner", "organization", "parent", "source")])


def _totals(spark: SparkSession, d: str) -> DataFrame:
    return cooccurrence.language_totals(table(spark, d, "languages"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return cooccurrence.language_pairs(table(spark, d, "languages"), "line_no")


def language_totals(spark: SparkSession, d: str) -> DataFrame:
    return _totals(spark, d)


def language_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d)


def language_pairs_filtered(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).where(F.col("weight") >= 5)


def language_top_n(spark: SparkSession, d: str) -> DataFrame:
    return cooccurrence.top_languages(_totals(spark, d), _pairs(spark, d), 10)


def language_matrix(spark: SparkSession, d: str) -> DataFrame:
    return cooccurrence.language_matrix(_pairs(spark, d), cooccurrence.top_languages(_totals(spark, d), _pairs(spark, d), 10))


def degree(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(R.contributor_graph(spark, d))


def weighted_degree(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(R.contributor_graph(spark, d), F.col("contributions"))


def degree_histogram(spark: SparkSession, d: str) -> DataFrame:
    return graph.degree_histogram(graph.degrees(R.contributor_graph(spark, d)))


def follow_degree_histogram(spark: SparkSession, d: str) -> DataFrame:
    return graph.degree_histogram(graph.degrees(R.follow_graph(spark, d)))


def out_degree(spark: SparkSession, d: str) -> DataFrame:
    return graph.out_degrees(R.follow_edges(spark, d))


def graph_summary(spark: SparkSession, d: str) -> DataFrame:
    return graph.summary(R.contributor_graph(spark, d)).unionAll(graph.summary(R.follow_graph(spark, d)))


def graph_labels(spark: SparkSession, d: str) -> DataFrame:
    return graph.label(R.contributor_graph(spark, d))


def graph_union(spark: SparkSession, d: str) -> DataFrame:
    return graph.union(R.contributor_graph(spark, d), R.follow_graph(spark, d), graph.graph(R.stargazer_edges(spark, d), "User", "Repository"))


def to_directed(spark: SparkSession, d: str) -> DataFrame:
    return graph.both_ways(graph.typed(R.contributor_graph(spark, d)))


def _m(spark: SparkSession, d: str) -> DataFrame:
    return R.contributor_edges(spark, d).select(F.col("src").alias("row"), F.col("dst").alias("col"), F.coalesce("contributions", F.lit(1)).cast("double").alias("w"))


def row_sum(spark: SparkSession, d: str) -> DataFrame:
    return matrix.row_sums(_m(spark, d))


def row_scale(spark: SparkSession, d: str) -> DataFrame:
    m = _m(spark, d)
    return matrix.scale_rows(m, m.select("row").distinct().withColumn("s", F.col("row") % 7 + 1.0))


def vector_matrix(spark: SparkSession, d: str) -> DataFrame:
    m = _m(spark, d)
    return matrix.vector_times(m.select("row").distinct().withColumn("x", F.col("row") % 7 + 1.0), m).select("col", F.round("x", 6).alias("x"))


def l1_rows(spark: SparkSession, d: str) -> DataFrame:
    return matrix.normalised(_m(spark, d), "l1").withColumn("w", F.round("w", 6))


def l2_rows(spark: SparkSession, d: str) -> DataFrame:
    return matrix.normalised(_m(spark, d), "l2").withColumn("w", F.round("w", 6))


def standardise(spark: SparkSession, d: str) -> DataFrame:
    columns = ["c_acctbal", "key"]
    rows = table(spark, d, "customer").select("c_custkey", "c_acctbal", (F.col("c_custkey") % 13).cast("double").alias("key"))
    return matrix.standardised(rows, columns).withColumns({c: F.round(c, 6) for c in columns})


def split_edges(spark: SparkSession, d: str) -> DataFrame:
    return R.Holdout(spark, d).edges


def _flipped(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def jaccard_user(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of classes of users with the same repositories."""
    edges = R.contributor_edges(spark, d).select("src", "dst")
    return similarity.jaccard(edges, similarity.set_classes(edges), 6)


def jaccard_user_classes(spark: SparkSession, d: str) -> DataFrame:
    return similarity.set_classes(R.contributor_edges(spark, d).select("src", "dst")).select(F.col("src").alias("user_id"), "class_id", "size", "members")


def jaccard_item(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of classes of repositories with the same users."""
    edges = _flipped(R.contributor_edges(spark, d))
    return similarity.jaccard(edges, similarity.set_classes(edges)).select("a", "b", F.round("sim", 6).alias("sim"))


def nearest_k(spark: SparkSession, d: str) -> DataFrame:
    return similarity.neighbours(_flipped(R.contributor_edges(spark, d)), 10).select("a", "b", F.round("sim", 6).alias("sim"), "rank")


def measure(spark: SparkSession, d: str) -> DataFrame:
    """All similarities of the repository with most users."""
    edges = _flipped(R.contributor_edges(spark, d))
    classes = similarity.set_classes(edges)
    first = classes.orderBy(F.desc("size"), "src").first()
    return similarity.measure(similarity.jaccard(edges, classes), classes, first.src if first else -1).select("b", F.round("sim", 6).alias("sim"))


def cosine_embeddings(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    return similarity.dense(rows.where(F.col("vec_id") % R.QUERY_IDS == 0), rows, "vec_id", "embedding", cosine=True).withColumn("sim", F.round("sim", 6))


def linear_embeddings(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    return similarity.dense(rows.where(F.col("vec_id") % R.QUERY_IDS == 0), rows, "vec_id", "embedding", cosine=False).withColumn("sim", F.round("sim", 6))


def sliding_tuples(spark: SparkSession, d: str) -> DataFrame:
    return ordering.slide(table(spark, d, "events"), "user_id", "event_id", "event_type", 3)


QUERIES = {
    f.__name__: f
    for f in (
        load_contributor_graph, load_stargazer_graph, load_follow_graph, load_membership_graph, load_language_graph, latest_languages, merge_accounts, merge_repositories,
        nonfork_descriptions, node_attributes, filter_edges, nodes_by_class, commit_projection, nested_pruning, language_totals, language_pairs, language_pairs_filtered,
        language_top_n, language_matrix, degree, weighted_degree, degree_histogram, follow_degree_histogram, out_degree, graph_summary, graph_labels, graph_union, to_directed,
        row_sum, row_scale, vector_matrix, l1_rows, l2_rows, standardise, split_edges, jaccard_user, jaccard_user_classes, jaccard_item, nearest_k, measure,
        cosine_embeddings, linear_embeddings, sliding_tuples,
    )
}
