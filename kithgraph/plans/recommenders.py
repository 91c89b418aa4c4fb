"""Queries on features, recommenders and their evaluation."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithgraph.operators import edge_features, evaluate, features, graph, matrix, recommend, similarity, walk
from kithgraph.plans import relations as R
from kithgraph.plans.graphs import nonfork_descriptions
from kithgraph.session import cut

#: Nearest neighbours of collaborative filtering, length of a recommendation, ranks at which it is judged.
NEIGHBOURS, LENGTH, CUTOFFS = 50, 20, [5, 10, 20]
#: Steps of the random walk.
STEPS = 10


def language_share(spark: SparkSession, d: str) -> DataFrame:
    return matrix.normalised(features.language_features(R.latest_languages(spark, d)), "l1").select(F.col("row").alias("repo_id"), F.col("col").alias("language"), F.round("w", 6).alias("share"))


def _tfidf(spark: SparkSession, d: str) -> DataFrame:
    texts = cut(nonfork_descriptions(spark, d))
    # one empty text stands for repositories without description
    return features.tfidf(features.term_counts(texts, "repo_id", "description"), texts.count() + 1)


def tfidf(spark: SparkSession, d: str) -> DataFrame:
    return _tfidf(spark, d).select(F.col("row").alias("repo_id"), F.col("col").alias("term"), F.round("w", 6).alias("w"))


def _follow(spark: SparkSession, d: str, direction: str) -> DataFrame:
    users = R.contributor_edges(spark, d).select(F.col("src").alias("row")).distinct()
    return features.neighbour_features(R.follow_edges(spark, d), users, direction)


def follower_features(spark: SparkSession, d: str) -> DataFrame:
    return _follow(spark, d, "follower").select("row", "col")


def followee_features(spark: SparkSession, d: str) -> DataFrame:
    return _follow(spark, d, "followee").select("row", "col")


def _similarity(spark: SparkSession, d: str, kind: str) -> DataFrame:
    h = R.Holdout(spark, d)
    m = h.train.select(F.col("src").alias("row"), F.col("dst").alias("col"), F.lit(1.0).alias("w"))
    source, target = similarity.bigraph_features(m, features.language_features(R.latest_languages(spark, d)), "target")
    a, b = {"ss": (source, source), "st": (source, target), "tt": (target, target)}[kind]
    a, b = cut(a), cut(b)
    return matrix.dot_of(a.where(F.col("row") % R.QUERY_IDS == 0), b, 6)


def bigraph_similarity_ss(spark: SparkSession, d: str) -> DataFrame:
    return _similarity(spark, d, "ss")


def bigraph_similarity_st(spark: SparkSession, d: str) -> DataFrame:
    return _similarity(spark, d, "st")


def bigraph_similarity_tt(spark: SparkSession, d: str) -> DataFrame:
    return _similarity(spark, d, "tt")


def edge_features_constant(spark: SparkSession, d: str) -> DataFrame:
    return edge_features.constant(R.contributor_edges(spark, d))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c, kind in df.dtypes if kind == "double"})


def edge_features_attribute(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(edge_features.edge_attributes(R.contributor_edges(spark, d), ("contributions",)))


def edge_features_user(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(edge_features.node_attributes(R.contributor_edges(spark, d), "src", R.users_merged(spark, d), edge_features.USER_KEYS))


def edge_features_repository(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(edge_features.node_attributes(R.contributor_edges(spark, d), "dst", R.repos_merged(spark, d), edge_features.REPOSITORY_KEYS))


def edge_features_language(spark: SparkSession, d: str) -> DataFrame:
    share = matrix.normalised(features.language_features(R.latest_languages(spark, d)), "l1")
    return _rounded(edge_features.language(R.contributor_edges(spark, d), share))


def edge_features_similarity(spark: SparkSession, d: str) -> DataFrame:
    """The root is the least user that has a repository with languages."""
    edges = R.contributor_edges(spark, d).select("src", "dst")
    m = edges.select(F.col("src").alias("row"), F.col("dst").alias("col"), F.lit(1.0).alias("w"))
    source, target = (cut(x) for x in similarity.bigraph_features(m, features.language_features(R.latest_languages(spark, d)), "target"))
    root = source.agg(F.min("row")).first()[0]
    return _rounded(edge_features.similarities(edges, source, target, -1 if root is None else root))


def edge_features_combined(spark: SparkSession, d: str) -> DataFrame:
    edges = R.contributor_edges(spark, d)
    blocks = edge_features.constant(edges), edge_features.edge_attributes(edges, ("contributions",)), edge_features.node_attributes(edges, "src", R.users_merged(spark, d), ("followers",))
    return _rounded(edge_features.combined(edges, *blocks))


def _rounded_score(df: DataFrame) -> DataFrame:
    return df.select("user", "item", "rank", F.round("score", 6).alias("score"))


def rec_user_cf(spark: SparkSession, d: str) -> DataFrame:
    return _rounded_score(recommend.user_cf(R.Holdout(spark, d).train, NEIGHBOURS, LENGTH))


def rec_item_cf(spark: SparkSession, d: str) -> DataFrame:
    return _rounded_score(recommend.item_cf(R.Holdout(spark, d).train, NEIGHBOURS, LENGTH))


def rec_random(spark: SparkSession, d: str) -> DataFrame:
    h = R.Holdout(spark, d)
    return recommend.random_items(h.train, h.some_users, h.items).select("user", "item", "rank", "score")


def _content(spark: SparkSession, d: str, feature, side: str) -> DataFrame:
    h = R.Holdout(spark, d)
    m = h.train.select(F.col("src").alias("row"), F.col("dst").alias("col"), F.lit(1.0).alias("w"))
    return _rounded_score(recommend.content_based(h.train, feature(m), side, h.some_users, h.items))


def rec_language(spark: SparkSession, d: str) -> DataFrame:
    return _content(spark, d, lambda m: features.language_features(R.latest_languages(spark, d)), "target")


def rec_description(spark: SparkSession, d: str) -> DataFrame:
    return _content(spark, d, lambda m: _tfidf(spark, d), "target")


def rec_quasi_user(spark: SparkSession, d: str) -> DataFrame:
    return _content(spark, d, lambda m: m, "source")


def rec_quasi_item(spark: SparkSession, d: str) -> DataFrame:
    return _content(spark, d, matrix.transpose, "target")


def rec_follower(spark: SparkSession, d: str) -> DataFrame:
    return _content(spark, d, lambda m: _follow(spark, d, "follower"), "source")


def rec_followee(spark: SparkSession, d: str) -> DataFrame:
    return _content(spark, d, lambda m: _follow(spark, d, "followee"), "source")


def _links(h: R.Holdout, *others: graph.Graph) -> DataFrame:
    merged = graph.both_ways(graph.union(graph.graph(h.train, "User", "Repository"), *others))
    name = lambda t, i: F.concat(F.substring(t, 1, 1), F.col(i).cast("string"))
    return merged.select(name("src_type", "src").alias("src"), name("dst_type", "dst").alias("dst"))


def personal_rank(spark: SparkSession, d: str) -> DataFrame:
    h = R.Holdout(spark, d)
    seeds = h.some_users.select(F.concat(F.lit("U"), F.col("user").cast("string")).alias("seed"))
    return walk.personal_rank(_links(h), seeds, max_steps=STEPS, digits=6).select("seed", "node", "x")


def rec_random_walk(spark: SparkSession, d: str) -> DataFrame:
    h = R.Holdout(spark, d)
    return _rounded_score(recommend.walked(_links(h), h.train, h.some_users, h.items, max_steps=STEPS))


def rec_random_walk_other_graph(spark: SparkSession, d: str) -> DataFrame:
    """The walk also follows who follows whom."""
    h = R.Holdout(spark, d)
    return _rounded_score(recommend.walked(_links(h, R.follow_graph(spark, d)), h.train, h.some_users, h.items, max_steps=STEPS))


class _Judged:
    """Collaborative filtering on the split, with its frequencies; ``whole`` has all neighbours and whole lists of the query set's users instead of the capped ones of all. Of whole lists only what is judged is put down: the ranks up to the last cutoff and those of all hits."""

    def __init__(self, spark: SparkSession, d: str, whole: bool = False) -> None:
        h = R.Holdout(spark, d)
        self.recs = cut(recommend.user_cf_of(h.train, h.some_users, max(CUTOFFS), recommend.seen(h.test)) if whole else recommend.user_cf(h.train, NEIGHBOURS, LENGTH))
        self.train, self.test = recommend.seen(h.train), recommend.seen(h.test)
        if whole:
            self.train, self.test = (x.where(F.col("user") % R.QUERY_IDS == 0) for x in (self.train, self.test))
        self.items = h.items

    def frequencies(self) -> DataFrame:
        return evaluate.frequencies(self.recs, self.train, self.test, self.items, CUTOFFS)

    def rates(self) -> DataFrame:
        return cut(evaluate.rates(self.frequencies()))

    def ap(self) -> DataFrame:
        return evaluate.average_precision(self.recs, self.train, self.test)


def frequencies(spark: SparkSession, d: str, whole: bool = False) -> DataFrame:
    return _Judged(spark, d, whole).frequencies()


def precision_recall(spark: SparkSession, d: str, whole: bool = False) -> DataFrame:
    return _rounded(_Judged(spark, d, whole).rates())


def pr_curve(spark: SparkSession, d: str, whole: bool = False) -> DataFrame:
    return _rounded(evaluate.curves(_Judged(spark, d, whole).rates())[0])


def roc_curve(spark: SparkSession, d: str, whole: bool = False) -> DataFrame:
    return _rounded(evaluate.curves(_Judged(spark, d, whole).rates())[1])


def average_precision(spark: SparkSession, d: str, whole: bool = False) -> DataFrame:
    return _rounded(_Judged(spark, d, whole).ap())


def mean_average_precision(spark: SparkSession, d: str, whole: bool = False) -> DataFrame:
    return _rounded(evaluate.mean_average_precision(_Judged(spark, d, whole).ap()))


def roc_auc(spark: SparkSession, d: str, whole: bool = False) -> DataFrame:
    return _rounded(evaluate.roc_auc(_Judged(spark, d, whole).rates()))


def metric_report(spark: SparkSession, d: str, whole: bool = False) -> DataFrame:
    """Precision and recall at each rank, MAP and AUC of collaborative filtering on the split."""
    j = _Judged(spark, d, whole)
    rates = j.rates()
    return _rounded(rates.select("k", "precision", "recall").crossJoin(evaluate.mean_average_precision(j.ap())).crossJoin(evaluate.roc_auc(rates)))


def rec_user_cf_whole(spark: SparkSession, d: str) -> DataFrame:
    """For the query set's users, with all neighbours and whole lists."""
    h = R.Holdout(spark, d)
    return _rounded_score(recommend.user_cf_of(h.train, h.some_users))


def rec_item_cf_whole(spark: SparkSession, d: str) -> DataFrame:
    """For the query set's users, with all neighbours and whole lists."""
    h = R.Holdout(spark, d)
    return _rounded_score(recommend.item_cf_of(h.train, h.some_users))


QUERIES = {
    f.__name__: f
    for f in (
        language_share, tfidf, follower_features, followee_features, bigraph_similarity_ss, bigraph_similarity_st, bigraph_similarity_tt, edge_features_constant, edge_features_attribute,
        edge_features_user, edge_features_repository, edge_features_language, edge_features_similarity, edge_features_combined, rec_user_cf, rec_item_cf, rec_random, rec_language,
        rec_description, rec_quasi_user, rec_quasi_item, rec_follower, rec_followee, personal_rank, rec_random_walk, rec_random_walk_other_graph, frequencies, precision_recall,
        pr_curve, roc_curve, average_precision, mean_average_precision, roc_auc, metric_report,
        rec_user_cf_whole, rec_item_cf_whole,
    )
}
JUDGED = (frequencies, precision_recall, pr_curve, roc_curve, average_precision, mean_average_precision, roc_auc, metric_report)
QUERIES |= {f"{f.__name__}_whole": partial(f, whole=True) for f in JUDGED}
