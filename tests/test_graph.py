"""Small graphs worked out by hand."""

import random

import pytest
from pyspark.sql import functions as F

from kithgraph.functions import web
from kithgraph.operators import cooccurrence, crawl, edge_features, evaluate, features, graph, matrix, ordering, recommend, similarity, walk

# users 1..4 and 5 (alone), items a..e as 11..15
EDGES = [(1, 11), (1, 12), (2, 12), (2, 13), (3, 11), (3, 12), (3, 13), (4, 14)]


@pytest.fixture
def edges(spark):
    return spark.createDataFrame(EDGES, "src long, dst long")


def test_jaccard_by_hand(spark, rows, edges):
    classes = similarity.set_classes(edges)
    got = {(a, b): round(s, 6) for a, b, s in rows(similarity.jaccard(edges, classes), "a", "b", "sim")}
    assert got == {(1, 2): round(1 / 3, 6), (1, 3): round(2 / 3, 6), (2, 3): round(2 / 3, 6)}


def test_copies_are_one_class(spark, rows, edges):
    more = edges.unionAll(spark.createDataFrame([(9, 11), (9, 12)], "src long, dst long"))
    classes = similarity.set_classes(more)
    assert (9, 1, 2, 2) in rows(classes, "src", "class_id", "size", "members")
    near = rows(similarity.nearest(similarity.jaccard(more, classes), classes, 2), "a", "rank", "b")
    assert [(1, 1, 9), (1, 2, 3)] == [x for x in near if x[0] == 1] and [(9, 1, 1), (9, 2, 3)] == [x for x in near if x[0] == 9]
    own = dict(rows(similarity.measure(similarity.jaccard(more, classes), classes, 9), "b", "sim"))
    assert own[9] == own[1] == 1.0 and set(own) == {1, 2, 3, 9}


@pytest.mark.parametrize("k", [1, 3, 10])
def test_hot_neighbours_change_nothing(spark, rows, k):
    r = random.Random(k)
    pairs = {(u, 1) for u in range(40) if u % 3} | {(u, 2) for u in range(40) if u % 2} | {(u, r.randrange(3, 40)) for u in range(60) for _ in range(r.randrange(3))}
    e = spark.createDataFrame(sorted(pairs), "src long, dst long")
    classes = similarity.set_classes(e)
    want = rows(similarity.nearest(similarity.jaccard(e, classes), classes, k), "a", "rank", "b", "sim")
    assert rows(similarity.neighbours(e, k), "a", "rank", "b", "sim") == want
    assert similarity.neighbours(e.limit(0), k).count() == 0


def test_collaborative_filtering_by_hand(spark, rows, edges):
    user = rows(recommend.user_cf(edges), "user", "item", "rank", "score")
    assert [(u, i, r, round(s, 6)) for u, i, r, s in user if u == 1] == [(1, 13, 1, 1.0)]
    item = rows(recommend.item_cf(edges), "user", "item", "score")
    assert [(u, i, round(s, 6)) for u, i, s in item if u == 1] == [(1, 13, round(1 / 3 + 2 / 3, 6))]
    assert not {(u, i) for u, i, *_ in user} & set(EDGES)


def test_content_keeps_zeros(spark, rows, edges):
    users, items = spark.createDataFrame([(1,), (5,)], "user long"), spark.createDataFrame([(i,) for i in range(11, 16)], "item long")
    f = spark.createDataFrame([(11, "x", 1.0), (13, "x", 2.0)], "row long, col string, w double")
    got = rows(recommend.content_based(edges, f, "target", users, items), "user", "rank", "item", "score")
    assert [(r, i, round(s, 6)) for u, r, i, s in got if u == 1] == [(1, 13, 1.0), (2, 14, 0.0), (3, 15, 0.0)]
    assert [i for u, r, i, s in got if u == 5] == [11, 12, 13, 14, 15]
    with pytest.raises(ValueError):
        recommend.content_based(edges, f, "both", users, items)


def ways(spark):
    pairs = [(f"U{a}", f"R{b}") for a, b in EDGES]
    return spark.createDataFrame(pairs + [(b, a) for a, b in pairs], "src string, dst string")


@pytest.mark.parametrize(("steps", "epsilon", "want"), [
    (1, 0.0, {"U1": 0.15, "R11": 0.425, "R12": 0.425}),
    (2, 0.0, {"U1": 0.451042, "U2": 0.120417, "U3": 0.301042, "R11": 0.06375, "R12": 0.06375}),
    (5, 1.0, {"U1": 1.0}),
])
def test_walk_by_hand(spark, rows, steps, epsilon, want):
    seeds = spark.createDataFrame([("U1",)], "seed string")
    got = {n: round(x, 6) for _, n, x in rows(walk.personal_rank(ways(spark), seeds, 0.15, steps, epsilon), "seed", "node", "x")}
    assert got == pytest.approx(want, abs=1e-6)


def test_walk_loses_mass_only_at_dead_ends(spark, rows):
    seeds = spark.createDataFrame([("U1",), ("U4",), ("X",)], "seed string")
    got = walk.personal_rank(ways(spark), seeds, 0.15, 6, 1e-9).groupBy("seed").agg(F.sum("x").alias("m"))
    mass = dict(rows(got, "seed", "m"))
    assert mass["U1"] == pytest.approx(1) and mass["U4"] == pytest.approx(1) and mass["X"] == pytest.approx(0.15)


def test_degrees(spark, rows, edges):
    g = graph.graph(edges, "User", "Repository")
    more = graph.Graph(g.nodes.unionAll(spark.createDataFrame([("User", 5), ("Repository", 15)], "type string, id long")), g.edges, "User", "Repository")
    assert rows(graph.degree_histogram(graph.degrees(more))) == [(0, 2), (1, 2), (2, 4), (3, 2)]
    loop = graph.graph(spark.createDataFrame([(1, 1)], "src long, dst long"), "User", "User", directed=True)
    assert rows(graph.degrees(loop), "degree") == [(2,)]
    assert rows(graph.summary(graph.graph(edges.limit(0), "User", "Repository"))) == [("undirected", 0, 0, None)]
    assert graph.nodes_of(g, "Planet") is None and graph.nodes_of(g, "Account").count() == 4


def test_edges_merge_later_wins(spark, rows):
    df = spark.createDataFrame([(1, 2, 5, 1), (1, 2, 7, 2), (1, 2, None, 3), (None, 2, 1, 4), (1, None, 1, 5)], "a long, b long, w long, line long")
    assert rows(graph.edges(df, F.col("a"), F.col("b"), {"w": F.col("w")}, F.col("line"))) == [(1, 2, 7)]


def test_metrics_by_hand(spark, rows):
    recs = spark.createDataFrame([(1, 13, 1), (1, 14, 2)], "user long, item long, rank int")
    train, test = (spark.createDataFrame(x, "user long, item long") for x in ([(1, 11), (1, 12), (2, 11)], [(1, 14), (1, 15), (3, 11)]))
    items = spark.createDataFrame([(i,) for i in range(11, 16)], "item long")
    freq = evaluate.frequencies(recs, train, test, items, [1, 2])
    assert rows(freq) == [(1, 1, 0, 0, 1, 2), (1, 2, 1, 0, 1, 1)]
    assert rows(evaluate.rates(freq), "k", "precision", "recall") == [(1, 0.0, 0.0), (2, 0.5, 0.5)]
    assert rows(evaluate.average_precision(recs, train, test)) == [(1, 0.25)]
    none = evaluate.frequencies(recs.limit(0), train.limit(0), test.limit(0), items, [1])
    assert none.count() == 0 and rows(evaluate.roc_auc(evaluate.rates(none))) == [(0.5,)]
    assert rows(evaluate.mean_average_precision(evaluate.average_precision(recs.limit(0), train.limit(0), test))) == [(None,)]


def test_auc_adds_only_missing_ends(spark, rows):
    rate = spark.createDataFrame([(1, 0.0, 0.4), (2, 0.5, 0.8), (3, None, None)], "k int, fallout double, recall double")
    assert rows(evaluate.roc_auc(rate))[0][0] == pytest.approx(0.5 * 0.6 + 0.5 * 0.9)


def test_split_is_exact_and_repeatable(spark, rows):
    many = spark.range(1, 1001).select((F.col("id") % 37).alias("src"), F.col("id").alias("dst"))
    one, two = (ordering.split_edges(many) for _ in range(2))
    assert one.where("is_train").count() == 800 and rows(one) == rows(two) and rows(ordering.split_edges(many, seed=1)) != rows(one)


def test_numbering(spark, rows):
    df = spark.range(100).select(F.pmod(F.col("id") * 37, F.lit(101)).alias("v"))
    got = rows(ordering.numbered(df, "v"), "n", "v")
    assert [n for n, _ in got] == list(range(100)) and [v for _, v in got] == sorted(v for _, v in got)
    assert ordering.numbered(df.limit(0), "v").count() == 0


def test_slices(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([1],), (None,), ([],)], "a array<long>")
    assert [r[0] for r in df.select(ordering.slices(F.col("a"), 2)).collect()] == [[[1, 2], [2, 3]], [], None, []]


def test_matrix(spark, rows):
    m = spark.createDataFrame([(1, "a", 3.0), (1, "b", 4.0), (2, "a", 0.0)], "row long, col string, w double")
    assert rows(matrix.normalised(m, "l2")) == [(1, "a", 0.6), (1, "b", 0.8), (2, "a", 0.0)]
    assert rows(matrix.row_sums(m)) == [(1, 7.0), (2, 0.0)]
    t = matrix.times(m, matrix.transpose(m))
    assert rows(t.where("w != 0")) == [(1, 1, 25.0)]
    s = matrix.standardised(spark.createDataFrame([(1.0, 2.0), (3.0, 2.0)], "x double, y double"), ["x", "y"])
    assert rows(s) == [(-1.0, 0.0), (1.0, 0.0)]
    assert matrix.standardised(m.select("w").limit(0), ["w"]).count() == 0


def test_dense(spark, rows):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [3.0, 4.0]), (3, [0.0, 0.0])], "id long, v array<float>")
    got = {(a, b): round(s, 6) for a, b, s in rows(similarity.dense(df.where("id < 3"), df, "id", "v", True), "a", "b", "sim")}
    assert got == {(1, 1): 1.0, (1, 2): 0.6, (1, 3): 0.0, (2, 1): 0.6, (2, 2): 1.0, (2, 3): 0.0}


def test_tfidf_counts_empty_text(spark, rows):
    texts = spark.createDataFrame([(1, "The red Fork"), (2, "red red x"), (3, ""), (4, None)], "id long, t string")
    counts = features.term_counts(texts, "id", "t")
    assert rows(counts) == [(1, "fork", 1.0), (1, "red", 1.0), (2, "red", 2.0)]
    assert {(r, c): round(w, 4) for r, c, w in rows(features.tfidf(counts, 4))}[2, "red"] == 1.0
    assert rows(features.term_counts(texts, "id", "t", 1), "col") == [("red",), ("red",)]


def test_cooccurrence_counts_lines(spark, rows):
    df = spark.createDataFrame([(1, {"a": 1, "b": 2}), (2, {"a": 1, "b": None}), (3, {}), (4, None)], "line long, languages map<string,long>")
    assert rows(cooccurrence.language_pairs(df, "line")) == [("a", "b", 2)]
    assert rows(cooccurrence.language_totals(df)) == [("a", 2, 2), ("b", 2, 2)]
    top = cooccurrence.top_languages(cooccurrence.language_totals(df), cooccurrence.language_pairs(df, "line"), 5)
    assert rows(top, "language", "weight_to_first") == [("a", 0), ("b", 2)]


def test_edge_features(spark, rows, edges):
    nodes = spark.createDataFrame([(1, True, 4), (2, False, None)], "id long, hireable boolean, followers long")
    got = edge_features.node_attributes(edges, "src", nodes, ("hireable", "followers"))
    assert got.count() == len(EDGES) and rows(got.agg(F.round(F.avg("followers"), 9), F.round(F.stddev_pop("followers"), 9))) == [(0.0, 1.0)]
    assert edge_features.edge_attributes(edges, ()).columns == ["src", "dst"] and edge_features.combined(edges).columns == ["src", "dst"]
    assert edge_features.combined(edges, edge_features.constant(edges, 2)).first().constant == 2.0
    m = edges.select(F.col("src").alias("row"), F.col("dst").alias("col"), F.lit(1.0).alias("w"))
    source, target = similarity.bigraph_features(m, m, "source")
    assert edge_features.similarities(edges, source, target, 1).count() == len(EDGES)
    with pytest.raises(ValueError):
        edge_features.similarities(edges, source, target, 99)


def test_web(spark):
    def one(c):
        return spark.range(1).select(c.alias("x")).first().x

    assert one(web.path(F.lit("https://a.b/c/d?e=f#g"))) == "/c/d" and one(web.query(F.lit("https://a.b/c/d?e=f#g"))) == "e=f"
    assert one(web.path(F.lit("https://a.b"))) == "" and one(web.path(F.lit(None).cast("string"))) is None
    header = F.lit('<https://x/2>; rel="next", <https://x/9>; REL="Last", rubbish')
    assert one(web.link_header(header)) == {"next": "https://x/2", "last": "https://x/9"} and one(web.has_next(header))
    assert one(web.link_header(F.lit(None).cast("string"))) == {} and not one(web.has_next(F.lit('<u>; rel="prev"')))
    assert one(web.paginated(F.lit("https://x/users/u/starred"))) == "https://x/users/u/starred?per_page=100"
    assert one(web.paginated(F.lit("https://x/users/u/starred?per_page=5"))) == "https://x/users/u/starred?per_page=5"
    assert one(web.paginated(F.lit("https://x/users/u"))) == "https://x/users/u"
    assert one(web.expand("repository_forks", owner=F.lit("a b"), repo=F.lit("c"))) == "/repos/a+b/c/forks" and one(web.expand("nothing")) == ""
    assert tuple(one(web.rate_limit(F.lit("60"), F.lit("x"), F.lit(None).cast("string")))) == (60, 0, 0)
    assert tuple(one(web.repository_parts(F.lit("a/b/c")))) == ("a", "b/c") and tuple(one(web.repository_parts(F.lit("a")))) == ("a", None)
    assert web.options("a:1,b,c:0") == {"a": True, "c": False} and web.options(None) == {}
    assert one(web.sigmoid(F.lit(0.0))) == 0.5 and one(web.falsy_to(F.lit(""), "string", "z")) == "z" and one(web.falsy_to(F.lit(3), "int", 9)) == 3


def test_policy_and_filters(spark, rows):
    assert crawl.policy(":1,user:0")["repository"] and not crawl.policy(":1,user:0")["user"]
    df = spark.createDataFrame([("repository_languages", True), ("repository_languages", None), ("repository_forks", False), ("what", False)], "endpoint string, fork boolean")
    assert [r.visit for r in crawl.with_visit(df, crawl.policy()).collect()] == [False, True, False, False]
    r = spark.createDataFrame([("/a", True, False, 1, False), ("/b", False, True, 5, True), ("/c", False, False, 1, True)], "endpoint string, visit boolean, start boolean, depth int, has_previous_page boolean")
    assert rows(crawl.wanted(r), "endpoint") == [("/a",), ("/b",)] and rows(crawl.wanted(r, 3), "endpoint") == [("/a",)] and rows(crawl.wanted(r, 0, True), "endpoint") == [("/b",)]
    assert rows(crawl.unvisited(r, spark.createDataFrame([("/a",), ("/b",)], "endpoint string")), "endpoint") == [("/b",), ("/c",)]


def test_levels(spark, rows):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 9)], "src long, dst long")
    s = spark.createDataFrame([(1,)], "node long")
    assert rows(crawl.levels(e, s), "node", "depth") == [(1, 0), (2, 1), (3, 2), (4, 3)] and crawl.levels(e, s, 1).count() == 2
