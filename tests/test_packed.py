"""Work on asked rows in one task each, against the relational way, and queries that must not move their pairs."""

import hashlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from kithgraph.operators import digests, matrix, ml, packed, recommend, similarity, walk
from kithgraph.plans import catalog

FOLDER = "/root/testdata/sf0.001"
#: Queries that pair asked rows with all others, by finding.
PAIRED = {"F1": "bigraph_similarity_ss", "F18": "jaccard_user", "F4": "precision_recall_whole", "F6": "rec_language", "F14": "rec_random", "F24": "rec_random_walk", "F2": "experiment_report", "F9": "recommend_all", "F10": "roc_curve_whole", "F11": "average_precision_whole", "F12": "bigraph_similarity_st", "F17": "frequencies_whole", "F19": "metric_report_whole", "F20": "pr_curve_whole", "F16": "bigraph_similarity_tt", "F5": "rec_followee", "F7": "rec_quasi_user", "F21": "rec_description", "F23": "rec_quasi_item", "F13": "rec_nmf", "F22": "rec_item_cf_whole", "F3": "personal_rank", "F8": "rec_random_walk_other_graph"}


@pytest.fixture
def unmoved(monkeypatch):
    """The operators that shuffle pairs aren't called."""

    def moved(*_, **__):
        raise AssertionError("pairs are moved")

    for module, name in ((recommend, "with_zeros"), (recommend, "grid"), (matrix, "dot"), (similarity, "neighbours_of"), (similarity, "met"), (walk, "_joined")):
        monkeypatch.setattr(module, name, moved)


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")
@pytest.mark.parametrize("name", PAIRED.values(), ids=PAIRED)
def test_pairs_are_not_moved(spark, unmoved, name):
    assert catalog.QUERIES[name](spark, FOLDER).count() > 0


@pytest.fixture
def both_ways(rows, monkeypatch):
    """Results of a function with tables that may be sent and with none that may."""

    def run(f, *columns):
        sent = rows(f(), *columns)
        with monkeypatch.context() as m:
            m.setattr(packed, "ENTRIES", 0)
            moved = rows(f(), *columns)
        same = [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in sent]
        assert same == [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in moved]
        return same

    return run


@pytest.fixture(scope="module")
def train(spark):
    r = np.random.default_rng(3)
    pairs = {(u, 100) for u in range(30)} | {(int(u), 100 + int(i)) for u, i in r.integers(0, 30, (90, 2))}
    return spark.createDataFrame(sorted(pairs), "src long, dst long")


@pytest.fixture(scope="module")
def users(spark):
    return spark.createDataFrame([(0,), (7,), (77,)], "user long")


def test_products_with_asked_rows_are_the_same_both_ways(spark, both_ways):
    r = np.random.default_rng(5)
    cells = {(int(i), f"c{j}"): float(w) for i, j, w in zip(r.integers(0, 40, 200), r.integers(0, 12, 200), r.random(200))} | {(3, "c1"): -0.5, (4, "c1"): 0.0}
    m = spark.createDataFrame([(i, c, w) for (i, c), w in cells.items()], "row long, col string, w double")
    for b in (m, m.where("w > 0"), m.limit(0)):
        found = both_ways(lambda: matrix.dot_of(m.where("row % 5 = 0"), b, 6), "a", "b", "sim")
        assert bool(found) == (b.count() > 0)


def test_pairs_of_classes_are_the_same_both_ways(spark, train, both_ways):
    for edges in (train, train.selectExpr("dst AS src", "src AS dst"), train.limit(0)):
        classes = similarity.set_classes(edges)
        for digits in (None, 6):
            found = both_ways(lambda: similarity.jaccard(edges, classes, digits), "a", "b", "sim")
            assert bool(found) == (edges.count() > 0)


def test_collaborative_filtering_is_the_same_both_ways(spark, train, users, both_ways):
    columns = "user", "rank", "item", "score"
    for n in (None, 3):
        assert both_ways(lambda: recommend.user_cf_of(train, users, n), *columns)
        assert both_ways(lambda: recommend.item_cf_of(train, users, n), *columns)
    also = spark.createDataFrame([(0, 129), (7, 128), (7, 127), (77, 100), (0, 5)], "user long, item long")
    found = both_ways(lambda: recommend.user_cf_of(train, users, 2, also), *columns)
    whole = {(u, i): r for u, r, i, _ in both_ways(lambda: recommend.user_cf_of(train, users), *columns)}
    asked = {(0, 129), (7, 128), (7, 127)} & set(whole)
    assert {(u, i): r for u, r, i, _ in found} == {k: r for k, r in whole.items() if r <= 2 or k in asked}


@pytest.mark.parametrize("side", ["source", "target"])
def test_content_is_the_same_both_ways(spark, train, users, both_ways, side):
    r = np.random.default_rng(8)
    ids = range(30) if side == "source" else range(100, 135)
    features = spark.createDataFrame([(i, f"c{int(j)}", float(w)) for i in ids for j, w in zip(r.choice(9, 2, replace=False), r.random(2))], "row long, col string, w double")
    items = spark.createDataFrame([(i,) for i in range(100, 133)], "item long")
    for n in (4, None):
        assert both_ways(lambda: recommend.content_based(train, features, side, users, items, n), "user", "rank", "item", "score")


def test_random_items_are_the_same_both_ways(spark, train, users, both_ways):
    items = spark.createDataFrame([(i,) for i in [*range(-3, 140), 10**6, 2**62]], "item long")
    for n in (5, 400):
        assert both_ways(lambda: recommend.random_items(train, users, items, 7, n), "user", "rank", "item", "score")


@pytest.mark.parametrize("head", ["", "42:7:", "42:10028455:", "1:-999999999999999999:", "x" * 50])
def test_first_words_of_hashes(head):
    numbers = np.array([0, 5, -3, 99, 100, 10**18, -(10**18), 2**62, *range(1000, 12_000)])
    want = [hashlib.md5(f"{head}{x}".encode()).hexdigest()[:8] for x in numbers.tolist()]
    assert [f"{x:08x}" for x in digests.first_words(head.encode(), numbers, {}).tolist()] == want


def test_walks_are_the_same_both_ways(spark, train, users, both_ways, monkeypatch):
    monkeypatch.setattr(walk, "HUB", 4)
    name = lambda k, c: F.concat(F.lit(k), F.col(c).cast("string"))
    ways = train.select(name("U", "src").alias("src"), name("R", "dst").alias("dst"))
    ways = ways.unionAll(ways.select("dst", "src"))
    seeds, items = users.select(name("U", "user").alias("seed")), spark.createDataFrame([(i,) for i in range(100, 133)], "item long")
    for steps, epsilon in ((10, 0.01), (3, 0.0), (6, 0.05)):
        assert both_ways(lambda: walk.personal_rank(ways, seeds, 0.15, steps, epsilon), "seed", "node", "x")
        assert both_ways(lambda: recommend.walked(ways, train, users, items, 0.15, steps, epsilon, 6), "user", "rank", "item", "score")


def test_lists_by_factors_are_whole_without_moving_pairs(spark, train, users, unmoved):
    items = spark.createDataFrame([(i,) for i in range(100, 133)], "item long")
    found = ml.nmf_recommend(train, users, items, 3, 5).collect()
    own = {(r.src, r.dst) for r in train.collect()}
    assert len(found) == 15 and not {(r.user, r["item"]) for r in found} & own
    assert [r["item"] for r in sorted((r for r in found if r.user == 77), key=lambda r: r["rank"])] == [100, 101, 102, 103, 104]
