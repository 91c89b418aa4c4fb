"""Queries that do the whole job where their namesakes with SQL stop earlier, against brute force."""

from pathlib import Path

import pytest

from kithgraph.plans import catalog
from kithgraph.plans import relations as R

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


def walked(ways: dict, seed: str, steps: int = 10) -> dict:
    x = {seed: 1.0}
    for _ in range(steps):
        y = {seed: 0.15}
        for n, mass in x.items():
            for m in ways.get(n, ()):
                y[m] = y.get(m, 0) + 0.85 * mass / len(ways[n])
        if max(abs(y.get(n, 0) - x.get(n, 0)) for n in {*x, *y}) < 0.01:
            break
        x = y
    return {n: v for n, v in x.items() if v}


@pytest.mark.parametrize("more", [False, True])
def test_walks_go_ten_steps(spark, more):
    h = R.Holdout(spark, FOLDER)
    pairs = {(f"U{e.src}", f"R{e.dst}") for e in h.train.collect()}
    if more:
        pairs |= {(f"U{e.src}", f"U{e.dst}") for e in R.follow_edges(spark, FOLDER).collect()}
    ways = {}
    for a, b in pairs | {(b, a) for a, b in pairs}:
        ways.setdefault(a, []).append(b)
    users, items, seen = [u.user for u in h.some_users.collect()], [i.item for i in h.items.collect()], {(e.src, e.dst) for e in h.train.collect()}
    want = {u: walked(ways, f"U{u}") for u in users}
    if not more:
        ranks = {(r.seed, r.node): r.x for r in catalog.QUERIES["personal_rank"](spark, FOLDER).collect()}
        assert ranks == pytest.approx({(f"U{u}", n): x for u in users for n, x in want[u].items()}, abs=2e-6)
    name = "rec_random_walk_other_graph" if more else "rec_random_walk"
    got = {(r.user, r["rank"]): r.item for r in catalog.QUERIES[name](spark, FOLDER).collect()}
    for u in users:
        best = sorted((i for i in items if (u, i) not in seen), key=lambda i: (-round(want[u].get(f"R{i}", 0), 9), i))[:10]
        assert [got[u, k + 1] for k in range(len(best))] == best


def test_levels_of_the_whole_query_set_to_the_end(spark):
    ahead = {}
    for e in R.follow_edges(spark, FOLDER).collect():
        ahead.setdefault(e.src, []).append(e.dst)
    depth = {n: 0 for n in ahead if n % R.QUERY_IDS == 0}
    queue = list(depth)
    for n in queue:
        for m in ahead.get(n, ()):
            if m not in depth:
                depth[m] = depth[n] + 1
                queue.append(m)
    got = {r.node: r.depth for r in catalog.QUERIES["bfs_levels_whole"](spark, FOLDER).collect()}
    assert got == depth and len(got) > catalog.QUERIES["bfs_levels"](spark, FOLDER).count()


def sets(edges) -> tuple[dict, dict]:
    of, by = {}, {}
    for a, b in edges:
        of.setdefault(a, set()).add(b)
        by.setdefault(b, set()).add(a)
    return of, by


def test_collaborative_filtering_with_all_neighbours(spark):
    h = R.Holdout(spark, FOLDER)
    train, test = (sets((e.src, e.dst) for e in x.collect())[0] for x in (h.train, h.test))
    _, users_of = sets((u, i) for u in train for i in train[u])
    jaccard = lambda x, y: len(x & y) / len(x | y)
    asked = [u for u in train if u % R.QUERY_IDS == 0]

    def ranked(scores: dict, u: int) -> list:
        return [i for i in sorted(scores, key=lambda i: (-round(scores[i], 9), i)) if i not in train[u] and scores[i] > 0]

    by_user, by_item = {}, {}
    for u in asked:
        one, two = {}, {}
        for v in train:
            if v != u and train[u] & train[v]:
                for i in train[v]:
                    one[i] = one.get(i, 0) + jaccard(train[u], train[v])
        for j in train[u]:
            for i in users_of:
                if i != j and users_of[i] & users_of[j]:
                    two[i] = two.get(i, 0) + jaccard(users_of[i], users_of[j])
        by_user[u], by_item[u] = ranked(one, u), ranked(two, u)
    for name, want in (("rec_user_cf_whole", by_user), ("rec_item_cf_whole", by_item)):
        got = {}
        for r in sorted(catalog.QUERIES[name](spark, FOLDER).collect(), key=lambda r: r["rank"]):
            got.setdefault(r.user, []).append(r.item)
        assert got == {u: x for u, x in want.items() if x}
        assert max(map(len, got.values())) > 20
    ap = {}
    for u in asked:
        if u in test:
            hits = [k + 1 for k, i in enumerate(by_user[u]) if i in test[u]]
            ap[u] = sum((n + 1) / k for n, k in enumerate(hits)) / len(test[u])
    assert {r.user: r.ap for r in catalog.QUERIES["average_precision_whole"](spark, FOLDER).collect()} == pytest.approx(ap, abs=2e-6)
    report = catalog.QUERIES["metric_report_whole"](spark, FOLDER).collect()
    assert {r.k for r in report} == {5, 10, 20} and report[0].map == pytest.approx(sum(ap.values()) / len(ap), abs=2e-6)


def test_hot_neighbours_are_dealt_to_blocks(spark, rows, monkeypatch):
    import random

    from kithgraph.operators import matrix, similarity, skew, walk

    random.seed(4)
    pairs = sorted({(s, 0) for s in range(40) if random.random() < 0.8} | {(random.randrange(40), random.randrange(1, 9)) for _ in range(120)})
    edges = spark.createDataFrame(pairs, "src long, dst long")
    sets = {s: {d for t, d in pairs if t == s} for s, _ in pairs}
    want = {(a, b): len(x & y) / len(x | y) for a, x in sets.items() for b, y in sets.items() if a < b and x & y}

    def all_pairs():
        classes = similarity.set_classes(edges)
        return {(r.a, r.b): r.sim for r in similarity.jaccard(edges, classes).collect()}, {r.src: r.class_id for r in classes.collect()}

    plain = all_pairs()
    monkeypatch.setattr(similarity, "PAIR_ROWS", 3)
    monkeypatch.setattr(similarity, "TASK_PAIRS", 50)
    dealt = all_pairs()
    assert plain == dealt
    heads = set(dealt[1].values())
    assert dealt[0] == {k: pytest.approx(v) for k, v in want.items() if set(k) <= heads}
    near = similarity.neighbours(edges, 5)
    best = {a: sorted(((-round(want.get((min(a, b), max(a, b)), 0), 9), b) for b in sets if b != a and (min(a, b), max(a, b)) in want))[:5] for a in sets}
    got = {}
    for r in near.collect():
        got.setdefault(r.a, []).append((-round(r.sim, 9), r.b))
    assert {a: sorted(v) for a, v in got.items()} == {a: v for a, v in best.items() if v}

    few = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, None)], "i int, k string")
    many = spark.createDataFrame([("x" if j % 3 else "y", j) for j in range(50)] + [(None, 99)], "k string, j int")
    expect = rows(few.join(many, "k"))
    assert rows(skew.dealt_join(few, many, "k", rows=4)) == expect == rows(skew.dealt_join(few, many, "k"))
    assert skew.dealt_join(few, many.limit(0), "k", 4).count() == 0

    ways = spark.createDataFrame([(f"U{a}", f"R{b}") for a, b in pairs] + [(f"R{b}", f"U{a}") for a, b in pairs], "src string, dst string")
    seeds = spark.createDataFrame([("U1",), ("U2",), ("nobody",)], "seed string")
    ranks = lambda: [(a, b, round(x, 12)) for a, b, x in rows(walk.personal_rank(ways, seeds))]
    whole = ranks()
    monkeypatch.setattr(walk, "DEAL_ROWS", 4)
    assert ranks() == whole
    m = spark.createDataFrame([(s, d, 1.0 + s) for s, d in pairs], "row long, col long, w double")
    assert rows(matrix.dot(m, m), "a", "b", "sim") == rows(matrix.times(m, matrix.transpose(m)), "row", "col", "w")
