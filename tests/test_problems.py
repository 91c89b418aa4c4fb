import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kithgraph.operators import forest, shred, skew
from kithgraph.operators.current import current_values


def test_counts_ignore_nulls_and_repeats(spark, rows):
    df = spark.createDataFrame([(1, 5), (1, 5), (1, 6), (2, None), (None, 7), (3, 5)], "key long, other long")
    assert rows(skew.distinct_others(df, ["key"], "other")) == [(1, 2), (3, 1)]
    assert skew.distinct_others(df.limit(0), ["key"], "other").count() == 0


def test_dominant_takes_equality(spark, rows):
    df = spark.createDataFrame([("a", 1, 2), ("a", 2, 98), ("b", 1, 1)], "g string, key long, n long")
    assert rows(skew.dominant(df, "g", "n", 50), "g", "key") == [("a", 1), ("a", 2), ("b", 1)]
    assert rows(skew.dominant(df.where("key = 1 or n > 98"), "g", "n", 2), "g", "key") == [("a", 1), ("b", 1)]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_join_is_a_join(spark, rows, how):
    left = spark.createDataFrame([(0, i) for i in range(300)] + [(i, i) for i in range(50)] + [(None, 1), (77, 1)], "k long, v long")
    right = spark.createDataFrame([(i, str(i)) for i in range(60)], "k long, w string")
    assert rows(skew.lookup_join(left, right, "k", how, parts=4), "k", "v", "w") == rows(left.join(right, "k", how), "k", "v", "w")


def test_current_value_rule(spark, rows):
    data = [
        (1, "2023-01-01 00:00:00", True, 1, "old"),
        (1, "2023-02-01 00:00:00", False, 2, "short"),
        (1, "2023-02-01 00:00:00", True, 3, "full"),
        (1, "2023-03-01 00:00:00", True, 4, "  "),
        (2, None, False, 5, "x"),
        (2, None, False, 6, "y"),
        (3, None, None, 7, None),
        (None, "2024-01-01 00:00:00", True, 8, "nobody"),
    ]
    df = spark.createDataFrame(data, "id long, u string, f boolean, line long, v string")
    got = current_values(df, F.col("id"), {"v": F.col("v")}, F.col("u").cast("timestamp"), F.col("f"), F.col("line"))
    assert rows(got, "id", "n_rows", "v", "v__line") == [(1, 4, "full", 3), (2, 2, "y", 6), (3, 1, None, None)]


def walk(parent: dict) -> dict:
    """Brute force: id to (root, depth)."""
    out = {}
    for n in parent:
        path = [n]
        while path[-1] in parent:
            nxt = parent[path[-1]]
            if nxt in path:
                out[n] = (min(path[path.index(nxt) :]), -1)
                break
            path.append(nxt)
        else:
            out[n] = (path[-1], len(path) - 1)
    return out


def forests() -> list[dict]:
    r = random.Random(3)
    chain = {i: i + 1 for i in range(60)}
    star = {i: 1000 for i in range(100, 200)} | {1000: 1001}
    ring = {500: 501, 501: 502, 502: 500, 503: 500, 504: 503, 600: 600, 601: 600}
    wild = {i: r.randrange(2000, 2090) for i in range(2000, 2080)}
    return [chain, star, ring, chain | star | ring | wild]


@pytest.mark.parametrize("parent", forests())
@pytest.mark.parametrize("task_links", [1_000_000, 12])
def test_forest_as_brute_force(spark, rows, parent, task_links):
    if task_links < 100 and len(parent) < 80:
        pytest.skip("nothing to merge")
    links = spark.createDataFrame([(k, v, "x") for k, v in parent.items()], "node long, parent long, root string")
    got = {r.node: (r.root, r.depth) for r in forest.resolve(links, task_links=task_links).collect()}
    assert got == walk(parent)


def test_many_long_circles_need_doubling(spark):
    parent = {c * 100 + i: c * 100 + (i + 1) % 30 for c in range(6) for i in range(30)}
    links = spark.createDataFrame(list(parent.items()), "node long, parent long")
    assert {r.node: (r.root, r.depth) for r in forest.resolve(links, task_links=10).collect()} == walk(parent)


@pytest.mark.parametrize("task_links", [60, 90, 130])
def test_tails_on_small_circles(spark, task_links):
    """A circle is often solved in one task before its tail, which lies in another, is merged: the tail keeps its least id and has no depth."""
    ids = random.Random(5).sample(range(10_000), 300)
    parent = {}
    for leaf, x, y, *ring in (ids[i : i + 5] for i in range(0, 300, 5)):
        z, w = sorted(ring, reverse=True)
        parent |= {leaf: x, x: y, y: z, z: w, w: z}
    found = forest.resolve(spark.createDataFrame(list(parent.items()), "node long, parent long"), task_links=task_links)
    assert {r.node: (r.root, r.depth) for r in found.collect()} == walk(parent)


def test_forest_nulls_repeats_and_nothing(spark, rows):
    links = spark.createDataFrame([(1, 2), (1, 2), (1, 9), (None, 3), (4, None)], "node long, parent long")
    assert rows(forest.resolve(links), "node", "root", "depth") == [(1, 2, 1)]
    none = forest.resolve(links.limit(0))
    assert none.count() == 0 and forest.paths(none).count() == 0


def test_paths_and_descendants(spark, rows):
    links = spark.createDataFrame([(i, i - 1) for i in range(2, 9)] + [(20, 21), (21, 20)], "node long, parent long")
    paths = forest.paths(forest.resolve(links))
    got = {r.node: r.path for r in paths.collect()}
    assert got[8] == list(range(1, 9)) and got[2] == [1, 2] and got[20] is None
    below = rows(forest.descendants(paths), "ancestor", "node", "distance")
    assert len(below) == 7 * 8 // 2 and (1, 8, 7) in below and (7, 8, 1) in below


def test_jump_on_nothing():
    empty = np.zeros(0, np.int64)
    assert len(forest.jump(empty, empty, empty, empty)[0]) == 0


JSONS = [
    (1, '{"sha":"a","repo":{"id":1},"parents":[{"sha":"p"},null,{"x":1},{"sha":"q"}],"n":null,"f":true}'),
    (2, '[{"sha":"b","repo":{"id":2}}, 7, {"sha":"c","parents":[]}]'),
    (3, '{"repo":{"id":9},"page":{"no":1,"commits":[{"sha":"d","repo":{"id":3},"parents":[{"sha":"a"}]},null]}}'),
    (4, '{"sha":"e","repo":{"id'),
    (5, None),
    (6, ""),
    (7, "null"),
    (8, '"text"'),
    (9, "[" * 100_000),
    (10, '{"sha":"\\ud800x","repo":{"id":4.0},"sha":"last"}'),
    (11, '{"sha":"' + "y" * 300_000 + '"}'),
]


def test_json_records(spark, rows):
    df = spark.createDataFrame([(k, t, "clash") for k, t in JSONS], "line long, payload string, value string")
    records = shred.json_records(df, "line", "payload", ("", "[]", "page.commits[]"), ["repo.id", "sha", "parents[].sha", "n", "f"], {"repo.id": "repo.id"})
    flat = shred.root_columns(records, {"repo": "repo.id", "sha": "sha", "f": "f"})
    parents = {}
    for r in shred.group_table(flat.withColumns({"k": F.col("key"), "r": F.col("record")}), ["k", "r"], "parents[]", {"p": "parents[].sha"}).collect():
        parents.setdefault((r.k, r.r), []).append((r.ordinals[0], r.p))
    got = {(r["key"], r.record): (r.repo, (r.sha or "")[:5], r.f, sorted(parents.get((r["key"], r.record), []))) for r in flat.collect()}
    assert got[1, 0] == ("1", "a", "true", [(0, "p"), (3, "q")])
    assert got[2, 0] == ("2", "b", None, []) and got[2, 1] == (None, "c", None, [])
    assert got[3, 1] == ("9", "d", None, [(0, "a")])
    assert got[10, 0] == ("4.0", "last", None, []) and got[11, 0][1] == "yyyyy"
    assert {k for k, _ in got} == {1, 2, 3, 10, 11}
    assert shred.json_records(df.limit(0), "line", "payload", ("",), ["sha"]).count() == 0


def test_arrays_in_arrays(spark, rows):
    text = '{"id":7,"files":[{"name":"x","hunks":[{"at":1,"lines":["a",null,"b"]},{"at":2,"lines":[]}]},null,{"name":"y","hunks":[{"lines":["c"]}]}]}'
    paths = ["id", "files[].name", "files[].hunks[].at", "files[].hunks[].lines[]"]
    df = spark.createDataFrame([(1, text), (2, "[" * 50_000 + "]" * 50_000), (3, '{"files":[' * 20_000)], "k long, t string")
    raw = shred.root_columns(shred.json_records(df, "k", "t", ("",), paths), {"id": "id"})
    typed = df.where("k = 1").select("k", F.from_json("t", "id long, files array<struct<name:string,hunks:array<struct<at:int,lines:array<string>>>>>").alias("d")).select("k", "d.*")
    typed = shred.root_columns(shred.typed_records(typed, F.col("k"), paths), {"id": "id"})
    for records in (raw, typed):
        of = lambda group, **columns: [(r[0], list(r[1]), *r[2:]) for r in sorted(map(tuple, shred.group_table(records, ["id"], group, columns).collect()), key=str)]
        assert of("files[]", name="files[].name") == [("7", [0], "x"), ("7", [2], "y")]
        assert of("files[].hunks[]", at="files[].hunks[].at") == [("7", [0, 0], "1"), ("7", [0, 1], "2")]
        assert of("files[].hunks[].lines[]", line="files[].hunks[].lines[]") == [("7", [0, 0, 0], "a"), ("7", [0, 0, 2], "b"), ("7", [2, 0, 0], "c")]
    pairs = shred.json_records(spark.createDataFrame([(1, '{"p":[{"a":1,"b":2},{"b":3},{}]}')], "k long, t string"), "k", "t", ("",), ["p[].a", "p[].b"])
    assert rows(shred.group_table(pairs, ["key"], "p[]", {"a": "p[].a", "b": "p[].b"}), "ordinals", "a", "b") == [([0], "1", "2"), ([1], None, "3")]
    assert rows(raw, "key") == [(1,)]


NAMES = st.sampled_from(["a", "b", "c"])
VALUES = st.recursive(st.none() | st.booleans() | st.integers(-5, 10**20) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=4), lambda v: st.lists(v, max_size=3) | st.dictionaries(NAMES, v, max_size=3), max_leaves=25)


def leaves_of(node, steps, places=()):
    for i, s in enumerate(steps):
        if s == "[]":
            for n, e in enumerate(node if isinstance(node, list) else ()):
                yield from leaves_of(e, steps[i + 1 :], (*places, n))
            return
        if not isinstance(node, dict) or s not in node:
            return
        node = node[s]
    if isinstance(node, bool):
        yield places, "true" if node else "false"
    elif isinstance(node, str | int | float):
        yield places, node if isinstance(node, str) else repr(node)


def test_rows_that_a_join_needs(spark, rows):
    df = spark.createDataFrame([(i % 50, f"t{i}") for i in range(200)] + [(None, "n")], "id long, t string")
    keys = spark.createDataFrame([(3,), (3,), (7,), (99,), (None,)], "id long")
    for buckets in (1, 8, 1 << 18):
        some = skew.likely_in(df, keys, "id", buckets)
        assert some.columns == ["id", "t"] and rows(some.join(keys.distinct(), "id")) == rows(df.join(keys.distinct(), "id"))
    assert skew.likely_in(df, keys, "id").count() == 8 and skew.likely_in(df, keys.limit(0), "id").count() == 0


@settings(max_examples=300, deadline=None)
@given(VALUES, st.sampled_from([None, 0, 2]), st.booleans(), st.integers(0, 60))
def test_token_stream_by_the_whole_document(doc, indent, ascii_only, cut):
    paths = ["a", "b.c", "a[]", "a[].b", "a[][].c", "b[].a[]"]
    shredder = shred.Shredder(("", "[]", "c.a[]"), paths, {"b.a": "a"})
    text = json.dumps(doc, indent=indent, ensure_ascii=ascii_only)
    want = []
    for steps in ((), ("[]",), ("c", "a", "[]")):
        level = [doc]
        for s in steps:
            level = [e for x in level for e in (x if isinstance(x, list) else ())] if s == "[]" else [x[s] for x in level if isinstance(x, dict) and s in x]
        for r in level:
            if isinstance(r, dict):
                own = {(p, places): v for p in paths for places, v in leaves_of(r, shred._steps(p))}
                if steps:
                    own |= {("a", ()): v for _, v in leaves_of(doc, ("b", "a"))}
                want.append(own)
    assert shredder.records(text) == want
    part = text[: len(text) - 1 - cut % max(1, len(text))]
    try:
        json.loads(part)
    except ValueError:
        assert shredder.records(part) == []


@pytest.mark.parametrize("text", ["[1,]", "{,}", '{"a":1,}', '{"a"}', '{"a":}', "[1 2]", "[1}", "{]", '{"a":1]', "[01]", "[1.]", "nul", '["' + chr(92) + 'x"]', '{"a":1} x', '[tru e]', '{"a" "b"}', ":", ",", "]", '{1:2}', '["a' + chr(10) + '"]', "[NaN]", ""])
def test_what_is_no_json(text):
    assert shred.Shredder(("", "[]"), ["a"], {}).records(text) == []


def test_repeated_names_in_a_record():
    of = lambda text, paths: shred.Shredder(("", "p.c[]"), paths, {"r": "r"}).records(text)
    assert of('{"a":[{"b":1},{"b":2}],"a":[{"b":3}]}', ["a[].b"]) == [{("a[].b", (0,)): "3"}]
    assert of('{"a":[{"b":1}],"a":null}', ["a[].b"]) == [{}] and of('{"a":1,"a":{"x":2}}', ["a"]) == [{}]
    assert of('{"p":{"c":[{"a":1}]},"p":{"c":[{"a":2},{"a":3,"a":4}]},"r":5,"r":[]}', ["a"]) == [{}, {("a", ()): "2"}, {("a", ()): "4"}]
    assert shred.Shredder(("x[].y",), ["z[]"], {}).records('{"x":[{"y":{"z":[1]}},{"y":{"z":[2]},"y":{"z":[3,4]}}]}') == [{("z[]", (0,)): "1"}, {("z[]", (0,)): "3", ("z[]", (1,)): "4"}]


def test_typed_children_and_groups(spark, rows):
    df = spark.createDataFrame([(1, [("a",), None, (None,)]), (2, []), (3, None)], "id long, parents array<struct<sha:string>>")
    got = rows(shred.child_table(df, {"key": F.col("id")}, "parents", {"sha": "sha"}))
    assert got == [(1, 0, "a"), (1, 1, None), (1, 2, None)]
    assert shred.groups(df.schema) == {"": ["id"], "parents[]": ["parents[].sha"]}
