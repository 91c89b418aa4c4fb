import json

import pytest
from pyspark.sql import functions as F

from kithgraph.operators import graph
from kithgraph.operators.crawl import request_state
from kithgraph.sources import jsonl, reports
from kithgraph.sources.schemas import ITEMS
from kithgraph.streaming import ingest


def write(path, lines):
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))


def test_items_drop_undeclared_and_keep_order(spark, rows, tmp_path):
    write(tmp_path / "Contributor.jsonl", [{"repo": {"id": 1, "name": "x"}, "user": {"id": 2}, "contributions": 3, "odd": 1}, {"repo": None, "user": {}}, "{broken", {"repo": {"id": 1}, "user": {"id": 2}, "contributions": 9}])
    df = jsonl.read_items(spark, str(tmp_path), "Contributor")
    assert df.columns == ["repo", "user", "contributions", "line_no"]
    assert rows(graph.edges(df, F.col("user.id"), F.col("repo.id"), {"c": F.col("contributions")}, F.col("line_no"))) == [(2, 1, 9)]
    assert jsonl.read_items(spark, str(tmp_path), "Contributor", F.col("contributions") > 5).count() == 1


def test_summary_overrides_full(spark, rows):
    df = spark.createDataFrame([(1, "full", "a", 1), (1, None, "b", 2), (1, "late", None, 3), (None, "x", "x", 4)], "id long, name string, blog string, rank int")
    assert rows(jsonl.merge_entities(df, "id", F.col("rank")), "id", "name", "blog") == [(1, "late", "b")]
    assert rows(jsonl.last_rows(df, F.col("id"), F.col("rank"), b=F.col("blog"))) == [(1, None)]


def test_append_and_read(spark, tmp_path):
    items = spark.createDataFrame([((1,), (2,), "x")], "repo struct<id:long>, user struct<id:long>, odd string")
    for _ in range(2):
        jsonl.append_items(items, str(tmp_path), "Stargazer")
    assert jsonl.read_items(spark, str(tmp_path), "Stargazer").count() == 2


def test_graph_files(spark, rows, tmp_path):
    g = graph.graph(spark.createDataFrame([(1, 10), (2, 10), (2, 11)], "src long, dst long"), "User", "Repository")
    reports.write_graph(g, str(tmp_path / "p"))
    reports.write_json_graph(g, str(tmp_path / "j"))
    for back in (reports.read_graph(spark, str(tmp_path / "p")), reports.read_json_graph(spark, str(tmp_path / "j"), "User", "Repository")):
        assert rows(back.nodes) == rows(g.nodes) and rows(back.edges) == rows(g.edges) and not back.directed


def test_unknown_nodes_go_with_their_links(spark, rows, tmp_path):
    nodes = [{"id": {"type": "User", "id": 1}}, {"id": {"type": "Planet", "id": 2}}, {"id": {"type": "Repository", "id": 3}}]
    (tmp_path / "g.json").write_text(json.dumps({"directed": False, "multigraph": False, "nodes": nodes, "links": [{"source": 0, "target": 1}, {"source": 2, "target": 0}]}))
    g = reports.read_json_graph(spark, str(tmp_path / "g.json"), "User", "Repository")
    assert rows(g.nodes) == [("Repository", 3), ("User", 1)] and rows(g.edges) == [(1, 3)]


def test_report_round_trip(spark, rows, tmp_path):
    recs = spark.createDataFrame([(1, 1, 5, 0.5)], "user long, rank int, item long, score double")
    pairs, items = spark.createDataFrame([(1, 4)], "user long, item long"), spark.createDataFrame([(4,), (5,)], "item long")
    reports.write_report(str(tmp_path / "r"), {"name": "x", "n": 3}, recs, pairs, pairs, items)
    back = reports.read_report(spark, str(tmp_path / "r"))
    assert back["parameters"] == {"name": "x", "n": 3} and rows(back["recs"]) == rows(recs) and rows(back["items"]) == rows(items)
    reports.write_json_report(str(tmp_path / "j"), recs, pairs, pairs)
    assert json.loads(spark.read.text(str(tmp_path / "j")).first()[0]) == {"user": 1, "training": [4], "recommended": [5], "groundtruth": [4]}


def test_schemas_name_every_item():
    assert len(ITEMS) == 12 and ITEMS["Account"]["id"].dataType.typeName() == "long"


@pytest.fixture
def arriving(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder / "1.json", [{"item": "S", "id": 1}, {"item": "S", "id": 1}, {"item": "T", "id": 1}])
    write(folder / "2.json", [{"item": "S", "id": 1}, {"item": "S", "id": 2}])
    return folder


def test_stream_of_first_items_survives_a_restart(spark, rows, arriving, tmp_path):
    def run():
        stream = ingest.first_seen(ingest.read_folder(spark, str(arriving), spark.createDataFrame([], "item string, id long").schema, files=1), ["item", "id"])
        ingest.append(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        return rows(spark.read.schema("item string, id long").json(str(tmp_path / "out")))

    assert run() == [("S", 1), ("S", 2), ("T", 1)]
    write(arriving / "3.json", [{"item": "S", "id": 1}, {"item": "S", "id": 3}])
    assert run() == [("S", 1), ("S", 2), ("S", 3), ("T", 1)]


def test_stream_and_batch_agree_on_request_state(spark, rows, tmp_path):
    schema = "endpoint string, order long, status int, has_next boolean"
    data = [("/a", 1, 200, True), ("/b", 2, 200, False), ("/a", 3, 500, False), ("/b", 4, 200, True), ("/a", 5, 200, True), ("/", 6, 200, False), ("/c", 7, 404, False), ("/a", 8, 200, False)]
    folder = tmp_path / "in"
    for i, part in enumerate((data[:3], data[3:6], data[6:])):
        spark.createDataFrame(part, schema).coalesce(1).write.json(str(folder / f"{i}"))
    for i in range(3):
        for p in (folder / f"{i}").glob("part-*.json"):
            p.rename(folder / f"{i}.json")
    stream = ingest.request_states(ingest.read_folder(spark, str(folder), spark.createDataFrame([], schema).schema, files=1))
    query = stream.writeStream.format("memory").queryName("states").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    last = spark.table("states").groupBy("endpoint").agg(F.max(F.struct("pages", "state")).alias("m")).select("endpoint", "m.state", "m.pages")
    assert rows(last) == rows(request_state(spark.createDataFrame(data, schema)))


def test_late_rows_are_dropped_after_the_watermark(spark, rows, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder / "1.json", [{"ts": "2024-01-01 00:00:10", "k": "a"}, {"ts": "2024-01-01 00:05:00", "k": "a"}])
    schema = spark.createDataFrame([], "ts timestamp, k string").schema
    counts = ingest.counts_by_window(ingest.read_folder(spark, str(folder), schema, files=1), "ts", "k", "1 minute", "1 minute")
    query = counts.writeStream.format("memory").queryName("windows").outputMode("append").start()
    query.processAllAvailable()
    write(folder / "2.json", [{"ts": "2024-01-01 00:00:20", "k": "a"}, {"ts": "2024-01-01 00:09:00", "k": "b"}])
    query.processAllAvailable()
    query.stop()
    assert rows(spark.table("windows"), "k", "n") == [("a", 1), ("a", 1)]


def test_modes_and_written_nulls(spark, rows):
    df = spark.createDataFrame([(1, "A", "full", 1), (1, "ASummary", "short", 0), (2, "A", None, 2)], "id long, item string, name string, line_no int")
    of = lambda mode: rows(jsonl.merge_entities(jsonl.entity_rows(df, "ASummary", mode).select("id", "name", "rank"), "id", F.col("rank")), "id", "name")
    assert of("both") == [(1, "short"), (2, None)] and of("full") == [(1, "full"), (2, None)] and of("summary") == [(1, "short")]
    with pytest.raises(ValueError):
        jsonl.entity_rows(df, "ASummary", "none")
    lines = spark.createDataFrame([('{"id":1,"a":"x","b":2}', 1), ('{"id":1,"a":null}', 2), ('{"id":1,"c":[1]}', 3), ('{"id":"x","a":1}', 4), ("nothing", 5), (None, 6), ('{"a":1}', 7)], "t string, n int")
    assert [(r.id, r.fields) for r in jsonl.merge_documents(lines, "t", F.col("n")).collect()] == [(1, {"id": "1", "a": None, "b": "2", "c": "[1]"})]
    assert jsonl.merge_documents(lines.limit(0), "t", F.col("n")).count() == 0


def test_queue_survives_a_restart(spark, rows, tmp_path):
    from kithgraph.sources.queue import StartQueue

    requests = spark.createDataFrame([("/b",), ("/a",), ("/a",), (None,)], "path string")
    assert StartQueue(spark, str(tmp_path / "q")).fill(requests, "path")
    again = StartQueue(spark, str(tmp_path / "q"))
    assert not again.fill(requests.limit(1), "path")
    first = again.next(2)
    assert rows(first, "position", "path") == [(0, None), (1, "/a")]
    again.done(first)
    again.done(first)
    assert rows(StartQueue(spark, str(tmp_path / "q")).waiting(), "position", "path") == [(2, "/a"), (3, "/b")]


def test_recorded_pages_as_a_source(spark, rows, tmp_path):
    from kithgraph.sources.connector import FolderTransport, PageSource

    record = FolderTransport(str(tmp_path)).record
    record("https://x/a", 200, {"Link": '<https://x/a?page=2&ids=1,2>; rel="next", <https://x/a?page=9>; rel="last"'}, "[1]")
    record("https://x/a?page=2&ids=1,2", 200, {"link": "<https://x/a>; rel=next"}, "[2]")  # a circle ends
    record("https://x/b", 500, {"Link": '<https://x/a>; rel="next"'}, "")
    spark.dataSource.register(PageSource)
    df = spark.read.format("api_pages").option("folder", str(tmp_path)).option("urls", "https://x/a\nhttps://x/b\nhttps://x/none").load()
    assert rows(df, "start", "page", "status", "body") == [("https://x/a", 1, 200, "[1]"), ("https://x/a", 2, 200, "[2]"), ("https://x/b", 1, 500, ""), ("https://x/none", 1, 404, None)]


def test_a_local_checkpoint_folder_only_for_a_local_master():
    from kithgraph.session import shared_folder

    assert shared_folder("hdfs://x/y", "yarn") == "hdfs://x/y" and shared_folder(None, "local[8]") and shared_folder(None, "local")
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(ValueError):
            shared_folder(None, master)


@pytest.mark.parametrize("missing", ["kithgraph.llm", "ahocorasick"])
def test_only_the_subpackage_itself_may_be_missing(missing):
    import subprocess
    import sys
    from pathlib import Path

    code = f"""
import sys
class Absent:
    def find_spec(self, name, path=None, target=None):
        if name == {missing!r}:
            raise ModuleNotFoundError("absent", name=name)
sys.meta_path.insert(0, Absent())
import __spark_entry__ as e
print("p1_found" in e.queries(), "p2_found" in e.queries())
"""
    root = Path(__file__).resolve().parents[1]
    if missing == "ahocorasick" and not (root / "kithgraph/llm").exists():
        pytest.skip("no subpackage")
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True)
    assert done.stdout.split() == ["False", "True"] if missing == "kithgraph.llm" else done.returncode != 0 and "absent" in done.stderr


def test_response_parsers(spark, rows):
    from kithgraph.operators import crawl, responses

    some = [
        (1, "repository_contributors", 7, False, None, '[{"id":1,"login":"a","contributions":3},{"id":2,"login":"b/c","type":"Organization"},{"login":"x"},null]'),
        (2, "user_followers", 9, False, '<https://x?page=2,3>; rel="next"', '[{"id":1,"login":"a"}]'),
        (3, "repository_forks", 7, False, None, '[{"id":5,"name":"n","fork":true,"owner":{"id":1,"login":"a"},"parent":{"id":6,"name":"m","owner":{"login":"o"}}}]'),
        (4, "repository", None, True, None, '{"id":5,"name":"n","owner":{"id":2,"login":"b","type":"Organization"}}'),
        (5, "repository", None, False, None, '{"id":8,"name":"n","owner":{"id":2,"login":"b"}}'),
        (6, "repository_commits", 7, False, None, '[{"sha":"s","author":null,"committer":{"id":1,"login":"a"},"parents":[{"sha":"p"}]}]'),
        (7, "user", None, True, None, '{"id":3,"login":"c","type":"User","company":"z"}'),
        (8, "user_organizations", 3, False, None, '[{"id":4,"login":"d"}]'),
        (9, "user_followers", 9, False, None, "no json"),
        (10, "organization_members", 9, False, '<https://y>; rel="prev"', None),
        (11, "nonsense", 9, False, '<https://y>; rel="next"', "[]"),
    ]
    df = spark.createDataFrame(some, "n long, endpoint string, parent_id long, start boolean, link string, body string")
    p = responses.parsed(df)
    assert rows(responses.relations(p)) == [("Contributor", 7, 1, 3), ("Contributor", 7, 2, None), ("Follow", 9, 1, None)]
    assert rows(responses.relation(p, "user_followers"), "followee_id", "follower_id") == [(9, 1)]
    assert rows(responses.named_repositories(p), "n", "id") == [(3, 5), (3, 6)]
    assert rows(responses.named_accounts(p), "n", "id", "type") == [(1, 1, None), (1, 2, "Organization"), (2, 1, None), (3, 1, None), (4, 2, "Organization"), (6, 1, None), (8, 4, "Organization")]
    assert rows(responses.commits(p), "repo_id", "sha", "author", "committer.id") == [(7, "s", None, 1)]
    assert rows(responses.details(p, "account"), "id", "company") == [(3, "z")] and rows(responses.details(p, "repository"), "id", "owner.id") == [(5, 2), (8, 2)]
    made = responses.requests(p, crawl.policy())
    of = lambda n: rows(made.where(F.col("n") == n), "endpoint", "path", "visit")
    assert ("organization", "/orgs/b%2Fc", True) in of(1) and len(of(1)) == 7 + 3 and len(of(5)) == 0
    assert len(of(4)) == 7 + 3 and ("repository", "/repos/b/n", False) not in of(4) and ("repository_languages", "/repos/b/n/languages", True) in of(4)
    assert ("repository_languages", "/repos/a/n/languages", False) in of(3) and ("repository_languages", "/repos/o/m/languages", True) in of(3) and len(of(3)) == 2 * 8 + 7
    assert {e for e, _, _ in of(7)} == {"user_followers", "user_following", "user_repositories", "user_starred", "user_subscriptions", "user_organizations"}
    assert rows(responses.next_pages(df), "n", "url") == [(2, "https://x?page=2,3")]
    assert responses.relations(responses.parsed(df.limit(0))).count() == 0


def test_link_headers(spark):
    from kithgraph.functions import web

    headers = [
        ('<https://x/?a=1,2>; rel="next", <https://y>; rel=last', {"next": "https://x/?a=1,2", "last": "https://y"}),
        ('<https://x>; title="a, b; rel=first"; REL="Next Prev"', {"next": "https://x", "prev": "https://x"}),
        ("<https://a>; rel=next, <https://b>; rel='next'", {"next": "https://b"}),
        ("<https://a>, <https://b>; type=x", {}), ("", {}), (None, {}), ("rel=next", {}), ("<https://a", {}),
    ]
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(headers)], "i int, h string")
    got = {r.i: (r.m, r.more) for r in df.select("i", web.link_header(F.col("h")).alias("m"), web.has_next(F.col("h")).alias("more")).collect()}
    assert [got[i] for i in range(len(headers))] == [(m, "next" in m) for _, m in headers]


def test_log_changes_and_drops(spark, rows):
    from kithgraph.operators import crawl

    df = spark.createDataFrame([(5, 9, 8, 30), (1, 9, 9, 0), (2, 9, 9, 20), (3, 9, 8, 20), (9, 9, 9, 20)], "order long, limit int, remaining int, reset int")
    assert rows(crawl.limit_changes(df), "order", "reset") == [(2, 20), (5, 30), (9, 20)] and crawl.limit_changes(df.limit(0)).count() == 0
    log = spark.createDataFrame([("/a", 2, "x"), ("/b", 1, "y"), ("/a", 1, None), ("/a", 2, "x"), (None, 5, "z")], "endpoint string, time int, params string")
    assert rows(crawl.request_log(log)) == [("/a", 1, 1, None), ("/a", 2, 2, "x"), ("/a", 3, 2, "x"), ("/b", 1, 1, "y")]
    items = spark.createDataFrame([("ASummary", 1, 3), ("ASummary", 1, 2), ("ASummary", None, 4), ("A", 1, 5), ("A", 1, 6)], "item string, id long, line_no int")
    assert rows(crawl.dropped_items(items), "line_no") == [(3,)]


def test_attributes_that_nodes_have_already(spark, rows):
    nodes = spark.createDataFrame([("User", 1, "old", 7), ("User", 2, "kept", 8), ("Repository", 1, "r", 9)], "type string, id long, name string, size int")
    g = graph.Graph(nodes, spark.createDataFrame([], "src long, dst long"), "User", "Repository")
    new = spark.createDataFrame([(1, None, "x"), (3, "n", "y")], "id long, name string, blog string")
    assert rows(graph.with_attributes(g, "Account", new), "id", "name", "size", "blog") == [(1, None, 7, "x"), (2, "kept", 8, None)]


def test_models_by_one_interface(spark, rows):
    from kithgraph.operators import models

    train = spark.createDataFrame([(1, 10), (1, 11), (2, 10), (2, 12), (3, 1 << 40)], "src long, dst long")
    items = train.select(F.col("dst").alias("item")).distinct()
    all_of = [models.Random(), models.UserBased(), models.ItemBased(), models.Walk(), models.Factors(2), models.ContentBased("own", "target", train.select(F.col("dst").alias("row"), F.col("src").alias("col"), F.lit(1.0).alias("w")))]
    for r in all_of:
        recs = r.fit(train, items).recommend_all(n=2)
        assert recs.columns == ["user", "rank", "item", "score"] and recs.join(train, (recs.user == train.src) & (recs.item == train.dst), "left_semi").count() == 0
        assert recs.where("user = 1").orderBy("rank").first().item == 12 or isinstance(r, models.Random | models.Factors)
    assert models.Walk().parameters() == {"alpha": 0.15, "max_steps": 10, "epsilon": 0.01} and models.ContentBased("own", "target", items).parameters() == {"of": "own", "side": "target"}
