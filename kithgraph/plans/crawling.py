"""Queries on crawl state and web functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithgraph.functions import web
from kithgraph.operators import crawl
from kithgraph.plans import relations as R
from kithgraph.session import cut
from kithgraph.sources.tables import table

SITE = "https://api.hub.example"


def _repos(spark: SparkSession, d: str) -> DataFrame:
    names = web.repository_parts(F.col("full_name"))
    return table(spark, d, "repository").where(F.col("full_name").isNotNull()).select("line_no", "crawled_at", "id", "fork", names.alias("n")).select("*", "n.owner", "n.repo").drop("n")


def _requests(spark: SparkSession, d: str) -> DataFrame:
    """A request for each event and, of each repository row, for its contributors; some with a page."""
    events = table(spark, d, "events").select(
        F.col("event_id").alias("n"), F.col("ts").alias("time"), F.concat(F.lit(f"{SITE}/users/u"), F.col("user_id").cast("string"), F.lit("/"), F.lower("event_type"), F.lit("?page="), F.get_json_object("props", "$.k")).alias("url")
    )
    return events.withColumn("endpoint", web.path(F.col("url"))).withColumn("params", web.query(F.col("url")))


def expand_endpoint(spark: SparkSession, d: str) -> DataFrame:
    return _repos(spark, d).select("line_no", web.expand("repository_contributors", owner=F.col("owner"), repo=F.col("repo")).alias("path"))


def parse_endpoint(spark: SparkSession, d: str) -> DataFrame:
    paths = _repos(spark, d).select("line_no", web.expand("repository_forks", owner=F.col("owner"), repo=F.col("repo")).alias("path"))
    return paths.select("line_no", web.endpoint_keys(F.col("path")).alias("k")).select("line_no", "k.owner", "k.repo", "k.user")


def paginated_url(spark: SparkSession, d: str) -> DataFrame:
    urls = _repos(spark, d).select("line_no", F.concat(F.lit(f"{SITE}/repos/"), "owner", F.lit("/"), "repo", F.element_at(F.array(F.lit("/forks"), F.lit("/languages"), F.lit("/commits?page=2"), F.lit("/pulls?per_page=5")), (F.col("line_no") % 4 + 1).cast("int"))).alias("url"))
    return urls.select("line_no", web.paginated(F.col("url")).alias("url"))


def _headers(spark: SparkSession, d: str) -> DataFrame:
    n = F.get_json_object("props", "$.k")
    nxt = F.concat(F.lit(f'<{SITE}/x?page='), n, F.lit('>; rel="next"'))
    last = F.concat(F.lit(f'<{SITE}/x?page=100>; REL="Last"'))
    header = F.when(F.col("event_type") == "error", F.lit("")).when(F.col("event_id") % 3 == 0, last).otherwise(F.concat_ws(", ", nxt, last))
    return table(spark, d, "events").select("event_id", "ts", "user_id", header.alias("link"), n.alias("left"))


def parse_link_header(spark: SparkSession, d: str) -> DataFrame:
    links = web.link_header(F.col("link"))
    return _headers(spark, d).select("event_id", F.try_element_at(links, F.lit("next")).alias("next"), F.try_element_at(links, F.lit("last")).alias("last"), web.has_next(F.col("link")).alias("more"))


def rate_limit(spark: SparkSession, d: str) -> DataFrame:
    return _headers(spark, d).select("event_id", web.rate_limit(F.lit("5000"), F.col("left"), F.lit("soon")).alias("r")).select("event_id", "r.limit", "r.remaining", "r.reset")


def policy_filter(spark: SparkSession, d: str) -> DataFrame:
    """Repository rows whose languages, contributors and commits may be fetched, forks' contributors too."""
    rules = crawl.policy("fork_contributors:1")
    each = _repos(spark, d).select("line_no", "fork", F.explode(F.array(*[F.lit(f"repository_{x}") for x in ("languages", "contributors", "commits")])).alias("endpoint"))
    return crawl.with_visit(each, rules).where("visit").select("line_no", "endpoint")


def dedup_summaries(spark: SparkSession, d: str) -> DataFrame:
    return crawl.first_items(table(spark, d, "account")).select("line_no", "item", "id")


def request_log(spark: SparkSession, d: str) -> DataFrame:
    return crawl.request_log(_requests(spark, d))


def request_totals(spark: SparkSession, d: str) -> DataFrame:
    return crawl.request_totals(_requests(spark, d))


def dropped_items(spark: SparkSession, d: str) -> DataFrame:
    return crawl.dropped_items(table(spark, d, "account")).select("line_no", "item", "id")


def limit_changes(spark: SparkSession, d: str) -> DataFrame:
    """The limit's reset is the hour of the event's number."""
    headers = _headers(spark, d).select(F.col("event_id").alias("order"), web.rate_limit(F.lit("5000"), F.col("left"), (F.floor(F.col("event_id") / 37) * 3600).cast("string")).alias("r"))
    return crawl.limit_changes(headers.select("order", "r.limit", "r.remaining", "r.reset"))


def shutdown_filter(spark: SparkSession, d: str) -> DataFrame:
    """While the crawl ends only further pages of what was begun are asked for."""
    requests = table(spark, d, "events").select("event_id", F.lit(1).alias("depth"), (F.col("event_id") % 3 != 0).alias("visit"), (F.col("event_id") % 10 == 0).alias("start"), (F.col("event_id") % 2 == 0).alias("has_previous_page"))
    return crawl.wanted(requests, shutting_down=True).select("event_id")


def scalar_functions(spark: SparkSession, d: str) -> DataFrame:
    """Defaults for null, false, 0 and empty values; the logistic function; the time of the query."""
    rows = table(spark, d, "account").select(
        "line_no", web.falsy_to(F.col("company"), "string", "none").alias("company"), web.falsy_to(F.col("hireable"), "boolean", True).alias("hireable"),
        web.falsy_to(F.col("followers"), "bigint", -1).alias("followers"), F.round(web.sigmoid(F.col("followers") / 1000.0), 9).alias("weight"), web.utc_now().rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9:]{8}Z$").alias("timed"),
    )
    return rows


def visited_pending(spark: SparkSession, d: str) -> DataFrame:
    """Of each user the events as responses; those of type error are failures, and a link header without next ends the pages."""
    rows = table(spark, d, "events").select("event_id", "event_type").join(_headers(spark, d), "event_id")
    responses = rows.select(F.concat(F.lit("/users/u"), F.col("user_id").cast("string"), F.lit("/"), (F.col("event_id") % 5).cast("string")).alias("endpoint"), F.col("event_id").alias("order"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"), web.has_next(F.col("link")).alias("has_next"))
    return crawl.request_state(responses)


def start_requests(spark: SparkSession, d: str) -> DataFrame:
    log = _repos(spark, d).select(web.expand("repository_forks", owner=F.col("owner"), repo=F.col("repo")).alias("path"))
    return crawl.start_requests_with_items(log, "repository_languages", table(spark, d, "repository"), "full_name")


def bfs_levels(spark: SparkSession, d: str) -> DataFrame:
    """Who is reached along follow edges in three steps from the users whose id is divisible by 20 times QUERY_IDS, as the SQL states; ``bfs_levels_whole`` takes the whole query set to the end."""
    edges = R.follow_edges(spark, d)
    starts = edges.where(F.col("src") % (20 * R.QUERY_IDS) == 0).select(F.col("src").alias("node"))
    return crawl.levels(edges, starts, 3)


def bfs_levels_whole(spark: SparkSession, d: str) -> DataFrame:
    """Who is reached from the users with an id of the query set along follow edges, however far."""
    edges = cut(R.follow_edges(spark, d))
    return crawl.levels(edges, edges.where(F.col("src") % R.QUERY_IDS == 0).select(F.col("src").alias("node")))


def depth_filter(spark: SparkSession, d: str) -> DataFrame:
    requests = _requests(spark, d).select(
        "n", crawl.child_depth((F.col("n") % 4).cast("int"), F.col("n") % 2 == 0).alias("depth"), (F.col("n") % 3 != 0).alias("visit"), (F.col("n") % 10 == 0).alias("start"), (F.col("n") % 2 == 0).alias("has_previous_page")
    )
    return crawl.wanted(requests, max_depth=3).select("n", "depth")


def unvisited_requests(spark: SparkSession, d: str) -> DataFrame:
    visited = visited_pending(spark, d).where("state = 'visited'").select("endpoint")
    requests = table(spark, d, "events").select("event_id", F.concat(F.lit("/users/u"), F.col("user_id").cast("string"), F.lit("/"), (F.col("event_id") % 7).cast("string")).alias("endpoint"), (F.col("event_id") % 100 == 0).alias("start"))
    return crawl.unvisited(requests, visited).select("event_id", "endpoint")


QUERIES = {
    f.__name__: f
    for f in (
        expand_endpoint, parse_endpoint, paginated_url, parse_link_header, rate_limit, policy_filter, dedup_summaries, request_log, visited_pending, start_requests,
        bfs_levels, bfs_levels_whole, depth_filter, unvisited_requests, request_totals, dropped_items, limit_changes, shutdown_filter, scalar_functions,
    )
}
