"""State of an incremental crawl: policy, requests, what was visited, the frontier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithgraph.functions import web
from kithgraph.operators.ordering import numbered
from kithgraph.operators.skew import lookup_join
from kithgraph.session import cut

#: Endpoints that may be visited unless said otherwise; fork_… decides for forks beside repository_….
POLICY = {
    "repository": False, "user": True, "organization": True, "repository_forks": False, "repository_collaborators": True, "repository_languages": True,
    "repository_stargazers": False, "repository_contributors": True, "repository_subscribers": False, "repository_commits": False, "user_organizations": True,
    "user_repositories": True, "user_followers": False, "user_following": False, "user_starred": False, "user_subscriptions": False,
    "organization_repositories": True, "organization_members": True, "fork_collaborators": False, "fork_languages": False, "fork_stargazers": False,
    "fork_contributors": False, "fork_subscribers": False, "fork_commits": False,
}


def policy(text: str | None = None) -> dict[str, bool]:
    """The default policy changed by 'k:0,k:1'; the key '' sets all first."""
    own = web.options(text)
    base = dict.fromkeys(POLICY, own.pop("")) if "" in own else dict(POLICY)
    return base | own


def with_visit(requests: DataFrame, rules: dict[str, bool], endpoint: str = "endpoint", fork: str = "fork") -> DataFrame:
    """``requests`` with ``visit``: whether the policy allows the endpoint and, for a fork, also its fork_… key; what isn't in the policy is not allowed."""
    table = F.create_map(*[F.lit(x) for kv in rules.items() for x in kv])
    allowed = lambda key: F.coalesce(F.try_element_at(table, key), F.lit(False))
    forked = F.regexp_replace(F.col(endpoint), "^repository_", "fork_")
    return requests.withColumn("visit", allowed(F.col(endpoint)) & (~F.coalesce(F.col(fork), F.lit(False)) | allowed(forked)))


def wanted(requests: DataFrame, max_depth: int = 0, shutting_down: bool = False) -> DataFrame:
    """Requests to send: to be visited or a start, not deeper than ``max_depth`` (0: any depth), and while shutting down only further pages."""
    keep = F.col("visit") | F.col("start")
    keep = keep & (F.col("depth") <= max_depth) if max_depth > 0 else keep
    return requests.where(keep & F.col("has_previous_page") if shutting_down else keep)


def unvisited(requests: DataFrame, visited: DataFrame) -> DataFrame:
    """Requests whose endpoint wasn't visited, and starts."""
    return requests.where("start").unionAll(requests.where("not start").join(visited, "endpoint", "left_anti").select(*requests.columns))


def request_state(responses: DataFrame) -> DataFrame:
    """``endpoint`` and ``state`` after all responses with status 200: 'visited' if the last one had no next page, else 'pending'; ``pages`` seen since.

    ``responses`` has endpoint, order, status and has_next; the endpoints '' and '/' are ignored.
    """
    good = responses.where((F.col("status") == 200) & ~F.col("endpoint").isin("", "/"))
    last = good.groupBy("endpoint").agg(F.max_by("has_next", "order").alias("more"), F.count(F.lit(1)).alias("pages"), F.max(F.when(~F.col("has_next"), F.lit(True))).alias("ended"))
    # an endpoint that was read to its last page stays visited though it be read again
    return last.select("endpoint", F.when(F.col("ended"), "visited").otherwise("pending").alias("state"), "pages")


def request_log(requests: DataFrame) -> DataFrame:
    """Every request in order of time within its endpoint: ``endpoint``, ``position`` from 1, ``time``, ``params``. Requests are sorted by range, so a hot endpoint is spread over tasks."""
    rows = numbered(requests.select("endpoint", "time", "params"), "endpoint", "time", "params")
    first = rows.groupBy("endpoint").agg(F.min("n").alias("__first"))
    return lookup_join(rows, first, "endpoint").select("endpoint", (F.col("n") - F.col("__first") + 1).alias("position"), "time", "params")


def request_totals(requests: DataFrame) -> DataFrame:
    """``endpoint``, ``n`` requests, first and last time; all algebraic."""
    return requests.groupBy("endpoint").agg(F.count(F.lit(1)).alias("n"), F.min("time").alias("first_time"), F.max("time").alias("last_time"))


def dropped_items(items: DataFrame, order: str = "line_no") -> DataFrame:
    """The items that ``first_items`` leaves out, for the log."""
    return items.join(first_items(items, order).select(order), order, "left_anti")


def limit_changes(responses: DataFrame) -> DataFrame:
    """Responses (order, limit, remaining, reset) whose ``reset`` isn't that of the response before, the first included if it isn't 0. Responses are numbered by range and each is joined to the one before."""
    rows = numbered(responses.select("order", "limit", "remaining", "reset"), "order")
    before = rows.select((F.col("n") + 1).alias("n"), F.col("reset").alias("__before"))
    return rows.join(before, "n", "left").where(F.col("reset") != F.coalesce("__before", F.lit(0))).select("order", "limit", "remaining", "reset")


def first_items(items: DataFrame, order: str = "line_no") -> DataFrame:
    """Items of summary kinds once for each kind and id, the first in ``order``; other kinds, and summaries without id, pass."""
    summary = items["item"].endswith("Summary") & items["id"].isNotNull()
    first = items.where(summary).groupBy("item", "id").agg(F.min(order).alias(order))
    return items.where(summary).join(first, ["item", "id", order], "left_semi").unionByName(items.where(~F.coalesce(summary, F.lit(False))))


def start_requests(log: DataFrame, endpoint: str, path: str = "path") -> DataFrame:
    """Distinct keys (owner and repo, user, or org) that the paths of a request log name, and the endpoint's path for each."""
    key = web.endpoint_keys(F.col(path))
    needs = [n for n in ("owner", "repo", "user", "org") if "{" + n + "}" in web.ENDPOINTS[endpoint]]
    keys = log.select(key.alias("k")).select("k.*")
    for n in needs:
        keys = keys.where(F.col(n).isNotNull())
    return keys.select(*needs).distinct().select(*needs, web.expand(endpoint, **{n: F.col(n) for n in needs}).alias("path"))


def start_requests_with_items(log: DataFrame, endpoint: str, items: DataFrame, item_key: str, path: str = "path") -> DataFrame:
    """As ``start_requests``, joined to the last known item by login or full name; keys without an item are left out."""
    keys = start_requests(log, endpoint, path)
    key: Column = F.concat_ws("/", "owner", "repo") if "owner" in keys.columns else F.coalesce(*[F.col(c) for c in keys.columns if c in ("user", "org")])
    last = items.where(F.col(item_key).isNotNull() & F.col("id").isNotNull()).groupBy(F.col(item_key).alias("key")).agg(F.max_by("id", "line_no").alias("item_id"))
    return keys.withColumn("key", key).join(last, "key").drop("key")


def levels(edges: DataFrame, starts: DataFrame, max_depth: int = 0, priority: int = 1) -> DataFrame:
    """Breadth-first frontier: ``node``, ``depth`` (0 for the starts) and ``priority`` = -depth·``priority``, to ``max_depth`` (0: all that can be reached).

    One join and one anti-join a level; each level's new nodes are cut from the plan and written once. The edges (src, dst) are read once a level.
    """
    frontier = cut(starts.select(F.col("node")).distinct())
    found, depth = frontier.withColumn("depth", F.lit(0)), 0
    while (not max_depth or depth < max_depth) and not frontier.isEmpty():
        depth += 1
        ahead = edges.join(frontier.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        frontier = cut(ahead.join(found, "node", "left_anti"))
        found = found.unionAll(frontier.withColumn("depth", F.lit(depth)))
    return found.withColumn("priority", -F.col("depth") * priority)


def child_depth(parent: Column, continuation: Column) -> Column:
    """Depth of a request made by another: one more, but the same for a further page."""
    return parent + F.when(continuation, 0).otherwise(1)
