"""The same results in SQL."""

from kithgraph.plans.relations import FOLLOW, QUERY_IDS

_SITE = "https://api.hub.example"
_REPOS = """repos AS (SELECT *, split_part(full_name, '/', 1) AS o, substr(full_name, strpos(full_name, '/') + 1) AS r FROM repository WHERE full_name IS NOT NULL)"""
_HEADERS = f"""headers AS (SELECT event_id, user_id, event_type, json_extract_string(props, '$.k') AS k, CASE WHEN event_type = 'error' THEN '' WHEN event_id % 3 = 0 THEN 'last' ELSE 'both' END AS kind FROM events)"""
_STATE = f"""{_HEADERS}, responses AS (SELECT '/users/u' || user_id || '/' || (event_id % 5) AS endpoint, kind = 'both' AS has_next FROM headers WHERE event_type <> 'error'),
state AS (SELECT endpoint, CASE WHEN bool_or(NOT has_next) THEN 'visited' ELSE 'pending' END AS state, count(*) AS pages FROM responses GROUP BY endpoint)"""

SQL = {
    "expand_endpoint": f"WITH {_REPOS} SELECT line_no, '/repos/' || o || '/' || r || '/contributors' AS path FROM repos",
    "parse_endpoint": f'WITH {_REPOS} SELECT line_no, o AS owner, r AS repo, CAST(NULL AS VARCHAR) AS "user" FROM repos',
    "paginated_url": f"""WITH {_REPOS} SELECT line_no, '{_SITE}/repos/' || full_name || CASE line_no % 4 WHEN 0 THEN '/forks?per_page=100' WHEN 1 THEN '/languages' WHEN 2 THEN '/commits?page=2&per_page=100' ELSE '/pulls?per_page=5' END AS url FROM repos""",
    "parse_link_header": f"""WITH {_HEADERS} SELECT event_id, CASE WHEN kind = 'both' THEN '{_SITE}/x?page=' || k END AS next, CASE WHEN kind <> '' THEN '{_SITE}/x?page=100' END AS last, kind = 'both' AS more FROM headers""",
    "rate_limit": "SELECT event_id, 5000 AS \"limit\", coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INT), 0) AS remaining, 0 AS reset FROM events",
    "policy_filter": """SELECT line_no, endpoint FROM repository CROSS JOIN (SELECT unnest(['repository_languages', 'repository_contributors']) AS endpoint)
WHERE full_name IS NOT NULL AND (NOT coalesce(fork, false) OR endpoint = 'repository_contributors')""",
    "dedup_summaries": """SELECT line_no, item, id FROM (SELECT *, row_number() OVER (PARTITION BY item, id ORDER BY line_no) AS n FROM account) WHERE n = 1 OR item NOT LIKE '%Summary' OR id IS NULL""",
    "request_log": """WITH r AS (SELECT ts, '/users/u' || user_id || '/' || lower(event_type) AS endpoint, 'page=' || json_extract_string(props, '$.k') AS params FROM events)
SELECT endpoint, row_number() OVER (PARTITION BY endpoint ORDER BY ts, params) AS position, ts AS time, params FROM r""",
    "request_totals": "SELECT '/users/u' || user_id || '/' || lower(event_type) AS endpoint, count(*) AS n, min(ts) AS first_time, max(ts) AS last_time FROM events GROUP BY ALL",
    "dropped_items": """SELECT line_no, item, id FROM (SELECT *, row_number() OVER (PARTITION BY item, id ORDER BY line_no) AS n FROM account WHERE item LIKE '%Summary' AND id IS NOT NULL) WHERE n > 1""",
    "limit_changes": """SELECT event_id AS "order", 5000 AS "limit", k AS remaining, reset FROM (SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INT), 0) AS k, CAST(event_id // 37 * 3600 AS INT) AS reset,
  lag(CAST(event_id // 37 * 3600 AS INT), 1, 0) OVER (ORDER BY event_id) AS before FROM events) WHERE reset <> before""",
    "shutdown_filter": "SELECT event_id FROM events WHERE (event_id % 3 <> 0 OR event_id % 10 = 0) AND event_id % 2 = 0",
    "scalar_functions": """SELECT line_no, CASE WHEN coalesce(company, '') = '' THEN 'none' ELSE company END AS company, true AS hireable, CASE WHEN coalesce(followers, 0) = 0 THEN -1 ELSE followers END AS followers,
  round(1 / (1 + exp(-followers / 1000.0::DOUBLE)), 9) AS weight, true AS timed FROM account""",
    "visited_pending": f"WITH {_STATE} SELECT * FROM state",
    "start_requests": """WITH k AS (SELECT DISTINCT full_name FROM repository WHERE full_name IS NOT NULL)
SELECT split_part(full_name, '/', 1) AS owner, substr(full_name, strpos(full_name, '/') + 1) AS repo, '/repos/' || full_name || '/languages' AS path, item_id
FROM k JOIN (SELECT full_name, arg_max(id, line_no) AS item_id FROM repository WHERE id IS NOT NULL GROUP BY full_name) USING (full_name)""",
    "bfs_levels": f"""WITH {FOLLOW}, l0 AS (SELECT DISTINCT src AS node FROM follow_edges WHERE src % {20 * QUERY_IDS} = 0),
l1 AS (SELECT DISTINCT dst AS node FROM follow_edges WHERE src IN (FROM l0) AND dst NOT IN (FROM l0)),
l2 AS (SELECT DISTINCT dst AS node FROM follow_edges WHERE src IN (FROM l1) AND dst NOT IN (FROM l0) AND dst NOT IN (FROM l1)),
l3 AS (SELECT DISTINCT dst AS node FROM follow_edges WHERE src IN (FROM l2) AND dst NOT IN (FROM l0) AND dst NOT IN (FROM l1) AND dst NOT IN (FROM l2))
SELECT node, 0 AS depth, 0 AS priority FROM l0 UNION ALL SELECT node, 1, -1 FROM l1 UNION ALL SELECT node, 2, -2 FROM l2 UNION ALL SELECT node, 3, -3 FROM l3""",
    "depth_filter": """SELECT n, depth FROM (SELECT event_id AS n, CAST(event_id % 4 + CASE WHEN event_id % 2 = 0 THEN 0 ELSE 1 END AS INT) AS depth FROM events) WHERE (n % 3 <> 0 OR n % 10 = 0) AND depth <= 3""",
    "unvisited_requests": f"""WITH {_STATE}, r AS (SELECT event_id, '/users/u' || user_id || '/' || (event_id % 7) AS endpoint, event_id % 100 = 0 AS start FROM events)
SELECT event_id, endpoint FROM r WHERE start OR endpoint NOT IN (SELECT endpoint FROM state WHERE state = 'visited')""",
}
