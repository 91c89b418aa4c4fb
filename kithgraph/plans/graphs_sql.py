"""The same results in SQL."""

from kithgraph.plans.relations import CONTRIBUTOR, FOLLOW, LATEST, QUERY_IDS, REPO_FIELDS, REPOS_MERGED, SPLIT, STARGAZER, USER_FIELDS, USERS_MERGED

_EACH = "SELECT line_no, e.key AS language, e.value AS bytes FROM (SELECT line_no, unnest(map_entries(languages)) AS e FROM languages)"
_TOTALS = f"""each AS ({_EACH}), totals AS (SELECT language, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS size, count(*) AS occurrence FROM each GROUP BY language),
pairs AS (SELECT x.language AS a, y.language AS b, count(*) AS weight FROM each x JOIN each y ON x.line_no = y.line_no AND x.language < y.language GROUP BY ALL),
both_pairs AS (SELECT a, b, weight FROM pairs UNION ALL SELECT b, a, weight FROM pairs), top AS (SELECT * FROM totals ORDER BY size DESC, language LIMIT 10)"""
_NODES = """nodes AS (SELECT 'User' AS type, src AS id FROM contributor_edges UNION SELECT 'Repository', dst FROM contributor_edges)"""


def _degrees(weight: str) -> str:
    return f"""degrees AS (SELECT 'User' AS type, src AS id, CAST(sum({weight}) AS BIGINT) AS degree FROM contributor_edges GROUP BY src UNION ALL
  SELECT 'Repository', dst, CAST(sum({weight}) AS BIGINT) FROM contributor_edges GROUP BY dst)"""


_FDEG = """fdegrees AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM follow_edges UNION ALL SELECT dst FROM follow_edges) GROUP BY id)"""
_M = f"{CONTRIBUTOR}, m AS (SELECT src AS row, dst AS col, CAST(coalesce(contributions, 1) AS DOUBLE) AS w FROM contributor_edges)"


def _jaccard(src: str, dst: str) -> str:
    return f"""{CONTRIBUTOR}, e AS (SELECT {src} AS s, {dst} AS t FROM contributor_edges),
sets AS (SELECT s, list(t ORDER BY t) AS l, count(*) AS size FROM e GROUP BY s),
classes AS (SELECT s, size, min(s) OVER (PARTITION BY l) AS class_id, count(*) OVER (PARTITION BY l) AS members FROM sets)"""


_SIM = """sims AS (SELECT x.s AS a, y.s AS b, count(*) AS shared FROM e x JOIN e y ON x.t = y.t GROUP BY ALL),
sim AS (SELECT a, b, shared / CAST(p.size + q.size - shared AS DOUBLE) AS sim FROM sims JOIN sets p ON p.s = a JOIN sets q ON q.s = b)"""
_HEADS = " JOIN classes c1 ON c1.s = a AND c1.class_id = a JOIN classes c2 ON c2.s = b AND c2.class_id = b WHERE a < b"


def _dense(value: str) -> str:
    return f"SELECT a.vec_id AS a, b.vec_id AS b, round({value}, 6) AS sim FROM embeddings a CROSS JOIN embeddings b WHERE a.vec_id % {QUERY_IDS} = 0"


_X, _Y = "CAST(a.embedding AS DOUBLE[])", "CAST(b.embedding AS DOUBLE[])"

SQL = {
    "load_contributor_graph": f"WITH {CONTRIBUTOR} SELECT * FROM contributor_edges",
    "load_stargazer_graph": f"WITH {STARGAZER} SELECT * FROM stargazer_edges",
    "load_follow_graph": f"WITH {FOLLOW} SELECT * FROM follow_edges",
    "load_membership_graph": "SELECT DISTINCT c_custkey AS src, CAST(c_nationkey AS BIGINT) AS dst FROM customer",
    "load_language_graph": """SELECT src, dst, arg_max(bytes, line_no) AS bytes FROM (SELECT repo_id AS src, line_no, e.key AS dst, e.value AS bytes
  FROM (SELECT repo.id AS repo_id, line_no, unnest(map_entries(languages)) AS e FROM languages WHERE repo.id IS NOT NULL)) GROUP BY ALL""",
    "latest_languages": f"WITH {LATEST} SELECT * FROM language_bytes",
    "merge_accounts": f"WITH {USERS_MERGED} SELECT id, {', '.join(USER_FIELDS)} FROM accounts_merged",
    "merge_repositories": f"WITH {REPOS_MERGED} SELECT id, {', '.join(REPO_FIELDS)} FROM repositories_merged",
    "nonfork_descriptions": """SELECT id AS repo_id, coalesce(description, '') AS description FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY line_no DESC) AS r
  FROM repository WHERE id IS NOT NULL AND item = 'RepositorySummary' AND NOT coalesce(fork, false)) WHERE r = 1""",
    "node_attributes": f"""WITH {CONTRIBUTOR}, {_NODES}, {USERS_MERGED}, {REPOS_MERGED}
SELECT n.type, n.id, login AS label, followers AS popularity FROM nodes n LEFT JOIN accounts_merged a ON a.id = n.id WHERE n.type = 'User' UNION ALL
SELECT n.type, n.id, name, stargazers_count FROM nodes n LEFT JOIN repositories_merged r ON r.id = n.id WHERE n.type = 'Repository'""",
    "filter_edges": f"WITH {CONTRIBUTOR} SELECT * FROM contributor_edges WHERE contributions >= 5",
    "nodes_by_class": f"WITH {CONTRIBUTOR}, {_NODES} SELECT * FROM nodes WHERE type = 'User'",
    "commit_projection": """SELECT line_no, sha, "commit".message AS message, "commit".author.name AS author,
  array_to_string(list_transform(parents, lambda p: coalesce(p.sha, '?')), ' ') AS parents FROM commits""",
    "nested_pruning": "SELECT line_no, owner.id AS owner_id, organization.id AS organization_id, parent.id AS parent_id, source.id AS source_id FROM repository",
    "language_totals": f"WITH {_TOTALS} SELECT * FROM totals",
    "language_pairs": f"WITH {_TOTALS} SELECT * FROM pairs",
    "language_pairs_filtered": f"WITH {_TOTALS} SELECT * FROM pairs WHERE weight >= 5",
    "language_top_n": f"""WITH {_TOTALS}, head AS (SELECT language AS f FROM top ORDER BY size DESC, language LIMIT 1)
SELECT language, size, occurrence, coalesce(weight, 0) AS weight_to_first FROM top CROSS JOIN head LEFT JOIN both_pairs ON a = f AND b = language""",
    "language_matrix": f"WITH {_TOTALS} SELECT a, b, weight FROM both_pairs WHERE a IN (SELECT language FROM top) AND b IN (SELECT language FROM top)",
    "degree": f"WITH {CONTRIBUTOR}, {_degrees('1')} SELECT * FROM degrees",
    "weighted_degree": f"WITH {CONTRIBUTOR}, {_degrees('coalesce(contributions, 1)')} SELECT * FROM degrees",
    "degree_histogram": f"WITH {CONTRIBUTOR}, {_degrees('1')} SELECT degree, count(*) AS n FROM degrees GROUP BY degree",
    "follow_degree_histogram": f"WITH {FOLLOW}, {_FDEG} SELECT degree, count(*) AS n FROM fdegrees GROUP BY degree",
    "out_degree": f"WITH {FOLLOW} SELECT src AS id, count(*) AS out_degree FROM follow_edges GROUP BY src",
    "graph_summary": f"""WITH {CONTRIBUTOR}, {FOLLOW}, {_NODES}, {_FDEG}, c AS (
  SELECT 'undirected' AS kind, (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM contributor_edges) AS n_edges, 2 AS f UNION ALL
  SELECT 'directed', (SELECT count(*) FROM fdegrees), (SELECT count(*) FROM follow_edges), 1)
SELECT kind, n_nodes, n_edges, round(CAST(n_edges * f AS DOUBLE) / n_nodes, 6) AS average_degree FROM c""",
    "graph_labels": f"""WITH {CONTRIBUTOR}, {_degrees('1')} SELECT type, id, degree, CASE type WHEN 'Repository' THEN 'red' ELSE 'green' END AS colour,
  round(CASE WHEN degree > 1 THEN log2(CAST(degree AS DOUBLE)) ELSE 2.0 END, 6) AS size FROM degrees""",
    "graph_union": f"""WITH {CONTRIBUTOR}, {FOLLOW}, {STARGAZER} SELECT 'User' AS src_type, src, 'Repository' AS dst_type, dst FROM contributor_edges UNION
  SELECT 'User', src, 'Repository', dst FROM stargazer_edges UNION SELECT 'User', src, 'User', dst FROM follow_edges""",
    "to_directed": f"""WITH {CONTRIBUTOR} SELECT 'User' AS src_type, src, 'Repository' AS dst_type, dst FROM contributor_edges UNION ALL
  SELECT 'Repository', dst, 'User', src FROM contributor_edges""",
    "row_sum": f"WITH {_M} SELECT row, sum(w) AS w FROM m GROUP BY row",
    "row_scale": f"WITH {_M} SELECT row, col, w * (row % 7 + 1) AS w FROM m",
    "vector_matrix": f"WITH {_M} SELECT col, round(sum(w * (row % 7 + 1)), 6) AS x FROM m GROUP BY col",
    "l1_rows": f"WITH {_M} SELECT row, col, round(CASE WHEN s > 0 THEN w / s ELSE w END, 6) AS w FROM (SELECT *, sum(abs(w)) OVER (PARTITION BY row) AS s FROM m)",
    "l2_rows": f"WITH {_M} SELECT row, col, round(CASE WHEN s > 0 THEN w / s ELSE w END, 6) AS w FROM (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY row)) AS s FROM m)",
    "standardise": """WITH c AS (SELECT c_custkey, c_acctbal, CAST(c_custkey % 13 AS DOUBLE) AS key FROM customer)
SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) AS c_acctbal, round((key - avg(key) OVER ()) / stddev_pop(key) OVER (), 6) AS key FROM c""",
    "split_edges": f"WITH {SPLIT} SELECT src, dst, rn <= floor(n * 0.8) AS is_train FROM ordered",
    "jaccard_user": f"WITH {_jaccard('src', 'dst')}, {_SIM} SELECT a, b, round(sim, 6) AS sim FROM sim{_HEADS}",
    "jaccard_user_classes": f"WITH {_jaccard('src', 'dst')} SELECT s AS user_id, class_id, size, members FROM classes",
    "jaccard_item": f"WITH {_jaccard('dst', 'src')}, {_SIM} SELECT a, b, round(sim, 6) AS sim FROM sim{_HEADS}",
    "nearest_k": f"""WITH {_jaccard('dst', 'src')}, {_SIM}
SELECT a, b, round(sim, 6) AS sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(sim, 9) DESC, b) AS rank FROM sim WHERE a <> b) WHERE rank <= 10""",
    "measure": f"WITH {_jaccard('dst', 'src')}, {_SIM} SELECT b, round(sim, 6) AS sim FROM sim WHERE a = (SELECT s FROM sets ORDER BY size DESC, s LIMIT 1)",
    "cosine_embeddings": _dense(f"coalesce(list_dot_product({_X}, {_Y}) / nullif(sqrt(list_dot_product({_X}, {_X})) * sqrt(list_dot_product({_Y}, {_Y})), 0), 0)"),
    "linear_embeddings": _dense(f"list_dot_product({_X}, {_Y})"),
    "sliding_tuples": """SELECT user_id, event_id, v1, v2, v3 FROM (SELECT user_id, event_id, event_type AS v1, lead(event_type) OVER w AS v2, lead(event_type, 2) OVER w AS v3,
  lead(event_id, 2) OVER w AS l FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE l IS NOT NULL""",
}
