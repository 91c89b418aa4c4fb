"""The same results in SQL."""

_PAIRS = """pairs AS (
  SELECT 'stargazer' AS relation, repo.id AS key_id, "user".id AS other_id FROM stargazer UNION
  SELECT 'follow', followee.id, follower.id FROM follow UNION
  SELECT 'contributor', repo.id, "user".id FROM contributor),
counts AS (SELECT relation, key_id, count(*) AS n_others FROM pairs WHERE key_id IS NOT NULL AND other_id IS NOT NULL GROUP BY ALL)"""

_VISIBLE = r"[^\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

_OBJECTS = f"""docs AS (SELECT line_no, CAST(payload AS JSON) AS j FROM commit_raw WHERE json_valid(payload)),
objects AS (
  SELECT line_no, 0 AS record, j AS o, j->'repo' AS repo FROM docs WHERE json_type(j) = 'OBJECT' UNION ALL
  SELECT line_no, i - 1, o, o->'repo' FROM (SELECT line_no, unnest(CAST(j AS JSON[])) AS o, generate_subscripts(CAST(j AS JSON[]), 1) AS i FROM docs WHERE json_type(j) = 'ARRAY') UNION ALL
  SELECT line_no, i, o, coalesce(nullif(r, 'null'), o->'repo') FROM (SELECT line_no, j->'repo' AS r, unnest(CAST(j->'page'->'commits' AS JSON[])) AS o,
    generate_subscripts(CAST(j->'page'->'commits' AS JSON[]), 1) AS i FROM docs WHERE json_type(j) = 'OBJECT' AND json_type(j->'page'->'commits') = 'ARRAY')),
raw AS (SELECT line_no, record, o, TRY_CAST(repo->>'id' AS BIGINT) AS repo_id, o->>'sha' AS sha FROM objects WHERE TRY_CAST(repo->>'id' AS BIGINT) IS NOT NULL AND regexp_matches(o->>'sha', '{_VISIBLE}'))"""

_TYPED = f"typed AS (SELECT line_no, repo.id AS repo_id, sha, \"commit\" AS c, author, committer, parents FROM commits WHERE repo.id IS NOT NULL AND regexp_matches(sha, '{_VISIBLE}'))"


def _person(role: str) -> str:
    return f"""SELECT repo_id, sha, '{role}' AS role, c.{role}.name AS name, c.{role}.email AS email, CAST(c.{role}.date AS TIMESTAMP) AS date FROM typed UNION
  SELECT repo_id, sha, '{role}', o->'commit'->'{role}'->>'name', o->'commit'->'{role}'->>'email', CAST(CAST(o->'commit'->'{role}'->>'date' AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS TIMESTAMP) FROM raw"""


_LINKS = """links AS (SELECT id AS node, arg_max(parent.id, struct_pack(u := coalesce(updated_at, TIMESTAMP '0001-01-01'), f := item = 'Repository', l := line_no)) AS parent
  FROM repository WHERE id IS NOT NULL AND parent.id IS NOT NULL GROUP BY id),
walk(node, path) AS (SELECT node, [node, parent] FROM links UNION ALL
  SELECT w.node, list_append(w.path, l.parent) FROM walk w JOIN links l ON l.node = w.path[-1] WHERE len(list_distinct(w.path)) = len(w.path)),
ends AS (SELECT node, arg_max(path, len(path)) AS path FROM walk GROUP BY node),
tree AS (SELECT node, path FROM ends WHERE len(list_distinct(path)) = len(path))"""

SQL = {
    "p2_found": f"WITH {_PAIRS} SELECT relation, key_id FROM (SELECT *, sum(n_others) OVER (PARTITION BY relation) AS total FROM counts) WHERE n_others * 50 >= total",
    "p2_counts": f"WITH {_PAIRS} SELECT relation, key_id, n_others FROM counts",
    "p3_found": f"""WITH {_OBJECTS}, {_TYPED}, links AS (
  SELECT repo_id, sha, CAST(i - 1 AS BIGINT) AS pos, p.sha AS parent_sha FROM (SELECT repo_id, sha, unnest(parents) AS p, generate_subscripts(parents, 1) AS i FROM typed) UNION
  SELECT repo_id, sha, CAST(i - 1 AS BIGINT), p->>'sha' FROM (SELECT repo_id, sha, unnest(CAST(o->'parents' AS JSON[])) AS p, generate_subscripts(CAST(o->'parents' AS JSON[]), 1) AS i
    FROM raw WHERE json_type(o->'parents') = 'ARRAY'))
SELECT repo_id, sha, pos, parent_sha FROM links WHERE parent_sha IS NOT NULL""",
    "p3_commits": f"""WITH {_OBJECTS}, {_TYPED}
SELECT 'commits' AS source, line_no, 0 AS record, repo_id, sha, c.message AS message, c.tree.sha AS tree_sha, c.comment_count AS comment_count, c.verification.verified AS verified,
  c.verification.reason AS verification_reason, author.id AS author_id, committer.id AS committer_id FROM typed UNION ALL
SELECT 'commit_raw', line_no, record, repo_id, sha, o->'commit'->>'message', o->'commit'->'tree'->>'sha', TRY_CAST(o->'commit'->>'comment_count' AS BIGINT),
  TRY_CAST(o->'commit'->'verification'->>'verified' AS BOOLEAN), o->'commit'->'verification'->>'reason', TRY_CAST(o->'author'->>'id' AS BIGINT), TRY_CAST(o->'committer'->>'id' AS BIGINT) FROM raw""",
    "p3_persons": f"""WITH {_OBJECTS}, {_TYPED}, persons AS ({_person('author')} UNION {_person('committer')})
SELECT repo_id, sha, role, name, email, date FROM persons WHERE coalesce(name, email, CAST(date AS VARCHAR)) IS NOT NULL""",
    "p4_found": f"""WITH RECURSIVE {_LINKS}
SELECT node AS repo_id, path[-1] AS root_id, CAST(len(path) - 1 AS BIGINT) AS depth FROM tree UNION ALL
SELECT node, list_min(path[list_position(path, path[-1]):]), -1 FROM ends WHERE len(list_distinct(path)) < len(path)""",
    "p4_paths": f"WITH RECURSIVE {_LINKS} SELECT node AS repo_id, array_to_string(list_reverse(path), '/') AS path FROM tree",
    "p4_forks_below": f"""WITH RECURSIVE {_LINKS}
SELECT a AS repo_id, node AS fork_id, CAST(i - 1 AS BIGINT) AS distance FROM (SELECT node, unnest(path) AS a, generate_subscripts(path, 1) AS i FROM tree) WHERE i > 1""",
}
