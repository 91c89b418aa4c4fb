"""The same results in SQL, without files."""

from kithgraph.plans.crawling_sql import SQL as CRAWLING
from kithgraph.plans.recommenders_sql import SQL as RECOMMENDERS
from kithgraph.plans.relations import CONTRIBUTOR, FOLLOW, REPO_FIELDS, SPLIT, USER_FIELDS


def _merged(table: str, item: str, fields: tuple[str, ...]) -> str:
    return f"SELECT id, {', '.join(f'arg_max({f}, line_no) AS {f}' for f in fields)} FROM {table} WHERE item = '{item}' AND id IS NOT NULL GROUP BY id"


_RANDOM, _LANGUAGE = RECOMMENDERS["rec_random"], RECOMMENDERS["rec_language"]
_NAMED = f"""SELECT 'Random' AS name, '{{"seed": 42}}' AS parameters, "user", rank, item FROM ({_RANDOM})
UNION ALL SELECT 'Random', '{{"seed": 7}}', "user", rank, item FROM ({_RANDOM.replace("'42:'", "'7:'").replace("md5('7:' || src", "md5('42:' || src")})
UNION ALL SELECT 'ContentBased', '{{"of": "language", "side": "target"}}', "user", rank, item FROM ({_LANGUAGE})"""

SQL = {
    "graph_files": f"WITH {CONTRIBUTOR} SELECT * FROM contributor_edges",
    "graph_nodes_files": f"WITH {FOLLOW} SELECT DISTINCT 'User' AS type, id FROM (SELECT src AS id FROM follow_edges UNION ALL SELECT dst FROM follow_edges)",
    "graph_json_files": f"WITH {FOLLOW} SELECT * FROM follow_edges",
    "item_files": 'SELECT repo.id AS repo_id, "user".id AS user_id, contributions FROM contributor WHERE contributions IS NOT NULL',
    "report_files": f"""WITH {SPLIT} SELECT 'recs' AS kind, "user", item, CAST(rank AS INTEGER) AS rank, 42 AS seed FROM ({_RANDOM})
UNION ALL SELECT 'train', "user", item, 0, 42 FROM train UNION ALL SELECT 'test', "user", item, 0, 42 FROM test""",
    "report_json_files": f"""WITH {SPLIT}, known AS (SELECT DISTINCT "user" FROM train)
SELECT "user", 'training' AS kind, CAST(row_number() OVER (PARTITION BY "user" ORDER BY item) - 1 AS INTEGER) AS pos, item FROM train
UNION ALL SELECT "user", 'recommended', CAST(rank - 1 AS INTEGER), item FROM ({_RANDOM}) WHERE "user" IN (FROM known)
UNION ALL SELECT "user", 'groundtruth', CAST(row_number() OVER (PARTITION BY "user" ORDER BY item) - 1 AS INTEGER), item FROM test WHERE "user" IN (FROM known)""",
    "merge_accounts_full": _merged("account", "Account", USER_FIELDS),
    "merge_accounts_summary": _merged("account", "AccountSummary", USER_FIELDS),
    "merge_repositories_full": _merged("repository", "Repository", REPO_FIELDS),
    "merge_repositories_summary": _merged("repository", "RepositorySummary", REPO_FIELDS),
    "merge_documents": "SELECT id, n.v AS name, c.v AS company, f.v AS followers FROM (SELECT id, "
    + ", ".join(f"arg_max(struct_pack(v := {f}), line_no) FILTER (WHERE item = 'Account' OR {f} IS NOT NULL) AS {f[0]}" for f in ("name", "company", "followers"))
    + " FROM account WHERE id IS NOT NULL GROUP BY id)",
    "start_queue": f"SELECT position, path FROM (SELECT row_number() OVER (ORDER BY path) - 1 AS position, path, item_id FROM ({CRAWLING['start_requests']})) WHERE item_id % 2 <> 0",
    "recommend_all": f"""SELECT name, "user", rank, item FROM ({_NAMED}) WHERE parameters <> '{{"seed": 7}}'""",
    "experiment_report": f"""WITH {SPLIT}, recs AS ({_NAMED}), asked AS (SELECT DISTINCT "user" FROM train WHERE "user" % 50 = 0 AND "user" IN (SELECT "user" FROM test)),
ks AS (SELECT unnest([5, 10]) AS k), truth AS (SELECT count(*) AS n FROM test WHERE "user" IN (FROM asked)),
hits AS (SELECT name, parameters, k, CAST(count(*) AS BIGINT) AS pos, CAST(count(t.item) AS BIGINT) AS tp FROM recs JOIN ks ON rank <= k LEFT JOIN test t ON t."user" = recs."user" AND t.item = recs.item WHERE recs."user" IN (FROM asked) GROUP BY ALL)
SELECT name, parameters, k, tp, pos - tp AS fp, n - tp AS fn FROM hits CROSS JOIN truth""",
}
