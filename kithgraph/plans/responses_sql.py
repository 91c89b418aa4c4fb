"""The same results in SQL, from the tables themselves."""

from kithgraph.functions.web import ENDPOINTS
from kithgraph.operators.crawl import POLICY
from kithgraph.operators.responses import ORGANIZATION_PARTS, REPOSITORY_PARTS, USER_PARTS

_NAMED = """named AS (
  SELECT id, name, full_name, fork, owner.id AS owner_id FROM repository
  UNION ALL SELECT parent.id, NULL, NULL, NULL, NULL FROM repository UNION ALL SELECT source.id, NULL, NULL, NULL, NULL FROM repository
  UNION ALL SELECT parent.id, NULL, NULL, NULL, NULL FROM repository WHERE item = 'Repository' AND fork UNION ALL SELECT source.id, NULL, NULL, NULL, NULL FROM repository WHERE item = 'Repository' AND fork),
known AS (SELECT * FROM named WHERE id IS NOT NULL), begun AS (SELECT id, name, fork, owner.id AS owner_id FROM repository WHERE item = 'Repository' AND fork)"""
_TYPE = "CASE WHEN {0} % 11 = 0 THEN 'Organization' ELSE 'User' END"
_OWNERS = "owners AS (SELECT owner_id AS id FROM known WHERE owner_id IS NOT NULL UNION ALL SELECT owner_id FROM begun WHERE owner_id IS NOT NULL)"


def _asked(endpoint: str, rows: str, values: dict[str, str], fork: str = "false") -> str:
    path = f"'{ENDPOINTS[endpoint]}'"
    for name, value in values.items():
        path = f"replace({path}, '{{{name}}}', coalesce({value}, ''))"
    visit = str(POLICY[endpoint]).lower()
    forks = str(POLICY[endpoint] and POLICY.get(endpoint.replace("repository_", "fork_"), False)).lower()
    return f"SELECT '{endpoint}' AS endpoint, {path} AS path, {fork} AS fork, CASE WHEN {fork} THEN {forks} ELSE {visit} END AS visit FROM {rows}"


_REPO, _LOGIN = {"owner": "'u' || owner_id", "repo": "name"}, "'u' || id"
_REQUESTS = " UNION ALL ".join(
    [_asked("repository", "known", _REPO)]
    + [_asked(f"repository_{p}", "(SELECT id, name, owner_id, fork FROM known UNION ALL SELECT id, name, owner_id, fork FROM begun)", _REPO, "coalesce(fork, false)") for p in REPOSITORY_PARTS]
    + [_asked(e, "owners WHERE id % 11 <> 0", {"user": _LOGIN}) for e in ("user", *(f"user_{p}" for p in USER_PARTS))]
    + [_asked(e, "owners WHERE id % 11 = 0", {"org": _LOGIN}) for e in ("organization", *(f"organization_{p}" for p in ORGANIZATION_PARTS))]
)

SQL = {
    "response_stargazers": 'SELECT repo.id AS repo_id, "user".id AS user_id FROM stargazer WHERE "user".id IS NOT NULL',
    "response_subscribers": 'SELECT repo.id AS repo_id, "user".id AS user_id FROM stargazer WHERE "user".id IS NOT NULL',
    "response_contributors": 'SELECT repo.id AS repo_id, "user".id AS user_id, contributions FROM contributor WHERE "user".id IS NOT NULL',
    "response_collaborators": 'SELECT repo.id AS repo_id, "user".id AS user_id FROM contributor WHERE "user".id IS NOT NULL',
    "response_followers": "SELECT followee.id AS followee_id, follower.id AS follower_id FROM follow WHERE follower.id IS NOT NULL",
    "response_members": "SELECT follower.id AS org_id, followee.id AS user_id FROM follow WHERE followee.id IS NOT NULL",
    "response_languages": "SELECT repo.id AS repo_id, e.key AS language, e.value AS bytes FROM (SELECT repo, unnest(map_entries(languages)) AS e FROM languages)",
    "response_commits": 'SELECT repo.id AS repo_id, sha, "commit".message AS message, "commit".author.email AS email, author.id AS author_id, committer.id AS committer_id, CAST(len(parents) AS INTEGER) AS n_parents FROM commits',
    "response_details": "SELECT id, full_name, fork, description, owner.id AS owner_id, parent.id AS parent_id FROM repository WHERE item = 'Repository'",
    "response_summaries": f"WITH {_NAMED} SELECT id, full_name, fork, 'u' || owner_id AS owner FROM known",
    "response_accounts": f"""WITH {_NAMED}, {_OWNERS}, ids AS (SELECT "user".id AS id FROM stargazer UNION ALL SELECT author.id FROM commits UNION ALL SELECT committer.id FROM commits UNION ALL SELECT id FROM owners)
SELECT id, 'u' || id AS login, {_TYPE.format('id')} AS type, count(*) AS n FROM ids WHERE id IS NOT NULL GROUP BY ALL""",
    "response_requests": f"WITH {_NAMED}, {_OWNERS}, made AS ({_REQUESTS}) SELECT endpoint, visit, fork, count(*) AS n, min(path) AS first_path, max(path) AS last_path FROM made GROUP BY ALL",
    "response_pages": """SELECT DISTINCT followee.id AS parent_id, 'https://api.hub.example/user_followers?ids=1,2&page=' || (line_no // 50 + 1) AS url, true AS has_previous_page FROM follow WHERE line_no // 50 % 3 <> 0""",
}
