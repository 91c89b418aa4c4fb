"""Explicit schemas of the crawled items; reading never infers one. Undeclared fields are dropped and missing ones are null."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


_ID = _struct(id=T.LongType())
_S, _L, _B, _TS = T.StringType(), T.LongType(), T.BooleanType(), T.TimestampNTZType()

ACCOUNT = _struct(
    login=_S, id=_L, type=_S, site_admin=_B, name=_S, company=_S, blog=_S, location=_S, email=_S, hireable=_B,
    public_repos=_L, public_gists=_L, followers=_L, following=_L, created_at=_TS, updated_at=_TS,
)
REPOSITORY = _struct(
    id=_L, name=_S, full_name=_S, owner=_ID, organization=_ID, private=_B, description=_S, fork=_B, created_at=_TS, updated_at=_TS, pushed_at=_TS,
    homepage=_S, size=_L, language=_S, has_issues=_B, has_downloads=_B, has_wiki=_B, stargazers_count=_L, subscribers_count=_L, forks_count=_L,
    network_count=_L, open_issues_count=_L, default_branch=_S, parent=_ID, source=_ID,
)
_PERSON = _struct(name=_S, email=_S, date=_TS)
COMMIT = _struct(
    repo=_ID, sha=_S,
    commit=_struct(author=_PERSON, committer=_PERSON, message=_S, tree=_struct(sha=_S), comment_count=_L, verification=_struct(verified=_B, reason=_S)),
    author=_ID, committer=_ID, parents=T.ArrayType(_struct(sha=_S)),
)

#: Schema of each kind of item.
ITEMS: dict[str, T.StructType] = {
    "Account": ACCOUNT,
    "AccountSummary": ACCOUNT,
    "Repository": REPOSITORY,
    "RepositorySummary": REPOSITORY,
    "Membership": _struct(org=_ID, user=_ID),
    "Follow": _struct(follower=_ID, followee=_ID),
    "Contributor": _struct(repo=_ID, user=_ID, contributions=_L),
    "Collaborator": _struct(repo=_ID, user=_ID),
    "Stargazer": _struct(repo=_ID, user=_ID),
    "Subscriber": _struct(repo=_ID, user=_ID),
    "Languages": _struct(repo=_ID, languages=T.MapType(_S, _L)),
    "Commit": COMMIT,
}
