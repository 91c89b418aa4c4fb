"""Responses of a paginated web API to items, relations and further requests; each response is parsed once.

A response has ``n`` (its key), ``endpoint`` (a name of ``web.ENDPOINTS``), ``parent_id`` (id of the repository, user or organisation it was asked
for), ``start`` (whether the crawl began with it), ``link`` (its Link header) and ``body`` (JSON text). A body that is null, no JSON or of another shape gives nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kithgraph.functions import web
from kithgraph.operators.crawl import with_visit
from kithgraph.sources.schemas import ACCOUNT, COMMIT, REPOSITORY

#: Endpoints that list repositories, and that list accounts (with the type that all of them have, if it isn't told).
REPOSITORY_LISTS = ("repository_forks", "user_repositories", "user_starred", "user_subscriptions", "organization_repositories")
ACCOUNT_LISTS = {
    "repository_collaborators": None, "repository_contributors": None, "repository_stargazers": None, "repository_subscribers": None, "user_followers": None,
    "organization_members": None, "user_following": "User", "user_organizations": "Organization",
}
#: What is asked for of each repository, user and organisation.
REPOSITORY_PARTS = ("forks", "collaborators", "contributors", "languages", "stargazers", "subscribers", "commits")
USER_PARTS = ("followers", "following", "repositories", "starred", "subscriptions", "organizations")
ORGANIZATION_PARTS = ("members", "repositories")
#: Relations by endpoint: kind, the parent's column, the account's column.
RELATIONS = {
    "repository_collaborators": ("Collaborator", "repo", "user"), "repository_contributors": ("Contributor", "repo", "user"), "repository_stargazers": ("Stargazer", "repo", "user"),
    "repository_subscribers": ("Subscriber", "repo", "user"), "user_followers": ("Follow", "followee", "follower"), "organization_members": ("Membership", "org", "user"),
}

_NAMED = T.StructType([T.StructField("id", T.LongType()), T.StructField("login", T.StringType()), T.StructField("type", T.StringType()), T.StructField("contributions", T.LongType())])


def _with(schema: T.StructType, **kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(f.name, kinds.get(f.name, f.dataType)) for f in schema.fields])


_BASE = _with(REPOSITORY, owner=_NAMED)
_REPOSITORY = _with(_BASE, parent=_BASE, source=_BASE)
_COMMIT = _with(COMMIT, author=_NAMED, committer=_NAMED)


def _is(*names: str) -> Column:
    return F.col("endpoint").isin(*names)


def _named(c: Column) -> Column:
    return F.struct(c.id.alias("id"), c.login.alias("login"), c.type.alias("type"))


def parsed(responses: DataFrame) -> DataFrame:
    """Responses with what their bodies hold: ``accounts`` that are named (id, login, type, contributions), ``repositories`` that are named, ``commits``, ``languages``, and the entity itself, ``account`` or ``repository``."""
    body = F.col("body")
    parse = lambda when, kind: F.when(when, F.from_json(body, kind))
    forced = F.coalesce(*[F.when(_is(e), F.lit(t)) for e, t in ACCOUNT_LISTS.items() if t])
    return responses.select(
        "n", "endpoint", "parent_id", "start",
        F.transform(parse(_is(*ACCOUNT_LISTS), T.ArrayType(_NAMED)), lambda a: F.struct(a.id.alias("id"), a.login.alias("login"), F.coalesce(forced, a.type).alias("type"), a.contributions.alias("contributions"))).alias("accounts"),
        parse(_is(*REPOSITORY_LISTS), T.ArrayType(_REPOSITORY)).alias("repositories"),
        parse(_is("repository_commits"), T.ArrayType(_COMMIT)).alias("commits"),
        parse(_is("repository_languages"), T.MapType(T.StringType(), T.LongType())).alias("languages"),
        parse(_is("user", "organization"), ACCOUNT).alias("account"),
        parse(_is("repository"), _REPOSITORY).alias("repository"),
    )


def relations(p: DataFrame) -> DataFrame:
    """Relations that parsed responses state: ``kind``, ``parent_id``, ``id``, ``contributions`` (of contributors). ``RELATIONS`` names the columns; accounts without id state none."""
    kind = F.coalesce(*[F.when(_is(e), F.lit(k[0])) for e, k in RELATIONS.items()])
    each = p.select(kind.alias("kind"), "parent_id", F.inline("accounts")).where(F.col("kind").isNotNull() & F.col("id").isNotNull())
    return each.select("kind", "parent_id", "id", F.when(F.col("kind") == "Contributor", F.col("contributions")).alias("contributions"))


def relation(p: DataFrame, endpoint: str) -> DataFrame:
    """The relation of one endpoint under its own columns."""
    kind, parent, account = RELATIONS[endpoint]
    extra = ["contributions"] if kind == "Contributor" else []
    return relations(p.where(_is(endpoint))).select(F.col("parent_id").alias(f"{parent}_id"), F.col("id").alias(f"{account}_id"), *extra)


def languages(p: DataFrame) -> DataFrame:
    """Languages items: repo_id and its map; an empty map is an item too."""
    return p.where(F.col("languages").isNotNull()).select(F.col("parent_id").alias("repo_id"), "languages")


def commits(p: DataFrame) -> DataFrame:
    """Commit items: repo_id and the declared fields, persons' accounts and parents reduced to their keys."""
    each = p.select(F.col("parent_id").alias("repo_id"), F.explode("commits").alias("c")).where(F.col("c").isNotNull())
    key = lambda c: F.when(c.isNotNull(), F.struct(c.id.alias("id")))
    return each.select("repo_id", "c.sha", "c.commit", key(F.col("c.author")).alias("author"), key(F.col("c.committer")).alias("committer"), "c.parents")


def details(p: DataFrame, kind: str) -> DataFrame:
    """Items of the entities that were asked for themselves, 'account' or 'repository', references reduced to ids."""
    own = p.where(F.col(kind).isNotNull()).select(f"{kind}.*")
    return own if kind == "account" else own.select(*[_key(c) if c in ("owner", "organization", "parent", "source") else F.col(c) for c in own.columns])


def _key(c: str) -> Column:
    return F.when(F.col(c).isNotNull(), F.struct(F.col(f"{c}.id").alias("id"))).alias(c)


def named_repositories(p: DataFrame) -> DataFrame:
    """Repositories that responses name, with their fields (RepositorySummary): those of lists and, of a list's or of a starting repository, parent and source."""
    base = lambda r: F.struct(*[(r["owner"] if f.name == "owner" else F.when(r[f.name].isNotNull(), F.struct(r[f.name]["id"].alias("id"))) if f.name in ("parent", "source") else r[f.name]).alias(f.name) for f in _BASE.fields])
    up = lambda r: F.array(base(r.parent), base(r.source))
    listed = F.flatten(F.transform("repositories", lambda r: F.concat(F.array(base(r)), up(r))))
    own = F.when(F.col("start"), up(F.col("repository")))
    return p.select("n", F.inline(F.filter(F.coalesce(listed, own), lambda r: r.id.isNotNull())))


def named_accounts(p: DataFrame) -> DataFrame:
    """Accounts that responses name (AccountSummary): ``n``, ``id``, ``login``, ``type``; those of lists, persons of commits, owners of named and of starting repositories."""
    listed = F.transform("accounts", _named)
    persons = F.flatten(F.transform("commits", lambda c: F.array(_named(c.author), _named(c.committer))))
    own = F.when(F.col("start") & F.col("repository").isNotNull(), F.array(_named(F.col("repository.owner"))))
    direct = p.select("n", F.inline(F.coalesce(listed, persons, own)))
    owners = named_repositories(p).select("n", "owner.id", "owner.login", "owner.type")
    return direct.unionAll(owners).where(F.col("id").isNotNull())


def requests(p: DataFrame, rules: dict[str, bool]) -> DataFrame:
    """Requests that parsed responses lead to: ``n``, ``endpoint``, ``path``, ``parent_id``, ``fork``, ``visit`` by the policy ``rules``.

    Each named entity is asked for itself and, as an entity that the crawl began with, for its parts. Of a fork the policy for forks counts, but not for the repository itself. Requests repeat as names do.
    """
    repos = named_repositories(p).select("n", "id", "fork", F.col("owner.login").alias("owner"), "name", F.lit(True).alias("named"))
    began = p.where("start and repository is not null").select("n", "repository.id", "repository.fork", F.col("repository.owner.login").alias("owner"), "repository.name", F.lit(False).alias("named"))
    accounts = named_accounts(p).select("n", "id", "login", "type", F.lit(True).alias("named"))
    begun = p.where("start and account is not null").select("n", "account.id", "account.login", F.when(_is("organization"), "Organization").otherwise("User").alias("type"), F.lit(False).alias("named"))

    def each(rows: DataFrame, kind: str, parts: tuple[str, ...], values: dict[str, Column], fork: Column) -> DataFrame:
        ask = lambda e, parent, f: F.struct(F.lit(e).alias("endpoint"), web.expand(e, **values).alias("path"), parent.cast("bigint").alias("parent_id"), f.alias("fork"))
        own = F.when(F.col("named"), ask(kind, F.lit(None), F.lit(False)))
        return rows.select("n", F.inline(F.array_compact(F.array(own, *[ask(f"{kind}_{part}", F.col("id"), fork) for part in parts]))))

    everyone = accounts.unionAll(begun)
    org = F.coalesce(F.col("type") == "Organization", F.lit(False))
    out = each(repos.unionAll(began), "repository", REPOSITORY_PARTS, {"owner": F.col("owner"), "repo": F.col("name")}, F.coalesce("fork", F.lit(False)))
    out = out.unionAll(each(everyone.where(~org), "user", USER_PARTS, {"user": F.col("login")}, F.lit(False)))
    out = out.unionAll(each(everyone.where(org), "organization", ORGANIZATION_PARTS, {"org": F.col("login")}, F.lit(False)))
    return with_visit(out, rules)


def next_pages(responses: DataFrame) -> DataFrame:
    """Requests for the next pages of lists that go on: ``n``, ``endpoint``, ``parent_id``, ``url``, ``has_previous_page``. They are as deep as the page before."""
    more = responses.where(_is(*REPOSITORY_LISTS, *ACCOUNT_LISTS, "repository_commits")).select("n", "endpoint", "parent_id", F.try_element_at(web.link_header(F.col("link")), F.lit("next")).alias("url"))
    return more.where(F.col("url").isNotNull()).withColumn("has_previous_page", F.lit(True))
