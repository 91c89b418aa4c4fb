"""Recommenders. Each gives for all users (or a stated set of them) ``user``, ``rank``, ``item``, ``score`` of items the user hasn't got."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithgraph.operators import digests, matrix, packed, similarity, walk
from kithgraph.operators.ordering import best
from kithgraph.operators.skew import in_blocks
from kithgraph.session import cut

#: Columns of the lists that are made in one task a user.
LISTS = "user bigint, item bigint, score double, rank int"


def ranked(scores: DataFrame, seen: DataFrame, n: int | None) -> DataFrame:
    """Scores (user, item, score) of items not ``seen`` (user, item), best first, ties by the lesser item."""
    fresh = scores.join(seen, ["user", "item"], "left_anti")
    return best(fresh, "user", [F.round("score", 9).desc(), F.col("item")], n)


def grid(users: DataFrame, items: DataFrame) -> DataFrame:
    """Every (user, item) of a stated set of users, which is broadcast in blocks of bounded size."""
    return in_blocks(users.select("user"), "user", lambda some: items.select("item").crossJoin(F.broadcast(some)).select("user", "item"))


def with_zeros(scores: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Every item for each of a stated set of ``users``, 0 where there is no score. The set is a query set, so users × items is what is asked."""
    return grid(users, items).join(scores, ["user", "item"], "left").select("user", "item", F.coalesce("score", F.lit(0.0)).alias("score"))


def listed(user: int, items: np.ndarray, scores: np.ndarray, free: np.ndarray, n: int | None, also: np.ndarray | None = None) -> tuple:
    """A user's list as in ``ranked``, from the scores of all ``items`` (sorted) and those at which one is ``free`` to be recommended; with ``also`` (positions), those are listed at any rank."""
    q = packed.rounded(scores[free], 9)
    top = packed.first(q, n)
    rank = np.arange(1, len(top) + 1)
    if also is not None and len(top) < len(q):
        more = np.setdiff1d(np.flatnonzero(np.isin(free, also)), top)
        rank = np.concatenate((rank, [1 + np.count_nonzero(q > q[i]) + np.count_nonzero(q[:i] == q[i]) for i in more])).astype(int)
        top = np.concatenate((top, more))
    return np.full(len(top), user), items[free[top]], scores[free[top]], rank


def user_cf(train: DataFrame, neighbours: int | None = None, n: int | None = 10) -> DataFrame:
    """Sum of the similarities of the nearest users who have the item. Only items that some of them has are candidates. ``train`` has src (user) and dst (item)."""
    near = similarity.neighbours(train, neighbours).select(F.col("a").alias("user"), F.col("b").alias("src"), "sim")
    scores = near.join(train, "src").groupBy("user", F.col("dst").alias("item")).agg(F.sum("sim").alias("score"))
    return ranked(scores, seen(train), n)


def item_cf(train: DataFrame, neighbours: int | None = None, n: int | None = 10) -> DataFrame:
    """Sum of the similarities of the user's items to the item, where it is among their nearest."""
    flipped = train.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    near = similarity.neighbours(flipped, neighbours).select(F.col("a").alias("dst"), F.col("b").alias("item"), "sim")
    scores = train.join(near, "dst").groupBy(F.col("src").alias("user"), "item").agg(F.sum("sim").alias("score"))
    return ranked(scores, seen(train), n)


def user_cf_of(train: DataFrame, users: DataFrame, n: int | None = None, also: DataFrame | None = None) -> DataFrame:
    """``user_cf`` with all neighbours, and whole lists by default, for a stated set of ``users`` (user), whose pairs alone are formed. Items of ``also`` (user, item) are listed at whatever rank they have."""
    if fits(train, users, *([] if also is None else [also])):
        return _cf_packed(train, users, n, also, by_user=True)
    near = similarity.neighbours_of(train, users.select(F.col("user").alias("src"))).select(F.col("a").alias("user"), F.col("b").alias("src"), "sim")
    scores = near.join(train, "src").groupBy("user", F.col("dst").alias("item")).agg(F.sum("sim").alias("score"))
    if n is None or also is None:
        return ranked(scores, seen(train), n)
    kept = ranked(scores, seen(train), None).join(also.select("user", "item", F.lit(True).alias("__also")).distinct(), ["user", "item"], "left")
    return kept.where((F.col("rank") <= n) | F.col("__also")).drop("__also")


def item_cf_of(train: DataFrame, users: DataFrame, n: int | None = None) -> DataFrame:
    """``item_cf`` with all neighbours, and whole lists by default, for a stated set of ``users`` (user); only pairs of their items are formed."""
    if fits(train, users):
        return _cf_packed(train, users, n, None, by_user=False)
    own = train.join(users.select(F.col("user").alias("src")), "src", "left_semi")
    flipped = train.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    near = similarity.neighbours_of(flipped, own.select(F.col("dst").alias("src")).distinct()).select(F.col("a").alias("dst"), F.col("b").alias("item"), "sim")
    scores = own.join(near, "dst").groupBy(F.col("src").alias("user"), "item").agg(F.sum("sim").alias("score"))
    return ranked(scores, seen(train), n)


def fits(*tables: DataFrame) -> bool:
    """Whether tables of whole numbers are few enough to be sent to every task."""
    return all(packed.whole_numbers(t, *t.columns) for t in tables) and packed.few(*tables)


#: Items whose similarities a task keeps, those with most users first met.
KEPT_ITEMS = 48


def _cf_packed(train: DataFrame, users: DataFrame, n: int | None, also: DataFrame | None, by_user: bool) -> DataFrame:
    """Collaborative filtering with all neighbours, a user at a time from the whole table of edges: the users or items that share something are counted and their similarities summed where they are met."""
    users_of, items_of = packed.gathered(train, "src", "dst")
    who, what = np.unique(users_of), np.unique(items_of)
    has = packed.Sparse(packed.number(who, users_of), packed.number(what, items_of), None, (len(who), len(what)))
    wanted = None
    if also is not None:
        of, it = (packed.number(ids, x) for ids, x in zip((who, what), packed.gathered(also, "user", "item")))
        known = (of >= 0) & (it >= 0)
        wanted = packed.Sparse(of[known], it[known], None, has.shape)
    sent = users.sparkSession.sparkContext.broadcast((who, what, has, has.transposed(), wanted))
    kept: dict[int, np.ndarray] = {}

    def near(own: int, of: packed.Sparse, back: packed.Sparse) -> tuple[np.ndarray, np.ndarray]:
        """The rows of ``of`` that share a column with row ``own``, and their Jaccard similarities."""
        shared = back.counts(of.row(own))
        shared[own] = 0
        at = np.flatnonzero(shared)
        both = shared[at]
        return at, both / (of.ptr[own + 1] - of.ptr[own] + of.ptr[at + 1] - of.ptr[at] - both)

    def item_scores(i: int, has: packed.Sparse, by: packed.Sparse) -> np.ndarray:
        if i not in kept:
            found = np.zeros(len(by.ptr) - 1)
            at, sim = near(i, by, has)
            found[at] = sim
            if by.ptr[i + 1] - by.ptr[i] < 100 or len(kept) >= KEPT_ITEMS:
                return found
            kept[i] = found
        return kept[i]

    def of(asked: np.ndarray) -> Iterator[tuple]:
        who, what, has, by, wanted = sent.value
        for user, u in zip(asked, packed.number(who, asked)):
            if u < 0:
                continue
            mine = has.row(u)
            score = has.spread(*near(u, has, by)) if by_user else sum((item_scores(i, has, by) for i in mine), np.zeros(len(what)))
            score[mine] = 0
            yield listed(user, what, score, np.flatnonzero(score > 0), n, None if wanted is None else wanted.row(u))

    return packed.each(users, "user", of, LISTS)


def seen(train: DataFrame) -> DataFrame:
    """(user, item) of the training edges."""
    return train.select(F.col("src").alias("user"), F.col("dst").alias("item"))


def content_based(train: DataFrame, features: DataFrame, side: str, users: DataFrame, items: DataFrame, n: int | None = 10) -> DataFrame:
    """Cosine between the user's and the item's features, one side given and the other propagated along the edges; all unseen items are candidates.

    ``features`` are those of items ('target') or users ('source'); ``users`` (user) is the stated set of users, ``items`` (item) the universe.
    """
    if side not in ("source", "target"):
        raise ValueError('side must be "source" or "target"')
    if all(packed.whole_numbers(t, *c) for t, *c in ((train, "src", "dst"), (features, "row"), (users, "user"), (items, "item"))) and packed.few(train, features := cut(features), items):
        return _content_packed(train, features, side, users, items, n)
    m = train.select(F.col("src").alias("row"), F.col("dst").alias("col"), F.lit(1.0).alias("w"))
    asked = users.select(F.col("user").alias("row"))
    # only the asked users' features are wanted, so their rows alone are multiplied; rows are normalised one by one
    if side == "target":
        source, target = similarity.bigraph_features(m.join(asked, "row", "left_semi"), features, side)
    else:
        source, target = similarity.bigraph_features(m, features, side, asked)
    scores = matrix.dot(source, target).select(F.col("a").alias("user"), F.col("b").alias("item"), F.col("sim").alias("score"))
    return ranked(with_zeros(scores, users, items), seen(train), n)


def _content_packed(train: DataFrame, features: DataFrame, side: str, users: DataFrame, items: DataFrame, n: int | None) -> DataFrame:
    """``content_based``, a user at a time: the user's features, summed over the items where these are given, times those of all items. Where users' features are given the products are with users and summed over each item's."""
    users_of, items_of = packed.gathered(train, "src", "dst")
    row, col, w = packed.gathered(features, "row", "col", "w")
    (all_items,) = packed.gathered(items, "item")
    own_ids, other_ids = (np.concatenate((items_of, all_items)), users_of) if side == "target" else (users_of, np.concatenate((items_of, all_items)))
    given, other = np.unique(np.concatenate((own_ids, row))), np.unique(other_ids)
    who, what = (other, given) if side == "target" else (given, other)
    columns, (col,) = packed.coded(col)
    f = packed.Sparse(packed.number(given, row), col, w, (len(given), len(columns)))
    has = packed.Sparse(packed.number(who, users_of), packed.number(what, items_of), None, (len(who), len(what)))
    universe = np.zeros(len(what), bool)
    universe[packed.number(what, all_items)] = True
    if side == "target":
        sizes = np.sqrt(np.bincount(f.rows, f.w**2, len(given)))
        f_by_column = packed.Sparse(f.idx, f.rows, f.w / np.where(sizes > 0, sizes, 1)[f.rows], f.shape[::-1])
        lengths = np.zeros(0)
    else:
        f_by_column = f.transposed()
        lengths = _summed_lengths(train, what, f, has.transposed())
    sent = users.sparkSession.sparkContext.broadcast((who, what, f, f_by_column, has, universe, lengths))

    def of(asked: np.ndarray) -> Iterator[tuple]:
        who, what, f, f_by_column, has, universe, lengths = sent.value
        for user, u in zip(asked, packed.number(who, asked)):
            mine = has.row(u) if u >= 0 else np.zeros(0, np.int64)
            if side == "target":
                own = f.spread(mine, np.ones(len(mine)))
                at = np.flatnonzero(own)
                score = f_by_column.spread(at, own[at] / (np.sqrt((own[at] ** 2).sum()) or 1))
            elif u >= 0:
                x = f.weights(u)
                own = f_by_column.spread(f.row(u), x / (np.sqrt((x**2).sum()) or 1))
                at = np.flatnonzero(own)
                score = has.spread(at, own[at]) / np.where(lengths > 0, lengths, 1)
            else:
                score = np.zeros(len(what))
            free = universe.copy()
            free[mine] = False
            yield listed(user, what, score, np.flatnonzero(free), n)

    return packed.each(users, "user", of, LISTS)


def _summed_lengths(train: DataFrame, what: np.ndarray, f: packed.Sparse, by: packed.Sparse) -> np.ndarray:
    """The length of the sum of the features of each item's users."""
    sent = train.sparkSession.sparkContext.broadcast((what, f, by))

    def of(asked: np.ndarray) -> Iterator[tuple]:
        what, f, by = sent.value
        found = np.zeros(len(asked))
        for k, i in enumerate(packed.number(what, asked)):
            at, n = f.entries(by.row(i))
            cols, w = f.idx[at], f.w[at]
            if 8 * len(at) < f.shape[1]:
                _, cols = np.unique(cols, return_inverse=True)
            found[k] = np.sqrt((np.bincount(cols, w) ** 2).sum())
        yield asked, found

    got = packed.each(train.select("dst"), "dst", of, "dst bigint, size double", 10_000)
    ids, sizes = packed.gathered(got, "dst", "size")
    lengths = np.zeros(len(what))
    lengths[packed.number(what, ids)] = sizes
    return lengths


def walked(links: DataFrame, train: DataFrame, users: DataFrame, items: DataFrame, alpha: float = 0.15, max_steps: int = 10, epsilon: float = 0.01, n: int | None = 10) -> DataFrame:
    """Unseen items by a walk from each of a stated set of users; all unseen items are candidates. ``links`` (src, dst) name users U and items R, each with its id."""
    seeds = users.select(F.concat(F.lit("U"), F.col("user").cast("string")).alias("seed"))
    if fits(train, users, items) and packed.few(links := cut(links)):
        return _walked_packed(links, train, users, items, walk.Steps(alpha, max_steps, epsilon), n)
    ranks = walk.personal_rank(links, seeds, alpha, max_steps, epsilon)
    scores = ranks.where(F.col("node").startswith("R")).select(F.substring("seed", 2, 30).cast("bigint").alias("user"), F.substring("node", 2, 30).cast("bigint").alias("item"), F.col("x").alias("score"))
    return ranked(with_zeros(scores, users, items), seen(train), n)


def _walked_packed(links: DataFrame, train: DataFrame, users: DataFrame, items: DataFrame, steps: walk.Steps, n: int | None) -> DataFrame:
    users_of, items_of = packed.gathered(train, "src", "dst")
    who, what = np.unique(users_of), np.unique(packed.gathered(items, "item")[0])
    at = packed.number(what, items_of)
    has = packed.Sparse(packed.number(who, users_of)[at >= 0], at[at >= 0], None, (len(who), len(what)))
    nodes, (src, dst) = packed.coded(*packed.gathered(links, "src", "dst"))
    ways = walk.Ways(src, dst, len(nodes))
    node_of = lambda kind, ids: ways.place(nodes, pa.array([f"{kind}{x}" for x in ids.tolist()], pa.string()))
    own, (asked,) = node_of("R", what), packed.gathered(users.distinct(), "user")
    asked = np.sort(asked)
    sent = users.sparkSession.sparkContext.broadcast((who, what, has, ways, own, asked, node_of("U", asked)))

    def of(some: np.ndarray) -> Iterator[tuple]:
        who, what, has, ways, own, asked, roots = sent.value
        for k, x in walk.walks(ways, roots[packed.number(asked, some)], steps):
            u = packed.number(who, some[k : k + 1])[0]
            free = np.ones(len(what), bool)
            if u >= 0:
                free[has.row(u)] = False
            yield listed(some[k], what, np.where(own >= 0, x[own], 0.0), np.flatnonzero(free), n)

    return packed.each(users, "user", of, LISTS, ways.width)


def random_items(train: DataFrame, users: DataFrame, items: DataFrame, seed: int = 42, n: int | None = 10) -> DataFrame:
    """Unseen items in the order of a seeded hash; score 0."""
    if n is not None and fits(train, users, items):
        return _random_packed(train, users, items, seed, n)
    fresh = grid(users, items).join(seen(train), ["user", "item"], "left_anti")
    hashed: Column = F.md5(F.concat(F.lit(f"{seed}:"), F.col("user").cast("string"), F.lit(":"), F.col("item").cast("string")))
    return best(fresh.withColumn("score", F.lit(0.0)), "user", [hashed, F.col("item")], n)


def _random_packed(train: DataFrame, users: DataFrame, items: DataFrame, seed: int, n: int) -> DataFrame:
    """``random_items``, a user at a time: the first words of all items' hashes at once, whole hashes of those that can be among the first."""
    users_of, items_of = packed.gathered(train, "src", "dst")
    who, what = np.unique(users_of), np.unique(packed.gathered(items, "item")[0])
    at = packed.number(what, items_of)
    has = packed.Sparse(packed.number(who, users_of)[at >= 0], at[at >= 0], None, (len(who), len(what)))
    sent = users.sparkSession.sparkContext.broadcast((who, what, has))
    endings: dict[int, list] = {}

    def of(asked: np.ndarray) -> Iterator[tuple]:
        who, what, has = sent.value
        for user, u in zip(asked, packed.number(who, asked)):
            mine = has.row(u) if u >= 0 else np.zeros(0, np.int64)
            most = n + len(mine)
            head = f"{seed}:{user}:".encode()
            some = np.arange(len(what))
            if most < len(what):
                words = digests.first_words(head, what, endings)
                some = np.flatnonzero(words <= np.partition(words, most - 1)[most - 1])
            order = sorted((hashlib.md5(head + str(what[i]).encode()).digest(), i) for i in some.tolist())
            own = set(mine.tolist())
            top = what[np.array([i for _, i in order if i not in own][:n], np.int64)]
            yield np.full(len(top), user), top, np.zeros(len(top)), np.arange(1, len(top) + 1)

    return packed.each(users, "user", of, LISTS)
