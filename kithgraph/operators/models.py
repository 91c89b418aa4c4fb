"""Recommenders under one interface: fit on training edges, recommend for a set of users, tell their parameters to a report."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithgraph.operators import evaluate, ml, recommend


@dataclass(frozen=True)
class Recommender:
    """What a recommender is made of. ``fit`` takes edges (src: user, dst: item) and the universe of items (item)."""

    @property
    def name(self) -> str:
        return type(self).__name__

    def parameters(self) -> dict[str, object]:
        """The plain fields by name; tables such as features aren't parameters."""
        return {f.name: v for f in fields(self) if isinstance(v := getattr(self, f.name), (str, int, float, bool, type(None)))}

    def fit(self, train: DataFrame, items: DataFrame) -> Model:
        return Model(self, train, items)

    def scored(self, train: DataFrame, items: DataFrame, users: DataFrame, n: int | None) -> DataFrame:
        """``user``, ``rank``, ``item``, ``score`` for the ``users`` (user)."""
        raise NotImplementedError


@dataclass(frozen=True)
class Model:
    """A fitted recommender."""

    recommender: Recommender
    train: DataFrame
    items: DataFrame

    def recommend_all(self, users: DataFrame | None = None, n: int | None = 10) -> DataFrame:
        """The ``n`` best unseen items (None: all) of a stated set of ``users`` (user), or of all users with training edges."""
        asked = self.train.select(F.col("src").alias("user")).distinct() if users is None else users
        return self.recommender.scored(self.train, self.items, asked, n).select("user", "rank", "item", "score")


@dataclass(frozen=True)
class Random(Recommender):
    seed: int = 42

    def scored(self, train: DataFrame, items: DataFrame, users: DataFrame, n: int | None) -> DataFrame:
        return recommend.random_items(train, users, items, self.seed, n)


@dataclass(frozen=True)
class UserBased(Recommender):
    def scored(self, train: DataFrame, items: DataFrame, users: DataFrame, n: int | None) -> DataFrame:
        return recommend.user_cf_of(train, users, n)


@dataclass(frozen=True)
class ItemBased(Recommender):
    def scored(self, train: DataFrame, items: DataFrame, users: DataFrame, n: int | None) -> DataFrame:
        return recommend.item_cf_of(train, users, n)


@dataclass(frozen=True)
class ContentBased(Recommender):
    """``features`` (row, col, w) of items ('target') or users ('source'); ``of`` says which they are."""

    of: str
    side: str
    features: DataFrame

    def scored(self, train: DataFrame, items: DataFrame, users: DataFrame, n: int | None) -> DataFrame:
        return recommend.content_based(train, self.features, self.side, users, items, n)


@dataclass(frozen=True)
class Factors(Recommender):
    rank: int = 10

    def scored(self, train: DataFrame, items: DataFrame, users: DataFrame, n: int | None) -> DataFrame:
        return ml.nmf_recommend(train, users, items, self.rank, n)


@dataclass(frozen=True)
class Walk(Recommender):
    alpha: float = 0.15
    max_steps: int = 10
    epsilon: float = 0.01

    def scored(self, train: DataFrame, items: DataFrame, users: DataFrame, n: int | None) -> DataFrame:
        name = lambda k, c: F.concat(F.lit(k), F.col(c).cast("string"))
        ways = train.select(name("U", "src").alias("src"), name("R", "dst").alias("dst"))
        ways = ways.unionAll(ways.select("dst", "src")).distinct()
        return recommend.walked(ways, train, users, items, self.alpha, self.max_steps, self.epsilon, n)


def experiment(recommenders: Sequence[Recommender], train: DataFrame, test: DataFrame, items: DataFrame, users: DataFrame, cutoffs: list[int]) -> DataFrame:
    """The report of several recommenders, each fitted once and judged on a stated set of users: ``name``, ``parameters`` (JSON), and sums over users of ``tp``, ``fp``, ``fn`` at each cutoff ``k``."""

    def judged(r: Recommender) -> DataFrame:
        recs = r.fit(train, items).recommend_all(users, max(cutoffs))
        own, truth = (recommend.seen(x).join(users, "user", "left_semi") for x in (train, test))
        sums = evaluate.frequencies(recs, own, truth, items, cutoffs).groupBy("k").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
        return sums.select(F.lit(r.name).alias("name"), F.lit(json.dumps(r.parameters(), sort_keys=True)).alias("parameters"), "k", "tp", "fp", "fn")

    return reduce(DataFrame.unionAll, map(judged, recommenders))
