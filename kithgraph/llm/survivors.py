"""One record for each group of rows that describe the same thing."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithgraph.functions.text import has_text
from kithgraph.operators.current import current_values
from kithgraph.session import cut

#: Most sources that fusion compares with each other.
SOURCES = 2_000


def surviving_lines(df: DataFrame, key: Column, fields: Mapping[str, Column], updated: Column, full: Column, line: Column) -> DataFrame:
    """``id``, ``field`` and ``line_no`` of the row that gives each field's current value, for ids with two or more rows.

    The rule is ``current_values``': latest update, then full before summary items, then the greatest line, among the rows
    where the field isn't missing. Fields that every row lacks give no row.
    """
    one = current_values(df, key, fields, updated, full, line, values=False).where(F.col("n_rows") >= 2)
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}__line").alias("line_no")) for f in fields])
    return one.select("id", F.inline(each)).where(F.col("line_no").isNotNull())


def fuse(claims: DataFrame, rounds: int = 3, false_values: int = 10, copies: float = 0.8, prior: float = 0.2) -> DataFrame:
    """The most probable value of each field of each id, from sources of unknown accuracy of which some copy from others.

    ``claims`` has ``id``, ``field``, ``value`` (string), ``source`` and ``at`` (anything that orders). Nulls in the first four and values of white
    space are no claims; of a source's claims about a field the latest counts (on ties the greater value). Result: ``id``, ``field``,
    ``value``, ``probability``; ties go to the smaller value. An empty table gives an empty result.

    Each round, with the accuracies A of the sources (0.8 at first): a vote for a value weighs ln(``false_values``·A/(1-A)); votes of
    sources that share a value are taken from the most accurate down, each discounted by the chance, over the sources before it,
    that it was copied (``copies``·P(dependent)); probabilities of a field's values follow from the votes, counting the values nobody
    claimed; A is the mean probability of a source's values. Two sources are dependent, with Bayes' rule from
    ``prior``, by what they share: shared values held false speak strongly for copying, shared true ones weakly, differing
    ones against. Fields only one source speaks of can't tell and are left out of that comparison.

    Claims are grouped once, by id and field, where there is at most one a source, and kept as numbers of sources and values; a round reads these and
    sends each task's sums for sources and pairs of sources that met, combined in the task. At most SOURCES sources are allowed (more are an error): the table of their
    pairs, 4 bytes each, is broadcast.
    """
    spark = claims.sparkSession
    good = claims.where(F.col("id").isNotNull() & F.col("field").isNotNull() & F.col("source").isNotNull() & has_text(F.col("value")))
    names = sorted(r[0] for r in good.select("source").distinct().limit(SOURCES + 1).collect())
    if len(names) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    n = max(1, len(names))
    numbers = F.broadcast(spark.createDataFrame(list(enumerate(names)), "__s int, source string"))
    latest = good.join(numbers, "source").groupBy("id", "field", "__s").agg(F.max(F.struct("at", "value")).alias("__m"))
    slots = latest.groupBy("id", "field").agg(F.sort_array(F.collect_list(F.struct("__m.value", "__s"))).alias("__c"))
    values = F.array_distinct("__c.value")
    slots = cut(slots.select("id", "field", F.col("__c.__s").alias("sources"), F.transform("__c.value", lambda v: F.array_position(values, v).cast("int") - 1).alias("codes"), values.alias("values")))
    accuracy, dependent = np.full(n, 0.8), np.zeros((n, n), np.float32)
    for _ in range(rounds - 1):
        sent = spark.sparkContext.broadcast((accuracy, dependent))
        sums = slots.select("sources", "codes").mapInArrow(_round(sent, false_values, copies), "pair long, t double, f long, d long")
        told = sums.groupBy("pair").agg(F.sum("t").alias("t"), F.sum("f").alias("f"), F.sum("d").alias("d")).toPandas()
        own, both = told[told["pair"] < 0], told[told["pair"] >= 0]
        accuracy = accuracy.copy()
        accuracy[-1 - own["pair"].to_numpy()] = np.clip(own["t"] / own["f"], 0.01, 0.99)
        x, y = divmod(both["pair"].to_numpy(), n)
        dependent = np.zeros((n, n), np.float32)
        dependent[x, y] = dependent[y, x] = _dependence((accuracy[x] + accuracy[y]) / 2, both["t"].to_numpy(), both["f"].to_numpy(), both["d"].to_numpy(), false_values, copies, prior)
    sent = spark.sparkContext.broadcast((accuracy, dependent))

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for b in batches:
            votes = Votes(b.column(2), b.column(3), *known, false_values, copies)
            code, probability = votes.best()
            texts = b.column(4)
            at = pa.array(texts.offsets.to_numpy()[:-1] - texts.offsets[0].as_py() + code)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), texts.flatten().take(at), pa.array(np.round(probability, 6))], ["id", "field", "value", "probability"])

    kinds = dict(claims.dtypes)
    return slots.mapInArrow(last, f"id {kinds['id']}, field {kinds['field']}, value string, probability double")


class Votes:
    """The claims of a batch of slots (lists of source numbers and value numbers), and the probabilities of their values."""

    def __init__(self, sources: pa.ListArray, codes: pa.ListArray, accuracy: np.ndarray, dependent: np.ndarray, false_values: int, copies: float) -> None:
        sizes = np.diff(sources.offsets.to_numpy())
        slot, source, code = np.repeat(np.arange(len(sizes)), sizes), sources.flatten().to_numpy(), codes.flatten().to_numpy()
        order = np.lexsort((source, -accuracy[source], code, slot))
        self.slot, self.source, self.code, self.slots = slot[order], source[order], code[order], len(sizes)
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(self.slot) != 0) | (np.diff(self.code) != 0)
        self.value = np.cumsum(new) - 1
        self.first = np.flatnonzero(new)
        alone = np.ones(len(order))
        for i, before in _earlier(self.value):
            alone[i] *= 1 - copies * dependent[self.source[before], self.source[i]]
        a = accuracy[self.source]
        score = np.bincount(self.value, alone * np.log(false_values * a / (1 - a)), len(self.first))
        self.of = self.slot[self.first]
        top = np.zeros(self.slots)
        np.maximum.at(top, self.of, score)
        unsaid = np.maximum(false_values + 1 - np.bincount(self.of, minlength=self.slots), 0)
        share = np.exp(score - top[self.of])
        self.p = share / (np.bincount(self.of, share, self.slots) + unsaid * np.exp(-top))[self.of]

    def best(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each slot the most probable value's number, the least on ties, and its probability."""
        order = np.lexsort((self.code[self.first], -self.p, self.of))
        head = order[np.flatnonzero(np.diff(self.of[order], prepend=-1))]
        return self.code[self.first][head], self.p[head]

    def pairs(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the pairs of sources that speak of the same slot, and for each 0 if they share a value held true, 1 if one held false, 2 if they differ."""
        top = np.zeros(self.slots)
        np.maximum.at(top, self.of, self.p)
        true = (self.p >= top[self.of])[self.value]
        codes, kinds = [np.zeros(0, np.int64)], [np.zeros(0, np.int8)]
        for i, before in _earlier(self.slot):
            x, y = self.source[i].astype(np.int64), self.source[before]
            codes.append(np.minimum(x, y) * n + np.maximum(x, y))
            kinds.append(np.where(self.value[i] != self.value[before], 2, np.where(true[i], 0, 1)).astype(np.int8))
        return np.concatenate(codes), np.concatenate(kinds)


def _earlier(group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of ``group`` (sorted) and the place so many before each, for every distance at which both are in the same group."""
    first = np.flatnonzero(np.diff(group, prepend=group[:1] - 1)) if len(group) else np.zeros(0, np.int64)
    rank = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
    i, back = np.flatnonzero(rank > 0), 1
    while len(i):
        yield i, i - back
        back += 1
        i = i[rank[i] >= back]


def _round(sent, false_values: int, copies: float):
    """Sums of a task: for each source, as -1 less its number, of its values' probabilities (t) and their count (f); for each pair of sources how often they share a value held true (t), false (f), or differ (d)."""
    schema = pa.schema([("pair", pa.int64()), ("t", pa.float64()), ("f", pa.int64()), ("d", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        accuracy, dependent = sent.value
        n = len(accuracy)
        total, count = np.zeros(n), np.zeros(n, np.int64)
        pairs, counts = np.zeros(0, np.int64), np.zeros((0, 3), np.int64)
        for b in batches:
            votes = Votes(b.column(0), b.column(1), accuracy, dependent, false_values, copies)
            total += np.bincount(votes.source, votes.p[votes.value], n)
            count += np.bincount(votes.source, minlength=n)
            codes, kinds = votes.pairs(n)
            new, at = np.unique(np.concatenate([pairs, codes]), return_inverse=True)
            more = np.zeros((len(new), 3), np.int64)
            np.add.at(more, at[: len(pairs)], counts)
            np.add.at(more, (at[len(pairs) :], kinds), 1)
            pairs, counts = new, more
        met = np.flatnonzero(count)
        rows = [np.concatenate([-1 - met, pairs]), np.concatenate([total[met], counts[:, 0].astype(float)]), np.concatenate([count[met], counts[:, 1]]), np.concatenate([0 * met, counts[:, 2]])]
        yield pa.RecordBatch.from_arrays([pa.array(r, f.type) for r, f in zip(rows, schema)], schema=schema)

    return run


def _dependence(a: np.ndarray, t: np.ndarray, f: np.ndarray, d: np.ndarray, false_values: int, copies: float, prior: float) -> np.ndarray:
    """Probability that two sources of mean accuracy ``a`` depend on each other, by how often they share a value held true, one held false, and differ."""
    pt, pf = a * a, (1 - a) ** 2 / false_values
    pd = np.maximum(1e-9, 1 - pt - pf)
    alone = t * np.log(pt) + f * np.log(pf) + d * np.log(pd)
    copied = t * np.log(a * copies + pt * (1 - copies)) + f * np.log((1 - a) * copies + pf * (1 - copies)) + d * np.log(pd * (1 - copies))
    return 1 / (1 + (1 - prior) / prior * np.exp(np.clip(alone - copied, -500.0, 500.0)))
