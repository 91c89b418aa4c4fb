"""Items that appear together in the same record more often than chance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithgraph.operators.ordering import numbered
from kithgraph.operators.skew import lookup_join
from kithgraph.session import cut, tasks

#: Codes that one task holds before it sorts them into a run (16 bytes each, twice that while they are sorted).
RUN_CODES = 1 << 21
#: Items that a code has room for: 32 bits each of two, the first one's highest being the sign.
MOST_ITEMS = 1 << 32
_RUNS = "code bigint, n bigint"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted item-id lists with a weight to runs of pair codes, each run sorted and counted.

    The codes of a batch are made for all lists at once, each item with the one so many places before it, distance by distance.
    """
    codes: list[np.ndarray] = []
    weights: list[np.ndarray] = []
    held = 0

    def run() -> pa.RecordBatch:
        code = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        weight = np.concatenate(weights) if weights else np.zeros(0, np.int64)
        order = np.argsort(code, kind="stable")
        return _counted(code[order], weight[order])

    for batch in batches:
        lists = batch.column(0)
        sizes = np.diff(lists.offsets.to_numpy())
        ids = lists.flatten().to_numpy()
        place = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        weight = np.repeat(batch.column(1).to_numpy(), sizes)
        at, back = np.flatnonzero(place > 0), 1
        while len(at):
            codes.append((ids[at - back] << 32) | ids[at])
            weights.append(weight[at])
            held += len(at)
            if held >= RUN_CODES:
                yield run()
                codes, weights, held = [], [], 0
            back += 1
            at = at[place[at] >= back]
    yield run()


def _counted(code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Lengths of the runs of equal codes."""
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(code[first]), pa.array(np.add.reduceat(n, first) if len(first) else n)], ["code", "n"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted codes with counts to one row for each code, holding back the last code of a batch for the next."""
    code, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        out = _counted(np.concatenate([code, batch.column(0).to_numpy()]), np.concatenate([n, batch.column(1).to_numpy()]))
        code, n = out.column(0).to_numpy()[-1:], out.column(1).to_numpy()[-1:]
        if out.num_rows > 1:
            yield out.slice(0, out.num_rows - 1)
    yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], ["code", "n"])


def pair_counts(baskets: DataFrame, items: str, least: int = 1, part: int | None = None) -> DataFrame:
    """How often each pair of items is in the same record, and how much more often than by chance.

    ``items`` is an array of strings; nulls in it and repeats don't count, a record without items isn't one. Result, with
    item_a < item_b: item_a, item_b, n_ab, n_a, n_b, n (records with an item), ``lift`` = n_ab·n / (n_a·n_b), and ``odds_ratio`` with half a
    record added to each cell of the two-by-two table, so that it is finite. Only pairs in at least ``least`` records and, if
    ``part`` is given, in at least n/part records are returned; an item in fewer can't be in such a pair and is left out first.

    Equal records are counted once with a weight. A pair is one 64-bit code of two item numbers; each task sorts its codes in
    bounded runs and counts within a run before anything moves; the runs are then sorted externally by code (Spark spills
    and merges them) and run lengths counted in one pass. A pair in a third of all records thus reaches its task as one row a
    run; the commonest items' rows are joined to their counts by broadcast. More than MOST_ITEMS items that are frequent enough are an error. An empty table gives an empty result.
    """
    spark = baskets.sparkSession
    clean = baskets.select(F.array_sort(F.array_distinct(F.filter(F.col(items), lambda x: x.isNotNull()))).alias("items")).where(F.size("items") > 0)
    sets = cut(clean.groupBy("items").agg(F.count(F.lit(1)).alias("weight"))).withColumn("set_id", F.monotonically_increasing_id())
    total = sets.agg(F.sum("weight")).first()[0] or 0
    support = max(least, 1, -(-total // part) if part else 1)
    each = sets.select("set_id", "weight", F.explode("items").alias("item"))
    counts = each.groupBy("item").agg(F.sum("weight").alias("n_item")).where(F.col("n_item") >= support)
    names = cut(numbered(counts, "item", name="item_id"))
    if names.where(F.col("item_id") >= MOST_ITEMS).limit(1).count():
        raise ValueError(f"more than {MOST_ITEMS} items")
    lists = lookup_join(each, names, "item").groupBy("set_id").agg(F.sort_array(F.collect_list("item_id")).alias("ids"), F.max("weight").alias("weight"))
    runs = cut(lists.where(F.size("ids") > 1).select("ids", "weight").mapInArrow(_pack, _RUNS))
    width = tasks(spark, runs.count(), RUN_CODES)
    pairs = runs.repartition(width, "code").sortWithinPartitions("code").mapInArrow(_merged, _RUNS).where(F.col("n") >= support)
    a, b = (names.select(F.col("item_id").alias(f"id_{x}"), F.col("item").alias(f"item_{x}"), F.col("n_item").alias(f"n_{x}")) for x in "ab")
    both = cut(pairs.select(F.shiftrightunsigned("code", 32).alias("id_a"), F.col("code").bitwiseAND(F.lit((1 << 32) - 1)).alias("id_b"), F.col("n").alias("n_ab")))
    both = lookup_join(lookup_join(both, a, "id_a"), b, "id_b").withColumn("n", F.lit(total).cast("bigint"))
    n11, n10, n01 = F.col("n_ab") + 0.5, F.col("n_a") - F.col("n_ab") + 0.5, F.col("n_b") - F.col("n_ab") + 0.5
    n00 = F.col("n") - F.col("n_a") - F.col("n_b") + F.col("n_ab") + 0.5
    return both.select(
        "item_a",
        "item_b",
        "n_ab",
        "n_a",
        "n_b",
        "n",
        (F.col("n_ab") * F.col("n").cast("double") / (F.col("n_a") * F.col("n_b").cast("double"))).alias("lift"),
        (n11 * n00 / (n10 * n01)).alias("odds_ratio"),
    )


def above_chance(pairs: DataFrame, times: int) -> DataFrame:
    """Pairs at least ``times`` as frequent as if the two items were independent, compared in whole numbers."""
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    return pairs.where(wide("n_ab") * wide("n") >= wide("n_a") * wide("n_b") * times)
