"""Sparse matrices in long form: (row, col, w), at most one entry a cell."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithgraph.operators import packed
from kithgraph.operators.skew import dealt_join
from kithgraph.session import cut

#: Entries of the rows that asked ones are multiplied with at once.
DOT_ENTRIES = 100_000


def row_sums(m: DataFrame) -> DataFrame:
    """``row`` and the sum of its entries."""
    return m.groupBy("row").agg(F.sum("w").alias("w"))


def scale_rows(m: DataFrame, scale: DataFrame) -> DataFrame:
    """Each row times its factor (``row``, ``s``); rows without factor vanish."""
    return m.join(scale, "row").select("row", "col", (F.col("w") * F.col("s")).alias("w"))


def vector_times(v: DataFrame, m: DataFrame) -> DataFrame:
    """Row vector (``row``, ``x``) times matrix: ``col``, ``x``."""
    return v.join(m, "row").groupBy("col").agg(F.sum(F.col("x") * F.col("w")).alias("x"))


def transpose(m: DataFrame) -> DataFrame:
    """Rows and columns exchanged."""
    return m.select(F.col("col").alias("row"), F.col("row").alias("col"), "w")


def times(a: DataFrame, b: DataFrame) -> DataFrame:
    """Matrix product, summed where it is met before it is moved."""
    left = a.select("row", F.col("col").alias("__k"), F.col("w").alias("__a"))
    right = b.select(F.col("row").alias("__k"), "col", F.col("w").alias("__b"))
    return left.join(right, "__k").groupBy("row", "col").agg(F.sum(F.col("__a") * F.col("__b")).alias("w"))


def normalised(m: DataFrame, norm: str) -> DataFrame:
    """Rows divided by their L1 or L2 norm; rows of zeros stay as they are."""
    size = F.sum(F.abs("w")) if norm == "l1" else F.sqrt(F.sum(F.col("w") * F.col("w")))
    sizes = m.groupBy("row").agg(size.alias("__size"))
    return m.join(sizes, "row").select("row", "col", F.when(F.col("__size") > 0, F.col("w") / F.col("__size")).otherwise(F.col("w")).alias("w"))


def standardised(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Each column minus its mean, divided by its population deviation (1 where that is 0), over all rows or over each group ``by``. Nulls stay null."""
    moments = [f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    # without groups the moments are one row, with groups one for each group
    joined = df.join(df.groupBy(*by).agg(*moments), by) if by else df.crossJoin(F.broadcast(df.agg(*moments)))

    def scaled(c: str) -> Column:
        s = F.col(f"__s_{c}")
        return ((F.col(c) - F.col(f"__m_{c}")) / F.when(s > 0, s).otherwise(1.0)).alias(c)

    return joined.select(*[scaled(c) if c in columns else F.col(c) for c in df.columns])


def dot(a: DataFrame, b: DataFrame) -> DataFrame:
    """Inner products of the rows of two matrices over shared columns: ``a``, ``b``, ``sim``; pairs without a shared column are absent. A column of very many rows of ``b`` is dealt to several tasks."""
    left = a.select(F.col("row").alias("a"), F.col("col").alias("__k"), F.col("w").alias("__a"))
    right = b.select(F.col("row").alias("b"), F.col("col").alias("__k"), F.col("w").alias("__b"))
    return dealt_join(left, right, "__k").groupBy("a", "b").agg(F.sum(F.col("__a") * F.col("__b")).alias("sim"))


def dot_of(asked: DataFrame, b: DataFrame, digits: int) -> DataFrame:
    """``dot`` of a stated set of rows, rounded to ``digits``: these are sent to every task, the rows of ``b`` are dealt to tasks by row, and no pair is moved. More of them than may be sent, or ids that aren't whole, take the way of ``dot``."""
    asked, b = (x.select("row", "col", "w") for x in (cut(asked), b))
    if not (packed.whole_numbers(asked, "row") and packed.whole_numbers(b, "row") and packed.few(asked)):
        return dot(asked, b).withColumn("sim", F.round("sim", digits))
    row, col, w = packed.gathered(asked, "row", "col", "w")
    ids, (row,) = packed.coded(row)
    columns, (col,) = packed.coded(col)
    sent = b.sparkSession.sparkContext.broadcast((ids, columns, packed.Sparse(row, col, w, (len(ids), len(columns))), len(w) and w.min()))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        ids, columns, a, least = sent.value
        for table in packed.whole_rows(batches, DOT_ENTRIES):
            row, col, w = (c.combine_chunks() for c in table.columns)
            row, w = (c.to_numpy(zero_copy_only=False) for c in (row, w))
            if isinstance(columns, np.ndarray):
                at = packed.number(columns, col.to_numpy(zero_copy_only=False))
            else:
                at = pc.fill_null(pc.index_in(col, value_set=columns), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            names, own = np.unique(row[at >= 0], return_inverse=True)
            by = packed.Sparse(at[at >= 0], own, w[at >= 0], (len(columns), len(names)))
            above = min(least, w.min(initial=1.0)) > 1e-100  # then no product is lost, and pairs that share a column are those above 0
            for i in range(len(ids)):
                cols = a.row(i)
                sim = by.spread(cols, a.weights(i))
                met = np.flatnonzero(sim if above else by.counts(cols))
                yield np.full(len(met), ids[i]), names[met], packed.rounded(sim[met], digits) / 10.0**digits

    tasks = 6 * b.sparkSession.sparkContext.defaultParallelism
    return b.dropna().repartition(tasks, "row").sortWithinPartitions("row").mapInArrow(packed.in_batches(of, schema := "a bigint, b bigint, sim double"), schema)
