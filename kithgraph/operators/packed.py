"""Sparse tables small enough to be sent to every task: what an asked row meets is summed there, so its pairs aren't shuffled.

Tables beyond ENTRIES take the relational way instead; the results are the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Most entries of a table that is gathered and sent (24 bytes each in a task).
ENTRIES = 12_000_000
#: Rows of a batch of results.
BATCH = 200_000


class Sparse:
    """A matrix by rows: row r has columns ``idx[ptr[r]:ptr[r + 1]]`` with weights ``w`` there (None: all 1)."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, w: np.ndarray | None, shape: tuple[int, int]) -> None:
        order = np.argsort(rows, kind="stable")
        self.shape, self.idx, self.w = shape, cols[order].astype(np.int64), None if w is None else w[order].astype(float)
        self.ptr = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=shape[0])))).astype(np.int64)
        self._of: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_of": None}

    @property
    def rows(self) -> np.ndarray:
        """The row of each entry."""
        if self._of is None:
            self._of = np.repeat(np.arange(self.shape[0]), np.diff(self.ptr))
        return self._of

    def transposed(self) -> Sparse:
        return Sparse(self.idx, self.rows, self.w, self.shape[::-1])

    def row(self, r: int) -> np.ndarray:
        return self.idx[self.ptr[r] : self.ptr[r + 1]]

    def weights(self, r: int) -> np.ndarray:
        return np.ones(self.ptr[r + 1] - self.ptr[r]) if self.w is None else self.w[self.ptr[r] : self.ptr[r + 1]]

    def entries(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the entries of the rows ``at``, one row after the other, and how many each has."""
        n = self.ptr[at + 1] - self.ptr[at]
        return np.repeat(self.ptr[at] - np.cumsum(n) + n, n) + np.arange(n.sum()), n

    def counts(self, at: np.ndarray) -> np.ndarray:
        """For each column, how many of the rows ``at`` have it."""
        if len(at) == 1:
            return np.bincount(self.row(at[0]), minlength=self.shape[1])
        return np.bincount(self.idx[self.entries(at)[0]], minlength=self.shape[1])

    def spread(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The rows ``at`` times ``x``, summed: a value for each column."""
        n = self.ptr[at + 1] - self.ptr[at]
        if 2 * n.sum() > len(self.idx):  # nearly all entries, so they are gone through as they lie
            values, cols = np.bincount(at, x, self.shape[0])[self.rows], self.idx
            if self.w is not None:
                values = values * self.w
        else:
            where, n = self.entries(at)
            values, cols = np.repeat(x, n), self.idx[where]
            if self.w is not None:
                values = values * self.w[where]
        return np.bincount(cols, values, self.shape[1])


def few(*tables: DataFrame) -> bool:
    """Whether all tables may be sent. They should be cut, they are read again."""
    return all(t.limit(ENTRIES + 1).count() <= ENTRIES for t in tables)


def whole_numbers(df: DataFrame, *columns: str) -> bool:
    return all(kind in ("tinyint", "smallint", "int", "bigint") for name, kind in df.dtypes if name in columns)


def gathered(df: DataFrame, *columns: str) -> list[np.ndarray]:
    """The columns of the rows that have them all."""
    table = df.select(*columns).dropna().toArrow()
    return [c.combine_chunks().to_numpy(zero_copy_only=False) if not pa.types.is_string(c.type) else c.combine_chunks() for c in table.columns]


def coded(*parts: np.ndarray | pa.Array) -> tuple[np.ndarray | pa.Array, list[np.ndarray]]:
    """The distinct ids of all parts and the parts as numbers of these. Whole numbers are sorted, strings in order of appearance."""
    if any(isinstance(p, (pa.Array, pa.ChunkedArray)) for p in parts):
        both = pa.chunked_array([c for p in parts for c in (p.chunks if isinstance(p, pa.ChunkedArray) else [p])], pa.string()).combine_chunks().dictionary_encode()
        codes, ids = both.indices.to_numpy(zero_copy_only=False).astype(np.int64), both.dictionary
    else:
        ids, codes = np.unique(np.concatenate(parts), return_inverse=True)
    return ids, np.split(codes, np.cumsum([len(p) for p in parts])[:-1])


def number(ids: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Numbers of whole ids among sorted ones, -1 for those that aren't."""
    if not len(ids):
        return np.full(len(of), -1)
    at = np.minimum(np.searchsorted(ids, of), len(ids) - 1)
    return np.where(ids[at] == of, at, -1)


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Values times 10^digits as whole numbers, halves away from zero."""
    y = np.abs(x * 10.0**digits)
    low = np.floor(y)
    return np.copysign(low + (y - low >= 0.5), x)


def first(q: np.ndarray, n: int | None) -> np.ndarray:
    """Positions of the ``n`` (None: all) greatest values, greatest first, equal ones in order."""
    if n is None or n >= len(q):
        return np.argsort(-q, kind="stable")
    if n < 1:
        return np.zeros(0, np.int64)
    least = np.partition(q, len(q) - n)[len(q) - n]
    above = np.flatnonzero(q > least)
    above = above[np.argsort(-q[above], kind="stable")]
    return np.concatenate((above, np.flatnonzero(q == least)[: n - len(above)]))


def each(asked: DataFrame, key: str, of: Callable[[np.ndarray | pa.Array], Iterator[tuple]], schema: str, width: int = 1) -> DataFrame:
    """``of`` gets the asked ids (column ``key``), ``width`` at most at once, and yields columns of results; the ids are spread over tasks."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            ids = batch.column(0)
            for k in range(0, len(ids), width):
                some = ids.slice(k, width)
                yield from of(some if pa.types.is_string(some.type) else some.to_numpy(zero_copy_only=False))

    spark = asked.sparkSession
    asked = asked.select(key).dropna().distinct()
    tasks = max(1, min(-(-asked.count() // width), 6 * spark.sparkContext.defaultParallelism))
    return asked.repartition(tasks, key).mapInArrow(in_batches(parts, schema), schema)


def in_batches(of: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]], schema: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What ``of`` yields as columns, put together to batches of about BATCH rows."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[pa.Array]] = []
        size = 0
        for columns in of(batches):
            held.append([pa.array(c, t) if isinstance(c, np.ndarray) else c for c, t in zip(columns, types)])
            size += len(held[-1][0])
            if size >= BATCH:
                yield from _joined(held, names)
                held, size = [], 0
        yield from _joined(held, names)

    return run


def whole_rows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Batches that are sorted by their first column put together to tables of ``size`` rows at least (but the last) in which no value of that column is split."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= size:
            whole = pa.Table.from_batches(held).combine_chunks()
            ids = whole.column(0).combine_chunks().to_numpy(zero_copy_only=False)
            end = int(np.searchsorted(ids, ids[-1]))  # the last may go on in the next batch
            if end:
                yield whole.slice(0, end)
            held = whole.slice(end).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _joined(held: list[list[pa.Array]], names: list[str]) -> Iterator[pa.RecordBatch]:
    if held:
        whole = pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*held)], names=names)
        for k in range(0, len(whole), BATCH):
            yield whole.slice(k, BATCH)
