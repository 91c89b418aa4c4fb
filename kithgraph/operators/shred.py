"""Nested records to flat tables that keep their parent-child links."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A record's triples: a leaf's path from the record ('[]' marks what is repeated), its place in each repeated thing on the way, from 0, and its value as text.
TRIPLES = "array<struct<path:string,ordinals:array<int>,value:string>>"
_RECORDS = pa.schema([
    ("key", pa.int64()), ("record", pa.int32()), ("triples", pa.list_(pa.struct([("path", pa.string()), ("ordinals", pa.list_(pa.int32())), ("value", pa.string())]))),
])
#: Triples in one Arrow batch of output.
BATCH = 50_000
#: One token of JSON: punctuation, string, number, name.
_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|"([^"\\\x00-\x1f]*(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*)*)"|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)|(true|false|null))')
_WHITE = re.compile(r"[ \t\n\r]*")


def groups(schema: T.StructType) -> dict[str, list[str]]:
    """The leaf paths of a schema by their nearest repeated ancestor ('' for the record itself); '[]' marks what is repeated."""
    out: dict[str, list[str]] = {"": []}

    def walk(kind: T.DataType, path: str, group: str) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(f.dataType, f"{path}.{f.name}" if path else f.name, group)
        elif isinstance(kind, T.ArrayType):
            out.setdefault(f"{path}[]", [])
            walk(kind.elementType, f"{path}[]", f"{path}[]")
        else:
            out[group].append(path)

    walk(schema, "", "")
    return out


def record_table(df: DataFrame, keys: Mapping[str, Column], paths: Mapping[str, str]) -> DataFrame:
    """One row for each record of a typed nested table: ``keys`` and the leaves at ``paths`` (column name: dotted path). A path through a null struct is null."""
    return df.select(*[c.alias(k) for k, c in keys.items()], *[F.col(p).alias(k) for k, p in paths.items()])


def child_table(df: DataFrame, keys: Mapping[str, Column], array: str, leaves: Mapping[str, str]) -> DataFrame:
    """One row for each element of the array at the path ``array``: ``keys``, ``pos`` (from 0, null elements counted), and the element's leaves.

    Null and empty arrays give no row; a null element gives a row of nulls.
    """
    each = df.select(*[c.alias(k) for k, c in keys.items()], F.posexplode(F.col(array)).alias("pos", "__e"))
    return each.select(*keys, "pos", *[F.col(f"__e.{p}").alias(k) for k, p in leaves.items()])


class _Node:
    """A place in a document that a root or a wanted path goes through."""

    def __init__(self) -> None:
        self.children: dict[str, _Node] = {}
        self.root: int | None = None
        self.leaves: list[tuple[int, str, int]] = []  # root, path, repeated things above the root
        self.inherits: list[str] = []

    def at(self, steps: Sequence[str]) -> _Node:
        node = self
        for s in steps:
            node = node.children.setdefault(s, _Node())
        return node

    def below(self) -> Iterator[_Node]:
        yield self
        for c in self.children.values():
            yield from c.below()


class Shredder:
    """Reads JSON text token by token and keeps the wanted leaves of its records; memory follows these and the depth, not the document."""

    def __init__(self, roots: Sequence[str], paths: Sequence[str], inherited: Mapping[str, str]) -> None:
        self.top, self.direct = _Node(), [not r for r in roots]
        for k, root in enumerate(roots):
            steps = _steps(root)
            start = self.top.at(steps)
            start.root = k
            for p in paths:
                start.at(_steps(p)).leaves.append((k, p, steps.count("[]")))
        for a, b in inherited.items():
            self.top.at(_steps(a)).inherits.append(b)

    def records(self, text: str) -> list[dict[tuple[str, tuple[int, ...]], str]]:
        """The leaves of each record by path and places, records by root and then as they stand; none if the text is no complete JSON document."""
        found: list[list[tuple[tuple[int, ...], dict]]] = [[] for _ in self.direct]
        handed: dict[str, str] = {}
        stack: list[tuple[bool, _Node | None, set[str] | None, int | None]] = []  # whether an array, its node, names met, root of the record it is
        places: list[int] = []
        node: _Node | None = self.top
        key_next, value_next, closing, pos = False, True, False, 0
        match = _TOKEN.match
        while True:
            m = match(text, pos)
            if m is None:
                break
            pos, kind = m.end(), m.lastindex
            if kind == 1:
                c = m.group(1)
                if c in "{[":
                    if not value_next:
                        return []
                    root = None
                    if c == "{" and node is not None and node.root is not None:
                        root = node.root
                        found[root].append((tuple(places), {}))
                    array = c == "["
                    stack.append((array, node, None if array or node is None else set(), root))
                    if array:
                        places.append(0)
                        node = node.children.get("[]") if node is not None else None
                    key_next, value_next, closing = not array, array, True
                elif c in "}]":
                    if not stack or not closing or stack[-1][0] != (c == "]"):
                        return []
                    if stack.pop()[0]:
                        places.pop()
                    key_next, value_next, closing = False, False, bool(stack)
                elif c == ",":
                    if not stack or key_next or value_next or not closing:
                        return []
                    array, parent, _, _ = stack[-1]
                    if array:
                        places[-1] += 1
                        node = parent.children.get("[]") if parent is not None else None
                    key_next, value_next, closing = not array, array, False
                else:  # a colon is taken with its name
                    return []
                if not stack and not value_next:
                    break
                continue
            if key_next:
                if kind != 2 or not (colon := match(text, pos)) or colon.group(1) != ":":
                    return []
                pos = colon.end()
                _, parent, names, _ = stack[-1]
                node = None
                if parent is not None:
                    name = _string(m.group(2))
                    node = parent.children.get(name)
                    if node is not None:
                        if name in names:
                            self._forget(node, places, found, handed)
                        names.add(name)
                key_next, value_next, closing = False, True, False
                continue
            if not value_next:
                return []
            if node is not None and (node.leaves or node.inherits):
                value = _string(m.group(2)) if kind == 2 else _number(m.group(3)) if kind == 3 else None if m.group(4) == "null" else m.group(4)
                if value is not None:
                    for root, path, above in node.leaves:
                        if any(f[3] == root for f in stack):
                            found[root][-1][1][path, tuple(places[above:])] = value
                    for to in node.inherits:
                        handed[to] = value
            key_next, value_next, closing = False, False, True
            if not stack:
                break
        if stack or value_next or _WHITE.match(text, pos).end() != len(text):
            return []
        out = []
        for direct, records in zip(self.direct, found):
            for _, leaves in records:
                out.append(leaves if direct else leaves | {(to, ()): v for to, v in handed.items()})
        return out

    @staticmethod
    def _forget(node: _Node, places: list[int], found: list, handed: dict[str, str]) -> None:
        """Drop what an earlier value of a repeated name gave."""
        here, dropped = tuple(places), {below.root for below in node.below()}
        for below in node.below():
            if below.root is not None:
                found[below.root] = [r for r in found[below.root] if r[0][: len(here)] != here]
            for root, path, above in below.leaves:
                if root not in dropped and found[root]:
                    leaves = found[root][-1][1]
                    for k in [k for k in leaves if k[0] == path and k[1][: len(here) - above] == here[above:]]:
                        del leaves[k]
            for to in below.inherits:
                handed.pop(to, None)


def _string(raw: str) -> str:
    return json.loads(f'"{raw}"').encode("utf-8", "replace").decode() if "\\" in raw else raw


def _number(raw: str) -> str:
    return repr(float(raw)) if any(c in raw for c in ".eE") else "0" if raw == "-0" else raw


def json_records(df: DataFrame, key: str, text: str, roots: Sequence[str], paths: Sequence[str], inherited: Mapping[str, str] | None = None) -> DataFrame:
    """JSON text to records as path-value-ordinal triples: ``key``, ``record``, ``triples``.

    ``roots`` are the places where records stand, such as '' (the text is a record), '[]' or 'page.commits[]'; ``record``
    counts a text's records from 0. ``paths`` are the leaves wanted, seen from the record, with any number of '[]', whose
    places (from 0, nulls and odd elements counted) are the triple's ordinals. A leaf with an object, an
    array or null gives no triple; booleans come as true and false, whole numbers as digits. ``inherited`` (path in the text:
    path in the record) hands a value of the text down to all its records except that of the root '', in place of their own.
    Texts that are null, empty, incomplete or no JSON, or that hold no record, give nothing; of a
    repeated name the last counts. ``key`` must be an integer; a null key is kept. Texts are parsed as a stream of tokens, however deep, and what isn't wanted is passed over.
    """
    shredder = Shredder(roots, paths, inherited or {})

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        batch_of = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [[]] * 3, _RECORDS)], schema=_RECORDS)
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                for n, leaves in enumerate(shredder.records(t.as_py() or "")):
                    rows.append((k, n, [{"path": p, "ordinals": o, "value": v} for (p, o), v in leaves.items()]))
                    held += 1 + len(leaves)
                if held >= BATCH:
                    yield batch_of()
                    rows, held = [], 0
        yield batch_of()

    return df.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")).mapInArrow(parse, f"key bigint, record int, triples {TRIPLES}")


def typed_records(df: DataFrame, key: Column, paths: Sequence[str]) -> DataFrame:
    """Rows of a typed nested table to records as triples: ``key``, ``record`` (0), ``triples`` of the leaves at ``paths``; null leaves, and those below null structs, arrays and elements, give none."""
    none = F.array().cast(TRIPLES)

    def triples(value: Column, steps: tuple[str, ...], path: str, places: tuple[Column, ...]) -> Column:
        for i, s in enumerate(steps):
            if s == "[]":
                inner = F.transform(value, lambda e, n: triples(e, steps[i + 1 :], path, (*places, n)))
                return F.coalesce(F.flatten(inner), none)
            value = F.col(s) if value is None else value[s]
        own = F.struct(F.lit(path).alias("path"), (F.array(*places) if places else F.array().cast("array<int>")).alias("ordinals"), value.cast("string").alias("value"))
        return F.when(value.isNotNull(), F.array(own)).otherwise(none)

    return df.select(key.cast("bigint").alias("key"), F.lit(0).alias("record"), F.concat(*[triples(None, _steps(p), p, ()) for p in paths]).alias("triples"))


def _steps(path: str) -> tuple[str, ...]:
    return tuple(x for part in path.split(".") for x in ((part[:-2], "[]") if part.endswith("[]") else (part,)) if x)


def root_columns(records: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """``records`` with the leaves of the record itself as ``columns`` (name: path without '[]'), null where there is none; no shuffle."""
    value = lambda p: F.get(F.filter("triples", lambda t: t.path == p), F.lit(0)).value
    return records.withColumns({c: value(p) for c, p in columns.items()})


def group_table(records: DataFrame, keys: Sequence[str], group: str, columns: Mapping[str, str]) -> DataFrame:
    """The table of what is repeated at ``group`` (a path that ends in '[]'): ``keys`` of the record, ``ordinals`` (the place of each element and of all above it, which ties it to its parents' tables),
    and its leaves as ``columns`` (name: path with the same '[]'). Elements without any of the leaves have no row.

    With one column the triples are the table; with more they are put together by record and place, each task's own first.
    """
    depth = group.count("[]")
    own = F.filter("triples", lambda t: t.path.isin(*columns.values()))
    each = records.select("key", "record", *keys, F.inline(own)).withColumn("ordinals", F.slice("ordinals", 1, depth))
    if len(columns) == 1:
        return each.select(*keys, "ordinals", F.col("value").alias(next(iter(columns))))
    picked = [F.max(F.when(F.col("path") == p, F.col("value"))).alias(c) for c, p in columns.items()]
    return each.groupBy("key", "record", *keys, "ordinals").agg(*picked).select(*keys, "ordinals", *columns)
