"""Freely typed values to entries of a reference list."""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithgraph.functions.text import has_text
from kithgraph.operators.skew import lookup_join
from kithgraph.session import cut, tasks

#: Deletes in one dictionary, of 12 bytes each; a longer list takes several dictionaries.
PART_DELETES = 4_000_000
#: Cost of an edit: swapping neighbours and doubling or dropping a doubled letter are the likeliest slips.
SWAP, DOUBLE, EDIT = 0.9, 0.9, 1.0
MISS = -1
#: Most distinct qualifiers of a list (they are gathered as one set).
QUALIFIERS = 200_000
#: Distinct values that one task parses (ten times as many), or keys that it looks up.
TASK_VALUES = 1_000
#: A habit of writing is learned if it is seen at this many different names and makes up at least one part in HABIT_PARTS of its kind, so fewer than that are, whatever the data.
HABIT_NAMES, HABIT_PARTS = 3, 500
#: Words of a phrase beside a name, and of names that are compared word by word.
PHRASE_WORDS, NAME_WORDS = 4, 8


@dataclass(frozen=True)
class Habits:
    """What people write around names and in place of words: phrases before and after, words left out inside, other forms of a first and of a further word."""

    before: frozenset[str] = frozenset()
    after: frozenset[str] = frozenset()
    inside: frozenset[str] = frozenset()
    first: dict[str, str] = field(default_factory=dict)
    further: dict[str, str] = field(default_factory=dict)


def normal(text: str) -> str:
    """Compatibility form without marks, in lower case, runs of other characters than letters and digits as one space."""
    flat = text.lower() if text.isascii() else "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).casefold()
    return re.sub(r"[\W_]+", " ", flat).strip()


def stripped(words: list[str], habits: Habits) -> list[str]:
    """Words without the phrases around them; a phrase that is all there is stays."""
    while True:
        old = len(words)
        for n in range(min(PHRASE_WORDS, len(words) - 1), 0, -1):
            if " ".join(words[:n]) in habits.before:
                words = words[n:]
                break
        for n in range(min(PHRASE_WORDS, len(words) - 1), 0, -1):
            if " ".join(words[-n:]) in habits.after:
                words = words[:-n]
                break
        if len(words) == old:
            return words


def spelled(words: list[str], habits: Habits) -> list[str]:
    """Words with other forms written as in names, and without those that are left out."""
    if len(words) < 2:
        return words
    inner = [habits.further.get(w, w) for w in words[1:-1] if w not in habits.inside]
    return [habits.first.get(words[0], words[0]), *inner, habits.further.get(words[-1], words[-1])]


def unqualified(words: list[str], qualifiers: frozenset[str], longest: int) -> tuple[list[str], str]:
    """Words without the qualifier (of at most ``longest`` words) at one of their ends, and the qualifier ('' if there is none)."""
    for n in range(1, min(len(words), longest + 1)):
        if (q := " ".join(words[-n:])) in qualifiers:
            return words[:-n], q
        if (q := " ".join(words[:n])) in qualifiers:
            return words[n:], q
    return words, ""


def keys(text: str, habits: Habits, qualifiers: frozenset[str], longest: int) -> list[tuple[str, str, bool]]:
    """(key, qualifier, whether it must be a name as it is) that a value may mean: without the phrases around, with words as names have them, and as it was typed."""
    words = normal(text).split(" ")
    rest, q = unqualified(stripped(words, habits), qualifiers, longest)
    core = stripped(rest, habits)
    out = {("".join(core), q): False, ("".join(spelled(core, habits)), q): False}
    plain, q = unqualified(words, qualifiers, longest)
    out.setdefault(("".join(plain), q), True)
    return [(k, q, exact) for (k, q), exact in out.items()]


def deletes(key: str, n: int) -> set[str]:
    """``key`` and all strings got by deleting up to ``n`` of its characters."""
    out = level = {key}
    for _ in range(n):
        level = {k[:i] + k[i + 1 :] for k in level for i in range(len(k))}
        out = out | level
    return out


def reach(key: str) -> int:
    """Edits allowed for a key."""
    return 2 if len(key) >= 6 else 1 if len(key) >= 4 else 0


def distance(a: str, b: str, most: int = 2) -> tuple[int, float] | None:
    """Damerau-Levenshtein distance, with up to one edit between swapped letters: number of edits and their weight along the path of fewest edits and then least weight. None above ``most`` edits.

    What both start and end with is passed over; of the rest only cells within ``most`` of the diagonal are filled, and none after a row without one within ``most``.
    """
    if abs(len(a) - len(b)) > most:
        return None
    start, short = 0, min(len(a), len(b))
    while start < short and a[start] == b[start]:
        start += 1
    end = 0
    while end < short - start and a[-1 - end] == b[-1 - end]:
        end += 1
    n, m = len(a) - start - end, len(b) - start - end
    far = (most + 1, 0.0)
    a, b = (x[max(0, start - 1) : start] + x[start : start + k] for x, k in ((a, n), (b, m)))
    o = min(1, start)  # characters before the part that differs
    d: dict[tuple[int, int], tuple[int, float]] = {(0, 0): (0, 0.0)}
    for i in range(n + 1):
        alive = False
        for j in range(max(0, i - most), min(m, i + most) + 1):
            if i == j == 0:
                alive = True
                continue
            best = far
            x, y = a[o + i - 1] if i else "", b[o + j - 1] if j else ""
            if i and j:
                e, w = d.get((i - 1, j - 1), far)
                best = min(best, (e, w) if x == y else (e + 1, w + EDIT))
                if i > 1 and j > 1 and x == b[o + j - 2] and y == a[o + i - 2]:
                    e, w = d.get((i - 2, j - 2), far)
                    best = min(best, (e + 1, w + SWAP))
                if i > 2 and j > 1 and x == b[o + j - 2] and y == a[o + i - 3]:
                    e, w = d.get((i - 3, j - 2), far)
                    best = min(best, (e + 2, w + EDIT + SWAP))
                if i > 1 and j > 2 and x == b[o + j - 3] and y == a[o + i - 2]:
                    e, w = d.get((i - 2, j - 3), far)
                    best = min(best, (e + 2, w + EDIT + SWAP))
            if i:
                e, w = d.get((i - 1, j), far)
                best = min(best, (e + 1, w + (DOUBLE if o + i > 1 and x == a[o + i - 2] else EDIT)))
            if j:
                e, w = d.get((i, j - 1), far)
                best = min(best, (e + 1, w + (DOUBLE if o + j > 1 and y == b[o + j - 2] else EDIT)))
            if best[0] <= most:
                d[i, j] = best
                alive = True
        if not alive and not any((k, j) in d for k in (i - 1, i - 2) for j in range(m + 1)):
            return None
    return d.get((n, m))


#: An entry's key: (reference id, key, whether it is the alias, its qualifiers, how often the key occurs, and how often beside one of the qualifiers).
Entry = tuple[int, str, bool, list[str], int, int]


class Dictionary:
    """Symmetric-delete dictionary of a part of a reference list: hashes of the names' deletes in order, each with its name."""

    def __init__(self, entries: list[Entry]) -> None:
        self.own: dict[str, list[Entry]] = defaultdict(list)
        for entry in entries:
            self.own[entry[1]].append(entry)
        self.names = sorted({e[1] for e in entries if not e[2]})
        sizes = np.fromiter((1 + (n := len(k)) * (reach(k) > 0) + n * (n - 1) // 2 * (reach(k) > 1) for k in self.names), np.int64, len(self.names))
        hashes, of, at = np.empty(int(sizes.sum()), np.int64), np.empty(int(sizes.sum()), np.int32), 0
        for i, name in enumerate(self.names):
            for x in deletes(name, reach(name)):
                hashes[at], of[at] = hash(x), i
                at += 1
        order = np.argsort(hashes[:at], kind="stable")
        self.hashes, self.of = hashes[:at][order], of[:at][order]
        self.longest = max(map(len, self.names), default=0)

    def near(self, key: str) -> list[tuple[float, str]]:
        """Other names within reach of ``key``, with the weight of the edits."""
        n = reach(key)
        if not n or len(key) > self.longest + n:  # no name is so long
            return []
        asked = np.fromiter(map(hash, deletes(key, n)), np.int64)
        low = np.searchsorted(self.hashes, asked)
        hit = low < len(self.hashes)
        low, asked = low[hit], asked[hit]
        same = self.hashes[low] == asked
        found: set[int] = set()
        for at, h in zip(low[same].tolist(), asked[same].tolist()):
            while at < len(self.hashes) and self.hashes[at] == h:
                found.add(int(self.of[at]))
                at += 1
        out = []
        for i in found:
            name = self.names[i]
            d = distance(key, name, min(n, reach(name))) if name != key else None
            if d:
                out.append((d[1], name))
        return out

    def matches(self, key: str, exact: bool) -> list[tuple[float, Entry]]:
        """Entries whose name or alias is ``key``, and those whose name is within reach."""
        out = [(0.0, e) for e in self.own.get(key, ())]
        return out if exact else out + [(w, e) for w, name in self.near(key) for e in self.own[name] if not e[2]]


class Names:
    """Names of a part of a reference list, word by word, to learn from values that are nearly a name how people write."""

    def __init__(self, names: list[str]) -> None:
        self.keys = {n.replace(" ", "") for n in names}
        self.open: dict[tuple[int, int, str], set[str]] = defaultdict(set)
        for name in names:
            words = name.split(" ")
            for i in range(len(words)) if 1 < len(words) <= NAME_WORDS else ():
                self.open[i, len(words), " ".join(words[:i] + words[i + 1 :])].add(words[i])

    def habits(self, words: list[str]) -> Iterator[tuple[str, str, str, str]]:
        """(kind, what was typed, what the name has, name) for each way in which the words are a name but for one habit."""
        if "".join(words) in self.keys:
            return
        for n in range(1, min(PHRASE_WORDS, len(words) - 1) + 1):
            if (k := "".join(words[n:])) in self.keys:
                yield "before", " ".join(words[:n]), "", k
            if (k := "".join(words[:-n])) in self.keys:
                yield "after", " ".join(words[-n:]), "", k
        if not 1 < len(words) <= NAME_WORDS + 1:
            return
        for i, w in enumerate(words):
            rest = words[:i] + words[i + 1 :]
            if 0 < i < len(words) - 1 and (k := "".join(rest)) in self.keys:
                yield "inside", w, "", k
            for other in self.open.get((i, len(words), " ".join(rest)), ()):
                if aligned(w, other):
                    yield ("further" if i else "first"), w, other, " ".join([*words[:i], other, *words[i + 1 :]])


def aligned(a: str, b: str) -> bool:
    """Whether one word is short for the other: the same first letter, and the shorter one's letters in their order in the other."""
    short, long = sorted((a, b), key=len)
    letters = iter(long)
    return len(short) < len(long) and short[:1] == long[:1] and all(c in letters for c in short)


_cache: dict[str, object] = {}


def _cached(name: str, make):
    if name not in _cache:
        if len(_cache) > 2:
            _cache.clear()
        _cache[name] = make()
    return _cache[name]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def match(df: DataFrame, key: str, value: str, reference: DataFrame, ref_id: str, name: str, alias: str | None = None, qualifiers: tuple[str, ...] = ()) -> DataFrame:
    """``key`` and ``ref_id`` for each row whose ``value`` isn't missing (null or white space): the entry of ``reference`` meant, or -1.

    How people write is learned from the values: those that are a name of the list but for words before or after it, a word left out
    or put in, or a word that is short for the name's (the same first letter, letters in order) show such habits, and one that is seen at HABIT_NAMES different
    names and is not rare counts. A value is reduced to keys: case, marks, punctuation and spaces don't count, nor do learned phrases, and, if one
    of the list's qualifiers (such as the country) stands beside it, that. Entries whose name is within two edits of a key (one for keys
    under 6 characters, none under 4), or whose alias is a key, are candidates, if the qualifier is one of theirs. Of them counts the
    least weighted distance, then the name that occurs more often in these very values, then the entry whose qualifiers stand beside that name
    more often, then the least id. If there is no candidate, or none agrees with the qualifier, the result is -1. Rows repeat as they come; entries with a null id or name are left out; an empty list gives -1 everywhere.

    Values are first reduced to the distinct ones, each is matched once, and the result joined back, common values by broadcast. The list is
    broadcast in parts of about PART_DELETES deletes, each a sorted array of hashes on the worker, and the best over all parts counts. Gathered are the list's
    entries of one part, fewer than HABIT_PARTS habits of each kind, and at most QUALIFIERS qualifiers (more are an error).
    """
    spark = df.sparkSession
    rows = df.where(has_text(F.col(value))).select(F.col(key).alias("__key"), F.col(value).alias("value"))
    counts = cut(rows.groupBy("value").agg(F.count(F.lit(1)).alias("n")))
    entries = reference.where(F.col(ref_id).isNotNull() & F.col(name).isNotNull()).select(
        F.col(ref_id).cast("bigint").alias("ref"), F.col(name).alias("name"), (F.col(alias) if alias else F.lit(None)).cast("string").alias("alias"), F.array(*[F.col(q) for q in qualifiers]).cast("array<string>").alias("q")
    )
    entries = cut(entries.distinct().mapInArrow(_keyed, "ref bigint, name string, k string, alias boolean, own array<string>"))
    beside = entries.select(F.explode("own")).distinct().limit(QUALIFIERS + 1).collect()
    if len(beside) > QUALIFIERS:
        raise ValueError(f"more than {QUALIFIERS} qualifiers")
    known = frozenset(r[0] for r in beside)
    longest = max((q.count(" ") + 1 for q in known), default=0)
    length = F.length("k")
    parts = max(1, -(-(entries.agg(F.sum(1 + length + length * (length - 1) / 2)).first()[0] or 0) // PART_DELETES))
    parts = int(parts)
    part = lambda p: entries.where(F.pmod(F.xxhash64("ref"), F.lit(parts)) == p)
    width = tasks(spark, counts.count(), 10 * TASK_VALUES)
    counts = counts.repartition(width)

    seen = None
    for p in range(parts):
        names = spark.sparkContext.broadcast([r[0] for r in part(p).where("not alias").select("name").distinct().collect()])
        some = counts.mapInArrow(_learner(names, uuid.uuid4().hex, known, longest), "kind string, typed string, meant string, name string, n bigint")
        seen = some if seen is None else seen.unionAll(some)
    habits = _habits(seen)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("value", pa.string()), ("n", pa.int64()), ("k", pa.string()), ("q", pa.string()), ("exact", pa.bool_())])
        for b in batches:
            yield _batch([(v, n, *k) for v, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for k in keys(v, habits, known, longest)], schema)

    parsed = cut(counts.mapInArrow(parse, "value string, n bigint, k string, q string, exact boolean"))
    asked = parsed.groupBy("k", "q").agg(F.min("exact").alias("exact"))
    asked = cut(asked.repartition(tasks(spark, asked.count(), TASK_VALUES)))
    used = parsed.groupBy("k", "q").agg(F.sum("n").alias("n"))
    told = entries.join(used, "k", "left").groupBy("ref", "k", "alias", "own").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("times"), F.coalesce(F.sum(F.when(F.array_contains("own", F.col("q")), F.col("n"))), F.lit(0)).alias("times_own")
    )
    told = cut(told.select("ref", "k", "alias", "own", "times", "times_own"))
    found = None
    for p in range(parts):
        own = [tuple(r) for r in told.where(F.pmod(F.xxhash64("ref"), F.lit(parts)) == p).collect()]
        hits = asked.mapInArrow(_matcher(spark.sparkContext.broadcast(own), uuid.uuid4().hex), "k string, q string, exact boolean, weight double, less bigint, less_own bigint, ref bigint")
        found = hits if found is None else found.unionAll(hits)
    best = found.groupBy("k", "q").agg(F.min(F.struct("weight", "less", "less_own", "ref")).alias("m"))
    matched = parsed.join(best, ["k", "q"], "left").where(~F.col("exact") | (F.col("m.weight") == 0)).groupBy("value").agg(F.min("m").alias("m"))
    ids = cut(matched.select("value", F.coalesce("m.ref", F.lit(MISS)).cast("bigint").alias("__ref")))
    return lookup_join(rows, ids, "value").select(F.col("__key").alias(key), F.col("__ref").alias("ref_id"))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An entry's keys: its name's, and its alias's."""
    schema = pa.schema([("ref", pa.int64()), ("name", pa.string()), ("k", pa.string()), ("alias", pa.bool_()), ("own", pa.list_(pa.string()))])
    for b in batches:
        out = []
        for ref, name, alias, q in zip(*(c.to_pylist() for c in b.columns)):
            own, flat, other = sorted({normal(x or "") for x in q} - {""}), normal(name), normal(alias or "")
            out += [(ref, flat, flat.replace(" ", ""), False, own)] * bool(flat) + [(ref, other, other.replace(" ", ""), True, own)] * bool(other)
        yield _batch(out, schema)


def _learner(names, call: str, known: frozenset[str], longest: int):
    schema = pa.schema([("kind", pa.string()), ("typed", pa.string()), ("meant", pa.string()), ("name", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Names = _cached(call, lambda: Names(names.value))
        for b in batches:
            out = []
            for v, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rest, _ = unqualified(normal(v).split(" "), known, longest)
                out += [(*h, n) for h in index.habits(rest)]
            yield _batch(out, schema)

    return run


def _habits(seen: DataFrame) -> Habits:
    """Those of the habits ``seen`` that count; of two meanings of a word the commoner, and on ties the first."""
    each = cut(seen.groupBy("kind", "typed", "meant", "name").agg(F.sum("n").alias("n")))
    total = each.groupBy("kind").agg(F.sum("n").alias("total"))
    kept = each.groupBy("kind", "typed", "meant").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("names")).where(F.col("names") >= HABIT_NAMES)
    kept = kept.join(F.broadcast(total), "kind").where(F.col("n") * HABIT_PARTS >= F.col("total")).collect()
    phrases = {k: frozenset(r.typed for r in kept if r.kind == k) for k in ("before", "after", "inside")}
    forms = {k: {r.typed: r.meant for r in sorted(kept, key=lambda r: (r.n, r.meant)) if r.kind == k} for k in ("first", "further")}
    return Habits(**phrases, **forms)


def _matcher(sent, call: str):
    schema = pa.schema([("k", pa.string()), ("q", pa.string()), ("exact", pa.bool_()), ("weight", pa.float64()), ("less", pa.int64()), ("less_own", pa.int64()), ("ref", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Dictionary = _cached(call, lambda: Dictionary(sent.value))
        for b in batches:
            out: list[tuple] = []
            for k, q, exact in zip(*(c.to_pylist() for c in b.columns)):
                for weight, (ref, _, _, own, times, times_own) in index.matches(k, exact):
                    if not q or not own or q in own:
                        out.append((k, q, exact, weight, -times, -times_own, ref))
            yield _batch(out, schema)

    return run
