"""Test items that stand in a corpus."""

from __future__ import annotations

import re
import uuid
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Consecutive words of a passage that make a leak.
WORDS = 13
#: Bytes of item text in one automaton; more items are searched for in several scans. A word takes about 100 bytes of a worker's memory, so such an automaton takes less than 200 MB.
ITEM_BYTES = 8_000_000
#: Windows of items that were met last and are kept at hand (about 200 bytes each).
WINDOWS = 100_000
#: Longest runs of letters or digits.
_WORD = re.compile(r"[^\W_]+")
_SPANS = "{key} {kind}, item_id bigint, start int, end int, n_words int, answer boolean"


class Index:
    """One automaton over the items' passages and answers, words being numbered.

    A passage is in it once, cut into blocks of half a leak's words: any run of ``words`` words of the passage holds a whole block, so every leak is met, and a
    word takes one node. Where a block is met, the windows around it are compared with the item's.
    """

    def __init__(self, items: list[tuple[int, str, str | None]], words: int) -> None:
        self.words, self.block, self.number = words, (words + 1) // 2, {}
        self.passages: dict[int, array] = {}
        self.of: list[int] = []
        self._windows: dict[int, set[bytes]] = {}
        self._kept = 0
        blocks: dict[tuple[int, ...], set[int]] = defaultdict(set)
        answers: dict[tuple[int, ...], set[int]] = defaultdict(set)
        number = lambda text: array("I", [self.number.setdefault(w, len(self.number) + 1) for w in spoken(text)])
        for k, (item, passage, answer) in enumerate(items):
            self.of.append(item)
            run = self.passages[k] = number(passage)
            for i in range(0, len(run) - self.block + 1 if len(run) >= words else 0, self.block):
                blocks[tuple(run[i : i + self.block])].add(k)
            if answer and (said := tuple(number(answer))):
                answers[said].add(k)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        self.empty = not blocks
        for key in blocks.keys() | answers.keys():
            self.automaton.add_word(key, (tuple(sorted(blocks.get(key, ()))), tuple(sorted(answers.get(key, ())))))
        if not self.empty:
            self.automaton.make_automaton()

    def windows(self, k: int) -> set[bytes]:
        """All runs of ``words`` words of a passage."""
        if k not in self._windows:
            run = self.passages[k]
            if self._kept > WINDOWS:
                self._windows, self._kept = {}, 0
            self._windows[k] = {run[i : i + self.words].tobytes() for i in range(len(run) - self.words + 1)}
            self._kept += len(self._windows[k])
        return self._windows[k]

    def find(self, text: str) -> list[tuple[int, int, int, int, bool]]:
        """Item, start and end in code points of the text as it is, words matched, and whether the item's answer stands in the text too; one for each maximal run."""
        found = _WORD.findall(text.lower()) if text.isascii() else spoken(text)
        if len(found) < self.words or self.empty:
            return []
        seen = array("I", map(self.number.get, found, repeat(0)))
        starts: dict[int, set[int]] = defaultdict(set)
        answered: set[int] = set()
        for end, (blocks, answers) in self.automaton.iter(tuple(seen)):
            answered.update(answers)
            for k in blocks:
                starts[k].update(range(max(0, end - self.words + 1), min(end - self.block + 1, len(seen) - self.words) + 1))
        if not starts:
            return []
        spans, out = None, []
        for k, some in starts.items():
            own = self.windows(k)
            runs: list[list[int]] = []
            for i in sorted(some):
                if seen[i : i + self.words].tobytes() in own:
                    if runs and runs[-1][1] == i - 1:
                        runs[-1][1] = i
                    else:
                        runs.append([i, i])
            if runs:
                spans = spans or [m.span() for m in _WORD.finditer(text)]
                out += [(self.of[k], spans[a][0], spans[b + self.words - 1][1], b - a + self.words, k in answered) for a, b in runs]
        return out


def spoken(text: str) -> list[str]:
    """The longest runs of letters or digits, in lower case."""
    return [w.lower() for w in _WORD.findall(text)]


_cache: dict[object, Index] = {}


def find_leaks(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, passage: str, answer: str | None = None, words: int = WORDS) -> DataFrame:
    """Every maximal run of at least ``words`` consecutive words of an item's passage in a text, whatever stands between the words.

    Words are the longest runs of letters or digits, in lower case. Result: ``key``, ``item_id``, ``start`` and ``end`` (code points in the text
    as it is, end excluded), ``n_words``, and ``answer``: whether the item's answer stands anywhere in the text as whole words. Null and
    empty texts and passages with fewer words give nothing; null item ids are left out; repeated items count once, repeated
    documents each. Documents aren't shuffled; each text is read once by one automaton over passages and answers. Items are broadcast up to ITEM_BYTES;
    more are dealt to several automata of about that size, each with a scan of its own, so no task holds them all.
    """
    spark = docs.sparkSession
    own = items.select(
        F.col(item_key).cast("bigint").alias("item"), F.col(passage).alias("passage"), (F.col(answer) if answer else F.lit(None)).cast("string").alias("answer")
    ).where(F.col("item").isNotNull() & F.col("passage").isNotNull())
    size = own.agg(F.sum(F.octet_length("passage") + F.coalesce(F.octet_length("answer"), F.lit(0)))).first()[0] or 0
    scans = max(1, -(-size // ITEM_BYTES))
    kind = docs.schema[key].dataType.simpleString()
    schema = _SPANS.format(key=f"`{key}`", kind=kind)
    out = None
    for k in range(scans):
        rows = [tuple(r) for r in own.where(F.pmod(F.xxhash64("item"), F.lit(scans)) == k).distinct().collect()]
        sent = spark.sparkContext.broadcast(rows)
        found = docs.select(key, text).mapInArrow(_scanner(sent, uuid.uuid4().hex, words, key, docs.schema[key].dataType), schema)
        out = found if out is None else out.unionAll(found)
    return out


def _scanner(sent, name, words, key, key_type):
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(key_type)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _cache.get(name)
        if index is None:
            _cache.clear()
            index = _cache[name] = Index(sent.value, words)
        for batch in batches:
            at: list[int] = []
            rows: list[tuple] = []
            for i, t in enumerate(batch.column(1)):
                hits = index.find(t.as_py() or "")
                at += [i] * len(hits)
                rows += hits
            columns = list(zip(*rows)) or [[], [], [], [], []]
            types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())
            keys = batch.column(0).take(pa.array(at, pa.int64())).cast(kind)
            yield pa.RecordBatch.from_arrays([keys, *(pa.array(c, t) for c, t in zip(columns, types))], [key, "item_id", "start", "end", "n_words", "answer"])

    return scan
