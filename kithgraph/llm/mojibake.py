"""Text that was decoded with the wrong character encoding: finding it and restoring it."""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithgraph.operators.skew import likely_in
from kithgraph.session import cut, tasks

#: Encodings in which UTF-8 may have been read.
READ_AS = ("cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "cp866", "koi8_r", "iso8859_2", "iso8859_15")
#: Fixed values: (written in, read as) pairs of encodings with one byte a character.
SINGLE = tuple((w, r) for w in ("cp1251", "koi8_r", "cp866") for r in ("cp1252", "latin-1", "cp1251", "koi8_r", "cp866", "mac_roman", "cp437", "cp850") if w != r) + tuple(
    (w, r) for w in ("cp1252", "mac_roman", "cp850", "cp437") for r in ("cp1252", "cp1251", "cp437", "cp850", "mac_roman", "cp1250", "cp866", "koi8_r") if w != r
)
#: Bytes that are lost most often: without a character in a common encoding, or a space or hyphen nobody sees.
OFTEN_LOST = (0xA0, 0xAD, 0x81, 0x8D, 0x8F, 0x90, 0x9D)
#: Costs in nats: of a byte supposed lost, of passing from sound text to a channel or between channels; the gain that makes a text a case.
LOST, SWITCH, GAIN = 4.0, 1.5, 1.0
#: What a lost character tells by itself.
REPLACED = 5.0
#: What a known reading of a token too short to tell by itself is worth beside others of its channel.
BESIDE = 0.001
#: Bounds, in nats, of what the frequencies of two words may tell against the likelihood of their characters.
WORD_LOW, WORD_HIGH = -6.0, 3.0
#: Cost of an ASCII letter in a reading that isn't a known word.
LETTER = 3.0
#: Of the occurrences of the words that fit a damaged one, the share that the commonest needs to be taken for it.
SURE = 2 / 3
#: Bytes of one character that may be lost at once.
MOST_LOST = 2
#: Times that UTF-8 may have been read in the same encoding.
DEPTHS = 3

#: Distinct tokens that one task reads through all channels, and words that one task fits to damaged ones.
TASK_TOKENS = 2_000
#: Parts of the commonest tokens' rows, and the share of all occurrences (one in so many) that makes a token one of these.
SALTS, HOT_PARTS = 64, 500

_HIGH, _REFERENCE = r"\x{80}-\x{10ffff}", "&(?:[A-Za-z]{2,8}|#[0-9]{2,5});"
#: Whole runs of letters and other characters than ASCII that have such a character or a character reference; from a reference on also of what
#: references are made of. No group is repeated (Java would recurse) and a run is only looked at from its start, so time is linear.
TOKEN = f"(?<![A-Za-z{_HIGH}])[A-Za-z]*+(?:[{_HIGH}][A-Za-z{_HIGH}]*+(?:{_REFERENCE}[A-Za-z0-9&#;{_HIGH}]*+)?|{_REFERENCE}[A-Za-z0-9&#;{_HIGH}]*+)"
#: The same for Python.
PYTHON_TOKEN = TOKEN.replace(_HIGH, "\x80-\U0010ffff")
_MARK = "�"
#: Label of a lattice's edge for any character beyond ASCII.
_ANY = ""
#: Characters of a word's two ends that are looked up, and most readings of an end.
_ENDS, MOST_ENDS = 4, 12

#: node -> edges (next node, character, bytes supposed lost, whether the last channel made it); nodes are places in the text.
Lattice = list[list[tuple[int, str, int, bool]]]


@lru_cache(maxsize=None)
def _bytes_of(encoding: str) -> dict[str, int]:
    """Character to byte; bytes without a character stand for the control character of their number."""
    table: dict[str, int] = {}
    for b in range(256):
        try:
            c = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            c = chr(b)
        table.setdefault(c, b)
    return table


@lru_cache(maxsize=None)
def _blank(encoding: str) -> tuple[int, ...]:
    """Continuation bytes without a character in the encoding."""
    known = set(_bytes_of(encoding).values())
    return tuple(b for b in range(0x80, 0xC0) if b not in known or _bytes_of(encoding).get(chr(b)) == b and chr(b) < "\xa0") or tuple(range(0x80, 0xC0))


def _width(lead: int) -> int:
    return 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 0


@lru_cache(maxsize=None)
def _may_be(encoding: str) -> re.Pattern:
    """What a text must have to be UTF-8 read in the encoding, one byte missing or not."""
    of = lambda low, high: re.escape("".join(c for c, b in _bytes_of(encoding).items() if low <= b <= high and c >= "\x80"))
    follows = f"[{of(0x80, 0xBF)}{_MARK}]"
    return re.compile(f"[{of(0xC2, 0xDF)}]|[{of(0xE0, 0xEF)}]{follows}|[{of(0xF0, 0xF4)}]{follows}{follows}")


def plain(text: str) -> Lattice:
    """The lattice of a text that is read as it is."""
    return [[(i + 1, c, 0, False)] for i, c in enumerate(text)]


def decoded(lattice: Lattice, encoding: str) -> Lattice | None:
    """The lattice of texts whose UTF-8 bytes, read in ``encoding``, may have become one of ``lattice``'s; None if there is none.

    A character is its byte, a replacement mark any byte without a character, and after a lead byte the last byte may be missing where no
    continuation follows. What is no UTF-8 stays as it is, so partly damaged text is read too; where a sequence is complete, it is read. Paths with the same
    character between the same places are one edge (the one of fewest lost bytes), so the lattice is linear in the text.
    """
    table, out, any_new = _bytes_of(encoding), [], False
    for edges in lattice:
        best: dict[tuple[int, str], int] = {}
        stay = []
        for edge in edges:
            to, c, lost, _ = edge
            width = _width(table.get(c, 0)) if c >= "\x80" else 0
            complete = False
            if width:
                paths = [(to, bytes([table[c]]), lost, 0)]
                for left in range(width - 1, 0, -1):
                    longer = []
                    for at, seen, n, here in paths:
                        follows = False
                        for j, d, m, _ in lattice[at] if at < len(lattice) else ():
                            if d == _MARK:
                                follows = True
                                if here < MOST_LOST:
                                    longer += [(j, seen + bytes([b]), n + m + 1, here + 1) for b in _blank(encoding)]
                            elif d >= "\x80" and 0x80 <= table.get(d, 0) <= 0xBF:
                                follows = True
                                longer.append((j, seen + bytes([table[d]]), n + m, here))
                        if left == 1 and not follows and not here:
                            longer += [(at, seen + bytes([b]), n + 1, 1) for b in OFTEN_LOST]
                    paths = longer
                for at, seen, n, here in paths:
                    try:
                        k = at, seen.decode()
                    except UnicodeDecodeError:
                        continue
                    complete |= not here
                    best[k] = min(n, best.get(k, n))
            if not complete:
                stay.append((to, c, lost, False))
        any_new |= bool(best)
        out.append(stay + [(to, c, n, True) for (to, c), n in best.items()])
    return out if any_new else None


def lost_characters(text: str) -> Lattice:
    """The lattice of a text with replacement marks: each mark is one character beyond ASCII, or a byte of one in UTF-8."""
    out = plain(text)
    for i, c in enumerate(text):
        if c == _MARK:
            out[i] = [(i + w, _ANY, w, True) for w in (1, 2, 3, 4) if text.startswith(_MARK * w, i)]
    return out


def likeliest(lattice: Lattice, likely: Callable[[str], float]) -> tuple[float, str, int] | None:
    """Viterbi: the path through at least one edge of the last channel whose characters are likeliest, lost bytes counting against it: (score, reading, bytes lost)."""
    n = len(lattice)
    states: list[list[tuple[float, int, str, int, int, bool] | None]] = [[None, None] for _ in range(n + 1)]
    states[0][0] = (0.0, 0, "", -1, 0, False)
    for i in range(n):
        for flag in (0, 1):
            state = states[i][flag]
            if state is None:
                continue
            for to, c, lost, new in lattice[i]:
                score = state[0] - LOST * lost + (likely(c) if c >= "\x80" else 0.0)
                own = states[to][f := int(flag or new)]
                if own is None or score > own[0]:
                    states[to][f] = (score, state[1] + lost, c, i, flag, True)
    end = states[n][1]
    if end is None:
        return None
    letters, at, flag = [], n, 1
    while at or flag:
        _, _, c, i, f, _ = states[at][flag]
        letters.append(c)
        at, flag = i, f
    return end[0], "".join(reversed(letters)), end[1]


def fits(lattice: Lattice, word: str) -> int | None:
    """Fewest lost bytes with which a path of ``lattice`` that has an edge of the last channel reads ``word``; None if none does."""
    now = {(0, False): 0}
    for c in word:
        new: dict[tuple[int, bool], int] = {}
        for (i, flag), n in now.items():
            for to, d, lost, changed in lattice[i] if i < len(lattice) else ():
                if d == c or d == _ANY and c >= "\x80" and c != _MARK and (to - i == 1 or len(c.encode()) == to - i):
                    k = to, flag or changed
                    new[k] = min(n + lost, new.get(k, n + lost))
        if not new:
            return None
        now = new
    return now.get((len(lattice), True))


def ends(lattice: Lattice) -> tuple[list[str], int, int, bool]:
    """Keys of the ends that a path may have, fewest and most characters of a path, and whether any byte is in doubt.

    An end is as many characters, up to _ENDS, as have at most MOST_ENDS readings; every path has one of the first ends and one of the last. There are no
    keys if both ends may be any character.
    """
    n = len(lattice)
    least, most, into = {0: 0}, {0: 0}, defaultdict(list)
    doubt = False
    for i in range(n):
        if i in least:
            doubt |= len(lattice[i]) > 1 or any(e[2] for e in lattice[i])
            for to, c, _, _ in lattice[i]:
                least[to], most[to] = min(least[i] + 1, least.get(to, n + 1)), max(most[i] + 1, most.get(to, 0))
                into[to].append((i, c))

    def walk(start: int, edges: Callable[[int], Iterable[tuple[int, str]]], stop: int, join: Callable[[str, str], str]) -> list[str]:
        now = {("", start)}
        for _ in range(_ENDS):
            if any(at == stop for _, at in now) or any(c == _ANY for _, at in now for _, c in edges(at)):
                break
            longer = {(join(s, c), to) for s, at in now for to, c in edges(at)}
            if len({s for s, _ in longer}) > MOST_ENDS:
                break
            now = longer
        return sorted({s for s, _ in now})

    first = walk(0, lambda at: [(to, c) for to, c, _, _ in lattice[at]], n, lambda s, c: s + c)
    last = walk(n, lambda at: into[at], 0, lambda s, c: c + s)
    b = max(0, min(len(last[0]), least[n] - len(first[0])))
    last = sorted({s[len(s) - b :] for s in last})
    return [f"{len(x)}{x}\n{y}" for x in first for y in last if x or y], least[n], most[n], doubt


@lru_cache(maxsize=None)
def _single_table(written: str, read: str) -> dict[int, str]:
    """Characters beyond ASCII as the other encoding has their byte; those it can't have become a mark."""
    out = {}
    for c, b in _bytes_of(read).items():
        if c >= "\x80":
            try:
                out[ord(c)] = bytes([b]).decode(written) if b >= 0x80 else _MARK
            except UnicodeDecodeError:
                out[ord(c)] = _MARK
    return out


def _base(token: str) -> str:
    return html.unescape(token) if "&" in token else token


def lattices(token: str) -> Iterator[tuple[str, Lattice]]:
    """Each channel of UTF-8 read in another encoding that may have made the token, with its lattice."""
    base = _base(token)
    if base.isascii():
        return
    for encoding in READ_AS:
        if not _may_be(encoding).search(base):
            continue
        lattice = plain(base)
        for depth in range(1, DEPTHS + 1):
            lattice = decoded(lattice, encoding)
            if lattice is None:
                break
            yield f"utf_8>{encoding}" + f"*{depth}" * (depth > 1), lattice


@lru_cache(maxsize=512)
def _lattice_of(token: str, channel: str) -> Lattice:
    if channel == "lost":
        return lost_characters(token)
    encoding, _, depth = channel.removeprefix("utf_8>").partition("*")
    lattice = plain(_base(token))
    for _ in range(int(depth or 1)):
        lattice = decoded(lattice, encoding)
    return lattice


def one_byte(token: str) -> Iterator[tuple[str, str]]:
    """(channel, reading) for encodings of one byte a character taken for each other."""
    base = _base(token)
    high = [c for c in base if c >= "\x80"]
    for written, read in SINGLE:
        table = _single_table(written, read)
        if all(ord(c) in table for c in high):
            r = base.translate(table)
            if r != base and r.isalpha():
                yield f"{written}>{read}", r


def tells(token: str) -> bool:
    """Whether a token is more than an odd character or two."""
    base = _base(token)
    letters = sum(c >= "\x80" and not c.isspace() for c in base)
    return letters >= 3 or bool(letters) and len(base) > letters + 1


def likelihood(counts: dict[str, int]) -> Callable[[str], float]:
    """Log-probability of characters beyond ASCII from their counts. Unseen ones take, as Witten and Bell have it, the share of all kinds met, spread over blocks of 128 as often as these occur."""
    total, kinds = sum(counts.values()), len(counts) + 1
    blocks: dict[int, int] = defaultdict(int)
    for c, n in counts.items():
        blocks[ord(c) >> 7] += n
    every = (0x110000 >> 7) * 128
    known: dict[str, float] = {}

    def one(c: str) -> float:
        v = known.get(c)
        if v is None:
            spread = (blocks.get(ord(c) >> 7, 0) / 128 + kinds / every) / (total + kinds)
            v = known[c] = math.log((counts.get(c, 0) + kinds * spread) / (total + kinds))
        return v

    return one


def best_path(spots: list[list[tuple[str, float]]]) -> tuple[float, list[int]]:
    """Viterbi over a text's doubtful tokens, each with (channel, gain) choices: the greatest total gain over sound text, and the choice at each token (-1: sound)."""
    states: dict[str, tuple[float, tuple | None]] = {"": (0.0, None)}
    for options in spots:
        top = max(states.items(), key=lambda x: x[1][0])
        new: dict[str, tuple[float, tuple | None]] = {}
        for channel, (score, trail) in states.items():
            new[channel] = max(new.get(channel, (-math.inf, None)), (score, (-1, trail)), key=lambda x: x[0])
        for k, (channel, gain) in enumerate(options):
            stay = states.get(channel)
            come = top[1][0] - SWITCH
            score, trail = stay if stay and stay[0] >= come else (come, top[1][1])
            if score + gain > new.get(channel, (-math.inf, None))[0]:
                new[channel] = (score + gain, (k, trail))
        states = new
    score, trail = max(states.values(), key=lambda x: x[0])
    picks = []
    while trail:
        picks.append(trail[0])
        trail = trail[1]
    return score, picks[::-1]


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def _odd_texts(docs: DataFrame, text: str) -> DataFrame:
    """Texts that can have tokens at all; those of ASCII alone aren't searched."""
    return docs.where((F.octet_length(text) > F.length(text)) | F.contains(F.col(text), F.lit("&")))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_PROPOSED = pa.schema([("token", pa.string()), ("n", pa.int64()), ("channel", pa.string()), ("reading", pa.string()), ("chars", pa.float64()), ("own", pa.float64()), ("lost", pa.int32()), ("key", pa.string()), ("lo", pa.int32()), ("hi", pa.int32())])
_FITTED = pa.schema([("token", pa.string()), ("n", pa.int64()), ("channel", pa.string()), ("reading", pa.string()), ("chars", pa.float64()), ("own", pa.float64()), ("lost", pa.int32()), ("n_reading", pa.int64())])


def _end_keys(word: Column) -> Column:
    """All keys of a word's ends, of up to _ENDS characters each; the two may not overlap."""
    sizes = [(a, b) for a in range(_ENDS + 1) for b in range(_ENDS + 1) if a + b]
    keys = [F.when(F.length(word) >= a + b, F.concat(F.lit(f"{a}"), F.left(word, F.lit(a)), F.lit("\n"), F.right(word, F.lit(b)))) for a, b in sizes]
    return F.array_compact(F.array(*keys))


def suspects(counts: DataFrame, total: int) -> DataFrame:
    """Of ``counts`` (token, n; ``total`` occurrences) the tokens that are likelier the result of a wrong decoding: ``token`` and ``choices`` (gain > 0, channel, reading), at most one a channel."""
    spark = counts.sparkSession
    # at most one entry for each code point there is, whatever the corpus
    chars = dict(counts.select(F.explode(F.split("token", "")).alias("c"), "n").where(F.col("c") > "\x7f").groupBy("c").agg(F.sum("n")).collect())
    sent = spark.sparkContext.broadcast(chars)

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        likely = likelihood(sent.value)
        for b in batches:
            rows: list[tuple] = []
            for token, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = sum(likely(c) for c in _base(token) if c >= "\x80")
                for channel, lattice in lattices(token):
                    found = likeliest(lattice, likely)
                    if found is None or found[0] - own + WORD_HIGH <= 0:  # no word can make up for it: it has no likelier characters
                        continue
                    rows.append((token, n, channel, found[1], found[0] - own, own, found[2], None, 0, 0))
                    keys, lo, hi, doubt = ends(lattice)
                    rows += [(token, n, channel, None, None, own, 0, k, lo, hi) for k in keys if doubt]
                beside = math.inf if tells(token) else BESIDE
                rows += [(token, n, channel, r, beside, own, 0, None, 0, 0) for channel, r in one_byte(token)]
                if _MARK in token:
                    keys, lo, hi, _ = ends(lost_characters(token))
                    rows += [(token, n, "lost", None, None, own, 0, k, lo, hi) for k in keys]
            yield _batch(rows, _PROPOSED)

    proposed = cut(counts.repartition(tasks(spark, counts.count(), TASK_TOKENS)).mapInArrow(propose, "token string, n bigint, channel string, reading string, chars double, own double, lost int, key string, lo int, hi int"))
    seen = counts.select(F.col("token").alias("reading"), F.col("n").alias("n_reading"))
    weighed = proposed.where("reading is not null").join(seen, "reading", "left").select("token", "n", "channel", "reading", "chars", "own", "lost", F.coalesce("n_reading", F.lit(0)).alias("n_reading"))

    # words of the corpus that a lattice with lost bytes also reads: looked up by the ends that all its paths share
    asked = proposed.where("key is not null").select("token", "n", "channel", "own", "key", "lo", "hi")
    used = asked.select("key").distinct()
    words = counts.where(~F.col("token").contains(_MARK)).select(F.col("token").alias("reading"), F.col("n").alias("n_reading"), F.explode(_end_keys(F.col("token"))).alias("key")).join(used, "key", "left_semi")
    near = asked.join(words, "key").where((F.length("reading") >= F.col("lo")) & (F.length("reading") <= F.col("hi"))).select("token", "n", "channel", "own", "reading", "n_reading")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        likely = likelihood(sent.value)
        for b in batches:
            rows = []
            for token, n, channel, own, word, times in zip(*(c.to_pylist() for c in b.columns)):
                lost = fits(_lattice_of(token, channel), word)
                if lost is not None and word != token:
                    score = sum(likely(c) for c in word if c >= "\x80") - LOST * lost - own
                    rows.append((token, n, channel, word, score, own, lost, times))
            yield _batch(rows, _FITTED)

    fitted = cut(near.mapInArrow(fit, "token string, n bigint, channel string, reading string, chars double, own double, lost int, n_reading bigint"))
    weighed = weighed.unionByName(fitted.where("channel != 'lost'"))
    telling = F.log((F.col("n_reading") + 1.0) / (F.col("n") + 1.0))
    wide = F.col("channel").startswith("utf_8>")
    gain = F.when(wide, F.col("chars") + F.greatest(F.lit(WORD_LOW), F.least(F.lit(WORD_HIGH), telling))).otherwise(F.when(F.col("n_reading") >= 2, F.least(telling, F.col("chars"))))
    # of a channel's readings: a word of two documents or more by its frequency, another by its characters, in both cases less what its lost bytes cost
    spelled = F.col("chars") + F.col("own") - LETTER * (F.length("reading") - F.length(F.regexp_replace("reading", r"[\x00-\x7f]", "")))
    score = F.when(F.col("n_reading") >= 2, F.log(F.col("n_reading") / F.lit(float(total))) - LOST * F.col("lost")).otherwise(spelled)
    byte = weighed.select("token", "channel", "reading", gain.alias("gain"), score.alias("score")).where(F.col("gain") > 0)
    byte = cut(byte.groupBy("token", "channel").agg(F.max("gain").alias("gain"), F.max(F.struct("score", "reading")).alias("m")).select("token", "channel", "m.reading", "gain"))

    # marks: the commonest sound word that fits, if it is by far the commonest
    sound = fitted.where("channel = 'lost'").join(byte.select(F.col("token").alias("reading")).distinct(), "reading", "left_anti")
    sound = sound.groupBy("token").agg(F.max(F.struct("n_reading", "reading")).alias("m"), F.sum("n_reading").alias("all")).where(F.col("m.n_reading") >= F.col("all") * SURE)
    marked = counts.where(F.col("token").contains(_MARK)).select("token")
    lost = marked.join(sound, "token", "left").select("token", F.lit("lost").alias("channel"), F.col("m.reading").alias("reading"), F.lit(REPLACED).alias("gain"))
    return byte.unionByName(lost).groupBy("token").agg(F.sort_array(F.collect_list(F.struct("gain", "channel", "reading")), asc=False).alias("choices"))


def garbled(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Texts that, wholly or in part, show the result of decoding with the wrong encoding: ``key``, ``gain``, and ``spans`` (token number, reading or null where it can't be restored).

    The corpus is the language model. Its tokens with characters beyond ASCII (or character references) are counted once over all documents; each distinct
    token is read through every channel: UTF-8 in eleven encodings, up to three times over, as a lattice with lost bytes as wildcards, and one-byte
    encodings taken for each other. A reading gains by the likelihood of its characters and by how many more documents have it as
    a word than have the token. Of a lattice count the reading of likeliest characters (Viterbi, exact) and all words of the corpus that it reads, looked up by the ends that its paths may have, so
    no reading that could be better is left out, but for words of lattices both of whose ends may be anything. One-byte channels need the reading to be known in two documents. A replacement mark tells by itself; its
    reading is the word that fits, each mark being a character or a byte of one, if it has SURE of the occurrences of all that fit, and else null. Over each text's doubtful tokens a Viterbi search takes the
    best series of channels, where changing channel costs; a text is a case if the best series gains more than GAIN over reading it as it is.

    Null and empty texts are no cases. Rows of equal key are one text here, so ``key`` should be unique; null keys are left out. Runs of any length are read whole, in linear time. What is shuffled are
    distinct tokens and the places of odd ones, the commonest tokens' in SALTS parts; the only thing gathered is one number a code point and the fewer than HOT_PARTS commonest tokens.
    """
    some = _odd_texts(docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")), "__text")
    counts = cut(some.select(F.explode(F.array_distinct(_tokens(F.col("__text")))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 1
    doubtful = cut(suspects(counts, total))
    hot = [r[0] for r in doubtful.join(counts, "token").where(F.col("n") * HOT_PARTS > total).select("token").collect()]
    is_hot = F.col("token").isin(hot) if hot else F.lit(False)
    each = some.where(F.col("__key").isNotNull()).select("__key", F.posexplode(_tokens(F.col("__text"))).alias("pos", "token"))
    each = each.withColumn("salt", F.when(is_hot, F.pmod(F.xxhash64("__key", "pos"), F.lit(SALTS)).cast("int")).otherwise(0))
    dealt = doubtful.withColumn("salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    spots = each.join(dealt, ["token", "salt"]).groupBy("__key").agg(F.sort_array(F.collect_list(F.struct("pos", "choices"))).alias("spots"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, gains, spans = [], [], []
            for row, found in enumerate(b.column(1).to_pylist()):
                gain, picks = best_path([[(c["channel"], c["gain"]) for c in s["choices"]] for s in found])
                if gain > GAIN:
                    keep.append(row)
                    gains.append(gain)
                    spans.append([{"pos": s["pos"], "reading": s["choices"][k]["reading"]} for s, k in zip(found, picks) if k >= 0])
            kind = pa.list_(pa.struct([("pos", pa.int32()), ("reading", pa.string())]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array(gains, pa.float64()), pa.array(spans, kind)], [key, "gain", "spans"])

    kind = docs.schema[key].dataType.simpleString()
    return spots.mapInArrow(decide, f"`{key}` {kind}, gain double, spans array<struct<pos:int,reading:string>>")


def restored(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``garbled``'s texts as restored: ``key``, ``text``, ``n_spans``, and ``whole``: whether every damaged token could be restored."""
    found = cut(garbled(docs, key, text).select(F.col(key).alias("__key"), "spans"))
    both = likely_in(docs.select(F.col(key).alias("__key"), F.col(text).alias("text")), found, "__key").join(found, "__key")
    pattern = re.compile(PYTHON_TOKEN)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, n, whole = [], [], []
            for t, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                new = {s["pos"]: s["reading"] for s in spans}
                parts, last = [], 0
                for at, m in enumerate(pattern.finditer(t)):
                    if new.get(at):
                        parts += [t[last : m.start()], new[at]]
                        last = m.end()
                texts.append("".join([*parts, t[last:]]))
                n.append(len(new))
                whole.append(all(new.values()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(n, pa.int32()), pa.array(whole, pa.bool_())], [key, "text", "n_spans", "whole"])

    kind = docs.schema[key].dataType.simpleString()
    return both.select("__key", "text", "spans").mapInArrow(put, f"`{key}` {kind}, text string, n_spans int, whole boolean")
