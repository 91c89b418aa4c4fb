"""Encoding a corpus with a public tokenizer, and decoding it."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache, partial
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kithgraph.session import cut

#: Where the vocabulary files are.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Characters of text in a pack of documents that share a list of distinct pre-tokens.
PACK_CHARACTERS = 4_000_000

#: White space as the tokenizer's pattern means it, and that pattern: contractions, letters, digits, other marks, spaces. (For Java
#: letters and digits come first, which never start where a contraction does, and what can't give anything back doesn't try to.)
_S = r"\x09-\x0d\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
PRE_TOKEN = rf" ?\p{{L}}++| ?\p{{N}}++|'(?:s|t|re|ve|m|ll|d)| ?[^{_S}\p{{L}}\p{{N}}]++|[{_S}]+(?![^{_S}])|[{_S}]+"
_PYTHON_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ids."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, Path(path).read_bytes().splitlines())}


@lru_cache(maxsize=2)
def _encoder(path: str):
    import tiktoken

    return tiktoken.Encoding("words", pat_str=_PYTHON_PATTERN, mergeable_ranks=ranks(path), special_tokens={})


def pre_tokens(text: Column) -> Column:
    """Array of the pieces that are encoded by themselves; together they are the text. A text with code points that this Java doesn't know is one piece, which the encoder splits."""
    unknown = (F.octet_length(text) > F.length(text)) & text.rlike(r"\p{Cn}")
    return F.when(unknown, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(PRE_TOKEN), F.lit(0)))


def encode(docs: DataFrame, key: str, text: str, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``key`` and ``ids`` (array of int) of every row, without special tokens; strings that look like them are ordinary text.

    Null and empty texts give the empty array. Repeated rows are each encoded; other columns are dropped.

    Each distinct pre-token of the corpus is encoded once. Texts are split once, where they are read, into packs of documents: a pack is the list of its
    distinct pre-tokens and each document's pre-tokens in their order as compressed numbers in that list. Packs are cut; what is shuffled is (pack, distinct pre-token)
    to the encoder and its ids back, and the packs' numbers, which are smaller than the texts. There each document's numbers are
    replaced by ids. A pre-token in every document is one row a pack. Nothing is broadcast.
    """
    path = str(Path(tokenizers) / vocabulary)
    kind = docs.schema[key].dataType.simpleString()
    pieces = docs.select(F.col(key).alias("__key"), F.coalesce(pre_tokens(F.col(text)), F.array().cast("array<string>")).alias("pieces"))
    packs = cut(pieces.mapInArrow(partial(_packed, characters=PACK_CHARACTERS), f"keys array<{kind}>, sizes array<int>, codes binary, pieces array<string>")).withColumn("pack", F.monotonically_increasing_id())
    asked = packs.select("pack", F.posexplode("pieces").alias("i", "piece"))

    def ids_of(batches):
        encoder = _encoder(path)
        for batch in batches:
            ids = encoder.encode_ordinary_batch(batch.column(0).to_pylist(), num_threads=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["piece", "ids"])

    encoded = asked.select("piece").distinct().mapInArrow(ids_of, "piece string, ids array<int>")
    answers = asked.join(encoded, "piece").select(F.col("pack").alias("__pack"), "i", "ids")

    def put_together(own: pa.Table, known: pa.Table) -> pa.Table:
        keys, sizes = own["keys"].combine_chunks().flatten(), own["sizes"].combine_chunks().flatten().to_numpy()
        known = known.sort_by("i")
        codes = np.frombuffer(pa.decompress(own["codes"][0].as_py(), decompressed_size=4 * int(sizes.sum()), codec="zstd"), np.int32) if sizes.sum() else np.zeros(0, np.int32)
        found = known["ids"].combine_chunks().take(pa.array(codes)) if known.num_rows else pa.array([], pa.list_(pa.int32()))
        ends = found.offsets.to_numpy() - found.offsets[0].as_py()
        starts = np.concatenate([[0], np.cumsum(sizes)])
        return pa.table({key: keys, "ids": pa.ListArray.from_arrays(pa.array(ends[starts], pa.int32()), found.flatten())})

    numbers = packs.select("pack", "keys", "sizes", "codes")
    return numbers.groupBy("pack").cogroup(answers.groupBy("__pack")).applyInArrow(put_together, f"`{key}` {kind}, ids array<int>")


def _packed(batches: Iterator[pa.RecordBatch], characters: int) -> Iterator[pa.RecordBatch]:
    """Documents as arrays of pieces to packs: keys, number of pieces of each, their numbers in order (compressed) and the distinct pieces."""
    for batch in batches:
        lists = batch.column(1)
        ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        flat = lists.flatten()
        size = np.concatenate([[0], np.cumsum(pc.utf8_length(flat).to_numpy(), dtype=np.int64)])[ends]
        first = 0
        while first < len(lists):
            last = max(first + 1, int(np.searchsorted(size, size[first] + characters, "right")) - 1)
            coded = flat.slice(ends[first], ends[last] - ends[first]).dictionary_encode()
            codes = pa.compress(coded.indices.to_numpy().astype(np.int32).tobytes(), codec="zstd", asbytes=True)
            sizes = np.diff(ends[first : last + 1]).astype(np.int32)
            row = [batch.column(0).slice(first, last - first), pa.array(sizes), coded.dictionary]
            keys, sizes, words = (pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in row)
            yield pa.RecordBatch.from_arrays([keys, sizes, pa.array([codes], pa.binary()), words], ["keys", "sizes", "codes", "pieces"])
            first = last


@lru_cache(maxsize=2)
def _token_bytes(path: str) -> pa.Array:
    """Bytes of each token by its id; the last entry is empty and stands for ids that aren't in the vocabulary."""
    table = ranks(path)
    rows = [b""] * (max(table.values(), default=-1) + 2)
    for token, rank in table.items():
        rows[rank] = token
    return pa.array(rows, pa.large_binary())


def texts_of(ids: pa.Array, table: pa.Array) -> pa.Array:
    """The text of each list of ids; null for null. Bytes are put together before they are read as UTF-8, since a character may be spread over tokens; what is no UTF-8 becomes replacement marks."""
    sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy()
    flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    last = len(table) - 1
    taken = table.take(pa.array(np.where((flat >= 0) & (flat < last), flat, last)))
    ends = taken.cast(pa.large_binary()).buffers()[1]
    ends = np.frombuffer(ends, np.int64)[taken.offset : taken.offset + len(taken) + 1]
    whole = np.ascontiguousarray(ends[np.concatenate([[0], np.cumsum(sizes)])])
    texts = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(whole), taken.buffers()[2]])
    try:
        texts = texts.cast(pa.large_string()).cast(pa.string())
    except pa.ArrowInvalid:
        texts = pa.array([t.decode("utf-8", "replace") for t in texts.to_pylist()], pa.string())
    return pc.if_else(ids.is_null(), pa.scalar(None, pa.string()), texts)


def decode(encoded: DataFrame, ids: str, out: str = "text", tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``encoded`` with ``out``: the text of each list of ids. An empty list gives '', null gives null; ids that aren't in the vocabulary (null ones too) give nothing.

    The table of token bytes has a fixed number of rows; each worker has it and joins a batch's ids to it at once. No shuffle.
    """
    path = str(Path(tokenizers) / vocabulary)
    rest = [c for c in encoded.columns if c != out or c == ids]
    schema = T.StructType([encoded.schema[c] for c in rest if c != out] + [T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = texts_of(b.column(ids), _token_bytes(path))
            names = [c for c in b.schema.names if c != out]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), texts], [*names, out])

    return encoded.select(*rest).mapInArrow(run, schema)
