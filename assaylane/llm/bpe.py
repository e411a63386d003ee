"""Byte-level BPE: encoding by ranked merges over distinct words, decoding by joining pieces."""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text, or ids, about, that are handled at once.
SLICE_BYTES = 1 << 20
#: Distinct words whose tokens a Python worker keeps (some 200 bytes each); the rest are merged anew.
KEPT_WORDS = 250_000


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: on each line a piece in base64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in lines if line.strip())}


def merge_table(ranks: dict[bytes, int]) -> dict[int, int]:
    """What two neighbouring tokens merge into, for every way to cut a piece into two pieces: ``left << 32 | right`` to token."""
    table = {}
    for piece, rank in ranks.items():
        for i in range(1, len(piece)):
            left, right = ranks.get(piece[:i]), ranks.get(piece[i:])
            if left is not None and right is not None:
                table[left << 32 | right] = rank
    return table


#: Above every rank: two tokens that don't merge.
NONE = 1 << 40
#: A word of more bytes than this is merged with a heap: the list takes quadratic time.
LONG_WORD = 500


def merge_word(ids: list[int], merged: dict[int, int]) -> list[int]:
    """The tokens of a word from those of its bytes: again and again the leftmost pair of least rank becomes one token.

    The pairs' ranks are kept beside the tokens, so that a merge looks up only its two new pairs.
    """
    get = merged.get
    pairs = [get(a << 32 | b, NONE) for a, b in zip(ids, ids[1:], strict=False)]
    while pairs:
        least = min(pairs)
        if least == NONE:
            break
        i = pairs.index(least)
        ids[i] = least
        del ids[i + 1], pairs[i]
        if i < len(pairs):
            pairs[i] = get(least << 32 | ids[i + 1], NONE)
        if i:
            pairs[i - 1] = get(ids[i - 1] << 32 | least, NONE)
    return ids


def merge_long(ids: list[int], merged: dict[int, int]) -> list[int]:
    """As :func:`merge_word`, in n log n: a heap of pairs over a linked list of tokens."""
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(rank, i, ids[i], ids[i + 1]) for i in range(n - 1) if (rank := merged.get(ids[i] << 32 | ids[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i, left, right = heapq.heappop(heap)
        j = after[i]
        if ids[i] != left or j >= n or ids[j] != right:
            continue
        ids[i], ids[j] = rank, -1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n and (r := merged.get(ids[a] << 32 | ids[b])) is not None:
                heapq.heappush(heap, (r, a, ids[a], ids[b]))
    return [x for x in ids if x >= 0]


class Encoder:
    """Splits texts by a pattern and merges each distinct word of them once, within the memory of KEPT_WORDS words.

    Token ids are held as bytes of little-endian 32-bit integers, so a text's ids are its words' bytes joined.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.merged = merge_table(ranks)
        self.single = [ranks[bytes([i])] for i in range(256)]
        self.known: dict[str, bytes] = {}
        pieces = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            pieces[rank] = piece
        self.bytes = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        self.length = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        self.start = self.length.cumsum() - self.length

    def word(self, word: str) -> bytes:
        """The ids of one word; it is kept if there is room."""
        encoded = word.encode("utf-8", "replace")
        whole = self.ranks.get(encoded)
        if whole is not None:
            ids = [whole]
        else:
            ids = (merge_word if len(encoded) <= LONG_WORD else merge_long)([self.single[b] for b in encoded], self.merged)
        found = array("I", ids).tobytes()
        if len(self.known) < KEPT_WORDS:
            self.known[word] = found
        return found

    def encode(self, text: str) -> bytes:
        known, word = self.known.get, self.word
        return b"".join([known(w) or word(w) for w in self.find(text)])

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that the ids stand for; an id that the ranks lack is an error."""
        length = self.length[ids]
        if not length.all():
            raise ValueError("an id without a piece")
        ends = length.cumsum()
        return self.bytes[np.repeat(self.start[ids] - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)]


@lru_cache(maxsize=2)
def _encoder(name: str, pattern: str) -> Encoder:
    """One for each Python worker, from the file that Spark has brought to its machine."""
    return Encoder(read_ranks(SparkFiles.get(name)), pattern)


def _ship(spark: SparkSession, ranks_path: str) -> str:
    """Spark copies the rank file to every executor, also to those that come later; a text file of a fixed vocabulary."""
    spark.sparkContext.addFile(ranks_path)
    return ranks_path.rstrip("/").rsplit("/", 1)[-1]


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in pieces of about SLICE_BYTES of a column, but for a longer single row: bounds a task's memory."""
    held = batch.column(column)
    sizes = pc.fill_null(pc.binary_length(held) if pa.types.is_string(held.type) else pc.list_value_length(held), 0).to_numpy(zero_copy_only=False)
    at = np.cumsum(sizes, dtype=np.int64) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), batch.num_rows]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with its whole texts' token ids as an array of integers; special tokens' names are ordinary text.

    Null or empty text: no ids. Each row stands alone, so repeated rows get equal ids, an
    empty table gives none, and nothing is shuffled. Other columns pass through, but for one named
    like ``ids``, which is replaced.
    """
    name = _ship(docs.sparkSession, ranks_path)
    kept = [c for c in docs.columns if c != ids]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(name, pattern)
        for batch in batches:
            for part in slices(batch, kept.index(text)):
                found = [encoder.encode(t or "") for t in part.column(kept.index(text)).to_pylist()]
                offsets = np.cumsum([0, *(len(x) // 4 for x in found)], dtype=np.int32)
                values = np.frombuffer(b"".join(found), dtype="<i4")
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(offsets, values)], [*kept, ids])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, ranks_path: str, pattern: str, *, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes that its ids stand for: the pieces of the rank file one after another.

    Null ids: no bytes. An id that the file lacks is an error.
    """
    name = _ship(encoded.sparkSession, ranks_path)
    kept = [c for c in encoded.columns if c != decoded]
    rows = encoded.select(*[F.col(f"`{c}`") for c in kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(name, pattern)
        for batch in batches:
            for part in slices(batch, kept.index(ids)):
                column = part.column(kept.index(ids))
                found = [encoder.decode(np.asarray(x.values, dtype=np.int64) if x.is_valid else np.zeros(0, np.int64)).tobytes() for x in column]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.binary())], [*kept, decoded])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(decoded, T.BinaryType())]))
