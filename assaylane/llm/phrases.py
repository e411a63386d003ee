"""Phrase collocations: frequent phrases counted by slots of a minimal perfect hash, scored by their weakest cut.

Texts become arrays of numbers of frequent words. Phrases then grow by a word at a time. A phrase of k words can only be frequent if
the phrases of its first and of its last k - 1 words are, so only places where both are count (Apriori). Its key is
(number of the first k - 1 words, number of the last word), 64 bits that stand for one phrase. For each length

1. every task counts hashed keys in two arrays of buckets, and the arrays are summed in a tree. A key with a bucket below the
   threshold in either can't be frequent;
2. the other keys that occur are the candidates, and get a minimal perfect hash that stores them;
3. every task looks its keys up, compares the stored key, and counts slots in an array; arrays are summed in a tree;
4. what reaches the threshold gets a hash of its own, whose slots number the phrases in the arrays of the next length.

A hash has a bounded number of keys. More candidates make more hashes, one pass over the arrays for each.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut, discard
from .grams import mix64
from .perfect import PerfectHash

#: Keys of one perfect hash, some 18 bytes each where it is held.
PART_KEYS = 1 << 21
#: Bytes of one dictionary of words as Python holds it.
PART_BYTES = 32 << 20
#: Words that a task holds before it hands their counts on.
HELD = 100_000
#: Candidate keys, eight bytes each, that a task holds before it hands them on.
KEYS_HELD = 1 << 20
#: Places of the arrays that a task handles together, but for a longer single text.
TOGETHER = 1 << 19
#: Counts in one row of an array that is summed.
SLICE = 1 << 16

#: Fixed by the contract: bytes that end a piece, marked by a byte that UTF-8 never has.
_END = b"\xff"
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + _END * 10)


def tokens_of(text: bytes | None) -> list[bytes]:
    """The words of a UTF-8 text, A-Z made small, with a mark between pieces."""
    return [] if text is None else text.translate(_FOLD).replace(_END, b" " + _END + b" ").split()


def _texts(docs: DataFrame) -> DataFrame:
    return docs.where("text is not null").select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.encode("text", "UTF-8").alias("text"))


def _tasks(df: DataFrame) -> DataFrame:
    """Few tasks for each core: each holds one array of counts, so their number decides what is sent."""
    return df.coalesce(2 * df.sparkSession.sparkContext.defaultParallelism)


def count_words(docs: DataFrame, min_count: int) -> DataFrame:
    """lang, word and f of the words with at least ``min_count`` occurrences, and a row without a word with all occurrences of each lang."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, found in held.items():
                found.pop(_END, None)
                words = [*found, None]
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(words), "word": pa.array(words, pa.binary()).cast(pa.string()), "f": [*found.values(), found.total()]}, schema=pa.schema([("lang", pa.string()), ("word", pa.string()), ("f", pa.int64())]))
            held.clear()

        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = held[lang]
                size -= len(found)
                found.update(tokens_of(text.as_py()))
                size += len(found)
                if size > HELD:
                    yield from rows()
                    size = 0
        yield from rows()

    counted = _tasks(_texts(docs)).mapInArrow(count, "lang string, word string, f bigint").groupBy("lang", "word").agg(F.sum("f").alias("f"))
    return cut(counted.where(F.col("word").isNull() | (F.col("f") >= min_count)))


def number_words(words: DataFrame) -> tuple[DataFrame, int]:
    """``words`` (lang, word, f) with id (from 0) and part, and the number of parts: dictionaries of bounded size."""
    n, size = words.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("word") + 150), F.lit(0))).first()
    parts = -(-size // PART_BYTES) or 1

    def number(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.sort_values(["lang", "word"]).assign(slot=np.arange(len(rows), dtype=np.int64))

    placed = cut(words.withColumn("part", F.pmod(F.xxhash64("lang", "word"), F.lit(parts)).cast("int")).groupBy("part").applyInPandas(number, "lang string, word string, f bigint, part int, slot bigint"))
    return _offset(placed, n), parts


def _offset(placed: DataFrame, n: int) -> DataFrame:
    """Slots of parts made numbers of the whole."""
    if n >= 1 << 31:
        raise ValueError("more than 2^31 frequent phrases of one length")
    sizes = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, at = F.lit(0), 0
    for part in sorted(sizes):
        starts = F.when(F.col("part") == part, F.lit(at)).otherwise(starts)
        at += sizes[part]
    return placed.withColumn("id", F.col("slot") + starts)


def encode_words(docs: DataFrame, numbered: DataFrame, parts: int) -> DataFrame:
    """``s``: for every text the numbers of its words as 32-bit integers, runs of other words and ends of pieces as one -1; ``last`` is NULL."""
    state = _texts(docs).withColumn("s", F.lit(None).cast("binary"))
    for part in range(parts):
        known: dict[str, dict[bytes, int]] = defaultdict(dict)
        for r in numbered.where(F.col("part") == part).select("lang", "word", "id").toLocalIterator():
            known[r["lang"]][r["word"].encode()] = r["id"]
        shared, done = docs.sparkSession.sparkContext.broadcast(dict(known)), part == parts - 1

        def encode(batches: Iterable[pa.RecordBatch], shared=shared, done=done) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for lang, text, s in zip(*(batch.column(i) for i in range(3)), strict=True):
                    ids = shared.value.get(lang.as_py(), {})
                    got = np.array([ids.get(t, -1) for t in tokens_of(text.as_py())], np.int32)
                    if s.as_py() is not None:
                        before = np.frombuffer(s.as_py(), np.int32)
                        got = np.where(before >= 0, before, got)
                    out.append((_short(got) if done else got).tobytes())
                kept = pa.array(out, pa.binary())
                yield pa.RecordBatch.from_arrays([kept, pa.nulls(len(kept), pa.binary())] if done else [batch.column(0), batch.column(1), kept], names=["s", "last"] if done else ["lang", "text", "s"])

        state = cut(state.mapInArrow(encode, "s binary, last binary" if done else "lang string, text binary, s binary"))
    return state


def _short(s: np.ndarray) -> np.ndarray:
    return s[_kept(s)]


def _kept(s: np.ndarray) -> np.ndarray:
    """All places of phrases, and the first of each run of others."""
    return (s >= 0) | (np.concatenate([[0], s[:-1]]) >= 0)


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices of about ``TOGETHER`` places."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(0)).to_numpy(zero_copy_only=False).astype(np.int64) // 4 + 1
        starts = np.flatnonzero(np.diff(sizes.cumsum() // TOGETHER, prepend=-1))
        for start, end in zip(starts, np.append(starts[1:], len(sizes)), strict=True):
            yield batch.slice(start, end - start)


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts' s and last, one after another with -1 between them, and where each text begins and ends. Of single words s is the last, too."""
    gap = np.array([-1], np.int32).tobytes()
    rows = batch.column(0).to_pylist()
    s = np.frombuffer(gap.join(rows) + gap, np.int32)
    last = s if batch.column(1).null_count else np.frombuffer(gap.join(batch.column(1).to_pylist()) + gap, np.int32)
    return s, last, np.concatenate([[0], np.cumsum([len(x) // 4 + 1 for x in rows])]).astype(np.int64)


def _keys(s: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where a phrase and the one a word on are both frequent, and the keys of what they make together."""
    at = np.flatnonzero((s[:-1] >= 0) & (s[1:] >= 0))
    return at, s[at].astype(np.uint64) << np.uint64(32) | last[at + 1].astype(np.uint64)


def _sum_in_tree(rows: DataFrame, finish: Callable[[int, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """``slice`` and ``counts`` (64-bit integers) summed over tasks, first in branches, then over these; and what ``finish`` makes of each sum."""

    def total(group: pd.DataFrame) -> np.ndarray:
        out = np.zeros(SLICE, np.int64)
        for counts in group["counts"]:
            out += np.frombuffer(counts, np.int64)
        return out

    def add(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"slice": group["slice"].iloc[:1], "counts": [total(group).tobytes()]})

    def end(group: pd.DataFrame) -> pd.DataFrame:
        return finish(int(group["slice"].iloc[0]), total(group))

    return rows.groupBy("slice", "branch").applyInPandas(add, "slice int, counts binary").groupBy("slice").applyInPandas(end, schema)


def count_places(state: DataFrame, size: int, place: Callable[[np.ndarray], np.ndarray], finish: Callable[[int, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """``finish`` of each slice of the occurrences of ``place(keys)`` (from 0 to ``size`` - 1, negative ones not counted) over all keys."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(-(-size // SLICE) * SLICE, np.int64)
        for batch in _pieces(batches):
            s, last, _ = _arrays(batch)
            at = place(_keys(s, last)[1])
            at, times = np.unique(at[at >= 0], return_counts=True)  # a bincount of what occurs, without a second long array
            total[at] += times
        used = [i for i in range(len(total) // SLICE) if total[i * SLICE : (i + 1) * SLICE].any()]
        branch = TaskContext.get().partitionId() % 16
        for i in used:
            yield pa.RecordBatch.from_pydict({"slice": pa.array([i], pa.int32()), "branch": pa.array([branch], pa.int32()), "counts": [total[i * SLICE : (i + 1) * SLICE].tobytes()]})

    return _sum_in_tree(_tasks(state).mapInArrow(count, "slice int, branch int, counts binary"), finish, schema)


def _buckets(keys: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """A key's place in either half of the buckets, by hashes that have nothing to do with each other."""
    mask = np.uint64(half - 1)
    return (mix64(keys) & mask).astype(np.int64), half + (mix64(keys ^ np.uint64(0x9E3779B97F4A7C15)) & mask).astype(np.int64)


def heavy_buckets(state: DataFrame, buckets: int, min_count: int) -> np.ndarray:
    """For each bucket of hashed keys whether it has ``min_count`` occurrences: one bit each on the driver."""
    found = np.zeros(buckets // 8, np.uint8)

    def bits(at: int, counts: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"slice": [at], "bits": [np.packbits(counts >= min_count).tobytes()]})

    def place(keys: np.ndarray) -> np.ndarray:
        return np.concatenate(_buckets(keys, buckets // 2))

    for row in count_places(state, buckets, place, bits, "slice int, bits binary").collect():
        found[row["slice"] * SLICE // 8 : (row["slice"] + 1) * SLICE // 8] = np.frombuffer(row["bits"], np.uint8)
    return np.unpackbits(found).view(bool)


def candidates(state: DataFrame, heavy: np.ndarray) -> DataFrame:
    """``key`` of all keys that occur and have a heavy bucket in both halves: an infrequent key seldom shares both with frequent ones."""
    shared = state.sparkSession.sparkContext.broadcast(np.packbits(heavy))

    def distinct(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good = np.unpackbits(shared.value).view(bool)
        held = np.zeros(0, np.uint64)
        row = lambda keys: pa.RecordBatch.from_pydict({"key": keys.view(np.int64)})
        for batch in _pieces(batches):
            s, last, _ = _arrays(batch)
            keys = _keys(s, last)[1]
            first, second = _buckets(keys, len(good) // 2)
            held = np.union1d(held, keys[good[first] & good[second]])
            if len(held) > KEYS_HELD:
                yield row(held)
                held = held[:0]
        if len(held):
            yield row(held)

    return cut(_tasks(state).mapInArrow(distinct, "key bigint").distinct())


def perfect_tables(keys: DataFrame) -> tuple[DataFrame, int, int]:
    """A perfect hash for each part of ``key``: part, n, data; the number of parts and of keys."""
    n = keys.count()
    parts = -(-n // PART_KEYS) or 1

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": rows["part"].iloc[:1], "n": [len(rows)], "data": [PerfectHash(rows["key"].to_numpy().view(np.uint64)).to_bytes()]})

    part = F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int").alias("part")
    return cut(keys.select("key", part).groupBy("part").applyInPandas(build, "part int, n bigint, data binary")), parts, n


def _part(tables: DataFrame, part: int) -> bytes:
    """One hash, of bounded size, for the tasks."""
    row = tables.where(F.col("part") == part).select("data").first()
    return bytes(row["data"]) if row else PerfectHash(np.zeros(0, np.uint64)).to_bytes()


def count_keys(state: DataFrame, keys: DataFrame, min_count: int) -> DataFrame:
    """``key`` and ``f`` of those of ``keys`` that occur at least ``min_count`` times."""
    tables, parts, _ = perfect_tables(keys)
    counted = None
    for part in range(parts):
        shared = state.sparkSession.sparkContext.broadcast(_part(tables, part))
        size = len(PerfectHash.from_bytes(shared.value))

        def slots(found: np.ndarray, shared=shared, cache={}) -> np.ndarray:  # noqa: B006  one hash a task
            if "hash" not in cache:
                cache["hash"] = PerfectHash.from_bytes(shared.value)
            return cache["hash"].slots(found)

        def read(at: int, f: np.ndarray, shared=shared) -> pd.DataFrame:
            often = np.flatnonzero(f >= min_count)
            return pd.DataFrame({"key": PerfectHash.from_bytes(shared.value).keys.view(np.int64)[at * SLICE + often], "f": f[often]})

        mine = cut(count_places(state, size, slots, read, "key bigint, f bigint"))
        counted = mine if counted is None else counted.unionByName(mine)
    return counted


def number_phrases(frequent: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """``id``, ``prefix``, ``word`` and ``f`` of frequent phrases, numbered by slots; the tables that number them; their parts."""
    tables, parts, n = perfect_tables(frequent.select("key"))

    def spread(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part, data in zip(frame["part"], frame["data"], strict=True):
                keys = PerfectHash.from_bytes(data).keys.view(np.int64)
                yield pd.DataFrame({"part": np.full(len(keys), part, np.int32), "slot": np.arange(len(keys)), "key": keys})

    placed = cut(tables.mapInPandas(spread, "part int, slot bigint, key bigint"))
    named = _offset(placed, n).select("id", "key").join(frequent, "key")
    return cut(named.select("id", F.shiftrightunsigned("key", 32).alias("prefix"), F.col("key").bitwiseAND(0xFFFFFFFF).alias("word"), "f")), tables, parts


def advance(state: DataFrame, tables: DataFrame, parts: int) -> DataFrame:
    """The arrays of phrases that are one word longer."""
    start = 0
    now = state.withColumn("next", F.lit(None).cast("binary"))
    for part in range(parts):
        data = _part(tables, part)
        shared, done = state.sparkSession.sparkContext.broadcast(data), part == parts - 1

        def fill(batches: Iterable[pa.RecordBatch], shared=shared, start=start, done=done) -> Iterator[pa.RecordBatch]:
            table = PerfectHash.from_bytes(shared.value)
            for batch in _pieces(batches):
                s, last, bounds = _arrays(batch)
                longer = np.full(len(s), -1, np.int32)
                at, keys = _keys(s, last)
                slots = table.slots(keys)
                longer[at] = np.where(slots >= 0, slots + start, -1)
                if batch.column(2).null_count == 0:
                    before = np.frombuffer(b"".join(x + np.array([-1], np.int32).tobytes() for x in batch.column(2).to_pylist()), np.int32)
                    longer = np.where(before >= 0, before, longer)
                pieces = [slice(b, e - 1) for b, e in zip(bounds[:-1], bounds[1:], strict=True)]
                if not done:
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([longer[p].tobytes() for p in pieces], pa.binary())], names=["s", "last", "next"])
                    continue
                ends = np.append(last[1:], np.int32(-1))
                kept = [(p, _kept(longer[p])) for p in pieces]
                kept = [(p, k) for p, k in kept if (longer[p] >= 0).any()]
                yield pa.RecordBatch.from_arrays([pa.array([longer[p][k].tobytes() for p, k in kept], pa.binary()), pa.array([ends[p][k].tobytes() for p, k in kept], pa.binary())], names=["s", "last"])

        start += len(PerfectHash.from_bytes(data))
        before, now = now, cut(now.mapInArrow(fill, "s binary, last binary" if done else "s binary, last binary, next binary"))
        if part:
            discard(before)
    return now


def collocations(docs: DataFrame, *, min_count: int = 100, max_words: int = 5, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the ``top`` best phrases of 2 to ``max_words`` words of each lang of ``docs`` (text, lang).

    a, l and r are the occurrences of the phrase, and of the parts before and after its weakest cut, n all words of the lang;
    score is floor(1000 a n / (l r)). A phrase goes if a longer one that holds it occurs as often. A null lang
    counts as ``und``; null and empty texts have no words; repeated rows count each; a table without frequent phrases gives no rows.
    """
    words = count_words(docs, min_count)
    totals = words.where("word is null").select("lang", F.col("f").alias("n"))
    numbered, parts = number_words(words.where("word is not null"))
    n_words = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = 1 << min(24, max(17, (n_words // 64).bit_length()))
    state = encode_words(docs, numbered, parts)
    none = F.array().cast("array<bigint>")
    first = cut(numbered.select("id", "lang", F.col("word").alias("phrase"), "f", F.lit(None).cast("bigint").alias("prefix"), F.lit(None).cast("bigint").alias("suffix"), none.alias("lefts"), none.alias("rights")))
    levels = [first]
    for _ in range(2, max_words + 1):
        found = count_keys(state, candidates(state, heavy_buckets(state, buckets, min_count)), min_count)
        phrases, tables, parts = number_phrases(found)
        if phrases.isEmpty():
            break
        old, state = state, advance(state, tables, parts)
        discard(old)
        levels.append(cut(_with_parts(phrases, levels[-1], first)))
    if len(levels) == 1:
        return first.join(totals, "lang").where("false").selectExpr("lang", "0L as rank", "phrase", "f as a", "f as l", "f as r", "n", "f as score")
    kept = None
    for level, longer in zip(levels[1:], [*levels[2:], None], strict=True):
        if longer is not None:
            held = longer.select(F.explode(F.array("prefix", "suffix")).alias("id"), "f").distinct()
            level = level.join(held, ["id", "f"], "left_anti")
        level = level.select("lang", "phrase", "f", "lefts", "rights")
        kept = level if kept is None else kept.unionByName(level)
    # products have up to 38 digits, ties go to the first cut
    score = "cast((1000 * cast(f as decimal(18,0)) * cast(n as decimal(15,0))) div (cast(c.lefts as decimal(18,0)) * cast(c.rights as decimal(18,0))) as bigint)"
    weakest = F.expr(f"array_min(transform(arrays_zip(lefts, rights), (c, k) -> struct({score} as score, k, c.lefts as l, c.rights as r)))").alias("cut")
    rows = kept.join(totals, "lang").select("lang", "phrase", F.col("f").alias("a"), "n", weakest).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    ranked = rows.selectExpr("lang", "cast(row_number() over (partition by lang order by score desc, a desc, phrase) as bigint) as rank", "phrase", "a", "l", "r", "n", "score")
    return ranked.where(F.col("rank") <= top)


def _with_parts(phrases: DataFrame, shorter: DataFrame, words: DataFrame) -> DataFrame:
    """Phrases with their text, the number of their last words but the first, and the counts of what lies before and after each cut."""
    front = shorter.select(F.col("id").alias("prefix"), "lang", F.col("phrase").alias("front"), F.col("f").alias("front_f"), F.col("suffix").alias("middle"), "lefts")
    end = words.select(F.col("id").alias("word"), F.col("phrase").alias("end"), F.col("f").alias("end_f"))
    joined = phrases.join(front, "prefix").join(end, "word")
    if shorter is words:
        rest = joined.withColumns({"suffix": F.col("word"), "rest_f": F.col("end_f"), "rest_rights": F.array().cast("array<bigint>")})
    else:
        tail = shorter.select(F.col("prefix").alias("middle"), F.col("word"), F.col("id").alias("suffix"), F.col("f").alias("rest_f"), F.col("rights").alias("rest_rights"))
        rest = joined.join(tail, ["middle", "word"])
    return rest.select("id", "lang", F.concat_ws(" ", "front", "end").alias("phrase"), "f", "prefix", "word", "suffix", F.concat("lefts", F.array("front_f")).alias("lefts"), F.concat(F.array("rest_f"), "rest_rights").alias("rights"))
