"""Ranked lexical search: compressed postings in shards, merged one document at a time for each query.

A shard is a run of documents that one task indexes. Its documents are numbered in the order of doc_id; a posting list holds, for
one term, the gaps between these numbers and the term's counts, as variable-length integers. A query opens the lists of its
terms in every shard, merges them by a heap of cursors, document after document, and keeps its best documents in a bounded
heap of (score, -doc_id). The bests of all shards are merged by one ranking. Weights and lengths come from the whole corpus.

Lists whose greatest contributions together can't reach the k-th score so far are not merged but looked into for documents that the
others brought up, so common words cost little. That leaves out only documents that can't be among the best.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import cut

#: Bytes of text in a shard, but for a longer single text: bounds a task's memory and a shard's lists.
SHARD_BYTES = 1 << 24
#: Vocabularies up to this many bytes are handed to the indexing tasks; a larger one means that all terms are indexed.
BROADCAST_BYTES = 32 << 20
#: Queries that are answered in one group with a shard.
BLOCK_QUERIES = 512

#: Term bytes stay, capitals made small; all other bytes become spaces. Bytes from 0x80 belong to characters that are no separators.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text in order: runs of ASCII letters, digits and characters beyond ASCII, A-Z made small."""
    return [] if text is None else text.translate(_FOLD).split()


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative integers as bytes of seven bits, low ones first, the last byte of each below 128; and the bytes of each."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    for shift in range(7, 64, 7):
        size += values >> np.uint64(shift) > 0
    start = size.cumsum() - size
    out = np.zeros(int(size.sum()), np.uint8)
    for i in range(int(size.max(initial=0))):
        at = np.flatnonzero(size > i)
        part = values[at] >> np.uint64(7 * i) & np.uint64(127)
        out[start[at] + i] = part + np.where(size[at] > i + 1, 128, 0).astype(np.uint64)
    return out, size


def unpack(data: bytes) -> np.ndarray:
    """The integers that :func:`pack` wrote."""
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)
    if not len(ends):
        return np.zeros(0, np.int64)
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), starts)


INDEX = pa.schema([("shard", pa.string()), ("term", pa.string()), ("df", pa.int64()), ("postings", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))])
_INDEX_DDL = "shard string, term string, df bigint, postings binary, doc_ids array<bigint>, lengths array<bigint>"


def _shard(name: str, docs: list[tuple[int, bytes]], vocabulary: frozenset | None) -> pa.RecordBatch:
    """Rows of one shard: one without a term that has its documents, and one for each term."""
    docs.sort(key=lambda d: d[0])
    ids, lengths, terms, numbers, counts = [], [], [], [], []
    for doc_id, text in docs:
        found = terms_of(text)
        if not found:
            continue
        tf = Counter(found if vocabulary is None else [t for t in found if t in vocabulary])
        terms += tf.keys()
        counts += tf.values()
        numbers += [len(ids)] * len(tf)
        ids.append(doc_id)
        lengths.append(len(found))
    if not terms:
        return pa.RecordBatch.from_pydict({"shard": [name], "term": [None], "df": [None], "postings": [None], "doc_ids": [ids], "lengths": [lengths]}, schema=INDEX)
    names, code = np.unique(np.array(terms, dtype=object), return_inverse=True)
    order = np.argsort(code, kind="stable")
    code, number, count = code[order], np.array(numbers)[order], np.array(counts)[order]
    first = np.flatnonzero(np.diff(code, prepend=-1))
    gaps = np.diff(number, prepend=0)
    gaps[first] = number[first]
    packed, size = pack(np.column_stack([gaps, count]).ravel())
    ends = size.cumsum()[np.append(first[1:], len(code)) * 2 - 1]
    starts = np.concatenate([[0], ends[:-1]])
    raw = packed.tobytes()
    empty = [None] * len(names)
    columns = {"shard": [name] * (len(names) + 1), "term": [None, *(t.decode() for t in names)], "df": [None, *np.diff(np.append(first, len(code))).tolist()], "postings": [None, *(raw[s:e] for s, e in zip(starts, ends, strict=True))], "doc_ids": [ids, *empty], "lengths": [lengths, *empty]}
    return pa.RecordBatch.from_pydict(columns, schema=INDEX)


def build_index(docs: DataFrame, vocabulary: frozenset | None = None) -> DataFrame:
    """The index of all ``docs`` (doc_id, text): shard, and either term, df, postings or the shard's doc_ids and lengths.

    Every document with a term is in it, and counts with its whole length; with a ``vocabulary`` (UTF-8 bytes) lists of other terms are left out.
    Rows without a doc_id are left out, as no result could name them; rows that repeat a doc_id are documents of their own.
    """
    broadcast = None if vocabulary is None else docs.sparkSession.sparkContext.broadcast(vocabulary)

    def shards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = None if broadcast is None else broadcast.value
        held, size, n = [], 0, 0
        part = TaskContext.get().partitionId()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append((doc_id, text))
                size += len(text)
                if size >= SHARD_BYTES:
                    yield _shard(f"{part}-{n}", held, words)
                    held, size, n = [], 0, n + 1
        if held:
            yield _shard(f"{part}-{n}", held, words)

    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint"), F.encode("text", "UTF-8").alias("text"))
    return rows.mapInArrow(shards, _INDEX_DDL)


@F.pandas_udf(T.ArrayType(T.StringType()))
def distinct_terms(texts: pd.Series) -> pd.Series:
    """The different terms of each text, in order; none for a null."""
    return texts.map(lambda t: sorted({w.decode() for w in terms_of(t.encode())}) if t is not None else [])


class _Shard:
    """The documents and opened lists of one shard."""

    def __init__(self, doc_ids: np.ndarray, lengths: np.ndarray, postings: dict[str, bytes], weights: dict[str, int], n_docs: int, n_terms: int) -> None:
        self.doc_ids = doc_ids
        self.m8 = 8 * (10 + 90 * lengths * n_docs // n_terms)
        self.lists, self.lookups, self.most = {}, {}, {}
        for term, raw in postings.items():
            values = unpack(raw)
            number, tf = values[0::2].cumsum(), values[1::2]
            gain = weights[term] * (1_000_000_000 * tf // (1000 * tf + self.m8[number]))
            self.most[term] = int(gain.max())
            self.lists[term] = (number.tolist(), gain.tolist())

    def gains(self, term: str) -> dict[int, int]:
        if term not in self.lookups:
            self.lookups[term] = dict(zip(*self.lists[term], strict=True))
        return self.lookups[term]

    def best(self, terms: list[str], k: int) -> list[tuple[int, int]]:
        """Score and doc_id of the k best documents for the terms, by descending score and ascending doc_id."""
        terms = sorted((t for t in terms if self.most.get(t, 0) > 0), key=lambda t: (self.most[t], t))
        bounds = np.cumsum([self.most[t] for t in terms]).tolist()  # what the first lists can give together
        bar = self._seed(terms, k)
        heap: list[tuple[int, int]] = []  # (score, -number), the worst first
        apart = sum(b <= bar for b in bounds)  # lists that are looked into only
        cursors = [(self.lists[t][0][0], i, 0) for i, t in enumerate(terms) if i >= apart]
        heapq.heapify(cursors)
        while cursors:
            number, score = cursors[0][0], 0
            while cursors and cursors[0][0] == number:
                _, i, at = cursors[0]
                numbers, gains = self.lists[terms[i]]
                score += gains[at]
                if at + 1 < len(numbers) and i >= apart:
                    heapq.heapreplace(cursors, (numbers[at + 1], i, at + 1))
                else:
                    heapq.heappop(cursors)
            for i in range(apart - 1, -1, -1):
                if score + bounds[i] <= bar:
                    break
                score += self.gains(terms[i]).get(number, 0)
            else:
                if score > bar:
                    entry = (score, -number)
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    else:
                        heapq.heappushpop(heap, entry)
                    if len(heap) == k and heap[0][0] > bar:
                        bar = heap[0][0]
                        grown = sum(b <= bar for b in bounds)
                        if grown > apart:  # their cursors leave the merge; what they would bring up is looked up
                            apart = grown
                            cursors = [c for c in cursors if c[1] >= apart]
                            heapq.heapify(cursors)
        return [(score, int(self.doc_ids[-number])) for score, number in sorted(heap, reverse=True)]

    def _seed(self, terms: list[str], k: int) -> int:
        """A score that k documents are above: from documents that hold the terms of the greatest contributions."""
        seen: set[int] = set()
        for t in reversed(terms):
            seen.update(self.lists[t][0][: 2 * k])
            if len(seen) >= 2 * k:
                break
        scores = sorted((sum(self.gains(t).get(d, 0) for t in terms) for d in seen), reverse=True)
        return scores[k - 1] - 1 if len(scores) >= k else 0


def _answer(units: pd.DataFrame, postings: pd.DataFrame, k: int) -> pd.DataFrame:
    """The best documents of one shard for one block of queries."""
    out: dict[str, list] = {"item": [], "doc_id": [], "score": []}
    if len(units) and len(postings):
        unit = units.iloc[0]
        opened = _Shard(np.asarray(unit["doc_ids"], np.int64), np.asarray(unit["lengths"], np.int64), dict(zip(postings["term"], postings["postings"], strict=True)), dict(zip(postings["term"], postings["w"].tolist(), strict=True)), int(unit["n_docs"]), int(unit["n_terms"]))
        for query in unit["queries"]:
            for score, doc_id in opened.best(list(query["terms"]), k):
                out["item"].append(query["item"])
                out["doc_id"].append(doc_id)
                out["score"].append(score)
    return pd.DataFrame(out)


def rank_documents(docs: DataFrame, items: DataFrame, *, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` best ``docs`` (doc_id, text) for each of ``items`` (item_id, text).

    Scores above 0 only, by descending score and ascending doc_id. A null or termless text of an item has no result, of a document no place in the
    corpus counts. Rows that repeat an item_id are one item with the terms of all; items without an id are left out. Rows of docs without
    a doc_id are left out; those that repeat one are documents of their own and take a rank each. An empty table gives no rows.
    """
    spark = docs.sparkSession
    terms = items.where("item_id is not null").select("item_id", F.explode(distinct_terms("text")).alias("term")).distinct()
    asked = cut(terms.groupBy("item_id").agg(F.sort_array(F.collect_list("term")).alias("terms")))
    wanted = asked.select(F.explode("terms").alias("term")).distinct()
    n_items = asked.count()
    size = wanted.agg(F.coalesce(F.sum(F.octet_length("term") + 64), F.lit(0))).first()[0]
    vocabulary = frozenset(r["term"].encode() for r in wanted.toLocalIterator()) if size <= BROADCAST_BYTES else None
    index = cut(build_index(docs, vocabulary))
    heads = index.where("term is null")
    n_docs, n_terms = heads.agg(F.coalesce(F.sum(F.size("doc_ids")), F.lit(0)), F.coalesce(F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x)), F.lit(0))).first()

    blocks = -(-n_items // BLOCK_QUERIES) or 1
    block = F.pmod(F.xxhash64(F.col("item_id").cast("string")), F.lit(blocks)).alias("block")
    queries = asked.groupBy(block).agg(F.collect_list(F.struct(F.col("item_id").alias("item"), "terms")).alias("queries"))
    weights = index.where("term is not null").groupBy("term").agg(F.sum("df").alias("df"))
    w = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("bigint").alias("w")
    open_terms = asked.select(block, F.explode("terms").alias("term")).distinct().join(weights.select("term", w), "term")
    units = heads.select("shard", "doc_ids", "lengths", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("block")).join(queries, "block").withColumns({"n_docs": F.lit(n_docs).cast("bigint"), "n_terms": F.lit(n_terms).cast("bigint")})
    postings = index.where("term is not null").select("shard", "term", "postings").join(open_terms, "term").selectExpr("shard as in_shard", "block as in_block", "term", "postings", "w")

    def answer(units: pd.DataFrame, postings: pd.DataFrame) -> pd.DataFrame:
        return _answer(units, postings, k)

    schema = T.StructType([T.StructField("item", items.schema["item_id"].dataType), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
    found = units.groupBy("shard", "block").cogroup(postings.groupBy("in_shard", "in_block")).applyInPandas(answer, schema)
    return found.selectExpr("item as item_id", "row_number() over (partition by item order by score desc, doc_id) as rank", "doc_id", "score").where(F.col("rank") <= k)
