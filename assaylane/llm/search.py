"""Exact top-k search by BM25 over sharded inverted indexes of like documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut
from .grams import chunks, code_points, mix64

K1, B = 1.2, 0.75
#: Documents and postings of a block, which has one inverted index, about, at most.
BLOCK_DOCS, BLOCK_POSTINGS = 4096, 2_000_000
#: Documents that are dealt into groups at once.
BATCH_DOCS = 1024
#: Queries scored at once against a block.
QUERY_ROWS = 128
#: Terms of the queries that are broadcast at once, about; more queries make more rounds.
ROUND_TERMS = 4_000_000
#: Terms that more of the pairs of a query of a group and a document of a block share are multiplied as dense rows, the others by their postings.
DENSE_SHARE = 0.001
#: Groups that documents and queries are dealt into by their most frequent terms, so that a block's are alike, the terms, and the queries that the groups are found from.
GROUPS, GROUP_TERMS, GROUP_QUERIES = 8, 512, 4096
#: Places that scores are rounded to before they are ranked; ties go to the smaller doc_id.
PLACES = 6


def terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash and the text of every term: runs of letters and digits, in small letters.

    The hash is a polynomial in the code points, taken from running sums, and then mixed.
    """
    codes, starts = code_points(texts)
    present = np.flatnonzero(np.bincount(codes, minlength=1))
    small = np.zeros(int(present[-1]) + 1, dtype=np.uint64)
    for c in present.tolist():
        if chr(c).isalnum():
            low = chr(c).lower()
            small[c] = ord(low) if len(low) == 1 else c
    values = small[codes]
    inside = values > 0
    first = np.flatnonzero(inside & ~np.append(False, inside[:-1]))
    end = np.flatnonzero(inside & ~np.append(inside[1:], False)) + 1
    with np.errstate(over="ignore"):
        base = np.uint64(0x9E3779B97F4A7C15)
        power = np.multiply.accumulate(np.append(np.uint64(1), np.full(len(values), base)))
        inverse = np.multiply.accumulate(np.append(np.uint64(1), np.full(len(values), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64)))))
        sums = np.append(np.uint64(0), np.cumsum(values * power[:-1], dtype=np.uint64))
        hashes = mix64((sums[end] - sums[first]) * inverse[first] + (end - first).astype(np.uint64))
    return hashes, np.searchsorted(starts, first, side="right") - 1


def counted(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, hash and count of each different term of each text, by owner and then hash. Owners rise."""
    order = np.argsort(hashes)
    small = owner[order].astype(np.uint16) if len(owner) and owner[-1] < 1 << 16 else owner[order]  # short integers are sorted by radix
    order = order[np.argsort(small, kind="stable")]
    hashes, owner = hashes[order], owner[order]
    new = np.flatnonzero(np.append(True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1]))) if len(hashes) else np.zeros(0, np.int64)
    return owner[new], hashes[new], np.diff(np.append(new, len(hashes)))


@dataclass
class Queries:
    """A round's queries: the vocabulary's sorted hashes, and for each (query, term) pair, by query, the row, the term's place and its weight.

    ``common`` are places of frequent terms, and ``centers`` has a row for each of them and a column for each group; ``group`` is that of each row, and rises.
    """

    ids: np.ndarray
    vocabulary: np.ndarray
    row: np.ndarray
    term: np.ndarray
    weight: np.ndarray
    group: np.ndarray
    common: np.ndarray
    centers: np.ndarray

    def __post_init__(self) -> None:
        self.maybe = _maybe(self.vocabulary)
        self.common_at = np.full(len(self.vocabulary), -1, dtype=np.int32)
        self.common_at[self.common] = np.arange(len(self.common))

    def groups(self, doc: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        return _nearest(doc, self.common_at[term], n, self.centers)


def _nearest(doc: np.ndarray, at: np.ndarray, n: int, centers: np.ndarray) -> np.ndarray:
    """The group of each of ``n`` documents by the frequent terms (-1: another term) that it has."""
    held = np.zeros((n, len(centers)), dtype=np.float32)
    held[doc[at >= 0], at[at >= 0]] = 1
    return (held @ centers).argmax(axis=1)


def _maybe(vocabulary: np.ndarray) -> np.ndarray:
    marks = np.zeros(1 << 22, dtype=bool)
    marks[(vocabulary & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
    return marks


def _places(vocabulary: np.ndarray, maybe: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which hashes are in the sorted vocabulary, and where."""
    at = np.flatnonzero(maybe[(hashes & np.uint64((1 << 22) - 1)).astype(np.int64)])
    place = np.searchsorted(vocabulary, hashes[at])
    place[place == len(vocabulary)] = 0
    hit = vocabulary[place] == hashes[at] if len(vocabulary) else np.zeros(0, dtype=bool)
    return at[hit], place[hit]


def _centers(row: np.ndarray, at: np.ndarray, n: int, size: int) -> np.ndarray:
    """Directions of groups of alike queries by spherical k-means; they decide which documents share a block, and no score."""
    held = np.zeros((min(n, GROUP_QUERIES), size), dtype=np.float32)
    mine = (at >= 0) & (row < len(held))
    held[row[mine], at[mine]] = 1
    held /= np.maximum(np.sqrt((held**2).sum(axis=1, keepdims=True)), 1)
    centers = held[np.linspace(0, max(len(held) - 1, 0), GROUPS).astype(int)] if len(held) else np.zeros((GROUPS, size), dtype=np.float32)
    for _ in range(10):
        nearest = (held @ centers.T).argmax(axis=1)
        for g in np.unique(nearest):
            sums = held[nearest == g].sum(axis=0)
            centers[g] = sums / max(np.sqrt((sums**2).sum()), 1e-9)
    return centers.T


class Block:
    """The inverted index of some alike documents: postings by term, the tf part of BM25 in them, and each term's maximum."""

    def __init__(self, ids: np.ndarray, doc: np.ndarray, term: np.ndarray, impact: np.ndarray):
        self.ids, self.by_doc, self.n = ids, impact, np.bincount(doc, minlength=len(ids))
        self.begin = self.n.cumsum() - self.n
        self.terms, self.place, self.count = np.unique(term, return_inverse=True, return_counts=True)
        order = np.argsort(self.place, kind="stable")
        self.doc, self.impact = doc[order].astype(np.int32), impact[order]
        self.start = self.count.cumsum() - self.count
        self.most = np.maximum.reduceat(self.impact, self.start) if len(term) else np.zeros(0)

    def score(self, queries: Queries, best: "Best") -> None:
        """Offers to ``best`` all documents of queries whose bound in this block reaches their k-th score.

        Scores are first taken in single precision; a document that with its rounding reaches the k-th score is then scored in double precision.
        """
        if not len(self.terms):
            return
        places = np.full(len(queries.vocabulary), -1, dtype=np.int32)
        places[self.terms] = np.arange(len(self.terms))
        place = places[queries.term]
        pairs = np.flatnonzero(place >= 0)
        place, row, weight = place[pairs], queries.row[pairs], queries.weight[pairs]
        bound = np.bincount(row, weight * self.most[place], minlength=len(queries.ids))
        alive = np.flatnonzero((bound + 10.0**-PLACES >= best.least()) & (bound > 0))
        if not len(alive):
            return
        local = np.full(len(queries.ids), -1)
        local[alive] = np.arange(len(alive))
        kept = local[row] >= 0
        place, row, weight = place[kept], local[row[kept]], weight[kept]
        starts = np.searchsorted(row, np.arange(len(alive) + 1))
        held = np.zeros(len(self.terms))
        size = len(self.ids)

        def exact(rows: np.ndarray, docs: np.ndarray) -> np.ndarray:
            """Scores of pairs of a query and a document, which are by query."""
            out = np.empty(len(rows))
            for lo, hi in _runs(rows):
                mine = slice(starts[rows[lo]], starts[rows[lo] + 1])
                held[place[mine]] = weight[mine]
                n = self.n[docs[lo:hi]]
                posting = _spans(self.begin[docs[lo:hi]], n)
                out[lo:hi] = np.add.reduceat(held[self.place[posting]] * self.by_doc[posting], n.cumsum() - n)
                held[place[mine]] = 0
            return out

        kind = queries.group[alive]
        cuts = [lo for run, end in _runs(kind) for lo in range(run, end, QUERY_ROWS)]
        for first, last in zip(cuts, [*cuts[1:], len(alive)], strict=True):
            mine = alive[first:last]
            at = slice(starts[first], starts[last])
            r, p, w = row[at] - first, place[at], weight[at]
            if not first or kind[first] != kind[first - 1]:
                end = np.searchsorted(kind, kind[first], side="right")
                asked_by = np.bincount(place[starts[first] : starts[end]], minlength=len(self.terms))
                dense = np.flatnonzero(asked_by * self.count > DENSE_SHARE * (end - first) * size)
                column = np.full(len(self.terms), -1)
                column[dense] = np.arange(len(dense))
                rows = np.zeros((len(dense), size), dtype=np.float32)
                posting = _spans(self.start[dense], self.count[dense])
                rows[np.repeat(np.arange(len(dense)), self.count[dense]), self.doc[posting]] = self.impact[posting]
                over = 1 + (len(dense) + 64) * 2.0**-22  # single precision's rounding, many times over
            own = column[p] >= 0
            asked = np.zeros((len(mine), len(dense)), dtype=np.float32)
            asked[r[own], column[p[own]]] = w[own]
            r, p, w = r[~own], p[~own], w[~own]
            n = self.count[p]
            posting = _spans(self.start[p], n)
            scores = np.bincount(np.repeat(r * size, n) + self.doc[posting], np.repeat(w, n) * self.impact[posting], minlength=len(mine) * size).astype(np.float32).reshape(len(mine), size)
            scores += asked @ rows
            limit = (np.maximum(best.least()[mine] - 10.0**-PLACES, 1e-9) / over).astype(np.float32)
            near = scores >= limit[:, None]
            n_near = near.sum(axis=1)
            crowded = np.flatnonzero(n_near > 4 * best.k)
            n_best = min(best.k, size)
            if len(crowded):  # the likeliest first, whose scores rule most others out
                likely = np.sort(np.argpartition(scores[crowded], -n_best, axis=1)[:, -n_best:], axis=1)
                r, c = np.repeat(crowded, n_best), likely.ravel()
                best.offer(mine[r], self.ids[c], exact(first + r, c))
                scores[r, c] = 0
                limit = (np.maximum(best.least()[mine] - 10.0**-PLACES, 1e-9) / over).astype(np.float32)
                near[crowded] = scores[crowded] >= limit[crowded, None]
            r, c = np.divmod(np.flatnonzero(near), size)
            if len(r):
                best.offer(mine[r], self.ids[c], exact(first + r, c))


def _spans(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places of spans of ``n`` from ``start`` on, one after the other."""
    return np.repeat(start - n.cumsum() + n, n) + np.arange(n.sum())


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where runs of equal values begin and end."""
    cuts = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    return zip(cuts.tolist(), [*cuts[1:].tolist(), len(values)], strict=True)


class Best:
    """The k best documents so far of every query, of those that score above zero."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), -1.0)
        self.doc = np.full((n, k), np.iinfo(np.int64).max)

    def least(self) -> np.ndarray:
        return self.score[:, -1]

    def offer(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Takes (query row, document, score) triples, and keeps the best of each row; ties go to the smaller doc_id."""
        scores = np.round(scores, PLACES)
        good = (scores > 0) & (scores >= self.score[rows, -1])
        rows, ids, scores = rows[good], ids[good], scores[good]
        if not len(rows):
            return
        known = np.unique(rows)
        q = np.concatenate([rows, np.repeat(known, self.k)])
        s = np.concatenate([scores, self.score[known].ravel()])
        d = np.concatenate([ids, self.doc[known].ravel()])
        order = np.lexsort((d, -s, q))
        q, s, d = q[order], s[order], d[order]
        starts = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
        rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
        top = rank < self.k
        self.score[q[top], rank[top]] = s[top]
        self.doc[q[top], rank[top]] = d[top]


def _tokens(docs: DataFrame) -> DataFrame:
    """doc_id, n_terms, and the hash and count of each different term, written once: each round reads them and not the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in chunks(b.to_pandas() for b in batches):
            all_hashes, all_owner = terms(piece["text"].tolist())
            owner, hashes, n = counted(all_hashes, all_owner)
            cuts = np.searchsorted(owner, np.arange(len(piece) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(piece["doc_id"].astype("Int64"), type=pa.int64()),
                    pa.array(np.bincount(all_owner, minlength=len(piece)), type=pa.int64()),
                    pa.ListArray.from_arrays(pa.array(cuts), pa.array(hashes.view(np.int64))),
                    pa.ListArray.from_arrays(pa.array(cuts), pa.array(n.astype(np.int32))),
                ],
                names=["doc_id", "n_terms", "hashes", "counts"],
            )

    return cut(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_terms long, hashes array<long>, counts array<int>"))


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, hash and count of each different term of a batch of tokens."""
    hashes, counts = batch.column("hashes"), batch.column("counts")
    owner = np.repeat(np.arange(batch.num_rows), hashes.value_lengths().to_numpy(zero_copy_only=False))
    return owner, hashes.flatten().to_numpy(zero_copy_only=False).view(np.uint64), counts.flatten().to_numpy(zero_copy_only=False)


def _statistics(tokens: DataFrame, vocabulary: np.ndarray) -> tuple[int, int, np.ndarray]:
    """Documents, terms in them, and in how many documents each term of the vocabulary is."""
    shared = tokens.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        maybe, seen = _maybe(words), np.zeros(len(words), dtype=np.int64)
        for batch in batches:
            seen += np.bincount(_places(words, maybe, _flat(batch)[1])[1], minlength=len(words))
        found = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(seen[found])], names=["term", "n"])

    n_docs, n_terms = tokens.agg(F.count(F.lit(1)), F.sum("n_terms")).first()
    own = tokens.select("hashes", "counts").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(len(vocabulary), dtype=np.int64)
    df[own["term"].to_numpy(dtype=np.int64)] = own["n"]
    return n_docs, n_terms or 0, df


def _search_round(tokens: DataFrame, round_queries: pd.DataFrame, statistics: tuple[int, int, np.ndarray], known: np.ndarray, k: int, splits: int) -> DataFrame:
    n_docs, n_terms, df = statistics
    hashes = np.concatenate([np.zeros(0, np.int64), *(np.asarray(x, dtype=np.int64) for x in round_queries["hashes"])]).view(np.uint64)
    counts = np.concatenate([np.zeros(0), *(np.asarray(x, dtype=float) for x in round_queries["counts"])])
    row = np.repeat(np.arange(len(round_queries)), round_queries["hashes"].map(len))
    vocabulary, term = np.unique(hashes, return_inverse=True)
    df = df[np.searchsorted(known, vocabulary)]
    idf = np.log(1 + (n_docs - df + 0.5) / (df + 0.5))
    mean = max(n_terms / max(n_docs, 1), 1e-9)
    common = np.argsort(-df, kind="stable")[:GROUP_TERMS]
    at = np.full(len(vocabulary), -1)
    at[common] = np.arange(len(common))
    centers = _centers(row, at[term], len(round_queries), len(common))
    group = _nearest(row, at[term], len(round_queries), centers)
    order = np.argsort(group, kind="stable")
    seat = np.empty(len(order), dtype=np.int64)
    seat[order] = np.arange(len(order))
    by_row = np.argsort(seat[row], kind="stable")
    ids = round_queries["query_id"].to_numpy(dtype=np.int64)[order]
    shared = tokens.sparkSession.sparkContext.broadcast(Queries(ids, vocabulary, seat[row][by_row], term[by_row], (counts * idf[term])[by_row], group[order], common, centers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        best = Best(len(queries.ids), k)
        held: dict[int, list[tuple]] = {}
        docs_held: dict[int, int] = {}
        size: dict[int, int] = {}

        def flush(group: int) -> None:
            parts = held.pop(group)
            first = np.cumsum([0, *(len(x[0]) for x in parts)])
            docs_held.pop(group), size.pop(group)
            Block(
                np.concatenate([x[0] for x in parts]),
                np.concatenate([x[1] + n for x, n in zip(parts, first, strict=False)]),
                np.concatenate([x[2] for x in parts]),
                np.concatenate([x[3] for x in parts]),
            ).score(queries, best)

        for whole in batches:
            for start in range(0, whole.num_rows, BATCH_DOCS):
                batch = whole.slice(start, BATCH_DOCS)
                ids, length = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "n_terms"))
                owner, hashes, n = _flat(batch)
                hit, term = _places(queries.vocabulary, queries.maybe, hashes)
                doc, tf = owner[hit], n[hit]
                impact = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / mean))
                kind = queries.groups(doc, term, len(ids))
                for g in np.unique(kind).tolist():
                    mine = kind == g
                    kept = mine[doc]
                    if g in held and (docs_held[g] + mine.sum() > BLOCK_DOCS or size[g] + kept.sum() > BLOCK_POSTINGS):
                        flush(g)
                    held.setdefault(g, []).append((ids[mine], (mine.cumsum() - 1)[doc[kept]], term[kept], impact[kept]))
                    docs_held[g] = docs_held.get(g, 0) + int(mine.sum())
                    size[g] = size.get(g, 0) + int(kept.sum())
                while sum(size.values()) > 2 * BLOCK_POSTINGS:
                    flush(max(size, key=size.get))
        for g in list(held):
            flush(g)
        q, rank = np.nonzero(best.score > 0)
        yield pa.RecordBatch.from_arrays([pa.array(queries.ids[q]), pa.array(best.doc[q, rank]), pa.array(best.score[q, rank])], names=["query_id", "doc_id", "score"])

    rows = tokens.where("doc_id is not null")
    parts = rows.coalesce(max(1, rows.rdd.getNumPartitions() // splits)) if splits > 1 else rows
    return parts.mapInArrow(run, "query_id long, doc_id long, score double")


def search(docs: DataFrame, queries: DataFrame, *, k: int = 10, splits: int = 4) -> DataFrame:
    """The k best rows of ``docs`` for every row of ``queries`` (doc_id, text): query_id, doc_id, score, rank.

    BM25 (k1 1.2, b 0.75, idf log(1 + (N - df + 0.5) / (df + 0.5)), a query's repeated terms counted) with N, df and the mean
    length of all documents. Texts are read once, and their counted terms are written. A shard is ``splits`` of that table's splits, read by one task. The task keeps each query's
    k best and deals documents into blocks of alike ones: a block's inverted index holds the largest
    impact of each term, their weighted sum bounds a query's scores there, and a query
    whose bound is under its k-th score skips the block. The others score all of its documents in single precision, and those
    that can reach the k-th score in double. The shards' winners are then ranked. Every score uses global
    statistics, so the result is that of one index.

    Queries are broadcast in rounds of about ROUND_TERMS different terms, all rows being searched in
    every round; the different terms of all queries are held by the driver at once. Scores are rounded to six places; ties go to the smaller doc_id, and a repeated row takes its places.
    Only documents that share a term with the query are returned, so a query without terms, or
    with null text, has no rows. Rows with a null doc_id are counted but not returned. A query that is a document finds itself.
    """
    tokens = _tokens(docs)
    asked = _tokens(queries.where("doc_id is not null")).select(F.col("doc_id").alias("query_id"), "hashes", "counts")
    total = asked.agg(F.sum(F.size("hashes"))).first()[0] or 0
    rounds = -(-total // ROUND_TERMS) or 1
    known = np.unique(asked.select(F.explode("hashes").alias("term")).distinct().toPandas()["term"].to_numpy(dtype=np.int64).view(np.uint64))
    statistics = _statistics(tokens, known)
    found = None
    for i in range(rounds):
        mine = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(rounds)) == i).toPandas().sort_values("query_id").drop_duplicates("query_id")
        part = _search_round(tokens, mine, statistics, known, k, splits)
        found = part if found is None else found.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
