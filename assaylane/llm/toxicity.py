"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut
from .grams import chunks, code_points, lower_letters, mix64

#: Hashed n-grams: fixes the size of all that the driver gathers.
BUCKETS = 1 << 19
SIZES = (3, 4, 5)
#: Bytes of labels up to which they are broadcast.
BROADCAST_BYTES = 32 << 20
#: Letters of a typical text, and the steps in which values are added up (whole numbers add up alike in any order).
TYPICAL = 2000
STEPS = 1000


def features(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram size: the bucket and the text of every n-gram, in order of texts.

    n-grams run over small letters; whatever is no letter counts as one blank, so an n-gram can hold
    a word's edge. They don't cross from text to text.
    """
    codes, starts = code_points(texts)
    letters = lower_letters(codes).astype(np.uint64)
    edge = np.zeros(len(letters), dtype=bool)
    edge[starts - 1] = True
    edge[-1] = True
    keep = (letters > 0) | edge | np.append(True, letters[:-1] > 0)  # of a run of blanks only the first, and texts' edges
    owner = (edge.cumsum() - 1)[keep]
    letters, edge = letters[keep], edge[keep]
    edges = np.append(0, edge.cumsum())
    for size in SIZES:
        n = len(letters) - size + 1
        if n <= 0:
            continue
        packed = np.zeros(n, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for i in range(size):
                packed = packed * np.uint64(0x100000001B3) + letters[i : i + n]
        inside = edges[size - 1 : size - 1 + n] == edges[1 : n + 1]  # no text's edge after the first place and before the last
        yield (mix64(packed[inside] + np.uint64(size)) % np.uint64(BUCKETS)).astype(np.int64), np.minimum(owner[:n][inside], len(texts) - 1)


def values(texts: list[str], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, bucket and value of every n-gram of every text, each pair once, optionally of ``wanted`` buckets only.

    The value is log(1 + occurrences in TYPICAL n-grams): toxicity shows in how dense an n-gram is,
    so a long text isn't held to have more of everything.
    """
    pairs, length = [], np.zeros(len(texts))
    for buckets, owner in features(texts):
        length = np.maximum(length, np.bincount(owner, minlength=len(texts)))
        if wanted is not None:
            at = np.flatnonzero(wanted[buckets])
            buckets, owner = buckets[at], owner[at]
        pairs.append(owner * BUCKETS + buckets)
    found, count = np.unique(np.concatenate(pairs), return_counts=True) if pairs else (np.zeros(0, np.int64), np.zeros(0))
    owner = found // BUCKETS
    return owner, found % BUCKETS, np.log1p(count * TYPICAL / np.maximum(length[owner], TYPICAL / 4))


@dataclass(frozen=True)
class ToxicityModel:
    """``weight[bucket]``: the ratio times its coefficient, zero for what is left out."""

    weight: np.ndarray
    bias: float

    def score(self, texts: list[str]) -> np.ndarray:
        owner, buckets, value = values(texts, self.weight != 0)
        return 1 / (1 + np.exp(-(self.bias + np.bincount(owner, self.weight[buckets] * value, minlength=len(texts)))))


def log_count_ratios(total: np.ndarray, squares: np.ndarray, rows: np.ndarray, *, min_ratio: float, min_z: float) -> np.ndarray:
    """log of the mean value of a bucket in toxic texts over that in other texts; zero where it is small or may be chance.

    ``total[class, bucket]`` and ``squares`` sum values and their squares over ``rows[class]`` texts; class 1 is toxic.
    """
    n = rows[:, None]
    mean = total / n
    spread = np.maximum(squares / n - mean**2, 0) / n + 1 / n**2
    ratio = np.log((total[1] + 1) / (n[1] + 2)) - np.log((total[0] + 1) / (n[0] + 2))
    sure = np.abs(mean[1] - mean[0]) / np.sqrt(spread.sum(axis=0))
    return np.where((np.abs(ratio) >= min_ratio) & (sure >= min_z), ratio, 0.0)


def logistic(owner: np.ndarray, feature: np.ndarray, value: np.ndarray, label: np.ndarray, n_features: int, *, l2: float, rounds: int) -> tuple[np.ndarray, float]:
    """Logistic regression of sparse rows by Nesterov's accelerated gradient, with a ridge ``l2`` on all but the bias."""
    n = len(label)
    w, b = np.zeros(n_features), float(np.log((label.sum() + 1) / (n - label.sum() + 1)))
    step = 4.0 / (1 + np.bincount(owner, value**2, minlength=n).max(initial=0) + 4 * l2)
    v, c = w.copy(), b
    for t in range(rounds):
        margin = c + np.bincount(owner, v[feature] * value, minlength=n)
        error = (1 / (1 + np.exp(-margin)) - label) / n
        w_next = v - step * (np.bincount(feature, error[owner] * value, minlength=n_features) + l2 * v)
        b_next = c - step * error.sum()
        pull = t / (t + 3)
        v, c = w_next + pull * (w_next - w), b_next + pull * (b_next - b)
        w, b = w_next, b_next
    return w, b


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, max_fit_rows: int = 10_000, min_ratio: float = 0.25, min_z: float = 4.0, l2: float = 1e-4, rounds: int = 400) -> ToxicityModel:
    """Learns from the rows of ``docs`` that have a ``labels.toxic``; of several labels of a doc_id the largest counts.

    The log-count ratios use every labelled text: tasks count in arrays of BUCKETS numbers, and Spark adds them.
    The linear classifier is then fitted on the driver to about ``max_fit_rows`` labelled texts
    at most (a hash of doc_id picks them), of which only the buckets with a ratio come, BUCKETS at most. Labels are broadcast to the documents if their counted size is within
    BROADCAST_BYTES; above, both are shuffled by doc_id.
    Without labels of both kinds the model gives every text the share of toxic labels (one half if there are none).
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    texts = docs.select(F.col("doc_id").alias("_id"), "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, squares = np.zeros(2 * BUCKETS, dtype=np.int64), np.zeros(2 * BUCKETS, dtype=np.int64)
        rows = np.zeros(2, dtype=np.int64)
        for piece in chunks(batches):
            toxic = (piece["toxic"].to_numpy() > 0).astype(np.int64)
            owner, buckets, value = values(piece["text"].tolist())
            at, v = toxic[owner] * BUCKETS + buckets, np.rint(value * STEPS)
            total += np.bincount(at, v, minlength=2 * BUCKETS).astype(np.int64)
            squares += np.bincount(at, v * v, minlength=2 * BUCKETS).astype(np.int64)
            rows += np.bincount(toxic, minlength=2)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at.astype("int32"), "total": total[at], "squares": squares[at]})
        yield pd.DataFrame({"bucket": np.array([-2, -1], "int32"), "total": rows, "squares": 0})

    known = cut(known)
    labels_side = F.broadcast(known) if known.count() * 16 <= BROADCAST_BYTES else known
    labelled = texts.join(labels_side, F.col("_id") == F.col("doc_id")).select("text", "toxic")
    counts = labelled.mapInPandas(count, "bucket int, total long, squares long").groupBy("bucket").agg(F.sum("total").alias("total"), F.sum("squares").alias("squares")).toPandas().sort_values("bucket")
    n_neg, n_pos = (int(counts.loc[counts["bucket"] == k, "total"].sum()) for k in (-2, -1))
    weight = np.zeros(BUCKETS)
    if not n_pos or not n_neg:
        return ToxicityModel(weight, float(np.log((n_pos + 1) / (n_neg + 1))))
    counts = counts[counts["bucket"] >= 0]
    total, squares = np.zeros(2 * BUCKETS), np.zeros(2 * BUCKETS)
    total[counts["bucket"]], squares[counts["bucket"]] = counts["total"] / STEPS, counts["squares"] / STEPS**2
    ratio = log_count_ratios(total.reshape(2, -1), squares.reshape(2, -1), np.array([n_neg, n_pos]), min_ratio=min_ratio, min_z=min_z)
    shared = docs.sparkSession.sparkContext.broadcast(ratio != 0)

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for piece in chunks(batches):
            owner, buckets, value = values(piece["text"].tolist(), shared.value)
            cuts = np.searchsorted(owner, np.arange(1, len(piece)))
            yield pd.DataFrame({"toxic": piece["toxic"], "buckets": [x.tolist() for x in np.split(buckets, cuts)], "vals": [x.tolist() for x in np.split(value, cuts)]})

    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, max_fit_rows / (n_pos + n_neg)))))
    sample = texts.join(F.broadcast(cut(chosen)), F.col("_id") == F.col("doc_id")).select("text", "toxic").mapInPandas(pick, "toxic int, buckets array<int>, vals array<float>").toArrow()
    if not sample.num_rows:
        return ToxicityModel(weight, float(np.log((n_pos + 1) / (n_neg + 1))))
    lists = sample.column("buckets").combine_chunks()
    owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    buckets = lists.flatten().to_numpy().astype(np.int64)
    value = sample.column("vals").combine_chunks().flatten().to_numpy().astype(np.float64)
    label = (sample.column("toxic").to_numpy() > 0).astype(float)
    names, feature = np.unique(buckets, return_inverse=True)
    w, bias = logistic(owner, feature, ratio[names][feature] * value, label, len(names), l2=l2, rounds=rounds)
    weight[names] = w * ratio[names]
    return ToxicityModel(weight, bias)


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, threshold: float = 0.3) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from ``threshold`` on) for every row of ``docs``.

    Reads doc_id and whole texts only. Null or empty text: the score of no n-gram, which is
    the model's bias. Repeated rows get equal scores; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for piece in chunks(batches):
            score = shared.value.score(piece["text"].tolist())
            yield pd.DataFrame({"doc_id": piece["doc_id"], "score": score, "predicted": (score >= threshold).astype("int32")})

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInPandas(run, "doc_id long, score double, predicted int")
