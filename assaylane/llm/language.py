"""Language identification as inference of a mixture of languages."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grams import chunks, code_points, lower_letters, mix64

#: Hashed trigrams: fixes the size of the model at BUCKETS numbers a language.
BUCKETS = 1 << 16
#: Languages a model can hold; the driver holds a table of BUCKETS by at most so many.
MAX_LANGUAGES = 256
UNDETERMINED = "und"


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each letter: the bucket of (letter before, itself, letter after), the number of its word, and, for each word, its text.

    Words are runs of letters; what is no letter, a text's ends included, counts as a blank.
    """
    codes, starts = code_points(texts)
    letters = lower_letters(codes)
    at = np.flatnonzero(letters)
    wide = letters.astype(np.uint64)
    packed = (wide[at - 1] << np.uint64(42)) | (wide[at] << np.uint64(21)) | wide[at + 1]
    buckets = (mix64(packed) % np.uint64(BUCKETS)).astype(np.int64)
    first = letters[at - 1] == 0
    word = first.cumsum() - 1
    owner = np.searchsorted(starts, at[first], side="right") - 1
    return buckets, word, owner


@dataclass(frozen=True)
class LanguageModel:
    """``log_likelihood[bucket, language]`` for the languages in alphabetical order."""

    languages: list[str]
    log_likelihood: np.ndarray


def fit_languages(docs: DataFrame, *, smoothing: float = 0.5) -> LanguageModel:
    """Counts the trigrams of all rows of ``docs`` that have a lang; their shares are the likelihoods.

    Tasks count in arrays of BUCKETS numbers and Spark adds them up, so a language with most
    of the rows is no hot group. What reaches the driver has a fixed size: BUCKETS numbers
    for each of at most MAX_LANGUAGES languages.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, np.ndarray] = {}
        for piece in chunks(batches):
            for lang, rows in piece.groupby("lang", sort=False):
                buckets, _, _ = trigrams(rows["text"].tolist())
                seen[lang] = seen.get(lang, 0) + np.bincount(buckets, minlength=BUCKETS)
        for lang, counts in seen.items():
            at = np.flatnonzero(counts)
            yield pd.DataFrame({"lang": lang, "bucket": at.astype("int32"), "n": counts[at]})
            yield pd.DataFrame({"lang": [lang], "bucket": np.array([-1], "int32"), "n": [0]})  # a language without letters is one too

    known = docs.select("text", F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull())
    counts = known.mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    languages = sorted(row[0] for row in counts.where("bucket = -1").limit(MAX_LANGUAGES + 1).select("lang").collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    table = np.full((BUCKETS, len(languages)), smoothing)
    place = {lang: i for i, lang in enumerate(languages)}
    found = counts.where("bucket >= 0").toPandas()
    table[found["bucket"].to_numpy(), found["lang"].map(place).to_numpy(dtype=np.int64)] += found["n"].to_numpy()
    return LanguageModel(languages, np.log(table / table.sum(axis=0)).astype(np.float32))


def mixture(likelihood: np.ndarray, owner: np.ndarray, n_texts: int, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """EM for the shares of the ``allowed`` languages in each text.

    ``likelihood[word, language]`` is scaled to a maximum of 1 for each word; ``owner`` is the text of each
    word, ascending. Returns shares[text, language] and the log likelihood of each text.
    """
    edges = np.flatnonzero(np.diff(owner, prepend=-1))
    texts = owner[edges]
    size = np.diff(np.append(edges, len(owner)))
    shares = np.zeros((n_texts, likelihood.shape[1]))
    shares[texts] = allowed[texts] / np.maximum(allowed[texts].sum(axis=1, keepdims=True), 1)
    for _ in range(rounds):
        joint = likelihood * shares[owner]
        joint /= np.maximum(joint.sum(axis=1, keepdims=True), 1e-30)
        shares[texts] = np.add.reduceat(joint, edges, axis=0) / size[:, None]
    fit = np.zeros(n_texts)
    fit[texts] = np.add.reduceat(np.log(np.maximum((likelihood * shares[owner]).sum(axis=1), 1e-30)), edges)
    return shares, fit


def infer(model: LanguageModel, texts: list[str], *, rounds: int = 8, penalty: float = 1.0) -> np.ndarray:
    """Shares of languages for each text: zero outside its language set, and all zero without a letter.

    EM over all languages orders them by share. Sets grow in this order while a language
    raises the log likelihood by more than ``penalty * log(words)``, half of what two
    parameters cost by the Bayesian information criterion.
    """
    buckets, word, owner = trigrams(texts)
    n, languages = len(texts), len(model.languages)
    best = np.zeros((n, languages))
    if not len(owner) or not languages:
        return best
    edges = np.flatnonzero(np.diff(word, prepend=-1))
    scores = np.add.reduceat(model.log_likelihood[buckets], edges, axis=0).astype(np.float64)
    likelihood = np.exp(scores - scores.max(axis=1, keepdims=True))
    every, _ = mixture(likelihood, owner, n, np.ones((n, languages), bool), rounds)
    order = np.argsort(-every, axis=1, kind="stable")
    words = np.bincount(owner, minlength=n)
    rank = np.argsort(order, axis=1, kind="stable")
    growing = words > 0
    fit = np.full(n, -np.inf)
    for k in range(1, languages + 1):
        mine = growing[owner]
        if not mine.any():
            break
        shares, now = mixture(likelihood[mine], owner[mine], n, rank < k, rounds if k > 1 else 0)
        better = growing & (now - fit > (penalty * np.log(np.maximum(words, 2)) if k > 1 else -np.inf))
        best[better] = shares[better]
        fit[better] = now[better]
        growing = better
    return best


def identify(docs: DataFrame, model: LanguageModel, *, min_share: float = 0.0) -> DataFrame:
    """doc_id, lang_pred, score (the share of lang_pred) and ``mixture`` (language to share) for every row of ``docs``.

    Reads doc_id and text only. The model has a fixed size (see :func:`fit_languages`) and
    travels with the tasks' code. Null or empty text, or a text without a letter: ``und``
    with score 0 and an empty mixture. Ties go to the alphabetically first language. Rows
    are independent: repeated rows get equal results; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = shared.value
        names = np.array([*held.languages, UNDETERMINED], dtype=object)
        for piece in chunks(batches):
            shares = infer(held, piece["text"].tolist())
            sure = shares.sum(axis=1) > 0
            top = np.where(sure, shares.argmax(axis=1) if shares.shape[1] else 0, len(held.languages))
            yield pd.DataFrame(
                {
                    "doc_id": piece["doc_id"],
                    "lang_pred": names[top],
                    "score": np.where(sure, shares.max(axis=1, initial=0), 0.0).clip(0, 1),
                    "mixture": [{held.languages[j]: float(row[j]) for j in np.flatnonzero(row > min_share)} for row in shares],
                }
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInPandas(run, "doc_id long, lang_pred string, score double, mixture map<string,double>")


def remainder(doc_id: Column, modulus: int) -> Column:
    """CRC-32 of the decimal doc_id, modulo ``modulus``: the folds of the contracts. A null doc_id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus
