"""Quality rules by weak supervision: rules vote or abstain, EM weighs them."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import cut
from .common import WORD_PATTERN, words

GOOD, BAD = 1, -1


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the statistics the rules read, all from the whole text (null: none).

    n_words; word_chars: code points in words; n_symbols: characters of ``#*$%&|<>``;
    n_dup_lines: lines that have a word and equal an earlier line; n_repeat_words: words
    in three-word windows found twice or more in the text; n_lines: lines that have a
    word; n_plain: words of letters, apostrophes and hyphens before one mark at most; n_upper_words:
    words of two or more code points with a capital and no small letter; n_digits;
    n_bangs: pairs of exclamation marks.

    Each projection reads arrays that the one below has made, so nothing is split twice.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    split = docs.withColumns(
        {
            "_words": words(F.col(text)),
            "_lines": F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD_PATTERN)),
        }
    )
    hashed = split.withColumn(
        "_grams",
        F.slice(
            F.transform("_words", lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2))),
            1,
            F.greatest(F.size("_words") - 2, F.lit(0)),
        ),
    ).withColumn("_repeats", F.size("_grams") > F.size(F.array_distinct("_grams")))
    # grams sorted with their places; those whose neighbour is equal occur twice or more
    placed = hashed.withColumn(
        "_placed",
        F.when(F.col("_repeats"), F.sort_array(F.transform("_grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))),
    )
    found = placed.withColumn(
        "_found",
        F.when(
            F.col("_repeats"),
            F.sort_array(
                F.transform(
                    F.filter(
                        "_placed",
                        lambda x, i: x["g"].eqNullSafe(F.get("_placed", i - 1)["g"]) | x["g"].eqNullSafe(F.get("_placed", i + 1)["g"]),
                    ),
                    lambda x: x["i"],
                )
            ),
        ),
    )
    covered = F.aggregate(
        F.transform("_found", lambda at, i: F.least(F.lit(3), F.coalesce(F.get("_found", i + 1), at + 3) - at)),
        F.lit(0).cast("bigint"),
        lambda done, n: done + n,
    )
    count = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("bigint")
    return found.withColumns(
        {
            "n_words": F.size("_words").cast("bigint"),
            "word_chars": F.length(F.array_join("_words", "")).cast("bigint"),
            "n_symbols": count(r"[#*$%&|<>]"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
            "n_repeat_words": F.when(F.col("_repeats"), covered).otherwise(0).cast("bigint"),
            "n_lines": F.size("_lines").cast("bigint"),
            "n_plain": F.size(F.filter("_words", lambda w: w.rlike(r"^[\p{L}\p{M}'’-]+[.,;:?!]?$"))).cast("bigint"),
            "n_upper_words": F.size(F.filter("_words", lambda w: (F.upper(w) == w) & (F.lower(w) != w) & (F.length(w) > 1))).cast("bigint"),
            "n_digits": count(r"[0-9]"),
            "n_bangs": count(r"!!"),
        }
    ).drop("_words", "_lines", "_grams", "_repeats", "_placed", "_found")


@dataclass(frozen=True)
class Rule:
    """Votes BAD where ``bad`` holds, else GOOD where ``good`` holds, else abstains."""

    name: str
    bad: Column
    good: Column

    def vote(self) -> Column:
        return F.when(self.bad, BAD).when(self.good, GOOD).otherwise(0).cast("tinyint").alias(self.name)


def default_rules() -> list[Rule]:
    """The rules over :func:`text_statistics`; ratios are written as products, so no rule divides by zero.

    A rule that looks for one kind of junk says nothing where it finds none, so only the
    last, which looks for plain prose, votes GOOD.
    """
    n, c, never = F.col("n_words"), F.col, F.lit(False)
    return [
        Rule("v_symbols", 10 * c("n_symbols") > 3 * n, never),
        Rule("v_dup_lines", 10 * c("n_dup_lines") > 3 * c("n_lines"), never),
        Rule("v_repeats", 10 * c("n_repeat_words") > 3 * n, never),
        Rule("v_word_length", (c("word_chars") < 2 * n) | (c("word_chars") > 14 * n), never),
        Rule("v_capitals", 10 * c("n_upper_words") > 4 * n, never),
        Rule("v_digits", 4 * c("n_digits") > c("word_chars"), never),
        Rule("v_shouting", 5 * c("n_bangs") > n, never),
        Rule("v_prose", never, 10 * c("n_plain") >= 8 * n),
    ]


@dataclass(frozen=True)
class LabelModel:
    """Each rule's accuracy when it votes, as EM has found it, and the share of good documents taken."""

    share: float
    accuracy: dict[str, float]

    def posterior(self) -> Column:
        """The probability that a document is good, given the votes in its row."""
        odds = F.lit(math.log(self.share / (1 - self.share)))
        for name, a in self.accuracy.items():
            odds = odds + F.col(name).cast("double") * F.lit(math.log(a / (1 - a)))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def fit_label_model(votes: DataFrame, names: list[str], *, share: float = 0.5, start: float = 0.8, floor: float = 0.6, ceiling: float = 0.99, rounds: int = 50) -> LabelModel:
    """Expectation-maximisation over the votes of all documents.

    Given its quality a document's votes are independent; a rule that votes is right with
    its accuracy, and that it abstains says nothing. ``share``, the class balance, is given
    and not estimated: kinds of junk hardly overlap, so an estimated balance would let the
    many good documents outvote every rule that fires alone. ``floor`` says that rules
    are better than chance, which tells the two classes apart. Only the counts of vote
    patterns reach the driver: at most ``3 ** rules`` rows at any input size. An empty
    table leaves the starting values.
    """
    patterns = [(tuple(row[n] for n in names), row["n_docs"]) for row in votes.groupBy(*names).agg(F.count(F.lit(1)).alias("n_docs")).collect()]
    accuracy = [start] * len(names)
    for _ in range(rounds if patterns else 0):
        right, cast = [0.0] * len(names), [0.0] * len(names)
        for pattern, n in patterns:
            odds = math.log(share / (1 - share)) + sum(v * math.log(a / (1 - a)) for v, a in zip(pattern, accuracy, strict=True))
            good = 1 / (1 + math.exp(-odds))
            for j, v in enumerate(pattern):
                if v:
                    cast[j] += n
                    right[j] += n * (good if v == GOOD else 1 - good)
        accuracy = [min(max(r / c, floor), ceiling) if c else a for r, c, a in zip(right, cast, accuracy, strict=True)]
    return LabelModel(share, dict(zip(names, accuracy, strict=True)))


def _voted(statistics: DataFrame, rules: list[Rule], min_words: int) -> DataFrame:
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return statistics.withColumn("base_failed", failed).withColumns({r.name: r.vote() for r in rules})


def judge(statistics: DataFrame, rules: list[Rule] | None = None, *, threshold: float = 0.5, min_words: int = 50) -> DataFrame:
    """``statistics`` with base_failed, the votes, quality (posterior probability) and kept.

    base_failed: fewer than ``min_words`` words, or over half the words in repeated windows.
    The label model is fitted on all rows that pass the base. ``statistics`` is read twice, so it should be written.
    """
    rules = default_rules() if rules is None else rules
    names = [r.name for r in rules]
    voted = _voted(statistics, rules, min_words)
    model = fit_label_model(voted.where(~F.col("base_failed")).select(*names), names)
    return voted.withColumn("quality", model.posterior()).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_plain", "n_upper_words", "n_digits", "n_bangs"]


def quality_verdicts(docs: DataFrame, **options) -> DataFrame:
    """doc_id, the statistics and the verdict of every document.

    The statistics are written once to the shared folder (some ten numbers a document), then
    read twice: to fit the label model and to judge.

    Null or empty text: no words, so base_failed. Repeated rows are judged alike and all
    returned. Empty table: empty result. Only doc_id and text are read, so other columns
    can have any name.
    """
    base = cut(text_statistics(docs.select("doc_id", "text")).select("doc_id", *STATISTICS))
    return judge(base, **options)


def keep_quality(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with its columns.

    Rows and statistics are written once to the shared folder and read twice, for the model and
    for the verdict: a filter over unwritten statistics would be pushed below them and compute them anew, and
    joining verdicts to documents would shuffle all texts.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    measured = cut(text_statistics(docs.select(row, F.col("text"))).select("_row", *STATISTICS))
    kept = judge(measured, **options).where("kept")
    return kept.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
