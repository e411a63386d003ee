"""Best templates of short sequences by alignment score, without aligning all pairs; and alleles ranked by similarity.

Queries and templates of one length (and allele) meet in tiles of bounded size. A tile's scores without gaps are one product of
matrices. A gap can only help where the best letters of a query and a template, less two openings of a gap, reach the query's
k-th score without gaps: only these pairs are aligned. The result is exact.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import cut
from .structure import BLOSUM_ORDER, align_many, substitution

GAP_OPEN, GAP_EXTEND = -10.0, -0.5
#: Templates in a block of :func:`template_blocks`.
BLOCK = 256
#: Templates and queries of a tile, and of the parts of it that are scored at once.
TILE, CHUNK = 32768, 4096
#: The same where gaps are looked for, which fewer queries need and which takes longer.
GAP_TILE, GAP_CHUNK = 4096, 256
COLUMNS, ROWS = 4096, 1024
#: Pairs that are aligned at once.
ALIGNED = 1 << 16


def _matrix() -> np.ndarray:
    """Scores by code points below 128; letters outside the matrix score 0 with all."""
    table = np.zeros((128, 128))
    for (x, y), value in substitution().items():
        table[ord(x), ord(y)] = value
    return table


def _codes(texts: list[str]) -> np.ndarray:
    return np.minimum(np.array([[ord(c) for c in t.upper()] for t in texts], np.int64).reshape(len(texts), -1), 127)


def bounds(queries: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """The most that each query (codes, a row each) can score with any sequence whose letters at each place are among ``letters`` (a place by 128 flags)."""
    table = _matrix()
    at_place = np.stack([table[:, there].max(axis=1) for there in letters])  # by place and letter of the query
    straight = at_place[np.arange(len(letters)), queries].sum(axis=1)
    best = table[:, letters.any(axis=0)].max(axis=1)[queries]
    return np.maximum(straight, np.maximum(best, 0).sum(axis=1) - np.maximum(best.min(axis=1), 0) + 2 * GAP_OPEN)


def flags(letters: Iterable[Iterable[int]]) -> np.ndarray:
    """Lists of codes as a row of 128 flags each."""
    rows = list(letters)
    out = np.zeros((len(rows), 128), bool)
    for i, there in enumerate(rows):
        out[i, there] = True
    return out


def pair_scores(query: str, others: list[str], least: float, codes: np.ndarray | None = None) -> tuple[np.ndarray, int]:
    """Alignment scores of a query with sequences of its length, -inf for some that are under ``least``; and how many had to be aligned."""
    table, q, t = _matrix(), _codes([query])[0], _codes(others) if codes is None else codes
    mine = table[q]
    straight = mine[np.arange(len(q)), t].sum(axis=1)
    scores = np.where(straight >= least, straight, -np.inf)
    most = np.maximum(mine.max(axis=1), 0)  # with any letter: where that is too little, no gap can help
    if most.sum() - most.min() + 2 * GAP_OPEN < least:
        return scores, 0
    best = mine[:, t].max(axis=2)  # of the query's places by templates
    gapped = np.maximum(best, 0).sum(axis=0) - np.maximum(best.min(axis=0), 0) + 2 * GAP_OPEN
    aligned = np.flatnonzero((gapped >= least) & (gapped > straight))
    if len(aligned):
        scores[aligned] = align_many([query] * len(aligned), [others[i] for i in aligned], gap_open=GAP_OPEN, gap_extend=GAP_EXTEND)
    return scores, len(aligned)


def template_blocks(templates: DataFrame, sequence: str, name: str, order: str, allele: str | None = None) -> DataFrame:
    """Blocks of templates: group, n (length), block, letters (a bit mask for each place) and members in their order.

    Sorted ranges of sequences are blocks, so like beginnings stand together. Missing and empty sequences are no templates.
    """
    rows = templates.where(F.length(sequence) > 0).select(F.col(allele).alias("group") if allele else F.lit("").alias("group"), F.length(sequence).alias("n"), F.upper(sequence).alias("s"), F.col(sequence).alias("sequence"), F.col(name).alias("name"), F.col(order).alias("order"))
    ranged = rows.repartitionByRange("group", "n", "s").sortWithinPartitions("group", "n", "s").withColumn("_at", F.monotonically_increasing_id())
    numbered = cut(ranged).withColumn("block", F.floor(F.col("_at") / BLOCK))
    place = lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.least(F.ascii(F.substr(s, i, F.lit(1))), F.lit(127)))
    members = F.array_sort(F.collect_list(F.struct("order", "name", "sequence"))).alias("members")
    letters = F.collect_set(F.struct(F.lit(0).alias("z"), place(F.col("s")).alias("codes"))).alias("seen")
    gathered = numbered.groupBy("group", "n", "block").agg(members, letters)
    found = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.array_distinct(F.transform("seen", lambda x: F.get(x["codes"], i))))
    return gathered.select("group", "n", "block", "members", found.alias("letters"))


def _classes(texts: list[str]) -> np.ndarray:
    """Texts of one length as rows of places in the matrix, 20 for letters outside it."""
    look = np.full(513, len(BLOSUM_ORDER))
    for c in range(512):
        if chr(c).upper() in BLOSUM_ORDER:
            look[c] = BLOSUM_ORDER.index(chr(c).upper())
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).reshape(len(texts), -1)
    return look[np.minimum(points, 512)]


def _class_scores() -> np.ndarray:
    """Scores by classes of letters."""
    size = len(BLOSUM_ORDER)
    table = np.zeros((size + 1, size + 1), np.float32)
    for (x, y), value in substitution().items():
        table[BLOSUM_ORDER.index(x), BLOSUM_ORDER.index(y)] = value
    return table


def _columns_of(values: Iterable[str]) -> dict[str, list[int]]:
    found: dict[str, list[int]] = {}
    for i, v in enumerate(values):
        found.setdefault(v, []).append(i)
    return found


@F.pandas_udf(T.DoubleType())
def gapped_most(query: pd.Series) -> pd.Series:
    """The most that an alignment with gaps can score between a query and any sequence of its length."""
    table = np.maximum(_class_scores().max(axis=1), 0)
    most = [table[_classes([q])[0]] for q in query]
    return pd.Series([float(m.sum() - m.min() + 2 * GAP_OPEN) for m in most], dtype=float)


def gapped_bounds(table: np.ndarray, q: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The most that pairs of sequences of one length can score with gaps.

    Where paired places lie at most d apart, and some do, d places at least of either side are in gaps.
    """
    best = np.maximum(table[q, t], 0)
    most = np.full(len(q), -np.inf)
    for d in range(1, max(q.shape[1], 2)):
        best[:, d:] = np.maximum(best[:, d:], table[q[:, d:], t[:, :-d]])
        best[:, :-d] = np.maximum(best[:, :-d], table[q[:, :-d], t[:, d:]])
        most = np.maximum(most, best.sum(axis=1) - d * best.min(axis=1) + 2 * GAP_OPEN + 2 * (d - 1) * GAP_EXTEND)
    return most


def score_tile(asked: pd.DataFrame, members: pd.DataFrame, k: int, *, omit_self: bool, gaps: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``asked``, rows of ``members`` and scores: of each asked row at least the k best members, the first of equals.

    ``asked`` has query, omit and least, ``members`` sequence and name, all of one length. Scores under ``least`` are left out. Without ``gaps`` only
    places that face each other count.
    """
    table, q, t = _class_scores(), _classes(list(asked["query"])), _classes(list(members["sequence"]))
    n, letters = q.shape[1], len(BLOSUM_ORDER)
    one_hot = np.eye(letters + 1, letters, dtype=np.float32)
    spelled = np.array([*BLOSUM_ORDER, "X"])
    low = asked["least"].to_numpy(np.float32).copy()
    named, equal = _columns_of(members["name"]), _columns_of(members["sequence"])
    gone = [[*(c for name in omit for c in named.get(name, ())), *(equal.get(query, ()) if omit_self else ())] for query, omit in zip(asked["query"], asked["omit"], strict=True)]
    out = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.float32))]
    for first in range(0, len(t), COLUMNS):
        there = t[first : first + COLUMNS]
        faced = one_hot[there].reshape(len(there), -1).T
        best = np.maximum(np.stack([table[:, there[:, j]] for j in range(n)]).max(axis=0), 0) if gaps else None
        for start in range(0, len(q), ROWS):
            mine = q[start : start + ROWS]
            scores = table[mine][:, :, :letters].reshape(len(mine), -1) @ faced
            least = low[start : start + ROWS]
            if gaps:
                counts = (mine[:, :, None] == np.arange(letters + 1)).sum(axis=1).astype(np.float32)
                bound = counts @ best + np.float32(2 * GAP_OPEN)
                r, c = np.nonzero((bound >= least[:, None]) & (bound > scores))
                for at in range(0, len(r), ALIGNED):
                    i, j = r[at : at + ALIGNED], c[at : at + ALIGNED]
                    most = gapped_bounds(table, mine[i], there[j])
                    likely = (most >= least[i]) & (most > scores[i, j])
                    i, j = i[likely], j[likely]
                    if len(i):
                        scores[i, j] = align_many(["".join(x) for x in spelled[mine[i]]], ["".join(x) for x in spelled[there[j]]], gap_open=GAP_OPEN, gap_extend=GAP_EXTEND)
            for i in range(len(mine)):
                for column in gone[start + i]:
                    if first <= column < first + COLUMNS:
                        scores[i, column - first] = -np.inf
            open_rows = np.flatnonzero(np.isneginf(least))
            if len(open_rows) and scores.shape[1] > k:
                low[start + open_rows] = np.partition(scores[open_rows], scores.shape[1] - k, axis=1)[:, -k]
            r, c = np.nonzero((scores >= low[start : start + ROWS, None]) & (scores > -np.inf))
            out.append((r + start, c + first, scores[r, c]))
    rows, columns, found = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((columns, -found, rows))
    rows, columns, found = rows[order], columns[order], found[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[place < k], columns[place < k], found[place < k]


def top_templates(queries: DataFrame, templates: DataFrame, sequence: str, name: str, order: str, *, k: int = 10, omit_self: bool = False, alleles: str | None = None, allele: str | None = None, omit: str | None = None) -> DataFrame:
    """The k best templates of each query of its own length: query, template, template_name, score, rank.

    By global alignment score (BLOSUM62, gaps -10 and -0.5), ties by the place of the template's allele in the query's list, then by the
    templates' ``order``. With ``alleles`` (a query's ranked list) only templates of these ``allele``s count. ``omit`` names a
    query column with an array of template names that don't count for it, ``omit_self`` leaves out equal sequences. Queries that are repeated
    (with one list) count once; queries without a template, missing and empty ones have no rows.
    """
    kept = [F.col(sequence).alias("query"), F.col(alleles).alias("list") if alleles else F.array(F.lit("")).alias("list"), F.col(omit).alias("omit") if omit else F.array().cast("array<string>").alias("omit")]
    asked = cut(queries.where(F.length(sequence) > 0).select(*kept).distinct().withColumn("id", F.xxhash64("query", "list", "omit")))
    known = cut(templates.where(F.length(sequence) > 0).select(F.col(allele).alias("group") if allele else F.lit("").alias("group"), F.length(sequence).alias("n"), F.col(sequence).alias("sequence"), F.col(name).alias("name"), F.col(order).alias("order")))
    kind = templates.schema[order].dataType.simpleString()
    unit = ["group", "n", "tile", "chunk"]

    def scored(chosen: DataFrame, *, gaps: bool) -> DataFrame:
        """Candidates of ``chosen`` (id, query, omit, least, group, n, place): at least the k best of each tile."""

        def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            members = right.sort_values(["order", "name", "sequence"], na_position="first", ignore_index=True)
            r, c, scores = score_tile(left, members, k, omit_self=omit_self, gaps=gaps)
            taken = members.iloc[c][["sequence", "name", "order"]].set_axis(["template", "template_name", "template_order"], axis=1).reset_index(drop=True)
            return taken.assign(id=left["id"].to_numpy()[r], place=left["place"].to_numpy()[r], score=scores.astype(float))[["id", "place", "template", "template_name", "template_order", "score"]]

        tile, chunk = (GAP_TILE, GAP_CHUNK) if gaps else (TILE, CHUNK)
        tiles = known.groupBy("group", "n").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
        chunks = chosen.groupBy("group", "n").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks"))
        sizes = cut(tiles.join(chunks, ["group", "n"]))
        units = min(int(sizes.agg(F.sum(F.col("tiles").cast("long") * F.col("chunks"))).first()[0] or 1), 4096)
        every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        left = chosen.join(sizes, ["group", "n"]).withColumn("chunk", F.pmod(F.xxhash64("id", "place"), F.col("chunks")).cast("int")).withColumn("tile", every("tiles")).drop("tiles", "chunks")
        right = known.join(sizes, ["group", "n"]).withColumn("tile", F.pmod(F.xxhash64("sequence", "name", "order"), F.col("tiles")).cast("int")).withColumn("chunk", every("chunks")).drop("tiles", "chunks")
        met = left.repartition(units, *unit).groupBy(*unit).cogroup(right.repartition(units, *unit).groupBy(*unit))
        return met.applyInPandas(run, f"id long, place int, template string, template_name string, template_order {kind}, score double")

    best_first = Window.partitionBy("id").orderBy(F.desc("score"), "place", "template_order", "template_name", "template")
    listed = asked.select("id", "query", "omit", F.length("query").alias("n"), F.posexplode("list").alias("place", "group"))
    straight = cut(scored(listed.withColumn("least", F.lit(float("-inf"))), gaps=False).withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k))
    reached = straight.where(F.col("rank") == k).select("id", F.col("score").alias("least"))
    open_queries = cut(asked.select("id", "query").join(reached, "id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf")))).where(gapped_most("query") >= F.col("least")).select("id", "least"))
    gapped = scored(listed.join(open_queries, "id"), gaps=True).withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)
    found = straight.join(open_queries, "id", "left_anti").unionByName(gapped)
    return found.join(asked.select("id", "query"), "id").select("query", "template", "template_name", "template_order", "score", "rank")


def opened_share(queries: DataFrame, templates: DataFrame, sequence: str, name: str, order: str, *, k: int = 10) -> DataFrame:
    """n_pairs and n_open: pairs of a query and a template of its length, and those in blocks whose bound reaches the query's final k-th score."""
    asked = queries.where(F.length(sequence) > 0).select(F.col(sequence).alias("query")).distinct()
    last = top_templates(queries, templates, sequence, name, order, k=k).where(F.col("rank") == k).select("query", F.col("score").alias("least"))
    blocks = template_blocks(templates, sequence, name, order).select("n", F.size("members").alias("size"), "letters")

    @F.pandas_udf("double")
    def most(query: pd.Series, letters: pd.Series) -> pd.Series:
        return pd.Series([float(bounds(_codes([q]), flags(there))[0]) for q, there in zip(query, letters, strict=True)], dtype=float)

    met = asked.join(blocks, F.length("query") == F.col("n")).join(last, "query", "left").withColumn("bound", most("query", "letters"))
    return met.agg(F.sum("size").alias("n_pairs"), F.sum(F.when(F.col("least").isNull() | (F.col("bound") >= F.col("least")), F.col("size")).otherwise(0)).alias("n_open"))


def ranked_alleles(alleles: DataFrame, references: DataFrame, gene: str, name: str, sequence: str, *, gap: float = -10.0) -> DataFrame:
    """gene, name, reference, score and rank: for each allele the ``references`` of its gene by global alignment (BLOSUM62, every gap costs ``gap``).

    References are the listed few, so alleles meet them in blocks of a gene; an allele meets itself too. Ties by the reference's name. Rows without a gene,
    name or sequence take no part.
    """
    known = lambda df: df.where(F.col(gene).isNotNull() & F.col(name).isNotNull() & (F.length(sequence) > 0))

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.empty(len(a))
        sizes = pd.DataFrame({"n": a.str.len(), "m": b.str.len()}).reset_index(drop=True)
        for _, rows in sizes.groupby(["n", "m"]):
            out[rows.index] = align_many(a.iloc[rows.index].tolist(), b.iloc[rows.index].tolist(), gap_open=gap, gap_extend=gap)
        return pd.Series(out)

    right = known(references).select(F.col(gene).alias("_gene"), F.col(name).alias("reference"), F.col(sequence).alias("_other"))
    met = known(alleles).select(F.col(gene).alias("gene"), F.col(name).alias("name"), F.col(sequence).alias("_own")).join(right, F.col("gene") == F.col("_gene"))
    order = Window.partitionBy("gene", "name").orderBy(F.desc("score"), "reference")
    scored = met.withColumn("score", score("_own", "_other")).withColumn("rank", F.row_number().over(order))
    return scored.select("gene", "name", "reference", "score", "rank")


__all__ = ["BLOSUM_ORDER", "bounds", "opened_share", "pair_scores", "ranked_alleles", "score_tile", "template_blocks", "top_templates"]
