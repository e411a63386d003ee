"""Template search with bounds against aligning everything."""

from __future__ import annotations

import numpy as np
import pytest

from assaylane.operators import structure, templates

AMINO = "ACDEFGHIKLMNPQRSTVWY"


def words(n, seed, lengths=(7, 9)):
    draw = np.random.default_rng(seed)
    stems = ["".join(draw.choice(list(AMINO), 9)) for _ in range(12)]
    out = []
    for _ in range(n):
        w = list(draw.choice(stems)[: draw.choice(lengths)])
        for _ in range(draw.integers(0, 5)):
            w[draw.integers(len(w))] = draw.choice(list(AMINO))
        out.append("".join(w))
    return out


def plain(query, rows, k):
    """Rows (template, name, order, rank of its allele) of one length, aligned one by one."""
    table = structure.substitution()
    scored = [(-structure.align(query, t, score=table, gap_open=-10.0, gap_extend=-0.5)[0], place, order, name, t) for t, name, order, place in rows if len(t) == len(query)]
    return [(query, t, name, order, -s, i + 1) for i, (s, _, order, name, t) in enumerate(sorted(scored)[:k])]


@pytest.mark.parametrize("block", [256, 3])
def test_search_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(templates, "BLOCK", block)
    known, asked = words(120, 1), [*words(12, 2), "WWWWWWWWW", "ACDEFGHIK", "QQ"]
    rows = [(t, f"t{i}", i % 50) for i, t in enumerate(known)]
    df = spark.createDataFrame([*rows, (None, "null", 0), ("", "empty", 0)], "s string, name string, no int").repartition(3)
    queries = spark.createDataFrame([(q,) for q in [*asked, asked[0], None, ""]], "s string")
    found = templates.top_templates(queries, df, "s", "name", "no", k=4)
    expected = [r for q in dict.fromkeys(asked) for r in plain(q, [(*r, 0) for r in rows], 4)]
    assert sorted(map(tuple, found.collect())) == sorted(expected)
    counts = templates.opened_share(queries, df, "s", "name", "no", k=4).first()
    print("pairs of one length:", counts.n_pairs, "in blocks that must be opened:", counts.n_open)
    assert counts.n_open <= counts.n_pairs


def test_lists_of_alleles_and_omissions(spark):
    known = words(60, 3)
    rows = [(t, f"t{i}", i, "ABC"[i % 3]) for i, t in enumerate(known)]
    df = spark.createDataFrame(rows, "s string, name string, no int, allele string")
    query, gone = known[5], [f"t{i}" for i in range(0, 60, 7)]
    queries = spark.createDataFrame([(query, ["C", "A"], gone)], "s string, list array<string>, without array<string>")
    found = templates.top_templates(queries, df, "s", "name", "no", k=50, alleles="list", allele="allele", omit="without", omit_self=True)
    allowed = [(t, n, o, "CA".index(a)) for t, n, o, a in rows if a in "CA" and n not in gone and t != query]
    assert sorted(map(tuple, found.collect())) == sorted(plain(query, allowed, 50))
    assert templates.top_templates(queries, df.where("false"), "s", "name", "no").collect() == []


def test_bounds_hold():
    draw = np.random.default_rng(5)
    table = structure.substitution()
    for _ in range(60):
        block = words(4, int(draw.integers(1 << 30)), (9,))
        query = words(1, int(draw.integers(1 << 30)), (9,))[0]
        letters = np.zeros((9, 128), bool)
        for t in block:
            letters[np.arange(9), [ord(c) for c in t]] = True
        scores = [structure.align(query, t, score=table, gap_open=-10.0, gap_extend=-0.5)[0] for t in block]
        assert templates.bounds(np.array([[ord(c) for c in query]]), letters)[0] >= max(scores)
        found, _ = templates.pair_scores(query, block, min(scores))
        assert found.tolist() == scores
        high, aligned = templates.pair_scores(query, block, max(scores))
        assert [s for s in high if s >= max(scores)] == [s for s in scores if s >= max(scores)]


def test_ranked_alleles(spark):
    rows = [("A", "A1", "ACDEFGH"), ("A", "A2", "ACDEFGHK"), ("A", "A3", "WWWW"), ("B", "B1", "ACDEFGH"), (None, "x", "ACD"), ("A", None, "ACD"), ("A", "A4", None)]
    df = spark.createDataFrame(rows, "gene string, name string, s string")
    found = templates.ranked_alleles(df, df.where("name <> 'A3'"), "gene", "name", "s")
    table = structure.substitution()
    score = lambda a, b: structure.align(a, b, score=table, gap_open=-10.0, gap_extend=-10.0)[0]
    sequences = {n: s for _, n, s in rows}
    got = {(r.name, r.reference): (r.score, r["rank"]) for r in found.collect()}
    assert set(got) == {(a, b) for a in ("A1", "A2", "A3") for b in ("A1", "A2")} | {("B1", "B1")}
    assert all(s == score(sequences[a], sequences[b]) for (a, b), (s, _) in got.items())
    assert got["A1", "A1"][1] == 1 and got["A2", "A2"][1] == 1


def test_hamming_pairs_of_document_words(spark, sf_dir):
    from assaylane.operators import joins
    from assaylane.plans.sequence import document_words

    sample = document_words(spark, sf_dir).where("xxhash64(s) % 8 = 0")
    found = {tuple(r) for r in joins.hamming_pairs(sample, "s", distance=2).collect()}
    known = sorted(r.s for r in sample.collect())
    by_length = {}
    for w in known:
        by_length.setdefault(len(w), []).append(w)
    expected = set()
    for group in by_length.values():
        codes = np.array([[ord(c) for c in w] for w in group])
        for i, w in enumerate(group):
            apart = (codes[i + 1 :] != codes[i]).sum(axis=1)
            expected |= {(w, group[i + 1 + j], int(apart[j])) for j in np.flatnonzero(apart <= 2)}
    assert found == expected and expected


@pytest.mark.parametrize("tile", [1000, 7])
def test_search_in_tiles(spark, monkeypatch, tile):
    """Queries and templates that are dealt into many tiles, most alignments with gaps, against brute force."""
    for name in ("TILE", "CHUNK", "GAP_TILE", "GAP_CHUNK", "COLUMNS", "ROWS"):
        monkeypatch.setattr(templates, name, tile)
    monkeypatch.setattr(templates, "ALIGNED", 5)
    known = [*words(30, 8, (9,)), *[w[i:] + w[:i] for i in (1, 2) for w in words(15, 8, (9,))], "A\u00c4CDEFGHI"]
    rows = [(t, f"t{i}", i % 5) for i, t in enumerate(known)]
    df = spark.createDataFrame(rows, "s string, name string, no int").repartition(3)
    found = templates.top_templates(df.where("no < 3"), df, "s", "name", "no", k=6)
    expected = [r for q in dict.fromkeys(t for t, _, no in rows if no < 3) for r in plain(q, [(*r, 0) for r in rows], 6)]
    assert sorted(map(tuple, found.collect())) == sorted(expected)


def test_tile_bounds_hold():
    table, q, t = structure.substitution(), words(40, 11, (9,)), words(40, 12, (9,))
    most = templates.gapped_bounds(templates._class_scores(), templates._classes(q), templates._classes(t))
    for a, b, bound in zip(q, t, most, strict=True):
        straight = sum(table[x, y] for x, y in zip(a, b, strict=True))
        score = structure.align(a, b, score=table, gap_open=-10.0, gap_extend=-0.5)[0]
        assert score == straight or score <= bound
