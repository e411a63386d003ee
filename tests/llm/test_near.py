"""Near-duplicates against brute-force Jaccard similarity."""

from __future__ import annotations

import random

import corpus_pipeline
from assaylane.llm import near


def brute(texts):
    sets = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {i: find(i) for i in texts}, pairs


def edited(rng, words, share):
    """The words with single ones replaced, so that about ``share`` of the five-word shingles of both stay common."""
    w = words.copy()
    for at in rng.sample(range(2, len(w) - 2), round(len(w) * (1 - share) / (1 + share) / 5)):
        w[at] = f"new{rng.randrange(10**9)}"
    return w


def test_stage_finds_pairs_of_similarity_four_fifths(spark, make):
    rng = random.Random(8)
    rows = []
    for i in range(150):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(60, 400))]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(edited(rng, words, rng.uniform(0.7, 0.95))))]
    expected, pairs = brute(dict(rows))
    assert 60 < len(pairs) < 140
    left = {r.doc_id for r in corpus_pipeline.simhash_dedup(spark, make(*rows), "").collect()}
    assert left >= set(expected.values())  # nothing below the threshold goes
    assert len(left - set(expected.values())) <= 0.01 * len(pairs)


def test_template_family_is_compared_whole(spark, make, monkeypatch):
    """Texts around one template below the threshold share buckets; the near copies among them are found, leaders or not."""
    monkeypatch.setattr(near, "LEADERS", 2)
    monkeypatch.setattr(near, "TILE", 16)
    rng = random.Random(9)
    template = [f"t{i}" for i in range(300)]
    rows = []
    for i in range(60):
        words = edited(rng, template, 0.8)
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(edited(rng, words, 0.93)))]
    rng.shuffle(rows)
    expected, pairs = brute(dict(rows))
    found = {r.doc_id: r.component_id for r in near.near_components(make(*rows)).collect()}
    assert len(set(expected.values())) > 40 and found == expected


def test_case_and_space_and_empty_texts(spark, make):
    rows = [(1, "A b\nc d e f"), (2, "a  B c d e F"), (3, ""), (4, None), (5, " \t"), (None, "a b c d e f"), (6, "a b"), (7, "A\tb"), (8, "a c")]
    found = [(r.doc_id, r.component_id) for r in near.near_components(make(*rows)).collect()]
    assert sorted(found, key=str) == sorted([(1, 1), (2, 1), (3, 3), (4, 3), (5, 3), (None, 1), (6, 6), (7, 6), (8, 8)], key=str)
