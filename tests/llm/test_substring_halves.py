"""Windows of segments that very many documents share: only those that can be shared are handed on."""

from __future__ import annotations

import random

import pytest

from assaylane.llm import substring


def texts_of(spark, words_of):
    """Segments of the documents, as the operator hands them to the choice of references."""
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in words_of.items()], "doc_id long, text string")
    columns = ["anchor", "doc_id", "text_id", "start", "size"]
    found = {(r.doc_id, r.start): r for r in substring.segments(docs, 50).collect()}
    rows = [(*(r[c] for c in columns[:-1]), bytearray(" ".join(words_of[i][s : s + r["size"]]).encode())) for (i, s), r in found.items()]
    return spark.createDataFrame(rows, "anchor long, doc_id long, text_id long, start int, words binary"), found


@pytest.mark.parametrize("length", [20, 45])
def test_windows_around_a_short_passage_are_not_handed_on(spark, length):
    """A passage that is shorter than a window shares none, and of a window that holds less than half of it nothing is hashed."""
    rng = random.Random(length)
    own = lambda: [str(rng.random()) for _ in range(60)]
    texts, _ = texts_of(spark, {i: own() + [f"p{j}" for j in range(length)] + own() for i in range(40)})
    handed = sum(len(r.words.split()) - 49 for r in substring._may_share(texts, 50).collect())
    windows = sum(len(r.words.split()) - 49 for r in texts.collect())
    assert windows > 2800 and handed == (0 if length == 20 else handed) and handed < windows / 3
    assert substring._owners(texts, 50).count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_owners_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    words = {}
    for i in range(50):
        w = [f"p{j}" for j in range(130)]
        for at in rng.sample(range(130), 2):
            w[at] = f"x{rng.randrange(4)}"
        words[i] = w[rng.randrange(20) : 130 - rng.randrange(20)]
    texts, found = texts_of(spark, words)
    holders: dict = {}
    for (i, s), r in found.items():
        for j in range(s, s + r["size"] - 49):
            holders.setdefault(tuple(words[i][j : j + 50]), []).append((i, r.text_id, s, r.anchor))
    wanted = {min(h) for h in holders.values() if min(h)[0] < max(h)[0]}
    assert wanted and {(r.doc_id, r.text_id, r.start, r.anchor) for r in substring._owners(texts, 50).collect()} == wanted
