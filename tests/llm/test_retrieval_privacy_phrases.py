"""Ranked search, personal data and phrases against plain versions, and their odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylane.llm import phrases, pii, queries, ranked
from assaylane.llm.perfect import PerfectHash

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def small(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_ranking(docs, items, k):
    words = [(d, [small(t) for t in TERM.findall(text)]) for d, text in docs if d is not None and text is not None]
    words = [(d, w) for d, w in words if w]
    n_docs, n_terms = len(words), sum(len(w) for _, w in words)
    df = Counter(t for _, w in words for t in set(w))
    asked = defaultdict(set)
    for item, text in items:
        if item is not None and text is not None:
            asked[item] |= {small(t) for t in TERM.findall(text)}
    out = []
    for item, terms in asked.items():
        scores = []
        for d, w in words:
            tf, m = Counter(w), 100 - 90 + (90 * len(w) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in terms if tf[t])
            if score > 0:
                scores.append((-score, d))
        out += [(item, i + 1, d, -s) for i, (s, d) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def ranking(spark, docs, items, k=3):
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    return sorted(map(tuple, ranked.rank_documents(rows, spark.createDataFrame(items, "item_id long, text string"), k=k).collect()))


def random_docs(seed, n):
    draw = random.Random(seed)
    vocabulary = [f"{draw.choice('abcÉ')}{i}" for i in range(60)]
    return [(d, " ".join(draw.choices(vocabulary, weights=[1 / (i + 1) for i in range(60)], k=draw.randint(0, 60)))) for d in range(n)]


@pytest.mark.parametrize("limit", [ranked.BROADCAST_BYTES, 0])
@pytest.mark.parametrize("shard", [ranked.SHARD_BYTES, 700])
def test_ranking_equals_brute_force(spark, monkeypatch, limit, shard):
    monkeypatch.setattr(ranked, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(ranked, "BLOCK_QUERIES", 3)
    docs = random_docs(1, 150) + [(7, "a0 a1 a1"), (7, "a0 a1 a1"), (None, "a0 a1"), (900, None), (901, " .,"), (902, "A0 A1-a1"), (903, "a0,a1;A1")]
    items = [(i, text) for i, text in random_docs(2, 8)] + [(100, "a0 a1"), (100, "b2"), (101, None), (102, "!?"), (None, "a0"), (103, "zz unknown"), (104, docs[3][1])]
    assert ranking(spark, docs, items, 5) == plain_ranking(docs, items, 5)


def test_ranking_ties_and_copies(spark):
    docs = [(d, "same words here") for d in range(40, 0, -1)] + [(99, "other")]
    assert [(r[1], r[2]) for r in ranking(spark, docs, [(1, "same here")], 10)] == [(i + 1, i + 1) for i in range(10)]


def test_ranking_of_nothing(spark):
    assert ranking(spark, [], [(1, "a")]) == ranking(spark, [(1, "a")], []) == ranking(spark, [(1, None)], [(1, "a")]) == []


def test_shards_prune_and_stay_exact():
    draw = np.random.default_rng(0)
    lists = {f"t{i}": np.flatnonzero(draw.random(500) < 1 / (i + 1)) for i in range(12)}
    data = {t: ranked.pack(np.column_stack([np.diff(at, prepend=0), draw.integers(1, 9, len(at))]).ravel())[0].tobytes() for t, at in lists.items() if len(at)}
    weights = {t: int(draw.integers(0, 9000)) for t in data}
    shard = ranked._Shard(np.arange(500) * 2, draw.integers(9, 90, 500), data, weights, 500, 20_000)
    totals = Counter()
    for t in data:
        totals.update(shard.gains(t))
    expected = sorted(((s, 2 * d) for d, s in totals.items() if s > 0), key=lambda x: (-x[0], x[1]))
    for k in (1, 5, 1000):
        assert shard.best(list(data), k) == expected[:k]


def test_packed_integers():
    values = np.array([0, 1, 127, 128, 16383, 16384, 1 << 40, 5])
    data, sizes = ranked.pack(values)
    assert ranked.unpack(data.tobytes()).tolist() == values.tolist() and sizes.sum() == len(data)


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def plain_spans(text):
    out = []
    for place, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}
            if good[kind]:
                out.append((m.start(), place, kind, m.end()))
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(out)]


TEXTS = [
    "mail a.b+c@x-y.example.com, then a@b.c_d@e.f.g and x@y z@q.r. @a.b q@@w.e end@it.",
    "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 00000255.0.0.01 1.2.3 9.9.9.9.",
    "4041894974608795 4041 8949 7460 8795 4041-8949-7460-8795 4041894974608796 1 2 - 3 0 0 0 0 0 0 0 0 0 0 0 0 0 0",
    "+1 (988) 555-2485 +49.30.1234567 +1 ( +12 +1234567890123456 +1(((((((2345678901 +9 9",
    "\U0001f600 é +1 (988) 555-2485\ta@b.cc \U0001f600\U0001f600 10.0.0.1 é@b.co",
    "", None, "a" * 3000 + "@" + "b" * 3000, "0." * 2000, "a@b" + ".c" * 5000, "9 " * 4000, "+1" * 2000,
]


def test_patterns_equal_the_plain_ones(make):
    draw = random.Random(5)
    texts = TEXTS + ["".join(draw.choice("a1.@+-_ ()4%") for _ in range(draw.randint(0, 60))) for _ in range(400)]
    found = {r.doc_id: r for r in pii.sanitise(make(*enumerate(texts))).collect()}
    for i, text in enumerate(texts):
        expected = plain_spans(text)
        assert found[i].base == ",".join(expected), text
        assert [found[i][f"n_{k}"] for k in PLAIN] == [sum(s.startswith(k + ":") for s in expected) for k in PLAIN]


def test_terms_that_reveal_go(make):
    draw = random.Random(3)
    filler = lambda n: " ".join(draw.choice(["green", "river", "stone", "house", "cloud", "table"]) + draw.choice(["", "s"]) for _ in range(n))
    docs = [(i, f"{filler(12)} Zebulon writes from zeb@mail.example.org {filler(9)}") for i in range(4)]
    docs += [(i, f"{filler(20)} visitor zebulon passed {filler(3)}") for i in range(4, 5)] + [(i, filler(25)) for i in range(10, 60)]
    docs += [(i, "Copied Quirinus note to quin@mail.example.org about stone") for i in range(60, 66)]
    found = {r.doc_id: r for r in pii.sanitise(make(*docs)).collect()}
    for i in range(4):
        at = docs[i][1].index("Zebulon")
        assert f"term:{at}:{at + 7}" in found[i].spans and "Zebulon" not in found[i].sanitised and "[email]" in found[i].sanitised
        assert set(found[i].base.split(",")) <= set(found[i].spans.split(","))
    assert "term:" in found[4].spans  # the name alone, without the address
    assert all(found[i].spans == "" for i in range(10, 60))
    assert all(found[i].spans == found[i].base for i in range(60, 66))  # copies of one text are no evidence


def test_personal_data_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    for r in queries.op12_pii(spark, sf_dir).collect():
        assert r.base_sha256 == hashlib.sha256(",".join(plain_spans(docs[r.doc_id])).encode()).hexdigest()


def test_perfect_hash():
    draw = np.random.default_rng(1)
    keys = np.unique(draw.integers(0, 1 << 63, 20_000, dtype=np.uint64))
    table = PerfectHash.from_bytes(PerfectHash(keys).to_bytes())
    assert sorted(table.slots(keys).tolist()) == list(range(len(keys)))
    assert (table.keys[table.slots(keys)] == keys).all() and (table.slots(keys + np.uint64(1))[~np.isin(keys + np.uint64(1), keys)] == -1).all()
    assert PerfectHash(np.zeros(0, np.uint64)).slots(keys).tolist() == [-1] * len(keys)


def plain_collocations(docs, min_count, top):
    n, f = Counter(), defaultdict(Counter)
    for text, lang in docs:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", small(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        frequent = {g: c for g, c in counts.items() if len(g) > 1 and c >= min_count}
        held = {b[i : i + k] for b, c in frequent.items() for k in range(2, len(b)) for i in range(len(b) - k + 1) if c >= frequent[b[i : i + k]]}
        rows = []
        for g, a in frequent.items():
            if g not in held:
                score, _, left, right = min((math.floor(Fraction(1000 * a * n[lang], counts[g[:k]] * counts[g[k:]])), k, counts[g[:k]], counts[g[k:]]) for k in range(1, len(g)))
                rows.append((-score, -a, " ".join(g).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


@pytest.mark.parametrize("part_keys,part_bytes,held", [(1 << 21, 32 << 20, 500_000), (60, 1500, 5)])
def test_phrases_equal_brute_force(spark, monkeypatch, part_keys, part_bytes, held):
    monkeypatch.setattr(phrases, "PART_KEYS", part_keys)
    monkeypatch.setattr(phrases, "PART_BYTES", part_bytes)
    monkeypatch.setattr(phrases, "HELD", held)
    draw = random.Random(2)
    words = ["the", "of", "New", "york", "city", "Évian", "x"]
    docs = [(" ".join(draw.choice([*words, "new york city of the", "a a a", "rare" + str(draw.random())]) + draw.choice(["", "", "", ".", "\n"]) for _ in range(draw.randint(0, 40))), draw.choice(["en", "fr", None, "und"])) for _ in range(120)]
    docs += [(None, "en"), ("", "fr"), ("the of " * 300, "de"), (" . ", None)]
    table = spark.createDataFrame(docs, "text string, lang string").withColumn("n", F.lit(1)).repartition(3)
    found = phrases.collocations(table, min_count=20, top=15)
    assert sorted(map(tuple, found.collect())) == plain_collocations(docs, 20, 15)
    assert dict(found.dtypes) == {"lang": "string", "rank": "bigint", "phrase": "string", "a": "bigint", "l": "bigint", "r": "bigint", "n": "bigint", "score": "bigint"}


def test_phrases_of_nothing(spark, make):
    assert phrases.collocations(make((1, "a b c"), (2, None))).collect() == []
    assert phrases.collocations(make((1, "a b")).where("false")).collect() == []


@pytest.mark.parametrize("run", [lambda d: ranked.rank_documents(d, d.select(F.col("doc_id").alias("item_id"), "text")), pii.sanitise, lambda d: phrases.collocations(d, min_count=2)])
def test_odd_and_clashing_rows(odd, clashing, run):
    run(odd).collect()
    run(clashing).collect()
    assert run(odd.where("false")).collect() == []
