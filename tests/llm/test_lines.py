"""Lines whose near copies are led by none of them."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from assaylane.llm import lines


def test_template_family_is_compared_whole(spark, make, monkeypatch):
    """Lines of a template that meet in one large bucket only, below the threshold; the near copies among them are found all the same."""
    monkeypatch.setattr(lines, "bands", lambda found: found.select(F.lit(1).cast("bigint").alias("key"), "id").distinct())
    rng = random.Random(10)
    text = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    template = text(180)
    rows = []
    for i in range(30):
        line = template + text(38)
        rows += [(2 * i, line), (2 * i + 1, line[:-1] + "#")]
    sets = {i: {t[j : j + 8] for j in range(len(t) - 7)} for i, t in rows}
    for a, x in sets.items():
        for b, y in sets.items():
            assert a == b or (a // 2 == b // 2) == (len(x & y) >= 0.8 * len(x | y))
    found = {r.doc_id: r.n_removed for r in lines.drop_duplicate_lines(make(*rows)).collect()}
    assert found == {i: i % 2 for i, _ in rows}


def test_most_met_member_leads(spark):
    """The member that meets most others leads its buckets, whatever its id; buckets of one go."""
    rows = [(1, 5), (1, 1), (1, 2), (2, 5), (2, 3), (3, 5), (3, 1), (4, 9)]
    found = lines._meet(spark.createDataFrame(rows, "key bigint, id bigint")).collect()
    assert sorted((r.key, r.id, r.leader) for r in found) == [(k, i, 5) for k, i in sorted(rows[:-1])]


def test_marks_tell_near_from_nearly_near(spark):
    """Marks let every pair of the threshold pass, repeats in the lines included, and hardly one of similarity under 0.77, though the lines have 500 shingles and more."""
    rng = random.Random(7)
    base = [rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(560)]
    texts = []
    for i in range(60):
        line = base.copy()
        for at in rng.sample(range(len(line)), rng.randint(0, 8)):
            line[at] = "#"
        texts.append((i, "".join(line) + "again and again " * (i % 3)))
    sets = {i: {t[j : j + 8] for j in range(len(t) - 7)} for i, t in texts}
    marked = lines.marks(spark.createDataFrame(texts, "id bigint, line string").select("id", F.encode("line", "UTF-16BE").alias("wide")))
    pairs = marked.join(lines._other(marked), (F.col("id") < F.col("_id")) & lines._may_be_near(0.8)).select("id", "_id")
    passed = {(r.id, r._id) for r in pairs.collect()}
    alike = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    assert {p for p, s in alike.items() if s >= 0.8} <= passed
    below = [p for p, s in alike.items() if s < 0.77]
    assert len(below) > 300 and sum(p in passed for p in below) <= 0.01 * len(below)


def test_met_pairs_are_not_marked(spark, make, monkeypatch):
    """Two lines that are alike but not near, and share a bucket of two, have met there; neither is marked to be compared again."""
    monkeypatch.setattr(lines, "bands", lambda found: found.select(F.lit(1).cast("bigint").alias("key"), "id").distinct())
    marked, marks = [], lines.marks
    monkeypatch.setattr(lines, "marks", lambda texts: marked.append(texts.count()) or marks(texts))
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    template = text(60)
    found = lines.drop_duplicate_lines(make((1, template + text(40)), (2, template + text(40)))).collect()
    assert [r.n_removed for r in found] == [0, 0] and marked == [0]


def test_band_without_a_shingle_has_no_key(spark):
    """Short lines of different words, most of whose bands are empty, share no key; equal ones have the same."""
    rows = [(i, f"{i:04d}-{i * 7919 % 10007:05d}-") for i in range(200)]
    found = lines.bands(spark.createDataFrame([*rows, rows[0]], "id bigint, line string"))
    shared = found.groupBy("key").count().where("count > 1").count()
    assert shared == 0 and {r.id for r in found.select("id").distinct().collect()} == set(range(200))
