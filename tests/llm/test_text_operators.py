"""Each operator against a brute-force version, an exact round trip or held-out accuracy."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

import public_tokenizers
from assaylane.llm import bpe, html, language, lines, mixing, quality, queries, search, simhash, substring, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, sf_dir):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def test_poisson_rates_and_repeatability(spark):
    rows = [(i, "x" * 10, "en", "big" if i % 4 else "small", 10) for i in range(8000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    weights = spark.createDataFrame([("big", 1.0), ("small", 1.0)], "source string, weight double")
    found = mixing.mix_sources(docs, weights, seed=3)
    counts = {r.source: r["count"] for r in found.groupBy("source").count().collect()}
    assert counts["big"] == pytest.approx(4000, rel=0.06) and counts["small"] == pytest.approx(4000, rel=0.06)
    copies = Counter(r["count"] for r in found.where("source = 'small'").groupBy("doc_id").count().collect())
    for k in (1, 2, 3):  # the rate is 2
        assert copies[k] == pytest.approx(2000 * math.exp(-2) * 2**k / math.factorial(k), rel=0.15)
    keys = [r.shuffle_key for r in found.collect()]
    assert keys == sorted(keys)
    again = mixing.mix_sources(docs.repartition(7), weights, seed=3)
    assert again.exceptAll(found).count() == 0 and found.exceptAll(again).count() == 0


@pytest.mark.parametrize("many", [2, 256])
def test_substrings_equal_brute_force(spark, sf_dir, monkeypatch, many):
    monkeypatch.setattr(substring, "MANY_SEGMENTS", many)
    docs = documents(spark, sf_dir)
    words = {i: WORD.findall(r.text or "") for i, r in docs.items()}
    first: dict = {}
    for i in sorted(words):
        for j in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][j : j + 50]), i)
    for r in queries.op2_substring(spark, sf_dir).collect():
        w, gone = words[r.doc_id], set()
        for j in range(len(w) - 49):
            if first[tuple(w[j : j + 50])] < r.doc_id:
                gone.update(range(j, j + 50))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())


def test_one_passage_in_very_many_documents(spark, make, monkeypatch):
    monkeypatch.setattr(substring, "MANY_SEGMENTS", 16)
    rng = random.Random(1)
    passage = " ".join(f"p{i}" for i in range(60))
    own = lambda: " ".join(str(rng.random()) for _ in range(40))
    docs = make(*[(i, f"{own()} {passage} {own()}") for i in range(200)])
    found = {r.doc_id: r.n_removed for r in substring.remove_repeats(docs).collect()}
    assert found == {i: 0 if i == 0 else 60 for i in range(200)}


def test_substrings_of_rows_that_share_a_doc_id(spark, make):
    passage, own = " ".join(f"p{i}" for i in range(60)), " ".join(f"q{i}" for i in range(70))
    found = substring.remove_repeats(make((1, passage), (2, passage), (2, own), (2, passage)))
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in found.collect()) == [(1, 60, 0), (2, 60, 60), (2, 60, 60), (2, 70, 0)]


@pytest.mark.parametrize("seed", [1, 2])
def test_many_variants_of_a_passage_equal_brute_force(spark, make, monkeypatch, seed):
    """Windows that many documents share in many variants: references and segments are dealt into several parts each."""
    monkeypatch.setattr(substring, "MANY_SEGMENTS", 4)
    rng = random.Random(seed)
    base = [f"p{i}" for i in range(90)]
    texts = {}
    for i in range(60):
        w = base.copy()
        for at in rng.sample([*range(20), *range(72, 90)], 3):
            w[at] = f"x{rng.randrange(6)}"
        texts[i] = [f"a{i}"] * rng.randrange(5) + w[rng.randrange(8) : 90 - rng.randrange(8)]
    first: dict = {}
    for i, w in texts.items():
        for j in range(len(w) - 49):
            first.setdefault(tuple(w[j : j + 50]), i)
    for r in substring.remove_repeats(make(*[(i, " ".join(w)) for i, w in texts.items()])).collect():
        w = texts[r.doc_id]
        gone = {k for j in range(len(w) - 49) if first[tuple(w[j : j + 50])] < r.doc_id for k in range(j, j + 50)}
        assert r.n_removed == len(gone) and r.kept == " ".join(x for k, x in enumerate(w) if k not in gone)


def test_automaton_equals_brute_force():
    rng = random.Random(2)
    for _ in range(500):
        refs = [[rng.randrange(3) for _ in range(rng.randint(0, 20))] for _ in range(rng.randint(0, 4))]
        text, n = [rng.randrange(3) for _ in range(rng.randint(0, 30))], rng.randint(1, 5)
        automaton = substring.SuffixAutomaton()
        for r in refs:
            automaton.add(r)
        known = {tuple(r[i : i + n]) for r in refs for i in range(len(r) - n + 1)}
        expected = {j for i in range(len(text) - n + 1) if tuple(text[i : i + n]) in known for j in range(i, i + n)}
        assert {j for b, e in automaton.spans(text, n) for j in range(b, e)} == expected


def test_language_held_out(spark):
    sf_dir = "/root/testdata/sf0.01"
    found = queries.op3_language(spark, sf_dir).where("held_out").join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in found) / len(found) > 0.97


def test_language_mixtures(spark, make):
    """A text of two languages, half and half, has both in its set."""
    a, b = "bada gada dabo gabo badi ", "tikki pekki tepik kitep pitek "
    docs = make(*[(i, a * 20, "a", "s") for i in range(5)], *[(10 + i, b * 20, "b", "s") for i in range(5)])
    model = language.fit_languages(docs)
    found = {r.doc_id: r for r in language.identify(make((1, a * 10), (2, (a + b) * 10), (3, "123 ...")), model).collect()}
    assert found[1].lang_pred == "a" and set(found[1].mixture) == {"a"}
    assert set(found[2].mixture) == {"a", "b"} and 0.3 < found[2].mixture["a"] < 0.7
    assert found[3].lang_pred == "und"


def test_toxicity_held_out(spark):
    sf_dir = "/root/testdata/sf0.1"
    found = queries.op4_toxicity(spark, sf_dir).where("held_out").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").collect()
    bad, good = [r.score for r in found if r.toxic], [r.score for r in found if not r.toxic]
    auc = np.mean([[x > y for y in good] for x in bad])
    assert auc > 0.95
    assert sum(r.predicted for r in found if not r.toxic) / len(good) < 0.03
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)


def test_toxicity_without_both_classes(spark, make):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    found = toxicity.score_toxicity(make((1, "a"), (2, None)), toxicity.fit_toxicity(make((1, "a")), labels)).collect()
    assert {round(r.score, 6) for r in found} == {round(2 / 3, 6)}


def brute_bm25(docs, asked, k):
    terms = {i: Counter(re.findall(r"[^\W_]+", (t or "").lower())) for i, t in docs}
    n, mean = len(docs), sum(sum(t.values()) for t in terms.values()) / len(docs)
    df = Counter(t for c in terms.values() for t in c)
    out = {}
    for q in asked:
        scores = []
        for i, c in terms.items():
            size = sum(c.values())
            s = sum(m * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * size / mean)) for t, m in terms[q].items() if t in c)
            if s > 0:
                scores.append((-round(s, 6), i))
        out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def test_search_equals_brute_force(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_DOCS", 32)
    monkeypatch.setattr(search, "QUERY_ROWS", 3)
    monkeypatch.setattr(search, "ROUND_TERMS", 400)
    docs = documents(spark, sf_dir)
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(3)
    asked = [i for i in docs if i % 10 == 0]
    found: dict = {}
    for r in search.search(df, df.where("doc_id % 10 = 0"), k=4, splits=1).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.doc_id, r.score))
    expected = brute_bm25([(i, r.text) for i, r in docs.items()], asked, 4)
    for q in asked:
        assert [i for i, _ in found[q]] == [i for i, _ in expected[q]]
        assert [s for _, s in found[q]] == pytest.approx([s for _, s in expected[q]], abs=2e-6)


def brute_simhash(text):
    import xxhash

    low = (text or "").translate({65 + i: 97 + i for i in range(26)})
    w = WORD.findall(low)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_equals_brute_force(spark, sf_dir):
    docs = documents(spark, sf_dir)
    prints = {i: brute_simhash(r.text) for i, r in docs.items()}
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    for r in queries.op6_simhash(spark, sf_dir).collect():
        assert (r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", find(r.doc_id))


@pytest.mark.parametrize(("tile", "n"), [(4, 60), (512, 300)])
def test_links_join_all_near_fingerprints(spark, monkeypatch, tile, n):
    """Fingerprints drawn around few centres: many share a key, and tiles of a bucket are compared with each other."""
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = random.Random(4)
    centres = [rng.getrandbits(64) for _ in range(5)]
    values = sorted({rng.choice(centres) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(n)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()
    root = {v: v for v in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for e in edges:
        assert e.a in root and e.b in root
        root[find(e.a)] = find(e.b)
    for i, a in enumerate(values):
        for j, b in enumerate(values[:i]):
            if (a ^ b).bit_count() <= 2:
                assert find(signed[i]) == find(signed[j])


def test_lines_near_brute_force(spark, sf_dir):
    """MinHash may miss a pair near the threshold, but must not remove a line that brute force keeps; equal lines of any length are never missed."""
    docs = documents(spark, sf_dir)
    occ = [(i, p, x.lower()) for i in sorted(docs) for p, x in enumerate((docs[i].text or "").split("\n")) if WORD.search(x)]
    unique = list(dict.fromkeys(x for *_, x in occ))
    grams = [{x[i : i + 8] for i in range(len(x) - 7)} if len(x) >= 40 else None for x in unique]
    root = list(range(len(unique)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(grams):
        for j in range(i):
            b = grams[j]
            if a and b and len(a & b) >= 0.8 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    place, seen, gone, equal = {x: i for i, x in enumerate(unique)}, set(), Counter(), Counter()
    for i, _, x in occ:
        c = find(place[x])
        gone[i] += c in seen
        equal[i] += x in seen
        seen |= {c, x}
    found = {r.doc_id: r.n_removed for r in queries.op7_lines(spark, sf_dir).collect()}
    assert all(equal[i] <= found[i] <= gone[i] for i in docs)
    assert sum(found.values()) >= 0.98 * sum(gone.values())


def test_lines_planted_edits(spark, make):
    """Lines of 120 to 400 characters with one character or one word replaced: all whose similarity is 0.8 or more are found but for 2 %, none below it."""
    rng = random.Random(12)
    text = lambda n: "".join(rng.choice("abcdefghijklmnop  ") for _ in range(n))
    rows, near = [], {}
    for i in range(400):
        line = text(rng.randint(100, 400))
        at, new = rng.randrange(len(line) - 6), text(rng.choice((1, 6)))
        other = line[:at] + new + line[at + len(new) :]
        x, y = ({s[j : j + 8] for j in range(len(s) - 7)} for s in (line, other))
        rows += [(2 * i, line), (2 * i + 1, other)]
        near[2 * i + 1] = line == other or len(x & y) >= 0.8 * len(x | y)
    found = {r.doc_id: r.n_removed for r in lines.drop_duplicate_lines(make(*rows)).collect()}
    assert not any(found[i] for i in found if not near.get(i))
    assert sum(map(bool, near.values())) > 300
    assert sum(found[i] for i in near if near[i]) >= 0.98 * sum(near.values())


def test_lines_short_repeats_and_shared_ids(spark, make):
    """Equal short lines leave one; blank lines stay; rows of one doc_id with different texts lose only their own lines."""
    docs = make((1, "short line\n\n \t\nanother"), (2, "Short Line\n\nkept here\n \t"), (3, "another\nmore"), (3, "of its own\nmore and more"))
    found = sorted((r.doc_id, r.text) for r in lines.drop_duplicate_lines(docs).collect())
    assert found == [(1, "short line\n\n \t\nanother"), (2, "\nkept here\n \t"), (3, "more"), (3, "of its own\nmore and more")]


def test_lines_of_one_large_group(spark, make):
    """Hundreds of near copies of a line leave one; a different line stays."""
    rng = random.Random(5)
    base = [f"word{i}" for i in range(60)]
    copies = []
    for i in range(300):
        w = base.copy()
        w[rng.randrange(60)] = f"new{i}"
        copies.append((i, " ".join(w) + "\n" + f"a line of its own, number {i}, told apart by {rng.random()} and {rng.random()}"))
    found = lines.drop_duplicate_lines(make(*copies)).orderBy("doc_id").collect()
    assert [r.n_removed for r in found] == [0] + [1] * 299


def test_bpe_equals_tiktoken(spark, sf_dir):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = documents(spark, sf_dir)
    for r in queries.op8_bpe(spark, sf_dir).collect():
        ids = reference.encode_ordinary(docs[r.doc_id].text or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((docs[r.doc_id].text or "").encode()).hexdigest()
    encoder, rng = bpe.Encoder(ranks, public_tokenizers.PATTERN), random.Random(6)
    for text in ["a" * 3000, "<|endoftext|>", "don't I'LL  \n\n x", "　日本語１２"] + ["".join(rng.choice("ab é\n\t'sd1²,. 日ñ") for _ in range(40)) for _ in range(500)]:
        assert np.frombuffer(encoder.encode(text), "<i4").tolist() == reference.encode_ordinary(text)


def test_quality_statistics_equal_brute_force(spark, sf_dir):
    docs = documents(spark, sf_dir)
    for r in queries.op9_quality(spark, sf_dir).collect():
        text = docs[r.doc_id].text or ""
        w = WORD.findall(text)
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {k for j in range(len(w) - 2) if grams[tuple(w[j : j + 3])] > 1 for k in (j, j + 1, j + 2)}
        kept_lines = [x for x in text.split("\n") if WORD.search(x)]
        expected = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(kept_lines) - len(set(kept_lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.base_failed and r.kept)


def test_quality_keeps_clean_and_rejects_junk(spark):
    sf_dir = "/root/testdata/sf0.01"
    found = queries.op9_quality(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label")), "doc_id").where("not base_failed").collect()
    assert all(r.kept for r in found if r.label == 1)
    assert not any(r.kept for r in found if r.label == 0)


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var x="</p><p>no</p>";</script></head><body class="post">
<header class="site"><a href="/">Home of news</a></header><nav><ul><li><a href=/a>One</a></li><li><a href=/b>Two</a></li></ul></nav>
<div class="cookie-notice">We use cookies to serve you better and so on.</div><!-- <p>hidden</p> -->
<article><h1>The  title &amp; more</h1><p>First   paragraph of the story, with<br>a break &eacute;.</p><p>In.</p>
<aside class="related"><p>Read this other story that we have here</p></aside>
<p>Second <a href="/x">linked word</a> paragraph goes on for quite some time.</p>
<section id="comments"><h3>Comments</h3><p>A reader says a lot of things in this comment here.</p></section></article>
<form><label>Your mail</label><button>Send</button></form><div class="sidebar"><p>Popular things of this week in a sidebar.</p></div>
<footer>&copy; someone &middot; all rights reserved.</footer></body></html>"""


def test_html_main_text(spark):
    page = spark.createDataFrame([(1, "u", PAGE)], "page_id long, url string, html string")
    assert html.main_text(page).first().text == "The title & more\nFirst paragraph of the story, with a break é.\nIn.\nSecond linked word paragraph goes on for quite some time."


def test_html_without_named_containers(spark):
    words = "word " * 40
    plain = f"<body><div><a href=1>Home</a></div><div><a href=2>About us</a></div><div>{words}</div><div>{words}end.</div><div><a href=3>More of it</a></div></body>"
    found = html.main_text(spark.createDataFrame([(1, "u", plain)], "page_id long, url string, html string")).first().text
    assert found == words.strip() + "\n" + words + "end."


def test_html_articles_of_the_test_pages(spark, sf_dir):
    from html import unescape

    found = {r.page_id: r.text for r in queries.op10_html(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        marked = re.sub(r"</?(p|h1|br|b)>", lambda m: "\0" if m[1] in ("p", "h1") else " ", article)
        parts = [" ".join(unescape(x).split()) for x in marked.split("\0")]
        assert found[r.page_id] == "\n".join(x for x in parts if x)
