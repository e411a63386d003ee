"""Substring deduplication: suffix automata of reference passages, matched by streaming documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut
from .grams import chunks, mix64

#: Words of the grams by which windows are found to meet.
GRAM = 8
#: Different segments of an anchor up to which all of them are references; above, only those that own a shared window.
MANY_SEGMENTS = 256
#: Segments, about, that one call of the matching gets.
CALL_SEGMENTS = 4096


def split_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The 64-bit hash and the text of every word, and the texts as bytes; words end at ASCII white space.

    A word's hash is a polynomial in its bytes, taken from running sums, and then mixed with its length.
    """
    encoded = [t.encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b" " + b" ".join(encoded) + b" ", dtype=np.uint8)
    inside = (data != 32) & ((data < 9) | (data > 13))
    first = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    end = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    lengths = np.fromiter((len(e) + 1 for e in encoded), dtype=np.int64, count=len(encoded))
    starts = 1 + np.append(0, lengths.cumsum()[:-1]) if len(encoded) else np.zeros(0, np.int64)
    return ranges_hash(data.astype(np.uint64) + np.uint64(1), first, end), np.searchsorted(starts, first, side="right") - 1, encoded


def ranges_hash(values: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range of ``values``, equal for equal ranges wherever they are."""
    if not len(first):
        return np.zeros(0, np.uint64)
    base = 0x9E3779B97F4A7C15
    with np.errstate(over="ignore"):
        power = np.multiply.accumulate(np.append(np.uint64(1), np.full(len(values), np.uint64(base))))
        inverse = np.multiply.accumulate(np.append(np.uint64(1), np.full(len(values), np.uint64(pow(base, -1, 1 << 64)))))
        sums = np.append(np.uint64(0), np.cumsum(values * power[:-1], dtype=np.uint64))
        return mix64((sums[end] - sums[first]) * inverse[first] + mix64((end - first).astype(np.uint64)))


def anchors(hashes: np.ndarray, owner: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The gram that stands for each window: window starts, the place of the gram, and its hash.

    A window is ``window`` words of one text. Of its grams of GRAM words the one of least hash stands
    for it, the leftmost of equals, so equal windows are stood for by equal grams at equal distances.
    """
    n = len(hashes) - GRAM + 1
    empty = np.zeros(0, np.int64)
    if n <= 0:
        return empty, empty, np.zeros(0, np.uint64)
    gram = ranges_hash(hashes, np.arange(n), np.arange(n) + GRAM)
    starts = np.arange(max(0, len(hashes) - window + 1))
    starts = starts[owner[starts] == owner[starts + window - 1]]
    if not len(starts):
        return empty, empty, np.zeros(0, np.uint64)
    width = window - GRAM + 1
    least, place, span = gram.copy(), np.arange(n), 1
    while span < width:  # minima over spans of doubling width, each from two that overlap
        step = min(span, width - span)
        a, b = slice(0, len(least) - step), slice(step, len(least))
        second = least[b] < least[a]
        place = np.where(second, place[b], place[a])
        least = np.where(second, least[b], least[a])
        span += step
    return starts, place[starts], least[starts]


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text and text_id, the text's hash: rows that share a doc_id may have different texts."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_id"))


def segments(docs: DataFrame, window: int) -> DataFrame:
    """anchor, content, doc_id, text_id, start and size of every segment: the windows that one gram stands for, joined.

    Each window of a text lies in one segment, and equal windows lie in segments of one anchor. ``content``
    hashes the segment's words; start and size count words.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for piece in chunks(batches):
            hashes, owner, _ = split_words(piece["text"].tolist())
            starts, place, gram = anchors(hashes, owner, window)
            first = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (owner[starts[1:]] != owner[starts[:-1]]))) if len(starts) else starts
            begin, end = starts[first], starts[np.append(first[1:], len(starts)) - 1] + window if len(starts) else starts
            doc = owner[begin]
            texts_at = np.searchsorted(owner, np.arange(len(piece)))
            yield pd.DataFrame(
                {
                    "anchor": gram[first].view(np.int64),
                    "content": ranges_hash(hashes, begin, end).view(np.int64),
                    "doc_id": piece["doc_id"].to_numpy(dtype=np.int64)[doc],
                    "text_id": piece["text_id"].to_numpy(dtype=np.int64)[doc],
                    "start": (begin - texts_at[doc]).astype(np.int32),
                    "size": (end - begin).astype(np.int32),
                }
            )

    rows = _rows(docs).where(F.col("doc_id").isNotNull())
    return rows.mapInPandas(run, "anchor long, content long, doc_id long, text_id long, start int, size int")


class SuffixAutomaton:
    """The suffix automaton of several word sequences: all their factors, and none that crosses from one to the next."""

    def __init__(self) -> None:
        self.step: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, sequence) -> None:
        step, link, length = self.step, self.link, self.length
        last = 0
        for word in sequence:
            to = step[last].get(word)
            if to is not None and length[to] == length[last] + 1:
                last = to
                continue
            if to is not None:
                last = self._clone(last, word, to)
                continue
            new = len(step)
            step.append({})
            link.append(0)
            length.append(length[last] + 1)
            at = last
            while at >= 0 and word not in step[at]:
                step[at][word] = new
                at = link[at]
            if at >= 0:
                to = step[at][word]
                link[new] = to if length[to] == length[at] + 1 else self._clone(at, word, to)
            last = new

    def _clone(self, at: int, word, to: int) -> int:
        """A copy of state ``to`` for the shorter factors that end in it, reached from ``at`` and its suffixes."""
        step, link, length = self.step, self.link, self.length
        copy = len(step)
        step.append(step[to].copy())
        link.append(link[to])
        length.append(length[at] + 1)
        link[to] = copy
        while at >= 0 and step[at].get(word) == to:
            step[at][word] = copy
            at = link[at]
        return copy

    def spans(self, sequence, shortest: int) -> list[tuple[int, int]]:
        """The maximal spans of words all of whose windows of ``shortest`` words occur, from the matching statistics."""
        step, link, length = self.step, self.link, self.length
        at, match, out = 0, 0, []
        for i, word in enumerate(sequence):
            to = step[at].get(word)
            while to is None and at:
                at = link[at]
                match = length[at]
                to = step[at].get(word)
            if to is None:
                match = 0
            else:
                at, match = to, match + 1
            if match >= shortest:
                begin = i + 1 - shortest
                if out and begin <= out[-1][1]:
                    out[-1][1] = i + 1
                else:
                    out.append([begin, i + 1])
        return [tuple(x) for x in out]


def _to_documents(rows: DataFrame, lists: DataFrame, name: str, how: str) -> DataFrame:
    """``rows`` (doc_id, text, text_id) joined with a list for each doc_id and text_id; both grow with the input, so they are merged at every size."""
    side = lists.select(F.col("doc_id").alias("_id"), F.col("text_id").alias("_text_id"), name)
    same = (F.col("doc_id") == F.col("_id")) & (F.col("text_id") == F.col("_text_id"))
    return rows.join(side.hint("merge"), same, how).drop("_id", "_text_id")


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """anchor, n_contents, doc_id, text_id, start and words (joined by spaces) of the ``wanted`` segments (anchor, n_contents, doc_id, text_id, start, size)."""
    lists = cut(wanted.groupBy("doc_id", "text_id").agg(F.collect_list(F.struct("anchor", "n_contents", "start", "size")).alias("parts")))
    columns = ["anchor", "n_contents", "doc_id", "text_id", "start", "words"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for piece in chunks(batches):
            out = []
            for doc_id, text_id, text, parts in zip(piece["doc_id"], piece["text_id"], piece["text"], piece["parts"], strict=True):
                words = text.encode("utf-8", "replace").split()
                out += [(p["anchor"], p["n_contents"], doc_id, text_id, p["start"], b" ".join(words[p["start"] : p["start"] + p["size"]])) for p in parts]
            yield pd.DataFrame(out, columns=columns)

    joined = _to_documents(_rows(docs).where("doc_id is not null"), lists, "parts", "inner")
    texts = joined.mapInPandas(run, "anchor long, n_contents long, doc_id long, text_id long, start int, words binary")
    return cut(texts.dropDuplicates(["anchor", "doc_id", "text_id", "start"]))


def _halves(texts: DataFrame, window: int) -> DataFrame:
    """half, anchor, doc_id, text_id, start and words of every segment, parted into the windows that reach far left of the gram and the others.

    ``half`` hashes the words that all windows of a part hold, counted from the gram: the gram with more than half of a window's other words on its left, or with
    the rest on its right. Equal windows have their gram at equal distances, so they lie in parts of one ``half``.
    """
    middle = (window - GRAM) // 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), 2048):
                part = batch.iloc[i : i + 2048]
                hashes, owner, _ = split_words([w.decode("utf-8") for w in part["words"]])
                starts, place, _ = anchors(hashes, owner, window)
                if not len(starts):
                    continue
                left = place - starts > middle
                first = np.flatnonzero(np.append(True, (left[1:] != left[:-1]) | (owner[starts[1:]] != owner[starts[:-1]])))
                begin, end = starts[first], starts[np.append(first[1:], len(starts)) - 1] + window
                gram, left, of = place[first], left[first], owner[starts[first]]
                low, high = np.where(left, gram - middle - 1, gram), np.where(left, gram + GRAM, gram + window - middle)
                from_text = np.searchsorted(owner, np.arange(len(part)))[of]
                mine = part.iloc[of]
                words = [w.split()[b:e] for w, b, e in zip(mine["words"], begin - from_text, end - from_text, strict=True)]
                yield pd.DataFrame({"half": ranges_hash(hashes, low, high).view(np.int64), **{c: mine[c].to_numpy() for c in ("anchor", "doc_id", "text_id", "start")}, "words": [b" ".join(w) for w in words]})

    return texts.mapInPandas(run, "half long, anchor long, doc_id long, text_id long, start int, words binary")


def _may_share(texts: DataFrame, window: int) -> DataFrame:
    """The parts of segments (:func:`_halves`) whose common words stand in parts of other documents too; no other window can be shared."""
    # both sides written before the join, so that the join stands alone and Spark can split a half's rows
    halves = cut(_halves(texts, window))
    shared = cut(halves.groupBy("half").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select(F.col("half").alias("_half")))
    return halves.join(shared.hint("merge"), F.col("half") == F.col("_half"), "left_semi").drop("half")


def _owners(texts: DataFrame, window: int) -> DataFrame:
    """anchor, doc_id, text_id and start of those segments that are the first to hold a window that another one holds.

    A segment has ``window - GRAM + 1`` windows at most. Only those of halves that several documents hold are handed on.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), 2048):
                part = batch.iloc[i : i + 2048]
                hashes, owner, _ = split_words([w.decode("utf-8") for w in part["words"]])
                starts = np.arange(max(0, len(hashes) - window + 1))
                starts = starts[owner[starts] == owner[starts + window - 1]]
                mine = part.iloc[owner[starts]]
                found = ranges_hash(hashes, starts, starts + window)
                yield pd.DataFrame({"found": found.view(np.int64), **{c: mine[c].to_numpy() for c in ("anchor", "doc_id", "text_id", "start")}})

    windows = _may_share(texts, window).mapInPandas(run, "found long, anchor long, doc_id long, text_id long, start int")
    first = windows.groupBy("found").agg(F.min(F.struct("doc_id", "text_id", "start", "anchor")).alias("own"), F.max("doc_id").alias("last")).where("own.doc_id < last")
    return first.select("own.anchor", "own.doc_id", "own.text_id", "own.start").distinct()


def _matched(texts: DataFrame, window: int) -> DataFrame:
    """doc_id, text_id, begin and end of the spans of segments that occur in segments of the same unit with a smaller doc_id.

    ``texts``: unit, doc_id, text_id, start, words, reference, asked. In each unit segments pass in order of doc_id: a
    segment that asks is streamed through the automaton of the references before it, and one that is a reference is then added to it.
    """
    calls = max(1, texts.count() // CALL_SEGMENTS)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        rows = rows.sort_values(["unit", "doc_id", "text_id", "start"], kind="stable")
        for _, unit in rows.groupby("unit", sort=False):
            automaton, waiting, before = SuffixAutomaton(), [], None
            for doc_id, text_id, start, words, reference, asked in zip(*(unit[c] for c in ("doc_id", "text_id", "start", "words", "reference", "asked")), strict=True):
                if doc_id != before:
                    for sequence in waiting:
                        automaton.add(sequence)
                    waiting, before = [], doc_id
                sequence = words.split()
                if asked:
                    out += [(doc_id, text_id, start + b, start + e) for b, e in automaton.spans(sequence, window)]
                if reference:
                    waiting.append(sequence)
        return pd.DataFrame(out, columns=["doc_id", "text_id", "begin", "end"])

    dealt = texts.withColumn("call", F.pmod(F.xxhash64("unit", F.lit(3)), F.lit(calls)))
    return dealt.groupBy("call").applyInPandas(run, "doc_id long, text_id long, begin int, end int")


def repeated_spans(docs: DataFrame, *, window: int = 50) -> DataFrame:
    """doc_id, text_id and ``spans`` (begin, end in words) that hold every window that also starts in a document with a smaller doc_id.

    1. Every text is cut into segments (:func:`segments`); those of different documents with one anchor may
       share windows. An equal segment of a smaller doc_id settles a segment without looking at words.
    2. The other segments of such anchors, one for each content, are the reference shards: the words of an
       anchor's segments make a suffix automaton, through which they are streamed in order of doc_id
       for their matching statistics. Maximal spans of at least ``window`` matching words are repeated.
    3. An anchor with more than MANY_SEGMENTS contents, as of a passage that very many documents quote, is
       not left to one task: hashes of windows, of those alone half of whose words other documents hold too, name the segments that first
       hold a shared window. These alone are its references. References and segments are both dealt into parts, and a unit is
       one part of either, so that a unit stays small however many there are.
    """
    found = cut(segments(docs, window))
    # written before the joins, so that a join stands alone in its stage and Spark can split an anchor's rows;
    # both sides grow with the input, so they are merged at every size
    shared = cut(found.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select(F.col("anchor").alias("_anchor")))
    met = cut(found.join(shared.hint("merge"), F.col("anchor") == F.col("_anchor"), "left_semi"))
    contents = cut(met.groupBy("anchor", "content").agg(F.min("doc_id").alias("first_id")))
    keys = contents.select(F.col("anchor").alias("_anchor"), F.col("content").alias("_content"), "first_id")
    placed = cut(met.join(keys.hint("merge"), (F.col("anchor") == F.col("_anchor")) & (F.col("content") == F.col("_content"))).drop("_anchor", "_content"))
    settled = placed.where("doc_id > first_id").select("doc_id", "text_id", F.col("start").alias("begin"), (F.col("start") + F.col("size")).alias("end"))

    several = cut(contents.groupBy("anchor").agg(F.count(F.lit(1)).alias("n_contents")).where("n_contents > 1").select(F.col("anchor").alias("_anchor"), "n_contents"))
    open_ = placed.where("doc_id = first_id").join(several.hint("merge"), F.col("anchor") == F.col("_anchor")).select("anchor", "doc_id", "text_id", "start", "size", "n_contents")
    open_ = cut(open_)
    texts = _texts_of(docs, open_)
    place = ["doc_id", "text_id", "start", "words"]
    few = texts.where(F.col("n_contents") <= MANY_SEGMENTS).select(F.col("anchor").alias("unit"), *place, F.lit(True).alias("reference"), F.lit(True).alias("asked"))
    many = texts.where(F.col("n_contents") > MANY_SEGMENTS)
    owners = cut(_owners(many.drop("n_contents"), window)).select(*[F.col(c).alias(f"_{c}") for c in ("anchor", "doc_id", "text_id", "start")])
    same = (F.col("anchor") == F.col("_anchor")) & (F.col("doc_id") == F.col("_doc_id")) & (F.col("text_id") == F.col("_text_id")) & (F.col("start") == F.col("_start"))
    flagged = cut(many.join(owners, same, "left").withColumn("reference", F.col("_anchor").isNotNull()).drop("_anchor", "_doc_id", "_text_id", "_start"))
    held = cut(flagged.groupBy("anchor").agg(F.count_if("reference").alias("n_references")).select(F.col("anchor").alias("_anchor"), "n_references"))
    sized = flagged.join(held, F.col("anchor") == F.col("_anchor")).drop("_anchor")
    asking, referring = F.ceil(F.col("n_contents") / MANY_SEGMENTS).cast("int"), F.greatest(F.lit(1), F.ceil(F.col("n_references") / MANY_SEGMENTS)).cast("int")
    mine = F.pmod(F.xxhash64("doc_id", "text_id", "start"), asking).cast("int")
    my_reference = F.pmod(F.xxhash64("doc_id", "text_id", "start", F.lit(5)), referring).cast("int")
    asks = sized.withColumn("_other", F.explode(F.sequence(F.lit(0), referring - 1))).select("anchor", mine.alias("a"), F.col("_other").alias("r"), *place, F.lit(False).alias("reference"), F.lit(True).alias("asked"))
    refers = sized.where("reference").withColumn("_other", F.explode(F.sequence(F.lit(0), asking - 1))).select("anchor", F.col("_other").alias("a"), my_reference.alias("r"), *place, F.lit(True).alias("reference"), F.lit(False).alias("asked"))
    dealt = asks.unionByName(refers).select(F.xxhash64("anchor", "a", "r").alias("unit"), *place, "reference", "asked")
    matched = _matched(cut(few.unionByName(dealt)), window)
    spans = settled.unionByName(matched)
    return cut(spans.groupBy("doc_id", "text_id").agg(F.sort_array(F.collect_set(F.struct("begin", "end"))).alias("spans")))


def remove_repeats(docs: DataFrame, *, window: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, spans (merged) and kept (the other words, joined by spaces) of every row of ``docs``.

    Words are maximal runs of characters other than ASCII white space. A word goes if a window of ``window``
    consecutive words that covers it also starts in a document with a smaller doc_id; windows are judged on the texts as
    they come, whole.

    Null or empty text: no words. Rows with a null doc_id are returned unchanged and compared with nothing.
    Rows that share a doc_id aren't each other's smaller document, and each loses only what its own text has in common with smaller ones. Empty table: empty
    result. Columns other than doc_id and text aren't read.
    """
    joined = _to_documents(_rows(docs), repeated_spans(docs, window=window), "spans", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for piece in chunks(batches):
            out = []
            for text, spans in zip(piece["text"], piece["spans"], strict=True):
                words = text.encode("utf-8", "replace").split()
                merged: list[list[int]] = []
                for s in spans if spans is not None else ():
                    if merged and s["begin"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s["end"])
                    else:
                        merged.append([s["begin"], s["end"]])
                n, kept, at = len(words), [], 0
                for begin, end in merged:
                    kept += words[at:begin]
                    at = end
                kept += words[at:]
                out.append((n, n - len(kept), [{"begin": b, "end": e} for b, e in merged], b" ".join(kept).decode("utf-8")))
            done = pd.DataFrame(out, columns=["n_words", "n_removed", "spans", "kept"])
            done.insert(0, "doc_id", piece["doc_id"].astype("Int64"))
            yield done

    return joined.mapInPandas(run, "doc_id long, n_words long, n_removed long, spans array<struct<begin:int,end:int>>, kept string")
