"""Personal data: patterns, and terms that give away which person a text is about. DataFrame functions only.

Protected entities are the addresses and numbers that the patterns find. Words near an entity's mentions may tell who it is as well as
the entity does. How well is estimated from the corpus: the pointwise mutual information of a term and an entity, as a
share of the information that the entity itself has. Terms over a threshold are generalised, over a higher one removed,
wherever they stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import cut

#: Fixed by the contract, in the order in which spans of one start are listed. A match may begin where the one before ended or where no
#: character of its first run comes before; parts that can't give characters back are possessive, so time is linear in the text. Runs of
#: digits match whole or not at all, so those of other lengths than a card's are left out here.
LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A part of an address of at most 255, leading zeros allowed.
PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?|)"
TERM_CLASS = r"[\p{L}\p{N}]"
#: Matches that are placed together.
TOGETHER = 128
#: Terms up to this many bytes are broadcast; more are joined by shuffling.
BROADCAST_BYTES = 32 << 20


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Whether the digits pass Luhn's check: every second from the right counts double, less 9 if over 9."""
    doubled = lambda x, i: F.when(i % 2 == 1, x * 2 - F.when(x > 4, 9).otherwise(0)).otherwise(x)
    from_right = F.transform(F.split(F.reverse(_digits(value)), "(?<=[0-9])(?=[0-9])"), lambda x: x.cast("int"))
    return F.aggregate(F.transform(from_right, doubled), F.lit(0), lambda a, x: a + x) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    """Whether a match of the kind's pattern counts."""
    if kind == "ip":
        return value.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    if kind == "card":
        return F.when(F.length(_digits(value)).between(14, 19), _luhn(value)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def _spans(gaps: Column, matches: Column, kind: str, order: int) -> Column:
    """Start, place of the kind, kind, end and value of matches, from what lies between them; places count code points."""
    empty = F.array().cast("array<struct<start:int,place:int,kind:string,end:int,value:string>>")

    def step(at: Column, pair: Column) -> Column:
        start = at["pos"] + F.length(pair["gap"])
        end = start + F.length(pair["match"])
        span = F.struct(start.alias("start"), F.lit(order).alias("place"), F.lit(kind).alias("kind"), end.alias("end"), pair["match"].alias("value"))
        return F.struct(end.alias("pos"), F.when(pair["match"].isNull(), at["spans"]).otherwise(F.concat(at["spans"], F.array(span))).alias("spans"))

    # runs of TOGETHER matches first, so that long lists are not copied for each match
    pairs = F.zip_with(gaps, matches, lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(gaps) - 1) / TOGETHER).cast("int")), lambda b: F.slice(pairs, b * TOGETHER + 1, F.lit(TOGETHER)))
    length = lambda block: F.aggregate(block, F.lit(0), lambda a, p: a + F.length(p["gap"]) + F.coalesce(F.length(p["match"]), F.lit(0)))
    ahead = lambda at, n: F.struct((at["pos"] + n).alias("pos"), F.concat(at["starts"], F.array(at["pos"])).alias("starts"))
    starts = F.aggregate(F.transform(blocks, length), F.struct(F.lit(0).alias("pos"), F.array().cast("array<int>").alias("starts")), ahead, lambda at: at["starts"])
    inside = F.zip_with(blocks, starts, lambda block, start: F.aggregate(block, F.struct(start.alias("pos"), empty.alias("spans")), step, lambda at: at["spans"]))
    return F.when(F.size(matches) == 0, empty).otherwise(F.flatten(inside))


def _located(text: Column, pattern: Column, gaps: Column, kind: str, order: int) -> Column:
    matches = F.when(F.size(gaps) > 1, F.regexp_extract_all(text, pattern, F.lit(0))).otherwise(F.array().cast("array<string>"))
    return _spans(gaps, matches, kind, order)


def _valid(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: _holds(kind, s["value"]))


def base_spans(rows: DataFrame) -> DataFrame:
    """``rows`` (doc: a struct, text without nulls) with n_email, n_ip, n_card, n_phone and ``base``, the spans by start and kind."""
    split = rows.withColumns({f"gaps_{k}": F.split("text", p, -1) for k, p in PATTERNS.items()})
    found = split.withColumns({k: _located(F.col("text"), F.lit(p), F.col(f"gaps_{k}"), k, i) for i, (k, p) in enumerate(PATTERNS.items())})
    good = found.withColumns({k: _valid(F.col(k), k) for k in PATTERNS})
    counts = {f"n_{k}": F.size(k).cast("bigint") for k in PATTERNS}
    return good.withColumns({**counts, "base": F.array_sort(F.concat(*PATTERNS))}).select(*rows.columns, *counts, "base")


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _rows(docs: DataFrame) -> DataFrame:
    """The documents in a struct, with a key (doc_id, or a hash of a text that has none) and their text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text-"), F.xxhash64(text).cast("string")))
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), key.alias("key"), text.alias("text"))


def mentions(found: DataFrame, *, reach: int = 100) -> DataFrame:
    """entity, key, context and terms of each mention in ``found`` (key, text, base): the terms within ``reach`` code points of it.

    Words that the reach cuts, and other entities, are no terms; a context is the hash of what stands around the mention.
    """
    mention = found.where(F.size("base") > 0).select("key", "text", F.explode("base").alias("span"))
    start, end = F.col("span.start"), F.col("span.end")
    left = F.substr("text", F.greatest(start - reach, F.lit(0)) + 1, F.least(start, F.lit(reach)))
    right = F.substr("text", end + 1, F.lit(reach))
    whole = F.concat(F.when(start > reach, F.regexp_replace(left, r"^[^\x20\x09-\x0D]+", "")).otherwise(left), F.lit(" "), F.when(F.length("text") > end + reach, F.regexp_replace(right, r"[^\x20\x09-\x0D]+$", "")).otherwise(right))
    for pattern in PATTERNS.values():
        whole = F.regexp_replace(whole, pattern, " ")
    value = F.lower(F.when(F.col("span.kind").isin("card", "phone"), _digits(F.col("span.value"))).otherwise(F.col("span.value")))
    terms = F.array_distinct(F.regexp_extract_all(F.lower(whole), F.lit(TERM_CLASS + "{3,}"), F.lit(0)))
    return mention.select(F.concat_ws(":", "span.kind", value).alias("entity"), "key", F.xxhash64(left, right).alias("context"), terms.alias("terms"))


def _of_terms(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """The tokens (column term) that are among ``terms``: broadcast if these are few by count, else joined by shuffling."""
    size = terms.agg(F.coalesce(F.sum(F.octet_length("term") + 64), F.lit(0))).first()[0]
    return tokens.join(F.broadcast(terms) if size <= BROADCAST_BYTES else terms, "term")


def disclosing_terms(rows: DataFrame, found: DataFrame, *, generalise: float = 0.8, remove: float = 0.9, min_contexts: int = 3) -> DataFrame:
    """term and strength (1: it tells as much as the entity itself) of terms that give away an entity, with action ``generalise`` or ``remove``.

    With documents as the unit, strength is log(co N / (c t)) / log(N / c): of N documents c mention the entity, t hold the term,
    and co have it near a mention. A pair needs ``min_contexts`` different contexts, so copies of one text are no evidence.
    """
    spark = rows.sparkSession
    n = float(rows.count())
    mentioned = cut(mentions(found))
    near = mentioned.select("entity", "key", "context", F.explode("terms").alias("term"))
    in_docs = near.groupBy("entity", "term", "key").agg(F.min("context").alias("context"))
    by_context = in_docs.groupBy("entity", "term", "context").agg(F.count(F.lit(1)).alias("co"))
    pairs = by_context.groupBy("entity", "term").agg(F.sum("co").alias("co"), F.count(F.lit(1)).alias("contexts")).where(F.col("contexts") >= min_contexts)
    known = mentioned.select("entity", "key").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") < n)
    # documents that hold a term are no fewer than those that have it near any mention: terms that are too common by this count alone go
    least = near.select("term", "key").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("t"))
    strength = F.log(F.col("co") * F.lit(n) / (F.col("c").cast("double") * F.col("t"))) / F.log(F.lit(n) / F.col("c"))
    likely = cut(pairs.join(known, "entity").join(least, "term").where(strength >= generalise).select("entity", "term", "co", "c"))
    if likely.isEmpty():
        return spark.createDataFrame([], "term string, strength double, action string")
    held = rows.select(F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("t"))
    rated = likely.join(held, "term").withColumn("strength", strength)
    best = rated.groupBy("term").agg(F.max("strength").alias("strength")).where(F.col("strength") >= generalise)
    return cut(best.withColumn("action", F.when(F.col("strength") >= remove, "remove").otherwise("generalise")))


def _term_spans(found: DataFrame, rows: DataFrame, terms: DataFrame) -> DataFrame:
    """``found`` with ``extra``: the spans of disclosing terms that no base span touches."""
    none = F.array().cast("array<struct<start:int,place:int,kind:string,end:int,value:string>>")
    if terms.isEmpty():
        return found.withColumn("extra", none)
    tokens = rows.select("key", F.explode(F.array_distinct(F.split("text", r"[^\p{L}\p{N}]+"))).alias("surface")).withColumn("term", F.lower("surface"))
    hits = cut(_of_terms(tokens, terms).groupBy("key").agg(F.collect_set(F.when(F.col("action") == "remove", F.col("surface"))).alias("removed"), F.collect_set("surface").alias("surfaces")))
    size = hits.agg(F.coalesce(F.sum(F.octet_length(F.array_join("surfaces", ",")) + 200), F.lit(0))).first()[0]
    joined = found.join((F.broadcast(hits) if size <= BROADCAST_BYTES else hits).withColumnRenamed("key", "hit"), F.col("key") == F.col("hit"), "left")
    pattern = F.concat(F.lit(f"(?<!{TERM_CLASS})(?:"), F.array_join("surfaces", "|"), F.lit(f")(?!{TERM_CLASS})"))
    gaps = joined.withColumn("pattern", F.when(F.col("hit").isNotNull(), pattern)).withColumn("gaps", F.when(F.col("hit").isNotNull(), F.split("text", F.col("pattern"), F.lit(-1))))
    spans = F.when(F.col("hit").isNotNull(), _located(F.col("text"), F.col("pattern"), F.col("gaps"), "term", len(PATTERNS))).otherwise(none)
    named = F.transform("spans", lambda s: s.withField("kind", F.when(F.array_contains("removed", s["value"]), "term").otherwise("general")))
    free = F.filter(named, lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return gaps.withColumn("spans", spans).withColumn("extra", free).select(*found.columns, "extra")


def sanitise(docs: DataFrame, **thresholds) -> DataFrame:
    """``docs`` (doc_id, text) with n_email, n_ip, n_card, n_phone, base, spans and sanitised.

    ``base`` and ``spans`` list kind:start:end of the patterns, and of these and of disclosing terms; start and end count code points, end
    excluded. In ``sanitised`` patterns are replaced by their kind in brackets; disclosing terms become ``[term]`` where they are
    generalised (kind general) and go where they are removed (kind term). ``thresholds``: those of :func:`disclosing_terms`.
    A null or empty text has no spans. Rows that repeat a doc_id keep their own spans and count as one document in the estimates; rows without one
    are known by their text. Other columns stay, whatever their names, but for those named above. An empty table gives an empty one.
    """
    rows = _rows(docs)
    found = base_spans(rows)
    terms = disclosing_terms(rows, found, **thresholds)
    full = _term_spans(found, rows, terms).withColumn("all", F.array_sort(F.concat("base", "extra")))
    mark = lambda s: F.when(s["kind"] == "term", "").when(s["kind"] == "general", "[term]").otherwise(F.concat(F.lit("["), s["kind"], F.lit("]")))
    step = lambda at, s: F.struct(F.greatest(at["pos"], s["end"]).alias("pos"), F.concat(at["out"], F.substr("text", at["pos"] + 1, F.greatest(s["start"] - at["pos"], F.lit(0))), F.when(s["start"] >= at["pos"], mark(s)).otherwise("")).alias("out"))
    clean = F.aggregate("all", F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")), step, lambda at: F.concat(at["out"], F.substr("text", at["pos"] + 1)))
    counts = [f"n_{k}" for k in PATTERNS]
    new = [*counts, "base", "spans", "sanitised"]
    kept = [F.col("doc").getField(c).alias(c) for c in docs.columns if c.lower() not in new]
    return full.select(*kept, *counts, listed(F.col("base")).alias("base"), listed(F.col("all")).alias("spans"), clean.alias("sanitised"))
