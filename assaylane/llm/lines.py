"""Fuzzy line deduplication by MinHash, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..storage import cut, discard

#: Characters of a shingle, and MinHash bins in a band and bands: two lines of similarity 0.8 share a band
#: with probability 0.985, of 0.85 with 0.997, of 0.9 with 0.9998.
WIDTH, ROWS, BANDS = 8, 4, 8
#: Shingles, about, of a longer line that may hold a bin's least hash: a bin is left without one by chance ``exp(-SURVIVORS / 32)``.
SURVIVORS = 96
#: Leaders of a large bucket in the second round; buckets of no more members go to the last round, of all pairs, at once.
LEADERS = 16
#: 64-bit words of a line's mark, a bitmap of its shingles that rules pairs out.
WORDS = 64
#: Words of a mark that are made in one group; a group costs as much as many words.
LANES = 8
#: Members of a part of a large bucket in the last round; a part meets its whole bucket in a task.
TILE = 4096
#: Bytes up to which the removed lines are broadcast to the documents; above, both are shuffled.
BROADCAST_BYTES = 32 << 20
#: Fixed: the characters besides the line feed that make no word.
BLANKS = " \t\v\f\r"


def occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, pos (from 0), line (in small letters) and id (its hash) of all lines with a word.

    An id has 64 bits: among n different lines some ``n ** 2 / 2 ** 65`` pairs share one.
    """
    lines = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.posexplode(F.split(F.lower("text"), "\n")).alias("pos", "line"))
    return lines.where(F.ltrim("line", F.lit(BLANKS)) != "").select("doc_id", "pos", "line", F.xxhash64("line").alias("id"))


def _different(lines: DataFrame) -> DataFrame:
    """id and line, each id once, merged in the tasks that read them and then by a shuffle on id alone, which later aggregates by id need not repeat."""
    return lines.groupBy("id").agg(F.first("line").alias("line"))


def _places(wide: Column) -> Column:
    """The bytes, from 1, at which the shingles of a line in UTF-16 begin; a line of fewer than WIDTH characters is one shingle."""
    return F.sequence(F.lit(1), F.greatest(F.length(wide) - 2 * WIDTH + 1, F.lit(1)), F.lit(2))


def _shingle(wide: Column, at: Column) -> Column:
    """UTF-16 makes a shingle a slice of bytes."""
    return F.substring(wide, at, F.lit(2 * WIDTH))


def bands(lines: DataFrame) -> DataFrame:
    """key and id of every different line (id, line) and each of its bands.

    MinHash by one permutation: shingles' hashes are dealt into ROWS * BANDS bins, and a line's signature is the
    least hash of each bin; a band's key hashes ROWS bins. An empty bin, of a short line, counts as empty. Of a long
    line only hashes under a bound that leaves about SURVIVORS of them are looked at, since a greater one is hardly
    ever the least of a bin. Shingles are exploded and reduced in the tasks that read the lines, so that least hashes are shuffled and no
    text is; equal lines have equal ones and are merged with that. A line has two groups of bins, since a group costs as much as many
    bins. The bytes and the bound are made below the explode, or each shingle would make them anew.
    """
    wide = lines.select("id", F.encode("line", "UTF-16BE").alias("wide"))
    some = F.length("wide") / 2
    bound = F.when(some <= 2 * SURVIVORS, F.lit((1 << 31) - 1)).otherwise((F.lit(SURVIVORS * 2.0**32) / some - F.lit(2.0**31)).cast("int"))
    spread = wide.select("id", "wide", bound.alias("bound"), F.explode(_places(F.col("wide"))).alias("at"))
    hashed = spread.select("id", "bound", F.hash(_shingle(F.col("wide"), F.col("at"))).alias("h")).where("h <= bound")
    band, half, none = F.pmod("h", F.lit(BANDS)), BANDS // 2, F.lit((1 << 31) - 1)
    place = F.pmod(band, F.lit(half)) * ROWS + F.pmod(F.shiftright("h", 16), F.lit(ROWS))
    dealt = hashed.select("id", "h", (band >= half).alias("upper"), place.alias("place"))
    least = dealt.groupBy("id", "upper").agg(*[F.min(F.when(F.col("place") == i, F.col("h")).otherwise(none)).alias(f"least_{i}") for i in range(half * ROWS)])
    bins = [F.when(F.col(f"least_{i}") == none, F.lit(0)).otherwise(F.col(f"least_{i}")) for i in range(half * ROWS)]
    keys = []
    for b in range(half):
        own = bins[b * ROWS : (b + 1) * ROWS]
        key = F.xxhash64(F.lit(b) + F.when(F.col("upper"), F.lit(half)).otherwise(F.lit(0)), *own)
        # a band without a shingle has no key, or all lines with such a band would meet
        keys.append(F.when(F.least(*[F.col(f"least_{i}") for i in range(b * ROWS, (b + 1) * ROWS)]) < none, key).alias(f"key_{b}"))
    return least.select("id", *keys).select(F.explode(F.array(*[f"key_{b}" for b in range(half)])).alias("key"), "id").where("key is not null")


def shingle_set(wide: Column) -> Column:
    """The different hashes of the shingles of a line in UTF-16. The outer lambda holds the line's bytes, which each shingle would else copy anew."""
    hashes = F.transform(F.array(wide), lambda w: F.transform(_places(w), lambda at: F.xxhash64(_shingle(w, at))))
    return F.array_distinct(F.get(hashes, F.lit(0)))


def marks(texts: DataFrame) -> DataFrame:
    """id, n and mark of every line (id, wide): its number of different shingles, and WORDS words of a bitmap in which each of them flips a bit."""
    # the first elements stand for the groups of LANES words themselves, so that a group without a shingle is there too
    # dealt by id first, so that a line's words are made and brought together in one task
    groups = WORDS // LANES
    sets = texts.repartition("id").select("id", shingle_set(F.col("wide")).alias("of"))
    spread = sets.select("id", F.posexplode(F.concat(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<bigint>"), "of")).alias("at", "h"))
    shingle = F.col("at") >= groups
    group = F.when(shingle, F.pmod(F.shiftright("h", 9), F.lit(groups))).otherwise(F.col("h")).cast("int")
    bit = F.when(shingle, F.expr("shiftleft(1L, cast(h & 63 as int))")).otherwise(F.lit(0))
    placed = spread.select("id", group.alias("group"), F.pmod(F.shiftright("h", 6), F.lit(LANES)).alias("lane"), bit.alias("bit"), shingle.cast("int").alias("one"))
    lanes = [F.bit_xor(F.when(F.col("lane") == i, F.col("bit")).otherwise(F.lit(0))).alias(f"lane_{i}") for i in range(LANES)]
    several = placed.groupBy("id", "group").agg(F.sum("one").alias("n"), *lanes)
    words = F.sort_array(F.collect_list(F.struct("group", F.array(*[f"lane_{i}" for i in range(LANES)]).alias("bits"))))
    whole = several.groupBy("id").agg(F.sum("n").alias("n"), words.alias("words"))
    return cut(whole.select("id", "n", F.flatten("words.bits").alias("mark")))


def _may_be_near(threshold: float) -> Column:
    """Whether lines (n, mark) and (_n, _mark) can have the similarity ``threshold``, by their marks.

    Shingles that both lines have flip the same bits of both, so marks differ only in bits flipped by the d shingles of one line alone,
    and in at most d of them. Of sets with i common and u different elements in all, d = u - i and n + _n = u + i, and
    i >= t * u means d <= (n + _n) * (1 - t) / (1 + t). So no pair of the threshold is ruled out. Only shingles of one line alone
    can hide each other, so few pairs below it pass. Numbers of shingles, which differ by no more than d, are looked at first.
    A mark is one array: with a column for each word the comparison made a method too long for the JVM to compile.
    """
    room = (F.col("n") + F.col("_n")) * F.lit(1 - threshold) + F.lit(1e-6)
    each = F.zip_with("mark", "_mark", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    differ = F.aggregate(each, F.lit(0), lambda total, x: total + x)
    return (F.abs(F.col("n") - F.col("_n")) * F.lit(1 + threshold) <= room) & (differ * F.lit(1 + threshold) <= room)


def _other(rows: DataFrame) -> DataFrame:
    """``rows`` with an underscore before every name."""
    return rows.select(*[F.col(c).alias(f"_{c}") for c in rows.columns])


def _marked(rows: DataFrame, marked: DataFrame) -> DataFrame:
    """``rows`` with the number of shingles and the mark of their id."""
    known = marked.withColumnRenamed("id", "_of")
    return rows.join(known, F.col("id") == F.col("_of")).drop("_of")


def _meet(members: DataFrame) -> DataFrame:
    """``members`` (key, id) of buckets of two or more, with the bucket's leader.

    It is the member that meets the most others in all its buckets. In a family of edited copies that is a line of few edits, which
    more members are near to than to one drawn at random, and it leads most of its buckets, so that fewer pairs are compared.
    """
    several = cut(members.groupBy(F.col("key").alias("_key")).agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    met = cut(members.join(_small_enough(several, 64), F.col("key") == F.col("_key")).drop("_key"))
    weights = cut(met.groupBy(F.col("id").alias("_id")).agg(F.sum("size").alias("weight")))
    weighed = met.join(weights, F.col("id") == F.col("_id")).select("key", "id", "weight")
    # written before the join, so that the join stands alone in its stage and Spark can split a bucket's rows
    best = cut(weighed.groupBy(F.col("key").alias("_key")).agg(F.max(F.struct("weight", "id")).alias("best")))
    return met.join(best.select("_key", F.col("best.id").alias("leader")), F.col("key") == F.col("_key")).select("key", "id", "leader")


def _verify(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """a, b and near of the given pairs: whether the Jaccard similarity of their sets of shingles, by 64-bit hashes, reaches the threshold.

    Many pairs share b, so its set is made once; the text of a travels to it, which is shorter than a's set. A line a with too few
    places for the threshold makes no set.
    """
    pairs = cut(pairs)
    wanted = pairs.select(F.col("b").alias("_b")).distinct()
    right = cut(texts.join(wanted, F.col("id") == F.col("_b"), "left_semi").select(F.col("id").alias("_b"), shingle_set(F.col("wide")).alias("_of_b")))
    left = texts.select(F.col("id").alias("_a"), F.col("wide").alias("_wide"))
    both = pairs.join(left, F.col("a") == F.col("_a")).join(right, F.col("b") == F.col("_b"))
    enough = F.size(_places(F.col("_wide"))) + 1e-6 >= F.size("_of_b") * F.lit(threshold)
    sets = both.select("a", "b", F.when(enough, shingle_set(F.col("_wide"))).otherwise(F.array().cast("array<bigint>")).alias("_of_a"), "_of_b")
    counted = sets.select("a", "b", (F.size("_of_a") + F.size("_of_b")).alias("_n"), F.size(F.array_intersect("_of_a", "_of_b")).alias("_common"))
    found = cut(counted.select("a", "b", (F.col("_common") / (F.col("_n") - F.col("_common")) >= threshold).alias("near")))
    discard(pairs, right)
    return found


def _named(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members (key, id, root) of the buckets that hold lines of several components, with the bucket's size."""
    known = members.join(roots.select(F.col("node").alias("_node"), F.col("root").alias("_root")), F.col("id") == F.col("_node"), "left")
    named = cut(known.select("key", "id", F.coalesce("_root", "id").alias("root")))
    mixed = cut(named.groupBy("key").agg(F.min("root").alias("_low"), F.max("root").alias("_high"), F.count(F.lit(1)).alias("size")).where("_low < _high"))
    left = cut(named.join(mixed.select(F.col("key").alias("_key"), "size"), F.col("key") == F.col("_key")).drop("_key"))
    discard(named, mixed)
    return left


def line_components(lines: DataFrame, *, threshold: float = 0.8) -> DataFrame:
    """node and root for the ids of the ``lines`` (id, line) that are linked, over any number of links, by a similarity of at least ``threshold``.

    Lines that share a band key meet in a bucket. All members are compared with the bucket's leader: a
    group of copies of one line, however large, costs one comparison a member. Components are taken, and only buckets
    in which others than the leader, who has met all, are of several of them go on, since a comparison within a component can add nothing. In buckets of more than
    LEADERS members, LEADERS drawn by a hash, most of them from the bucket's largest component, meet all members of other components, and components
    are taken again: who has near ones there hardly stays outside, so that few are left to be compared one by one. At last all
    pairs of different components that still share a bucket are compared, so that all that is missed is what the bands miss. After the first round
    marks rule out pairs first, by some bit counts, and shingles are compared only where the marks allow the threshold. What is left grows
    with the square of a bucket whose lines are not near each other; a large bucket is dealt into parts for it.
    """
    keyed = cut(bands(lines))
    members = cut(_meet(keyed))
    discard(keyed)
    met = _few(lines.select("id", "line"), members.select("id").distinct())
    texts = cut(_different(met).select("id", F.encode("line", "UTF-16BE").alias("wide")))
    met = _verify(members.where("id <> leader").select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct(), texts, threshold)
    roots = connected_components(met.where("near").select("a", "b"))
    left = _named(members.where("id <> leader").select("key", "id"), roots)
    marked = marks(texts.join(left.select(F.col("id").alias("_id")).distinct(), F.col("id") == F.col("_id"), "left_semi"))
    slot = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(LEADERS))
    large = left.where(F.col("size") > LEADERS)
    leaders = large.groupBy("key", slot.alias("slot")).agg(F.min("id").alias("id"), F.min_by("root", "id").alias("root")).select("key", "id", "root")
    apart = (F.col("key") == F.col("_key")) & (F.col("root") != F.col("_root"))
    pairs = _unordered(_marked(large, marked).join(cut(_other(_marked(leaders, marked))), apart & _may_be_near(threshold)))
    more = _verify(pairs, texts, threshold)
    roots = _joined(more.where("near"), roots)
    done = met.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).unionByName(more.select("a", "b"))

    sized = cut(_marked(_named(left.select("key", "id"), roots), marked)).withColumn("parts", F.ceil(F.col("size") / TILE).cast("int"))
    mine = sized.withColumn("part", F.pmod(F.xxhash64("id", F.lit(7)), F.col("parts")).cast("int"))
    others = _other(sized.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))))
    pairs = _unordered(mine.join(others, apart & (F.col("part") == F.col("_part")) & (F.col("id") > F.col("_id")) & _may_be_near(threshold)))
    pairs = pairs.join(_other(done), (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left_anti")
    return _joined(_verify(pairs, texts, threshold).where("near"), roots)


def _unordered(met: DataFrame) -> DataFrame:
    """Every pair of id and _id once, as a and b."""
    return met.select(F.greatest("id", "_id").alias("a"), F.least("id", "_id").alias("b")).distinct()


def _joined(near: DataFrame, roots: DataFrame) -> DataFrame:
    """Components of the near pairs and of those known, which stay if there is no pair."""
    if near.isEmpty():
        return roots
    return connected_components(near.select("a", "b").unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))


def _small_enough(df: DataFrame, bytes_a_row: int) -> DataFrame:
    """``df``, marked for broadcast if its counted rows are within BROADCAST_BYTES."""
    return F.broadcast(df) if df.count() * bytes_a_row <= BROADCAST_BYTES else df


def _few(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The ``rows`` whose id is among ``ids``."""
    ids = cut(ids.withColumnRenamed("id", "_id"))
    return rows.join(_small_enough(ids, 64), F.col("id") == F.col("_id"), "left_semi")


def duplicate_lines(docs: DataFrame, *, threshold: float = 0.8, min_chars: int = 40) -> DataFrame:
    """doc_id and ``removed`` (pos and id), the lines that repeat an earlier one, for every document that has such lines.

    A class holds all occurrences of equal lines, however short, and of the lines of at least ``min_chars`` characters that
    :func:`line_components` joins. Its first occurrence, by doc_id and then by place, stays.
    """
    lines = cut(occurrences(docs))
    roots = line_components(lines.where(F.length("line") >= min_chars).select("id", "line"), threshold=threshold).select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    named = lines.select("doc_id", "pos", "id").join(roots.hint("shuffle_hash"), F.col("id") == F.col("_node"), "left")
    classed = cut(named.select("doc_id", "pos", "id", F.coalesce("_root", "id").alias("class")))
    discard(lines)
    spread = classed.groupBy("class", "doc_id").agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("n"))
    # written before the join, so that the join stands alone in its stage and Spark can split a class's rows
    first = spread.groupBy("class").agg(F.min("doc_id").alias("_first_id"), F.min_by("pos", "doc_id").alias("_first_pos"), F.sum("n").alias("n"))
    first = cut(first.where("n > 1").select(F.col("class").alias("_class"), "_first_id", "_first_pos"))
    repeated = classed.join(first.hint("shuffle_hash"), F.col("class") == F.col("_class")).where("doc_id <> _first_id or pos <> _first_pos")
    removed = cut(repeated.groupBy("doc_id").agg(F.collect_set(F.struct("pos", "id")).alias("removed")))
    discard(classed, first)
    return removed


def without_lines(docs: DataFrame, removed: DataFrame, *, n_lines: str | None = None, n_removed: str | None = None) -> DataFrame:
    """``docs`` without the lines that :func:`duplicate_lines` found, with columns named ``n_lines`` and ``n_removed`` if names are given.

    An added column replaces one of ``docs`` of its name. The removed lines are broadcast if their counted size is within
    BROADCAST_BYTES, and else joined by shuffling.
    """
    weight = removed.agg(F.sum(32 * F.size("removed") + 64)).first()[0] or 0
    gone = removed.select(F.col("doc_id").alias("_id"), F.col("removed").alias("_removed"))
    # rows travel in a struct, so that their columns can have any name
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_doc"), F.split("text", "\n").alias("_lines"))
    whole = rows.join(F.broadcast(gone) if weight <= BROADCAST_BYTES else gone, F.col("_doc") == F.col("_id"), "left")
    # rows that share a doc_id may have different texts: a place counts only where it holds the line that was found there
    found = F.filter("_removed", lambda r: F.xxhash64(F.lower(F.get("_lines", r["pos"]))) == r["id"])
    placed = whole.withColumn("_found", F.when(F.col("_removed").isNotNull(), F.transform(found, lambda r: r["pos"])))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_found"), lambda at: F.get("_lines", at))
    text = F.when(F.col("_found").isNull() | F.col("_row.text").isNull(), F.col("_row.text")).otherwise(F.array_join(kept, "\n"))
    added = {}
    if n_lines is not None:
        added[n_lines] = F.when(F.col("_row.text").isNull(), 0).otherwise(F.size("_lines"))
    if n_removed is not None:
        added[n_removed] = F.when(F.col("_found").isNull(), 0).otherwise(F.size("_found"))
    columns = [(text if c == "text" else F.col("_row")[c]).alias(c) for c in docs.columns if c not in added]
    return placed.select(*columns, *[v.alias(c) for c, v in added.items()])


def drop_duplicate_lines(docs: DataFrame, *, threshold: float = 0.8, min_chars: int = 40, n_lines: str | None = "n_lines", n_removed: str | None = "n_removed") -> DataFrame:
    """``docs`` without the lines that repeat an earlier one, with its columns, and n_lines and n_removed (None: without them).

    Lines are split at line feeds and compared in small letters. A line goes if an equal one comes earlier, by doc_id and then by place;
    lines of at least ``min_chars`` characters also if they are joined, over any number of links, to an earlier one by links
    of at least ``threshold`` Jaccard similarity of their sets of WIDTH-character shingles. Lines without a word stay. A document all of
    whose lines go stays with an empty text.

    Null text stays null. Rows with a null doc_id stay as they are, and nothing is compared
    with them. Rows that repeat a doc_id count as one document that has all their lines, and lines at one place as one occurrence.
    Empty table: empty result. Other columns pass through, but for those named like the added ones, which are replaced.
    """
    return without_lines(docs, duplicate_lines(docs, threshold=threshold, min_chars=min_chars), n_lines=n_lines, n_removed=n_removed)
