"""Main text of web pages: flat text blocks classified by a decision tree."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html import unescape

import pandas as pd
from pyspark.ml.classification import DecisionTreeClassificationModel, DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .labelled_pages import MARK, PAGES, SIZES

#: Words from which a block is running text.
RUNNING = 12

# Elements and words of HTML.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCOPES = frozenset("article aside body details dialog div dl fieldset figure footer form header main menu nav ol section table td th ul".split())
#: Elements whose content is no text but, unlike raw text, ends with their parent.
HIDDEN_TAGS = frozenset("svg select button audio video canvas".split())
#: What an end tag of another element, or a made-up one, doesn't reach beyond.
WALLS = SCOPES | HIDDEN_TAGS
BOILER_TAGS = frozenset("aside dialog fieldset footer form menu nav".split())
MAIN_TAGS = frozenset("article main".split())
BOILER_WORDS = frozenset(
    "ad ads adv advert advertisement advertising adsense banner bookmarks breadcrumb breadcrumbs comment comments consent cookie cookies copyright discussion disqus "
    "dropdown footer form gdpr login masthead menu menubar modal nav navbar navigation newsletter notice outbrain pager pagination popup promo promoted promotion related "
    "recommended reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe taboola tags toolbar widget".split()
)
MAIN_WORDS = frozenset("article body content entry main post story text".split())
UPPER_WORDS = frozenset("header head top meta".split())

#: Names with such words say what an element goes without, or a state or topic of it: "no-sidebar", "ad-free", "comments-open", "tag-search".
ASIDE_FIRST = frozenset("no non not without has with is hide category cat tag type format status".split())
ASIDE_LAST = frozenset("free open opened closed enabled disabled on off allowed less".split())

#: Comments, declarations, elements of raw text (which run to the page's end without an end tag), and tags. Outside quotes a
#: tag holds no "<", and what has matched is not tried anew, so unclosed tags take time in proportion to the page.
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^<>]*>"
    r"|<(script|style|noscript|template|textarea|iframe|title)(?=[\s/>])[^<>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:\"[^\"]*+\"|'[^']*+'|[^<>\"'])*+)>"
    r"|</?[a-zA-Z][^<>]*>",
    re.S | re.I,
)
HINT = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HINT_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")


def hints(tag: str, attributes: str, in_main: bool) -> tuple[bool, bool]:
    """Whether an element looks like it holds boilerplate, and like it holds the main text.

    Each class, id or role is read as a whole: one that says what the element goes without, or a state of it, says nothing.
    """
    found: set[str] = set()
    if "=" in attributes and tag not in ("body", "html", "main"):
        for m in HINT.finditer(attributes):
            for name in (m[1] or m[2] or m[3] or "").split():
                parts = [w.lower() for w in HINT_WORD.findall(name)]
                if len(parts) < 2 or parts[0] not in ASIDE_FIRST and parts[-1] not in ASIDE_LAST:
                    found.update(parts)
    boiler = tag in BOILER_TAGS or bool(found & BOILER_WORDS)
    main = tag in MAIN_TAGS or not boiler and bool(found & MAIN_WORDS)
    if not main and not in_main and (tag == "header" or found & UPPER_WORDS):
        boiler = True
    return boiler, main


def blocks(html: str) -> list[dict]:
    """The text blocks of a page in order: text, n_words, n_linked, apart, main, heading and scope_links.

    ``apart``: how much of the page's running text stands outside an element around the block that is named like boilerplate, from 0 (none, so
    the element holds the page's text, whatever its name) to 1; the highest of several elements, 0 without one. ``main``: whether an element around it looks
    like the main part. ``scope_links``: the share of linked words of the element that the block stands in.

    A block ends at every block-level tag; ``<br>`` is white space. Character references are decoded,
    white space becomes one space, and blocks without text are left out. Missing end tags are
    made up for: a block-level tag ends an open paragraph, an end tag what is open inside it. HIDDEN_TAGS hide what is inside them;
    one without its own end tag hides only what comes before the next block-level tag or its parent's end.
    """
    unclosed: set[int] = set()
    while True:
        out, found = _walk(html, unclosed)
        if not found:
            return out
        unclosed |= found


class Named:
    """The elements of a page that are named like boilerplate: a tree under the page itself, number 0."""

    def __init__(self) -> None:
        self.above, self.main, self.now = [0], [False], 0

    def enter(self, main: bool) -> None:
        self.above.append(self.now)
        self.main.append(main)
        self.now = len(self.above) - 1

    def shares(self, blocks: list[dict]) -> list[float]:
        """How much of the running text stands outside each element and outside others that are boilerplate by name, 1 if it has what looks like the main part.

        Running text are blocks of RUNNING words or more, or in what looks like the main part, of which at most a third are linked; on a page without any,
        all words that aren't linked.
        """
        running = [b["n_words"] - b["n_linked"] if (b["main"] or b["n_words"] >= RUNNING) and 3 * b["n_linked"] <= b["n_words"] else 0 for b in blocks]
        if not any(running):
            running = [b["n_words"] - b["n_linked"] for b in blocks]
        n = len(self.above)
        free, inside, main_free, main_inside = ([0] * n for _ in range(4))
        for b, words in zip(blocks, running, strict=True):
            for total, part in ((free, words), (inside, words), (main_free, words * b["main"]), (main_inside, words * b["main"])):
                total[b["apart"]] += part
        for i in range(n - 1, 0, -1):
            up = self.above[i]
            inside[up] += inside[i]
            main_inside[up] += main_inside[i]
            if self.main[i]:  # an article counts as what it stands in, whatever its name
                free[up] += free[i]
                main_free[up] += main_free[i]
        out, main_out, share = [0] * n, [0] * n, [0.0] * n
        for i in range(1, n):
            up = self.above[i]
            out[i] = out[up] + free[up] - (free[i] if self.main[i] else 0)
            main_out[i] = main_out[up] + main_free[up] - (main_free[i] if self.main[i] else 0)
            alone = main_out[i] > 0 and not main_inside[i]
            mine = 1.0 if alone else out[i] / (out[i] + inside[i]) if out[i] else 0.0
            share[i] = max(mine, share[up])
        return share


def _walk(html: str, unclosed: set[int]) -> tuple[list[dict], set[int]]:
    """The blocks, and where elements of HIDDEN_TAGS begin that turned out to have no end tag, beside those known."""
    out: list[dict] = []
    opened: list[int] = []
    found: set[int] = set()
    named = Named()
    scopes = [[0, 0]]  # words and linked words that stand in each scope
    scope = [0]
    stack: list[tuple[str, int, bool]] = []
    places: dict[str, list[int]] = {}
    walls: list[int] = []
    early: list[int] = []
    parts: list[tuple[str, bool]] = []
    state = {"main": 0, "a": 0, "heading": 0, "hidden": 0}

    def count(entry: tuple[str, int, bool], by: int) -> None:
        tag, _, main = entry
        state["main"] += by * main
        state["a"] += by * (tag == "a")
        state["heading"] += by * (tag in HEADINGS)
        state["hidden"] += by * (tag in HIDDEN_TAGS)

    def flush() -> None:
        text = " ".join("".join(t for t, _ in parts).split())
        if text:
            linked = sum(len(t.split()) for t, link in parts if link)
            n = len(text.split())
            linked = min(linked, n)
            scopes[scope[-1]][0] += n
            scopes[scope[-1]][1] += linked
            out.append({"text": text, "n_words": n, "n_linked": linked, "apart": named.now, "main": int(state["main"] > 0), "heading": int(state["heading"] > 0), "scope_links": scope[-1]})
        parts.clear()

    def close(to: int, ended: bool = False) -> None:
        while len(stack) > to:
            tag = stack[-1][0]
            if tag in HIDDEN_TAGS:
                begin = opened.pop()
                if begin not in unclosed and not (ended and len(stack) == to + 1):
                    found.add(begin)
            places[tag].pop()
            for marks in (walls, early):
                if marks and marks[-1] == len(stack) - 1:
                    marks.pop()
            if tag in SCOPES:
                scope.pop()
            named.now = stack[-1][1]
            count(stack.pop(), -1)

    def last(tag: str, walled: bool, beyond: frozenset[str] = frozenset()) -> int:
        """The place of the innermost open element of this tag, if no wall is above it but those ``beyond``; -1 for none."""
        at = places.get(tag) or [-1]
        wall = len(walls) - 1
        while walled and wall >= 0 and stack[walls[wall]][0] in beyond:
            wall -= 1
        return -1 if walled and wall >= 0 and at[-1] < walls[wall] else at[-1]

    at = 0
    for m in MARKUP.finditer(html):
        if m.start() > at and not state["hidden"]:
            parts.append((unescape(html[at : m.start()]), state["a"] > 0))
        at = m.end()
        if m[3] is None:
            if m[1]:
                parts.append((" ", False))
            continue
        tag, closing = m[3].lower(), bool(m[2])
        block = tag in BLOCK_TAGS
        if block and early:
            close(early[0])
        if block and not state["hidden"]:
            flush()
        elif tag in HIDDEN_TAGS:
            parts.append((" ", False))
        elif tag == "br":
            parts.append((" ", False))
        if tag in VOID_TAGS:
            continue
        if closing:
            i = last(tag, tag not in WALLS)
            if i >= 0:
                close(i, True)
        else:
            if block and (i := last("p", True)) >= 0:
                close(i)
            if tag in ("li", "dt", "dd", "tr", "td", "th", "a") and (i := last(tag, True, frozenset({"td", "th"}) if tag == "tr" else frozenset())) >= 0:
                close(i)
            if m[4].endswith("/"):
                continue
            boiler, main = hints(tag, m[4], state["main"] > 0)
            entry = (tag, named.now, main)
            places.setdefault(tag, []).append(len(stack))
            if tag in WALLS:
                walls.append(len(stack))
            if tag in HIDDEN_TAGS:
                opened.append(m.start())
                if m.start() in unclosed:
                    early.append(len(stack))
            if tag in SCOPES:
                scope.append(len(scopes))
                scopes.append([0, 0])
            if tag == "main":  # whatever the elements around it are named, this is the main part
                named.now = 0
            elif boiler:
                named.enter(main)
            stack.append(entry)
            count(entry, 1)
    if at < len(html) and not state["hidden"]:
        parts.append((unescape(html[at:]), state["a"] > 0))
    flush()
    close(0)
    shares = named.shares(out)
    for b in out:
        n, linked = scopes[b["scope_links"]]
        b["apart"], b["scope_links"] = shares[b["apart"]], linked / n
    return out, found


BLOCK_SCHEMA = "array<struct<text:string,n_words:int,n_linked:int,apart:double,main:int,heading:int,scope_links:double>>"
OWN = ("n_words", "apart", "main", "heading", "scope_links")
FEATURES = [*OWN, "links", "words_before", "links_before", "words_after", "links_after"]


def written(page: str, size: float) -> str:
    """A labelled page with its words written out."""
    return re.sub(r"\{(\d+)\}", lambda m: " ".join(["word"] * max(1, round(int(m[1]) * size))), page)


def labelled_rows(pages: Sequence[str] = PAGES) -> list[tuple]:
    """FEATURES and label of every block of the labelled pages at each of SIZES; beyond a page's ends are no words and no links."""
    rows = []
    for page in pages:
        for size in SIZES:
            found = blocks(written(page, size))
            around = [(0, 0.0), *[(b["n_words"], b["n_linked"] / b["n_words"]) for b in found], (0, 0.0)]
            rows += [tuple(map(float, (*[b[n] for n in OWN], me[1], *before, *after, b["text"].startswith(MARK)))) for b, before, me, after in zip(found, around, around[1:], around[2:], strict=False)]
    return rows


def fit_tree(spark: SparkSession, rows: list[tuple] | None = None, *, depth: int = 6) -> DecisionTreeClassificationModel:
    """A decision tree over FEATURES, from the blocks of the labelled pages."""
    table = spark.createDataFrame(labelled_rows() if rows is None else rows, [*FEATURES, "label"])
    assembled = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(table).coalesce(1)
    return DecisionTreeClassifier(maxDepth=depth, maxBins=64, minInstancesPerNode=2, seed=1).fit(assembled)


def held_out_accuracy(spark: SparkSession, *, every: int = 3) -> float:
    """Share of blocks that a tree from the other pages judges right, on every ``every``-th page in turn."""
    right = total = 0
    for turn in range(every):
        model = fit_tree(spark, labelled_rows([p for i, p in enumerate(PAGES) if i % every != turn]))
        rows = spark.createDataFrame(labelled_rows([p for i, p in enumerate(PAGES) if i % every == turn]), [*FEATURES, "label"])
        good = F.count_if(tree_column(model, {f: F.col(f) for f in FEATURES}) == (F.col("label") > 0.5))
        n, ok = rows.agg(F.count(F.lit(1)), good).first()
        right, total = right + ok, total + n
    return right / total


def tree_column(model: DecisionTreeClassificationModel, feature: dict[str, Column]) -> Column:
    """The tree's prediction as a nested CASE over columns."""

    def branch(node) -> Column:
        if node.getClass().getSimpleName() == "LeafNode":
            return F.lit(node.prediction() > 0.5)
        split = node.split()
        return F.when(feature[FEATURES[split.featureIndex()]] <= F.lit(split.threshold()), branch(node.leftChild())).otherwise(branch(node.rightChild()))

    return branch(model._java_obj.rootNode())


def extract_blocks(pages: DataFrame, model: DecisionTreeClassificationModel | None = None, *, html: str = "html") -> DataFrame:
    """``pages`` with ``blocks``: text, word and link counts, container flags and ``kept`` of every text block.

    Python tasks only find the blocks; the features of neighbours and the tree are column expressions.
    Nothing is shuffled, and a page is never split.
    """
    model = fit_tree(pages.sparkSession) if model is None else model

    @F.pandas_udf(BLOCK_SCHEMA)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda page: blocks(page or ""))

    def judged(block: Column, i: Column) -> Column:
        share = lambda b: b["n_linked"] / b["n_words"]
        zero = F.lit(0.0)
        before, after = F.when(i > 0, F.get("_blocks", i - 1)), F.get("_blocks", i + 1)
        feature = {n: block[n].cast("double") for n in OWN} | {
            "links": share(block),
            "words_before": F.coalesce(before["n_words"].cast("double"), zero),
            "links_before": F.coalesce(share(before), zero),
            "words_after": F.coalesce(after["n_words"].cast("double"), zero),
            "links_after": F.coalesce(share(after), zero),
        }
        return F.struct(*[block[n].alias(n) for n in ("text", "n_linked", *OWN)], tree_column(model, feature).alias("kept"))

    found = pages.withColumn("_blocks", find(F.col(html)))
    return found.withColumn("blocks", F.transform("_blocks", judged)).drop("_blocks")


def main_text(pages: DataFrame, model: DecisionTreeClassificationModel | None = None) -> DataFrame:
    """page_id, url, text (the kept blocks in page order, joined by a line feed) and n_chars of every page.

    Null or empty html, or no block kept: an empty text. Rows stand alone: repeated rows give equal
    rows, an empty table gives none. Other columns, whatever their names, are not read.
    """
    found = extract_blocks(pages.select("page_id", "url", "html"), model)
    text = F.array_join(F.transform(F.filter("blocks", lambda b: b["kept"]), lambda b: b["text"]), "\n")
    return found.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("bigint"))
