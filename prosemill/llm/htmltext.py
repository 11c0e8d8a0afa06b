"""Main text of web pages from flat text blocks and a decision tree.

A page is cut into flat blocks at block-level tags. Each block has its word
count and link density, those of its neighbours, and where it stands. A
decision tree, trained with MLlib on a small labelled table, tells the blocks
of the article from the rest.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "place")

#: Places: outside any article, inside one, inside a part that pages repeat or that isn't the author's.
PLAIN, ARTICLE, AROUND = 0.0, 1.0, 2.0
#: The mark of an element around by its class alone, which an article or main element in it undoes.
LOOSE = 3.0

#: The small labelled table: (words, link density, the same of the block before and after, place, 1 for main text).
LABELLED = (
    # pages without an article tag: long blocks with few links, and short ones between such blocks, are main text
    (40, 0.0, 25, 0.0, 35, 0.0, PLAIN, 1), (25, 0.0, 6, 0.9, 40, 0.0, PLAIN, 1), (60, 0.05, 40, 0.0, 3, 1.0, PLAIN, 1), (18, 0.0, 30, 0.0, 22, 0.0, PLAIN, 1),
    (8, 0.0, 35, 0.0, 45, 0.0, PLAIN, 1), (5, 0.0, 60, 0.0, 50, 0.0, PLAIN, 1), (12, 0.1, 28, 0.0, 33, 0.0, PLAIN, 1), (120, 0.02, 4, 1.0, 5, 1.0, PLAIN, 1),
    (30, 0.1, 0, 0.0, 0, 0.0, PLAIN, 1), (22, 0.0, 1, 1.0, 4, 0.5, PLAIN, 1), (80, 0.15, 18, 0.0, 26, 0.0, PLAIN, 1), (16, 0.0, 45, 0.0, 2, 0.0, PLAIN, 1),
    (1, 1.0, 1, 1.0, 1, 1.0, PLAIN, 0), (2, 1.0, 1, 1.0, 3, 1.0, PLAIN, 0), (3, 1.0, 40, 0.0, 2, 1.0, PLAIN, 0), (15, 0.9, 3, 1.0, 25, 0.0, PLAIN, 0),
    (30, 0.8, 60, 0.0, 4, 1.0, PLAIN, 0), (4, 0.0, 1, 1.0, 3, 1.0, PLAIN, 0), (6, 0.3, 2, 1.0, 0, 0.0, PLAIN, 0), (5, 0.0, 3, 1.0, 0, 0.0, PLAIN, 0),
    (7, 0.0, 2, 0.0, 4, 1.0, PLAIN, 0), (3, 0.0, 0, 0.0, 2, 1.0, PLAIN, 0), (45, 0.7, 30, 0.0, 30, 0.0, PLAIN, 0), (2, 0.0, 5, 0.6, 6, 0.4, PLAIN, 0),
    # inside an article all but link lists is main text, however short
    (2, 0.0, 0, 0.0, 40, 0.0, ARTICLE, 1), (1, 0.0, 3, 0.0, 2, 0.0, ARTICLE, 1), (11, 0.0, 4, 1.0, 50, 0.0, ARTICLE, 1), (90, 0.0, 11, 0.0, 60, 0.0, ARTICLE, 1),
    (55, 0.1, 90, 0.0, 14, 0.2, ARTICLE, 1), (3, 0.0, 55, 0.0, 10, 0.1, ARTICLE, 1), (200, 0.0, 2, 0.0, 3, 1.0, ARTICLE, 1), (9, 0.3, 12, 0.0, 20, 0.0, ARTICLE, 1),
    (4, 0.0, 2, 1.0, 2, 1.0, ARTICLE, 1), (30, 0.4, 8, 0.0, 6, 0.0, ARTICLE, 1), (1, 0.0, 0, 0.0, 0, 0.0, ARTICLE, 1), (7, 0.0, 60, 0.0, 9, 0.4, ARTICLE, 1),
    (2, 1.0, 3, 1.0, 2, 1.0, ARTICLE, 0), (12, 0.95, 60, 0.0, 4, 1.0, ARTICLE, 0), (1, 1.0, 40, 0.0, 1, 1.0, ARTICLE, 0), (5, 1.0, 5, 1.0, 0, 0.0, ARTICLE, 0),
    # menus, sidebars, adverts, notices, comments and footers never are, however long
    (9, 0.0, 2, 1.0, 40, 0.0, AROUND, 0), (40, 0.0, 3, 1.0, 11, 0.0, AROUND, 0), (60, 0.0, 55, 0.0, 30, 0.0, AROUND, 0), (1, 1.0, 1, 1.0, 1, 1.0, AROUND, 0),
    (25, 0.2, 60, 0.0, 8, 0.3, AROUND, 0), (120, 0.0, 90, 0.0, 12, 0.0, AROUND, 0), (3, 0.0, 40, 0.0, 0, 0.0, AROUND, 0), (14, 0.1, 40, 0.0, 0, 0.0, AROUND, 0),
)

#: HTML's elements by what they do to a flow of text.
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math mrow mi mn mo ms mtext msup msub msubsup mfrac msqrt mroot mover munder munderover mtable mtr mtd mstyle mspace semantics".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_AROUND = frozenset("nav header footer aside form button select option menu dialog noscript iframe object figcaption".split())
_SILENT = frozenset("head title template svg canvas audio video textarea".split())
#: Elements whose names tell where they stand; a heading's or paragraph's don't.
_CONTAINERS = frozenset("div section ul ol dl table tbody tr td th main article aside nav header footer form fieldset details".split())
#: Further parts that compound names of what stands around an article have: ad-slot, related-posts, site-header; but not social-history.
_FURNITURE = frozenset("slot slots box bar bars list lists link links button buttons icon icons section block area container wrap wrapper inner outer unit body item items post posts entry entries article articles story stories site page global main primary secondary top bottom left right small large big mobile desktop fixed sticky overlay field thread holder group row col column panel content text message form wp js".split())
#: Parts of class names: what stands around an article; of these, what holds items that are articles themselves; what an article is named.
_NAMES = re.compile(r"ad|ads|advert\w*|banner|promo\w*|sponsor\w*|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|side|footer|header|masthead|cookie\w*|consent|gdpr|notice|popup|modal|newsletter|subscribe|signup|share|sharing|social|related|recommend\w*|comment\w*|replies|reply|disqus|respond|widget\w*|pagination|pager|toolbar|login|search", re.I)
_LISTS = re.compile(r"ad|ads|advert\w*|promo\w*|sponsor\w*|related|recommend\w*|comment\w*|replies|reply|disqus|respond", re.I)
_ARTICLE_NAMES = re.compile(r"article|content|post|entry|story|main|body", re.I)
#: Class names that tell of a part of the page without being it: has-sidebar, comments-closed, content-sidebar-wrap.
_NEGATIONS = frozenset("has no not non with without".split())
_STATES = frozenset("open opened closed enabled disabled collapsed expanded visible layout page".split())
_WRAPPERS = frozenset("wrap wrapper container grid inner outer".split())
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile("[>\"']")
_CLOSE = {k: re.compile(rf"</{k}\s*>", re.I) for k in ("script", "style")}
#: A quoted value is this long at most; beyond, its quote is a stray character and the tag ends at the first >.
QUOTED = 1 << 16
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)


def _tag_end(page: str, at: int, stops: dict[str, int]) -> int:
    """Where the tag whose name ends at `at` has its >, outside quotes if these are closed. stops: where each mark is known to be absent from on."""
    i = at
    while i < stops[">"] and (m := _STOP.search(page, i)):
        if m[0] == ">":
            return m.start()
        if m.start() >= stops[m[0]]:
            break
        end = page.find(m[0], m.start() + 1, m.start() + 1 + QUOTED)
        if end < 0:
            if page.find(m[0], m.start() + 1) < 0:
                stops[m[0]] = m.start()
            break
        i = end + 1
    return page.find(">", at)


def parts_of(page: str) -> Iterator[tuple[str, str, str, str]]:
    """("text", text, "", "") and ("tag", "/" or "", name, attributes) in page order, without comments, declarations, scripts and styles.

    One pass forward: what isn't closed is a comment, script or style to the
    end, a tag that isn't is text.
    """
    n, at, seen = len(page), 0, 0
    last = page.rfind(">")
    stops = {">": last + 1, '"': n, "'": n}
    while (i := page.find("<", at)) >= 0:
        end = None
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            end = n if end < 0 else end + 3
        elif page.startswith("<![CDATA[", i):
            end = i + 9
        elif i > last:
            break  # no tag is closed from here on, but a comment may still begin
        elif page[i + 1 : i + 2] in ("!", "?"):
            end = page.find(">", i) + 1
        elif m := _NAME.match(page, i + 1):
            stop = _tag_end(page, m.end(), stops)
            if i > seen:
                yield "text", page[seen:i], "", ""
            name = m[2].lower()
            at = seen = stop + 1
            if name in _CLOSE and not m[1]:
                closed = _CLOSE[name].search(page, at)
                at = seen = closed.end() if closed else n
                yield "text", " ", "", ""
            else:
                yield "tag", m[1], name, page[m.end() : stop]
            continue
        if end is None:
            at = i + 1
            continue
        if i > seen:
            yield "text", page[seen:i], "", ""
        at = seen = end
    tail = page[seen:]
    if (c := tail.find("<!--")) >= 0:
        tail = tail[:c]
    if m := re.search(r"<[a-zA-Z/]", tail):
        tail = tail[: m.start()]  # a tag that is cut off
    if tail:
        yield "text", tail, "", ""


def _attributes(attrs: str) -> dict[str, str]:
    """Attributes by name in lower case; the first of a name counts."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attrs):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def _hidden(given: dict[str, str]) -> bool:
    return given.get("hidden", "false").strip().lower() != "false" or given.get("aria-hidden", "").strip().lower() == "true" or bool(_UNSEEN.search(given.get("style", "")))


@lru_cache(maxsize=1 << 14)
def _named(names: str) -> tuple[bool, bool, bool]:
    """Whether class names are those of a part around the article, of one that holds items of its own, of the article."""
    around = lists = article = False
    for token in names.lower().split():
        parts = [x for x in re.split(r"[-_]+", token) if x]
        if not parts or not _NEGATIONS.isdisjoint(parts) or len(parts) > 1 and parts[-1] in _STATES:
            continue
        of_article = any(_ARTICLE_NAMES.fullmatch(x) for x in parts)
        article |= of_article
        if of_article and parts[-1] in _WRAPPERS:
            continue
        # The header of a post holds its title.
        found = [x for x in parts if _NAMES.fullmatch(x) and not (x == "header" and of_article)]
        if not found or any(x not in _FURNITURE and not _NAMES.fullmatch(x) and not x.isdigit() for x in parts):
            continue
        around = True
        lists |= any(_LISTS.fullmatch(x) for x in found)
    return around, lists, article


def blocks(page: str) -> list[tuple[str, int, int, float]]:
    """(text, words, words in links, place) of each flat block with text, in page order."""
    out: list[tuple[str, int, int, float]] = []
    #: Open elements, each with what holds inside it: silent, in an article, around, loosely around.
    stack: list[tuple[str, tuple[bool, bool, bool, bool]]] = []
    open_: Counter = Counter()
    parts: list[str] = []
    in_link = linked = 0
    now = (False, False, False, False)

    def end() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text and not now[0]:
                words = len(text.split(" "))
                out.append((text, words, min(linked, words), AROUND if now[2] or now[3] else ARTICLE if now[1] else PLAIN))
        parts, linked = [], 0

    def pop() -> None:
        nonlocal now
        open_[stack.pop()[0]] -= 1
        now = stack[-1][1] if stack else (False, False, False, False)

    for kind, close, name, attrs in parts_of(page):
        if kind == "text":
            parts.append(close)
            if in_link:
                linked += len(close.split())
            continue
        if name == "a":
            in_link = 0 if close else 1
        if name in _INLINE:
            if name in ("br", "img", "wbr"):
                parts.append(" ")
            continue
        end()
        if name in _VOID:
            continue
        if close:
            if open_[name]:
                while stack[-1][0] != name:
                    pop()
                pop()
                in_link = 0
            continue
        mark = None
        given = _attributes(attrs) if attrs and not attrs.isspace() else {}
        hidden = name in _SILENT or bool(given and _hidden(given))
        around, lists, article = _named(" ".join([given.get("class", ""), given.get("id", ""), given.get("role", "")])) if given and name in _CONTAINERS else (False, False, False)
        if name in _AROUND and not (name in ("header", "figcaption") and now[1]):
            mark = AROUND
        elif name in ("article", "main"):
            mark = AROUND if name == "article" and lists else ARTICLE
        elif name not in ("html", "body"):
            if around:
                mark = AROUND if lists else LOOSE
            elif article and name in ("div", "section", "td"):
                mark = ARTICLE
        # A paragraph ends the one that is open; so does an item or a cell.
        if name in ("p", "li", "td", "tr", "option", "dt", "dd") and stack and stack[-1][0] == name:
            pop()
        silent, inside, far, loose = now
        loose = loose and not (mark == ARTICLE and name in ("article", "main")) or mark == LOOSE
        now = (silent or hidden, inside or mark == ARTICLE, far or mark == AROUND, loose)
        stack.append((name, now))
        open_[name] += 1
    end()
    return out


def train(spark: SparkSession, labelled: tuple = LABELLED, depth: int = 5) -> tuple:
    """The tree as nested tuples: (feature no., threshold, left, right) or a label."""
    rows = spark.createDataFrame([tuple(map(float, r)) for r in labelled], [*FEATURES, "label"]).coalesce(1)
    made = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    tree = DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=1, seed=7).fit(made)

    def walk(node) -> tuple | float:
        if node.subtreeDepth() == 0:
            return float(node.prediction())
        s = node.split()
        return (s.featureIndex(), float(s.threshold()), walk(node.leftChild()), walk(node.rightChild()))

    return walk(tree._call_java("rootNode"))


def _classify(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    i, t, left, right = tree
    go = x[:, i] <= t
    out = np.empty(len(x))
    out[go], out[~go] = _classify(left, x[go]), _classify(right, x[~go])
    return out


def main_text(page: str | None, tree) -> tuple[str, int, int]:
    """(text, blocks kept, all blocks) of one page."""
    found = blocks(page) if page else []
    if not found:
        return "", 0, 0
    n = np.array([b[1] for b in found], dtype=float)
    links = np.array([b[2] for b in found], dtype=float) / n
    pad = lambda v: np.concatenate(([0.0], v, [0.0]))
    x = np.stack([n, links, pad(n)[:-2], pad(links)[:-2], pad(n)[2:], pad(links)[2:], np.array([b[3] for b in found])], axis=1)
    kept = np.flatnonzero(_classify(tree, x) == 1)
    return "\n".join(found[i][0] for i in kept), len(kept), len(found)


def extract(pages: DataFrame, tree: tuple | None = None, page: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """One row for each row of pages: page_id, url, text, n_chars (code points), blocks_kept, blocks_all.

    A null or empty page, or one without main text, has the empty text.
    Repeated rows each have their row. Pages are parsed whole, one at a time.
    """
    spark = pages.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(tree if tree is not None else train(spark))
    rows = pages.select(F.col(page).alias("page_id"), F.col(url).alias("url"), F.col(source).alias("html"))

    def each(batches):
        for batch in batches:
            made = [main_text(x.as_py(), shared.value) for x in batch.column(2)]
            text, kept, every = zip(*made, strict=True) if made else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), *[pa.array(list(x), pa.int64()) for x in (map(len, text), kept, every)]], names=["page_id", "url", "text", "n_chars", "blocks_kept", "blocks_all"])

    kinds = [f.dataType.simpleString() for f in rows.schema[:2]]
    return rows.mapInArrow(each, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long, blocks_kept long, blocks_all long")
