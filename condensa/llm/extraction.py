"""Main text of web pages by shallow features of flat text blocks.

A page becomes a flat list of text blocks, cut where block elements begin or end. A
block is described by its number of words and its link density, by those of the
blocks before and after it, and by four signals of the elements around it, each a
feature of its own: inside an article element, under a name that articles have, inside
what frames or fills pages at times (forms, boxes, layout names), inside what never is
article (menus, footers, asides, reader comments, hidden parts). An article element
starts anew in boxes and under layout names, but not in what never is article: a card in
a sidebar and a reader's comment are articles of their own. A decision tree,
trained on the small labelled table below, tells article from the rest.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

_RAW = "script|style|noscript|template|textarea|iframe|svg|title|select|button"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<({_RAW})(?=[\s/>])[^>]*(?:/>|>.*?(?:</\1\s*>|\Z))"
    r"|<(/?)([a-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|</?[a-z][^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.I | re.S,
)
#: Elements inside a line of text; all others begin and end blocks.
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose end tags are often left out; they hold no other blocks worth a place of their own.
_LEAF = frozenset("p li dt dd tr td th thead tbody tfoot option h1 h2 h3 h4 h5 h6".split())
#: Elements that aren't article, those that may hold an article though they seldom do, and articles.
_ASIDE = frozenset("nav aside footer menu dialog".split())
_BOX = frozenset("form fieldset".split())
_ARTICLE = frozenset("article main".split())
_NAMED = re.compile(r"\b(?:class|id|role|aria-label|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
#: Names of what isn't article, of what may be part of a page's layout, and of articles; names that
#: say what a page has ("has-sidebar", "with-comments") name no part of it.
_STRONG = re.compile(r"(?:^|[\s_-])(?:comments?|comment-?list|respond|repl(?:y|ies)|disqus|cookies?|consent|menu|navbar|navigation|breadcrumbs?|footer|masthead|contentinfo|pagination|pager|skip|popup|modal|copyright|login|signup|ads?|adverts?|advertisements?|adsense|sponsor(?:ed)?)(?:$|[\s_-])", re.I)
_WEAK = re.compile(r"(?:^|[\s_-])(?:nav|side-?bar|banner|promo(?:tion)?|widget|notice|alert|overlay|newsletter|subscri(?:be|ption)|search|share|sharing|social|related|recommend(?:ed|ations)?|toolbar|legal|disclaimer|complementary)(?:$|[\s_-])", re.I)
_BODY = re.compile(r"(?:^|[\s_-])(?:article|articlebody|main|story|post|entry)(?:$|[\s_-](?:body|content|text|inner)?)", re.I)
#: Whole names of parts that no article element inside makes main text.
_FIRM = re.compile(r"(?:^|\s)(?:comments?|comment-?list|comments-area|respond|repl(?:y|ies)|disqus|side-?bars?|footer|menu|nav|navbar|navigation|related|related-(?:posts|articles)|recommended|recommendations|widgets?|promo)(?=\s|$)", re.I)
_HAS = re.compile(r"(?:^|(?<=\s))(?:has|with|no|is|not)-\S+", re.I)

#: article, body, weak, strong; and firm: strong whatever is inside
Signals = tuple[bool, bool, bool, bool, bool]
_NONE: Signals = (False, False, False, False, False)


def _signals(name: str, attributes: str, around: Signals) -> Signals:
    """The signals inside an element, from those around it."""
    article, body, weak, strong, firm = around
    if name in _ARTICLE and not strong or name == "article":
        article, body, weak, strong = True, body, False, firm
    firm = firm or name in _ASIDE
    strong = strong or firm or name == "header" and not article
    weak = weak or name in _BOX
    if attributes and name not in ("html", "body"):
        names = " ".join(x.strip("\"'") for x in _NAMED.findall(attributes))
        if names:
            names = _HAS.sub(" ", names)
        if _HIDDEN.search(attributes) or names and _FIRM.search(names):
            firm = strong = True
        elif names and name not in _ARTICLE:
            strong, weak = strong or bool(_STRONG.search(names)), weak or bool(_WEAK.search(names))
            body = body or bool(_BODY.search(names))
    return article, body, weak, strong, firm


def blocks(page: str) -> list[tuple[str, int, int, Signals]]:
    """(text, words, words in links, signals) of the text blocks of a page, in order."""
    out: list[tuple[str, int, int, Signals]] = []
    parts: list[str] = []
    linked = 0
    stack: list[tuple[str, Signals]] = []
    leaf: Signals | None = None
    link = False
    at = 0

    def close() -> None:
        nonlocal linked
        if parts:
            words = html.unescape("".join(parts)).split()
            if words:
                out.append((" ".join(words), len(words), min(linked, len(words)), leaf if leaf is not None else stack[-1][1] if stack else _NONE))
            parts.clear()
        linked = 0

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text = page[at : m.start()]
            parts.append(text)
            if link:
                linked += len(text.split())
        at = m.end()
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        if name in _INLINE:
            link = (not m[2]) if name == "a" else link
            continue
        close()
        link = False
        if name in _VOID:
            continue
        around = stack[-1][1] if stack else _NONE
        if name in _LEAF:
            leaf = None if m[2] else _signals(name, m[4], around)
        elif m[2]:
            leaf = None
            if any(x[0] == name for x in stack):
                while stack.pop()[0] != name:
                    pass
        elif not m[4].endswith("/"):
            leaf = None
            stack.append((name, _signals(name, m[4], around)))
    if at < len(page):
        parts.append(page[at:])
    close()
    return out


#: Names of the columns of the features; the last six look at text, four of them at the neighbours'.
FEATURES = ("article", "body", "weak", "strong", "words", "links", "words before", "links before", "words after", "links after")


def features(rows: list[tuple[str, int, int, Signals]]) -> np.ndarray:
    """The signals, and words and link density of the block, of the one before and of the one after."""
    n = len(rows)
    out = np.zeros((n, len(FEATURES)))
    if n:
        words = np.array([r[1] for r in rows], float)
        link = np.array([r[2] for r in rows], float) / words
        out[:, :4], out[:, 4], out[:, 5] = [r[3][:4] for r in rows], words, link
        out[1:, 6], out[1:, 7], out[:-1, 8], out[:-1, 9] = words[:-1], link[:-1], words[1:], link[1:]
    return out


#: The labelled table: the features in order, and 1 for article.
LABELLED = np.array([
    # inside an article element: all but runs of links
    (1, 0, 0, 0, 9, 0, 0, 0, 80, 0, 1), (1, 0, 0, 0, 120, 0, 9, 0, 60, 0, 1), (1, 1, 0, 0, 60, 0.1, 120, 0, 1, 0, 1), (1, 0, 0, 0, 1, 0, 60, 0, 45, 0, 1),
    (1, 0, 0, 0, 2, 0, 1, 1, 1, 1, 1), (1, 1, 0, 0, 45, 0.3, 1, 0, 6, 0, 1), (1, 0, 0, 0, 6, 0, 45, 0.3, 30, 0, 1), (1, 0, 0, 0, 30, 0, 6, 0, 9, 1, 1),
    (1, 0, 0, 0, 1, 0, 0, 0, 0, 0, 1), (1, 0, 0, 0, 5, 0.2, 20, 0, 20, 0, 1), (1, 0, 0, 0, 12, 0.45, 30, 0, 30, 0, 1), (1, 0, 0, 0, 300, 0, 1, 1, 12, 0, 1),
    (1, 0, 0, 0, 4, 0, 2, 1, 3, 1, 1), (1, 1, 0, 0, 3, 0, 3, 0, 2, 0, 1), (1, 0, 0, 0, 7, 0.3, 2, 1, 4, 1, 1), (1, 0, 0, 0, 25, 0.2, 3, 1, 2, 1, 1),
    (1, 0, 0, 0, 9, 1, 30, 0, 8, 1, 0), (1, 0, 0, 0, 8, 1, 9, 1, 7, 1, 0), (1, 0, 0, 0, 3, 1, 50, 0, 3, 1, 0), (1, 1, 0, 0, 20, 0.9, 90, 0, 15, 0.95, 0),
    (1, 0, 0, 0, 2, 1, 70, 0, 70, 0, 0), (1, 0, 0, 0, 4, 0.8, 10, 0, 4, 0.8, 0), (1, 0, 0, 0, 60, 0.9, 60, 0, 8, 0, 0),
    # boxes and comments inside an article
    (1, 0, 1, 0, 3, 0, 40, 0, 2, 0, 0), (1, 0, 1, 0, 2, 0, 3, 0, 50, 0, 0), (1, 0, 1, 0, 12, 0.2, 60, 0, 4, 1, 0), (1, 1, 1, 0, 8, 1, 40, 0, 9, 1, 0), (1, 0, 1, 0, 18, 0, 70, 0, 60, 0, 0),
    (1, 0, 0, 1, 40, 0, 80, 0, 35, 0, 0), (1, 0, 0, 1, 3, 0.5, 40, 0, 20, 0, 0), (1, 1, 0, 1, 90, 0, 60, 0, 70, 0, 0),
    # menus, footers, asides and reader comments, however long
    (0, 0, 0, 1, 1, 1, 1, 1, 1, 1, 0), (0, 0, 0, 1, 12, 0, 1, 1, 9, 0, 0), (0, 0, 0, 1, 60, 0, 1, 1, 9, 0, 0), (0, 0, 0, 1, 14, 0, 80, 0, 0, 0, 0), (0, 1, 0, 1, 45, 0, 30, 0, 40, 0, 0),
    (0, 0, 0, 1, 200, 0, 40, 0, 30, 0, 0), (0, 0, 0, 1, 30, 0.1, 200, 0, 10, 0, 0), (0, 0, 1, 1, 4, 0, 30, 0, 120, 0, 0), (0, 0, 0, 1, 90, 0, 90, 0, 90, 0, 0), (0, 1, 1, 1, 25, 1, 5, 1, 0, 0, 0),
    # boxes and layout names: long prose between long prose is article, as where one form or layout is around the page
    (0, 0, 1, 0, 60, 0, 8, 0, 70, 0, 1), (0, 0, 1, 0, 70, 0.05, 60, 0, 45, 0, 1), (0, 0, 1, 0, 45, 0, 70, 0, 60, 0.1, 1), (0, 1, 1, 0, 90, 0.1, 45, 0, 3, 1, 1), (0, 0, 1, 0, 150, 0.1, 60, 0, 5, 0, 1),
    (0, 0, 1, 0, 2, 0, 1, 0, 3, 0, 0), (0, 0, 1, 0, 10, 0, 3, 0, 2, 0, 0), (0, 0, 1, 0, 22, 0, 5, 0, 3, 1, 0), (0, 0, 1, 0, 30, 0.1, 2, 1, 4, 0, 0), (0, 0, 1, 0, 6, 1, 5, 1, 7, 1, 0),
    (0, 0, 1, 0, 18, 0.2, 60, 0, 3, 1, 0), (0, 1, 1, 0, 4, 0, 50, 0, 4, 0, 0), (0, 0, 1, 0, 28, 0, 30, 0, 6, 0, 0), (0, 0, 1, 0, 40, 0.8, 9, 1, 60, 0, 0),
    # no element says anything: words and links of the block and its neighbours decide
    (0, 0, 0, 0, 60, 0, 8, 0, 70, 0, 1), (0, 0, 0, 0, 70, 0.05, 60, 0, 20, 0, 1), (0, 0, 0, 0, 25, 0, 70, 0, 60, 0, 1), (0, 0, 0, 0, 8, 0, 3, 1, 60, 0, 1), (0, 0, 0, 0, 6, 0, 2, 1, 35, 0, 1),
    (0, 0, 0, 0, 12, 0, 60, 0, 50, 0, 1), (0, 0, 0, 0, 5, 0, 40, 0, 80, 0, 1), (0, 0, 0, 0, 150, 0.2, 4, 1, 5, 0, 1), (0, 0, 0, 0, 40, 0, 2, 1, 3, 1, 1), (0, 0, 0, 0, 3, 0, 55, 0, 40, 0, 1),
    (0, 0, 0, 0, 30, 0.1, 90, 0, 6, 0, 1), (0, 0, 0, 0, 18, 0, 45, 0, 22, 0, 1), (0, 0, 0, 0, 24, 0, 50, 0, 3, 0, 1), (0, 0, 0, 0, 20, 0, 60, 0, 2, 1, 1), (0, 0, 0, 0, 15, 0, 40, 0, 4, 0, 1),
    (0, 0, 0, 0, 10, 0, 25, 0, 30, 0, 1), (0, 0, 0, 0, 35, 0.25, 6, 0, 4, 0, 1), (0, 0, 0, 0, 2, 0, 80, 0, 60, 0, 1), (0, 0, 0, 0, 9, 0, 30, 0, 18, 0, 1),
    (0, 1, 0, 0, 9, 0, 0, 0, 60, 0, 1), (0, 1, 0, 0, 5, 0, 30, 0, 4, 0, 1), (0, 1, 0, 0, 14, 0.1, 8, 0, 6, 0, 1), (0, 1, 0, 0, 40, 0.3, 20, 0, 3, 1, 1), (0, 1, 0, 0, 3, 0, 4, 1, 25, 0, 1), (0, 1, 0, 0, 2, 0, 12, 0, 0, 0, 1),
    (0, 1, 0, 0, 4, 1, 40, 0, 5, 1, 0), (0, 1, 0, 0, 9, 0.9, 8, 1, 7, 1, 0), (0, 1, 0, 0, 2, 1, 2, 1, 50, 0, 0),
    (0, 0, 0, 0, 1, 1, 1, 1, 1, 1, 0), (0, 0, 0, 0, 2, 1, 1, 1, 9, 0, 0), (0, 0, 0, 0, 3, 1, 0, 0, 3, 1, 0), (0, 0, 0, 0, 10, 0.8, 5, 1, 5, 1, 0), (0, 0, 0, 0, 2, 1, 3, 1, 60, 0, 0),
    (0, 0, 0, 0, 4, 0, 2, 1, 3, 1, 0), (0, 0, 0, 0, 6, 0, 5, 0, 4, 0, 0), (0, 0, 0, 0, 9, 0, 1, 1, 2, 0, 0), (0, 0, 0, 0, 3, 0, 6, 0, 0, 0, 0), (0, 0, 0, 0, 8, 0, 2, 1, 4, 1, 0),
    (0, 0, 0, 0, 40, 0.7, 3, 1, 6, 1, 0), (0, 0, 0, 0, 7, 0.3, 2, 1, 4, 1, 0), (0, 0, 0, 0, 2, 0, 9, 0, 3, 0, 0), (0, 0, 0, 0, 60, 0.9, 60, 0, 8, 0, 0), (0, 0, 0, 0, 12, 0, 3, 1, 2, 1, 0),
    (0, 0, 0, 0, 9, 0, 22, 0, 0, 0, 0), (0, 0, 0, 0, 5, 0.5, 70, 0, 3, 1, 0), (0, 0, 0, 0, 3, 1, 50, 0, 2, 1, 0), (0, 0, 0, 0, 7, 0, 1, 1, 0, 0, 0), (0, 0, 0, 0, 1, 0, 3, 0, 1, 0, 0),
], float)


def train(rows: np.ndarray, least: int = 1) -> tuple:
    """A tree of (feature, threshold, below, above), leaves 0 or 1, splitting by Gini impurity."""
    label = rows[:, -1]
    if len(set(label)) < 2 or len(rows) < 2 * least:
        return (int(label.mean() > 0.5),)

    def impurity(part: np.ndarray) -> float:
        p = part.mean()
        return len(part) * p * (1 - p)

    tried = []
    for f in range(rows.shape[1] - 1):
        values = np.unique(rows[:, f])
        for cut in (values[:-1] + values[1:]) / 2:
            low = rows[:, f] <= cut
            tried.append((impurity(label[low]) + impurity(label[~low]), f, cut))
    if not tried:
        return (int(label.mean() > 0.5),)
    _, f, cut = min(tried)
    low = rows[:, f] <= cut
    return f, cut, train(rows[low], least), train(rows[~low], least)


def used(tree: tuple, rows: np.ndarray) -> np.ndarray:
    """Which features the tree asks for each row, one column each."""
    out = np.zeros((len(rows), len(FEATURES)), bool)
    if len(tree) > 1:
        f, cut, below, above = tree
        low = rows[:, f] <= cut
        out[:, f] = True
        out[low] |= used(below, rows[low])
        out[~low] |= used(above, rows[~low])
    return out


def classify(tree: tuple, rows: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(rows), bool(tree[0]))
    f, cut, below, above = tree
    return np.where(rows[:, f] <= cut, classify(below, rows), classify(above, rows))


def extract(pages: DataFrame, labelled: np.ndarray = LABELLED) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks and n_kept of each row of pages.

    A null, empty or blank page, and one without article blocks, has the empty text.
    Pages cut off in a tag lose that tag; unknown references stay as they stand;
    pages are read whole, however long. Repeated rows each give a row, null ids too; an
    empty table gives none; other columns are left out. There is no shuffle.
    """
    tree = train(labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found, kept = [], [], []
            for page in batch.column(2).to_pylist():
                rows = blocks(page or "")
                good = classify(tree, features(rows)) if rows else []
                texts.append(" ".join(r[0] for r, g in zip(rows, good) if g))
                found.append(len(rows))
                kept.append(int(sum(good)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(found, pa.int64()), pa.array(kept, pa.int64())],
                ["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"],
            )

    return pages.selectExpr("cast(page_id as bigint) page_id", "url", "html").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint, n_blocks bigint, n_kept bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
