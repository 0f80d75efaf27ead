"""Main text of web pages from flat text blocks and a decision tree.

A page is cut at block tags into flat blocks of text. Each block has shallow features: its words and link density, those
of the block before and after it, and what stands around it in the page (inside an element for articles or main content,
inside one for navigation, forms and the like by tag, by role or by a whole word of its class or id, inside one whose
name may also be the topic of a text, a heading). A decision tree over these features, grown here from a small table of
labelled pages, keeps or drops the block; where no name helps, words and link density of block and neighbours decide.

Scripts, styles, comments and markup never become text; character references are decoded; white space within a block is
one space. Blocks that stay are joined by a line break in page order.

Defined cases: a null or empty page has an empty text; unclosed, crossed or stray tags never fail (an unclosed element
ends with its parent, a stray end tag is ignored); markup without an end runs to the end of the page, but for a CDATA
section, which HTML reads as a comment up to the next ``>``; pages of any length and depth are read whole, tag by tag,
in time that grows with their length; repeated rows get equal results; an empty table gives no row; columns named like the
results are replaced.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import LongType, StringType, StructField, StructType

from sensorgate.llm.common import query, table

#: Names of HTML elements.
BLOCK = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe li main menu nav noscript ol option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript textarea title iframe svg math select object canvas audio video".split())
#: Elements that an open element of the same kind ends.
SELF_ENDING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: A start tag of these ends an open paragraph.
ENDS_P = BLOCK - {"br", "button", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
PAGE_PARTS = frozenset("nav header footer aside form menu dialog head button fieldset iframe".split())
ARTICLE_PARTS = frozenset("article main".split())
PART_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: An open paragraph, item or cell is not ended from inside these.
ENCLOSING = frozenset("ul ol table div section article body nav aside blockquote dl select".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Whole words in a class or id that name a part of the page beside its article.
PART_WORDS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising banner banners breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer disqus footer form gdpr hidden masthead menu menus modal nav navbar navigation newsletter notice notices notification notifications pager pagination popup privacy promo promos promotion replies reply sidebar signup sponsor sponsored sponsors subscribe subscription topbar".split()
)
#: Whole words that name such a part or the topic of a text: the tree weighs them.
TOPIC_WORDS = frozenset("login overlay recommendations recommended related search share sharing social teaser teasers toolbar widget widgets".split())
ARTICLE_WORDS = frozenset("article articlebody body content entry main post story text".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_RAW_END = {name: re.compile(f"</{name}", re.I | re.A) for name in RAW}
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "in_article", "in_part", "topic", "heading")


@dataclass
class Block:
    text: str
    words: int
    linked: int
    in_article: bool
    in_part: bool
    topic: bool
    heading: bool


def _names(attributes: str, in_article: bool) -> tuple[bool, bool, bool]:
    """Whether attributes name a part beside the article, the article, or what may be either. A header in an article is its own."""
    part = article = topic = False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id"):
            words = {w.lower() for w in _WORD.findall(value)}
            part |= not words.isdisjoint(PART_WORDS) or ("header" in words and not in_article)
            topic |= not words.isdisjoint(TOPIC_WORDS)
            article |= not words.isdisjoint(ARTICLE_WORDS)
            continue
        value = value.lower()
        if name == "role":
            part |= value in PART_ROLES
            article |= value in ("main", "article")
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            part = True
    return part, article and not part, topic


def blocks(page: str) -> list[Block]:
    """Flat text blocks in page order."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # open elements: name; in article, in part, in a topic before them
    places: dict[str, list[int]] = {}  # where in the stack elements of a name lie
    pieces: list[str] = []
    links, linked, heading, at, length = 0, 0, 0, 0, len(page)
    article = part = topic = False

    def close() -> None:
        nonlocal linked
        if pieces:
            text = "".join(pieces)
            text = " ".join((entities.unescape(text) if "&" in text else text).split())
            if text:
                n = text.count(" ") + 1
                out.append(Block(text, n, min(n, linked), article, part, topic, heading > 0))
            pieces.clear()
        linked = 0

    def add(a: int, b: int) -> None:
        nonlocal linked
        if b > a:
            piece = page[a:b]
            pieces.append(piece)
            if links:
                linked += len(piece.split())

    def pop() -> str:
        nonlocal links, heading, article, part, topic
        name, article, part, topic = stack.pop()
        places[name].pop()
        links -= name == "a"
        heading -= name in HEADINGS
        return name

    def last(names) -> int:
        """Place of the innermost open element of these names, -1 if there is none."""
        return max((places[n][-1] for n in names if places.get(n)), default=-1)

    while at < length:
        m = _TAG.search(page, at)
        if m is None:
            add(at, length)
            break
        add(at, m.start())
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if places.get(name):
                if name in BLOCK:
                    close()
                while stack[-1][0] != name:
                    if stack[-1][0] in BLOCK:
                        close()
                    pop()
                pop()
            elif name in ("br", "p"):
                close()
            continue
        if name in RAW:
            if name in BLOCK:
                close()
            if not m[3].endswith("/") or name not in ("svg", "math"):
                end = _RAW_END[name].search(page, at)
                at = length if end is None else page.find(">", end.start()) + 1 or length
            continue
        if name in BLOCK:
            close()
        ending = SELF_ENDING.get(name, frozenset()) | ({"p"} if name in ENDS_P else frozenset())
        while ending and (open_ := last(ending)) >= 0 and last(ENCLOSING) <= open_:
            while len(stack) > open_:
                pop()
        if name in VOID:
            continue
        places.setdefault(name, []).append(len(stack))
        stack.append((name, article, part, topic))
        named_part, named_article, named_topic = _names(m[3], article) if m[3] else (False, False, False)
        if name in ("html", "body", "main", "article"):  # classes of the whole page say what else it has
            named_part = named_article = named_topic = False
        links += name == "a"
        heading += name in HEADINGS
        inside = article and name == "header"
        article = article or name in ARTICLE_PARTS or named_article
        part = part or (name in PAGE_PARTS and not inside) or named_part
        topic = topic or named_topic
    close()
    return out


def features(found: list[Block]) -> np.ndarray:
    """A row of FEATURES for each block; the neighbours of the first and the last block are empty."""
    x = np.zeros((len(found), len(FEATURES)))
    if found:
        x[:, 0] = [b.words for b in found]
        x[:, 1] = [b.linked / b.words for b in found]
        x[1:, 2:4], x[:-1, 4:6] = x[:-1, :2], x[1:, :2]
        x[:, 6:] = [(b.in_article, b.in_part, b.topic, b.heading) for b in found]
    return x


@dataclass
class Tree:
    """Nodes as arrays: the feature asked (-1: a leaf), its threshold, the node on each side, the share of kept blocks."""

    feature: list[int]
    threshold: list[float]
    low: list[int]
    high: list[int]
    share: list[float]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), int)
        feature, threshold, low, high = map(np.array, (self.feature, self.threshold, self.low, self.high))
        for _ in self.feature:
            inner = feature[node] >= 0
            if not inner.any():
                break
            goes = x[np.arange(len(x)), feature[node]] <= threshold[node]
            node = np.where(inner, np.where(goes, low[node], high[node]), node)
        return np.array(self.share)[node] >= 0.5


def grow(x: np.ndarray, keep: np.ndarray, depth: int = 8, least: int = 2) -> Tree:
    """Binary splits of least Gini impurity."""
    tree = Tree([], [], [], [], [])

    def node(rows: np.ndarray, left: int) -> int:
        me = len(tree.feature)
        share = keep[rows].mean()
        for column, value in zip((tree.feature, tree.threshold, tree.low, tree.high, tree.share), (-1, 0.0, 0, 0, float(share)), strict=True):
            column.append(value)
        if not left or share in (0.0, 1.0):
            return me
        best = (share * (1 - share) * len(rows) - 1e-9, -1, 0.0)
        for f in range(x.shape[1]):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, hits = x[order, f], np.cumsum(keep[order])
            cut = np.flatnonzero(v[1:] > v[:-1])
            cut = cut[(cut + 1 >= least) & (len(rows) - cut - 1 >= least)]
            if len(cut):
                n, h = cut + 1, hits[cut]
                rest, more = len(rows) - n, hits[-1] - h
                impurity = h * (n - h) / n + more * (rest - more) / rest
                k = impurity.argmin()
                if impurity[k] < best[0]:
                    best = (impurity[k], f, (v[cut[k]] + v[cut[k] + 1]) / 2)
        if best[1] >= 0:
            goes = x[rows, best[1]] <= best[2]
            tree.feature[me], tree.threshold[me] = best[1], best[2]
            tree.low[me] = node(rows[goes], left - 1)
            tree.high[me] = node(rows[~goes], left - 1)
        return me

    node(np.arange(len(x)), depth)
    return tree


#: The labelled table: pages as lists of (markup, kept). A block of a markup has its label.
_LONG = "the first long sentence of a story tells at some length what has happened and goes on until everything is told"
_ARTICLE = [("<h1>A title of a story</h1>", 1), (f"<p>{_LONG}.</p>", 1), ("<p>Short.</p>", 1), ("<p>Two words.</p>", 1), (f"<p>One <a href=x>link here</a> in a text. {_LONG}</p>", 1), ("<ul><li>first point</li><li>second point of a list</li></ul>", 1), ("<h2>Heading</h2>", 1), (f"<blockquote>{_LONG}</blockquote>", 1), ("<p><a href=x>a linked line</a></p>", 1), ("<table><tr><td>cell</td><td>another cell</td></tr></table>", 1), ("<pre>code line</pre>", 1), (f"<p><b>{_LONG}<br>{_LONG}</b></p>", 1)]
_AROUND = [("<nav><ul><li><a href=x>Home</a></li><li><a href=x>News</a></li></ul></nav>", 0), ("<header><p>Name of the site</p><a href=x>Start</a></header>", 0), ("<footer><p>Copyright of the site, all rights reserved by its owner.</p></footer>", 0), (f"<aside><h3>More</h3><p>{_LONG}</p></aside>", 0), ("<form><label>Mail</label><button>Send</button></form>", 0), ("<div class=ad>Buy this now, it is cheap and good.</div>", 0), ("<div class='cookie-notice'><p>We use cookies to improve this site.</p></div>", 0), ("<div id=sidebar><ul><li><a href=x>A related story of the day</a></li><li>text</li></ul></div>", 0), (f"<section class=comments><h3>Comments</h3><p>{_LONG}</p><p>Nice.</p></section>", 0), ("<div role=navigation><a href=x>Next page</a></div>", 0)]
_LOOSE = [("<div><a href=x>Home</a> <a href=x>About us</a></div>", 0), ("<p>Menu</p>", 0), ("<ul><li><a href=x>one</a></li><li><a href=x>two three</a></li></ul>", 0), (f"<p>{_LONG}</p>", 1), (f"<div>{_LONG} {_LONG}</div>", 1), (f"<h1>{_LONG}</h1>", 1), (f"<p>{_LONG} and more of the same</p>", 1), ("<p>Short.</p>", 1), (f"<p>{_LONG} {_LONG}</p>", 1), ("<h2>Two words</h2>", 1), (f"<p>{_LONG}, told again</p>", 1), (f"<p>{_LONG}</p>", 1), ("<p>All rights reserved</p>", 0)]


#: Names that are the topic of a text here and a part of the page there.
_TOPICS = [(f"<p class=social-contract>{_LONG}.</p>", 1), ("<div class=social><a href=x>Send on</a> <a href=x>Tell others</a></div>", 0), (f"<div id=searchParty><p>{_LONG}, and <a href=x>more</a></p></div>", 1), ("<div class=share><p>Share this</p></div>", 0), (f"<ul class=related><li><a href=x>{_LONG}</a></li><li><a href=x>another story</a></li></ul>", 0), ("<div class='widget search'><p>Find a word</p></div>", 0), (f"<p class=widget-makers>{_LONG} {_LONG}</p>", 1)]
#: Parts without any name that helps.
_LINKS = [("<div class=k1><a href=x>Start</a> <a href=x>Old stories</a> <a href=x>Who we are</a></div>", 0), ("<div class=k2><ul><li><a href=x>One</a></li><li><a href=x>Two of them</a></li><li><a href=x>A third and longer entry of the list</a></li></ul></div>", 0)]
_TEXT = [("<h1>A title of a story</h1>", 1), (f"<div class=k3>{_LONG}.</div>", 1), (f"<p>{_LONG}, as <a href=x>others told</a> before.</p>", 1), ("<p>Short.</p>", 1), (f"<p>{_LONG}.</p>", 1), ("<h2>Next part</h2>", 1), (f"<p>{_LONG} {_LONG}</p>", 1), ("<ul><li>a point without links</li><li>one more</li></ul>", 1), (f"<p>{_LONG}.</p>", 1)]
_MORE = [("<h3>More to read</h3>", 0), (f"<div class=k4><a href=x>{_LONG}</a></div>", 0), (f"<div class=k4><a href=x>{_LONG} and more</a></div>", 0), (f"<div class=k4>New: <a href=x>{_LONG}</a></div>", 0), ("<p><a href=x>Terms</a> and <a href=x>rules</a>, <a href=x>contact us</a></p>", 0)]


#: Paragraphs of many lengths: in an article none is too short.
_LENGTHS = [(f"<p>{' '.join(['word'] * n)}</p>", 1) for n in (3, 1, 14, 2, 40, 6, 11, 1, 1, 9, 25, 4, 13, 5, 60, 12, 2)]
_LENGTHS.append(("<p><a href=x>word</a></p>", 1))
_PLAIN = [(f"<{tag}>{' '.join(['word'] * n)}</{tag}>", 1) for tag, n in (("h1", 7), ("p", 60), ("p", 9), ("p", 33), ("h2", 4), ("p", 80), ("div", 13), ("p", 45), ("p", 5), ("p", 28), ("h2", 3), ("p", 90), ("p", 11), ("p", 26), ("p", 15), ("p", 50))]


def labelled_pages() -> list[tuple[str, list[int]]]:
    """Pages built from the table: with an article element, with a content class, and with neither; the article among
    other parts, and alone on its page."""
    pages: list[list] = []
    for opening, closing in (("<article>", "</article>"), ("<main>", "</main>"), ("<div class=content>", "</div>"), ("<div class='post entry'>", "</div>")):
        mixed = (opening, _ARTICLE + _AROUND[3:9], closing)
        pages.append([*_AROUND[:6], mixed, *_AROUND[6:]])
        for alone in (_ARTICLE, _ARTICLE[1:4], _ARTICLE[7:9], _ARTICLE[2:3], _ARTICLE[8:9]):
            pages.append([(opening, alone, closing)])
            pages.append([*_AROUND[:1], (opening, alone, closing), *_AROUND[2:3]])
    pages += [_LOOSE, _LOOSE + _AROUND[:3], _AROUND[:2] + _LOOSE, _LOOSE[3:], _LOOSE[:-1]]
    pages += [around for plain in (_PLAIN, _PLAIN[4:], _PLAIN[::-1], _PLAIN[1:6]) for around in (plain, _LINKS + plain + _MORE, _AROUND[:3] + plain + _AROUND[2:3])]
    pages += [_LINKS + _TEXT + _MORE, _TEXT + _MORE, _LINKS + _TEXT, _TEXT, _MORE + _TEXT[:5] + _MORE[1:], _LINKS + _TEXT[1:3] + _MORE[1:], _TEXT[3:4], _LINKS, _MORE[1:]]
    for opening, closing in (("<article>", "</article>"), ("", "")):
        mixed = _TEXT[:3] + _TOPICS + _TEXT[4:]
        if opening:
            lengths = [_LENGTHS, _LENGTHS[::-1], *([p] for p in _LENGTHS[:6]), *([p, q] for p in _LENGTHS[-4:] for q in _LENGTHS)]
            pages += [page for inner in lengths for page in ([(opening, inner, closing)], [*_LINKS, (opening, inner, closing), *_MORE], [*_AROUND[:1], (opening, inner, closing), *_AROUND[2:3]])]
        pages += [[(opening, mixed, closing)], [*_LINKS, (opening, mixed, closing), *_MORE]]
    out = []
    for parts in pages:
        markup, labels = "", []
        for part in parts:
            opening, inner, closing = part if len(part) == 3 else ("", [part], "")
            markup += opening + "".join(m for m, _ in inner) + closing
            for m, label in inner:
                labels += [label] * len(blocks(m))
        out.append((markup, labels))
    return out


@lru_cache(maxsize=1)
def tree() -> Tree:
    x, keep = [], []
    for markup, labels in labelled_pages():
        own = features(blocks(markup))
        if len(own) != len(labels):
            raise ValueError("labels do not fit the blocks")
        x.append(own)
        keep += labels
    return grow(np.concatenate(x), np.array(keep))


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    keep = tree()(features(found))
    return "\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame) -> DataFrame:
    """``pages``, all columns but ``html``, with ``text, n_chars``."""
    kept = pages.drop("text", "n_chars")
    schema = StructType([*kept.drop("html").schema.fields, StructField("text", StringType()), StructField("n_chars", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            rest = batch.select([n for n in batch.schema.names if n != "html"])
            arrays = [*rest.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*rest.schema.names, "text", "n_chars"])

    return kept.mapInArrow(run, schema)


@query("op2_html_text")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return extract(table(spark, folder, "pages").select("page_id", "url", "html"))
