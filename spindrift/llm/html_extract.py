"""Main text of web pages: flat text blocks, classified by a small decision tree.

A page is read once into text blocks (runs of text between block-level tags). A block's features are its
words and link density, those of the blocks before and after it, where it stands (``place``: in the main
article, around it, outside it, or on a page that marks no article), how many elements around it are
furniture by their tag, role or name (navigation, adverts, forms, comments, ...), how many have a name that
only hints at furniture, whether it is a heading, and its words relative to the page's longest plain block.
A decision tree, grown here from the blocks of the labelled pages below, keeps or drops each block.

An element that looks like furniture and yet holds nearly all the plain words of its page (a form around everything, a
``container sidebar-right``) is a wrapper and counts for nothing, unless it is named for comments, adverts or consent.

The main article: ``article`` and ``main`` elements are containers; those with at least a third of the words
of the one with most hold the main text, what stands around them in a container is near it, other containers
(cards of further stories) are outside.

Character references are decoded, white space inside a block becomes one space, blocks are joined by an
empty line in page order. Null or empty pages give an empty text, an empty table an empty one; repeated rows
get equal texts; a column that has the name of the result is replaced, others pass through. Broken markup is
read leniently and in linear time: missing end tags end with their parent, an unclosed script or comment
reaches to the end, a tag whose quotes never close ends at its first ``>``. Pages are read whole.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_or_empty

#: Elements that end a block; that hold no text of the page; that are furniture; that are void.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
SILENT = frozenset("head template noscript select button svg math object canvas audio video datalist".split())
FURNITURE = frozenset("nav menu footer aside form dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ITEMS = frozenset("li td th dt dd tr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: Parts of class and id names that speak of furniture, and parts that say nothing beside those.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar widget menu nav navbar navigation breadcrumb breadcrumbs footer copyright legal "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended comment comments disqus reply replies respond toolbar pagination pager masthead topbar".split()
)
#: Parts of names that are never a wrapper of the page's text.
NEVER_WRAPS = frozenset("comment comments disqus reply replies respond cookie cookies consent gdpr ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion".split())
PLAIN = frozenset(
    "area article articles bar block body bottom box button buttons card cards col column container content div footer form frame global group header holder icon icons inner item items js large left link links list main mobile "
    "module more news outer page panel policy post posts primary right row secondary section site slot small stories story sub text thread title top unit user view wrap wrapper".split()
)
BEFORE_QUOTE = re.compile(r"[^>\"']*")
TAG = re.compile(r"/?[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
END_OF_RAW = {t: re.compile(rf"</{t}", re.I) for t in RAW}

FEATURES = ("furniture", "place", "hints", "heading", "links", "links_before", "links_after", "words", "words_before", "words_after", "relative")

#: The labelled pages. A block begins with + if it is main text, with - if not; (n) stands for n more words.
LABELLED = """
<nav><ul><li><a href=/>-Home</a><li><a href=/w>-World</a><li><a href=/s>-Sport</a></ul></nav><div class=ad>-Buy (9)</div><article><h1>+A title (6)</h1><p>+Text (40)<br>(20)</p><p>+More (90)</p><p>+End</p></article><footer>-Copyright (4)</footer>
<header><a href=/>-Site</a><p>-A slogan (3)</p></header><main><h1>+Title (4)</h1><p>+By (2)</p><p>+Text (60) <a href=x>(10)</a></p><ul><li>+Point (4)</li><li>+Point (9)</li></ul><p>+Text (30)</p></main><aside><h3>-Popular</h3><p>-Teaser (25)</p></aside><footer><a href=/a>-About</a><p>-Rights (7)</p></footer>
<div class=cookie-notice>-We use (12)</div><article><header><h1>+Hi</h1></header><p>+B</p><div class=ad>-Buy (40)</div><section class=comments><h2>-Comments</h2><p>-I think (35)</p><p>-Me too</p></section></article>
<div><h2>+A title (2)</h2><p>+Text (40)</p><ul class=menu><li><a href=/>-Home</a><li><a href=/b>-B</a></ul></div>
<div id=top><a href=/>-Home</a></div><div><a href=/1>-News</a></div><div><a href=/2>-Sport (1)</a></div><div><h1>+Title (5)</h1></div><div>+Text (80)</div><div>+Text (55) <a href=x>(5)</a></div><div>-Tags</div><div><a href=/t>-one</a></div><div><a href=/u>-two</a></div><div>-Imprint (1)</div><div><a href=/p>-Privacy</a></div>
<h1>+One (1)</h1><p>+Only (9)</p>
<p>+Short page (6)</p>
<p>+Short page (12)</p><p>+and (4)</p>
<p>+One</p><p>+Two (30)</p>
<div>+Text (14)</div><div>+Text (8)</div>
<h1>+Note (2)</h1><p>+Text (16)</p><p>+Text (9)</p><div><a href=/>-Back (2)</a></div><div><a href=/>-Next</a></div>
<article><h1><a href=self>+Title that is its own link (4)</a></h1><p>+Text (70)</p><h2>+Sources</h2><ul><li><a href=1>+A study of things (5)</a><li><a href=2>+Report by the office (6)</a><li><a href=3>+The page of numbers (2)</a></ul></article>
<article><h2><a href=self>+Linked title (4)</a></h2><p>+Text (50)</p><p><a href=doc>+The whole report (6)</a></p><p>+Text (20)</p></article><div class=related-stories><h3>-More stories</h3><a href=1>-Story (5)</a></div>
<main><h1>+Story (3)</h1><p>+Text (90)</p><p>+Text (50)</p><article><h3><a href=1>-Other story (4)</a></h3><p>-Teaser (12)</p></article><article><h3><a href=2>-Third story (3)</a></h3><p>-Teaser (15)</p></article></main>
<main><h1>+Story (3)</h1><article><p>+Text (90)</p><p>+Text (50)</p><p>+Last (2)</p></article><article><h3><a href=1>-Other (4)</a></h3><p>-Teaser (12)</p></article></main>
<main><div>+Kicker (1)</div><h1>+Title (6)</h1><div>+By (3)</div><article><p>+Text (120)</p></article></main>
<article><p>+Text (70)</p><p class=share-price>+Price (25)</p><section id=search-algorithms><h2>+Searching (1)</h2><p>+Text (60)</p></section><div class=social-history>+History (30)</div><p>+Text (4)</p></article>
<div class=post><h1>+Title (4)</h1><p class=legal-case>+Text (45)</p><p>+Text (40)</p><div class=comment-by-author>+Text (30)</div></div>
<article><p>+Text (80)</p><div class=share-this-now><a href=1>-Share</a> <a href=2>mail</a></div><p>+Text (60)</p><div class=promo-of-day>-Ad <a href=3>(6)</a></div></article>
<div class=share-it-today><a href=1>-Share</a></div><div><h1>+Title (4)</h1><p>+Text (70)</p></div><div class=login-hint-now><a href=l>-Log in</a> or (2)</div>
<div class=sidebar>-Side (20)</div><div><p>+Text (60)</p><p>+Text (20)</p></div><div class=sidebar><p>-Side (50)</p></div><form>-Your name (3)</form>
<div><a href=/1><div>-Nav text that is long (8)</div></a></div><div><a href=/2><div>-Another nav text (7)</div></a></div><div><p>+Text (100)</p><p>+Text (25) <a href=x>(15)</a> (9)</p></div>
<article><a href=1><div>-Next story (7)</div></a><a href=2><div>-Story again (6)</div></a><a href=3>-See</a><p>+Text (90)</p><div><a href=t>-tag</a></div><div><a href=u>-tag</a></div></article>
<div><p>+Text (60)</p><div>-Share</div><div><a href=1>-Mail</a></div><div>-Links (1)</div><div><a href=2>-Site (1)</a></div></div>
<table><tr><td><a href=1>-Home</a><td><a href=2>-News (1)</a><tr><td>+Text (70)<td>+Text (30)</table>
<div><a href=1>-Story (9) </a><br></div><div><a href=2>-Story (11)</a></div><div><a href=3>-Story (14)</a></div><div><p>+Text (30)</p><p>+Text (45)</p></div><div><a href=4>-Story (10)</a></div>
<div role=navigation><a href=1>-A</a></div><div><p>+Text (18)</p><p>+Text (6)</p><p>+Text (33)</p></div><div role=contentinfo>-Firm (9)</div>
<article><h1>+T</h1><p>+Text (20)</p><nav><a href=1>-Next</a></nav><p>+Text (10)</p><aside>-Quote (30)</aside><p>+Text (3)</p><footer>-By (10)</footer></article><div class=comments>-Comment (80)</div><p>-Ad (60)</p><p>-Text outside (20)</p><div>-x</div>
<nav><a href=1>-A</a></nav><article><h1>+T (3)</h1><p>+Text (900)</p><p>+Text</p><p>+Text (5)</p><p>+Text (300)</p><p>+End (1)</p></article><footer>-Firm (9)</footer>
<div><h1>+T (3)</h1><p>+Text (600)</p><p>+Text</p><p>+Text (5)</p><h2>+Part</h2><p>+Text (300)</p><p>+End (1)</p></div><div class=footer>-Firm (9)</div>
<article><p>+Text (5)</p><p>+Text (2)</p><p>+Text <a href=1>(3)</a></p><p><a href=2>+Read it (1)</a></p><p>+Text (700)</p><p>+T</p></article><p>-Text (30)</p>
<article><p>+Text (50) <a href=1>(20)</a></p><p><a href=2>+Name (2)</a> wrote (8)</p><p>+Text (2) <a href=2>(2)</a></p></article>
<div class=newsletter><h3>-Sign up (2)</h3><p>-Get (14)</p></div><div><p>+Text (30)</p></div><div class=copyright>-Firm (3)</div>
<div>-Menu</div><ul><li><a href=1>-A</a><li><a href=2>-B</a><li><a href=3>-C (1)</a></ul><p>+Text (35)</p><p>+Text (5)</p><p>+Text (28)</p><ul><li><a href=4>-D</a><li><a href=5>-E</a></ul>
<h1>+Recipe (1)</h1><ul><li>+Flour (2)</li><li>+Salt</li><li>+Water (1)</li></ul><p>+Mix (20)</p>
"""


def sample_words(page: str) -> str:
    return re.sub(r"\((\d+)\)", lambda m: " ".join(["word"] * int(m[1])), page)


def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of the labelled pages."""
    rows, kept = [], []
    for page in LABELLED.strip().splitlines():
        found = blocks(sample_words(page))
        rows += features(found)
        kept += [b.text.startswith("+") for b in found]
    return np.array(rows), np.array(kept).astype(int)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 10) -> tuple | int:
    """Decision tree by Gini impurity: (feature, threshold, at most, above) or a class. Ties: the first feature."""
    if depth == 0 or len(set(y.tolist())) == 1:
        return int(2 * y.sum() > len(y))
    best = (1e-9, None)
    base = len(y) * y.mean() * (1 - y.mean())
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= t
            after = sum(len(p) * p.mean() * (1 - p.mean()) for p in (y[low], y[~low]))
            if base - after > best[0] + 1e-12:
                best = (base - after, (f, float(t), low))
    if best[1] is None:
        return int(2 * y.sum() > len(y))
    f, t, low = best[1]
    return f, t, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


def decide(tree: tuple | int, row: tuple) -> int:
    while not isinstance(tree, int):
        f, t, low, high = tree
        tree = low if row[f] <= t else high
    return tree


#: A block lies in at most this many elements of furniture that are told apart; deeper ones only count.
DEEP = 64


class Block:
    """A run of text; ``inside``: the elements of furniture around it, and ``chain``: the article and main elements around
    it, each with the furniture around that; outermost first. ``furniture`` counts the former, ``settle`` takes wrappers out."""

    __slots__ = ("chain", "furniture", "heading", "hints", "inside", "linked", "text", "words")

    def __init__(self, text: str, linked: int, chain: tuple[tuple[int, tuple[int, ...]], ...], inside: tuple[int, ...], hints: int, heading: bool):
        self.text, self.linked, self.chain, self.inside, self.hints, self.heading = text, linked, chain, inside, hints, heading
        self.words, self.furniture = text.count(" ") + 1, len(inside)

    @property
    def plain(self) -> int:
        return self.words - min(self.linked, self.words)


def settle(found: list[Block], fixed: set[int]) -> list[Block]:
    """Take wrappers out of the furniture: elements, not ``fixed``, with over half of the plain words outside ``fixed`` ones
    and ten times those that stand in no furniture. Containers in what remains furniture don't count."""
    wrappers: set[int] = set()
    open_ = [b for b in found if fixed.isdisjoint(b.inside)]
    total = sum(b.plain for b in open_)
    while True:
        free, own = 0, Counter()
        for b in open_:
            left = [e for e in b.inside if e not in wrappers]
            free += 0 if left else b.plain
            for e in left:
                own[e] += b.plain
        more = {e for e, n in own.items() if 2 * n > total and n >= 10 * free}
        if not more:
            break
        wrappers |= more
    for b in found:
        b.furniture = sum(e not in wrappers for e in b.inside)
        b.chain = tuple(c for c, inside in b.chain if wrappers.issuperset(inside))
    return found


def marks(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool, bool]:
    """Whether an element is furniture, whether its name only hints at it, and whether it can't be a wrapper."""
    if tag in FURNITURE or tag == "header" and not in_article:
        return True, False, tag in ("dialog", "footer", "menu") or any(p in NEVER_WRAPS for p in map(str.lower, PART.findall(attributes)))
    if not attributes.strip() or tag in ("html", "body", "article", "main") and "hidden" not in attributes:
        return False, False, False
    hint = False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            for token in value.split():
                parts = {p.lower() for p in PART.findall(token) if not p.isdigit()}
                if parts & NAMES:
                    if parts <= NAMES | PLAIN:
                        return True, False, bool(parts & NEVER_WRAPS)
                    hint = True
        if name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True, False, True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, False, True
    return False, hint, False


class Tokens:
    """Text and tags of a page in order, in linear time."""

    def __init__(self, page: str):
        self.page, self.at, self.broken = page, 0, False

    def tag_end(self, at: int) -> int:
        """Where the tag that began before ``at`` ends (its ``>``), or the page's length."""
        page, i = self.page, at
        while not self.broken:
            i = BEFORE_QUOTE.match(page, i).end()
            if i < len(page) and page[i] == ">":
                return i
            close = page.find(page[i], i + 1) if i < len(page) else -1
            if close < 0:
                self.broken = True  # quotes don't close any more: from here on they mean nothing
            i = close + 1
        end = page.find(">", at)
        return len(page) if end < 0 else end

    def skip(self, mark: str, start: int) -> None:
        end = self.page.find(mark, start)
        self.at = len(self.page) if end < 0 else end + len(mark)

    def __iter__(self):
        """(text, tag, closing, attributes): the text before a tag and the tag, if any."""
        page, begin = self.page, 0
        while True:
            lt = page.find("<", self.at)
            if lt < 0:
                yield page[begin:], "", False, ""
                return
            m = TAG.match(page, lt + 1)
            if m:
                end = self.tag_end(m.end())
                self.at = end + 1
                name = m[0].lower()
                yield page[begin:lt], name.lstrip("/"), name[0] == "/", page[m.end() : end]
            elif page.startswith(("<!", "<?"), lt):
                if page.startswith("<!--", lt):
                    self.skip("-->", lt + 4)
                elif page.startswith("<![CDATA[", lt):
                    self.skip("]]>", lt + 9)
                else:
                    self.skip(">", lt + 2)
                yield page[begin:lt], "", False, ""
            else:
                self.at = lt + 1  # a bare sign
                continue
            if self.at >= len(page):
                return
            begin = self.at

    def skip_raw(self, tag: str) -> None:
        end = END_OF_RAW[tag].search(self.page, self.at)
        self.at = len(self.page)
        if end:
            self.skip(">", end.end())


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple]] = []  # tag, state outside the element
    in_blocks: list[int] = []  # places in the stack of block elements
    opened: Counter[str] = Counter()
    inside: tuple[int, ...] = ()
    hints, silent, heading = 0, 0, False
    chain: tuple[tuple[int, tuple[int, ...]], ...] = ()
    fixed: set[int] = set()
    containers, marked, link = 0, 0, -1  # link: elements open where the link began
    pieces: list[str] = []
    linked: list[str] = []

    def flush() -> None:
        text = " ".join("".join(pieces).split())
        if text:
            out.append(Block(text, len("".join(linked).split()), chain, inside, hints, heading))
        pieces.clear()
        linked.clear()

    def unwind(n: int) -> None:
        nonlocal inside, hints, silent, heading, chain, link
        flush()
        inside, hints, silent, heading, chain = stack[n][1]
        opened.subtract(t for t, _ in stack[n:])
        del stack[n:]
        while in_blocks and in_blocks[-1] >= n:
            in_blocks.pop()
        if link > n:
            link = -1

    tokens = Tokens(page)
    for text, tag, closing, attributes in tokens:
        if text and not silent:
            text = html.unescape(text) if "&" in text else text
            pieces.append(text)
            if link >= 0:
                linked.append(text + " ")
        if not tag:
            continue
        if tag in RAW:
            if not closing:
                tokens.skip_raw(tag)
        elif tag == "br":
            pieces.append(" ")
        elif tag == "a":
            names = "" if closing else attributes.lower()
            link = -1 if closing or ("name=" in names or "id=" in names) and "href" not in names else len(stack)
        elif closing:
            if tag in BLOCK:
                flush()
            if opened[tag] > 0:
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                unwind(k)
        elif tag == "hr":
            flush()
        elif tag not in VOID:
            if tag in BLOCK:
                flush()
                # a new block ends an open paragraph; a list item, cell or row ends its like
                for k in reversed(in_blocks):
                    if stack[k][0] == "p" or stack[k][0] == tag and tag in ITEMS:
                        unwind(k)
                        break
                    if stack[k][0] not in ITEMS:
                        break
                if tag == "body" and stack and stack[-1][0] == "head":
                    unwind(len(stack) - 1)
            sure, hint, never = marks(tag, attributes, bool(chain))
            if tag in BLOCK or tag in SILENT or sure or hint:
                if attributes.rstrip().endswith("/") and tag not in BLOCK:
                    continue
                if tag in SILENT or sure:
                    flush()
                if tag in BLOCK:
                    in_blocks.append(len(stack))
                stack.append((tag, (inside, hints, silent, heading, chain)))
                opened[tag] += 1
                hints, silent = hints + hint, silent + (tag in SILENT)
                if sure and len(inside) < DEEP:
                    inside = (*inside, marked)
                    marked += 1
                    if never:
                        fixed.add(inside[-1])
                heading = heading or tag in HEADINGS
                if tag in ("article", "main") and len(chain) < DEEP:
                    chain = (*chain, (containers, inside))
                    containers += 1
    flush()
    return settle(out, fixed)


def places(found: list[Block]) -> list[int]:
    """2 in the main text's container, 1 around it in a container, -1 elsewhere; 0 if the page has no container."""
    own: Counter[int] = Counter()
    for b in found:
        if b.chain and not b.furniture:
            own[b.chain[-1]] += b.words - min(b.linked, b.words)
    if not own:
        return [0] * len(found)
    most = max(own.values())
    main = {c for c, n in own.items() if 3 * n >= most}
    around = {c for b in found if b.chain and b.chain[-1] in main for c in b.chain[:-1]}
    return [(2 if b.chain[-1] in main else 1 if b.chain[-1] in around else -1) if b.chain else -1 for b in found]


def features(found: list[Block]) -> list[tuple]:
    """One row of FEATURES per block."""
    links = [0.0, *(min(1.0, b.linked / b.words) for b in found), 0.0]
    words = [0, *(b.words for b in found), 0]
    longest = max((b.words for b in found if not b.furniture and 2 * b.linked < b.words), default=1)
    return [
        (b.furniture, place, b.hints, int(b.heading), links[i + 1], links[i], links[i + 2], words[i + 1], words[i], words[i + 2], min(1.0, b.words / longest))
        for i, (b, place) in enumerate(zip(found, places(found), strict=True))
    ]


def extract(page: str, tree: tuple | int) -> str:
    found = blocks(page)
    return "\n\n".join(b.text for b, row in zip(found, features(found), strict=True) if decide(tree, row))


def extract_text(df: DataFrame, column: str = "html", out: str = "text") -> DataFrame:
    """Add ``out``: the main text of each whole page. Other columns pass through."""
    small_batches(df.sparkSession)
    tree = grow(*labelled_table())

    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        return pd.Series([extract(p, tree) for p in batch], dtype=object)

    return df.withColumn(out, run(text_or_empty(column)))
