"""Main text of web pages: flat text blocks classified by a decision tree.

A page is read once into flat blocks: the text between block-level tags, with its words, the share
of them inside links, whether it reads like a notice of rights, and where it stands (in an element for boilerplate, in an element for the
article). A small decision tree, trained on the labelled tables below, decides from these and the neighbours' words and
link density which blocks are main text. The tables hold pages with and without elements and classes that tell what they are for, and
each page is learned a second time without them, so pages that mark nothing are decided by words and links alone.
"""

from __future__ import annotations

import functools
import html as _html
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare_workers

#: Elements whose content is never text.
SKIP = frozenset("script style noscript template svg math iframe object canvas select textarea audio video".split())
#: Elements that hold boilerplate.
BOILER = frozenset("nav footer aside form menu dialog button head title fieldset label".split())
#: Elements inside a line of text; all other tags end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id and role that mark boilerplate.
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promoted banner cookie cookies consent gdpr notice notices alert"
    " sidebar sidenav menu menubar nav navbar navigation breadcrumb breadcrumbs toolbar footer comment comments disqus reply replies respond"
    " share sharing social related recommended newsletter subscribe subscription signup login popup modal overlay widget pagination pager masthead tags search complementary contentinfo".split())
#: The same for elements that mark the article.
ARTICLE_WORDS = frozenset("article articlebody post entry content story main body".split())
#: How notices of rights begin.
_NOTICE = re.compile(r"^\W*(?:©|\(c\)|copyright\b)|©\s*\d{4}", re.I)
_WORD = re.compile("[a-z]+|[A-Z][a-z]*")
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_NAMED = re.compile(r"(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def _kind(name: str, attrs: str, in_article: bool) -> str:
    """boiler, article or empty for an element that opens."""
    marks = set()
    if attrs:
        for m in _NAMED.finditer(attrs):
            marks.update(w.lower() for w in _WORD.findall(next(g for g in m.groups() if g is not None)))
    if name in ("body", "html"):
        return ""
    if name in BOILER or name == "header" and not in_article:
        return "boiler"
    if name in ("article", "main"):
        return "boiler" if marks & {"comment", "comments", "reply"} else "article"
    if marks & BOILER_WORDS:
        return "boiler"
    if "header" in marks and not in_article:
        return "boiler"
    return "article" if name in ("div", "section", "td") and marks & ARTICLE_WORDS else ""


class Block:
    __slots__ = ("text", "words", "linked", "boiler", "article", "notice")

    def __init__(self, text: str, words: int, linked: int, boiler: bool, article: bool, notice: bool | None = None):
        self.text, self.words, self.linked, self.boiler, self.article = text, words, linked, boiler, article
        self.notice = bool(_NOTICE.search(text)) if notice is None else notice


def blocks_of(page: str) -> list[Block]:
    """The flat blocks of a page, in order; malformed and cut pages are read as far as they go."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    opened: Counter = Counter()  # names on the stack, so that an end tag without a start costs nothing
    parts: list[str] = []
    linked_parts: list[str] = []
    boiler = article = links = at = 0
    tag = _TAG

    def flush():
        if parts:
            raw = "".join(parts)
            parts.clear()
            text = " ".join(_html.unescape(raw).split())
            linked = len(_html.unescape(" ".join(linked_parts)).split()) if linked_parts else 0
            linked_parts.clear()
            if text:
                out.append(Block(text, text.count(" ") + 1, linked, boiler > 0, article > 0))

    def close() -> str:
        nonlocal boiler, article
        n, k = stack.pop()
        opened[n] -= 1
        boiler -= k == "boiler"
        article -= k == "article"
        return n

    def take(text: str):
        if text:
            parts.append(text)
            if links:
                linked_parts.append(text)

    end = len(page)
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            take(page[at:])
            break
        take(page[at:lt])
        if page.startswith("<!--", lt):
            stop = page.find("-->", lt + 4)
            at = end if stop < 0 else stop + 3
            continue
        nxt = page[lt + 1: lt + 2]
        if nxt in ("!", "?"):
            stop = page.find(">", lt)
            at = end if stop < 0 else stop + 1
            continue
        m = tag.match(page, lt)
        if m is None and tag is _TAG and (nxt.isalpha() or nxt == "/"):
            tag = _LOOSE  # a quote that is never closed: take tags up to the next >
            m = tag.match(page, lt)
        if m is None:
            if (nxt.isascii() and nxt.isalpha() or nxt == "/") and page.find(">", lt) < 0:
                break  # cut inside a tag
            take("<")
            at = lt + 1
            continue
        at = m.end()
        closing, name, attrs = m[1], m[2].lower(), m[3]
        if name in SKIP:
            if not closing and not attrs.endswith("/"):
                stop = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
                at = end if stop is None else stop.end()
            parts.append(" ") if parts else None
            continue
        if name == "br":
            take(" ")
            continue
        if name in INLINE:
            if name == "a":
                links = 0 if closing else 1
            if name == "a" and not closing and parts:
                linked_parts.append(" ")
            continue
        flush()
        links = 0
        if name in VOID:
            continue
        if closing:
            if opened[name]:
                while close() != name:
                    pass
            continue
        if name == "body":
            while opened["head"]:
                close()
        if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option", "h1", "h2", "h3", "h4", "h5", "h6") and stack and stack[-1][0] in (name, "p"):
            close()  # these close themselves
        kind = _kind(name, attrs, article > 0)
        boiler += kind == "boiler"
        article += kind == "article"
        stack.append((name, kind))
        opened[name] += 1
    flush()
    return out


FEATURES = ("words", "link_density", "prev_words", "prev_density", "next_words", "next_density", "boiler", "article", "page_article", "notice")


def features(blocks: list[Block]) -> np.ndarray:
    """One row a block: its own and its neighbours' words and link density, and where it stands."""
    n = len(blocks)
    w = np.array([b.words for b in blocks], float)
    d = np.array([min(1.0, b.linked / b.words) for b in blocks], float)
    pad = lambda x, k: np.concatenate([[0.0], x[:-1]]) if k < 0 else np.concatenate([x[1:], [0.0]])
    boiler, article = np.array([b.boiler for b in blocks], float), np.array([b.article for b in blocks], float)
    some = np.full(n, float((article * (1 - boiler)).any()))
    notice = np.array([b.notice for b in blocks], float)
    return np.stack([w, d, pad(w, -1), pad(d, -1), pad(w, 1), pad(d, 1), boiler, article, some, notice], axis=1)


#: The labelled table: pages of blocks (words, words in links, boilerplate element, article element, main text).
LABELLED = [
    [(6, 6, 1, 0, 0), (3, 0, 1, 0, 0), (9, 0, 0, 1, 1), (120, 2, 0, 1, 1), (1, 0, 0, 1, 1), (64, 0, 0, 1, 1), (12, 2, 1, 0, 0)],
    [(8, 8, 1, 0, 0), (5, 5, 1, 0, 0), (7, 0, 0, 1, 1), (45, 0, 0, 1, 1), (80, 10, 0, 1, 1), (3, 3, 0, 1, 1), (30, 0, 1, 1, 0), (14, 9, 1, 0, 0)],
    [(4, 4, 1, 0, 0), (11, 0, 0, 1, 1), (2, 0, 0, 1, 1), (200, 0, 0, 1, 1), (40, 4, 1, 1, 0), (55, 0, 1, 0, 0), (20, 1, 1, 0, 0)],
    [(5, 5, 0, 0, 0), (4, 4, 0, 0, 0), (6, 0, 0, 0, 1), (90, 3, 0, 0, 1), (70, 1, 0, 0, 1), (5, 0, 0, 0, 1), (85, 0, 0, 0, 1), (8, 6, 0, 0, 0), (4, 3, 0, 0, 0)],
    [(3, 3, 0, 0, 0), (3, 3, 0, 0, 0), (9, 0, 0, 0, 1), (150, 4, 0, 0, 1), (12, 0, 0, 0, 1), (60, 0, 0, 0, 1), (3, 3, 0, 0, 0), (7, 1, 0, 0, 0), (5, 5, 1, 0, 0)],
    [(2, 2, 0, 0, 0), (8, 0, 0, 1, 1), (110, 0, 0, 1, 1), (15, 15, 0, 0, 0), (25, 0, 0, 0, 0), (6, 0, 0, 0, 0), (60, 3, 1, 0, 0)],
    [(10, 10, 0, 0, 0), (35, 1, 0, 1, 1), (4, 0, 0, 1, 1), (33, 33, 0, 1, 1), (28, 0, 0, 1, 1), (90, 2, 0, 0, 0), (12, 12, 0, 0, 0)],
    [(40, 0, 1, 0, 0), (95, 0, 1, 0, 0), (20, 0, 0, 0, 1), (130, 6, 0, 0, 1), (18, 0, 0, 0, 1), (70, 2, 0, 0, 1), (22, 20, 0, 0, 0), (16, 0, 1, 0, 0)],
    [(26, 0, 0, 0, 1), (31, 0, 0, 0, 1), (17, 1, 0, 0, 1), (48, 4, 0, 0, 1), (2, 2, 0, 0, 0), (2, 2, 0, 0, 0), (2, 0, 0, 0, 0)],
    [(30, 0, 1, 0, 0), (8, 8, 0, 1, 1), (5, 5, 0, 1, 1), (7, 4, 0, 1, 1), (40, 20, 0, 1, 1), (6, 6, 0, 1, 1), (3, 1, 0, 1, 1), (50, 0, 1, 1, 0), (9, 0, 1, 0, 0)],
    [(80, 0, 1, 0, 0), (60, 30, 0, 1, 1), (2, 2, 0, 1, 1), (10, 5, 0, 1, 1), (90, 45, 0, 1, 1), (4, 4, 0, 1, 1), (100, 0, 1, 0, 0), (70, 0, 0, 0, 0)],
    [(45, 2, 1, 0, 0), (12, 6, 0, 1, 1), (12, 12, 0, 1, 1), (2, 1, 0, 1, 1), (5, 0, 0, 0, 0), (75, 1, 0, 0, 0), (33, 0, 1, 0, 0), (140, 3, 1, 0, 0)],
    [(4, 4, 0, 0, 0), (3, 0, 0, 0, 1), (60, 12, 0, 0, 1), (44, 9, 0, 0, 1), (2, 0, 0, 0, 1), (75, 15, 0, 0, 1), (5, 4, 0, 0, 0), (3, 3, 0, 0, 0)],
    [(2, 2, 0, 0, 0), (4, 0, 0, 0, 1), (52, 14, 0, 0, 1), (38, 7, 0, 0, 1), (3, 0, 0, 0, 1), (66, 20, 0, 0, 1), (6, 5, 0, 0, 0), (4, 4, 0, 0, 0)],
    [(3, 3, 1, 0, 0), (20, 0, 0, 1, 1), (4, 4, 0, 1, 1)],
    [(50, 0, 0, 1, 1), (2, 2, 0, 1, 1), (2, 2, 0, 1, 1)],
    [(9, 9, 0, 1, 1), (9, 9, 0, 1, 1), (1, 1, 0, 1, 1)],
    [(5, 0, 0, 1, 1), (8, 8, 0, 1, 1), (70, 0, 0, 0, 0), (6, 6, 0, 0, 0)],
    [(1, 0, 0, 1, 1), (1, 0, 0, 1, 1), (3, 0, 0, 1, 1), (500, 0, 0, 1, 1), (2, 0, 1, 1, 0), (2, 1, 1, 1, 0), (1, 0, 1, 0, 0)],
]


#: Labelled pages as text: the markup of each block and whether it is main text.
PAGES = [
    [("<div><ul><li><a href=/>Home</a>", 0), ("<li><a href=/news>News</a>", 0), ("<li><a href=/c>Contact us</a></ul></div>", 0), ("<div><h1>The river rises again</h1>", 1),
     ("<p>After three days of rain the river has passed the mark of last spring, and the lower streets are closed to cars until the end of the week.</p>", 1),
     ("<p>The mayor asked people to stay at home and to keep an eye on their neighbours.</p>", 1), ("<h2>What comes next</h2>", 1),
     ("<p>More rain is expected on Thursday, though less than before. See <a href=/w>the forecast</a> for the hours to come, which is brought up to date every morning at seven.</p></div>", 1),
     ("<div>© 2021 www.river-post.example.org · Words from the river, every day.</div>", 0)],
    [("<table><tr><td><a href=1>Start</a>", 0), ("<td><a href=2>Shop</a>", 0), ("<td><a href=3>About</a></table>", 0), ("<div>Buy two pans and get the third for nothing, only this week.</div>", 0),
     ("<div><b>How to boil an egg</b></div>", 1), ("<div>Put the egg into cold water, bring it to the boil and take the pan off the heat. Leave it for six minutes if you like it soft and for ten if you do not.</div>", 1),
     ("<div>Then cool it under the tap.</div>", 1), ("<div>Serve.</div>", 1), ("<div>Old eggs peel better than fresh ones, because the skin inside the shell lets go of the white as the egg loses water over the days.</div>", 1),
     ("<div><a href=4>More recipes</a> <a href=5>Pans</a></div>", 0), ("<div>Copyright The Kitchen Table. Do not copy our pictures without asking us first.</div>", 0)],
    [("<nav><a href=1>Titel</a></nav>", 0), ("<article><h1>Ein Haus am See</h1>", 1), ("<p>Das Haus stand leer, seit die alte Frau gestorben war, und niemand im Dorf wollte es haben, weil das Dach bei jedem Regen mehr Wasser ins Zimmer liess.</p>", 1),
     ("<p>Nein.</p>", 1), ("<p>© stand auf einem Schild an der Tür, sonst nichts.</p>", 1), ("<p>Im Herbst kam ein Mann aus der Stadt, sah sich die Zimmer an und blieb.</p></article>", 1), ("<footer>© 2019 www.see.example.de · Alle Rechte vorbehalten.</footer>", 0)],
    [("<div><a href=1>One</a></div>", 0), ("<div><a href=2>Two</a></div>", 0), ("<div><a href=3>Three</a></div>", 0), ("<div><a href=4>Four</a></div>", 0), ("<p>Nothing else was heard of the ship until a fisherman found a door on the beach.</p>", 1),
     ("<p>It was painted green and had a number on it that nobody could explain for years, until a clerk in the harbour office opened the right drawer.</p>", 1), ("<p>He laughed.</p>", 1),
     ("<p>The number was the price that the door had cost when it was new.</p>", 1), ("<div>(c) harbour.example.net · All the news that floats</div>", 0)],
    [("<div>Subscribe to our letter and never miss a story again.</div>", 0), ("<h1>Bread for beginners</h1>", 1), ("<p>Flour, water, salt and time are all that a loaf needs, and time is the one that most people leave out.</p>", 1),
     ("<p>Mix the flour and the water first and let them stand.</p>", 1), ("<p>Salt comes later.</p>", 1), ("<p>Bake the loaf in a pot with a lid for half an hour and without it until it is dark.</p>", 1),
     ("<ul><li><a href=1>Cakes</a>", 0), ("<li><a href=2>Pies</a>", 0), ("<li><a href=3>Soups and stews</a></ul>", 0), ("<p>© bread.example.com · All rights reserved.</p>", 0)],
    [("<header>The Hill Paper</header>", 0), ("<main><h1>Sheep on the road</h1>", 1), ("<p>Forty sheep held up the bus on Monday for an hour and a half, and the driver read the paper twice.</p>", 1), ("<p>Nobody was late, he said, because nobody was on the bus.</p>", 1), ("<p>Copyright was the word on the back of the paper that he read longest.</p></main>", 1),
     ("<aside>Read also: the year of the goats</aside>", 0), ("<section id=comments><p>I was on that bus and I was late for my train!</p></section>", 0), ("<footer><a href=1>Terms</a> <a href=2>Privacy</a></footer>", 0)],
]


class Tree:
    """A small classification tree: Gini splits, grown until the leaves are pure or too small."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 7, least: int = 2):
        self.node = self._grow(x, y, depth, least)

    def _grow(self, x, y, depth, least):
        share = y.mean() if len(y) else 0.0
        best = (share * (1 - share) * len(y) - 1e-9, None, None)
        if depth and 0 < share < 1:
            for f in range(x.shape[1]):
                values = np.unique(x[:, f])
                for cut in (values[1:] + values[:-1]) / 2:
                    left = x[:, f] <= cut
                    if min(left.sum(), (~left).sum()) < least:
                        continue
                    gini = sum(len(s) * s.mean() * (1 - s.mean()) for s in (y[left], y[~left]))
                    if gini < best[0]:
                        best = (gini, f, cut)
        if best[1] is None:
            return share >= 0.5
        left = x[:, best[1]] <= best[2]
        return best[1], best[2], self._grow(x[left], y[left], depth - 1, least), self._grow(x[~left], y[~left], depth - 1, least)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.array([self._one(row) for row in x], bool)

    def _one(self, row) -> bool:
        node = self.node
        while isinstance(node, tuple):
            f, cut, low, high = node
            node = low if row[f] <= cut else high
        return node


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of all blocks of the tables; the pages of text also as if nothing on them were marked, and cut behind their main text."""
    pages = [([Block("", w, l, bool(b), bool(a), False) for w, l, b, a, _ in page], [r[4] for r in page]) for page in LABELLED]
    texts = [(blocks_of("".join(t for t, _ in page)), [m for _, m in page]) for page in PAGES]
    # a notice within an article can only be told from a footer's by where it stands
    plain = [[(b, m) for b, m in zip(*page) if not (m and b.notice)] for page in texts]
    texts += [([Block("", b.words, b.linked, False, False, b.notice) for b, _ in page], [m for _, m in page]) for page in plain]
    for blocks, main in texts:
        end = len(main) - main[::-1].index(1)
        pages += [(blocks, main), (blocks[:end], main[:end])]
    return np.concatenate([features(b) for b, _ in pages]), np.array([float(m) for _, main in pages for m in main])


@functools.lru_cache(maxsize=1)
def tree() -> Tree:
    """The tree of the labelled tables, trained once in each worker."""
    return Tree(*labelled())


def main_text(page: str | None) -> str:
    """Main text of one page: its blocks in order, one a line; empty if there is none."""
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    keep = tree().predict(features(blocks))
    return "\n".join(b.text for b, k in zip(blocks, keep) if k)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` without the html column, with text and n_chars (code points); one row per input row.

    The whole html is read. Null and empty html give an empty text, as do pages without main text. A
    ``text`` or ``n_chars`` column of ``pages`` is replaced; all other columns pass through, nulls too.
    """
    prepare_workers(pages.sparkSession)
    keep = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    schema = pages.select(*keep, F.lit("").alias("text")).schema

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = pa.array([main_text(p.as_py()) for p in b.column(len(keep))], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), texts], [*keep, "text"])

    out = pages.select(*keep, F.col(html).cast("string").alias("__html")).mapInArrow(run, schema)
    return out.withColumn("n_chars", F.length("text").cast("bigint"))
