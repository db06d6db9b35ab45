"""Main-text extraction as a minimum cut.

A page becomes a list of text blocks in page order and the tree of elements that hold them. A linear
classifier gives every block a log odds of being content from its own text alone: the share of linked
characters, its length, how it ends, its element. Elements that say what they are (``nav``, ``article``,
words of class, id and role) have a log odds of their own, for each block below them. All of these
are capacities: positive ones from the source, negative ones to the sink. Smoothness edges join
neighbours in page order, blocks and the elements they stand in, and elements and their parents;
an element that says nothing of itself hangs on its parent with all of its blocks, one that does hangs
on it loosely. The minimum cut, found by augmenting flows level by level, is the labelling of least total
cost: blocks on the source's side are the article. A footer's well-formed sentence goes with the footer,
a one-word item of a list in an article stays with the article: neither could be told by itself.

Defined results: a null or empty page has an empty text; scripts, styles, fields and other elements
without prose never become blocks; character references are decoded; white space inside a block is
one space; blocks are joined by two line feeds; broken markup is read as far as it goes; nothing is cut
off by length; repeated rows are extracted one by one; null ids and URLs are carried along; an empty
table gives an empty one; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.llm.common import tidy

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never prose of the page.
SILENT = frozenset("script style head title noscript template svg math iframe object select option optgroup button textarea datalist canvas audio video map".split())
#: Elements that begin and end a block.
BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
#: A start tag ends an open paragraph, or open elements of the named kinds.
CLOSES_P = BLOCKS - {"html", "body"}
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LIST_SCOPE = frozenset("ul ol dl table".split())

#: Words in class, id and role attributes of elements that hold an article, and of those that hold none.
ARTICLE_WORDS = frozenset("article articlebody content entry main post story body text prose page".split())
OTHER_WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs footer sidebar aside ad ads adv advert advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup signin login search share sharing social related recommended recommendations widget pagination pager comment comments respond reply replies discussion disqus masthead toolbar copyright legal contentinfo complementary skip".split()
)
#: Log odds of an element, for each block of prose below it. Those of forms are smaller, as some pages are one form.
ELEMENT_ODDS = {"article": 4.0, "main": 4.0, "nav": -4.0, "footer": -4.0, "aside": -4.0, "header": -4.0, "dialog": -4.0, "menu": -4.0, "form": -2.5, "fieldset": -2.5}
#: Log odds of a block by the innermost element that holds it.
BLOCK_ODDS = {"p": 0.5, "blockquote": 0.5, "pre": 0.5, "h1": 0.3, "h2": 0.3, "h3": 0.3, "h4": 0.3, "h5": 0.3, "h6": 0.3, "li": -0.3, "td": -0.3}


@dataclass(frozen=True)
class CutConfig:
    """Prose pulls by less than the edges of blocks and elements hold, so it goes with an element that is
    sure of itself; blocks that are mostly links pull by more. These are not counted where
    something goes by the number of blocks: long menus would outvote a short article."""

    base: float = -0.8
    linked: float = -6.0  # times the share of linked characters beyond a third
    sentence: float = 0.8
    long_text: float = 1.2
    page_odds: float = 1.2  # for each block of prose: a page is there for its text
    article_words: float = 2.0
    other_words: float = -4.0
    order_edge: float = 0.3
    block_edge: float = 2.5
    loose_edge: float = 0.75
    tree_edge: float = 1.75  # added for each block of prose below an element without odds of its own


@dataclass
class Block:
    text: str
    odds: float
    element: int


@dataclass
class Element:
    parent: int
    odds: float = 0.0
    blocks: int = 0  # in it and below
    prose: int = 0  # those that are not mostly links


def attribute_words(attrs: list[tuple[str, str | None]]) -> set[str]:
    found: set[str] = set()
    for name, value in attrs:
        if name in ("class", "id", "role", "itemprop") and value:
            value = re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()
            found.update(re.split(r"[^a-z]+", value))
    return found


class PageReader(HTMLParser):
    """Turns a page into blocks and the elements that hold them. Each open tag knows its element."""

    def __init__(self, config: CutConfig):
        super().__init__(convert_charrefs=True)
        self.config = config
        self.blocks: list[Block] = []
        self.elements = [Element(-1)]
        self.stack: list[tuple[str, int, bool]] = []  # tag, element, silent
        self.open: Counter[str] = Counter()  # tags on the stack
        self.buffer: list[str] = []
        self.linked = 0
        self.links = 0
        self.within: list[str] = [""]  # tag of each element

    def _flush(self) -> None:
        text = " ".join("".join(self.buffer).split())
        if text and not (self.stack and self.stack[-1][2]):
            element, c = self.stack[-1][1] if self.stack else 0, self.config
            odds = c.base + BLOCK_ODDS.get(self.within[element], 0.0)
            odds += c.linked * max(0.0, min(1.0, self.linked / len(text)) - 1 / 3)
            odds += c.sentence * (text[-1] in ".!?…:;\"'”»)") + c.long_text * min(1.0, len(text) / 200)
            self.blocks.append(Block(text, odds, element))
            while element >= 0:
                self.elements[element].blocks += 1
                self.elements[element].prose += odds > -c.block_edge
                element = self.elements[element].parent
        self.buffer, self.linked = [], 0

    def _odds(self, tag: str, attrs: list[tuple[str, str | None]], outer: int) -> float:
        """What an element says of itself. Inside one that holds no article, an article is none either:
        readers' comments are often marked up as articles."""
        if tag in ("html", "body"):
            return 0.0
        odds = ELEMENT_ODDS.get(tag, 0.0)
        if tag == "header" and (self.open["article"] or self.open["main"]):
            odds = 0.0
        words = attribute_words(attrs)
        good, bad = bool(words & ARTICLE_WORDS), bool(words & OTHER_WORDS)
        if bad and not good:
            odds = min(odds, self.config.other_words)
        elif good and not bad and odds >= 0:
            odds = max(odds, self.config.article_words)
        while odds > 0 and outer >= 0:
            if self.elements[outer].odds <= self.config.other_words:
                return 0.0
            outer = self.elements[outer].parent
        return odds

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            if tag in ("br", "wbr"):
                self.buffer.append(" " if tag == "br" else "")
            elif tag == "hr":
                self._flush()
            return
        if tag in BLOCKS or tag in SILENT:
            self._flush()
            if tag in CLOSES_P:
                self._close("p", LIST_SCOPE | {"td", "th", "article", "section", "div", "body"})
            for other in SIBLINGS.get(tag, ()):
                self._close(other, LIST_SCOPE)
        _, element, silent = self.stack[-1] if self.stack else ("", 0, False)
        if tag in BLOCKS:
            self.elements.append(Element(element, self._odds(tag, attrs, element)))
            self.within.append(tag)
            element = len(self.elements) - 1
        self.links += tag == "a"
        self.stack.append((tag, element, silent or tag in SILENT))
        self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "math", "path"):
            self.handle_endtag(tag)

    def _close(self, tag: str, scope: frozenset[str] = frozenset()) -> None:
        if not self.open[tag]:
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                self._flush()
                self.links -= sum(t == "a" for t, *_ in self.stack[k:])
                self.open.subtract(t for t, *_ in self.stack[k:])
                del self.stack[k:]
                return
            if self.stack[k][0] in scope:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID:
            if tag == "br":
                self.buffer.append(" ")
            return
        if self.open[tag]:
            if tag in BLOCKS or tag in SILENT:
                self._flush()
                self._close(tag)
            else:  # an inline end tag closes the nearest such element and leaves blocks open
                for k in range(len(self.stack) - 1, -1, -1):
                    if self.stack[k][0] == tag:
                        self.links -= tag == "a"
                        self.open[tag] -= 1
                        del self.stack[k]
                        return
                    if self.stack[k][0] in BLOCKS:
                        return

    def handle_data(self, data: str) -> None:
        self.buffer.append(data)
        if self.links:
            self.linked += len(data)

    def read(self, page: str) -> list[Block]:
        end = page.rfind("-->") + 1  # comments that never end are no comments; each would be sought to the end
        self.feed(page[:end] + page[end:].replace("<!--", ""))
        self.close()
        self._flush()
        return self.blocks


class FlowNetwork:
    """Residual capacities as adjacency lists; edges come in pairs ``e`` and ``e ^ 1``."""

    def __init__(self, n: int):
        self.at: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.room: list[float] = []

    def join(self, a: int, b: int, there: float, back: float = 0.0) -> None:
        for x, y, room in ((a, b, there), (b, a, back)):
            self.at[x].append(len(self.to))
            self.to.append(y)
            self.room.append(room)

    def levels(self, source: int) -> list[int]:
        level = [-1] * len(self.at)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in self.at[a]:
                b = self.to[e]
                if level[b] < 0 and self.room[e] > 1e-12:
                    level[b] = level[a] + 1
                    queue.append(b)
        return level

    def source_side(self, source: int, sink: int) -> list[bool]:
        """Saturate all shortest paths of the residual network, again and again until the sink is out
        of reach; what is still in reach is the source's side."""
        while (level := self.levels(source))[sink] >= 0:
            turn = [0] * len(self.at)
            path: list[int] = []
            a = source
            while True:
                if a == sink:
                    least = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= least
                        self.room[e ^ 1] += least
                    while path and self.room[path[-1]] > 1e-12:
                        path.pop()
                    full = min(k for k, e in enumerate(path + [-1]) if e < 0 or self.room[e] <= 1e-12) if path else 0
                    del path[full:]
                    a = self.to[path[-1]] if path else source
                    continue
                while turn[a] < len(self.at[a]):
                    e = self.at[a][turn[a]]
                    if self.room[e] > 1e-12 and level[self.to[e]] == level[a] + 1:
                        break
                    turn[a] += 1
                else:
                    if a == source:
                        break
                    level[a] = -1
                    a = self.to[path.pop() ^ 1]
                    continue
                path.append(e)
                a = self.to[e]
        return [x >= 0 for x in level]


def content_blocks(blocks: list[Block], elements: list[Element], config: CutConfig) -> list[bool]:
    """The minimum cut over blocks and the elements that hold them."""
    used = [k for k, e in enumerate(elements) if e.blocks]
    number = {e: len(blocks) + k for k, e in enumerate(used)}
    source, sink = len(blocks) + len(used), len(blocks) + len(used) + 1
    net = FlowNetwork(sink + 1)

    def pull(node: int, odds: float) -> None:
        if odds > 0:
            net.join(source, node, odds)
        elif odds < 0:
            net.join(node, sink, -odds)

    for k, b in enumerate(blocks):
        pull(k, b.odds)
        net.join(k, number[b.element], config.block_edge, config.block_edge)
        if k:
            net.join(k - 1, k, config.order_edge, config.order_edge)
    for e, node in number.items():
        at = elements[e]
        if at.parent < 0:
            pull(node, config.page_odds * at.prose)
        else:
            pull(node, at.odds * at.prose)
            edge = config.loose_edge + (0.0 if at.odds else config.tree_edge * at.prose)
            net.join(node, number[at.parent], edge, edge)
    return net.source_side(source, sink)[: len(blocks)]


def main_text(page: str | None, config: CutConfig = CutConfig()) -> tuple[str, int, int, int]:
    """The article, the number of blocks, how many of them are content, and how many the cut labels
    otherwise than their own odds do."""
    reader = PageReader(config)
    blocks = reader.read(page or "")
    if not blocks:
        return "", 0, 0, 0
    keep = content_blocks(blocks, reader.elements, config)
    return "\n\n".join(b.text for b, k in zip(blocks, keep) if k), len(blocks), sum(keep), sum(k != (b.odds > 0) for b, k in zip(blocks, keep))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", config: CutConfig = CutConfig()) -> DataFrame:
    """One row per page: the id, the URL, ``text``, ``n_chars``, ``n_blocks``, ``n_content`` and ``n_overruled``, the
    blocks whose label is the cut's and not their own."""
    schema = pa.schema([("id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("n_blocks", pa.int64()), ("n_content", pa.int64()), ("n_overruled", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                found = [main_text(p, config) for p in batch.column(2).to_pylist()]
                text, *numbers = zip(*found)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64()), *(pa.array(n, pa.int64()) for n in numbers)], schema=schema)

    slim = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    out = slim.mapInArrow(tidy(run), "id long, url string, text string, n_chars long, n_blocks long, n_content long, n_overruled long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
