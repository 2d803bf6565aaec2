"""Main text of web pages, by the container that the pages of a host agree on."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import md5
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwitable.llm.common import sliced
from dwitable.session import settled

HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style textarea title iframe xmp noembed noframes"
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr output q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var".split())
CONTAINERS = frozenset("#root body article main div section td center blockquote".split())
ASIDE = frozenset(
    "head nav header footer aside form button select option datalist fieldset dialog menu noscript template svg math object "
    "audio video canvas map".split())
IN_HEAD = frozenset("base link meta title script style noscript template".split())
CLOSES = {  # a start tag ends an open element of these kinds, up to the nearest of the second kind
    "li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"),
    "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"),
    "article": ("nav header", "body"), "main": ("nav header", "body"), "body": ("head", "html"),
}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
# Words in class, id and role that mark what is no article, and what is one.
LAYOUT = frozenset(
    "sidebar side menu nav navbar navigation breadcrumb breadcrumbs masthead topbar header footer widget widgets toolbar "
    "contentinfo complementary".split())
MARKS = LAYOUT | frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "notification alert popup modal overlay newsletter subscribe subscription signup share sharing social related recommended "
    "recommendations comment comments reply replies respond discussion disqus pagination pager login search".split())
#: Among them the words of blocks that have articles of their own, which are not the page's.
BLOCKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner related recommended recommendations "
    "comment comments reply replies respond discussion disqus".split())
#: A name with one of these words, as has-comments, tells what is inside or around and not what the element is.
STATES = frozenset("has with no without non open enabled disabled".split())
GOOD = frozenset("article content entry post story main body text".split())

#: A tag's attributes: a quoted value counts only after an equals sign, an unquoted one ends at white space or the tag's end.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + RAW.replace(" ", "|") + r")\b[^>]*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*+)(?P<attrs>(?:=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)|[^>=]++|=)*+)>"
    r"|<[!?/][^>]*+>", re.I | re.S)
ATTRIBUTE = re.compile(r"([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"'][^\s>]*+)))?+")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class _Node:
    """An open or closed element."""

    __slots__ = ("tag", "path", "parent", "mark", "fixed", "order", "likely", "own", "clear", "aside", "good", "whole", "free", "shut", "linked", "inside")

    def __init__(self, tag: str, path: str, parent: _Node | None, mark: int, fixed: bool, order: int, likely: bool):
        self.tag, self.path, self.parent, self.mark, self.fixed, self.order, self.likely = tag, path, parent, mark, fixed, order, likely
        self.own = self.clear = 0  # characters of the element itself: all, and those outside links
        self.aside = self.good = self.whole = 0  # the mark that holds; characters outside links and marked parts, and all
        self.free, self.shut = 0, False  # characters outside links that lie in no part marked for sure by its tag
        self.linked = 0  # characters in links outside marked parts
        self.inside: list[tuple[int, int]] = []  # ranges of pieces


#: How an element is marked: not, by words that also name the layout around an article, by other words or as a form, or as what
#: has no article of the page in it.
NOT, MAYBE, LOOSE, SURE = range(4)
#: Shares of a page's text: more than half, nearly all, and so little that it is not the article.
HALF, NEARLY, FEW = 0.5, 0.9, 0.05
#: Paths from this length on begin with a digest of what is above.
LONG_PATH = 2000
#: A host's path with a smaller share of what the page's own best container holds is a box on that page.
SMALL = 0.2


def _attributes(text: str) -> tuple[str, int, bool, bool]:
    """The generalised classes, how far the words mark no article, whether they mark one, and whether the element is hidden."""
    classes, words, marks, hidden = "", set(), set(), False
    known: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(text):
        known.setdefault(name.lower(), a or b or c)
    for name, value in known.items():
        if name == "class":
            classes = "".join("." + x for x in sorted({re.sub(r"\d+", "#", x) for x in value.lower().split()}))
        if name in ("class", "id", "role"):
            for each in value.split():
                found = {x.lower() for x in WORDS.findall(each)}
                words |= found
                if not found & STATES:
                    marks |= found & MARKS
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            hidden = True
        elif name == "style" and "display:none" in value.replace(" ", "").lower():
            hidden = True
    good = bool(words & GOOD)
    if hidden or marks & BLOCKS:
        return classes, SURE, good, hidden
    return classes, LOOSE if marks - LAYOUT else MAYBE if marks and not good else NOT, good, hidden


class Page:
    """A page's text pieces and the containers they lie in. Broken markup is closed where HTML implies it."""

    def __init__(self, html: str):
        self.pieces: list[tuple[str, _Node | None]] = []  # text as written and its element, or a break
        root = _Node("#root", "", None, NOT, False, 0, False)
        self.nodes, self.stack, self.link = [root], [root], False
        at = 0
        for m in TOKEN.finditer(html):
            if m.start() > at:
                self._text(html[at : m.start()])
            at = m.end()
            if m["tag"]:
                (self._end if m["end"] else self._start)(m["tag"].lower(), m["attrs"])
        if at < len(html):
            self._text(html[at:])
        self._pop(0)
        self._weigh()
        while self._lift():
            self._weigh()

    def _text(self, raw: str) -> None:
        text = unescape(raw) if "&" in raw else raw
        size = len("".join(text.split()))
        node = self.stack[-1]
        if size and node.tag == "head":
            self._pop(len(self.stack) - 1)
            node = self.stack[-1]
        self.pieces.append((text, node))
        node.own += size
        if not self.link:
            node.clear += size

    def _break(self) -> None:
        self.pieces.append((" ", None))

    def _pop(self, depth: int) -> None:
        """Closes elements until ``depth`` are open."""
        while len(self.stack) > depth:
            node = self.stack.pop()
            node.inside = [(node.order, len(self.pieces))]

    def _weigh(self) -> None:
        """Which marks hold, the characters of every element, and the containers outside marked parts."""
        for n in self.nodes:
            if n.parent is None or n.tag in ("html", "body"):
                n.aside = NOT
            elif n.tag in ("article", "main"):  # what lies around it only named the layout, a state or a form
                n.aside = SURE if n.parent.aside == SURE else NOT if n.mark == MAYBE else n.mark
            else:
                n.aside = max(n.parent.aside, n.mark)
            n.whole, n.good, n.linked = n.own, 0 if n.aside else n.clear, 0 if n.aside else n.own - n.clear
        for n in reversed(self.nodes[1:]):
            n.parent.whole += n.whole
            n.parent.good += n.good
            n.parent.linked += n.linked
        self.containers = [n for n in self.nodes if n.tag in CONTAINERS and not n.aside]

    def _lift(self) -> bool:
        """Takes back marks of words and forms that lie around the article itself; whether there were any.

        A page that has an unmarked container named as an article keeps its marks. Elsewhere marks go that lie around a
        container named as an article with half of the text, or, of words that also name no layout, around nearly all text.
        On a page without any unmarked text those around most of it go, and last of all those of comments and adverts.
        """
        root = self.nodes[0]
        named = max((n.good for n in self.containers if n.likely), default=0)
        if root.whole and named >= FEW * root.whole or not any(n.mark and not n.fixed for n in self.nodes):
            return False
        for n in self.nodes:
            n.shut = n.fixed or (n.parent is not None and n.parent.shut and n.tag not in ("html", "body"))
            n.free = 0 if n.shut else n.clear
        for n in reversed(self.nodes[1:]):
            n.parent.free += n.free
        if not root.free or named >= FEW * root.free:
            return False
        lifted = []
        inner = [n for n in self.nodes if n.likely and n.tag in CONTAINERS and n.aside in (MAYBE, LOOSE) and not n.mark
                 and n.free >= HALF * root.free]
        if inner:
            at = inner[0].parent
            while at is not None and at.aside:
                if at.mark:
                    lifted.append(at)
                at = at.parent
        else:
            marked = [n for n in self.nodes if n.mark and n.aside and not n.shut and n.free]
            if root.good:
                lifted = [n for n in marked if n.mark == LOOSE and n.aside == LOOSE and n.free >= (1 - FEW) * root.free]
            else:
                lifted = ([n for n in marked if n.mark == LOOSE and n.free > HALF * root.free or n.mark == MAYBE and n.free >= NEARLY * root.free]
                          or [n for n in marked if n.mark == SURE and n.free >= NEARLY * root.free])
            lifted = [n for n in lifted if n.free == lifted[0].free]
        for n in lifted:
            n.mark = NOT
        return bool(lifted)

    def _start(self, tag: str, attrs: str) -> None:
        if tag in INLINE:
            self.link = tag == "a" or self.link
            return
        self._break()
        if tag in VOID:
            return
        self.link = False
        if self.stack[-1].tag == "p" and tag not in IN_HEAD:
            self._pop(len(self.stack) - 1)
        if self.stack[-1].tag == "head" and tag not in IN_HEAD:
            self._pop(len(self.stack) - 1)
        if tag in CLOSES:
            kinds, bound = CLOSES[tag]
            lowest = None
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i].tag in bound:
                    break
                if self.stack[i].tag in kinds:
                    lowest = i
            if lowest is not None:
                self._pop(lowest)
        if tag in ("html", "body") and any(n.tag == tag for n in self.stack):
            return
        classes, mark, likely, fixed = _attributes(attrs) if attrs.strip() else ("", NOT, False, False)
        if tag in ("html", "body"):
            mark, fixed = NOT, False
        elif tag == "form":
            mark = max(mark, LOOSE)
        elif tag in ASIDE:
            mark, fixed = SURE, True
        parent = self.stack[-1]
        above = parent.path if len(parent.path) < LONG_PATH else "#" + md5(parent.path.encode()).hexdigest()
        path = f"{above}>{tag}{classes}"
        node = _Node(tag, path, parent, mark, fixed, len(self.pieces), likely or tag in ("article", "main"))
        self.stack.append(node)
        self.nodes.append(node)

    def _end(self, tag: str, _: str) -> None:
        if tag in INLINE:
            self.link = self.link and tag != "a"
            return
        self._break()
        self.link = False
        if tag in VOID or tag in ("html", "body"):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                self._pop(i)
                return

    @staticmethod
    def score(node: _Node) -> float:
        """Text outside links and marked parts, times its share of all text, and more for a container named as an article."""
        return node.good * node.good / node.whole * (1.5 if node.likely else 1.0) if node.whole else 0.0

    def best(self) -> _Node:
        """The container with the highest score, the innermost of equal ones, or what holds the article's other parts too.

        A container around it is taken as long as it adds much text that is not in links, so that an article in several
        sections is whole although their common parent has a menu as well; around one that is named as an article, still
        more. An article or main element is whole by itself.
        """
        found = max(self.containers, key=lambda n: (self.score(n), n.order))
        around = found.parent
        while around is not None and found.tag not in ("article", "main"):
            if around.aside or around.tag not in CONTAINERS:
                around = around.parent
                continue
            more = around.good - found.good
            linked = around.linked - found.linked
            if more < (HALF if found.likely else SMALL) * found.good or linked > HALF * more:
                around = around.parent
                continue
            found, around = around, around.parent
        return found

    def text(self, nodes: list[_Node]) -> str:
        """The containers' text in page order, without marked parts; white space and breaks are one space."""
        parts, last = [], 0
        for node in nodes:
            start, end = node.inside[0]
            parts.extend(t for t, n in self.pieces[max(start, last) : end] if n is None or not n.aside)
            parts.append(" ")
            last = max(last, end)
        return " ".join("".join(parts).split())

    def main_text(self, path: str | None) -> tuple[str, str]:
        """The text and path of the host's containers, all that lie at the path, or of the page's own best container.

        The own best one counts if the host's are not there or have no text, and if they hold little of the text that it
        holds, unless they are named as an article and it is not.
        """
        own, found = self.best(), [n for n in self.containers if n.path == path]
        good, likely = sum(n.good for n in found), any(n.likely for n in found)
        if not good or (good < SMALL * own.good and (own.likely or not likely)):
            return self.text([own]), own.path
        return self.text(found), path


def with_host(pages: DataFrame) -> DataFrame:
    """``(page_id, url, html, host)``; an absent host is null."""
    host = F.regexp_extract(F.lower("url"), HOST, 1)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"),
                        F.when(F.length(host) > 0, host).alias("host"))


def winning_paths(pages: DataFrame) -> DataFrame:
    """The container path most pages of a host vote for: ``(host, winner)``; of equal ones the higher score, then the path."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            best = [(p := Page(x), p.best()) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0).cast(pa.string()), pa.array([n.path for _, n in best], pa.string()),
                                   pa.array([float(p.score(n)) for p, n in best], pa.float64())], ["host", "path", "score"])

    votes = pages.where("host is not null").select("host", "html").mapInArrow(vote, "host string, path string, score double")
    counted = votes.where("score > 0").groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("score").alias("score"))
    return counted.groupBy("host").agg(F.max_by("path", F.struct("n", F.round("score", 3), "path")).alias("winner"))


def main_texts(pages: DataFrame) -> DataFrame:
    """Every page with its main text: ``(page_id, url, text, path)``.

    Each page scores its containers and votes for the best one's path of tags and classes, digits generalised. Votes are
    counted by host and path, so a host with very many pages is summed up before it meets in one place. Each page is then
    read again at its host's winning path: the text of all containers there, in page order, or the page's own best one if those
    are a small box on that page (``Page.main_text``). Menus, headers, footers, asides, forms, scripts, adverts, notices and comments,
    told by tag or by a word of class, id or role, are left out; a mark on a wrapper around the article itself does not count
    (``Page._lift``). Character references are decoded; white space and
    the end of a block are one space.

    A null or empty html, and a page without text, give an empty text. A null or unreadable url has no host, and the page's own
    best container counts. Repeated rows give repeated rows. An empty table gives an empty result; other columns are ignored.
    """
    rows = with_host(pages)
    winners = settled(winning_paths(rows), "paths")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [Page(h).main_text(w) for h, w in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1).cast(pa.string()), pa.array([t for t, _ in found], pa.string()),
                                   pa.array([p for _, p in found], pa.string())], ["page_id", "url", "text", "path"])

    joined = rows.join(winners, "host", "left").select("page_id", "url", "html", "winner")
    return joined.mapInArrow(extract, "page_id long, url string, text string, path string")
