"""Main text of web pages by tree scoring.

A tolerant parser builds the element tree. Each text block (a paragraph, heading, list item, cell, or text
that stands bare in a container) outside boilerplate gives its container points for being there, for its
commas and for its length; the container's container gets half. A container's points are discounted by the
share of its text that is in links and shifted by its element and by words in its class and id. The best
container is widened to the article or main element around it, and then to each parent (the body aside) most of whose
text is kept already; all of it is kept (of what such a parent adds, not the blocks and elements that are mostly links),
with siblings that score near it and, beside it, headings, paragraphs,
quotes, lists, tables and sections with few links.

Boilerplate are navigation, page headers and footers, sidebars, notices, adverts, forms, reader comments, scripts,
styles, hidden elements (by element, role, or words in class and id). Words alone do not drop an element that has
article words beside them (unless its text is mostly links), holds the main element, the longest article or an h1, or
holds most of the page's running text (beside an article or main element with text: five blocks and four fifths of it
at least, and not reader comments): a layout wrapper is often named after what stands beside the article.
An element that is boilerplate by its kind or role is dropped if it has its end tag; a form or fieldset, and an element
that is never closed, is kept where it holds the main element, an article with most of the running text (and none stands outside), or
four fifths of the running text (beside an article or main element with text: in five blocks at least). A main element ends open
navigation, headers, footers and sidebars, as it can't stand in them. Time and memory grow linearly with the page.

In the kept part every block is one line of output: character references decoded, white space
turned into one space, trimmed; empty blocks go; blocks are joined in page order by two newlines.

Edge cases: null or empty html and pages without text give an empty text; unclosed and truncated markup is
closed at its end; a page whose blocks are all short falls back to its article or main element, else its
body; markup is read whole, whatever its length; repeated rows are extracted one by one; extra columns are
ignored.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Element groups of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe object svg math select option canvas audio video "
                "noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption "
                  "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section "
                  "summary table tbody td tfoot th thead tr ul".split())
LEAF = frozenset("p pre li td th dd dt h1 h2 h3 h4 h5 h6 blockquote figcaption summary address".split())
DROPPED = frozenset("nav footer aside form button head menu dialog search fieldset".split())
WRAPPERS = frozenset("form fieldset".split())  # pages are wrapped in these
ENDED_BY_MAIN = frozenset("nav footer header aside menu search button".split())
# What an opening element closes: the nearest of the group, unless one of the walls is nearer.
CLOSES = {tag: (group, walls) for group, walls in (
    (("li",), ("ul", "ol", "menu")), (("dd", "dt"), ("dl",)), (("td", "th"), ("tr", "table")),
    (("tr",), ("table", "tbody", "thead", "tfoot"))) for tag in group}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar "
                  "toolbar".split())
BOILERPLATE = frozenset(
    "ad ads advert advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent "
    "gdpr notice notification popup modal overlay newsletter subscribe subscription signup menu nav navbar navigation "
    "breadcrumb breadcrumbs sidebar aside widget widgets footer foot header masthead share sharing social related "
    "recommended recommendations comment comments disqus reply replies respond login search toolbar pagination pager "
    "skip copyright".split())
READERS = frozenset("comment comments disqus reply replies respond".split())
ARTICLE = frozenset("article post entry story content main body text".split())
ELEMENT_POINTS = {"article": 10, "main": 10, "section": 3, "div": 5, "pre": 3, "td": 3, "blockquote": 3, "ol": -3, "ul": -3,
                  "dl": -3, "li": -3, "form": -3, "address": -3}
# What is kept beside the best container, if it has few links.
BESIDE = frozenset("p pre h1 h2 h3 h4 h5 h6 blockquote ul ol dl table section figure".split())
SHORT_BLOCK, SIBLING_SHARE, FEW_LINKS, KEPT_SHARE = 25, 0.2, 0.25, 2 / 3

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]++|=\s*+(?:"[^"]*"|'[^']*'|[^\s>"']*+)|["'])*+)(?:>|\Z)""", re.DOTALL)
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "drop", "points", "chars", "linked", "named", "bad", "hard", "ended", "prose", "runs",
                 "core", "inside", "kept")

    def __init__(self, tag: str, parent: Node | None, drop: bool, named: float, bad: frozenset = frozenset(),
                 hard: str = ""):
        self.tag, self.parent, self.drop, self.named, self.bad, self.hard = tag, parent, drop, named, bad, hard
        self.points, self.chars, self.linked, self.ended = None, 0, 0, False
        self.prose, self.runs, self.core, self.kept = 0, 0, False, False
        # In an article or main element, or one itself.
        self.inside = tag in ("article", "main") or parent is not None and parent.inside


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTR.finditer(raw)}


def _judge(tag: str, raw: str, parent: Node) -> tuple[bool, str, float, frozenset]:
    """(hidden, boilerplate by kind or role, points for class and id, boilerplate words in them) of an element.

    The second is "part", "wrapper" for what may be wrapped around a page, or "".
    """
    hard = "wrapper" if tag in WRAPPERS else "part" if tag in DROPPED or tag == "header" and not parent.inside else ""
    if not raw.strip():
        return False, hard, 0.0, frozenset()
    attrs = _attributes(raw)
    style = attrs.get("style", "").replace(" ", "").lower()
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style:
        return True, hard, 0.0, frozenset()
    role = attrs.get("role", "").lower()
    if not hard and role in ROLES:
        hard = "wrapper" if role == "form" else "part"
    named = {t.lower() for t in _TOKEN.findall(f"{attrs.get('class', '')} {attrs.get('id', '')}")}
    bad, good = frozenset(named & BOILERPLATE), named & ARTICLE
    if tag in ("html", "body", "article", "main"):
        return False, hard, 0.0, bad
    if good and bad <= {"header", "banner"} or bad <= {"header"} and parent.inside:
        bad = frozenset()
    # Article words and boilerplate words outweigh each other.
    return False, hard, 25.0 if good and not bad else -25.0 if bad and not good else 0.0, bad


class _Page:
    """Elements, and text blocks as (text, link characters, owner) in page order."""

    def __init__(self, html: str):
        self.root = Node("html", None, False, 0.0)
        self.blocks: list[tuple[str, int, Node]] = []
        self.stack, self.at, self.links = [self.root], defaultdict(list), 0  # at: places in the stack by element
        self.inline, self.inline_open = [], Counter()
        self.nodes: list[Node] = []  # parents before their children
        self.by_name = False  # the inline elements that hide text do so by their names alone
        self.run: list[tuple[str, bool]] = []
        self._read(html)
        self._drop_hard()
        self._drop_named()

    def _weigh(self) -> None:
        """Sum up the blocks of every element."""
        for n in (self.root, *self.nodes):
            n.chars = n.linked = n.prose = n.runs = 0
        for text, linked, owner in self.blocks:
            owner.chars += len(text)
            owner.linked += linked
            if len(text) >= SHORT_BLOCK:
                owner.prose += len(text) - linked
                owner.runs += 2 * linked < len(text)
        for n in reversed(self.nodes):
            n.parent.chars += n.chars
            n.parent.linked += n.linked
            n.parent.prose += n.prose
            n.parent.runs += n.runs

    def _drop(self) -> None:
        """Take out what lies in dropped elements."""
        for n in self.nodes:
            n.drop = n.drop or n.parent.drop
        self.blocks = [b for b in self.blocks if not b[2].drop]

    def _drop_hard(self) -> None:
        """Drop the elements that are boilerplate by their kind or role, but for wrappers of the article."""
        suspects = []
        for n in self.nodes:
            if n.hard and not n.drop:
                if n.ended and n.hard == "part":
                    n.drop = True
                else:
                    suspects.append(n)
        self._drop()
        if not suspects:
            return
        self._weigh()
        articles = [n for n in self.nodes if n.tag in ("article", "main") and not n.drop and n.chars > n.linked]
        shut = {id(n) for n in suspects}
        for n in self.nodes:
            if id(n.parent) in shut:
                shut.add(id(n))
        outside = any(not n.bad and id(n) not in shut for n in articles)
        for core in articles:
            if core.tag == "main" or not core.bad and not outside and 2 * core.prose > self.root.prose:
                self._mark(core)
        for n in suspects:
            most = 0 < 4 * self.root.prose <= 5 * n.prose and (not articles or n.runs >= 5)
            n.drop = n.drop or not (n.core or most)
        for n in self.nodes:
            n.core = False
        self.root.core = False
        self._drop()

    @staticmethod
    def _mark(node: Node | None) -> None:
        while node is not None and not node.core:
            node.core = True
            node = node.parent

    def _drop_named(self) -> None:
        """Drop the elements that are boilerplate by their names, and their blocks."""
        suspects = [n for n in self.nodes if n.bad and n.tag not in ("html", "body", "article", "main") and not n.drop]
        self._weigh()
        if not suspects:
            return
        articles = [n for n in self.nodes if n.tag == "article" and not n.drop and not n.bad and n.chars > n.linked]
        cores = [n for n in self.nodes if n.tag in ("main", "h1") and not n.drop]
        if articles:
            cores.append(max(articles, key=lambda n: n.prose))
        for core in cores:
            self._mark(core)
        has_article = any(n.tag in ("article", "main") and n.chars > n.linked for n in cores)
        for n in suspects:
            most = 2 * n.prose > self.root.prose
            if has_article:
                most = 5 * n.prose >= 4 * self.root.prose and n.runs >= 5 and not n.bad & READERS
            if n.core or most:
                n.named = max(n.named, 0.0)
            elif n.named < 0 or 2 * n.linked > n.chars:
                n.drop = True
        self._drop()
        self._weigh()

    def _end_block(self) -> None:
        if self.run:
            text = _SPACE.sub(" ", "".join(t for t, _ in self.run)).strip()
            if text:
                linked = sum(len(_SPACE.sub(" ", t).strip()) for t, a in self.run if a)
                self.blocks.append((text, min(linked, len(text)), self.stack[-1]))
            self.run = []

    def _cut(self, i: int) -> None:
        """Close all elements from place ``i`` of the stack on."""
        while len(self.stack) > i:
            self.at[self.stack.pop().tag].pop()

    def _last(self, tags: Iterable[str]) -> int:
        return max((self.at[t][-1] for t in tags if self.at[t]), default=0)

    def _open(self, tag: str, raw: str) -> None:
        self._end_block()
        self.links = 0
        if tag != "hr":
            if self.at["p"]:
                self._close("p")
            if tag in CLOSES:
                group, walls = CLOSES[tag]
                if (i := self._last(group)) > self._last(walls):
                    self._cut(i)
            if tag == "main" and (i := min((self.at[t][0] for t in ENDED_BY_MAIN if self.at[t]), default=0)):
                self._cut(i)
            if tag == "body" or tag in ("article", "main", "h1") and self.by_name:
                self._inline_clear()  # an inline element around the article is a wrapper
            parent = self.stack[-1]
            drop, hard, named, bad = _judge(tag, raw, parent)
            self.at[tag].append(len(self.stack))
            self.stack.append(Node(tag, parent, drop or parent.drop, named, bad, hard))
            self.nodes.append(self.stack[-1])

    def _close(self, tag: str) -> None:
        self._end_block()
        self.links = 0
        if self.at[tag]:
            i = self.at[tag][-1]
            self.stack[i].ended = True
            self._cut(i)

    def _read(self, html: str) -> None:
        at, n = 0, len(html)
        while at < n:
            lt = html.find("<", at)
            if lt < 0:
                self._text(html[at:])
                break
            if lt > at:
                self._text(html[at:lt])
            m = _TAG.match(html, lt)
            if not m:
                self._text("<")
                at = lt + 1
                continue
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                if tag in BLOCK:
                    self._close(tag)
                elif tag == "a":
                    self.links = max(0, self.links - 1)
                self._inline_end(tag)
            elif tag in RAW:
                if not m[3].endswith("/"):
                    end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.IGNORECASE).search(html, at)
                    at = end.end() if end else n
            elif tag == "br":
                self._text(" ")
            elif tag in BLOCK:
                self._open(tag, m[3])
            elif tag == "a":
                self.links += 1
            elif tag not in VOID and (m[3].strip() or tag in DROPPED):
                self._inline_start(tag, m[3])
        self._end_block()

    def _inline_start(self, tag: str, raw: str) -> None:
        """A hidden or boilerplate inline element hides its text."""
        drop, hard, named, _ = _judge(tag, raw, self.stack[-1])
        if not self.inline:
            self.by_name = not drop
        elif drop:
            self.by_name = False
        if self.inline or drop or hard or named < 0:
            self.inline.append(tag)
            self.inline_open[tag] += 1

    def _inline_end(self, tag: str) -> None:
        if self.inline_open[tag]:
            while True:
                last = self.inline.pop()
                self.inline_open[last] -= 1
                if last == tag:
                    break
        elif tag in BLOCK:
            self._inline_clear()

    def _inline_clear(self) -> None:
        self.inline.clear()
        self.inline_open.clear()

    def _text(self, raw: str) -> None:
        if not self.inline and not self.stack[-1].drop:
            self.run.append((_html.unescape(raw) if "&" in raw else raw, self.links > 0))


def _density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def main_blocks(html: str | None) -> list[str]:
    """The kept blocks in page order."""
    page = _Page(html or "")
    containers: dict[int, Node] = {}
    for text, linked, owner in page.blocks:
        if len(text) < SHORT_BLOCK:
            continue
        points = (1 + text.count(",") + text.count("，") + min(len(text) // 100, 3)) * (1 - linked / len(text))
        holder = owner.parent if owner.tag in LEAF and owner.parent is not None else owner
        for node, share in ((holder, 1.0), (holder.parent, 0.5)):
            if node is not None:
                if node.points is None:
                    node.points = ELEMENT_POINTS.get(node.tag, 0) + node.named
                    containers[id(node)] = node
                node.points += points * share
    score = {k: n.points * (1 - _density(n)) for k, n in containers.items()}
    if not score:
        return _fallback(page)
    best = containers[max(score, key=lambda k: score[k])]  # the first in page order among equals
    bar = max(10.0, score[id(best)] * SIBLING_SHARE)
    root, node = best, best
    while node is not None:
        if node.tag in ("article", "main"):
            root = node
            break
        node = node.parent

    def is_kept(child: Node) -> bool:
        """Of the children of the root's parent."""
        return (child is root or id(child) in score and score[id(child)] >= bar
                or child.tag in BESIDE and child.linked < FEW_LINKS * child.chars)

    # Children of each element that have text, and the text that stands bare in it.
    children: dict[int, dict[int, Node]] = {}
    for _, _, owner in page.blocks:
        node = owner
        while node.parent is not None and id(node) not in children.setdefault(id(node.parent), {}):
            children[id(node.parent)][id(node)] = node
            node = node.parent
    widened = set()
    while root.parent is not None and root.parent.tag not in ("html", "body"):
        kept = sum(c.chars - c.linked for c in children[id(root.parent)].values() if is_kept(c))
        if kept < KEPT_SHARE * (root.parent.chars - root.parent.linked):
            break
        for child in children[id(root.parent)].values():
            child.drop = child is not root and 2 * child.linked > child.chars
        root = root.parent
        widened.add(id(root))
    root.kept = True
    if root.parent is not None:
        for child in children[id(root.parent)].values():
            child.kept = is_kept(child)
    for n in page.nodes:
        n.kept = not n.drop and (n.kept or n.parent.kept)
    return [text for text, linked, owner in page.blocks if owner.kept and not (id(owner) in widened and 2 * linked > len(text))]


def _fallback(page: _Page) -> list[str]:
    """Pages of short blocks: those in an article or main element, else all with few links."""
    inside = [t for t, _, owner in page.blocks if owner.inside]
    return inside or [t for t, linked, _ in page.blocks if linked < 0.5 * len(t)]


def main_text(html: str | None) -> str:
    return "\n\n".join(main_blocks(html))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id as long) page_id", "url", "html").mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
