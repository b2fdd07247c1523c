"""Main text of web pages by tag-path ratios.

A page is read as a list of text blocks, each under a path of tags from the root; containers carry their first class in the path,
inline tags and tag pairs that close implicitly are seen through. What the page itself marks as no article - navigation, footers,
asides, forms, what isn't shown, and parts whose whole name says advert, notice, menu, sidebar, sharing or comments - is left
out, unless that part holds all blocks of the page. Of the rest, text length outside links and punctuation are summed by path,
each per block; their fusion is the ratio of the path. Ratios are smoothed over the blocks in page order, so that what stands
between paragraphs gains and what stands among menus loses; a path's score is the mean over its blocks, doubled inside
``article`` and ``main`` (and 25 more, which counts among tiny texts only). Paths whose score reaches a share of the page's level pass; the level is that score at which half of the
text lies in blocks of a higher one. The containers of the blocks on passing paths are the content nodes; those before the
first and after the last that reach the threshold on their own are dropped. Result: the blocks on passing paths inside these
nodes, and what else stands in them (headings, notes, cells), except runs of three blocks or more that are nothing but links.

Null and empty pages, and pages without text, give an empty text; an empty table gives an empty result. Repeated rows get equal
texts. Broken tags at the end of a cut-off page are dropped. Nothing is cut off: time and memory grow with the length of a
page, whatever its depth, and one page is held in memory with its blocks (some three times its size).
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A comment, a declaration, or a tag; quotes count only behind an equals sign.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>])*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[^\W\d_]")
PUNCTUATION = re.compile(r"[.,;:!?…。、，！？；：،؟؛۔।॥]")
#: What stands between the parts of a page's title.
TITLE_PARTS = re.compile(r"\s+[-–—|·»:]+\s+")
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track".split())
#: Elements whose content is no markup.
RAW = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in "script style textarea title xmp iframe noembed noframes".split()}
#: Elements that don't break a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that are never shown as text of an article.
UNSEEN = frozenset("head script style template noscript svg math canvas object audio video map select button textarea iframe dialog applet noembed noframes".split())
#: Elements, and roles, that say that they are no part of it.
APART = frozenset("nav footer aside menu form".split())
APART_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words that name such parts, and words that may stand beside them in a name.
PARTS = frozenset(
    "ad ads adsbygoogle advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "sidebar aside nav navbar navigation menu breadcrumb breadcrumbs footer masthead header comment comments disqus respond reply replies share sharing social related "
    "recommended newsletter subscribe subscription signup login widget widgets toolbar pagination pager skip hidden".split()
)
BESIDE = frozenset(
    "area articles bar block bottom box button buttons col column container content fb form global group heading holder icon icons info inner is item items js law left link links list main media "
    "message messages more outer page panel posts primary reader region right row secondary section site slot small stories thread title top unit user wp wrap wrapper".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose first class tells paths apart.
CONTAINERS = frozenset("div section table tbody tr td ul ol dl main article center fieldset".split())
#: Elements that say they are the content, and what that does to the scores of paths through them.
NAMED = frozenset(["article", "main"])
NAMED_FACTOR, NAMED_SCORE = 2.0, 25.0
#: What an opening tag closes, up to the given containers.
CLOSES = {
    **dict.fromkeys(
        "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split(),
        (("p",), tuple("article aside blockquote body button div fieldset figure footer form header li main nav section table td th".split())),
    ),
    "li": (("li", "p"), tuple("ul ol menu dir".split())),
    "dt": (("dt", "dd", "p"), ("dl",)),
    "dd": (("dt", "dd", "p"), ("dl",)),
    "option": (("option",), ("select", "datalist")),
    "tr": (("tr", "td", "th", "p"), ("table",)),
    "td": (("td", "th", "p"), ("tr", "table")),
    "th": (("td", "th", "p"), ("tr", "table")),
    "body": (("head",), ()),
}
#: Weights of a block and of its neighbours, in page order, and the share of the level that passing paths reach.
KERNEL = (0.5, 0.22, 0.03)
THRESHOLD = 0.35
#: Blocks in a row that are nothing but links, from which on they are a menu.
MENU = 3


@lru_cache(maxsize=1 << 16)
def named_part(name: str) -> str | None:
    """The word for what a class or id names, if all of its words name parts apart or stand beside such; else None."""
    found = None
    for word in WORD.findall(name):
        word = word.lower()
        if word not in PARTS and word not in BESIDE and len(word) > 1:
            head = next((p for p in sorted(PARTS, key=len, reverse=True) if len(p) > 3 and word.startswith(p) and word[len(p) :] in BESIDE), None)
            if head is None:
                return None
            word = head
        if word in PARTS and found in (None, "header"):
            found = word
    return found


class Page:
    """The blocks of a page. An element is known by its number; parents come before their children.

    Per element: tag, parent, path (a number for the path of labels), apart (left out, unless it holds everything), unseen,
    header (of the page). Per block: its element, text, and the share of it that is linked.
    """

    def __init__(self, source: str):
        self.tag, self.parent, self.path, self.apart, self.unseen, self.header, self.named = [""], [-1], [0], [False], [False], [False], [False]
        self.element: list[int] = []
        self.text: list[str] = []
        self.linked: list[float] = []
        self.title = ""
        self.n_paths = 1
        self._read(source)

    def _read(self, source: str) -> None:
        paths: dict[tuple[int, str], int] = {}
        stack = [0]
        places: dict[str, list[int]] = defaultdict(list)  # where in the stack each tag is open
        parts: list[str] = []
        shown = linked = at = 0
        link = 0  # depth of the stack at which a link is open

        def flush() -> None:
            nonlocal shown, linked
            if parts:
                text = " ".join("".join(parts).split())
                if text:
                    self.element.append(stack[-1])
                    self.text.append(text)
                    self.linked.append(linked / shown)
                parts.clear()
            shown = linked = 0

        def close(depth: int) -> None:
            nonlocal link
            flush()
            while len(stack) > depth:
                places[self.tag[stack.pop()]].pop()
            if link > depth:
                link = 0

        while at < len(source):
            m = TOKEN.search(source, at)
            stop = m.start() if m else len(source)
            if stop > at:
                piece = source[at:stop]
                parts.append(html.unescape(piece) if "&" in piece else piece)
                shown += stop - at
                if link:
                    linked += stop - at
            if not m:
                break
            at = m.end()
            if m[2] is None:
                continue
            tag, given = m[2].lower(), m[3]
            if m[1]:  # an end tag
                if tag == "a":
                    link = 0
                if places[tag]:
                    close(places[tag][-1])
                elif tag == "p":
                    flush()
                continue
            if at >= len(source) and not m[0].endswith(">"):
                break  # a broken tag at the end
            attributes = {}
            if given and not given.isspace():
                attributes = {a[1].lower(): a[2] or a[3] or a[4] or "" for a in ATTRIBUTE.finditer(given)}
            names = [html.unescape(n) for k in ("class", "id") for n in attributes.get(k, "").split()]
            kinds = set(filter(None, map(named_part, names))) if tag not in HEADINGS and tag not in ("html", "body", "article", "main") else set()
            unseen = tag in UNSEEN or "hidden" in attributes or "display:none" in attributes.get("style", "").replace(" ", "").lower()
            if tag in INLINE and not kinds and not unseen and not places[tag]:
                if tag == "a" and "href" in attributes:
                    link = len(stack)
                continue
            if tag in VOID:
                flush()
                continue
            flush()
            if tag in CLOSES:
                closed, containers = CLOSES[tag]
                floor = max((places[c][-1] for c in containers if places[c]), default=0)
                depth = min((p[k] for c in closed if (p := places[c]) and (k := bisect_right(p, floor)) < len(p)), default=len(stack))
                if depth < len(stack):
                    close(depth)
            around = stack[-1]
            label = tag
            if tag in CONTAINERS and attributes.get("class"):
                label += "." + attributes["class"].split(None, 1)[0] if attributes["class"].strip() else ""
            step = (self.path[around], label)
            if step not in paths:
                paths[step] = self.n_paths
                self.n_paths += 1
            header = (tag == "header" or bool(kinds & {"header", "masthead"}) or attributes.get("role") == "banner") and not self.named[around]
            apart = tag in APART or attributes.get("role", "").lower() in APART_ROLES - {"banner"} or bool(kinds - {"header", "masthead"})
            self.tag.append(tag)
            self.parent.append(around)
            self.path.append(self.path[around] if tag in INLINE else paths[step])
            self.apart.append(apart)
            self.unseen.append(self.unseen[around] or unseen)
            self.header.append(self.header[around] or header)
            self.named.append(self.named[around] or tag in NAMED)
            number = len(self.tag) - 1
            if tag in RAW:
                end = RAW[tag].search(source, at)
                stop = end.start() if end else len(source)
                if tag == "title" and not self.title:
                    self.title = " ".join(html.unescape(source[at:stop]).split())
                self.unseen[number] = True
                at = stop
            if given.endswith("/") and self.unseen[around]:
                continue  # closed at once, as parts of drawings are
            places[tag].append(len(stack))
            stack.append(number)
        flush()

    def outside(self) -> list[bool]:
        """Per element, whether it is left out: unseen, or inside a part apart that doesn't hold all blocks of three or more."""
        seen = [e for e in self.element if not self.unseen[e]]
        held = [0] * len(self.tag)
        for e in seen:
            held[e] += 1
        for e in range(len(self.tag) - 1, 0, -1):
            held[self.parent[e]] += held[e]
        all_of_them = max(3, len(seen))
        out = [False] * len(self.tag)
        for e in range(1, len(self.tag)):
            out[e] = out[self.parent[e]] or self.unseen[e] or (self.apart[e] and held[e] < all_of_them)
        return out


def path_scores(page: Page, blocks: list[int]) -> dict[int, float]:
    """The score of each path: the smoothed ratio, text length outside links per block times (1 + punctuation per block)."""
    length: dict[int, float] = defaultdict(float)
    marks: dict[int, float] = defaultdict(float)
    count: dict[int, int] = defaultdict(int)
    of = [page.path[page.element[b]] for b in blocks]
    for b, p in zip(blocks, of, strict=True):
        own = 1 - page.linked[b]
        length[p] += len(page.text[b]) * own
        marks[p] += len(PUNCTUATION.findall(page.text[b])) * own
        count[p] += 1
    ratio = {p: length[p] / n * (1 + marks[p] / n) for p, n in count.items()}
    line = [ratio[p] for p in of]
    total: dict[int, float] = defaultdict(float)
    n = len(line)
    for i, (b, p) in enumerate(zip(blocks, of, strict=True)):
        smooth = weight = 0.0
        for j in range(max(0, i - 2), min(n, i + 3)):
            w = KERNEL[abs(i - j)]
            smooth += w * line[j]
            weight += w
        total[p] += _credited(page, b, smooth / weight)
    return {p: total[p] / k for p, k in count.items()}


def _credited(page: Page, block: int, score: float) -> float:
    return score * NAMED_FACTOR + NAMED_SCORE if page.named[page.element[block]] else score


def level(page: Page, blocks: list[int], scores: dict[int, float]) -> float:
    """The score at which half of the text (credited as scores are) lies in blocks of a score as high."""
    order = sorted(((scores[page.path[page.element[b]]], _credited(page, b, len(page.text[b]) * (1 - page.linked[b]))) for b in blocks), reverse=True)
    left = sum(n for _, n in order) / 2
    for score, n in order:
        left -= n
        if left <= 0:
            return score
    return 0.0


def main_text(source: str | None, threshold: float = THRESHOLD) -> str:
    page = Page(source or "")
    out = page.outside()
    blocks = [b for b, e in enumerate(page.element) if not out[e]]
    body = [b for b in blocks if not page.header[page.element[b]]] or blocks
    if not body:
        return ""
    scores = path_scores(page, body)
    bar = threshold * level(page, body, scores)
    passing = {p for p, s in scores.items() if s >= bar}
    chosen = [b for b in body if page.path[page.element[b]] in passing]
    nodes = _content_nodes(page, chosen, bar)
    inside = [False] * len(page.tag)
    for e in range(1, len(page.tag)):
        inside[e] = inside[page.parent[e]] or (e in nodes and page.tag[e] not in ("html", "body"))
    menus = _menus(page, body)
    kept = []
    for b in body:
        e = page.element[b]
        mine = page.path[e] in passing and _node(page, e) in nodes
        kept.append(mine or (inside[e] and b not in menus))
    # a heading in the open belongs to what follows it
    for i in range(len(body) - 2, -1, -1):
        if not kept[i] and kept[i + 1] and page.tag[page.element[body[i]]] in HEADINGS:
            kept[i] = True
    found = [b for b, k in zip(body, kept, strict=True) if k]
    if len(body) < len(blocks) and not any(page.tag[page.element[b]] == "h1" for b in found):
        found = sorted(found + _title(page, blocks))
    return " ".join(page.text[b] for b in found)


def _node(page: Page, element: int) -> int:
    """The content node of a block: the element around the one that holds it, or that one itself if it is a container."""
    return element if page.tag[element] in CONTAINERS - {"tr", "td", "tbody"} or element == 0 else page.parent[element]


def _content_nodes(page: Page, chosen: list[int], bar: float) -> set[int]:
    """The nodes of the chosen blocks, from the first to the last that reaches the bar by its own blocks."""
    own: dict[int, list[int]] = {}
    for b in chosen:
        own.setdefault(_node(page, page.element[b]), []).append(b)
    reach = []
    for node, blocks in own.items():
        n = len(blocks)
        size = sum(len(page.text[b]) * (1 - page.linked[b]) for b in blocks) / n
        marks = sum(len(PUNCTUATION.findall(page.text[b])) * (1 - page.linked[b]) for b in blocks) / n
        if _credited(page, blocks[0], size * (1 + marks)) >= bar:
            reach.append((blocks[0], blocks[-1]))
    if not reach:
        return set(own)
    first, last = min(a for a, _ in reach), max(b for _, b in reach)
    return {node for node, blocks in own.items() if blocks[-1] >= first and blocks[0] <= last}


def _menus(page: Page, blocks: list[int]) -> set[int]:
    """Blocks in runs of ``MENU`` or more that are nothing but links."""
    out: set[int] = set()
    run: list[int] = []
    for b in [*blocks, None]:
        if b is not None and page.linked[b] > 0.9:
            run.append(b)
            continue
        if len(run) >= MENU:
            out.update(run)
        run = []
    return out


def _title(page: Page, blocks: list[int]) -> list[int]:
    """The one first-level heading of the page's header, if it is the longest part of the page's title or that has none."""
    heads = [b for b in blocks if page.header[page.element[b]] and page.tag[page.element[b]] == "h1"]
    part = max(TITLE_PARTS.split(page.title), key=len)
    return heads if len(heads) == 1 and (part in page.text[heads[0]] or page.text[heads[0]] in part) else []


def extract(pages: DataFrame, source: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text of each page in ``out`` (an input column of that name is replaced)."""

    @F.pandas_udf("string")
    def texts(sources: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in sources:
            yield pd.Series([main_text(s) for s in series], dtype=object)

    return pages.withColumn(out, texts(F.col(source)))


def report(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text and n_chars (its code points)."""
    return extract(pages.select("page_id", "url", "html")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
