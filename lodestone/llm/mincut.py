"""Main text of pages by minimum-cut labelling.

A page is read into blocks of text. A classifier's evidence for and against each block becomes the capacity of its arcs
to the two terminals; blocks that follow each other, and blocks next to each other in one parent, are tied by smoothness
edges. The minimum cut labels all blocks at once. Blocks whose own evidence outweighs all their ties are settled first,
which changes no minimum cut and leaves little or nothing for the max-flow.

Pages are independent: one pass, no shuffle, memory in proportion to the largest page.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque

import pandas as pd
from pyspark.sql import Column, functions as F

# Element names by role.
RAW = "script style noscript template svg iframe object title math textarea select".split()
VOID = frozenset("area base br col embed head hr img input link meta param source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body button center dd details dialog div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 header hr html label legend li main menu nav ol option p pre section summary table tbody td tfoot
    th thead tr ul""".split())
CHROME = frozenset("nav footer aside form menu button label option dialog fieldset legend".split())
WRAPPERS = frozenset("body html".split())  # never chrome, whatever their classes
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
             "option": {"option"}}
# Words in classes, ids and roles.
CHROME_WORDS = frozenset("""ad ads advert advertisement adverts alert banner breadcrumb breadcrumbs byline comment comments consent
    cookie cookies disclaimer disqus footer header login masthead menu modal nav navbar navigation newsletter notice notices pager
    pagination popup promo promotion recommended related reply replies respond search share sharing sidebar signup social sponsor
    sponsored subscribe toolbar widget""".split())
AMBIGUOUS_WORDS = frozenset("""alert banner disclaimer footer header login menu modal navigation notice notices promotion recommended
    related search share sharing social toolbar widget""".split())  # beside another word they may be part of a subject
CONTENT_WORDS = frozenset("article content entry main post story".split())
NEVER_WRAPPERS = frozenset("comment comments disqus replies reply respond".split())

# Evidence in tenths; positive speaks for content.
IN_ARTICLE, OUTSIDE, IN_CHROME, LINKS = 60, -120, -400, -120
IN_ARTICLE_LINKS = -50   # in an article, in place of LINKS: its lists of links are content
IN_ARTICLE_CLASS = -130  # in an article, in place of IN_CHROME, for a compound like "social-history"; paragraphs outvote it
CHROME_CLASS = -70  # in place of IN_CHROME on pages without an article, for class, id or role; long paragraphs outvote it
PARAGRAPH, HEADING, NEUTRAL, PER_WORD, MOST_WORDS = 20, 10, -30, 2, 40
FOLLOWING, SIBLING = 10, 20

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])[^>]*+>"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+)>"
    r"|<[!?/][^>]*+>", re.S | re.I)
_ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
_AGAIN = {name: re.compile(rf"<{name}(?=[\s/>])", re.I) for name in RAW if name not in ("script", "style")}  # code may quote tags
_STOP = re.compile(r"</?(?:" + "|".join(sorted(BLOCK - {"option"})) + r")(?=[\s/>])", re.I)
_MARKS = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class _Element:
    __slots__ = ("name", "parent", "words", "chrome", "classed", "compound", "wraps", "article")

    def __init__(self, name, parent, attrs):
        self.name, self.parent, self.wraps = name, parent, False
        marks = [a or b or c for a, b, c in _MARKS.findall(attrs)] if attrs else []
        named = [{w.lower() for w in _WORD.findall(token)} for mark in marks for token in mark.split()]
        self.words = set().union(*named)
        self.chrome = name in CHROME or (name not in WRAPPERS and not CHROME_WORDS.isdisjoint(self.words))
        # chrome by its marks alone, or a form around other things; what readers say about a page stays chrome
        self.classed = self.chrome and (name not in CHROME or name == "form") and NEVER_WRAPPERS.isdisjoint(self.words)
        telling = [words for words in named if not CHROME_WORDS.isdisjoint(words)]
        self.compound = self.classed and name not in CHROME and all(
            words - CHROME_WORDS and words & CHROME_WORDS <= AMBIGUOUS_WORDS for words in telling)
        self.article = name in ("article", "main") or not CONTENT_WORDS.isdisjoint(self.words)
        if name == "header" and not any(e.article for e in _up(parent, None)):  # an article's own header has its title
            self.chrome, self.classed, self.compound = True, False, False
        if self.article and not self.chrome:
            while parent is not None and NEVER_WRAPPERS.isdisjoint(parent.words):
                parent.wraps, parent = True, parent.parent


class _Block:
    __slots__ = ("text", "parent", "linked")

    def __init__(self, text, parent, linked):
        self.text, self.parent, self.linked = text, parent, linked


def _raw_end(page: str, name: str, at: int, missing: set[str]) -> int:
    """Where the raw element that opened before ``at`` ends: at its end tag, or without one of its own at the next block."""
    end = None if name in missing else _ENDS[name].search(page, at)
    if end is None:
        missing.add(name)
    elif name not in _AGAIN or not _AGAIN[name].search(page, at, end.start()):
        return end.end()
    stop = _STOP.search(page, at, end.start() if end else len(page))
    return stop.start() if stop else end.end() if end else len(page)


def read_blocks(page: str) -> list[_Block]:
    """Blocks of text in page order: references decoded, white space runs made one space."""
    root = here = _Element("", None, "")
    blocks, parts, links, in_link = [], [], 0, 0

    def flush():
        nonlocal links
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            blocks.append(_Block(text, here, min(1.0, links / len(text))))
        parts.clear()
        links = 0

    def leave(names, stop=()):
        """Close the innermost open element of these names, and all inside it."""
        nonlocal here, in_link
        at = here
        while at is not root and at.name not in names:
            if at.name in stop:
                return
            at = at.parent
        if at is root:
            return
        in_link -= sum(1 for e in _up(here, at) if e.name == "a")
        here = at.parent

    at, missing = 0, set()
    while token := _TOKEN.search(page, at):
        if token.start() > at:
            parts.append(page[at:token.start()])
            if in_link:
                links += token.start() - at
        at = _raw_end(page, token["raw"].lower(), token.end(), missing) if token["raw"] else token.end()
        name = token["name"]
        if name is None:
            continue
        name = name.lower()
        if name in BLOCK:
            flush()
        elif name == "br":
            parts.append(" ")
        if token["end"]:
            leave((name,), ("table",) if name not in BLOCK else ())
        elif name not in VOID:
            if name in BLOCK:
                leave(("p",), BLOCK - {"p"})
            if name in CLOSED_BY:
                leave(CLOSED_BY[name], ("ul", "ol", "dl", "table", "select"))
            here = _Element(name, here, token["attrs"])
            in_link += name == "a"
    parts.append(page[at:])
    flush()
    return blocks


def _up(element, last):
    while element is not None:
        yield element
        if element is last:
            return
        element = element.parent


def evidence(blocks: list[_Block]) -> list[int]:
    """The classifier's evidence for each block."""
    paths = [list(_up(block.parent, None)) for block in blocks]
    # an element around all blocks that other chrome leaves says nothing about any of them
    hard = lambda path: any(e.chrome and not e.wraps and not e.classed for e in path)
    left = [path for path in paths if not hard(path)]
    around = {id(e) for e in left[0] if e.classed and all(e in path for path in left)} if left else set()
    placed = []
    for path in paths:
        marks = [e for e in path if e.chrome and not e.wraps and id(e) not in around]
        chrome = 0 if not marks else 1 if all(e.classed for e in marks) else 2
        placed.append((chrome, any(e.article for e in path), bool(marks) and all(e.compound for e in marks)))
    any_article = any(article and not chrome for chrome, article, _ in placed)
    out = []
    for block, (chrome, article, compound) in zip(blocks, placed, strict=True):
        links = IN_ARTICLE_LINKS if article and not chrome else LINKS
        score = PER_WORD * min(block.text.count(" ") + 1, MOST_WORDS) + int(links * block.linked)
        name = block.parent.name
        score += PARAGRAPH if name in ("p", "blockquote", "pre") else HEADING if name[:1] == "h" and name[1:].isdigit() else 0
        if not chrome:
            score += (IN_ARTICLE if article else OUTSIDE) if any_article else NEUTRAL
        elif article and compound:
            score += IN_ARTICLE + IN_ARTICLE_CLASS
        else:
            score += CHROME_CLASS if chrome == 1 and not any_article else IN_CHROME
        out.append(score)
    return out


def ties(blocks: list[_Block]) -> list[tuple[int, int, int]]:
    """Smoothness edges: blocks in succession, and neighbours within one parent's children."""
    edges = [(i, i + 1, FOLLOWING) for i in range(len(blocks) - 1)]
    last: dict[int, int] = {}
    for i, block in enumerate(blocks):
        parent = id(block.parent.parent if block.parent.parent is not None else block.parent)
        if parent in last:
            edges.append((last[parent], i, SIBLING))
        last[parent] = i
    return edges


def minimum_cut(scores: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """The labelling of least cost: a wrong label costs |score|, an edge between labels its weight. Ties go to False."""
    n = len(scores)
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for a, b, w in edges:
        if a != b:
            near[a][b] = near[a].get(b, 0) + w
            near[b][a] = near[b].get(a, 0) + w
    score, label = list(scores), [None] * n
    queue = deque(range(n))
    while queue:  # settle what outweighs its ties; its neighbours inherit the tie as evidence
        i = queue.popleft()
        if label[i] is None and (score[i] > (total := sum(near[i].values())) or -score[i] >= total):
            label[i] = score[i] > 0
            for j, w in near[i].items():
                del near[j][i]
                score[j] += w if label[i] else -w
                queue.append(j)
            near[i] = {}
    for i in range(n):
        if label[i] is None:
            group, todo = [], [i]
            while todo:
                at = todo.pop()
                if label[at] is None:
                    label[at] = False
                    group.append(at)
                    todo += near[at]
            for at in _content_side(group, score, near):
                label[at] = True
    return label


def _content_side(group: list[int], score: list[int], near: list[dict[int, int]]) -> list[int]:
    """Nodes on the source's side of the smallest source set of a minimum cut, by shortest augmenting paths."""
    source, sink = -1, -2
    room: dict[int, dict[int, int]] = {source: {}, sink: {}}
    for i in group:
        room[i] = dict(near[i])
        if score[i] > 0:
            room[source][i], room[i][source] = score[i], 0
        elif score[i] < 0:
            room[i][sink], room[sink][i] = -score[i], 0
    while True:
        came, queue = {source: source}, deque([source])
        while queue and sink not in came:
            a = queue.popleft()
            for b, left in room[a].items():
                if left > 0 and b not in came:
                    came[b] = a
                    queue.append(b)
        if sink not in came:
            return [i for i in group if i in came]
        path, at = [], sink
        while at != source:
            path.append((came[at], at))
            at = came[at]
        pushed = min(room[a][b] for a, b in path)
        for a, b in path:
            room[a][b] -= pushed
            room[b][a] += pushed


def main_text(page: str | None) -> str:
    """Content blocks, joined by newlines; empty if there are none."""
    blocks = read_blocks(page or "")
    return "\n".join(b.text for b, keep in zip(blocks, minimum_cut(evidence(blocks), ties(blocks)), strict=True) if keep)


def main_texts(page: Column) -> Column:
    """The main text of each page. A null or empty page has an empty text; broken markup is read as far as it makes sense, long
    pages whole; of equally good cuts the one with less text counts; repeated pages have the same text."""

    @F.pandas_udf("string")
    def of(pages: pd.Series) -> pd.Series:
        return pages.map(main_text, na_action=None)

    return of(page)
