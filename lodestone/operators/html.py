"""Page extraction: title, main text and links of raw HTML.

Nesting cannot be expressed with regular expressions, so one pass of the standard library's tolerant
tokenizer runs over Arrow batches. It keeps no tree: an element's text is the run of text pieces between
its start and its end, so one list of pieces and a stack of open elements are enough. Everything after
the tokenizer (cleaning, length checks, link filters) is done by Spark expressions.
"""

from __future__ import annotations

import html as html_std
from collections import Counter
from html.entities import html5 as ENTITIES
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from lodestone.functions.text import clean_text
from lodestone.functions.urls import is_crawlable, normalize_url
from lodestone.operators.arrow import slices
from lodestone.settings import REMOVED_TAGS

# --- fixed values -----------------------------------------------------------
# Where the main text is looked for, by priority: kind of test, value.
MAIN_SELECTORS = (
    ("tag", "main"),
    ("tag", "article"),
    ("role", "main"),
    ("class", "content"),
    ("class", "main-content"),
    ("class", "post-content"),
    ("id", "content"),
    ("id", "main-content"),
)
VOID_TAGS = frozenset(
    "area base basefont bgsound br col command embed frame hr image img input isindex keygen link "
    "menuitem meta nextid param source spacer track wbr".split())
# Elements whose text never counts as text of the elements around them.
SILENT_TAGS = frozenset(("rt", "rp", "template", "script", "style"))
# ----------------------------------------------------------------------------

_BODY = len(MAIN_SELECTORS)


class _PageScan(HTMLParser):
    """Collects the text pieces, the spans of candidate elements, the title and the hrefs of one page."""

    def __init__(self, removed):
        super().__init__(convert_charrefs=False)
        self.removed = removed
        self.pieces, self.spans, self.hrefs = [], {}, []
        self.title = None
        self._open = []          # (tag, candidate slots closed with it)
        self._names = Counter()  # how often each tag is open
        self._gone = 0           # open removed elements
        self._silent = 0
        self._title_depth = None

    def _slots(self, tag, attrs):
        for slot, (kind, value) in enumerate(MAIN_SELECTORS):
            if slot in self.spans:
                continue
            if kind == "tag":
                hit = tag == value
            elif kind == "class":
                hit = value in (attrs.get("class") or "").split()
            else:
                hit = attrs.get(kind) == value
            if hit:
                yield slot
        if tag == "body" and _BODY not in self.spans:
            yield _BODY

    def handle_starttag(self, tag, attrs):
        if tag == "title" and self.title is None:
            self.title, self._title_depth = [], len(self._open)
        if tag in self.removed:
            self._gone += 1
        slots = ()
        if not self._gone:
            attrs = dict(attrs)
            if tag == "a" and "href" in attrs:
                self.hrefs.append(attrs["href"] or "")
            slots = tuple(self._slots(tag, attrs))
            for slot in slots:
                self.spans[slot] = [len(self.pieces), None]
        if tag in SILENT_TAGS:
            self._silent += 1
        self._open.append((tag, slots))
        self._names[tag] += 1
        if tag in VOID_TAGS:
            self._pop()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self._pop()

    def handle_endtag(self, tag):
        if self._names[tag]:
            while self._pop() != tag:
                pass

    def _pop(self):
        tag, slots = self._open.pop()
        self._names[tag] -= 1
        if tag in self.removed:
            self._gone -= 1
        if tag in SILENT_TAGS:
            self._silent -= 1
        for slot in slots:
            self.spans[slot][1] = len(self.pieces)
        if self._title_depth is not None and len(self._open) <= self._title_depth:
            self._title_depth = None
        return tag

    def handle_data(self, data):
        if self._silent:
            return
        if self._title_depth is not None:
            self.title.append(data)
        if not self._gone:
            self.pieces.append(data)

    def handle_charref(self, name):
        self.handle_data(html_std.unescape(f"&#{name};"))

    def handle_entityref(self, name):
        self.handle_data(ENTITIES.get(name + ";", "&" + name))

    def unknown_decl(self, data):
        if data.upper().startswith("CDATA["):
            self.handle_data(data[6:])

    def _text(self, slot):
        start, end = self.spans[slot]
        return "".join(self.pieces[start:end])

    def result(self):
        self.close()
        title = "".join(self.title or ()).strip()
        text = ""
        first = min((s for s in self.spans if s != _BODY), default=None)
        if first is not None:
            text = self._text(first)
        if not text:
            text = self._text(_BODY) if _BODY in self.spans else "".join(self.pieces)
        return title, text, self.hrefs


def _scan(url, markup, removed):
    """``(title, text, absolute links, error)`` of one page; whatever cannot be read or resolved fails this page only."""
    if isinstance(markup, bytes):
        markup = markup.decode("utf-8", "ignore")
    page = _PageScan(removed)
    try:
        page.feed(markup or "")
        title, text, hrefs = page.result()
        return title, text, [urljoin(url, h) if url else h for h in hrefs], None
    except Exception as problem:  # the tokenizer has no narrower error for a malformed declaration
        return None, None, None, f"Error fetching {url}: {problem}"


def extract_pages(pages: DataFrame, removed_tags=REMOVED_TAGS) -> DataFrame:
    """``pages`` (url, html, other columns) -> url and the other columns, then title, content, links, error.

    ``html`` may be text or UTF-8 bytes (bad bytes are dropped). ``removed_tags`` name the subtrees that
    are deleted before text and links are read; the title is read before that. A ``content_type`` column,
    when there is one, marks the non-HTML rows as errors; they are not parsed.
    """
    removed = frozenset(removed_tags)
    typed = "content_type" in pages.columns
    kept = [c for c in pages.columns if c not in ("html", "content_type")]
    if typed:
        is_html = F.contains(F.lower("content_type"), F.lit("text/html"))
        pages = pages.withColumn("html", F.when(is_html, F.col("html"))).withColumn("_html", is_html)
        kept.append("_html")
    schema = pages.select(
        *kept, F.lit("").alias("title"), F.lit("").alias("raw_text"),
        F.array(F.lit("")).alias("links"), F.lit("").alias("error")).schema

    def scan(batches):
        for batch in slices(batches):
            pairs = zip(batch.column("url").to_pylist(), batch.column("html").to_pylist())
            rows = [_scan(url, markup, removed) for url, markup in pairs]
            titles, texts, links, errors = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept),
                 pa.array(titles, pa.string()), pa.array(texts, pa.string()),
                 pa.array(links, pa.list_(pa.string())), pa.array(errors, pa.string())],
                names=[*kept, "title", "raw_text", "links", "error"])

    out = pages.select(*kept, "html").mapInArrow(scan, _nullable(schema))
    error = F.col("error")
    if typed:
        error = F.when(~F.coalesce("_html", F.lit(False)),
                       F.concat(F.lit("Non-HTML content: "), F.col("url"))).otherwise(error)
    content = F.when(F.col("error").isNull(), clean_text(F.col("raw_text")))
    return (out.withColumn("error", error).withColumn("content", content)
            .select(*[c for c in kept if c != "_html"], "title", "content", "links", "error"))


def _nullable(schema):
    return T.StructType([T.StructField(f.name, T.ArrayType(T.StringType()) if f.name == "links" else f.dataType)
                         for f in schema])


def page_links(extracted: DataFrame) -> DataFrame:
    """Followable links, one row each: ``src_url, pos, dst_url``, in page order, duplicates kept."""
    good = extracted.where(F.col("error").isNull())
    links = good.select(F.col("url").alias("src_url"), F.posexplode("links").alias("pos", "href"))
    links = links.select("src_url", "pos", normalize_url(F.col("href")).alias("dst_url"))
    return links.where(is_crawlable(F.col("dst_url")))
