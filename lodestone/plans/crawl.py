"""Page table -> walked documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lodestone import settings
from lodestone.operators.html import extract_pages, page_links
from lodestone.operators.latest import latest_by_key
from lodestone.operators.walk import walk_links
from lodestone.plans.scratch import Scratch
from lodestone.sources.docs import page_docs


def crawl(starts: DataFrame, pages: DataFrame, rules: DataFrame | None = None,
          max_pages: int = settings.MAX_PAGES, max_depth: int = settings.MAX_DEPTH):
    """Walk ``pages`` (url, html, optionally ts) from ``starts`` -> ``(docs, visited, skipped, errors)``.

    Of a URL given more than once the newest row is parsed; without ``ts``, and between equal ones, a hash decides.
    Pages are parsed once, into a written table; the walk itself reads only lengths and links.
    """
    scratch = Scratch(pages.sparkSession, "crawl")
    dated = pages if "ts" in pages.columns else pages.withColumn("ts", F.lit(0))
    newest = latest_by_key(dated.withColumn("_tie", F.xxhash64("html")), "url", "ts", ("_tie",)).drop("_tie")
    pages = newest if "ts" in pages.columns else newest.drop("ts")
    extracted = scratch.write(extract_pages(pages), "pages")
    links = scratch.write(page_links(extracted), "links")
    sizes = extracted.select("url", F.length("content").alias("content_length"), "error")
    visited, skipped, errors = walk_links(starts, sizes, links, rules, max_pages, max_depth)
    docs = page_docs(extracted.join(visited.select("url").distinct(), "url", "left_semi"))
    return docs, visited, skipped, errors
