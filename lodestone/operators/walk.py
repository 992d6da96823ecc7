"""Bounded breadth-first walk over a link table, for any number of sites at once."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestone import settings
from lodestone.functions.urls import domain
from lodestone.operators.numbering import number_within
from lodestone.operators.robots import apply_rules, rule_tables
from lodestone.plans.scratch import Scratch

# A queue entry: walk, its domain, pages accepted before this level, URL, path of link positions.
_QUEUE = ["site", "host", "done", "url", "ord"]
_LEVEL = "site string, host string, done bigint, url string, ord array<int>, depth int, status string"
_GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"
_ENDS = "site string, depth int, pages bigint, end_ord array<int>"


def walk_links(starts: DataFrame, pages: DataFrame, links: DataFrame, rules: DataFrame | None = None,
               max_pages: int = settings.MAX_PAGES, max_depth: int = settings.MAX_DEPTH,
               min_chars: int = settings.MIN_PAGE_CHARS):
    """``(visited, skipped, errors)`` of one walk per row of ``starts`` (site, start_url).

    ``pages``: ``url, content_length`` (and optionally ``error``); of a URL given more than once, the longest readable
    row counts. ``links``: ``src_url, pos, dst_url``. Repeated starts count once; one site with several is refused. A walk visits URLs of the start's domain first come, first served; a page that is missing,
    forbidden or not HTML is an error, a page shorter than ``min_chars`` is skipped and not followed; the walk
    ends with its ``max_pages``-th accepted page, and links deeper than ``max_depth`` are skipped.

    A first-in-first-out queue visits level by level, and within a level in the order of the path of link
    positions that leads to a page. That path is the sort key ``ord``, so a level is one set of joins without
    any global numbering. Each level's verdicts are one written table; the driver only sees whether it is empty.
    """
    if max_pages < 1 or max_depth < 0:
        raise ValueError("need max_pages >= 1 and max_depth >= 0")
    scratch = Scratch(starts.sparkSession, "walk")
    pages = pages.select("url", "content_length",
                         (F.col("error") if "error" in pages.columns else F.lit(None).cast("string")).alias("bad"))
    row = F.struct(F.col("bad").isNull().alias("good"), "content_length", "bad")
    pages = pages.groupBy("url").agg(F.max(row).alias("row")).select("url", "row.content_length", "row.bad")
    starts = starts.select("site", "start_url").distinct()
    if not starts.groupBy("site").count().where("count > 1").isEmpty():
        raise ValueError("a site has more than one start")
    facts = scratch.write(_facts(starts, pages, links, rules), "facts")
    frontier = starts.select(F.col("site").cast("string").alias("site"), domain(F.col("start_url")).alias("host"),
                             F.lit(0).cast("bigint").alias("done"), F.col("start_url").alias("url"),
                             F.array(F.lit(0)).alias("ord"))
    names = []
    for depth in range(max_depth + 1):
        level = _classify(frontier, facts, min_chars).withColumn("depth", F.lit(depth))
        level = scratch.write(level.select(*_QUEUE, "depth", "status"), f"level-{depth}")
        if level.isEmpty():
            break
        names.append(depth)
        ends = scratch.write(_ends(level, max_pages, scratch), f"ends-{depth}")
        visited = _within(scratch.read(_LEVEL, *[f"level-{d}" for d in names]),
                          scratch.read(_ENDS, *[f"ends-{d}" for d in names]))
        queued = _queue(_within(level, ends), ends, links, visited)
        frontier = queued.groupBy("site", "host", "done", "url").agg(F.min("ord").alias("ord"))
    else:
        depth = max_depth + 1
    if not names:
        visited = queued = scratch.read(_LEVEL, "level-0")
    too_deep = (queued.withColumn("depth", F.lit(max_depth + 1)).withColumn("status", F.lit("too_deep"))
                if depth > max_depth else visited.limit(0))
    entry = ["site", "url", "depth", "ord"]
    reason = F.col("status").alias("reason")
    skipped = visited.where("status = 'short'").unionByName(too_deep.select(*_QUEUE, "depth", "status"))
    errors = visited.where(~F.col("status").isin("accepted", "short"))
    return (visited.where("status = 'accepted'").select(*entry),
            skipped.select(*entry, reason), errors.select(*entry, reason))


def _facts(starts, pages, links, rules):
    """What a verdict needs to know of a URL. With rules that is asked once for every URL that a walk can get to, not for
    those of each level: the queue of a level is computed once, and many walks share its URLs."""
    if rules is None:
        return pages.withColumn("allowed", F.lit(True))
    urls = starts.select(F.col("start_url").alias("url")).unionByName(links.select(F.col("dst_url").alias("url"))).distinct()
    return apply_rules(urls, *rule_tables(rules)).join(pages, "url", "left").select("url", "content_length", "bad", "allowed")


def _classify(frontier, facts, min_chars):
    status = (F.when(~F.coalesce("allowed", F.lit(True)), F.lit("robots"))
              .when(F.col("content_length").isNull() & F.col("bad").isNull(), F.lit("missing"))
              .when(F.col("bad").isNotNull(), F.lit("unreadable"))
              .when(F.col("content_length") < min_chars, F.lit("short"))
              .otherwise(F.lit("accepted")))
    return frontier.join(facts, "url", "left").withColumn("status", status)


def _ends(level, max_pages, scratch):
    """Per walk with accepted pages on a level: pages accepted so far and, once that is ``max_pages``, the last one.

    Only the first ``max_pages`` accepted entries of a walk can matter. Up to Spark's group limit, every map task's
    share is cut to that many rows before the shuffle; beyond it entries are numbered without gathering a walk.
    """
    accepted = level.where("status = 'accepted'").select("site", "depth", "done", "ord")
    if max_pages <= int(level.sparkSession.conf.get(_GROUP_LIMIT)):
        queue = Window.partitionBy("site").orderBy("ord")
        accepted = accepted.withColumn("_n", F.row_number().over(queue)).where(F.col("_n") <= max_pages)
    else:
        accepted = number_within(accepted, "site", "ord", scratch, f"numbered-{uuid.uuid4().hex}", "_n")
    first = accepted.where(F.col("_n") + F.col("done") <= max_pages)
    ends = first.groupBy("site", "depth").agg(
        (F.max("done") + F.count("*")).alias("pages"), F.max_by("ord", "_n").alias("_last"))
    return ends.select("site", "depth", "pages", F.when(F.col("pages") >= max_pages, F.col("_last")).alias("end_ord"))


def _within(rows, ends):
    """Entries a walk got to before it ended."""
    cut = ends.where(F.col("end_ord").isNotNull()).select("site", "depth", "end_ord")
    reached = F.col("end_ord").isNull() | (F.col("ord") <= F.col("end_ord"))
    return rows.join(cut, ["site", "depth"], "left").where(reached).select(*_QUEUE, "depth", "status")


def _queue(level, ends, links, visited):
    """Entries the accepted pages of a level add to the queues of walks that go on, duplicates included.

    The site test compares with the domain carried by the entry, so it runs on the links found, not on the table.
    """
    going = ends.where(F.col("end_ord").isNull()).select("site", F.col("pages").alias("done"))
    parents = level.where("status = 'accepted'").drop("done").join(going, "site").select(
        "site", "host", "done", F.col("url").alias("src_url"), "ord")
    inner = (parents["src_url"] == links["src_url"]) & (domain(links["dst_url"]) == parents["host"])
    found = parents.join(links, inner).select(
        "site", "host", "done", F.col("dst_url").alias("url"),
        F.concat("ord", F.array(F.col("pos").cast("int"))).alias("ord"))
    return found.join(visited.select("site", "url"), ["site", "url"], "left_anti").select(*_QUEUE)


def error_rows(errors: DataFrame) -> DataFrame:
    """Walk errors in the shape of all other error tables: ``stage, key, message``."""
    return errors.select(F.lit("crawl").alias("stage"), F.col("url").alias("key"), _message().alias("message"))


def _message() -> Column:
    return F.when(F.col("reason") == "robots", F.concat(F.lit("Blocked by robots.txt: "), "url")).otherwise(
        F.concat(F.lit("Error fetching "), "url", F.lit(": page "), "reason"))


def crawl_summary(visited: DataFrame, skipped: DataFrame, errors: DataFrame) -> DataFrame:
    """One row per site: counts and the accepted URLs in visiting order (at most ``max_pages`` of them).

    Errors are counted here and stay a table of their own.
    """
    urls = F.array_sort(F.collect_list(F.struct("depth", "ord", "url")))
    pages = visited.groupBy("site").agg(
        F.count("*").alias("page_count"), F.transform(urls, lambda u: u["url"]).alias("urls"))
    return _with_counts(pages, skipped, errors).select(
        "site", F.coalesce("page_count", F.lit(0)).alias("page_count"), "skipped_count", "error_count",
        F.coalesce("urls", F.array().cast("array<string>")).alias("urls"))


def crawl_report(visited: DataFrame, errors: DataFrame, ts: Column | None = None) -> DataFrame:
    """The report of a crawl as rows, whatever a walk's size: ``site, crawl_timestamp, kind, place, entry``.

    Kind ``url`` has the accepted URLs, numbered in visiting order, kind ``error`` the messages of what could not be read,
    numbered in their own order. ``ts`` is the time of the crawl (now, if not given), the same in all rows.
    """
    now = F.unix_timestamp().cast("double") if ts is None else ts.cast("double")
    order = Window.partitionBy("site").orderBy("depth", "ord")
    urls = visited.select("site", F.lit("url").alias("kind"), F.row_number().over(order).alias("place"), F.col("url").alias("entry"))
    told = errors.select("site", _message().alias("entry"))
    told = told.select("site", F.lit("error").alias("kind"), F.row_number().over(
        Window.partitionBy("site").orderBy("entry")).alias("place"), "entry")
    return urls.unionByName(told).select("site", now.alias("crawl_timestamp"), "kind", "place", "entry")


def crawl_stats(visited: DataFrame, skipped: DataFrame, errors: DataFrame) -> DataFrame:
    """The counts of ``crawl_summary`` alone."""
    pages = visited.groupBy("site").agg(F.count("*").alias("page_count"))
    return _with_counts(pages, skipped, errors).select(
        "site", F.coalesce("page_count", F.lit(0)).alias("page_count"), "skipped_count", "error_count")


def _with_counts(pages, skipped, errors):
    kinds = (skipped.select("site", F.lit(1).alias("_s"), F.lit(0).alias("_e"))
             .unionByName(errors.select("site", F.lit(0).alias("_s"), F.lit(1).alias("_e"))))
    counts = kinds.groupBy("site").agg(F.sum("_s").alias("_s"), F.sum("_e").alias("_e"))
    return (pages.join(counts, "site", "full")
            .withColumn("skipped_count", F.coalesce("_s", F.lit(0)))
            .withColumn("error_count", F.coalesce("_e", F.lit(0))))
