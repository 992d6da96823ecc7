"""The set-based walk against the definition of its order, one site at a time."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import walk
from lodestone.operators.robots import apply_rules, robots_filter
from lodestone.operators.numbering import number_within
from lodestone.operators.walk import crawl_stats, crawl_summary, error_rows, walk_links
from lodestone.plans.crawl import crawl
from lodestone.plans.index import error_digest
from lodestone.plans.scratch import Scratch


def host(url):
    name = url.split("/")[2]
    return name[4:] if name.startswith("www.") else name


def listed_walk(start, pages, links, blocked, max_pages, max_depth):
    """The walk from its definition: every chain of links through readable pages, shortest first and then by the places
    of its links; the first chain to a URL is its visit, and the visit of the last page of the budget ends the list."""
    def readable(url):
        return url not in blocked and pages.get(url, 0) >= 100

    chains = {0: [((), start)]}
    first = {start: ()}
    for depth in range(1, max_depth + 2):
        chains[depth] = []
        for place, url in chains[depth - 1]:
            if readable(url) and first[url] == place:
                chains[depth] += [(place + (i,), u) for i, u in enumerate(links.get(url, ())) if host(u) == host(start)]
        chains[depth].sort()
        for place, url in chains[depth]:
            if depth <= max_depth:
                first.setdefault(url, place)
    visits = sorted(((len(p), p, u) for u, p in first.items()))
    good = [i for i, (_, _, u) in enumerate(visits) if readable(u)]
    over = len(good) >= max_pages
    if over:
        visits = visits[:good[max_pages - 1] + 1]
    met = {u for _, _, u in visits}
    deep = [] if over else [(u, "too_deep") for _, u in chains[max_depth + 1] if u not in met]
    accepted = [(u, d) for d, _, u in visits if readable(u)]
    bad = [(u, "robots" if u in blocked else "missing") for _, _, u in visits if u in blocked or u not in pages]
    short = [(u, "short") for _, _, u in visits if u not in blocked and u in pages and pages[u] < 100]
    return accepted, short + deep, bad


def random_web(seed, n=60):
    rng = random.Random(seed)
    hosts = ["a.com", "www.a.com", "b.org"]
    urls = [f"https://{rng.choice(hosts)}/{'ok' if rng.random() < 0.8 else 'no'}/{i}" for i in range(n)]
    pages = {u: rng.choice([50, 99, 100, 500, 500, 500]) for u in urls if rng.random() < 0.9}
    links = {u: [rng.choice(urls) for _ in range(rng.randint(0, 6))] for u in pages}
    return urls, pages, links


def test_budgets_beyond_the_group_limit(spark):
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "2")
    try:
        test_equals_a_queue(spark, 2, 5, 3)
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")


def test_number_within_a_hot_key(spark):
    rows = [("hot", i * 7 % 4001) for i in range(4001)] + [("cold", 5), ("cold", 2)]
    frame = spark.createDataFrame(rows, "k string, o int").repartition(5)
    got = number_within(frame, "k", "o", Scratch(spark, "n"), "rows", "n").collect()
    assert sorted((r["o"], r["n"]) for r in got if r["k"] == "hot") == [(i, i + 1) for i in range(4001)]
    assert sorted((r["o"], r["n"]) for r in got if r["k"] == "cold") == [(2, 1), (5, 2)]


@pytest.mark.parametrize("seed, max_pages, max_depth", [
    (1, 50, 3), (2, 5, 3), (3, 1, 2), (5, 50, 0), (6, 12, 4)])
def test_equals_a_queue(spark, seed, max_pages, max_depth):
    urls, pages, links = random_web(seed)
    starts = [(f"s{i}", u) for i, u in enumerate(urls[:12])]
    rules = [("a.com", 0, "/no/1", True), ("a.com", 1, "/no/", False)]
    blocked = {u for u in urls if host(u) == "a.com" and "/no/" in u and not u.split("/no/")[1].startswith("1")}
    page_table = spark.createDataFrame(list(pages.items()), "url string, content_length int")
    link_table = spark.createDataFrame(
        [(u, i, v) for u, out in links.items() for i, v in enumerate(out)], "src_url string, pos int, dst_url string")
    result = walk_links(
        spark.createDataFrame(starts, "site string, start_url string"), page_table, link_table,
        spark.createDataFrame(rules, "domain string, seq int, path_prefix string, allow boolean"),
        max_pages, max_depth)
    visited, skipped, errors = [
        sorted(frame.collect(), key=lambda r: (r["depth"], r["ord"])) for frame in result]
    stats = {r["site"]: r for r in crawl_stats(*result).collect()}
    summary = {r["site"]: r for r in crawl_summary(*result).collect()}
    for site, start in starts:
        want = listed_walk(start, pages, links, blocked, max_pages, max_depth)
        assert [(r["url"], r["depth"]) for r in visited if r["site"] == site] == want[0]
        assert sorted((r["url"], r["reason"]) for r in skipped if r["site"] == site) == sorted(want[1])
        assert sorted((r["url"], r["reason"]) for r in errors if r["site"] == site) == sorted(want[2])
        counts = (len(want[0]), len(want[1]), len(want[2]))
        if any(counts):
            row = stats[site]
            assert (row["page_count"], row["skipped_count"], row["error_count"]) == counts
            assert summary[site]["urls"] == [u for u, _ in want[0]]


def test_no_starts(spark):
    none = spark.createDataFrame([], "site string, start_url string")
    pages = spark.createDataFrame([("u", 500)], "url string, content_length int")
    links = spark.createDataFrame([], "src_url string, pos int, dst_url string")
    assert [frame.count() for frame in walk_links(none, pages, links)] == [0, 0, 0]


def test_start_missing(spark):
    starts = spark.createDataFrame([("s", "https://a.com/x")], "site string, start_url string")
    pages = spark.createDataFrame([("u", 500)], "url string, content_length int")
    links = spark.createDataFrame([], "src_url string, pos int, dst_url string")
    visited, skipped, errors = walk_links(starts, pages, links)
    assert (visited.count(), skipped.count()) == (0, 0)
    assert [(r["url"], r["reason"]) for r in errors.collect()] == [("https://a.com/x", "missing")]


@pytest.mark.parametrize("url, allowed", [
    ("https://a.com/private/x", False), ("https://www.a.com/private/open/x", True), ("https://a.com/", True),
    ("https://b.com/private/x", True), ("https://a.com/q?x=1", False), ("https://a.com", True), ("https://c.com", False)])
def test_robots(spark, url, allowed):
    rules = spark.createDataFrame([
        ("a.com", 5, "/private/", False), ("a.com", 1, "/private/open", True), ("a.com", 2, "/q?", False),
        ("c.com", 1, "/", False), ("a.com", 9, "/private/", True)],
        "domain string, seq int, path_prefix string, allow boolean")
    row = robots_filter(spark.createDataFrame([(url,)], "url string"), rules).first()
    assert row["allowed"] is allowed


def test_crawl_from_html(spark):
    body = "word " * 30

    def page(*hrefs):
        return f"<title>T</title><body><main>{body}" + "".join(f'<a href="{h}">.</a>' for h in hrefs) + "</main></body>"

    rows = [("https://a.com/", page("/b", "c#x", "https://z.org/", "/short", "/gone", "/b")),
            ("https://a.com/b", page("/d")), ("https://a.com/c", page("/")), ("https://a.com/d", page()),
            ("https://a.com/short", "<body>tiny</body>"), ("https://z.org/", page())]
    pages = spark.createDataFrame(rows, "url string, html string")
    starts = spark.createDataFrame([("a", "https://a.com/")], "site string, start_url string")
    docs, visited, skipped, errors = crawl(starts, pages, max_depth=1)
    assert [r["url"] for r in visited.orderBy("depth", "ord").collect()] == [
        "https://a.com/", "https://a.com/b", "https://a.com/c"]
    assert {(r["url"], r["reason"]) for r in skipped.collect()} == {
        ("https://a.com/short", "short"), ("https://a.com/d", "too_deep")}
    assert [(r["url"], r["reason"]) for r in errors.collect()] == [("https://a.com/gone", "missing")]
    digest = error_digest(error_rows(errors)).collect()
    assert [(r["message"], r["more"]) for r in digest] == [("Error fetching https://a.com/gone: page missing", 0)]
    stored = {r["url"]: r for r in docs.collect()}
    assert set(stored) == {"https://a.com/", "https://a.com/b", "https://a.com/c"}
    assert stored["https://a.com/b"]["content_length"] == len(stored["https://a.com/b"]["content"])
    assert stored["https://a.com/b"]["doc_key"].startswith("b_")


def test_bad_limits(spark):
    frame = spark.createDataFrame([("s", "u")], "site string, start_url string")
    with pytest.raises(ValueError):
        walk_links(frame, frame, frame, max_pages=0)


def test_no_collect_in_plan(spark):
    """Frontiers stay tables: the walk's results read written files."""
    starts = spark.createDataFrame([("s", "https://a.com/x")], "site string, start_url string")
    pages = spark.createDataFrame([("https://a.com/x", 500)], "url string, content_length int")
    links = spark.createDataFrame([], "src_url string, pos int, dst_url string")
    visited, _, _ = walk_links(starts, pages, links)
    assert visited.inputFiles() and visited.select(F.count("*")).first()[0] == 1


def test_repeated_urls_and_starts(spark):
    pages = spark.createDataFrame(
        [("https://a.com/1", "<p>" + "old words here " * 9, 1), ("https://a.com/1", "<p>" + "new words here " * 9 + "<a href='/2'>x</a>", 2),
         ("https://a.com/2", "<p>" + "other words " * 12, 1), ("https://a.com/2", "<p>" + "other words " * 12, 1)],
        "url string, html string, ts int")
    starts = spark.createDataFrame([("s", "https://a.com/1")] * 2, "site string, start_url string")
    docs, visited, _, errors = crawl(starts, pages, max_pages=3)
    assert sorted(r["url"] for r in visited.collect()) == ["https://a.com/1", "https://a.com/2"] and errors.count() == 0
    rows = docs.collect()
    assert len(rows) == 2 and not any("old" in r["content"] for r in rows)
    with pytest.raises(ValueError):
        crawl(starts.unionByName(spark.createDataFrame([("s", "https://a.com/2")], starts.schema)), pages)


def test_rules_are_asked_once_for_all_levels(spark, monkeypatch):
    """Per level they made the whole queue of the level be computed twice."""
    asked = []
    monkeypatch.setattr(walk, "apply_rules", lambda urls, *rules: asked.append(1) or apply_rules(urls, *rules))
    starts = spark.createDataFrame([("s", "https://a.com/0")], "site string, start_url string")
    pages = spark.createDataFrame([(f"https://a.com/{i}", 500) for i in range(3)], "url string, content_length int")
    links = spark.createDataFrame([("https://a.com/0", 0, "https://a.com/1"), ("https://a.com/1", 0, "https://a.com/2"),
                                   ("https://a.com/1", 1, "https://a.com/gone"), ("https://a.com/1", 2, "https://a.com/gone/too")],
                                  "src_url string, pos int, dst_url string")
    rules = spark.createDataFrame([("a.com", 0, "/2", False), ("a.com", 1, "/gone/", False)], "domain string, seq int, path_prefix string, allow boolean")
    visited, skipped, errors = walk_links(starts, pages, links, rules)
    assert len(asked) == 1 and skipped.isEmpty() and visited.count() == 2
    assert {(r["url"][14:], r["reason"]) for r in errors.collect()} == {("2", "robots"), ("gone", "missing"), ("gone/too", "robots")}
