import pytest
from pyspark.sql import Row

from lodestone.operators.html import extract_pages, page_links

PAD = "p" * 5


def extract(spark, html, url="https://example.com/docs/page.html", **options):
    frame = spark.createDataFrame([(url, html)], "url string, html string")
    return extract_pages(frame, **options).first()


@pytest.mark.parametrize("html, content", [
    ("<html><body><p>one</p><p>two</p></body></html>", "onetwo"),
    ("<body>a<nav>menu</nav>b<header>h</header><footer>f</footer><script>s</script><style>t</style>c</body>", "abc"),
    ("<body>x<article>inner <b>text</b></article>y</body>", "inner text"),
    ("<body><article>second</article><main>first</main></body>", "first"),
    ("<body><article>one</article><article>two</article></body>", "one"),
    ('<body><div role="main">r</div><div class="content">c</div></body>', "r"),
    ('<body><div class="big content x">c</div><div id="content">i</div></body>', "c"),
    ('<body><div class="contents">no</div><div id="main-content">i</div></body>', "i"),
    ('<body><div class="post-content">p</div><div class="main-content">m</div></body>', "m"),
    ("<body>all<main></main></body>", "all"),
    ("<body>all<main> </main></body>", ""),
    ("<body>all<nav><main>menu</main></nav></body>", "all"),
    ("no body at all", "no body at all"),
    ("<body>a<!-- hidden -->b<!DOCTYPE x>c<?pi?>d</body>", "abcd"),
    ("<body>&lt;a&gt; &amp; &copy; &#65;&#x42; &nosuch; AT&T</body>", "<a> & © AB &nosuch AT&T"),
    ("<body><nav>open <p>never closed</body>", ""),
    ("<body><div><nav>menu</div>after</body>", "after"),
    ("<body><main>open <p>one <b>two</body>", "open one two"),
    ("<body>x</p></div>y<br>z<br/>w</body>", "xyzw"),
    ("<body><template>t</template><ruby>k<rt>r</rt></ruby></body>", "k"),
    ("<body>a  \n b</body>", "a b"),
    ("<body>Home  start</body>", "start"),
    ("<body><aside>side</aside><form>f</form><div class='ad'>ad</div></body>", "sidefad"),
    ("", ""),
    (None, ""),
])
def test_content(spark, html, content):
    assert extract(spark, html)["content"] == content


@pytest.mark.parametrize("html, title", [
    ("<title> A  b\n</title><body>x</body>", "A  b"),
    ("<head><title>first</title><title>second</title></head>", "first"),
    ("<header><title>in header</title></header><body>x</body>", "in header"),
    ("<body>none</body>", ""),
    ("<title>a &amp; b</title>", "a & b"),
])
def test_title(spark, html, title):
    assert extract(spark, html)["title"] == title


def test_bytes_with_bad_utf8(spark):
    frame = spark.createDataFrame([("u", bytearray(b"<body>a\xff\xc3\xa9b</body>"))], "url string, html binary")
    assert extract_pages(frame).first()["content"] == "aéb"


def test_links_in_order_without_menus(spark):
    html = """<body><nav><a href="/menu">m</a></nav><a href="b.html#x">b</a><a>no href</a><a href="/a?q=1">a</a>
    <a href="mailto:x@y.z">m</a><a href="file.PDF">f</a><a href="b.html">again</a><footer><a href="/foot">f</a></footer>
    <a href="">self</a><a href="//other.org/p">o</a></body>"""
    frame = spark.createDataFrame([("https://example.com/docs/page.html", html)], "url string, html string")
    links = page_links(extract_pages(frame)).orderBy("pos").collect()
    assert [r["dst_url"] for r in links] == [
        "https://example.com/docs/b.html", "https://example.com/a?q=1", "https://example.com/docs/b.html",
        "https://example.com/docs/page.html", "https://other.org/p"]
    assert {r["src_url"] for r in links} == {"https://example.com/docs/page.html"}


def test_menus_can_be_kept(spark):
    row = extract(spark, '<body><nav><a href="/m">menu</a></nav>x</body>', removed_tags=("script", "style"))
    assert row["content"] == "menux" and row["links"] == ["https://example.com/m"]


def test_bad_link_fails_the_page(spark):
    row = extract(spark, '<body>text<a href="http://[bad">x</a></body>')
    assert row["content"] is None and row["error"].startswith("Error fetching https://example.com")


def test_content_type(spark):
    frame = spark.createDataFrame([
        Row(url="a", html="<body>x</body>", content_type="Text/HTML; charset=utf-8"),
        Row(url="b", html="<body>y</body>", content_type="application/pdf"),
        Row(url="c", html="<body>z</body>", content_type=None)],
        "url string, html string, content_type string")
    rows = {r["url"]: r for r in extract_pages(frame).collect()}
    assert rows["a"]["content"] == "x" and rows["a"]["error"] is None
    assert rows["b"]["content"] is None and rows["b"]["error"] == "Non-HTML content: b"
    assert rows["c"]["error"] == "Non-HTML content: c"


def test_many_unclosed_tags_are_linear(spark):
    html = "<body>" + "<p><i>x</b>" * 50_000
    assert len(extract(spark, html)["content"]) == 50_000


def test_a_page_that_cannot_be_read_is_one_error_row(spark):
    rows = [("https://a.com/1", "<p>fine</p>"), ("https://a.com/2", "<p>x</p><![foo[bar]]>"), ("https://a.com/3", "<a href='http://[x'>y</a>")]
    got = {r["url"]: r for r in extract_pages(spark.createDataFrame(rows, "url string, html string")).collect()}
    assert [got[u]["error"] is None for u, _ in rows] == [True, False, False]
    assert got["https://a.com/1"]["content"] == "fine" and got["https://a.com/2"]["content"] is None
