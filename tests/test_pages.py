"""Pages and citations on literal inputs."""

import pytest
from pyspark.sql import functions as F

from quarryline.functions import pages, text


@pytest.mark.parametrize("html, expected", [
    ("<head><title>t</title></head><p>One</p><p>Two<br>three</p>", "One\nTwo\nthree"),
    ("<!-- <main>no</main> --><p>a &amp;lt; b &#65;&#x42; &nope; &nbsp;c</p>", "a &lt; b AB &nope; c"),
    ("<nav>menu</nav><main> </main><article>short</article><article>the longer one</article>", "the longer one"),
    ("<main>the main</main><article>much longer than the main</article>", "the main"),
    ("<article>first</article><article>other</article>", "first"),
    ("<header>h</header><p>text</p><aside>s</aside><footer>f</footer>", "text"),
    ("<script>if (a < b) { '<p>no</p>' }</script>kept<style>p{}</style>", "kept"),
    ("<script>never closed <b>x</b>", "never closed x"),
    ("<p>a</p>\n\n\n\n<p>b</p>", "a\n\nb"),
    ("a < b", "a < b"), ("", ""), ("<nav>only</nav>", ""), ("<ARTICLE CLASS=x>Big</ARTICLE>", "Big"), ("<b>x</b>y", "x y"), ("&#xD800;&#x110000;z", "�z"),
])
def test_page_text(html, expected):
    assert pages.page_text(html) == expected


def test_page_text_column(spark):
    rows = spark.createDataFrame([(1, "<p>x</p>"), (2, None)], "id int, html string")
    assert {r.id: r.t for r in rows.select("id", pages.html_text("html").alias("t")).collect()} == {1: "x", 2: None}
    assert pages.page_text("<p>y</p>" * 50_000).count("y") == 50_000


@pytest.mark.parametrize("markdown, expected", [
    ("see [a.c:1-2] and [b.c:3], again [a.c:1-2]", [("a.c:1-2", 1), ("b.c:3", 2)]),
    ("```\n[a.c:1]\n```\n[b.c:2]", [("b.c:2", 1)]), ("~~~ x\n[a.c:1]\n[c.c:9]", []), ("`[a.c:1]` [b.c:2] ` [c.c:3]", [("b.c:2", 1), ("c.c:3", 2)]),
    ("[a.c:1](http://x) [b c:1] [d:x]", []), ("text ```[a.c:1]``` end", []), ("", []), (None, []), ("[a:b.c:7]", [("a:b.c:7", 1)]),
])
def test_citations(spark, markdown, expected):
    found = text.citations(spark.createDataFrame([(1, markdown)], "id int, text string")).orderBy("ordinal").collect()
    assert [(r.source, r.ordinal) for r in found] == expected
    assert all(f"{r.path}:{r.lines}" == r.source for r in found)


def test_a_batch_becomes_strings_page_by_page():
    """The batch stays an Arrow array; it was a series of all pages' strings."""
    import pyarrow as pa

    assert pages._page_texts.func(pa.array(["<p>a</p>", None, ""])).to_pylist() == ["a", None, ""]
