import itertools
import random

import pytest

from quarryline.llm import extraction as x


def test_minimum_cut_against_all_labellings():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(1, 8)
        scores = [rng.uniform(-2, 2) for _ in range(n)]
        edges = [(i, j, rng.uniform(0, 1.5)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5]

        def cost(labels):
            own = sum(max(-s, 0) if content else max(s, 0) for s, content in zip(scores, labels))
            return own + sum(w for a, b, w in edges if labels[a] != labels[b])

        best = min(map(cost, itertools.product([False, True], repeat=n)))
        assert abs(cost(x.minimum_cut(scores, edges)) - best) < 1e-6


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href=/>Home</a></li></ul></nav><div id="cookie-notice">We use cookies, please accept them all now.</div>
<article><h1>A   title</h1><p>First &eacute; &#x41; &lt;b&gt;</p><p>Two<br>parts</p><div class="share-bar">Share this text with all your friends</div></article>
<aside><p>Other news that has a good many words in it today</p></aside><section class="comments"><p>Great article, I have read all of it twice</p></section>
<form><label>Your name</label></form><script>var a = "<p>no</p>";</script><footer>2020</footer></body></html>"""


def test_article_without_the_rest():
    assert x.main_text(PAGE) == "A title\nFirst é A <b>\nTwo parts"


def test_page_without_article_element():
    page = PAGE.replace("<article>", '<div class="content">').replace("</article>", "</div>")
    assert x.main_text(page) == "A title\nFirst é A <b>\nTwo parts"


BODY = "<h1>A title</h1><p>The first part has some words.</p><p>Another part follows it here.</p>"
TEXT = "A title\nThe first part has some words.\nAnother part follows it here."


@pytest.mark.parametrize("attributes", [
    'style="overflow:hidden"', 'class="overflow-hidden"', 'aria-hidden="false"', 'title="hidden valley"', 'data-href="/hidden-x"', "hidden=until-found",
    'class="has-sidebar"', 'class="content-with-sidebar"', 'class="search"', 'class="social"', 'class="tags"', 'class="notice"', 'data-x="display:none"',
])
def test_attributes_that_hide_no_article(attributes):
    assert x.main_text(f"<body><div {attributes}><article>{BODY}</article></div></body>") == TEXT
    assert x.main_text(f"<body><article><div {attributes}>{BODY}</div></article></body>") == TEXT or "class=" in attributes


@pytest.mark.parametrize("attributes", ["hidden", 'hidden=""', "HIDDEN='hidden'", 'aria-hidden="true"', 'style="color:red; display : none"'])
def test_what_hides(attributes):
    assert x.main_text(f"<article>{BODY}<div {attributes}><p>unseen words are here</p></div></article>") == TEXT


def test_names_are_whole_or_last_parts_and_weighed():
    long = "<p>" + "many words stand in this part " * 30 + "</p>"
    assert x.main_text(f'<article>{BODY}<div class="tags">a b c</div></article>') == TEXT
    assert x.main_text(f'<article>{BODY}<div class="tags-of-interest"><p>Some words more</p></div></article>') == TEXT + "\nSome words more"
    assert x.main_text(f'<article>{BODY}<div class="notice">{long}</div></article>').count("many") == 30
    assert x.main_text(f"<article>{BODY}</article><div>{long}{long}</div>").count("many") == 60
    assert x.main_text(f'<main>{BODY}<div class="comments"><article>{BODY}</article></div></main>') == TEXT


def test_the_cut_changes_labels_that_the_signs_alone_get_wrong(sf):
    def labels(page):
        blocks = x.blocks_of(page or "")
        scores, edges = x.network(blocks)
        return [(s > 0, k) for s, k, _ in zip(scores, x.minimum_cut(scores, edges), blocks, strict=False)]

    import pyarrow.parquet as pq

    pages = pq.read_table(f"{sf}/pages.parquet")["html"].to_pylist()
    assert sum(sign != cut for p in pages for sign, cut in labels(p)) > len(pages)
    # short parts of an article look like labels of a menu, and stay; a menu's long item goes
    page = f"<article>{BODY}<p>Yes.</p><h2>No</h2>{BODY}</article><div>{'<p><a href=x>Another page of this site with a long title of its own</a></p>' * 4}<p>And some words on them here</p></div>"
    own = labels(page)
    assert [sign for sign, _ in own] != [cut for _, cut in own]
    assert x.main_text(page) == f"{TEXT}\nYes.\nNo\n{TEXT}"


@pytest.mark.parametrize("page, text", [
    # a form that frames the page, with and without an article in it
    (f'<body><form id="aspnetForm" action="/"><nav><a href=/>Home</a></nav><article>{BODY}</article><label>Name</label></form></body>', TEXT),
    (f'<body><form id="aspnetForm"><div id="menu"><a href=/>Home</a></div><div id="content">{BODY}{BODY}</div><label>Search this site</label></form><form><p>Leave your name</p></form></body>', f"{TEXT}\n{TEXT}"),
    (f"<body><header><article>{BODY}</article></header></body>", TEXT),
    (f"<body><header><h1>The site</h1></header><article>{BODY}</article></body>", TEXT),
    (f"<body><dialog open><article>{BODY}</article></dialog></body>", TEXT),
    (f"<body><article>{BODY}</article><aside><article>{BODY}</article></aside></body>", TEXT),
    ("<body><p>Hello world.</p></body>", "Hello world."),
    ("<p>One.</p>", "One."),
    ("<body><nav><a href=/>Home</a></nav><p>Gone.</p><footer>2020</footer></body>", "Gone."),
    ("<body><nav><a href=/>Home</a></nav><ul><li><a href=a>Next</a></li></ul><footer>2020</footer></body>", ""),
])
def test_frames_and_short_pages(page, text):
    assert x.main_text(page) == text


LONG_COMMENT = "<p>" + "I have read all of this great article twice and will do so again. " * 12 + "</p>"


@pytest.mark.parametrize("comments", [
    '<section id="comments"><article class="comment"><p>I have read all of this great article twice.</p></article><article class="comment"><p>So have I.</p></article></section>',
    f'<section id="comments"><article class="comment">{LONG_COMMENT}</article></section>',
    f'<div class="post-comments"><div>{LONG_COMMENT}</div>{LONG_COMMENT}</div>',
    f'<article class="comment">{LONG_COMMENT}</article><article class="reply comment">{LONG_COMMENT}</article>',
    f'<ol class="commentlist"><li>{LONG_COMMENT}</li><li>{LONG_COMMENT}</li></ol>',
    f'<form><label>Comment</label>{LONG_COMMENT}<input type=submit></form>',
])
def test_comments_within_the_article_go(comments):
    assert x.main_text(f"<body><article>{BODY}{BODY}{comments}</article></body>") == f"{TEXT}\n{TEXT}"
    assert x.main_text(f"<body><main><article>{BODY}{BODY}</article>{comments}</main></body>") == f"{TEXT}\n{TEXT}"


def test_articles_within_an_article_and_in_main_stay():
    assert x.main_text(f"<main>{BODY}<article>{BODY}</article></main>") == f"{TEXT}\n{TEXT}"
    assert x.main_text(f"<article>{BODY}<article>{BODY}</article></article>") == f"{TEXT}\n{TEXT}"


def test_a_very_long_page():
    body = "".join(f"<p>Part {i} of a very long page with some words in it.</p>" for i in range(20_000))
    text = x.main_text(f"<body><nav><a href=/>Home</a></nav><article>{body}</article><footer>x</footer></body>")
    assert text.count("\n") == 19_999 and text.startswith("Part 0 ") and text.endswith("in it.")


def test_columns_with_clashing_names(spark):
    wide = "page_id long, url string, html string, text string, n_chars string, link int"
    rows = spark.createDataFrame([(1, "u", f"<article>{BODY}</article>", "x", "y", 1)], wide)
    assert [tuple(r) for r in x.extract_text(rows).collect()] == [(1, "u", TEXT, len(TEXT))]


def test_formulas_stay():
    assert x.main_text("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> hold for all of this.</p></article>") == "Let x=1 hold for all of this."


def test_odd_pages():
    assert x.main_text(None) == x.main_text("") == x.main_text("<p") == ""
    assert x.main_text("<article><p>cut &am") == "cut &am"
    assert x.main_text('<article><p class="x>odd</p><p>kept text</p></article>').endswith("kept text")
    assert x.main_text("<article>a < b and c<p>" + "w " * 50_000) .count("w") == 50_000


def test_query_keeps_every_row(spark):
    rows = [(1, "u", PAGE), (2, None, None), (None, "u", ""), (1, "u", PAGE)]
    out = x.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS n_chars", "2 AS text")).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in out) == sorted([(1, len(x.main_text(PAGE)))] * 2 + [(2, 0), (0, 0)])
    assert x.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
