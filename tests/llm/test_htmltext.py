import time

import pytest

from assaylake.llm import common, htmltext


def text_of(page):
    path = htmltext.vote(page)
    return htmltext.extract(page, None if path is None else htmltext.path_key(path))


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""),
        ("", ""),
        ("just words", "just words"),
        ("<p>a&amp;b &#233;&nbsp; c", "a&b é c"),
        ("<nav>menu</nav><article><h1>T</h1><p>one <b>t</b>wo<p>three</article><footer>f</footer>", "T one two three"),
        ('<script>var t="</p>";x(1)</script><article><p>a</p><!-- <p>no</p> --><p>b<br>c</p></article>', "a b c"),
        ('<div class="ad">buy</div><main><p>long enough text</p><form>f<input></form><aside>s</aside></main>', "long enough text"),
        ('<div id="content"><p>text of the page</p><ul><li>x<li>y</ul><div class="comments-list"><p>first!</p></div></div>', "text of the page x y"),
        ('<body class="has-sidebar"><div class="cookieNotice">c</div><section><p>the text is here</p></section><div role="banner">b</div></body>', "the text is here"),
        ("<article>a<b>unclosed <i>deep</article><p>after</p>", "aunclosed deep"),
        ("<article><p>x < y & z > w</p></article>", "x < y & z > w"),
        ('<article><p title="a > b">t</p><p hidden>h</p><p style="display: none">n</p></article>', "t"),
        ("<article><table><tr><td>a<td>b<tr><td>c</table></article>", "a b c"),
        ('<article><a title="unclosed>x</a><p>y</p></article>', "x y"),
        ("<body><h1>Head</h1><div class=a>long</div><div class=b>second</div></body>", "Head long second"),
        ("<div id=main><p>A</p><div class=search-results>real text</div></div>", "A real text"),
        ("<article><h1>T</h1><div class='related-work'>kept</div><div class='related-posts'>not</div></article>", "T kept"),
        ("<header>site</header><article><header><h1>Title</h1><nav>x</nav></header><div class=body>" + "text " * 50 + "</div><footer>f</footer></article>", "Title " + ("text " * 50).strip()),
        ("<main><h1>T</h1><p>lead</p><article><section>" + "text " * 90 + "</section></article></main>", "T lead " + ("text " * 90).strip()),
        ("<div><a href=1>one</a><a href=2>two</a><a href=3>three</a></div><h1>T</h1><div>some words here</div>", "T some words here"),
        ("<article><p>x <y and z", "x <y and z"),
        ("<article><p>a</p><!-- open <p>b</p>", "a"),
        ("<article><script>x</script ><p>a</p><style>b", "a"),
        ("<div class='a b c d'><p>t</p></div><div class='nav-links'>n</div>", "t"),
    ],
)
def test_pages(page, want):
    assert text_of(page) == want


def test_consensus_overrules_a_page(spark):
    usual = '<div class="story"><p>{}</p></div><div class="x9">{}</div>'
    pages = [(i, "https://h.example/" + str(i), usual.format("body text of some length " * 5, "short")) for i in range(8)]
    pages += [(8, "https://H.example:80/8", usual.format("brief", "a very long tail of other things " * 20)), (9, None, "<p>alone"), (10, "odd url", None), (11, "https://other.example", "<div class=x9><p>only</p></div>")]
    frame = spark.createDataFrame([(*p, "clash") for p in pages + pages[-1:]], "page_id long, url string, html string, host string")
    got = {r["page_id"]: r["text"] for r in htmltext.main_text(frame).collect()}
    assert got[8] == "brief" and got[9] == "alone" and got[10] == "" and got[11] == "only"
    winners = {r["host"]: r["path"] for r in htmltext.host_paths(frame).collect()}
    assert winners["h.example"] == "/div.story"
    assert htmltext.main_text(frame).count() == len(pages) + 1
    assert htmltext.main_text(frame.limit(0)).collect() == []


def test_deep_and_long_pages():
    assert text_of("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert len(text_of("<article>" + "<p>word word</p>" * 20_000 + "</article>")) == 20_000 * 10 - 1


def test_paths_have_all_classes():
    page = htmltext.Page("<div class='a b c d1'><p>one</p></div><div class='a b c e'><p>two</p></div>")
    assert [page.path(i) for i in range(3)] == ["", "/div.a.b.c.d", "/div.a.b.c.e"]
    assert page.text(page.on(htmltext.path_key("/div.a.b.c.e"))) == "two"


@pytest.mark.parametrize(
    "page",
    ["<a " * 400_000, "<div>" * 100_000 + "deep", "<!-" * 400_000, "<script>" + "</script " * 200_000, "<p>" + "</div>" * 200_000, '<a x="' * 200_001 + ">", "<a =' \">" * 150_000, "<b>" + "<i>" * 100_000 + "<div>" + "</b>" * 100_000, "<li>" * 100_000, "<div class=x>" * 50_000 + "</p>" * 50_000],
)
def test_linear_in_odd_pages(page):
    began = time.process_time()
    htmltext.extract(page, htmltext.path_key("/div"))
    assert time.process_time() - began < 8


def test_path_key_is_that_of_spark(spark):
    assert [r[0] % (1 << 64) for r in spark.sql("select xxhash64(x) from values ('/div.é'), ('') t(x)").collect()] == [htmltext.path_key("/div.é"), htmltext.path_key("")]


def test_hosts_beyond_a_broadcast(spark, monkeypatch):
    pages = [(i, f"https://h{i % 7 * (i % 2)}/", f"<article><p>text {i}</p></article><p>x") for i in range(60)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)
    want = {i: f"text {i}" for i in range(60)}
    assert {r["page_id"]: r["text"] for r in htmltext.main_text(frame).collect()} == want
    monkeypatch.setattr(common, "BROADCAST_ROWS", 2)
    assert {r["page_id"]: r["text"] for r in htmltext.main_text(frame).collect()} == want


BODY = "This is the whole article with quite some words in it, as it should be. " * 8


@pytest.mark.parametrize("inner", ['<div class="comment-on-law">%s</div>', '<p class="share-price">%s</p>', '<blockquote class="banner-quote">%s</blockquote>', '<div class="sharing-economy">%s</div>', '<p class="menu-of-the-day">%s</p>', '<div class="consent-form-law">%s</div>', '<div class="commentary">%s</div>'])
def test_names_with_other_words_are_content(inner):
    page = "<html><body><nav>Home</nav><article><h1>T</h1>" + inner % BODY + "<p>End.</p></article></body></html>"
    assert text_of(page) == " ".join(f"T {BODY} End.".split())


COMMENTS = ['<ol class="commentlist"><li>%s</li></ol>', '<div class="responses"><p>%s</p></div>', '<section id="comments"><article class="comment">%s</article></section>', '<div class="post-comments">%s</div>', '<div class="usercomments">%s</div>', '<div id="comment-12" class="comment-body">%s</div>', '<article class="comment" id="comment-3">%s</article>']


@pytest.mark.parametrize("comments", COMMENTS)
@pytest.mark.parametrize("theme", ["<article><h1>T</h1><p>{}</p>{}</article>", '<main><article><h1>T</h1><p>{}</p></article>{}</main>', '<div class="content"><h1>T</h1><p>{}</p>{}</div>', '<div id="docs"><div class="page"><h1>T</h1><p>{}</p></div>{}</div>'])
def test_reader_comments_go_in_every_theme(comments, theme):
    page = "<html><body><nav>Home</nav>" + theme.format(BODY, comments % ("Nice post. " * 200)) + "</body></html>"
    assert text_of(page) == " ".join(f"T {BODY}".split())


def test_path_with_little_text_yields():
    page = f"<html><body><div class=content>hi</div><article>{BODY}</article></body></html>"
    assert htmltext.extract(page, htmltext.path_key("/html/body/div.content")) == BODY.strip()


def test_forum_keeps_every_post():
    posts = "".join(f'<article class="post"><p>Post {i} says this. {BODY}</p><div class="share-bar">Share</div></article>' for i in range(4))
    page = f'<html><body><main class="thread">{posts}<p class="info-notice">Read the rules.</p></main></body></html>'
    text = text_of(page)
    assert all(f"Post {i} says this." in text for i in range(4)) and "Share" not in text and "rules" not in text


def test_page_inside_of_a_marked_element_is_read():
    page = f'<html><body><div class="sidebar-box"><p>{BODY}</p></div><p>x</p></body></html>'
    assert "whole article" in text_of(page)
    assert text_of(page.replace("sidebar-box", "comments")) == "x"
