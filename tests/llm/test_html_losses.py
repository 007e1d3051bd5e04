"""Articles under odd names and wrappers, and sentences with the words of notices in them: nothing is lost."""

from __future__ import annotations

import pytest

from quillmark.llm import html

TEXT = ["A first paragraph of the article, which goes on for a while.", "Critics said the cookie policy hurt users.", "Maria Lopez said: we will rebuild the town.", "Subscribe rates fell sharply.", "Ad: spending rose by ten percent.", "The last paragraph has more than a few words in it, as others do."]
PARTS = "".join(f"<p>{t}</p>" for t in TEXT)
MENU = "<ul><li><a href='/a'>Home</a></li><li><a href='/b'>Sports news</a></li></ul>"


@pytest.fixture(scope="module")
def fitted(spark):
    return html.train(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


@pytest.mark.parametrize(
    "page",
    [
        "<nav>{menu}</nav><article>{parts}</article><footer>© Us</footer>",
        '<nav>{menu}</nav><article class="share price">{parts}</article><footer>© Us</footer>',
        '<main class="legal">{parts}</main><footer>Imprint</footer>',
        '<div id="main" class="side">{parts}</div><div class="sidebar">{menu}</div>',
        '<div class="side"><article>{parts}</article></div>',
        "<form><article>{parts}</article><input></form>",
        '<form id="aspnetForm"><nav>{menu}</nav><div>{parts}</div><footer>© Us</footer></form>',
        '<form id="aspnetForm"><div class="header">{menu}</div><article>{parts}</article></form>',
        "<nav>{menu}<article>{parts}</article>",
        "<nav>{menu}<div>{parts}</div>",
        "<aside><main>{parts}</main></aside>",
        '<div style="display:none"><article>{parts}</article></div>',
        '<article>{parts}</article><section class="comments"><article class="comment"><p>I liked it very much, and so did my whole family here.</p></article></section>',
        '<article>{parts}</article><div class="sidebar"><article><p>Another story that you may want to read.</p></article></div>',
        '<div>{parts}</div><div class="sidebar"><article><p>Another story you want to read.</p></article></div>',
        '<article>{parts}</article><form><p>Write to us about what you think of this text.</p></form>',
        '<article>{parts}</article><div><p>I did not like what I have read here at all.</p></div>',
    ],
)
def test_the_article_stays_whole(page, fitted):
    page = "<html><body>" + page.format(menu=MENU, parts=PARTS) + "</body></html>"
    for weights in (html._PRIOR, fitted):
        assert html.main_text(page, weights) == "\n".join(TEXT)


@pytest.mark.parametrize("call", ["Sign up for our newsletter today!", "Advertisement", "Advertisement: buy now.", "John says: nice article!", "Read more about it here", "3 comments", "Share this on the net"])
def test_calls_inside_an_article_go(call, fitted):
    page = f"<article>{PARTS}<p>{call}</p>{PARTS}</article>"
    for weights in (html._PRIOR, fitted):
        assert html.main_text(page, weights) == "\n".join(TEXT + TEXT)


@pytest.mark.parametrize("page", ["<nav>{menu}</nav>", "<nav>{menu}</nav><footer>© 2024 Us</footer>", "<form><button>Send</button></form>", "<div class=menu>{menu}</div>", ""])
def test_pages_without_text_are_empty(page, fitted):
    for weights in (html._PRIOR, fitted):
        assert html.main_text(page.format(menu=MENU), weights) == ""


def test_pages_of_little_text_keep_it():
    assert html.main_text("<p>Hello</p>") == "Hello"
    assert html.main_text("<div><a href=x>One</a></div><div>two</div>") != ""


def test_deep_and_wide_marks_take_time_in_proportion():
    import time

    began = time.time()
    deep = "<div class=nav>" * 20_000 + PARTS
    wide = "".join(f"<div class='content c{k}'><p>Paragraph {k} of a text in many parts.</p></div>" for k in range(20_000))
    assert html.main_text(wide).count("\n") == 19_999
    html.main_text(deep)
    assert time.time() - began < 20
