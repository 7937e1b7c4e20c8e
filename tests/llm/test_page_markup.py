"""Markup that must not empty a page or stop a task."""

import time

import pytest

from corpusforge.llm import htmldiff


def text(page):
    return htmldiff.main_text(htmldiff.blocks_of(page), set())


BODY = "<p>First paragraph.</p><p>Second one.</p>"
WANT = "First paragraph.\nSecond one."


@pytest.mark.parametrize("page", [
    f'<body class="home no-sidebar has-comments"><article>{BODY}</article>',
    f'<article class="post no-comments">{BODY}</article>', f'<article class="sidebar comments">{BODY}</article>',
    f'<div data-id="nav"><article>{BODY}</article></div>', f'<div xclass="menu" data-role="banner">{BODY}</div>',
    f'<div class="layout nav-open header-fixed with-sidebar">{BODY}</div>', f"<html id='header'><main class=nav>{BODY}</main></html>",
    f'<main>{BODY}<div class="cookie-notice">x</div><div id=sidebar-left>y</div><section class="site-footer">z</section></main>',
    f'<main>{BODY}<div class="comments-area">x</div><ol class="comment_list"><li>y</ol><div role="navigation">z</div></main>',
    f'<article>{BODY}</article><article><p>More &hellip;</p></article><article><p>Other</p></article>',
    f'<article>{BODY}<div class="related-posts"><article><p>A teaser as long as the whole article is.</p></article></div></article>',
])
def test_main_text_by_markup(page):
    assert text(page) == WANT


def test_articles_of_like_length_all_stay():
    assert text("<article><p>One story.</p></article><article><p>Two story.</p></article>") == "One story.\nTwo story."


def test_quoted_values_may_hold_brackets():
    assert text('<article><p title="a < b > c">Text</p><a href=\'x>y\'>link</a></article>') == "Text\nlink"


def test_unclosed_quote_ends_at_the_next_tag():
    assert text('<article><p>One</p><p title="never closed>Two</p><p>Three</p></article>').startswith("One")
    assert "Three" in text('<article><p>One</p><p title="never closed>Two</p><p>Three</p></article>')


@pytest.mark.parametrize("broken", ['<a "', "<a '\"", "<!x ", "<a<", "<a b=", "</a ", "<!--", "&#"])
def test_broken_markup_is_linear(broken):
    start = time.process_time()
    text("<article><p>x</p>" + broken * (400_000 // len(broken)))
    assert time.process_time() - start < 10
