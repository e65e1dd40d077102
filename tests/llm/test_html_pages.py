"""Main text of pages written by hand, not by the generator that the model learns from; linear time in siblings."""

import time

import pytest

from helixframe.llm import html_extract

P = "Some real text of the article here, with words and commas. It goes on for a while, as articles do, in whole sentences."
Q = "A second part follows, which is shorter; it ends soon."

PAGES = [
    # the whole page in a form
    (f"<html><body><form id=aspnetForm><div class=nav><a href=/>Home</a></div><div id=content><h1>Title</h1><p>{P}</p><p>{Q}</p></div><input name=q><button>Go</button></form></body></html>", ["Title", P, Q]),
    # quotes that open nothing
    (f"<article><p class=it's>{P}</p><p>{Q}</p><p class=it's>{P}</p></article>", [P, Q, P]),
    (f"<article><p class=it's>{P}</p></article>", [P]),
    (f"""<article><p title="a > b" data-x='c "d"'>{P}</p><p =odd = "v" q=>{Q}</p></article>""", [P, Q]),
    # adverts and comments inside a paragraph
    (f'<article><p>{P} <span class="advert">Buy this now</span></p><p>{Q}<span class="comments">3 readers said nice</span></p></article>', [P, Q]),
    # lists by any name
    (f"<article><h2>Steps</h2><p>{P}</p><menu><li>First item of it</li><li>Second item of it</li></menu><p>{Q} <b>bold</b> <a href=x>linked</a>.</p></article>", ["Steps", P, "First item of it", "Second item of it", f"{Q} bold linked."]),
    # what surrounds an article
    (
        f"""<!doctype html><html><head><title>t</title><script>if (a<b) document.write("<p>x</p>")</script></head><body><header><div class="masthead">The Daily</div><nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav></header>
        <div class="cookie-notice"><p>We use cookies. Accept?</p><button>OK</button></div><main><article><h1>On &lt;tags&gt; &amp; more</h1><p>{P}<p>{Q}<blockquote><p>{Q}</p></blockquote></article>
        <section id="comments"><h3>Comments</h3><div class="comment"><b>joe</b><p>I liked this one very much.</p></div></section></main><aside><h3>Related</h3><ul><li><a href="/1">One thing</a></li><li><a href="/2">Other thing</a></li></ul></aside>
        <form class="newsletter"><label>Your address</label><input type=email><button>Subscribe</button></form><footer>&copy; 2024 The Daily &middot; All rights reserved</footer></body></html>""",
        ["On <tags> & more", P, Q, Q],
    ),
    # character references, white space, left-open elements
    (f"<div class=post><h1>Caf&eacute;\n  &#8364;5&nbsp;a\tday</h1><p><b>{P}<br>{Q}</div>", ["Café €5 a day", f"{P} {Q}"]),
]


@pytest.mark.parametrize(("page", "want"), PAGES)
def test_pages(page, want):
    assert html_extract.extract(page, html_extract.model()) == want


def test_many_siblings():
    m = html_extract.model()
    took = []
    for n in (5_000, 40_000):
        began = time.process_time()
        assert len(html_extract.extract("<article>" + "<p>some words, here</p>" * n + "</article>", m)) == n
        took.append(time.process_time() - began)
    assert took[1] < 20 * took[0]
    assert html_extract.extract("<div>" * 20_000 + "<p>" + P + "</foo>" * 20_000, m) in ([P], [])


@pytest.mark.parametrize("broken", ["<", "<<p", "</p></div>", "<p", "<!--", "<script>", "&#xFFFFFFF; &bogus;", "<a b='c", '<a b="c', "<a " + "b='" * 5000, "<a " + "=" * 50_000, "<p " + "x " * 100_000 + "<p>"])
def test_broken_pages(broken):
    html_extract.extract(broken, html_extract.model())
