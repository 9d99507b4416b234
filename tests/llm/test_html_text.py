"""Pages whose names and line lengths look like menus and adverts, but are text."""

from __future__ import annotations

from secondcart.llm import html_text


def test_slugs_of_titles_are_text():
    parts = [
        '<h2 id="search-and-sharing">Search and sharing</h2>',
        '<section id="related-work"><h2>Related work</h2><p>Others did this.</p></section>',
        '<h2 id="search">Search</h2>',
        '<section id="notice" aria-label="Copyright notice"><p>On notices.</p></section>',
        '<div class="section" id="social-widgets"><p>On widgets.</p></div>',
        '<p id="login">On logging in.</p><figure id="banner"><figcaption>A flag</figcaption></figure>',
        '<ul id="related-languages"><li id="ad-hoc">Ad hoc</li></ul>',
        '<div class="no-ads">Free of them.</div><div class="post-header">Head</div>',
        '<h2 class="social-history">Social history</h2>',
    ]
    text = (
        "Search and sharing Related work Others did this. Search On notices. On widgets."
        " On logging in. A flag Ad hoc Free of them. Head Social history"
    )
    for tag in ("article", "main"):
        page = f"<nav>Menu</nav><{tag}>{''.join(parts)}</{tag}><footer>Foot</footer>"
        assert html_text.main_text(page) == text


def test_a_wrapper_that_has_a_sidebar_is_no_sidebar():
    page = '<div class="layout has-sidebar"><article><p>Text</p></article></div>'
    assert html_text.main_text(page) == "Text"


def test_known_names_are_not_text():
    junk = [
        '<div class="share-buttons">Tell</div><div class="x ad">Buy</div>',
        '<ul class="related-posts"><li>More</li></ul><div id="newsletterForm">Join</div>',
        '<section class="comments">First!</section><section id="comments">Second!</section>',
        '<p class="widget">Box</p><div role="search">Find</div><aside>Side</aside>',
        '<div aria-label="Social links">Follow</div><p class="ad">Buy</p>',
    ]
    page = f"<article><p>One</p>{''.join(junk)}<p>two</p></article>"
    assert html_text.main_text(page) == "One two"


def test_without_an_article_an_advert_does_not_end_the_text():
    prose = [f"Paragraph {k} " + "x" * 386 for k in range(10)]
    closing = [f"Closing {k} " + "y" * 290 for k in range(2)]
    body = "".join(f"<p>{p}</p>" for p in prose)
    for junk in (
        '<div class="ad"><p>Buy</p><p>now</p><p>here</p></div>',
        "<form><p>Name</p><p>Mail</p><p>Send</p></form>",
        "".join(f"<li><a href=/{k}>Link {k}</a></li>" for k in range(5)),
    ):
        end = "".join(f"<p>{p}</p>" for p in closing)
        page = f"<body><h1>A title</h1>{junk}{body}{junk}{end}</body>"
        assert html_text.main_text(page) == " ".join(["A title", *prose, *closing])


def test_without_an_article_short_lines_between_paragraphs_stay():
    items = [f"short entry number {k % 10}" for k in range(12)]
    lines = "".join(f"<li>{x}</li>" for x in items)
    page = f"<body><p>{'a' * 500}</p><ul>{lines}</ul><p>{'b' * 500}</p></body>"
    assert html_text.main_text(page) == " ".join(["a" * 500, *items, "b" * 500])
    tiny = "".join(f"<p>entry {k}</p>" for k in range(6))
    page = f"<body>{tiny}<p>{'a' * 500}</p><p>{'b' * 500}</p>{tiny}</body>"
    ends = "entry 4 entry 5", "entry 0 entry 1"
    assert html_text.main_text(page) == f"{ends[0]} {'a' * 500} {'b' * 500} {ends[1]}"
