"""Whole texts of pages whose layouts differ from those that the page model is fitted on."""

import random

import pytest

pytest.importorskip("public_tokenizers")

from sparkloom.llm import html_text  # noqa: E402

SENTENCES = [
    "The river rises in the hills above the old mill and runs east.",
    "Boats have carried grain and timber along it for two hundred years.",
    "In spring the water covers the meadows, and nobody can cross them.",
    "A ferry was built in 1871 and sold for scrap soon after the war.",
    "Its last keeper still lives in the stone house beside the landing.",
    "Herons stand in the shallows when the evening is quiet enough.",
]
NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News from the town</a></li><li><a href="/c">Contact us</a></li></ul></nav>'
FOOTER = "<footer>&copy; 2020 The Valley Society. All rights reserved. <a href=/p>Privacy</a></footer>"
LONG_HEADING = "A short history of the river"


@pytest.fixture(scope="module")
def model(spark):
    return html_text.default_model(spark)


def paragraphs(n):
    return "".join(f"<p>{s}</p>" for s in SENTENCES[:n])


def page(body, furniture=True):
    return f"<html><head><title>River - Valley</title></head><body>{NAV * furniture}{body}{FOOTER * furniture}</body></html>"


@pytest.mark.parametrize("furniture", [True, False])
@pytest.mark.parametrize("heading", ["Sea", "Ouse", "River", "Rivers", "The Ouse", "The Ouse today", LONG_HEADING])
@pytest.mark.parametrize("n", [1, 2, 4, 6])
def test_short_headings_and_few_sentences(model, heading, n, furniture):
    html = page(f"<article><h1>{heading}</h1>{paragraphs(n)}</article>", furniture)
    assert html_text.main_texts([html], model) == [" ".join([heading, *SENTENCES[:n]])]


INNER = {
    "poem": ("<p>O river<br>so wide<br/>and slow<br>and grey</p>", "O river so wide and slow and grey"),
    "sources": ('<h2>Sources</h2><ul><li><a href="/1">County archive</a></li><li><a href="/2">Old maps</a></li></ul>', "Sources County archive Old maps"),
    "contents": ('<ul><li><a href="#a">Origin</a></li><li><a href="#b">Trade</a></li><li><a href="#c">Floods</a></li></ul>', "Origin Trade Floods"),
    "recipe": ("<ul><li>flour</li><li>2 eggs</li><li>milk</li><li>salt</li></ul>", "flour 2 eggs milk salt"),
    "ruby": ("<p>Written <ruby>漢<rp>(</rp><rt>kan</rt><rp>)</rp></ruby>字 on the old stone.</p>", "Written 漢(kan)字 on the old stone."),
    "break chance": ("<p>It is super<wbr>cali and foo<img src=x>bar as well.</p>", "It is supercali and foobar as well."),
    "own element": ("<p>An uncom<x-mark>mon</x-mark>ly fine view.</p>", "An uncommonly fine view."),
}


@pytest.mark.parametrize("furniture", [True, False])
@pytest.mark.parametrize("inner", INNER)
def test_what_articles_may_hold(model, inner, furniture):
    markup, text = INNER[inner]
    html = page(f"<article><h1>{LONG_HEADING}</h1>{paragraphs(4)}{markup}</article>", furniture)
    assert html_text.main_texts([html], model) == [" ".join([LONG_HEADING, *SENTENCES[:4], text])]


NAMES = "trail-guide navigator canal-navigation-history commentary shared-stories alert-box-article legal-news shared-post broadcast railway radish".split()


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("tag", ["div", "article", "section"])
def test_names_that_only_resemble_furniture(model, tag, name):
    html = page(f'<{tag} class="{name}"><h1>{LONG_HEADING}</h1>{paragraphs(4)}</{tag}>')
    assert html_text.main_texts([html], model) == [" ".join([LONG_HEADING, *SENTENCES[:4]])]


@pytest.mark.parametrize("title", ["<header><h1>{}</h1></header>", '<div class="article-header"><h1>{}</h1></div>'])
def test_title_in_a_header_of_the_article(model, title):
    html = page(f"<article>{title.format(LONG_HEADING)}{paragraphs(4)}</article>")
    assert html_text.main_texts([html], model) == [" ".join([LONG_HEADING, *SENTENCES[:4]])]


FURNITURE = [
    '<div class="site-nav"><a href=/>Home</a> <a href=/b>All about boats</a></div>',
    '<div id="topNav"><ul><li><a href=/>Home</a><li><a href=/b>Boats</a></ul></div>',
    '<div class="cookie-bar"><p>We use cookies to make this site work for you.</p><button>Fine</button></div>',
    '<div class="adBox">Buy a better boat from Smith and Sons today.</div>',
    '<aside><h3>More</h3><p>Our newsletter goes out on Mondays.</p></aside>',
    '<div class="sidebar-right"><h3>Read also</h3><ul><li><a href=/1>Ten walks along the coast</a></ul></div>',
    '<section id="comments"><h3>Comments</h3><article class="comment"><p>I have lived there, and this is quite wrong.</p></article></section>',
    '<form action="/s"><label>Search</label><input name=q><button>Go</button></form>',
    '<header class="masthead"><h1>The Valley Paper</h1><p>News since 1902.</p></header>',
]


def test_whole_texts_of_a_second_layout(model):
    """Pages put together by other rules than those of the labelled pages, in natural language."""
    rng = random.Random(5)
    pages, want = [], []
    for k in range(300):
        parts = [rng.choice(["Sea", "On boats", LONG_HEADING])]
        body = f"<h1>{parts[0]}</h1>"
        for s in rng.sample(SENTENCES, rng.randint(2, 6)):
            body += rng.choice([f"<p>{s}</p>", f"<p>{s}", f"<blockquote>{s}</blockquote>", f"<p><em>{s}</em></p>"])
            parts.append(s)
            if rng.random() < 0.3:
                markup, text = rng.choice(list(INNER.values()))
                body, parts = body + markup, [*parts, text]
            if rng.random() < 0.1:
                body += '<div class="advert">Buy a better boat from Smith and Sons today.</div>'
        open_, close = rng.choice([("<article>", "</article>"), ('<main id="content">', "</main>"), ('<div class="post">', "</div>"), ('<main><article class="story">', "</article></main>")])
        before, after = rng.sample(FURNITURE, rng.randint(0, 3)), rng.sample(FURNITURE, rng.randint(0, 3))
        pages.append(page("".join([*before, open_, body, close, *after]), rng.random() < 0.8))
        want.append(" ".join(parts))
    got = html_text.main_texts(pages, model)
    assert not [g for g in got if not g]
    assert sum(g == w for g, w in zip(got, want)) >= 0.97 * len(pages)
