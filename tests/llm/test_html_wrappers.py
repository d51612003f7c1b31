"""Forms and class words around a whole page, and links inside an article."""

import random

import pytest

from shelfsight.llm import html

LONG = ("This is the text of the page, and it is long enough to be decided by the words that it has in it, as it "
        "is with all of the pages here.")
SIDE = "<nav><a href='/'>Home</a></nav>"


@pytest.mark.parametrize("page, text", [
    (f"<body><form id=aspnetForm>{SIDE}<h1>Title</h1><p>{LONG}</p><footer>Foot</footer></form></body>", f"Title\n{LONG}"),
    (f"<body><form>{SIDE}<article><h1>Title</h1><p>Tiny.</p></article><p>Out of it.</p></form></body>", "Title\nTiny."),
    (f"<body><div class='layout-sidebar-right'>{SIDE}<article><p>{LONG}</p></article></div></body>", LONG),
    (f"<body><div class='menu-open'><h1>Title</h1><p>{LONG}</p><div class='comments'><p>{LONG} No.</p></div></div></body>",
     f"Title\n{LONG}"),
    (f"<body><div class='menu-open'><div class='post'><p>Short one.</p></div><div class=sidebar>{LONG}</div></div>"
     f"<div class='cookie-notice'>{LONG}</div></body>", "Short one."),
    # a form, comments, related articles and a sidebar beside the text stay out
    (f"<body><p>{LONG}</p><form><p>Your name</p></form></body>", LONG),
    (f"<body><article><p>Tiny.</p><form><p>{LONG}</p></form><div class=comments><p>{LONG}</p></div></article>"
     f"<div class=related><article><p>{LONG}</p></article></div></body>", "Tiny."),
    (f"<body><article><p>{LONG}</p></article><div class='widget'><article><p>{LONG} More.</p></article></div></body>", LONG),
    # links inside an article
    (f"<body><article><p>{LONG}</p><ul><li><a href=a>Source one</a></li><li>Short line</li><li><a href=b>Source two</a>"
     f"</li></ul></article></body>", f"{LONG}\nSource one\nShort line\nSource two"),
    (f"<body><p>{LONG}</p><p><a href=a>Source one</a></p></body>", LONG)])
def test_wrappers(page, text):
    assert html.extract(page) == text


PARTS = {"pl": "zażółć gęślą jaźń proszę bardzo dziękuję mówić pisać wiedzieć świat drzewo rzeka kamień chmura".split(),
         "en": "river stone cloud mountain forest harbour lantern copper silver meadow orchard thunder granite".split()}


@pytest.mark.parametrize("lang", ["pl", "en"])
def test_generated_pages_without_an_article(lang):
    """Long paragraphs in a language without a stop-word list, or with few stop
    words, between menus and links: all of them are the text."""
    rng = random.Random(lang)
    for _ in range(60):
        paragraphs = [" ".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(30, 90))) + "." for _ in range(rng.randint(1, 6))]
        link = "<div><a href='/x'>" + " ".join(rng.choice(PARTS[lang]) for _ in range(3)) + "</a></div>"
        hidden = f"<div {rng.choice(['hidden', 'hidden=until-found', 'HIDDEN'])}><p>{paragraphs[0]} hidden</p></div>"
        body = SIDE + link + "".join(f"<p>{p}</p>" + rng.choice(["", link, hidden]) for p in paragraphs) + "<footer>End</footer>"
        assert html.extract(f"<html><body>{body}</body></html>") == "\n".join(paragraphs)


def test_hidden_inside_a_value_hides_nothing():
    assert html.extract(f"<body><p data-x='hidden' title=\"a hidden b\">{LONG}</p></body>") == LONG
