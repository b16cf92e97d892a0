"""Class words and forms around a page don't hide its text; what stands beside it goes."""

import time

import pytest

from waypost.llm.pages import main_text

BODY = [f"Paragraph {k} has about a hundred characters, which is quite usual for the text of a page, is it not?"
        for k in range(5)]
TEXT = "\n".join(BODY)
INNER = "".join(f"<p>{text}</p>" for text in BODY)
MENU = '<nav><a href="/">Home</a></nav>'


@pytest.mark.parametrize("name", [
    "has-sidebar", "no-sidebar", "post-with-comments", "ad-free", "market-share", "promo-code-guide", "widget-area-off",
    "elementor-widget", "sidebar", "content widget"])
@pytest.mark.parametrize("tag", ["div", "article"])
def test_wrapper_classes(name, tag):
    assert main_text(f'<body>{MENU}<div class="{name}"><{tag}>{INNER}</{tag}></div></body>') == TEXT


def test_page_in_one_form():
    page = f'<body><form id="aspnet">{MENU}<div>{INNER}</div></form></body>'
    assert main_text(page) == TEXT
    asked = "<form><p>Write to us, we answer.</p><input></form>"
    assert main_text(f"<body><div>{INNER}{asked}</div></body>") == TEXT


def test_section_within_article():
    page = f'<article><h1>Head</h1>{INNER}<section class="social-science"><p>{BODY[0]}</p></section></article>'
    assert main_text(page) == "\n".join(["Head", TEXT, BODY[0]])
    page = f'<article>{INNER}<div class="social-share-bar"><p>Tell your friends about it.</p></div></article>'
    assert main_text(page) == TEXT


def test_neutral_link_list_and_copyright_go():
    links = "".join(f'<div><a href="/{k}">{k}</a></div>' for k in ("Home", "News"))
    page = f"<body><div>{links}</div><div>{INNER}</div><div>Copyright 2024 by Some Company</div></body>"
    assert main_text(page) == TEXT


def test_deep_pages_take_no_square_time():
    started = time.perf_counter()
    deep = "<div>" * 40_000 + INNER + "</b>" * 1000
    assert main_text(deep) == TEXT
    lines = "".join(f"<div>word {k}" for k in range(5_000))
    main_text(lines)
    assert time.perf_counter() - started < 5
