"""Main text that is split over blocks or articles comes out whole."""

import pytest

from waypost.llm.pages import main_text

MENU = '<nav><a href="/">Home</a></nav><div class="ad">Buy now, very cheap and good, do not miss it.</div>'
FOOT = "<footer>Text of a footer that is rather long, too long maybe.</footer>"
SHORT = [f"Paragraph {k} has about a hundred characters, which is quite usual for the text of a page, is it not?"
         for k in range(5)]
LONG = "One very long paragraph. " * 49 + "End."


@pytest.mark.parametrize("tag", ["div", "section", "blockquote"])
@pytest.mark.parametrize("at", [0, 2, 5])
def test_sibling_blocks_stay(tag, at):
    texts = SHORT[:at] + [LONG] + SHORT[at:]
    blocks = "".join(f"<{tag}><p>{text}</p></{tag}>" for text in texts)
    assert main_text(f"<body>{MENU}<div>{blocks}</div>{FOOT}</body>") == "\n".join(texts)


def test_two_even_columns_of_cells_stay():
    row = "".join(f"<td>{text}</td>" for text in SHORT[:2] + [LONG])
    assert main_text(f"<body>{MENU}<table><tr>{row}</table>{FOOT}") == "\n".join(SHORT[:2] + [LONG])


@pytest.mark.parametrize("wrap", ["{}", "<div>{}</div>"])
def test_sibling_articles_stay(wrap):
    texts = [LONG, *SHORT, "Tiny."]
    articles = "".join(wrap.format(f"<article><p>{text}</p></article>") for text in texts)
    comments = f'<section id="comments"><article><p>{SHORT[0]} What a nice page.</p></article></section>'
    for page in (f"{MENU}{articles}{FOOT}", f"<main>{articles}</main>{FOOT}", f"{articles}{comments}{FOOT}"):
        assert main_text(f"<body>{page}</body>") == "\n".join(texts)


def test_lines_of_links_inside_the_text_stay():
    links = '<p><a href="/a">A list of further reading</a></p>'
    assert main_text(f"<body>{MENU}<div><p>{SHORT[0]}</p>{links}<p>{SHORT[1]}</p></div>{FOOT}") == "\n".join(
        [SHORT[0], "A list of further reading", SHORT[1]])
