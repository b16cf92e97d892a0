import json

import pytest
from pyspark.sql import functions as F

from waypost.operators.extract import admissible, extract_links, extract_pages, extract_products

HTML = """<!DOCTYPE html><html><head><title> R&amp;D </title>
<meta name="description" content=" Desc "><meta property="og:description" content="og">
<style>p{}</style><script>var x = "</p><h1>no</h1>";</script></head>
<body class="x"><h1>Big <b>red</b></h1><h1> two </h1><!-- hidden --><template>tpl</template>
<p>Some<br>text &copy; x</p><script>more()</script>  <p> </p>tail</body></html>"""
MODES = ["parser", "pattern"]


def raw(spark, *htmls, urls=None):
    rows = [(i, (urls or {}).get(i, f"https://a.com/p-{i}"), html) for i, html in enumerate(htmls)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def one(spark, html, mode, **params):
    return extract_pages(raw(spark, html), "source", mode=mode, **params).first()


@pytest.mark.parametrize("mode", MODES)
def test_fields(spark, mode):
    row = one(spark, HTML, mode)
    assert (row.title, row.description, row.h1) == ("R&D", "Desc", "Bigred | two")
    assert row.body_text == "Big red two Some text © x tail"
    assert (row.status_code, row.site, row.depth) == (200, "source", 0)


@pytest.mark.parametrize("mode", MODES)
def test_missing_parts(spark, mode):
    row = one(spark, "<p>no body</p>", mode)
    assert (row.title, row.description, row.h1, row.body_text) == ("", "", "", "")


@pytest.mark.parametrize("mode", MODES)
def test_first_title_counts(spark, mode):
    assert one(spark, "<title>a</title><body><title>b</title>x</body>", mode).title == "a"


@pytest.mark.parametrize("mode", MODES)
def test_html_cut_inside_a_tag(spark, mode):
    assert one(spark, "<body><p>text</p><p cla", mode).body_text == "text"


@pytest.mark.parametrize("mode", MODES)
@pytest.mark.parametrize("tags, want", [
    ('<meta property="description" content="p">', "p"),
    ('<meta name="description" content=""><meta name="og:description" content="og">', "og"),
    ('<meta content="swapped" name="description"/>', "swapped"),
    ("<meta name='description' content='single'>", "single"),
    ('<meta property="og:description" content="only og">', "only og"),
    ('<meta name="descriptions" content="other">', ""),
])
def test_description(spark, mode, tags, want):
    assert one(spark, f"<head>{tags}</head><body>x</body>", mode).description == want


@pytest.mark.parametrize("mode", MODES)
def test_body_is_whole_unless_a_limit_is_asked_for(spark, mode):
    long = [one(spark, "<body>" + "é" * 30_000 + end + "</body>", mode) for end in "ab"]
    assert [len(page.body_text) for page in long] == [30_001, 30_001]
    assert long[0].content_hash != long[1].content_hash
    assert one(spark, "<body>abcdef</body>", mode, body_limit=3).body_text == "abc"


@pytest.mark.parametrize("mode", MODES)
def test_stub(spark, mode):
    df = raw(spark, None, urls={0: "https://a.com/shop/red-robot-x/?q"})
    row = extract_pages(df, "target", mode=mode).first()
    assert (row.status_code, row.title, row.h1, row.body_text) == (0, "red robot x", "", "")


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        extract_pages(raw(spark, HTML), "source", mode="x")


def test_admissible(spark):
    df = spark.createDataFrame([("text/html; x", "a" * 200), ("application/pdf", "a" * 300),
                                ("text/html", "a" * 199)], "ct string, html string")
    kept = df.where(admissible(F.col("ct"), F.col("html"), min_length=200)).collect()
    assert [row.ct for row in kept] == ["text/html; x"]


def product(spark, *blocks, extra=""):
    scripts = "".join(f'<script type="application/ld+json">{block}</script>' for block in blocks)
    pages = extract_pages(raw(spark, f"<head>{scripts}</head><body>{extra}</body>"), "source")
    return extract_products(pages).first().structured_data


def test_product_fields_last_wins(spark):
    row = product(
        spark,
        json.dumps([{"@type": "Product", "name": "A", "sku": "s1", "category": "cat",
                     "brand": {"name": "B"}, "gtin13": "123",
                     "offers": [{"price": 9.5, "priceCurrency": "EUR"}, {"price": 1}]}, "text", 5]),
        "{broken",
        json.dumps({"@type": "Product", "name": "A2", "sku": "", "brand": "Plain",
                    "offers": {"availability": "InStock", "gtin8": "ignored"}}))
    assert (row.product_name, row.sku, row.product_type, row.brand) == ("A2", "s1", "cat", "Plain")
    assert (row.price, row.currency, row.availability) == ("9.5", "EUR", "InStock")
    assert (row.ean, row.gtin) == ("123", "123")


def test_codes(spark):
    row = product(spark, json.dumps({"@type": "Product", "isbn": "i1", "gtin12": "t12"}))
    assert (row.ean, row.gtin) == (None, "t12")
    row = product(spark, json.dumps({"@type": "Product", "offers": {"gtin13": "o13"}}))
    assert (row.ean, row.gtin) == ("o13", "o13")
    row = product(spark, json.dumps({"@type": "Product", "offers": {"isbn": "no"}}),
                  extra='<span itemprop="gtin13"> 77 <b>8</b></span>')
    assert (row.ean, row.gtin) == ("778", "778")
    row = product(spark, extra='<meta itemprop="ean" content="5"><meta itemprop="gtin" content="4">')
    assert (row.ean, row.gtin) == ("4", "4")


def test_breadcrumb(spark):
    row = product(spark, json.dumps({"@type": "BreadcrumbList", "itemListElement": [
        {"position": 2, "name": "two", "item": {"@id": "/2"}}, "noise",
        {"name": "none", "item": "/0"}, {"position": 10, "name": "ten", "item": {"url": "/10"}},
        {"position": 1.5, "name": "mid"}]}))
    assert [(b.name, b.url) for b in row.breadcrumb] == [
        ("none", "/0"), ("mid", ""), ("two", "/2"), ("ten", "/10")]
    assert product(spark, "{}").breadcrumb == []


def test_links_by_any_quotes(spark):
    html = ("<a href=\"/l'eau\">a</a><a data-href=\"/wrong\" href=\"/right\">b</a><a href='/q\"uote'>c</a>"
            "<a href=/bare>d</a><a title=\"x > y\" href=\"/after\">e</a><a name=\"none\">f</a>"
            "<a href=\"/caf&eacute;?a=1&amp;b=2\">g</a><a HREF = '/upper'>h</a><abbr href=\"/no\">i</abbr>")
    found = extract_links(raw(spark, html, urls={0: "https://a.com/"})).collect()
    assert sorted(r.dst_url for r in found) == sorted(f"https://a.com/{path}" for path in (
        "l'eau", "right", 'q"uote', "bare", "after", "café", "upper"))


@pytest.mark.parametrize("mode", MODES)
def test_angle_brackets_in_attributes_and_all_entities(spark, mode):
    row = one(spark, '<head><title>caf&eacute; &#233;&#xE9;&#146; &amp;eacute; &unknown;</title>'
                     '<meta name="description" content="a > b&nbsp;c"></head>'
                     '<body><p title="x > y">don\'t</p><p class=it\'s>&hearts;&#x1F600;</p></body>', mode)
    assert row.title == "café éé’ &eacute; &unknown;"
    assert row.description == "a > b\xa0c"
    assert row.body_text == "don't ♥😀"


def test_links(spark):
    html = "".join(f'<a class="x" href="{href}">l</a>' for href in (
        "/a?x=1", "b/c#f", "../up", "https://a.com/abs;p", "HTTPS://a.com/Z", "https://b.com/no",
        "//a.com/proto", "mailto:x@a.com", "", "/r/../dots", "#top"))
    df = raw(spark, html, urls={0: "https://a.com/d/e/page?q=1"})
    assert sorted(r.dst_url for r in extract_links(df).collect()) == sorted([
        "https://a.com/a", "https://a.com/d/e/b/c", "https://a.com/d/up", "https://a.com/abs",
        "https://a.com/Z", "https://a.com/proto", "https://a.com/d/e/page", "https://a.com/dots",
        "https://a.com/d/e/page"])


def test_references_without_semicolon_in_title_and_headings(spark):
    html = ("<html>\n<title>\n a &amp;&lt;b &amp</title><body>\n<h1>x &copy; <b>&#233; &euro</b> &amp</h1>"
            "<!-- c --><p>t &amp</p></body></html>")
    plain = one(spark, html, "parser")
    assert (plain.title, plain.h1) == ("a &<b &", "x ©é &euro&")   # browsers know no bare &euro
    for mode in MODES:
        row = one(spark, html, mode, terminated_heads=True)
        assert (row.title, row.h1) == ("a &<b &amp", "x ©é &euro&amp")
    assert one(spark, html, "parser", terminated_heads=True).body_text.endswith("t &")
