"""HTML fields: pattern expressions that stay in the JVM, and a parser for full fidelity.

The pattern form serves well-formed pages at scan speed. The parser form runs as an Arrow batch
function over the same columns.
"""

from __future__ import annotations

import json
import re
from html import unescape
from html.entities import html5
from html.parser import HTMLParser

from pyspark.sql import Column, functions as F

from waypost.functions.urls import strip

BODY_LIMIT: int | None = None   # characters of body text that are stored; None: all

# Inside a tag: a quoted value may hold ">", a quote without "=" before it is a plain character.
_INSIDE = r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+"""
_TITLE = rf"(?is)<title(?:\s{_INSIDE})?+>(.*?)</title"
_H1 = rf"(?is)<h1(?:\s{_INSIDE})?+>(.*?)</h1"
_BODY = rf"(?is)<body(?:\s{_INSIDE})?+>(.*)"
_BODY_END = r"(?is)</body\s*>.*"
_TAG = rf"<{_INSIDE}>|<[a-zA-Z/!][^>]*$"
_UNSEEN = rf"(?is)<!--.*?-->|<(script|style|template)\b{_INSIDE}>.*?</\1\s*>"
_CUT_TAG = re.compile(r"<[a-zA-Z/!][^<>]*$")
_META = rf"(?is)<meta\s{_INSIDE}>"
_LINK = rf"(?is)<a\s{_INSIDE}>"
_VALUE = r"""\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>][^\s>]*+))"""
_OTHER = r"""[^\s=>/]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)?+)?+"""
_TERMINATED = re.compile(r"&(?:#[0-9]{1,9}|#[xX][0-9a-fA-F]{1,8}|[a-zA-Z][a-zA-Z0-9]*);")
_ENTITY = r"&(?:#[0-9]{1,9}|#[xX][0-9a-fA-F]{1,8}|[a-zA-Z][a-zA-Z0-9]*+);|[^&]++|&"


def _attribute(name: str) -> str:
    """Pattern of a whole tag with the attribute; groups 1 to 3 hold a value by its quotes."""
    return rf"(?is)^<[a-z]+(?:[\s/]++(?!{name}[\s=>/]){_OTHER})*+[\s/]++{name}{_VALUE}.*$"


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, null without one."""
    pattern = _attribute(name)
    return F.when(tag.rlike(pattern), decode_entities(F.regexp_replace(tag, pattern, "$1$2$3")))


def _named_entities() -> Column:
    """Map of all named entities, and of the numbers that stand for Windows characters."""
    names = [f"&{name}" for name in html5 if name.endswith(";")] + [f"&#{n};" for n in range(128, 160)]
    # One literal that the optimizer folds into a map.
    return F.str_to_map(F.lit("\x01".join(f"{name}\x02{unescape(name)}" for name in names)),
                        F.lit("\x01"), F.lit("\x02"))


def decode_entities(text: Column) -> Column:
    """Text with named and numbered entities decoded, each once."""
    named = _named_entities()

    def decoded(part: Column) -> Column:
        digits = F.substring(part, 3, 9)
        number = F.when(part.rlike("^&#[xX]"), F.conv(F.regexp_extract(part, "[0-9a-fA-F]+", 0), 16, 10)).when(
            part.startswith("&#"), F.regexp_extract(digits, "[0-9]+", 0)).cast("long")
        valid = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
        char = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).when(
            number.isNotNull(), F.lit("�"))
        return F.when(~part.startswith("&"), part).otherwise(F.coalesce(F.try_element_at(named, part), char, part))

    parts = F.regexp_extract_all(text, F.lit(_ENTITY), F.lit(0))
    return F.when(text.contains("&"), F.array_join(F.transform(parts, decoded), "")).otherwise(text)


def visible(html: Column) -> Column:
    """Markup with comments, scripts, styles and templates cut down to an empty tag.

    The other pattern functions read a column holding this.
    """
    return F.regexp_replace(html, _UNSEEN, "<!>")


def pattern_title(markup: Column) -> Column:
    text = F.regexp_extract(markup, _TITLE, 1)
    return strip(decode_entities(F.when(~text.contains("<"), text).otherwise(F.lit(""))))


def text_nodes(fragment: Column) -> Column:
    parts = F.transform(F.split(fragment, _TAG), lambda part: strip(decode_entities(part)))
    return F.filter(parts, lambda part: part != "")


def pattern_h1(markup: Column) -> Column:
    found = F.regexp_extract_all(markup, F.lit(_H1), F.lit(1))
    return F.array_join(F.transform(found, lambda inner: F.array_join(text_nodes(inner), "")), " | ")


def pattern_body(markup: Column, limit: int | None = BODY_LIMIT) -> Column:
    body = F.regexp_replace(F.regexp_extract(markup, _BODY, 1), _BODY_END, "")
    text = F.array_join(text_nodes(body), " ")
    return text if limit is None else F.substring(text, 1, limit)


def meta_tags(markup: Column) -> Column:
    return F.regexp_extract_all(markup, F.lit(_META), F.lit(0))


def pattern_description(tags: Column) -> Column:
    """``description`` by name, then by property; when empty, the same for ``og:description``.

    ``tags`` is a column holding ``meta_tags``; it is read several times.
    """
    def content(key: str, value: str) -> Column:
        wanted = rf"(?is)\s{key}\s*=\s*[\"']?{value}[\"'\s/>]"
        first = F.get(F.filter(tags, lambda tag: tag.rlike(wanted)), 0)
        return F.when(first.isNotNull(), F.coalesce(attribute(first, "content"), F.lit("")))

    def named(value: str) -> Column:
        return strip(F.coalesce(content("name", value), content("property", value), F.lit("")))

    return F.coalesce(F.nullif(named("description"), F.lit("")), named("og:description"))


def pattern_hrefs(markup: Column) -> Column:
    found = F.regexp_extract_all(markup, F.lit(_LINK), F.lit(0))
    return F.array_compact(F.transform(found, lambda tag: attribute(tag, "href")))


def decode_terminated(text: str) -> str:
    """Decode references that end in a semicolon; others stay, as in ``decode_entities``."""
    def char(found: re.Match) -> str:
        reference = found[0]
        return unescape(reference) if reference[1] == "#" else html5.get(reference[1:], reference)

    return _TERMINATED.sub(char, text)


class PageText(HTMLParser):
    """Collects the stored fields of one page while the standard parser walks it.

    With ``terminated_heads`` a reference without its semicolon stays as it is in title and headings.
    """

    _SILENT = {"script", "style", "template"}

    def __init__(self, terminated_heads: bool = False):
        super().__init__(convert_charrefs=True)
        self.terminated_heads = terminated_heads
        self._source, self._lines, self._from = "", [0], 0
        self.title, self.titles = None, 0
        self.headings: list[str] = []
        self.body: list[str] = []
        self.meta: dict[tuple[str, str], str] = {}
        self.blocks: list[str] = []
        self.itemprops: dict[str, str] = {}
        self.links: list[str] = []
        self._open: list[str] = []
        self._prop: tuple[str, str] | None = None
        self._in_body = False
        self._data: list[str] = []

    def feed(self, data):
        """The page as a whole: places in it are told from its start."""
        self._source = data
        if self.terminated_heads:
            self._lines += [found.end() for found in re.finditer("\n", data)]
        super().feed(data)

    def _place(self) -> int:
        line, offset = self.getpos()
        return self._lines[line - 1] + offset

    def handle_starttag(self, tag, attrs):
        self._flush()
        found = dict(attrs)
        if tag == "body":
            self._in_body = True
        elif tag == "meta":
            for attribute in ("name", "property"):
                key = (attribute, found.get(attribute) or "")
                self.meta.setdefault(key, (found.get("content") or "").strip())
        elif tag == "a" and "href" in found:
            self.links.append(found["href"] or "")
        elif tag == "h1":
            self.headings.append("")
        elif tag == "title":
            self.titles += 1
        elif "title" in self._open and self.titles == 1:
            self.title = ""
        if tag == "script" and found.get("type") == "application/ld+json":
            self.blocks.append("")
            tag = "ld+json"
        prop = found.get("itemprop")
        if prop and prop not in self.itemprops:
            self.itemprops[prop] = found.get("content") or ""
            if not self.itemprops[prop] and tag not in ("meta", "link"):
                self._prop = (prop, tag)
        if tag in self._SILENT or tag in ("ld+json", "title", "h1"):
            self._open.append(tag)

    def handle_endtag(self, tag):
        self._flush()
        if self._open and (self._open[-1] == tag or (tag, self._open[-1]) == ("script", "ld+json")):
            self._open.pop()
        if self._prop and self._prop[1] == tag:
            self._prop = None
        if tag == "body":
            self._in_body = False

    def handle_comment(self, data):
        self._flush()

    def handle_data(self, data):
        if self.terminated_heads and not self._data:
            self._from = self._place()
        self._data.append(data)

    def _flush(self):
        text, self._data = "".join(self._data), []
        inside = self._open[-1] if self._open else ""
        if inside == "ld+json":
            self.blocks[-1] += text
        if inside in self._SILENT or inside == "ld+json":
            return
        clean = head = text.strip()
        if self.terminated_heads and clean and (inside == "title" or "h1" in self._open):
            head = decode_terminated(self._source[self._from:self._place()]).strip()
        if inside == "title" and self.titles == 1 and self.title is None:
            self.title = head
        if "h1" in self._open and self.headings:
            self.headings[-1] += head
        if self._prop:
            self.itemprops[self._prop[0]] += clean
        if clean and self._in_body and inside != "title":
            self.body.append(clean)

    def close(self):
        super().close()
        self._flush()

    def description(self) -> str:
        for value in ("description", "og:description"):
            for attribute in ("name", "property"):
                if (attribute, value) in self.meta:
                    if self.meta[attribute, value]:
                        return self.meta[attribute, value]
                    break
        return ""


def parse_page(html: str, limit: int = BODY_LIMIT, terminated_heads: bool = False) -> PageText:
    page = PageText(terminated_heads)
    page.feed(_CUT_TAG.sub("", html))   # html cut off inside a tag: the rest is not text
    page.close()
    page.body_text = " ".join(page.body)[:limit]
    return page


def _filled(value):
    """A JSON value without empty members: product fields treat them as absent."""
    if isinstance(value, dict):
        return {key: _filled(item) for key, item in value.items() if item}
    return [_filled(item) for item in value] if isinstance(value, list) else value


def json_blocks(page: PageText) -> list[str]:
    """JSON-LD objects of a page; lists are flattened, anything else is dropped."""
    objects = []
    for block in page.blocks:
        try:
            data = json.loads(block)
        except ValueError:
            continue
        for item in data if isinstance(data, list) else [data]:
            if isinstance(item, dict):
                objects.append(json.dumps(_filled(item), ensure_ascii=False))
    return objects
