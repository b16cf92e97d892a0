"""Page extraction: stored html to text fields, product data and the link graph."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from waypost.functions.html import (
    BODY_LIMIT, json_blocks, meta_tags, parse_page, pattern_body, pattern_description, pattern_h1,
    pattern_hrefs, pattern_title, visible,
)
from waypost.functions.urls import netloc, raw_path, resolve_link, scheme
from waypost.session import spread

# Identifier keys in the order they are tried.
_GTIN_KEYS = ("gtin13", "gtin8", "gtin14", "gtin12", "gtin")
_ITEMPROPS = ("gtin13", "gtin", "ean")


def admissible(content_type: Column, html: Column, allowed: tuple[str, ...] = ("text/html",),
               min_length: int = 0) -> Column:
    """Pages worth keeping: an allowed content type and, optionally, enough html."""
    typed = F.lit(False)
    for name in allowed:
        typed = typed | content_type.contains(name)
    return typed & (F.length(html) >= min_length)


def admitted(raw: DataFrame, allowed: tuple[str, ...] = ("text/html",), min_length: int = 0) -> DataFrame:
    """The admissible rows of ``raw`` by its ``content_type`` column; all rows without that column.

    Rows without html were not fetched: they have no type to judge and stay, as stubs. A fetched row
    of unknown type goes.
    """
    if "content_type" not in raw.columns:
        return raw
    kept = admissible(F.coalesce("content_type", F.lit("")), F.col("html"), allowed, min_length)
    return raw.where(F.col("html").isNull() | kept)


def _stub_title(url: Column) -> Column:
    """Last path part with spaces for dashes: the title of a page that was not fetched."""
    last = F.regexp_extract(F.rtrim(raw_path(url), F.lit("/")), r"([^/]*)$", 1)
    return F.replace(last, F.lit("-"), F.lit(" "))


def extract_pages(raw: DataFrame, site: str | Column, *, mode: str = "parser",
                  body_limit: int = BODY_LIMIT, terminated_heads: bool = False) -> DataFrame:
    """Page table from ``raw(page_id, url, html[, status_code, depth])``.

    ``mode="parser"`` walks the markup in Arrow batches; ``mode="pattern"`` uses built-in
    expressions only. Both are narrow: no shuffle. Rows without html become stubs that keep
    the URL, with status 0 and a title made from the last path part. The parser decodes references
    without a semicolon as browsers do (``&amp`` at the end of a cut text); ``terminated_heads`` leaves
    them in title and headings, so that both modes give a page the same ones.
    """
    if mode not in ("parser", "pattern"):
        raise ValueError(f"unknown mode: {mode}")
    site_col = F.lit(site) if isinstance(site, str) else site
    status = F.col("status_code") if "status_code" in raw.columns else F.lit(200)
    depth = F.col("depth") if "depth" in raw.columns else F.lit(0)
    base = raw.select("page_id", "url", "html", status.cast("int").alias("status_code"),
                      depth.cast("int").alias("depth"), site_col.alias("site"))
    if mode == "pattern":
        html = F.col("html")
        markup = F.col("_markup")
        staged = spread(base).withColumn("_markup", visible(html))
        fields = staged.withColumn("_tags", meta_tags(markup)).select(
            "page_id", "url", "site", "depth", "status_code", html.isNull().alias("stub"),
            pattern_title(markup).alias("title"),
            pattern_description(F.col("_tags")).alias("description"),
            pattern_h1(markup).alias("h1"), pattern_body(markup, body_limit).alias("body_text"))
    else:
        fields = _parsed(base, body_limit, terminated_heads)
    blank = F.lit("")

    def text(name: str) -> Column:
        return F.coalesce(F.when(~F.col("stub"), F.col(name)), blank).alias(name)

    result = fields.select(
        "page_id", "url", "site", "depth",
        F.when(F.col("stub"), F.lit(0)).otherwise(F.col("status_code")).alias("status_code"),
        F.when(F.col("stub"), _stub_title(F.col("url"))).otherwise(F.col("title")).alias("title"),
        text("description"), text("h1"), text("body_text"),
        *[name for name in ("json_ld", "itemprop") if name in fields.columns],
    ).withColumn("content_hash", F.md5("body_text"))
    return result


def _parsed(base: DataFrame, limit: int, terminated_heads: bool) -> DataFrame:
    """One Arrow pass over the html; the other columns travel with it, so no join follows."""
    schema = ("page_id long, url string, site string, depth int, status_code int, stub boolean, "
              "title string, description string, h1 string, body_text string, "
              "json_ld array<string>, itemprop string")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pages = [parse_page(html or "", limit, terminated_heads) for html in batch["html"]]
            yield pd.DataFrame({
                "page_id": batch["page_id"], "url": batch["url"], "site": batch["site"],
                "depth": batch["depth"], "status_code": batch["status_code"],
                "stub": batch["html"].isna(),
                "title": [page.title or "" for page in pages],
                "description": [page.description() for page in pages],
                "h1": [" | ".join(page.headings) for page in pages],
                "body_text": [page.body_text for page in pages],
                "json_ld": [json_blocks(page) for page in pages],
                "itemprop": [next((page.itemprops[name] for name in _ITEMPROPS
                                   if name in page.itemprops), None) for page in pages],
            })

    return spread(base).mapInPandas(parse, schema)


def _json(block: Column, path: str) -> Column:
    return F.get_json_object(block, path)


def _product_fields(block: Column) -> Column:
    brand = _json(block, "$.brand")
    brand_name = F.when(brand.startswith("{"), _json(block, "$.brand.name")).when(
        ~brand.startswith("["), brand)
    # Offers: an object, or the first element of a list.
    offers = _json(block, "$.offers")
    offer = F.when(offers.startswith("["), _json(block, "$.offers[0]")).when(
        offers.startswith("{"), offers)

    def first_key(source: Column, keys: tuple[str, ...]) -> Column:
        return F.coalesce(*[
            F.when(_json(source, f"$.{key}").isNotNull(),
                   F.struct(F.lit(key).alias("key"), _json(source, f"$.{key}").alias("value")))
            for key in keys])

    return F.struct(
        _json(block, "$.name").alias("product_name"),
        _json(block, "$.sku").alias("sku"),
        _json(block, "$.category").alias("product_type"),
        brand_name.alias("brand"),
        _json(offer, "$.price").alias("price"),
        _json(offer, "$.priceCurrency").alias("currency"),
        _json(offer, "$.availability").alias("availability"),
        first_key(block, (*_GTIN_KEYS, "isbn")).alias("own"),
        first_key(offer, _GTIN_KEYS).alias("offered"),
    )


def _breadcrumb(block: Column) -> Column:
    raw_items = F.from_json(_json(block, "$.itemListElement"), "array<string>")
    items = F.filter(raw_items, lambda item: item.startswith("{"))

    def entry(item: Column, at: Column) -> Column:
        target = _json(item, "$.item")
        url = F.when(target.startswith("{"), F.coalesce(
            F.nullif(_json(item, "$.item['@id']"), F.lit("")), _json(item, "$.item.url"))
        ).otherwise(target)
        position = F.coalesce(F.try_to_number(_json(item, "$.position"), F.lit("999999999.999"))
                              .cast("double"), F.lit(0.0))
        return F.struct(position.alias("position"), at.alias("at"),
                        F.coalesce(_json(item, "$.name"), F.lit("")).alias("name"),
                        F.coalesce(url, F.lit("")).alias("url"))

    ordered = F.array_sort(F.transform(items, entry))
    return F.transform(ordered, lambda e: F.struct(e["name"].alias("name"), e["url"].alias("url")))


def with_structured_data(pages: DataFrame) -> DataFrame:
    """``pages`` with the column ``structured_data`` in place of ``json_ld`` and ``itemprop``.

    A page's blocks are folded inside its own row: the last non-empty value of a field wins,
    an offer's identifier counts only while there is none, and microdata fills in last.
    """
    def of_type(name: str) -> Column:
        return F.filter("json_ld", lambda block: _json(block, "$['@type']") == name)

    staged = pages.withColumns({
        "_products": F.transform(of_type("Product"), _product_fields),
        "_crumbs": F.get(F.reverse(of_type("BreadcrumbList")), 0),
    })

    def last(name: str) -> Column:
        values = F.transform(F.col("_products"), lambda p: p[name])
        return F.get(F.reverse(F.array_compact(values)), 0)

    codes = F.aggregate(
        "_products", F.struct(F.lit(None).cast("string").alias("gtin"),
                              F.lit(None).cast("string").alias("ean")),
        lambda acc, p: _fold_code(acc, p))
    staged = staged.withColumn("_codes", codes)
    fallback = F.when(F.col("_codes.ean").isNull(), F.col("itemprop"))
    return staged.withColumn("structured_data", F.struct(
        F.coalesce(fallback, F.col("_codes.ean")).alias("ean"),
        F.coalesce(fallback, F.col("_codes.gtin")).alias("gtin"),
        last("sku").alias("sku"), last("price").alias("price"),
        last("currency").alias("currency"), last("brand").alias("brand"),
        last("availability").alias("availability"),
        F.coalesce(_breadcrumb(F.col("_crumbs")),
                   F.array().cast("array<struct<name:string,url:string>>")).alias("breadcrumb"),
        last("product_name").alias("product_name"), last("product_type").alias("product_type"),
    )).drop("json_ld", "itemprop", "_products", "_crumbs", "_codes")


def extract_products(pages: DataFrame) -> DataFrame:
    """``(page_id, structured_data)`` from the ``json_ld`` and ``itemprop`` columns."""
    return with_structured_data(pages.select("page_id", "json_ld", "itemprop"))


def _fold_code(acc: Column, product: Column) -> Column:
    own, offered = product["own"], product["offered"]
    hit = F.coalesce(own, F.when(acc["gtin"].isNull(), offered))
    return F.struct(
        F.coalesce(hit["value"], acc["gtin"]).alias("gtin"),
        F.when(hit["key"] == "gtin13", hit["value"]).otherwise(acc["ean"]).alias("ean"))


def extract_links(raw: DataFrame) -> DataFrame:
    """``(src_url, dst_url)``: links of a page to its own host, without query or fragment.

    One pass of built-in expressions over the html; links never visit Python.
    """
    hrefs = spread(raw.select("url", "html")).select(
        "url", F.explode_outer(pattern_hrefs(visible(F.col("html")))).alias("href"))
    href = F.translate(F.trim("href"), "\t\r\n", "")
    full = F.col("full")
    return hrefs.where(F.col("href").isNotNull()).select(
        "url", resolve_link(F.col("url"), href).alias("full")
    ).where(full.isNotNull()).select(
        F.col("url").alias("src_url"), F.lower(scheme(full)).alias("head"),
        netloc(full).alias("host"), netloc(F.col("url")).alias("own"), raw_path(full).alias("path"),
    ).where(F.col("head").isin("http", "https") & (F.col("host") == F.col("own"))).select(
        "src_url", F.concat("head", F.lit("://"), "host", "path").alias("dst_url"))
