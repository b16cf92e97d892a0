"""Inputs of the registered queries, each derived from a whole driver table.

Two sites come from ``pages``: the http addresses are the old site, the https ones the new
site. A shop catalogue comes from ``part``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from waypost.functions.scoring import INTENT_LABELS
from waypost.functions.urls import origin
from waypost.operators.extract import extract_pages

CONTENT_TYPES = ("text/html; charset=utf-8", "application/pdf")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def site_column() -> Column:
    return F.when(F.col("url").startswith("https:"), F.lit("target")).otherwise(F.lit("source"))


def site_pages(spark: SparkSession, sf_dir: str, mode: str = "pattern") -> DataFrame:
    # Titles and headings as the SQL reads them: an entity ends in a semicolon.
    return extract_pages(read(spark, sf_dir, "pages"), site_column(), mode=mode, terminated_heads=True)


def head_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site pages with the columns matching needs; the unused body is never extracted."""
    return site_pages(spark, sf_dir).select("page_id", "url", "site", "title", "h1", "description")


def two_sites(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    return pages.where("site = 'source'"), pages.where("site = 'target'")


def label_at(number: Column) -> Column:
    """An intent label for a number; every sixth is missing."""
    labels = F.array(*[F.lit(label) for label in (*INTENT_LABELS, "")])
    return F.get(labels, F.pmod(number, F.lit(6)).cast("int"))


def page_intents(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", label_at(F.length("url")).alias("intention"))


def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of one site each by language; exact copies share their address."""
    text = F.col("text")
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("page_id"),
        F.concat(F.lit("https://docs.example/"), F.col("lang"), F.lit("/"), F.md5("text")).alias("url"),
        F.col("lang").alias("site"), F.col("source").alias("title"), F.lit("").alias("h1"),
        F.lit("").alias("description"), text.alias("body_text"), F.md5("text").alias("content_hash"),
    )


def _shop_path() -> Column:
    brand = F.replace(F.lower("p_brand"), F.lit("#"), F.lit("-"))
    name = F.replace(F.lower("p_name"), F.lit(" "), F.lit("-"))
    return F.concat_ws("/", F.lit("/Shop"), F.col("p_type"), brand,
                       F.concat(name, F.lit("-"), F.col("p_partkey").cast("string")))


def catalogue(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Old and new shop. The new one keeps small parts, some brand pages, some type pages and
    a shop page for one branch, so every level of the waterfall has matches."""
    part = read(spark, sf_dir, "part").withColumn("shop_path", _shop_path())
    key = F.col("p_partkey")
    source = part.select(
        (key * 2).alias("page_id"),
        F.concat(F.when(F.col("p_size") > 45, F.lit("https://old.example/Archive"))
                 .otherwise(F.lit("https://old.example")), F.col("shop_path"),
                 F.lit("?ref=list")).alias("url"),
        label_at(F.col("p_size")).alias("intention"),
    )
    folder = F.lower(F.regexp_extract("shop_path", "^(.*)/[^/]*$", 1))
    shelf = F.regexp_extract(folder, "^(.*)/[^/]*$", 1)

    def pages(rows: DataFrame, path: Column, offset: int) -> DataFrame:
        return rows.groupBy(F.concat(F.lit("https://new.example"), path, F.lit("/")).alias("url")).agg(
            (F.min("p_partkey") * 2 + offset).alias("page_id"),
            label_at(F.min("p_size")).alias("intention"))

    target = pages(part.where("p_size <= 10"), F.lower("shop_path"), 1)
    target = target.unionByName(
        pages(part.where("p_brand < 'Brand#2'"), folder, 100_000_001))
    target = target.unionByName(pages(part.where("p_type < 'M'"), shelf, 200_000_001))
    target = target.unionByName(pages(part.where("p_type < 'M'"), F.lit(""), 300_000_001))
    target = target.unionByName(pages(part.where("p_size > 45"), F.lit("/archive/shop"), 400_000_001))
    blank = F.lit("")
    return (source.withColumns({"title": blank, "h1": blank, "description": blank}),
            target.withColumns({"title": blank, "h1": blank, "description": blank}))


def robots_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One robots.txt per origin of ``pages``, with rules taken from its own addresses."""
    url = F.col("url")
    return read(spark, sf_dir, "pages").groupBy(origin(F.lower(url)).alias("origin")).agg(
        F.min(F.lower(url)).alias("first"), F.max(F.lower(url)).alias("last"),
        F.count(F.lit(1)).alias("n"),
    ).select("origin", F.concat(
        F.lit("User-agent: crawler\nDisallow: "), F.regexp_extract("last", "//[^/]*(/[^/?#]*)", 1),
        F.lit("\n\nUser-Agent: *\nDisallow:\nDisallow: /\n  disallow: "),
        F.regexp_extract("first", "//[^/]*(/[^?#]*)", 1),
        F.when(F.col("n") > 1, F.concat(F.lit("\nAllow: /\nSitemap: "), F.col("origin"),
                                        F.lit("/map-"), F.col("n").cast("string"), F.lit(".xml ")))
        .otherwise(F.lit("")),
        F.lit("\nUser-agent: other\nDisallow: /en"),
    ).alias("robots_txt"))


def sitemap_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sitemap per page below two levels of indexes, each listing at most 50 documents, and
    a malformed document per origin."""
    ns = ' xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'

    def name(level: str, number: Column) -> Column:
        return F.concat(F.lit(f"map:{level}-"), number.cast("string"))

    key = F.col("page_id")
    pages = read(spark, sf_dir, "pages").select(
        F.replace("url", F.lit("&"), F.lit("&amp;")).alias("url"), origin(F.col("url")).alias("origin"),
        name("page", key).alias("leaf"), name("low", F.floor(key / 50)).alias("low"),
        name("high", F.floor(key / 2_500)).alias("high"))
    leaf = pages.select(F.col("leaf").alias("sitemap_url"), F.concat(
        F.lit(f"<urlset{ns}><url><loc> "), "url", F.lit(" </loc></url></urlset>")).alias("xml"))

    def index(parent: str, child: str) -> DataFrame:
        locs = F.concat(F.lit("<sitemap><loc>"), F.col(child), F.lit("</loc></sitemap>"))
        return pages.groupBy(F.col(parent).alias("sitemap_url")).agg(F.concat(
            F.lit(f"<sitemapindex{ns}>"), F.array_join(F.collect_set(locs), ""),
            F.lit("</sitemapindex>")).alias("xml"))

    broken = pages.select(F.concat(F.lit("map:broken-"), F.col("origin")).alias("sitemap_url")
                          ).distinct().withColumn("xml", F.lit("<urlset><url>"))
    return leaf.unionByName(index("low", "leaf")).unionByName(index("high", "low")).unionByName(broken)


def order_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A link graph: part pages link to their suppliers' pages and back."""
    lines = read(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("part/"), F.col("l_partkey").cast("string")).alias("part"),
        F.concat(F.lit("supplier/"), F.col("l_suppkey").cast("string")).alias("supplier"))
    return lines.select(F.col("part").alias("src_url"), F.col("supplier").alias("dst_url")).unionByName(
        lines.select(F.col("supplier").alias("src_url"), F.col("part").alias("dst_url")))


def product_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw product pages of every part, with JSON-LD and microdata."""
    key = F.col("p_partkey").cast("string")
    offer = F.struct(F.col("p_retailprice").cast("decimal(12,2)").cast("string").alias("price"),
                     F.lit("EUR").alias("priceCurrency"),
                     F.when(F.col("p_size") > 25, F.concat(F.lit("77"), key)).alias("gtin13"))
    product = F.to_json(F.struct(
        F.lit("Product").alias("@type"), F.col("p_name").alias("name"), key.alias("sku"),
        F.col("p_type").alias("category"),
        F.struct(F.lit("Brand").alias("@type"), F.col("p_brand").alias("name")).alias("brand"),
        F.when(F.col("p_size") > 40, F.concat(F.lit("55"), key)).alias("gtin8"),
        F.array(offer).alias("offers")))
    crumbs = F.to_json(F.struct(
        F.lit("BreadcrumbList").alias("@type"),
        F.array(
            F.struct(F.lit(2).alias("position"), F.col("p_name").alias("name"),
                     F.concat(F.lit("/p/"), key).alias("item")),
            F.struct(F.lit(1).alias("position"), F.col("p_brand").alias("name"),
                     F.concat(F.lit("/b/"), F.col("p_brand")).alias("item")),
        ).alias("itemListElement")))
    script = '<script type="application/ld+json">'
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("page_id"), F.concat(F.lit("https://shop.example/p/"), key).alias("url"),
        F.concat(
            F.lit(f"<html><head><title>x</title>{script}["), product, F.lit(', "text"]</script>'),
            F.lit(script), crumbs, F.lit(f"</script>{script}{{broken</script></head><body>"),
            F.lit('<meta itemprop="gtin" content="99'), key, F.lit('"></body></html>'),
        ).alias("html"))


def segment_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page per customer: the market segment among stop words and a number that no other page has."""
    blank = F.lit("")
    return read(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("long").alias("page_id"), F.col("c_mktsegment").alias("title"), blank.alias("h1"),
        blank.alias("description"), F.concat(F.lit("le "), F.col("c_mktsegment"), F.lit(" est dans la "),
                                             F.col("c_custkey").cast("string")).alias("body_text"))
