import pytest
from pyspark.sql import functions as F

from waypost.operators.links import reachable
from waypost.plans.discover import discover_urls, merge_seeds
from waypost.sources.robots import discover_sitemaps, robots_filter, robots_rules
from waypost.sources.sitemaps import expand_sitemaps, sitemap_locations

NS = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'


def robots(spark, text, origin="https://a.com"):
    return spark.createDataFrame([(origin, text)], "origin string, robots_txt string")


def index(*children):
    locs = "".join(f"<sitemap><loc>{c}</loc></sitemap>" for c in children)
    return f"<sitemapindex {NS}>{locs}</sitemapindex>"


def leaf(*urls):
    return f"<urlset {NS}>" + "".join(f"<url><loc> {u} </loc></url>" for u in urls) + "</urlset>"


@pytest.mark.parametrize("text, rules", [
    ("User-agent: *\nDisallow: /a\nDisallow: /\nDisallow:\n", ["/a"]),
    ("User-agent: x\nDisallow: /x\nUser-agent: *\r\n disallow:/b \nUSER-AGENT: y\nDisallow: /y", ["/b"]),
    ("Disallow: /early\nUser-agent: *\nAllow: /z\nDisallow: /a:b\rDisallow: /c", ["/a:b", "/c"]),
    ("User-agent: *\nUser-agent: bot\nDisallow: /bot", []),
    ("User-agent: * \n\nDisallow: /1\n\nUser-agent: *\nDisallow: /2", ["/1", "/2"]),
    ("", []), (None, []),
])
def test_robots_rules(spark, text, rules):
    assert robots_rules(robots(spark, text)).first().rules == rules


def test_robots_filter_is_per_origin(spark):
    rules = robots(spark, "User-agent: *\nDisallow: /Private").unionByName(
        robots(spark, "User-agent: *\nDisallow: /b", "https://b.com"))
    urls = spark.createDataFrame([("https://a.com/Private/x",), ("https://a.com/private",),
                                  ("https://a.com/b",), ("https://b.com/b?x",), ("https://c.com/b",)],
                                 "url string")
    assert sorted(r.url for r in robots_filter(urls, rules).collect()) == [
        "https://a.com/b", "https://a.com/private", "https://c.com/b"]


def test_sitemap_discovery(spark):
    df = robots(spark, "x\nsitemap:  https://a.com/1.xml \nSitemap: https://a.com/2.xml").unionByName(
        robots(spark, None, "https://b.com"))
    assert sorted(r.sitemap_url for r in discover_sitemaps(df).collect()) == [
        "https://a.com/1.xml", "https://a.com/2.xml", "https://b.com/sitemap.xml"]


def test_sitemaps_follow_indexes_and_end_on_cycles(spark):
    docs = spark.createDataFrame([
        ("root", index("one", "two", "root", "gone")), ("one", leaf("u1", "u2")),
        ("two", index("three")), ("three", leaf("u2", "u3")), ("bad", "<urlset><url>"),
        ("plain", "<urlset><url><loc>u9</loc></url></urlset>"), ("apart", leaf("u8")), ("none", None),
    ], "sitemap_url string, xml string")
    roots = spark.createDataFrame([("root",), ("bad",), ("plain",), ("none",)], "sitemap_url string")
    assert sorted(r.url for r in expand_sitemaps(roots, docs).collect()) == ["u1", "u2", "u3"]
    assert sitemap_locations(docs.where("sitemap_url in ('bad', 'plain', 'none')")).count() == 0


def graph(spark, n=60):
    edges = [(f"{i}", f"{(i * 7 + 3) % n}") for i in range(n)] + [
        (f"{i}", f"{(i * 11 + 5) % n}") for i in range(n)] + [(f"{i}", "0") for i in range(n)]
    return spark.createDataFrame(edges, "src_url string, dst_url string"), edges


def walk(seeds, edges, max_depth):
    depth = {s: 0 for s in seeds}
    level = set(seeds)
    for d in range(1, max_depth + 1):
        level = {b for a, b in edges if a in level} - depth.keys()
        depth.update({u: d for u in level})
    return depth


def test_reachable_depths(spark):
    df, edges = graph(spark)
    seeds = spark.createDataFrame([("1",), ("2",), ("1",)], "url string")
    got = {r.url: r.depth for r in reachable(seeds, df, max_depth=3).collect()}
    assert got == walk({"1", "2"}, edges, 3)
    capped = reachable(seeds, df, max_depth=5, max_pages=9).collect()
    want = sorted((d, u) for u, d in walk({"1", "2"}, edges, 5).items())[:9]
    assert sorted((r.depth, r.url) for r in capped) == want


def test_discovery_with_every_source(spark):
    seeds = spark.createDataFrame([("https://a.com/s", 0)], "url string, ord long")
    rules = robots(spark, "Sitemap: map\nUser-agent: *\nDisallow: /no")
    maps = spark.createDataFrame([("map", leaf("https://a.com/m", "https://a.com/no/m"))],
                                 "sitemap_url string, xml string")
    edges = spark.createDataFrame([("https://a.com/m", "https://a.com/l"),
                                   ("https://a.com/l", "https://a.com/no/x"),
                                   ("https://a.com/l", "https://a.com/l2")],
                                  "src_url string, dst_url string")
    got = {r.url: r.depth for r in discover_urls(seeds, edges, robots=rules, sitemaps=maps).collect()}
    assert got == {"https://a.com/s": 0, "https://a.com/m": 0, "https://a.com/l": 1, "https://a.com/l2": 2}
    listed = discover_urls(seeds, edges, robots=rules, sitemaps=maps, follow_links=False, max_pages=1)
    assert [r.url for r in listed.collect()] == ["https://a.com/s"]


def test_seeds_come_before_sitemap_urls(spark):
    seeds = spark.createDataFrame([("a", 5), ("b", 1), ("a", 2)], "url string, ord long")
    more = spark.createDataFrame([("b",), ("c",)], "url string")
    got = [r.url for r in merge_seeds(seeds, more).orderBy("ord").collect()]
    assert got == ["b", "a", "c"]


def test_robots_hosts_in_any_case_and_many_rules(spark):
    many = "User-agent: *\n" + "\n".join(f"Disallow: /r{k}/" for k in range(5000)) + "\nDisallow: /private"
    rules = robots(spark, many, "https://www.Shop.example")
    rows = [(k, url) for k, url in enumerate((
        "https://WWW.Shop.example/private/x", "HTTPS://www.shop.example/Private", "https://www.shop.example/r4999/a",
        "https://www.shop.example/r5000/a", "https://www.shop.example", "https://other.example/private", None,
        "https://www.shop.example/r7/b", "https://www.shop.example/r7/b"))]
    left = robots_filter(spark.createDataFrame(rows, "page_id long, url string"), rules)
    assert sorted(r.page_id for r in left.collect()) == [1, 3, 4, 5, 6]
    assert left.columns == ["page_id", "url"]
    assert robots_filter(spark.createDataFrame(rows, "page_id long, url string"), rules.limit(0)).count() == 9
