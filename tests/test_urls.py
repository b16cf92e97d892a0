import hashlib
from urllib.parse import urljoin, urlparse

from pyspark.sql import functions as F

from waypost.functions.urls import (
    ancestor_paths, build_page_index, level_one_path, parent_path, raw_path, resolve_link,
)

#: url, normalized_url, path, segments
INDEXED = [
    ("http://a.com/x y|z/", "http://a.com/x y|z", "/x y|z", ["x y|z"]),
    ("https://a.com", "https://a.com/", "/", []),
    ("a.com/p", "a.com/p", "a.com/p", ["a.com", "p"]),
    ("/b;c/d;e;f?x#y", "/b;c/d", "/b;c/d", ["b;c", "d"]),
    ("/Foo//Bar///", "/foo//bar", "/foo//bar", ["foo", "bar"]),
    ("HTTP://User@Host:80/A/B/?q=1#f", "http://user@host:80/a/b", "/a/b", ["a", "b"]),
    ("  https://a.com/é/Ü/  ", "https://a.com/é/ü", "/é/ü", ["é", "ü", "  "]),
    ("http://a.com/p;v=1;w=2", "http://a.com/p", "/p", ["p"]),
    ("http://a.com/a;b/c", "http://a.com/a;b/c", "/a;b/c", ["a;b", "c"]),
    ("//cdn.example/x/", "//cdn.example/x", "/x", ["x"]),
    ("mailto:x@y.z", "mailto:x@y.z", "x@y.z", ["x@y.z"]),
    ("http://a.com?x=/y", "http://a.com/", "/", []),
    ("", "/", "/", []),
    ("/", "/", "/", []),
    ("http://a.com/#/route", "http://a.com/", "/", []),
    ("ftp://a.com/x/y/z/", "ftp://a.com/x/y/z", "/x/y/z", ["x", "y", "z"]),
    ("http://a.com//x", "http://a.com//x", "//x", ["x"]),
    ("https://a.com/a%20b/", "https://a.com/a%20b", "/a%20b", ["a%20b"]),
    ("a.com:80/p/q", "a.com:80/p/q", "80/p/q", ["80", "p", "q"]),
    ("http://a.com/x\ty", "http://a.com/xy", "/xy", ["xy"]),
]
URLS = [row[0] for row in INDEXED]


def test_index_columns(spark):
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    found = build_page_index(df).orderBy("page_id").collect()
    for row, (url, normal, path, segments) in zip(found, INDEXED, strict=True):
        assert (row.url, row.normalized_url, row.path, row.segments) == (url, normal, path, segments)
        assert row.url_hash == hashlib.md5(path.encode()).hexdigest()


def test_path_is_idempotent(spark):
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    once = build_page_index(df).select("page_id", F.col("path").alias("url"))
    twice = build_page_index(once)
    # A path without a leading slash and with a colon would read as a scheme.
    rows = twice.where(F.col("url").startswith("/") & ~F.col("url").startswith("//")).collect()
    assert rows and all(row.path == row.url for row in rows)


def test_parents_and_ancestors(spark):
    df = spark.createDataFrame([(1, "/a/b/c/d/e"), (2, "/a"), (3, "/"), (4, "/a/b")],
                               "page_id long, url string")
    s = F.col("segments")
    rows = {r.page_id: r for r in build_page_index(df).select(
        "page_id", parent_path(s).alias("parent"), level_one_path(s).alias("top"),
        ancestor_paths(s).alias("up")).collect()}
    assert [(u.level, u.path) for u in rows[1].up] == [(1, "/a/b/c/d"), (2, "/a/b/c"), (3, "/a/b")]
    assert [(u.level, u.path) for u in rows[4].up] == [(1, "/a")]
    assert rows[2].up == [] and rows[3].up == []
    assert (rows[1].parent, rows[1].top) == ("/a/b/c/d", "/a")
    assert (rows[2].parent, rows[2].top) == (None, "/a")
    assert (rows[3].parent, rows[3].top) == (None, None)


def test_match_text_joins_fields_and_url_words(spark):
    df = spark.createDataFrame(
        [(1, "http://a.com/x-y_z/", " T ", None, "d")],
        "page_id long, url string, title string, h1 string, description string")
    assert build_page_index(df).first().match_text == "T  d http:  a.com x y z"


def test_links_resolve_like_the_standard_join(spark):
    bases = ["https://a.com/d/e/page?q=1", "https://a.com", "https://a.com/x/", "https://a.com/p;v/q"]
    hrefs = ["/a?x", "b/c#f", "../up", "../../../up", "https://b.com/Z;p", "//c.com/x", "mailto:x@y", "",
             "#t", "?q", "/r/../dots", "/r/./s/..", ".", "..", "./x/", "b//c/", "...", "/.well-known/x",
             "x/.hidden", "/a/b/../../../c"]
    df = spark.createDataFrame([(b, h) for b in bases for h in hrefs], "base string, href string")
    full = resolve_link(F.col("base"), F.col("href"))
    for row in df.select("*", full.alias("full"), raw_path(full).alias("path")).collect():
        want = urlparse(urljoin(row.base, row.href))
        if want.scheme not in ("http", "https"):
            assert row.full is None
            continue
        got = urlparse(row.full)
        assert (got.scheme, got.netloc) == (want.scheme, want.netloc), row
        assert (row.path or "/") == (want.path or "/"), row
