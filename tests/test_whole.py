"""Whole queries against brute force on a driver table."""

import os
from collections import Counter

import pytest

from checks import queries as q, tables as t, whole
from waypost.operators.extract import extract_links
from waypost.plans import stats
from waypost.session import hold
from waypost.sources import robots

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")


def walked(seeds, edges):
    after, found, level = {}, {url: 0 for url in seeds}, list(seeds)
    for a, b in edges:
        after.setdefault(a, []).append(b)
    while level:
        fresh = {b for a in level for b in after.get(a, ()) if b not in found}
        found |= {b: found[level[0]] + 1 for b in fresh}
        level = sorted(fresh)
    return found


def test_links_to_any_depth(spark):
    seeds = [f"supplier/{r.s_suppkey}" for r in t.read(spark, SF_DIR, "supplier").collect()]
    edges = [(r.src_url, r.dst_url) for r in t.order_links(spark, SF_DIR).collect()]
    got = {r.url: r.depth for r in whole.link_bfs_whole(spark, SF_DIR).collect()}
    assert got == walked(seeds, edges)
    assert len(got) > q.link_bfs(spark, SF_DIR).count()


def test_discovery_to_any_depth(spark):
    pages = t.read(spark, SF_DIR, "pages")
    rules = t.robots_documents(spark, SF_DIR)
    edges = extract_links(pages).select("src_url", "dst_url").distinct().collect()
    urls = spark.createDataFrame([(u,) for u in {r.dst_url for r in edges} | {
        r.url for r in pages.select("url").collect()}], "url string")
    free = {r.url for r in robots.robots_filter(urls, rules).collect()}
    want = walked({r.url for r in pages.select("url").collect()} & free,
                  [(r.src_url, r.dst_url) for r in edges if r.dst_url in free])
    assert {r.url: r.depth for r in whole.discover_urls_whole(spark, SF_DIR).collect()} == want


def test_plan_has_every_phase_and_reaches_the_statistics(spark):
    plan = hold(whole.whole_plan(spark, SF_DIR), "plan")
    kinds = Counter((r.match_type, r.confidence) for r in plan.collect())
    assert {"cosine", "fuzzy"} & {kind for kind, _ in kinds}
    assert {(r.match_type, r.confidence): r.cnt for r in stats.plan_stats(plan).select(
        "match_type", "confidence", "cnt").collect()} == kinds
    assert sum(kinds.values()) == q._shop_plan(spark, SF_DIR).count()
    assert whole.QUERIES["plan_csv_whole"](spark, SF_DIR).count() >= sum(kinds.values())
