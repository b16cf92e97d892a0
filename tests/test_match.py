import pytest
from pyspark.sql import functions as F

from waypost.functions.urls import build_page_index
from waypost.operators.paths import match_exact, match_hierarchical, target_path_table
from waypost.plans.match import build_target_index, match_against, match_sites
from waypost.plans.stats import phase_counters, plan_stats, project_stats

DEEP = "https://old.com/fr/produits/robot-cuiseur/cook/"


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, title string")


def pages(spark, *urls, start=1, title=""):
    return frame(spark, [(start + i, url, title) for i, url in enumerate(urls)])


@pytest.mark.parametrize("targets, kind, score", [
    (["/fr/produits/robot-cuiseur", "/fr/produits", "/fr", "/"], "hierarchical_L1", 40.0),
    (["/fr/produits", "/fr", "/"], "hierarchical_L2", 25.0),
    (["/fr", "/"], "hierarchical_L3", 15.0),
    (["/", "/x"], "hierarchical_root", 5.0),
    (["/x"], "fallback", 0.0),
])
def test_nearest_ancestor_wins(spark, targets, kind, score):
    table = target_path_table(build_page_index(
        pages(spark, *[f"https://new.com{path}" for path in targets], start=10)))
    row = match_hierarchical(build_page_index(pages(spark, DEEP)), table, "/home").first()
    assert (row.match_type, row.score) == (kind, score)
    want = "/home" if kind == "fallback" else f"https://new.com{targets[0]}"
    assert row.target_url == want


def test_single_segment_never_tests_a_parent(spark):
    table = target_path_table(build_page_index(pages(spark, "https://n.com/a", start=10)))
    assert match_hierarchical(build_page_index(pages(spark, "/b")), table).first().match_type == "fallback"


def test_exact_takes_the_last_page_of_a_path(spark):
    table = target_path_table(build_page_index(
        frame(spark, [(11, "https://n.com/a/", ""), (12, "https://n.com/A?x", ""), (10, "/a", "")])))
    row = match_exact(build_page_index(pages(spark, "https://o.com/a#top")), table).first()
    assert (row.target_page_id, row.target_url, row.score) == (12, "https://n.com/A?x", 100.0)


def sites(spark):
    source = frame(spark, [
        (1, "https://o.com/same", ""), (2, "https://o.com/zz/one-thing-of-old", "grand robot cuiseur"),
        (3, "https://o.com/produits/lampe-12", "qqq"), (4, "https://o.com/cat/xxxxxxxxxxxxxxxxxxx/y", ""),
        (5, "https://o.com/!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!", ""),
        (6, "https://o.com/same?copy", "")])
    target = frame(spark, [
        (101, "https://n.com/same", "accueil"), (102, "https://n.com/r", "grand robot cuiseur"),
        (103, "https://n.com/produits/lampes-12", "aaa"), (104, "https://n.com/cat", "bbb"),
        (105, "https://n.com/other", "ccc")])
    return source, target


def test_waterfall_gives_one_redirect_per_source(spark):
    source, target = sites(spark)
    rows = {r.source_page_id: r for r in match_sites(
        source, target, cosine_threshold=0.95, fallback_url="https://n.com/other").collect()}
    assert len(rows) == 6
    kinds = {i: r.match_type for i, r in rows.items()}
    assert kinds[1] == kinds[6] == "exact"
    assert kinds[2] == "cosine" and rows[2].target_url == "https://n.com/r"
    assert kinds[3] == "fuzzy" and rows[3].target_url == "https://n.com/produits/lampes-12"
    assert kinds[5] == "fallback" and rows[5].target_url == "https://n.com/other"
    assert all(r.confidence == r.raw_confidence and not r.intent_mismatch for r in rows.values())


def test_intents_of_both_ends_and_of_the_fallback(spark):
    source, target = sites(spark)
    intents = spark.createDataFrame(
        [(1, "commerciale"), (101, "divers"), (5, "divers"), (105, "commerciale"),
         (3, "commerciale"), (103, "commerciale")], "page_id long, intention string")
    rows = {r.source_page_id: r for r in match_sites(
        source, target, intents, cosine_threshold=0.95, fallback_url="https://n.com/other").collect()}
    assert (rows[1].confidence, rows[1].intent_mismatch) == ("low", True)
    assert (rows[5].target_intention, rows[5].confidence) == ("commerciale", "low")
    assert rows[3].source_intention == rows[3].target_intention == "commerciale"
    assert rows[6].source_intention == "" and rows[6].confidence == "high"


def test_saved_index_gives_the_same_plan(spark, tmp_path):
    source, target = sites(spark)
    from waypost.plans.match import TargetIndex
    build_target_index(target).save(str(tmp_path / "index"))
    loaded = TargetIndex.load(spark, str(tmp_path / "index"))
    assert sorted(match_against(source, loaded).collect()) == sorted(match_sites(source, target).collect())


def test_empty_side_gives_an_empty_plan(spark):
    source, target = sites(spark)
    assert match_sites(source.limit(0), target).count() == 0
    empty = match_sites(source, target.limit(0))
    assert empty.count() == 0 and "intent_mismatch" in empty.columns


def test_status_filter_is_optional(spark):
    source, target = sites(spark)
    target = target.withColumn("status_code", F.when(F.col("page_id") == 101, 404).otherwise(200))
    source = source.withColumn("status_code", F.lit(200))
    every = match_sites(source, target, cosine_threshold=2.0, fuzzy_threshold=200)
    live = match_sites(source, target, cosine_threshold=2.0, fuzzy_threshold=200,
                       status_filter=F.col("status_code") < 400)
    assert every.where("match_type = 'exact'").count() == 2
    assert live.where("match_type = 'exact'").count() == 0


def test_counters_and_stats(spark):
    source, target = sites(spark)
    plan = match_sites(source, target, cosine_threshold=0.95)
    counts = {r.phase: r.cnt for r in phase_counters(plan).collect()}
    assert counts["exact"] == 2 and counts["intent_adjusted"] == 0 and len(counts) == 9
    assert sum(r.cnt for r in plan_stats(plan).collect()) == 6
    both = source.withColumn("site", F.lit("source")).unionByName(
        target.withColumn("site", F.lit("target")))
    row = project_stats(both, source.select("page_id"), plan).first()
    assert (row.source_pages, row.target_pages, row.classified, row.redirects) == (6, 5, 6, 6)
    assert row.high + row.medium + row.low == 6
