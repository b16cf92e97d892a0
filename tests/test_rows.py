import pytest
from pyspark.sql import functions as F

from waypost.operators import rows
from waypost.plans.stats import content_duplicates, intent_summary, needs_classification
from waypost.sources.url_lists import read_url_list


def pages(spark, *data):
    return spark.createDataFrame(list(data), "page_id long, url string, site string")


def test_dedupe_and_insert(spark):
    df = pages(spark, (3, "u", "source"), (1, "u", "source"), (2, "u", "target"), (4, "v", "source"))
    assert sorted(r.page_id for r in rows.dedupe_pages(df).collect()) == [1, 2, 4]
    stored = pages(spark, (0, "u", "source"))
    assert sorted(r.page_id for r in rows.insert_or_ignore(stored, df).collect()) == [2, 4]


def test_first_per_site_with_one_huge_site(spark):
    df = spark.range(5_000).select(
        F.col("id").alias("page_id"), F.lit("u").alias("url"),
        F.when(F.col("id") % 10 == 0, "small").otherwise("big").alias("site"))
    got = rows.first_per_site(df, 70, F.desc("page_id")).groupBy("site").agg(
        F.count("*").alias("n"), F.min("page_id").alias("low")).collect()
    assert {r.site: (r.n, r.low) for r in got} == {"big": (70, 4923), "small": (70, 4300)}


def test_upsert(spark):
    schema = "page_id long, cluster_label int, intention string"
    old = spark.createDataFrame([(1, 0, "a"), (2, 0, "a")], schema)
    new = spark.createDataFrame([(2, 1, "b"), (3, 1, "b")], schema)
    got = rows.upsert_classifications(old, new).collect()
    assert sorted((r.page_id, r.intention) for r in got) == [(1, "a"), (2, "b"), (3, "b")]


def test_small_stats(spark):
    df = spark.createDataFrame([(1, "s", "h"), (2, "s", "h"), (3, "t", "h")],
                               "page_id long, site string, content_hash string")
    assert [tuple(r) for r in content_duplicates(df).collect()] == [("s", "h", 2, 1)]
    labels = spark.createDataFrame([(1, "b"), (2, "a"), (3, "a")], "page_id long, intention string")
    assert [tuple(r) for r in intent_summary(labels).collect()] == [("a", 2), ("b", 1)]
    assert needs_classification(df, labels.limit(1)) and not needs_classification(df, labels.limit(2))


@pytest.mark.parametrize("text, want", [
    ("name,Address\nx,https://a.com/1\ny,\nz,NA\nw,\"https://a.com/2,3\"\n",
     ["https://a.com/1", "https://a.com/2,3"]),
    ("URL,url\nupper,lower\n", ["lower"]),
    ("first,second\nf1,s1\n", ["f1"]),
])
def test_csv_lists(spark, tmp_path, text, want):
    path = tmp_path / "list.CSV"
    path.write_text(text, encoding="utf-8")
    assert [r.url for r in read_url_list(spark, str(path)).collect()] == want


def test_text_lists(spark, tmp_path):
    path = tmp_path / "list.txt"
    path.write_text(" https://a.com/1 \n\n\thttps://a.com/é\r\n", encoding="utf-8")
    assert [r.url for r in read_url_list(spark, str(path)).collect()] == [
        "https://a.com/1", "https://a.com/é"]


def test_repeated_rows_are_folded(spark):
    df = spark.createDataFrame(
        [(1, "u", "s", "a"), (1, "u", "s", "a"), (1, "u", "s", "b"), (2, "u", "s", "c"), (1, "v", "s", "d")],
        "page_id long, url string, site string, title string")
    got = sorted((r.page_id, r.url) for r in rows.dedupe_pages(df).collect())
    assert got == [(1, "u"), (1, "v")]
    stored = spark.createDataFrame([(1, 0, "x"), (3, 0, "y")], "page_id long, cluster_label int, intention string")
    new = spark.createDataFrame([(1, 1, "p"), (1, 2, "q")], "page_id long, cluster_label int, intention string")
    assert sorted(map(tuple, rows.upsert_classifications(stored, new).collect())) == [(1, 2, "q"), (3, 0, "y")]
