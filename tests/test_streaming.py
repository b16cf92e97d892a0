import pytest
from pyspark.sql import functions as F

from checks.queries import QUERIES
from waypost.operators.extract import extract_pages
from waypost.plans.match import build_target_index, match_sites
from waypost.plans.migration import run_migration
from waypost.streaming.incremental import page_intake, redirect_stream

RAW = "page_id long, url string, html string"


def html(title):
    return f"<html><head><title>{title}</title></head><body><h1>{title}</h1><p>du texte {title}</p></body></html>"


def raw(spark, host, n, start=0):
    rows = [(start + i, f"https://{host}/cat-{i % 3}/page-{i}", html(f"sujet {i % 7} rare{i}"))
            for i in range(n)]
    return spark.createDataFrame(rows, RAW)


def drain(writer, checkpoint):
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def test_intake_skips_stored_pages_and_equals_batch(spark, tmp_path):
    inbox, table = f"{tmp_path}/in", f"{tmp_path}/pages"
    raw(spark, "o.com", 12).write.parquet(inbox)
    stream = spark.readStream.schema(RAW).parquet(inbox)
    drain(page_intake(stream, "source", table), f"{tmp_path}/cp")
    # New files: the same addresses again under new ids, and five new ones.
    raw(spark, "o.com", 17, start=100).write.mode("append").parquet(inbox)
    drain(page_intake(stream, "source", table), f"{tmp_path}/cp")
    # A lost checkpoint reads every file again and adds nothing.
    drain(page_intake(stream, "source", table), f"{tmp_path}/cp2")
    got = spark.read.parquet(table)
    assert sorted(r.page_id for r in got.collect()) == [*range(12), *range(112, 117)]
    batch = extract_pages(raw(spark, "o.com", 12), "source")
    stored = got.where("page_id < 100").select(*batch.columns)
    assert sorted(stored.collect()) == sorted(batch.collect())


def test_redirect_stream_equals_batch(spark, tmp_path):
    source = extract_pages(raw(spark, "o.com", 10), "source", mode="pattern")
    target = extract_pages(raw(spark, "n.com", 8, start=500), "target", mode="pattern").withColumn(
        "url", F.concat("url", F.lit("-x")))
    build_target_index(target).save(f"{tmp_path}/index")
    source.repartition(2).write.option("maxRecordsPerFile", 3).parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    drain(redirect_stream(stream, f"{tmp_path}/index", f"{tmp_path}/plan"), f"{tmp_path}/cp")
    got = spark.read.parquet(f"{tmp_path}/plan").drop("batch")
    assert sorted(got.collect()) == sorted(match_sites(source, target).collect())


def test_whole_migration(spark, tmp_path):
    old, new = raw(spark, "o.com", 9), raw(spark, "n.com", 7, start=50)
    plan = run_migration(old, new, str(tmp_path), formats=("csv", "htaccess", "nginx", "json"),
                         source_domain="https://o.com", target_domain="https://n.com",
                         generated_at="2026-01-01T00:00:00", classify={"n_clusters": 2})
    kinds = {r.source_page_id: r.match_type for r in plan.collect()}
    assert len(kinds) == 9 and sum(kind == "exact" for kind in kinds.values()) == 7
    assert spark.read.parquet(f"{tmp_path}/classifications").count() == 16
    assert spark.read.text(f"{tmp_path}/htaccess").where("value like 'RewriteRule%'").count() == 9


@pytest.mark.parametrize("parts", [1, 3])
def test_stream_queries_read_a_file_and_a_folder(spark, tmp_path, parts):
    # One address of the new site has a second page.
    new = raw(spark, "n.com", 12, start=100)
    pages = raw(spark, "o.com", 20).unionByName(new).unionByName(new.limit(1).withColumn(
        "page_id", F.lit(500).cast("long"))).withColumn(
        "url", F.when(F.col("page_id") < 100, F.replace("url", F.lit("https:"), F.lit("http:"))).otherwise(F.col("url")))
    folder = f"{tmp_path}/pages.parquet"
    if parts > 1:
        pages.repartition(parts).write.parquet(folder)
    else:
        pages.toPandas().to_parquet(folder)
    raw(spark, "other.com", 3, start=200).write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["stream_intake"](spark, str(tmp_path)).count() == 33
    kinds = QUERIES["stream_match"](spark, str(tmp_path)).groupBy("match_type").count().collect()
    assert sum(row["count"] for row in kinds) == 20 and dict(kinds)["exact"] == 12
