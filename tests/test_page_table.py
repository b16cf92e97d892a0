import json

from pyspark.sql import functions as F

from waypost.operators.extract import admitted
from waypost.plans.page_table import insert_pages, page_table, read_pages
from waypost.streaming.incremental import page_intake

RAW = "page_id long, url string, html string, content_type string"


def raw(spark, *rows):
    return spark.createDataFrame([(i, u, h, c) for i, u, h, c in rows], RAW)


def html(title, extra=""):
    return f"<html><head><title>{title}</title>{extra}</head><body><p>texte {title}</p></body></html>"


def many(spark, ids):
    return raw(spark, *[(i, f"https://o.com/p/{i % 1000}", html(f"t{i % 1000}"), "text/html") for i in ids])


def test_only_allowed_types_are_admitted(spark):
    rows = raw(spark, (1, "u1", "<p>x</p>", "text/html; charset=utf-8"), (2, "u2", "%PDF", "application/pdf"),
               (3, "u3", None, None), (4, "u4", "<p>x</p>", None), (5, "u5", "", "text/html"))
    assert sorted(r.page_id for r in admitted(rows).collect()) == [1, 3, 5]
    assert sorted(r.page_id for r in admitted(rows, ("text/html", "pdf"), 4).collect()) == [1, 2, 3]
    assert admitted(rows.drop("content_type")).count() == 5


def test_rows_have_address_and_product_columns(spark):
    data = {"@type": "Product", "name": "Vis", "sku": "v1", "offers": {
        "price": "3", "availability": "InStock", "gtin13": "77"}}
    block = f'<script type="application/ld+json">{json.dumps(data)}</script>'
    rows = raw(spark, (1, "HTTPS://O.com/Cat/Vis/?q=1", html("Vis", block), "text/html"),
               (2, "https://o.com/", html("x"), "image/png"))
    row, = page_table(rows, "source", crawled_at="2026-01-01T00:00:00").collect()
    assert (row.normalized_url, row.path_segments) == ("https://o.com/cat/vis", '["cat","vis"]')
    assert row.crawled_at == "2026-01-01T00:00:00" and len(row.url_hash) == 32
    found = json.loads(row.structured_data)
    assert (found["sku"], found["ean"], found["availability"]) == ("v1", "77", "InStock")
    plain, = page_table(rows, "source", mode="pattern").collect()
    assert plain.structured_data == "{}" and plain.normalized_url == row.normalized_url


def test_insert_returns_the_number_of_new_rows(spark, tmp_path):
    path = str(tmp_path)
    first = page_table(many(spark, range(20)), "source")
    assert insert_pages(first.unionByName(first), path, buckets=8) == 20
    assert insert_pages(first, path) == 0
    # The number of buckets is that of the table, whatever a later call says.
    assert insert_pages(page_table(many(spark, range(10, 25)), "source"), path, buckets=3) == 5
    assert insert_pages(page_table(many(spark, range(3)), "target"), path) == 3
    assert insert_pages(first.limit(0), path) == 0
    got = read_pages(spark, path)
    assert got.count() == 28 and got.where("site = 'source'").select("url").distinct().count() == 25


def test_an_insert_reads_its_own_buckets_only(spark, tmp_path):
    from waypost.plans import page_table as module
    path = str(tmp_path)
    insert_pages(page_table(many(spark, range(300)), "source"), path, buckets=64)
    some = page_table(many(spark, range(300, 303)), "source").withColumn(
        "bucket", F.pmod(F.xxhash64("url"), F.lit(64)).cast("int"))
    known = module.known_addresses(some, path)
    buckets = {r.bucket for r in some.select("bucket").distinct().collect()}
    files = [name for name in known.inputFiles() if "/site=source/" in name]
    read = {r.b for r in known.select(F.regexp_extract(F.input_file_name(), r"bucket=(\d+)", 1).cast(
        "int").alias("b")).distinct().collect()}
    assert read == buckets and len(files) > len(buckets)
    assert "PartitionFilters: [" in known._jdf.queryExecution().toString()


def test_intake_over_many_batches(spark, tmp_path):
    inbox, table = f"{tmp_path}/in", f"{tmp_path}/pages"
    for part in (range(0, 10), range(5, 20), range(5, 20), range(1010, 1040)):
        many(spark, part).coalesce(1).write.mode("append").parquet(inbox)
    raw(spark, (9, "https://o.com/a.pdf", "%PDF", "application/pdf")).write.mode("append").parquet(inbox)
    stream = spark.readStream.schema(RAW).option("maxFilesPerTrigger", 1).parquet(inbox)
    running = page_intake(stream, "source", table, mode="pattern", buckets=8).option(
        "checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    running.awaitTermination()
    got = read_pages(spark, table)
    assert sorted(r.url for r in got.select("url").collect()) == sorted(
        f"https://o.com/p/{i}" for i in range(40))
