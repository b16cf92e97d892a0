from pyspark.sql import functions as F

from waypost.operators import fuzzy
from waypost.plans import match
from waypost.session import spread


def filled(df):
    """How many partitions have rows, and how many rows the largest has."""
    sizes = [row["count"] for row in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return len(sizes), max(sizes)


def one_group(spark, path, n=4_000):
    """A table in one row group, read in many splits."""
    spark.range(n).select(
        (F.col("id") * 2).alias("page_id"), F.concat(F.lit("https://o.example/shop/"), F.md5(F.col("id").cast("string"))
                                                     ).alias("url")).coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


def test_addresses_of_one_row_group_are_taken_apart_by_all_cores(spark, tmp_path, monkeypatch):
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        pages = one_group(spark, str(tmp_path / "pages"))
        assert pages.rdd.getNumPartitions() >= 4 and filled(spread(pages))[0] == 1
        held = []
        monkeypatch.setattr(match, "hold", lambda df, label: held.append(df) or df)
        match._indexed(pages, None, None, "source-pages")
        parts, most = filled(held[0])
        assert parts >= 4 and most <= 1_100
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)


def test_target_paths_of_one_split_are_keyed_by_all_cores(spark, tmp_path, monkeypatch):
    class Stop(Exception):
        pass

    def first(df, label):
        raise Stop(df)

    paths = one_group(spark, str(tmp_path / "paths")).select(F.col("url").alias("path"), F.col("page_id").alias("first_id"))
    monkeypatch.setattr(fuzzy, "hold", first)
    try:
        fuzzy.match_fuzzy(paths.select("path").limit(3), paths)
    except Stop as stop:
        parts, most = filled(stop.args[0].where("first_id is not null").select("first_id"))
        assert parts >= 4 and most <= 1_100
    else:
        raise AssertionError("no table was stored")
