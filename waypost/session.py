"""Session helpers: a local session for tests, and lineage cuts in shared storage."""

from __future__ import annotations

import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int | None = None) -> SparkSession:
    """A local session for tests and the bench. A cluster brings its own session."""
    partitions = shuffle_partitions or (cores if isinstance(cores, int) else 8)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("waypost")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str | None:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    A local session without one gets its own temporary folder. A cluster session without
    one gets ``None``: a machine-local folder would not be visible to the executors.
    """
    context = spark.sparkContext
    directory = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if directory:
        return directory.rstrip("/")
    if context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="waypost-"))
        return context.getCheckpointDir().rstrip("/")
    return None


_scratch = threading.local()


@contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[None]:
    """Remove the tables ``hold`` writes inside this block once it ends.

    Results must be written before then. Without it they stay until the shared folder is
    cleaned, as checkpoints do.
    """
    outer, _scratch.paths = getattr(_scratch, "paths", None), []
    try:
        yield
    finally:
        written, _scratch.paths = _scratch.paths, outer
        hadoop = spark._jvm.org.apache.hadoop.fs
        for name in written:
            path = hadoop.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def hold(df: DataFrame, label: str, scratch: bool = True) -> DataFrame:
    """Compute ``df`` once and read it back from a table in the shared folder.

    Later steps then start from parquet: lineage is cut, lost executors cost only their own
    tasks, unused columns are never read again, and the planner knows the true size. Without
    a shared folder the rows are persisted with their lineage instead. With ``scratch`` false the
    table outlives the ``scratch_tables`` block it is written in.
    """
    spark = df.sparkSession
    directory = shared_dir(spark)
    if directory is None:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    path = f"{directory}/waypost/{label}-{uuid.uuid4().hex}"
    if scratch and getattr(_scratch, "paths", None) is not None:
        _scratch.paths.append(path)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(held: DataFrame) -> None:
    """Remove a table that ``hold`` wrote, before its block of scratch tables ends. Nothing may read it later."""
    spark = held.sparkSession
    if shared_dir(spark) is None:
        held.unpersist()
        return
    folders = {name.rpartition("/")[0] for name in held.inputFiles()}
    for name in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def configured(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """Settings of the session that hold inside this block. Results must be held before it ends."""
    before = {name: spark.conf.get(name, None) for name in conf}
    try:
        for name, value in conf.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def spread(df: DataFrame, even: bool = False) -> DataFrame:
    """Use all cores for costly per-row work on a scan of very few files.

    A large scan already has more partitions than cores and is left as it is, and so is
    anything behind a shuffle, where counting partitions would mean running it. With ``even`` the
    rows of a large scan are dealt out too: a file of few row groups fills few of its partitions.
    """
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    cores, parts = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    return df.repartition(max(cores, parts)) if even or parts < cores else df


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Only needed where it is neither installed on the executors nor passed by ``--py-files``.
    """
    context = spark.sparkContext
    package = Path(__file__).resolve().parent
    if any(Path(name).name == f"{package.name}.zip" for name in context.listFiles):
        return
    archive = Path(tempfile.mkdtemp(prefix="waypost-")) / package.name
    context.addPyFile(shutil.make_archive(str(archive), "zip", package.parent, package.name))
