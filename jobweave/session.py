"""Session helpers: the shared folder for written intermediates, and table loading."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can read, from ``spark.checkpoint.dir``.

    Only where the setting is absent (local tests) a folder of this machine is made, once per session.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="jobweave-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def write_shared(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a reader of it.

    It cuts the lineage, survives the loss of executors, and lets a result be read by several branches without being computed twice.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small text file of any folder that Spark can read, or None if there is none."""
    fs, p = _file(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str, once: bool = False) -> None:
    """Write a small text file in one step; with ``once`` it is an error if it exists."""
    fs, p = _file(spark, path)
    stream = fs.create(p, not once)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> None:
    """Remove a file or a folder, if it is there."""
    fs, p = _file(spark, path)
    fs.delete(p, True)


def discard(df: DataFrame) -> None:
    """Remove the written table that ``df`` reads, once nothing needs it any more."""
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        if folder.startswith((shared_dir(df.sparkSession), f"file://{shared_dir(df.sparkSession)}")):
            remove(df.sparkSession, folder)


def reach_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, whatever folder they were started in."""
    root, env = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder."""
    reach_workers(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def local_session(cpus: int | None = None, name: str = "jobweave") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    cpus = cpus or os.cpu_count() or 4
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    reach_workers(spark)
    return spark
