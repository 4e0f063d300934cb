"""Session and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "8", shuffle: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidemark")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only where that is unset (tests, one
    machine) a temporary folder is made and set, once per session."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        where = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    spark.conf.set("spark.checkpoint.dir", where) if _settable(spark) else None
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return where


def _settable(spark: SparkSession) -> bool:
    return spark.conf.get("spark.checkpoint.dir", None) is None and spark.conf.isModifiable("spark.checkpoint.dir")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint: its files survive the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for a table or file written by one run."""
    return f"{shared_dir(spark).rstrip('/')}/tidemark-{name}-{uuid.uuid4().hex}"


def _hadoop(spark: SparkSession, uri: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, uri: str) -> bool:
    """Whether a file or folder is there, on whatever file system its URI names."""
    fs, path = _hadoop(spark, uri)
    return fs.exists(path)


def remove(spark: SparkSession, uri: str) -> None:
    """Delete a file or folder of our own making, with all in it."""
    fs, path = _hadoop(spark, uri)
    fs.delete(path, True)


def local_path(uri: str) -> str:
    """The path of a file: URI as the file system of driver and executors knows it."""
    return uri[7:] if uri.startswith("file://") else uri[5:] if uri.startswith("file:") else uri


def attach(df: DataFrame, one: DataFrame, name: str) -> DataFrame:
    """df with the single row of `one` as a struct column: a scalar subquery, evaluated once."""
    return df.withColumn(name, one.select(F.struct("*")).scalar())


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
