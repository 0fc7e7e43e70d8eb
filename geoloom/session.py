"""Session settings, table loading and the shared folder for intermediate results."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named test table (a file or a folder of Parquet files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors can reach, as the cluster names it in spark.checkpoint.dir.

    Only a local master (tests, one machine) may leave it unset; it gets a folder of this machine. On a cluster no
    such folder would be shared, so an unset one is refused.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "") or context.getCheckpointDir()
    if not named:
        if not (context.master or "").startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), "geoloom-checkpoints")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def hadoop_path(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, and the path, as the JVM sees them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder's name under the shared folder; what is written there goes when the application ends."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    fs, at = hadoop_path(spark, path)
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def drop(spark: SparkSession, path: str) -> None:
    """Removes a scratch folder that nothing reads any more."""
    fs, at = hadoop_path(spark, path)
    fs.delete(at, True)


def stored(df: DataFrame, at: str, mode: str = "append") -> DataFrame:
    """df, written to a folder and read from there."""
    df.write.mode(mode).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """df, written once to the shared folder: later reads neither recompute it nor need its executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager)
