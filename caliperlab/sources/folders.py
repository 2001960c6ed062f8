"""Folders that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else the session's checkpoint folder; a temporary one, set as that, only in a local session that has neither."""
    sc = spark.sparkContext
    if base := spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir():
        return base.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="caliperlab-files-"))
    return sc.getCheckpointDir().rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    where, files = _at(spark, path)
    files.deleteOnExit(where)
    return path


def kept(df: DataFrame, name: str = "kept") -> DataFrame:
    """df as a written table of the shared folder: lineage ends there, lost executors cost no earlier step, and plans know its true size."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete written tables that no later plan reads."""
    for df in tables:
        for f in df.inputFiles()[:1]:
            where, files = _at(df.sparkSession, f.rsplit("/", 1)[0])
            files.delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where, files = _at(spark, path)
    return files.exists(where)


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
