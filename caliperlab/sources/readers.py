"""Readers and sinks of the file forms that the studies use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import folders


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header; quotes are doubled inside cells, cells may hold line ends, a byte order mark is ignored."""
    return spark.read.options(header=True, multiLine=True, escape='"').schema(schema).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(header=True, escape='"').csv(path)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole-file JSON arrays. They can't be split: convert large ones once to lines or Parquet."""
    return spark.read.option("multiLine", True).schema(schema).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str, tolerant: bool = False) -> DataFrame:
    """JSON lines, also compressed, by extension. Tolerant: malformed lines are left out; else they fail."""
    return spark.read.option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").schema(schema).json(path)


def corrupt_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The lines that `schema` can't read."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").json(path)
    return rows.withColumn("_file", F.col("_metadata.file_path")).where("_corrupt_record is not null").select("_file", F.col("_corrupt_record").alias("line"))


def read_glob(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Lines of all files of a pattern, with the folder that names their repository."""
    return spark.read.schema(schema).json(pattern).withColumn("repo", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def read_with_extra(spark: SparkSession, path: str, extra: str, schema: str, keep: Column) -> DataFrame:
    """Lines of all files below path and, where there are any below `extra`, those of its rows that `keep` names; rows of both count twice."""
    rows = spark.read.schema(schema).json(path)
    if not folders.exists(spark, extra):
        return rows
    return rows.unionByName(spark.read.schema(schema).json(extra).where(keep))


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """One row a file, line ends made uniform."""
    return spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("name"), F.regexp_replace("value", "\r\n?", "\n").alias("text"))


def write_partitioned(df: DataFrame, path: str, *by: str) -> None:
    """A folder per value of `by`; writing again replaces only the folders written."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).json(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def compact_log(spark: SparkSession, path: str, into: str, key: list[str], order: str) -> DataFrame:
    """The last row of each key of an append log, sorted, as a new table."""
    rows = spark.read.parquet(path)
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in key]), F.col(order)).alias("_row"))
    last.select(*key, "_row.*").sort(*key).write.mode("overwrite").parquet(into)
    return spark.read.parquet(into)
