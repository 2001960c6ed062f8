"""The driver's tables, and the relations of the studies that they stand in for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with each row's place in it, `_file` and `_row`: what an order leaves open goes by that."""
    df = table(spark, sf_dir, name)
    return df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as change requests: stratum (nation, priority), day, churn (price) and files (lines)."""
    orders, customer, lines = (table(spark, sf_dir, x) for x in ("orders", "customer", "lineitem"))
    files = lines.groupBy(F.col("l_orderkey").alias("key")).agg(F.count(F.lit(1)).alias("files"))
    made = orders.select(F.col("o_orderkey").alias("key"), "o_custkey", F.col("o_orderpriority").alias("priority"), F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("churn"), F.col("o_orderstatus").alias("status"))
    who = customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation"))
    return made.join(who, "o_custkey").join(files, "key").select("key", "nation", "priority", "day", "churn", "files", "status")


def known_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of a nation as a repository, with language (segment, BUILDING is Unknown) and kind (priority, low is other)."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    segment = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("key"), F.when(F.col("c_mktsegment") == "BUILDING", "Unknown").otherwise(F.col("c_mktsegment")).alias("language"))
    kind = F.when(F.col("priority") == "5-LOW", "other").otherwise(F.col("priority"))
    return changes(spark, sf_dir).withColumn("kind", kind).drop("priority").join(segment, "key")


def treated_and_controls(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    both = changes(spark, sf_dir)
    return both.where("status = 'F'").drop("status"), both.where("status = 'O'").drop("status")
