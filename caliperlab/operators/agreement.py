"""Agreement of raters and scoring of detectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: items, agreements, observed and expected agreement and Cohen's kappa (null where it is undefined)."""
    cells = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    total = cells.agg(F.sum("n").alias("items"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("agree"))
    left, right = (cells.groupBy(F.col(x).alias("label")).agg(F.sum("n").alias(f"n_{x}")) for x in ("a", "b"))
    chance = left.join(right, "label").agg(F.coalesce(F.sum(F.col("n_a").cast("double") * F.col("n_b")), F.lit(0.0)).alias("both"))
    po, pe = F.try_divide(F.col("agree"), F.col("items")), F.try_divide(F.col("both"), F.col("items").cast("double") * F.col("items"))
    return total.crossJoin(chance).select(F.coalesce("items", F.lit(0)).cast("long").alias("items"), F.coalesce("agree", F.lit(0)).cast("long").alias("agree"), F.round(po, 6).alias("observed"), F.round(pe, 6).alias("expected"), F.round(F.try_divide(po - pe, 1 - pe), 6).alias("kappa"))
