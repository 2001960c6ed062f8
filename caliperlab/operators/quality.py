"""Checks and merges of labelled rows: exact cover, latest valid answers, positional joins, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ordered


def latest_valid(rows: DataFrame, key: list[str], order: list[str], valid: Column) -> DataFrame:
    """The last valid row of each key."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return rows.where(valid).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def todo(frame: DataFrame, done: DataFrame, key: list[str], valid: Column) -> DataFrame:
    """Rows of the frame without a valid answer: failed ones are asked again."""
    return frame.join(done.where(valid).select(*key).distinct(), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The rows of new, and those of old whose key new doesn't have. Rows that share a key in new all stay."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def cover_violations(candidates: DataFrame, members: DataFrame, by: list[str], item: str) -> DataFrame:
    """Items of a group that clusters and rejects don't hold exactly once: duplicate, missing or unexpected."""
    times = members.groupBy(*by, item).agg(F.count(F.lit(1)).alias("times"))
    both = candidates.select(*by, item, F.lit(True).alias("_asked")).join(times, [*by, item], "full_outer")
    kind = F.when(F.col("_asked").isNull(), "unexpected").when(F.col("times").isNull(), "missing").when(F.col("times") > 1, "duplicate")
    return both.select(*by, item, kind.alias("violation")).where("violation is not null")


def positional_join(left: DataFrame, right: DataFrame, by: list[str], left_order: list[str], right_order: list[str]) -> DataFrame:
    """The i-th row of a group with the i-th row of the other side's; fails where group sizes differ. A group may lie in many tasks."""
    a, b = (ordered.ranks(df, by, order, "position").withColumn(flag, F.lit(True)) for df, order, flag in ((left, left_order, "_a"), (right, right_order, "_b")))
    met = a.join(b, [*by, "position"], "full_outer")
    # ranks have no gaps, so a larger group has a row that meets none
    same = F.when(F.col("_a").isNull() | F.col("_b").isNull(), F.raise_error(F.lit("groups differ in size"))).otherwise(F.lit(True))
    return met.where(same).drop("_a", "_b")


def required(rows: DataFrame, facts: DataFrame, key: list[str]) -> DataFrame:
    """Rows with their facts; fails where a row has none."""
    met = rows.join(facts.withColumn("_known", F.lit(True)), key, "left")
    return met.where(F.when(F.col("_known").isNull(), F.raise_error(F.lit("a row has no facts"))).otherwise(F.lit(True))).drop("_known")


def first_existing(held: DataFrame, by: str, item: str, priority: list[str], n: int) -> DataFrame:
    """(by, item, place) of the first n items of the priority list that each group has."""
    rank = F.array_position(F.array(*[F.lit(x) for x in priority]), F.col(item))
    listed = held.select(by, item, rank.alias("_rank")).where("_rank > 0").distinct()
    return listed.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("_rank"))).where(F.col("place") <= n).select(by, item, "place")


def first_source(rows: DataFrame, by: str, source: str) -> DataFrame:
    """The rows of each group's first source that exists, whole; valid or not."""
    first = rows.groupBy(by).agg(F.min(source).alias(source))
    return rows.join(first, [by, source], "left_semi")
