"""Joins of ranges by bins of their own size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _level(s: Column, e: Column) -> Column:
    """The least n with 2**n numbers or more than the range has."""
    return F.when(e <= s, 0).otherwise(F.length(F.bin(e - s)))


def _bins(s: Column, e: Column, level: Column) -> Column:
    """The one or two bins of a level that a range no longer than it overlaps."""
    at = lambda x: F.floor(x / F.pow(F.lit(2.0), level)).cast("long")
    return F.array_distinct(F.array(at(s), at(e)))


def overlap_join(a: DataFrame, b: DataFrame, by: list[str], a_range: tuple[str, str], b_range: tuple[str, str]) -> DataFrame:
    """Pairs of rows of a and b with equal `by` whose ranges of whole numbers (both ends within, below 2**50) share a number; each pair once.

    A range takes the one or two bins of the level that fits its length, and those that hold it on the levels of longer ranges of the
    other side. The pair meets on the longer one's level, in the bin where the later range begins. So a range is sent a few times for each length
    that occurs, however many ranges it overlaps. Ranges whose end is before their begin have no pair.
    """
    (a_s, a_e), (b_s, b_e) = (tuple(F.col(c) for c in r) for r in (a_range, b_range))
    sides = {}
    for name, df, s, e in (("a", a, a_s, a_e), ("b", b, b_s, b_e)):
        sides[name] = df.where(s <= e).withColumn("_own", _level(s, e))
    lengths = sides["a"].select(F.lit("a"), "_own").union(sides["b"].select(F.lit("b"), "_own")).distinct().collect()  # 100 at most
    present = {name: sorted(r[1] for r in lengths if r[0] == name) for name in sides}

    def placed(name: str, s: Column, e: Column, own_kind: int, strictly: bool) -> DataFrame:
        other = present["b" if name == "a" else "a"]
        wider = F.filter(F.array(*[F.lit(x) for x in other]).cast("array<int>"), lambda x: (x > F.col("_own")) if strictly else (x >= F.col("_own")))
        keys = lambda level, kind: F.transform(_bins(s, e, level), lambda x: F.struct(F.lit(kind).alias("_kind"), level.cast("int").alias("_level"), x.alias("_bin")))
        every = F.concat(keys(F.col("_own"), own_kind), F.flatten(F.transform(wider, lambda x: keys(x, 1 - own_kind))))
        return sides[name].withColumn("_k", F.explode(every)).select("*", "_k.*").drop("_k", "_own")

    left, right = placed("a", a_s, a_e, 1, False), placed("b", b_s, b_e, 0, True)
    met = left.join(right, [*by, "_kind", "_level", "_bin"])
    begin = F.floor(F.greatest(a_s, b_s) / F.pow(F.lit(2.0), F.col("_level"))).cast("long")
    return met.where((a_s <= b_e) & (b_s <= a_e) & (F.col("_bin") == begin)).drop("_kind", "_level", "_bin")


def near_groups(ranges: DataFrame, by: list[str], of_first: Column, distance: int = 50) -> DataFrame:
    """The groups of ranges(*by, s, e) where a range of the first kind starts or ends within `distance` of one of the other kind.

    Places are summed up by bins as wide as the distance: two in one bin are near, and of bins side by side the closest places decide.
    """
    points = ranges.withColumn("_first", of_first).select(*by, "_first", F.posexplode(F.array("s", "e")).alias("_end", "_at")).withColumn("_bin", F.floor(F.col("_at") / (distance + 1)))
    first, other = F.when(F.col("_first"), F.col("_at")), F.when(~F.col("_first"), F.col("_at"))
    bins = points.groupBy(*by, "_end", "_bin").agg(F.min(first).alias("a_min"), F.max(first).alias("a_max"), F.min(other).alias("b_min"), F.max(other).alias("b_max"))
    after = bins.select(*by, "_end", (F.col("_bin") - 1).alias("_bin"), F.col("a_min").alias("_a"), F.col("b_min").alias("_b"))
    close = (F.col("_b") - F.col("a_max") <= distance) | (F.col("_a") - F.col("b_max") <= distance)
    same = F.col("a_min").isNotNull() & F.col("b_min").isNotNull()
    return bins.join(after, [*by, "_end", "_bin"], "left").where(same | F.coalesce(close, F.lit(False))).select(*by).distinct()
