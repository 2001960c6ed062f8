"""Running sums and ranks of groups of any size: buckets in order, a total a bucket, and what lies before each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import kept


#: Rows that a task of spread() takes on average, where there are many, and where there are few.
TASK_ROWS, FEW_ROWS = 250_000, 20_000


def spread(df: DataFrame, *by: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """df dealt by key to tasks of about `task_rows` rows, so what one holds doesn't grow with the table; what groups by the keys and more isn't dealt again."""
    n, usual = df.count(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(1, -(-n // task_rows), min(usual, -(-n // FEW_ROWS))), *by)


def bucketed(df: DataFrame, by: list[str], order: list[str], buckets: int | None = None) -> DataFrame:
    """df with `_bucket`, which grows with (by, order): ranges of about equal size, so a large group lies in many of them."""
    n = buckets or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # the numbers of the ranges must not change when a task runs again
    return kept(df.repartitionByRange(n, *by, *order).withColumn("_bucket", F.spark_partition_id()))


def running(df: DataFrame, by: list[str], order: list[str], sums: dict[str, Column | str], bucket: str = "_bucket") -> DataFrame:
    """df with running sums by name, each of the rows of its group up to its own; equal places in the order count one by one.

    Only a total for each bucket of a group meets in a window of the group; rows meet by (group, bucket).
    """
    named = {f"_s{i}": (name, F.expr(x) if isinstance(x, str) else x) for i, (name, x) in enumerate(sums.items())}
    rows = df.withColumns({k: x for k, (_, x) in named.items()})
    whole = rows.groupBy(*by, bucket).agg(*[F.sum(k).alias(k) for k in named])
    earlier = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    before = whole.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate([*by, bucket])], *[F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(f"{k}b") for k in named])
    inside = Window.partitionBy(*by, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    met = rows.withColumns({k: F.sum(k).over(inside) for k in named})
    same = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate([*by, bucket])]
    on = same[0]
    for s in same[1:]:
        on = on & s
    out = met.join(before, on).withColumns({name: F.coalesce(F.col(k), F.lit(0)) + F.col(f"{k}b") for k, (name, _) in named.items()})
    return out.drop(*named, *[f"{k}b" for k in named], *[f"_g{i}" for i in range(len(same))])


def ranks(df: DataFrame, by: list[str], order: list[str], name: str, buckets: int | None = None) -> DataFrame:
    """df with gapless ranks from 1 in each group. `order` should tell rows of a group apart."""
    return running(bucketed(df, by, order, buckets), by, order, {name: F.lit(1).cast("long")}).drop("_bucket")
