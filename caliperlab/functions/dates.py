"""Date rules: parsing, latency buckets, midpoints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def latency_bucket(days: Column) -> Column:
    """unknown (null or negative), immediate (to 2 days), short (30), medium (180), long."""
    return F.when(days.isNull() | (days < 0), "unknown").when(days <= 2, "immediate").when(days <= 30, "short").when(days <= 180, "medium").otherwise("long")


def parse_day(text: Column) -> Column:
    """An ISO date or instant as its date, else the first ten characters as one, else null."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")).cast("date"), F.left(text, F.lit(10)).try_cast("date"))


def midpoint(lo: Column, hi: Column) -> Column:
    return F.date_add(lo, F.floor(F.datediff(hi, lo) / 2).cast("int"))
