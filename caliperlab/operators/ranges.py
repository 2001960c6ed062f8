"""Line ranges: overlap, proximity, windows, and changed lines of diffs."""

from __future__ import annotations

import difflib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def near(a: Column, b: Column, distance: int = 50) -> Column:
    """Whether some range of a starts or ends within `distance` of one of b; arrays of struct<s, e>."""
    return F.exists(a, lambda x: F.exists(b, lambda y: (F.abs(x.s - y.s) <= distance) | (F.abs(x.e - y.e) <= distance)))


def merge_windows(ranges: DataFrame, by: list[str], reach: int, last: Column) -> DataFrame:
    """Ranges (s, e) widened by `reach`, clamped to [1, last], and joined where they touch."""
    wide = ranges.select(*by, F.greatest(F.lit(1), F.col("s") - reach).alias("s"), F.least(last, F.col("e") + reach).alias("e"))
    order = Window.partitionBy(*by).orderBy("s", "e")
    before = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    flagged = wide.withColumn("_new", F.when(before.isNull() | (F.col("s") > before + 1), 1).otherwise(0))
    island = flagged.withColumn("_island", F.sum("_new").over(order))  # equal ranges are peers, so they share an island
    return island.groupBy(*by, "_island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("_island")


def diff_lines(diffs: DataFrame, by: list[str], diff: str = "diff") -> DataFrame:
    """One row a line of unified diffs: position, text, op and old and new line numbers.

    Deliberate: a line ``\\ No newline ..`` moves no counter, and inside a hunk ``+++`` and ``---`` are an
    added and a deleted line like others.
    """
    rows = diffs.select(*by, F.posexplode(text.lines(F.col(diff))).alias("pos", "line"))
    order = Window.partitionBy(*by).orderBy("pos")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    at = F.regexp_extract("line", r"^@@ -(\d+)(?:,\d+)? \+\d+", 1)
    new = F.regexp_extract("line", r"^@@ -\d+(?:,\d+)? \+(\d+)", 1)
    hunked = rows.withColumn("hunk", F.sum(F.when(at != "", 1).otherwise(0)).over(so_far)).where("hunk > 0")
    inside = Window.partitionBy(*by, "hunk").orderBy("pos")
    op = F.when(at != "", "@").when(F.col("line").startswith("+"), "+").when(F.col("line").startswith("-"), "-").when(F.col("line").startswith("\\"), "\\").otherwise(" ")
    marked = hunked.withColumn("op", op).withColumn("_at", F.when(at != "", at.cast("long"))).withColumn("_new", F.when(new != "", new.cast("long")))
    up = inside.rowsBetween(Window.unboundedPreceding, -1)
    old_no = F.first("_at").over(inside) + F.coalesce(F.sum(F.when(F.col("op").isin(" ", "-"), 1).otherwise(0)).over(up), F.lit(0))
    new_no = F.first("_new").over(inside) + F.coalesce(F.sum(F.when(F.col("op").isin(" ", "+"), 1).otherwise(0)).over(up), F.lit(0))
    out = marked.withColumn("old_no", F.when(F.col("op").isin(" ", "-"), old_no)).withColumn("new_no", F.when(F.col("op").isin(" ", "+"), new_no))
    return out.where("op <> '@'").select(*by, "hunk", "pos", "op", F.when((F.col("op") == " ") & ~F.col("line").startswith(" "), F.col("line")).otherwise(F.expr("substring(line, 2)")).alias("text"), "old_no", "new_no")


def snapshot_map(pairs: DataFrame) -> DataFrame:
    """(id, old_no, new_no) of lines that a sequence matcher finds in both texts of pairs(id, old, new).

    The matcher is the standard library's, with its rule that ignores popular lines from 200 lines up.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, old, new in zip(pdf["id"], pdf["old"], pdf["new"], strict=True):
                matcher = difflib.SequenceMatcher(a=(old or "").split("\n"), b=(new or "").split("\n"))
                out += [(key, a + k + 1, b + k + 1) for a, b, n in matcher.get_matching_blocks() for k in range(n)]
            yield pd.DataFrame(out, columns=["id", "old_no", "new_no"])

    return pairs.select(F.col("id").cast("long"), "old", "new").mapInPandas(run, "id long, old_no long, new_no long")
