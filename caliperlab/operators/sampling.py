"""Samples and chunks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import drop, kept
from . import ordered


def round_robin(df: DataFrame, stratum: str, order: list[str], n: int) -> DataFrame:
    """n rows: the first of each stratum, then the second of each, and so on."""
    ranked = df.withColumn("round", F.row_number().over(Window.partitionBy(stratum).orderBy(*order)))
    return ranked.where(F.col("round") <= n).orderBy("round", stratum).limit(n)


def hash_sample(df: DataFrame, key: Column, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, the same in every run: those with the smallest seeded MD5 of the key."""
    return df.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))).orderBy("_h").limit(n).drop("_h")


#: Rows of a group that one stream takes; the chunks of larger groups are found by pointers.
STREAM_ROWS = 1_000_000


def budget_chunks(df: DataFrame, by: str, order: str, size: str, most: int, budget: int, stream_rows: int = STREAM_ROWS) -> DataFrame:
    """(by, order, chunk): a chunk closes before the row that would bring it over `most` rows or `budget` size. A null size is 0; sizes aren't negative.

    Groups of up to `stream_rows` rows are streams; larger ones lie in many tasks. Rows without a
    group are one group, and a stream.
    """
    plain = df.select(by, order, F.coalesce(size, F.lit(0)).cast("long").alias(size))
    large = plain.groupBy(by).agg(F.count(F.lit(1)).alias("_n")).where((F.col("_n") > stream_rows) & F.col(by).isNotNull()).select(F.col(by).alias("_by"))
    large = kept(large, "large-groups")
    if large.isEmpty():
        return _chunk_streams(plain, by, order, size, most, budget)
    of_large = F.col(by) == F.col("_by")
    out = _chunk_pointers(plain.join(F.broadcast(large), of_large, "left_semi"), by, order, size, most, budget)
    return out.unionByName(_chunk_streams(plain.join(F.broadcast(large), of_large, "left_anti"), by, order, size, most, budget))


def _chunk_pointers(df: DataFrame, by: str, order: str, size: str, most: int, budget: int) -> DataFrame:
    """A row that begins a chunk points to the row that begins the next: the last one whose rows before it still fit, found by running counts over
    rows and limits together. Pointers from the first row, doubled each round, mark the rows that do begin one; a chunk's number counts them."""
    row = ordered.running(ordered.bucketed(df, [by], [order]), [by], [order], {"at": F.lit(1).cast("long"), "upto": size}).drop("_bucket")
    row = kept(row.withColumn("before", F.col("upto") - F.col(size)), "chunk-rows")
    ends = row.groupBy(by).agg(F.max("at").alias("at"), F.max("upto").alias("x"))
    marks = row.select(by, F.col("before").alias("x"), F.lit(0).alias("limit"), "at").unionByName(ends.select(by, "x", F.lit(0).alias("limit"), F.lit(None).cast("long").alias("at")))
    limits = row.select(by, (F.col("before") + budget).alias("x"), F.lit(1).alias("limit"), "at")
    both = ordered.bucketed(marks.unionByName(limits), [by], ["x", "limit"])
    counted = ordered.running(both, [by], ["x", "limit"], {"fits": 1 - F.col("limit")}).where("limit = 1")
    jump = kept(counted.select(by, "at", F.greatest(F.col("at") + 1, F.least(F.col("at") + most, "fits")).alias("next")), "pointers")
    begun = kept(row.where("at = 1").select(by, "at"), "begun")
    while True:
        reached = kept(begun.join(jump, [by, "at"]).select(by, F.col("next").alias("at")).join(row.select(by, "at"), [by, "at"], "left_semi"), "begun")
        if reached.join(begun, [by, "at"], "left_anti").isEmpty():
            break
        begun, old = kept(begun.unionByName(reached), "begun"), begun
        drop(old, reached)
        further = jump.select(by, F.col("at").alias("next"), F.col("next").alias("_next"))
        jump, old = kept(jump.join(further, [by, "next"]).select(by, "at", F.col("_next").alias("next")), "pointers"), jump
        drop(old)
    flagged = row.join(begun.distinct().withColumn("_begins", F.lit(1).cast("long")), [by, "at"], "left").withColumn("_bucket", F.floor(F.col("at") / 65_536))
    numbered = ordered.running(flagged, [by], ["at"], {"_chunk": F.coalesce("_begins", F.lit(0))})
    return numbered.select(by, order, (F.col("_chunk") - 1).cast("long").alias("chunk"))


def _chunk_streams(df: DataFrame, by: str, order: str, size: str, most: int, budget: int) -> DataFrame:
    placed = df.select(by, order, size).repartition(by).sortWithinPartitions(by, order)
    kinds = dict(placed.dtypes)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, chunk, n, total, fresh = None, 0, 0, 0, True
        for pdf in batches:
            out = []
            for key, s in zip(pdf[by], pdf[size], strict=True):
                if fresh or key != here:
                    here, chunk, n, total, fresh = key, 0, 0, 0, False
                if n and (n + 1 > most or total + s > budget):
                    chunk, n, total = chunk + 1, 0, 0
                n, total = n + 1, total + s
                out.append(chunk)
            yield pd.DataFrame({by: pdf[by], order: pdf[order], "chunk": out})

    return placed.mapInPandas(run, f"{by} {kinds[by]}, {order} {kinds[order]}, chunk long")
