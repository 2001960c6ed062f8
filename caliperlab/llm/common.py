"""What the corpus operators share: worker set-up, scratch tables, distributed ranks."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])


#: What Python workers keep from task to task, by operator. A worker serves one operator at a time.
_KEPT: dict[str, dict] = {}


def worker_memory(operator: str) -> dict:
    """The operator's own memory in this worker; that of others is dropped, so what is kept doesn't add up over stages."""
    if operator not in _KEPT:
        for memory in _KEPT.values():
            memory.clear()
        others = bool(_KEPT)
        _KEPT.clear()
        if others:
            _give_back()
        _KEPT[operator] = {}
    return _KEPT[operator]


def _give_back() -> None:
    """Freed memory goes back to the system: an allocator would keep it for this process."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_workers(spark: SparkSession) -> None:
    """Let Python workers of a local session import this package; a cluster ships it with --py-files."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), ROOT) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset in a local session (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not base:
        base = sc.getCheckpointDir()
        if not base:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            base = tempfile.mkdtemp(prefix="caliperlab-")
            sc.setCheckpointDir(base)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def save(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and return the stored table: later reads neither recompute nor depend on executors."""
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_saved(spark: SparkSession, df: DataFrame) -> None:
    """Delete a stored table that no later plan reads."""
    sc = spark.sparkContext
    for f in df.inputFiles()[:1]:
        where = sc._jvm.org.apache.hadoop.fs.Path(f.rsplit("/", 1)[0])
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


#: Rows of a few numbers each that may be broadcast; a larger table is joined by a shuffle.
BROADCAST_ROWS = 500_000
#: A group with one in so many of all rows is large: there are no more than so many.
LARGE_GROUPS = 1000


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, a stored table of narrow rows, to be broadcast where it has at most BROADCAST_ROWS; else as it is."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


def with_group(rows: DataFrame, groups: DataFrame, key: list[str], total: int) -> DataFrame:
    """rows joined to the one row that their key has in the stored table groups(*key, members, ..).

    Rows of large groups, of which there are at most LARGE_GROUPS, stay where they are; only the others meet by key.
    """
    is_large = F.col("members") * LARGE_GROUPS >= total
    large = F.broadcast(groups.where(is_large))
    rest = rows.join(F.broadcast(groups.where(is_large).select(*key)), key, "left_anti").join(groups.where(~is_large), key)
    return rows.join(large, key).unionByName(rest)


def looked_up(rows: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows joined to the one row that their key has in the stored table of narrow rows, where few keys may hold most rows.

    A table of at most BROADCAST_ROWS rows is broadcast. Of a larger one the rows of large keys are, at most LARGE_GROUPS of them, and
    only rows of other keys meet by key.
    """
    if table.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), key, how)
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") * LARGE_GROUPS >= rows.count())
    large = F.broadcast(save(rows.sparkSession, sizes.select(key), "large-keys"))
    hot = rows.join(large, key, "left_semi").join(F.broadcast(table.join(large, key, "left_semi")), key, how)
    return hot.unionByName(rows.join(large, key, "left_anti").join(table, key, how))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    return next(x for x in (name, *(f"{name}{i}" for i in range(len(taken) + 1))) if x.lower() not in taken)


def numbered(df: DataFrame, by: list[str], order: list[str], bucket, name: str) -> DataFrame:
    """Gapless numbers from 0 within each key of `by`, without one task sorting a whole key.

    `bucket` is a column that grows with `order` or is independent of it; rows are numbered by
    (bucket, order). Only the count of each (key, bucket) meets in a window per key.
    """
    b = df.withColumn("_b", bucket)
    counts = b.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_b")) - F.col("_n")
    starts = counts.select(*by, "_b", before.alias("_start"))
    inner = F.row_number().over(Window.partitionBy(*by, "_b").orderBy(*order))
    ranked = b.withColumn("_r", inner)
    return ranked.join(starts, [*by, "_b"]).withColumn(name, F.col("_start") + F.col("_r") - 1).drop("_b", "_r", "_start")


def filtered(docs: DataFrame, keep) -> DataFrame:
    """The rows of docs, with all their columns, whose text `keep` wants: a function of a list of texts to a list of booleans.

    `keep` is made once a task by calling the given factory. Narrow: no shuffle, no join back on an id.
    """
    at = docs.columns.index("text")

    def run(batches):
        wanted = keep()
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                yield part.filter(pa.array(wanted(part.column(at).to_pylist()), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def group_tables(batches, keys: list[str]):
    """The rows of each key, as tables, from batches sorted by whole-number keys; no more is held than a group and a batch."""
    held = None
    for batch in chain(batches, [None]):
        if batch is not None:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
        if held is None or not held.num_rows:
            continue
        columns = np.stack([held[c].to_numpy() for c in keys])
        cuts = [0, *(np.flatnonzero((columns[:, 1:] != columns[:, :-1]).any(0)) + 1).tolist(), held.num_rows]
        whole = cuts if batch is None else cuts[:-1]
        for a, b in zip(whole, whole[1:], strict=False):
            yield held.slice(a, b - a)
        held = None if batch is None else held.slice(cuts[-2])
