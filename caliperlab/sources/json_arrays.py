"""JSON arrays of any size, read by many tasks: blocks of a file are lexed apart, and the states they begin in composed.

Spark's text source cuts a file into blocks and those into texts at every closing brace. What a block does is known without
what stands before it, but for one thing: whether it begins inside a string. So the first pass finds, for either case, the depth
that a block adds and whether it ends inside a string; a fold over the blocks of a file gives each its beginning. The second pass cuts the
blocks at the commas of the array. An element that lies over a border is joined of its pieces.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from functools import partial
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import folders

_BLOCKS = "path string, block long, delta_out int, delta_in int, in_out boolean, in_in boolean"
_PIECES = "path string, block long, n long, begun boolean, ended boolean, text string"
ROWS = 2000


def ensure_workers(spark: SparkSession) -> None:
    """Let Python workers of a local session import this package; a cluster ships it with --py-files."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), root) if x)


#: What a byte of structure adds to the depth.
_STEP = np.zeros(256, np.int8)
_STEP[[ord("["), ord("{")]], _STEP[[ord("]"), ord("}")]] = 1, -1


def lexed(data: bytes, inside: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """(bytes, whether each stands in a string, whether the text ends inside one). A quote after an odd number of backslashes is none."""
    b = np.frombuffer(data, np.uint8)
    quotes = np.flatnonzero(b == ord('"'))
    back = b == ord("\\")
    if back.any() and len(quotes):
        at = np.arange(len(b), dtype=np.int64)
        other = np.maximum.accumulate(np.where(back, -1, at))
        quotes = quotes[(quotes - 1 - np.where(quotes > 0, other[quotes - 1], -1)) % 2 == 0]
    flips = np.zeros(len(b), np.int8)
    flips[quotes] = 1
    quoted = (np.cumsum(flips, dtype=np.int64) + inside) % 2 == 1
    return b, quoted, bool(quoted[-1]) if len(b) else inside


def _by_block(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[str]]]:
    """(path and whatever else is the same for a block, its texts in order with the brace that ended them)."""
    for batch in batches:
        columns = [batch[c].to_pylist() for c in batch.schema.names]
        key, texts = None, []
        for value, *own in zip(*columns, strict=True):
            if own != key and texts:
                yield tuple(key), texts
                texts = []
            key = own
            texts.append(value + "}")
        if texts:
            yield tuple(key), texts


def _summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each block does, for either beginning. A block comes in several batches: their sums are composed later, by n."""
    n, schema = 0, pa.schema([("path", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("delta_out", pa.int64()), ("delta_in", pa.int64()), ("in_out", pa.bool_()), ("in_in", pa.bool_())])
    for (path, block), texts in _by_block(batches):
        b, quoted, ended = lexed("".join(texts).encode(), False)
        # begun inside a string, all that is outside is inside and the other way round
        step = _STEP[b].astype(np.int64)
        row = (path, block, n, int(step[~quoted].sum()), int(step[quoted].sum()), ended, not ended)
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)
        n += 1


def _cut(batches: Iterable[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    """The pieces that are whole elements, or those that go over the border of a block."""
    schema = pa.schema([("path", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("begun", pa.bool_()), ("ended", pa.bool_()), ("text", pa.string())])
    here, n, inside, depth, begun, parts = None, 0, False, 0, False, []
    out: list[tuple] = []

    def piece(ended: bool) -> None:
        nonlocal n, parts
        if (begun and ended) == whole:
            out.append((*here, n, begun, ended, b"".join(parts).decode()))
        n, parts = n + 1, []

    def told() -> pa.RecordBatch:
        rows, out[:] = list(out), []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    for (path, block, start_in, start_depth), texts in _by_block(batches):
        if start_depth is None:
            raise ValueError(f"{path} was cut in other blocks before")
        if (path, block) != here:
            if here is not None and depth > 0:
                piece(False)
            here, n, inside, depth, begun, parts = (path, block), 0, start_in, start_depth, False, []
        data, lo = "".join(texts).encode(), 0
        b, quoted, inside = lexed(data, inside)
        after = depth + np.cumsum(np.where(quoted, 0, _STEP[b]), dtype=np.int64)
        if depth == 0 and not begun:
            first = np.flatnonzero(~quoted & (b == ord("[")) & (after == 1))
            if len(first):
                begun, lo, parts = True, int(first[0]) + 1, []
        cuts = np.flatnonzero(~quoted & (((b == ord(",")) & (after == 1)) | ((b == ord("]")) & (after == 0)))).tolist()
        for at in cuts:
            parts.append(data[lo:at])
            piece(True)
            begun, lo = True, at + 1
        depth = int(after[-1])
        if depth > 0:
            parts.append(data[lo:])
        if len(out) >= ROWS:
            yield told()
    if here is not None and depth > 0:
        piece(False)
    if out:
        yield told()


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of the elements of the JSON arrays in the files at path, in no order. An empty file and an empty array have none.

    The arrays must be valid JSON in UTF-8, each a file's only value. What is sent to every task is two numbers a block.
    """
    ensure_workers(spark)
    scan = spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    sums = folders.kept(scan.mapInArrow(_summed, _BLOCKS.replace("delta_out", "n long, delta_out").replace(" int", " long")), "json-blocks")
    in_order = sums.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("block", "n", "delta_out", "delta_in", "in_out", "in_in"))).alias("s"))
    begin = F.struct(F.lit(False).alias("inside"), F.lit(0).cast("long").alias("depth"), F.array().cast("array<struct<block:bigint,inside:boolean,depth:bigint>>").alias("starts"))

    def step(acc, s):
        known = F.concat(acc.starts, F.array(F.struct(s.block.alias("block"), acc.inside.alias("inside"), acc.depth.alias("depth"))))
        # a block's later batches are no beginnings
        starts = F.when((F.size(acc.starts) > 0) & (F.try_element_at(acc.starts, F.lit(-1)).block == s.block), acc.starts).otherwise(known)
        return F.struct(F.when(acc.inside, s.in_in).otherwise(s.in_out).alias("inside"), (acc.depth + F.when(acc.inside, s.delta_in).otherwise(s.delta_out)).alias("depth"), starts.alias("starts"))

    starts = in_order.select("path", F.explode(F.aggregate("s", begin, step, lambda acc: acc.starts)).alias("b")).select("path", "b.block", F.col("b.inside").alias("start_in"), F.col("b.depth").alias("start_depth"))
    placed = scan.join(F.broadcast(starts), ["path", "block"], "left").select("value", "path", "block", "start_in", "start_depth")
    whole = placed.mapInArrow(partial(_cut, whole=True), _PIECES).select("path", "text")
    # a few a block: of what it begins with and of what it ends with
    order = Window.partitionBy("path").orderBy("block", "n").rowsBetween(Window.unboundedPreceding, 0)
    border = placed.mapInArrow(partial(_cut, whole=False), _PIECES).withColumn("_of", F.sum(F.col("begun").cast("long")).over(order))
    joined = border.groupBy("path", "_of").agg(F.array_sort(F.collect_list(F.struct("block", "n", "text"))).alias("p")).select("path", F.array_join("p.text", "").alias("text"))
    return whole.unionByName(joined).where(F.trim(F.translate("text", "\n\r\t", "")) != "")


def read_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The elements of the JSON arrays at path as rows; an element that isn't of the schema's kind fails."""
    row = F.from_json("text", schema, {"mode": "FAILFAST"})
    return read_elements(spark, path).select(row.alias("row")).select("row.*")


def _bracketed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first = True
    for batch in batches:
        if batch.num_rows:
            lines = pc.binary_join_element_wise("[" if first else ",", batch["value"].slice(0, 1), "")
            rest = pc.binary_join_element_wise(",", batch["value"].slice(1), "")
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([lines, rest])], ["value"])
            first = False
    yield pa.RecordBatch.from_arrays([pa.array(["[]" if first else "]"])], ["value"])


def write_arrays(df: DataFrame, path: str) -> None:
    """A JSON array a partition, one file each."""
    ensure_workers(df.sparkSession)
    df.select(F.to_json(F.struct("*")).alias("value")).mapInArrow(_bracketed, "value string").write.text(path)
