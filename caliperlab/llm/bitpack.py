"""Fixed-width bit packing of token ids: every id takes the vocabulary's minimum number of bits."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .pieces import PieceEncoder

#: A block ends with the document that brings it to so many ids or documents.
BLOCK_IDS, BLOCK_DOCS = 1 << 19, 4096
FORMAT = "part int, block int, least_doc long, most_doc long, ids_before long, bits int, n_ids long, doc_ids array<long>, doc_lens array<long>, payload binary"
READ = "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long"


#: Widths at which packed ids are an ordinary little-endian array.
PLAIN = {8: np.dtype("u1"), 16: np.dtype("<u2"), 32: np.dtype("<u4")}


def width(vocab_size: int) -> int:
    """Bits that hold every id below vocab_size."""
    return max(1, int(vocab_size - 1).bit_length())


def _layout(bits: int) -> Iterator[tuple[int, int, int]]:
    for lane in range(64):
        yield lane, *divmod(lane * bits, 64)


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in groups of 64, each group in `bits` little-endian 64-bit words; lane by lane, so all groups at once."""
    groups = -(-len(ids) // 64)
    if bits in PLAIN:  # the same bytes, without lanes
        return ids.astype(PLAIN[bits]).tobytes() + bytes((groups * 64 - len(ids)) * bits // 8)
    lanes = np.zeros((groups, 64), np.uint64)
    lanes.reshape(-1)[: len(ids)] = ids
    words = np.zeros((groups, bits + 1), np.uint64)
    for lane, word, shift in _layout(bits):
        words[:, word] |= lanes[:, lane] << np.uint64(shift)
        if shift + bits > 64:
            words[:, word + 1] |= lanes[:, lane] >> np.uint64(64 - shift)
    return words[:, :bits].astype("<u8").tobytes()


def unpack(payload: bytes, bits: int, start: int, count: int) -> np.ndarray:
    """Ids start .. start+count-1 of a packed block; only the groups that hold them are touched."""
    if count <= 0:
        return np.zeros(0, np.uint32)
    if bits in PLAIN:
        return np.frombuffer(payload, PLAIN[bits], count, start * bits // 8).astype(np.uint32)
    first, last = start // 64, (start + count - 1) // 64
    words = np.frombuffer(payload, "<u8", (last - first + 1) * bits, first * bits * 8).reshape(-1, bits)
    lanes = np.empty((len(words), 64), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for lane, word, shift in _layout(bits):
        x = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            x = x | (words[:, word + 1] << np.uint64(64 - shift))
        lanes[:, lane] = x & mask
    return lanes.reshape(-1)[start - first * 64 :][:count]


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2) -> None:
    """Encode `text` of docs(doc_id, text) and write packed blocks in ascending doc_id order.

    A null text is an empty one; every document ends with end_id. Rows with one doc_id (repeated
    rows, or a null id, which comes first) stay together, in order of their text. Columns other than
    doc_id and text are ignored. An empty table gives a dataset without blocks.

    The container is Parquet, one row a block, because Spark's committer then makes a retried or
    speculative task safe on any store. Range partitioning deals out documents by id, so the order of
    (part, block) is the order of ids.
    """
    spark = docs.sparkSession
    common.ensure_workers(spark)

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder.of(tokenizer_path)
        bits, part = width(max(encoder.vocab_size, end_id + 1)), TaskContext.get().partitionId()
        end, held, ids, lens, n, before, block = np.array([end_id], encoder.dtype), [], [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            flat = np.concatenate(held)
            known = [i for i in ids if i is not None]
            row = {"part": [part], "block": [block], "least_doc": [min(known, default=None)], "most_doc": [max(known, default=None)], "ids_before": [before], "bits": [bits], "n_ids": [len(flat)], "doc_ids": [ids], "doc_lens": [lens], "payload": [pack(flat, bits)]}
            return pa.RecordBatch.from_pydict(row, schema=schema)

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for lo, encoded in encoder.encode_all(batch.column(1)):
                for key, x in zip(keys[lo : lo + len(encoded)], encoded, strict=True):
                    held += (x, end)
                    ids.append(key)
                    lens.append(len(x) + 1)
                    n += lens[-1]
                    if n >= BLOCK_IDS or len(ids) >= BLOCK_DOCS:
                        yield flush()
                        before, block, held, ids, lens, n = before + n, block + 1, [], [], [], 0
        if ids:
            yield flush()

    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("least_doc", pa.int64()), ("most_doc", pa.int64()), ("ids_before", pa.int64()), ("bits", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_lens", pa.list_(pa.int64())), ("payload", pa.binary())])
    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # the text's beginning lets rows of one id, a null one too, spread over tasks
    placed = plain.repartitionByRange("doc_id", F.left("text", F.lit(24))).sortWithinPartitions("doc_id", "text")
    placed.mapInArrow(encode, FORMAT).write.parquet(path)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document of a packed dataset.

    Each part's ids are counted from the blocks' heads alone; their running sum has a row a part.
    """
    common.ensure_workers(spark)

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                flat = unpack(row["payload"], row["bits"], 0, row["n_ids"]).astype("<u4")
                lens = np.asarray(row["doc_lens"], np.int64)
                ends = np.cumsum(lens)
                starts = ends - lens
                crcs = [zlib.crc32(flat[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array([row["part"]] * len(lens), pa.int32()), pa.array(starts + row["ids_before"]), pa.array(lens), pa.array(crcs, pa.int64())], names=["doc_id", "part", "local_start", "n_tokens", "ids_crc32"])

    blocks = spark.read.parquet(path)
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    offsets = totals.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_offset"))
    docs = blocks.select("part", "ids_before", "bits", "n_ids", "doc_ids", "doc_lens", "payload").mapInArrow(digest, READ)
    return docs.join(offsets, "part").select("doc_id", (F.col("_offset") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[np.ndarray]:
    """Random access: the ids of one document, from its block only: blocks' least and most ids are statistics of the files."""
    found = []
    at = F.lit(doc_id).cast("long")
    for row in spark.read.parquet(path).where((F.col("least_doc") <= at) & (F.col("most_doc") >= at)).orderBy("part", "block").toLocalIterator():
        starts = np.cumsum([0, *row["doc_lens"]])
        found += [unpack(row["payload"], row["bits"], int(starts[i]), row["doc_lens"][i]) for i, d in enumerate(row["doc_ids"]) if d == doc_id]
    return found
