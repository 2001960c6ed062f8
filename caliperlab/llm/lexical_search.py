"""Ranked lexical search: the product of an item-term matrix and a term-document matrix of whole-number impacts, in blocks.

Items, the queries, are taken in rounds that fit a stated size; a round's terms are numbered. One pass over the documents counts the round's
terms in each and stores them as sparse rows, from which the corpus statistics come. The product runs over blocks of those rows: a
block is turned to lists of documents by term, and each item's row of the product is merged from the lists of its terms
(Gustavson's method, with a dense row as the accumulator). Each task keeps the best documents of an item over its blocks, and one ranking by
item joins what the tasks kept.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Fixed values of the impact: saturation 8 over 1000, and 10 of 100 parts of it whatever the length.
SCALE, TF_SCALE, SATURATION, LENGTH_PARTS, PARTS = 1_000_000_000, 1000, 8, 90, 100
WEIGHT_SCALE = 1000
K = 10
#: Items of a round: so many bytes of text. Their terms are all that is sent to every worker.
ROUND_BYTES = 16 << 20
#: Documents and stored counts of a block of the product.
BLOCK_ROWS, BLOCK_COUNTS = 4096, 2_000_000
#: Bytes of a text that are split into words at a time.
PIECE = 1 << 20
COUNTS = "doc_id long, n long, terms binary, times binary"

#: Separators become spaces, A-Z become a-z; bytes of characters beyond ASCII stay.
_FOLD = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))


def term_counts(text: bytes | None) -> Counter:
    """How often each term is in a text of UTF-8 bytes, piece by piece; null has none."""
    folded = (text or b"").translate(_FOLD)
    if len(folded) <= PIECE:
        return Counter(folded.split())
    found, lo = Counter(), 0
    while lo < len(folded):
        hi = folded.find(b" ", lo + PIECE)
        hi = len(folded) if hi < 0 else hi
        found.update(folded[lo:hi].split())
        lo = hi
    return found


class Items:
    """Items of a round as the rows of a sparse matrix: item i has the terms terms[at[i] : at[i + 1]], so often as `times` says."""

    def __init__(self, rows: list[tuple[int | None, bytes | None]], once: bool) -> None:
        self.ids = [i for i, _ in rows]
        self.words: dict[bytes, int] = {}
        at, terms, times = [0], [], []
        for _, text in rows:
            for word, n in term_counts(text).items():
                terms.append(self.words.setdefault(word, len(self.words)))
                times.append(1 if once else n)
            at.append(len(terms))
        self.at, self.terms, self.times = np.array(at, np.int64), np.array(terms, np.int64), np.array(times, np.int64)


def _rounds(items: DataFrame, most: int) -> Iterator[list[tuple[int | None, bytes | None]]]:
    held, size = [], 0
    for row in items.select(F.col("item_id").cast("long"), F.col("text").cast("string").cast("binary")).toLocalIterator(prefetchPartitions=True):
        held.append((row[0], bytes(row[1]) if row[1] is not None else None))
        size += len(row[1] or b"") + 64
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _counted(words_of):
    """Sparse rows of the documents that have a term; `terms` are ascending numbers of the round's terms, 32 bits each like their counts."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.binary()), ("times", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                out = []
                for doc, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True):
                    found = term_counts(text)
                    if found:
                        own = sorted((words[w], n) for w, n in found.items() if w in words)
                        both = np.array(own, np.uint32).reshape(-1, 2)
                        out.append((doc, found.total(), both[:, 0].tobytes(), both[:, 1].tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return run


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all numbers of a column of 32-bit numbers, how many each row has)."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.uint32).astype(np.int64), np.array([len(r) // 4 for r in rows], np.int64)


def _held(n_terms: int):
    """How many documents of a task hold each term: a row a term."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            df += np.bincount(_flat(batch["terms"])[0], minlength=n_terms)
        own = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(df[own])], ["term", "df"])

    return run


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lo, sizes = 0, np.array([len(x) // 4 for x in batch["terms"].to_pylist()], np.int64)
        while lo < batch.num_rows:
            hi = lo + max(1, int(np.searchsorted(np.cumsum(sizes[lo : lo + BLOCK_ROWS]), BLOCK_COUNTS, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


class Best:
    """The k best documents of each item so far: equal scores by doc_id, null last."""

    def __init__(self, n_items: int, k: int) -> None:
        self.k, self.floor = k, np.zeros(n_items, np.int64)
        self.held: list[tuple[np.ndarray, ...]] = [tuple(np.zeros(0, t) for t in (np.int64, bool, np.int64))] * n_items

    def add(self, item: int, scores: np.ndarray, unknown: np.ndarray, docs: np.ndarray) -> None:
        own = np.flatnonzero((scores > 0) & (scores >= self.floor[item]))
        if not len(own):
            return
        if len(own) > self.k:
            own = own[scores[own] >= np.partition(scores[own], len(own) - self.k)[len(own) - self.k]]
        both = [np.concatenate([a, b[own]]) for a, b in zip(self.held[item], (scores, unknown, docs), strict=True)]
        order = np.lexsort((both[2], both[1], -both[0]))[: self.k]
        self.held[item] = tuple(x[order] for x in both)
        if len(order) == self.k:
            self.floor[item] = self.held[item][0][-1]


def _product(items_of, n_docs: int, n_terms: int, k: int):
    """(item, doc_id, score) of the best documents of each item among a task's rows. items_of: (rows of the item matrix, weight of each term)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, terms, times, weights = items_of.value
        best = Best(len(at) - 1, k)
        for block in _blocks(batches):
            term, sizes = _flat(block["terms"])
            tf, doc = _flat(block["times"])[0], np.repeat(np.arange(block.num_rows), sizes)
            m = PARTS - LENGTH_PARTS + LENGTH_PARTS * block["n"].to_numpy() * n_docs // n_terms
            impact = weights[term] * ((SCALE * tf) // (TF_SCALE * tf + SATURATION * m[doc]))
            order = np.argsort(term, kind="stable")
            doc, impact = doc[order], impact[order]
            begins = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(weights)))])
            unknown = block["doc_id"].is_null().to_numpy(zero_copy_only=False)
            ids = block["doc_id"].fill_null(0).to_numpy()
            for item in range(len(at) - 1):
                row = np.zeros(block.num_rows, np.int64)
                for t, n in zip(terms[at[item] : at[item + 1]], times[at[item] : at[item + 1]], strict=True):
                    lo, hi = begins[t], begins[t + 1]
                    if hi > lo:
                        row[doc[lo:hi]] += n * impact[lo:hi]
                best.add(item, row, unknown, ids)
        for item, (scores, unknown, docs) in enumerate(best.held):
            if len(scores):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(docs), item, np.int64)), pa.array(docs, mask=unknown), pa.array(scores)], ["item", "doc_id", "score"])

    return run


def _weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(WEIGHT_SCALE * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def ranked(docs: DataFrame, items: DataFrame, k: int = K, once: bool = True, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents(doc_id, text) of each of items(item_id, text), those with a score above 0.

    A term is a maximal run of ASCII letters and digits, A-Z lower-cased, and of characters beyond ASCII. A document's score sums, over
    the item's terms, weight times impact in whole numbers (the constants above); `once` counts a term of the item once, else as often
    as the item has it. Equal scores rank by ascending doc_id, a null doc_id last. Null texts and those without a term (empty, marks
    alone) are in no result and in no statistic; an item without a term has no row. Each row is a document or an item of its own, also
    where rows repeat or share an id: a repeated document ranks twice, a repeated item gives its rows again. No documents or
    no items: no rows. Other columns are ignored.

    Documents are read whole, once a round of items of `round_bytes`; a benchmark below that, the usual case, takes one round.
    """
    spark = docs.sparkSession
    common.ensure_workers(spark)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    found = None
    for i, rows in enumerate(_rounds(items, round_bytes)):
        hits = _round(plain, Items(rows, once), k)
        hits = hits.withColumn("round", F.lit(i)) if hits is not None else None
        found = hits if found is None else found.unionByName(hits) if hits is not None else found
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("round", "item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _round(plain: DataFrame, items: Items, k: int) -> DataFrame | None:
    spark = plain.sparkSession
    sc = spark.sparkContext
    if not items.words:
        return None
    counts = common.save(spark, plain.mapInArrow(_counted(sc.broadcast(items.words)), COUNTS), "term-counts")
    n_docs, n_terms = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_docs:
        return None
    df = np.zeros(len(items.words), np.int64)
    # a row for each of the round's terms at most
    for part in counts.select("terms").mapInArrow(_held(len(df)), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow().to_batches():
        df[part["term"].to_numpy()] = part["df"].to_numpy()
    matrix = sc.broadcast((items.at, items.terms, items.times, _weights(df, n_docs)))
    hits = counts.where(F.length("terms") > 0).mapInArrow(_product(matrix, n_docs, n_terms, k), "item long, doc_id long, score long")
    ids = spark.createDataFrame(pa.table({"item": pa.array(range(len(items.ids)), pa.int64()), "item_id": pa.array(items.ids, pa.int64())}))
    return hits.join(F.broadcast(ids), "item")
