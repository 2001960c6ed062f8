"""Benchmark items inside documents: size-partitioned MinHash containment search, then exact verification.

Items are partitioned by their number of distinct shingles, each partition with an index of its own. An item is
indexed under its minimum shingle by each of its partition's hash functions; a document that contains the share t of an
item's shingles holds each of those minima with probability t, however long the document is, so the number of functions
follows from t and the miss rate, and partitions of small items index all shingles. A document probes the partitions that
its own size can contain, with its whole shingle set. Every candidate's containment is then counted exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, shingles

THRESHOLD = 0.8
#: Chance to miss an item at the threshold; the hash functions of a partition follow from it.
MISS = 1e-12
#: Items whose shingles are sent to every worker at once; more items are taken in rounds of so many bytes.
MAX_INDEX_BYTES = 128 << 20
HITS = "doc_id long, item_id long, n_item_shingles long, n_shared long, containment double"


class Partition:
    """Items of sizes in [least, most], with their shingles in one sorted array; `probes` are the minima, or all shingles, of its items."""

    def __init__(self, items: list[tuple[int, np.ndarray]], most: int, threshold: float) -> None:
        self.functions = functions(most, threshold)
        self.item_ids = np.array([i for i, _ in items], np.int64)
        self.sizes = np.array([len(s) for _, s in items], np.int64)
        self.need = np.ceil(self.sizes * threshold - 1e-9).astype(np.int64)
        keys, owner = np.concatenate([s for _, s in items]), np.repeat(np.arange(len(items)), self.sizes)
        order = np.argsort(keys, kind="stable")
        self.keys, self.owner = keys[order], owner[order]
        self.probes = np.unique(np.concatenate([self._minima(s) for _, s in items]))

    def _minima(self, grams: np.ndarray) -> np.ndarray:
        if not self.functions:
            return grams
        return grams[[int(np.argmin(shingles.mix(grams ^ np.uint64(0x9E3779B97F4A7C15 * (i + 1) % 2**64)))) for i in range(self.functions)]]

    def search(self, own: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, its shingles, shared ones) of the items that a document with these distinct shingles contains."""
        if len(own) < self.need.min() or not within(own, self.probes).any():
            return []
        own = own[within(own, self.keys)]
        lo, hi = np.searchsorted(self.keys, own, "left"), np.searchsorted(self.keys, own, "right")
        places = np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo)[:-1]]), hi - lo) + np.arange((hi - lo).sum())
        shared = np.bincount(self.owner[places], minlength=len(self.sizes))
        return [(int(self.item_ids[i]), int(self.sizes[i]), int(shared[i])) for i in np.flatnonzero(shared >= self.need)]


def functions(most: int, threshold: float) -> int:
    """Hash functions of a partition of items of at most so many shingles; 0: index all their shingles."""
    wanted = math.ceil(math.log(MISS) / math.log(1 - threshold)) if threshold < 1 else 1
    return 0 if most <= wanted else wanted


def within(grams: np.ndarray, among: np.ndarray) -> np.ndarray:
    at = np.searchsorted(among, grams)
    at[at == len(among)] = 0
    return among[at] == grams


class Index:
    """Partitions of items by size: a partition's sizes are above half its largest, and a document too small for it skips it."""

    def __init__(self, item_ids: list[int], texts: list[str | None], threshold: float) -> None:
        hashes, bounds = shingles.words(texts)
        grams, at = shingles.shingles(hashes, bounds)
        self.widths = sorted({int(n) for n in np.diff(bounds) if 0 < n < shingles.WIDTH})
        by_size: dict[int, list[tuple[int, np.ndarray]]] = {}
        for i, item in enumerate(item_ids):
            own = np.unique(grams[at[i] : at[i + 1]])
            if len(own):
                by_size.setdefault(1 << (len(own) - 1).bit_length(), []).append((item, own))
        self.partitions = [Partition(items, most, threshold) for most, items in sorted(by_size.items())]
        self.probes = np.unique(np.concatenate([p.probes for p in self.partitions] or [np.zeros(0, np.uint64)]))

    def search(self, grams: np.ndarray) -> list[tuple[int, int, int]]:
        own = np.unique(grams)
        return [hit for p in self.partitions for hit in p.search(own)]


class Prefilter:
    """Bits of the probes' low hash bits: a test for most shingles without a search."""

    def __init__(self, probes: np.ndarray) -> None:
        self.bits = max(16, (64 * max(len(probes), 1)).bit_length())
        self.table = np.zeros(1 << self.bits, bool)
        self.table[self._place(probes)] = True

    def _place(self, grams: np.ndarray) -> np.ndarray:
        return (grams >> np.uint64(64 - self.bits)).astype(np.int64)

    def may_hold(self, grams: np.ndarray) -> np.ndarray:
        return self.table[self._place(grams)]


def _rounds(items: DataFrame, max_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in lists that fit max_bytes as an index (about 24 bytes a character at most)."""
    held, size = [], 0
    for row in items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator(prefetchPartitions=True):
        held.append((row[0], row[1]))
        size += 24 * len(row[1] or "") + 64
        if size >= max_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


def find_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, max_index_bytes: int = MAX_INDEX_BYTES) -> DataFrame:
    """Pairs (doc_id, item_id) where the document holds at least `threshold` of the item's 5-word shingles.

    Returns doc_id, item_id, n_item_shingles (distinct), n_shared and containment. An item of fewer than five
    words is one shingle of all its words, looked for at that length; one without words (null, empty,
    marks alone) is in no document. A null or empty text holds nothing. Items with equal texts each give a
    pair; repeated documents give their pairs again. Other columns are ignored. Documents are read whole
    and once a round of items; a benchmark within max_index_bytes, the usual case, takes one round.
    """
    spark = docs.sparkSession
    common.ensure_workers(spark)
    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = None
    for part in _rounds(items, max_index_bytes):
        hits = plain.mapInPandas(_finder(spark.sparkContext.broadcast(Index([i for i, _ in part], [t for _, t in part], threshold))), HITS)
        found = hits if found is None else found.unionByName(hits)
    return found if found is not None else spark.createDataFrame([], HITS)


def _held(index: Index, near: Prefilter, texts: list[str | None]) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """(place of the text, its items) for the texts that hold some."""
    widths = [shingles.WIDTH, *index.widths]
    for lo, hi in shingles.grouped(texts):
        hashes, bounds = shingles.words(texts[lo:hi])
        grams = [shingles.shingles(hashes, bounds, w) for w in widths]
        wanted = set()
        for g, at in grams:
            places = np.flatnonzero(near.may_hold(g))
            places = places[within(g[places], index.probes)] if len(places) and len(index.probes) else places[:0]
            wanted |= set((np.searchsorted(at, places, "right") - 1).tolist())
        for i in sorted(wanted):
            if found := index.search(np.concatenate([g[at[i] : at[i + 1]] for g, at in grams])):
                yield lo + i, found


def _finder(index_of):
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index: Index = index_of.value
        near = Prefilter(index.probes)
        for pdf in batches:
            ids = pdf["doc_id"].tolist()
            out = [(ids[i], item, size, n, n / size) for i, found in _held(index, near, pdf["text"].tolist()) for item, size, n in found]
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "n_item_shingles", "n_shared", "containment"])

    return run


def without_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, max_index_bytes: int = MAX_INDEX_BYTES) -> DataFrame:
    """The documents that hold no item, with all their columns; a null or empty text holds none. Narrow: no shuffle, no join.

    Each row is judged by its own text, also where rows share a doc_id or have none.
    """
    spark = docs.sparkSession
    common.ensure_workers(spark)

    def clean(index_of):
        def keep():
            index: Index = index_of.value
            near = Prefilter(index.probes)

            def wanted(texts: list[str | None]) -> list[bool]:
                held = {i for i, _ in _held(index, near, texts)}
                return [i not in held for i in range(len(texts))]

            return wanted

        return keep

    for part in _rounds(items, max_index_bytes):
        docs = common.filtered(docs, clean(spark.sparkContext.broadcast(Index([i for i, _ in part], [t for _, t in part], threshold))))
    return docs
