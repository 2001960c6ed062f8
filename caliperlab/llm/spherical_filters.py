"""Links between near-equal vectors by spherical-cap filters with structured random product codes.

A filter direction joins one code word for each of BLOCKS blocks of the (randomly rotated) coordinates. A
vector is inserted under every direction whose inner product with it reaches a bound, found by list
decoding: partial sums of two halves of the blocks, the second sorted, so only exceeding combinations are
met. Vectors that share a filter are compared exactly; a pair that shares several is counted in the
smallest. Large filters are compared block against block, and send on counts and a spanning forest, no pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from . import common
from .components import components

THRESHOLD = 0.98
BLOCKS = 4
#: Filters that a random vector exceeds on average. A vector's own bound is lowered until LEAST exceed it, so that no
#: vector has few; a pair at the threshold shares about half of its filters, and misses all with probability near 0.5 ** LEAST.
EXPECTED, LEAST = 24, 24
#: Filters of the code follow the number of vectors: about so many vectors of a label a filter were all labels one.
PER_FILTER = 0.1
MIN_WORDS, MAX_WORDS = 8, 256
#: Vectors compared at once.
BLOCK = 1024
#: Numbers of a membership matrix that are made at once.
CELLS = 1 << 22


class ProductCode:
    """Random directions of a dimension, and the bound that EXPECTED of them exceed for a random vector."""

    def __init__(self, dim: int, words: int, expected: float = EXPECTED) -> None:
        rng = np.random.default_rng(dim * 1009 + words)
        self.blocks = min(BLOCKS, dim)
        self.words = words
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.cuts = [int(x) for x in np.linspace(0, dim, self.blocks + 1)]
        self.codes = []
        for a, b in zip(self.cuts, self.cuts[1:], strict=False):
            c = rng.standard_normal((words, b - a))
            self.codes.append(c / np.linalg.norm(c, axis=1, keepdims=True) / math.sqrt(self.blocks))
        x = rng.standard_normal((256, dim))
        parts = self.scores(x / np.linalg.norm(x, axis=1, keepdims=True))
        picks = rng.integers(0, words, (self.blocks, 4096))
        sums = sum(p[:, q] for p, q in zip(parts, picks, strict=True))
        share = min(0.5, expected / float(words**self.blocks))
        # the tail of the sums is near normal; the bound is their upper quantile at that share
        self.bound = float(sums.std() * NormalDist().inv_cdf(1 - share))

    def scores(self, x: np.ndarray) -> list[np.ndarray]:
        turned = x @ self.rotation
        return [turned[:, a:b] @ c.T for a, b, c in zip(self.cuts, self.cuts[1:], self.codes, strict=False)]

    def decode(self, x: np.ndarray) -> list[np.ndarray]:
        """For each row of unit vectors the sorted numbers of all filters it exceeds."""
        parts, half, out = self.scores(x), self.blocks // 2, []
        for i in range(len(x)):
            halves = []
            for group in (parts[:half], parts[half:]):
                total = np.zeros(1)
                for p in group:
                    total = (total[:, None] + p[i][None, :]).reshape(-1)
                halves.append(total)
            left, right = halves
            by_left, by_right = np.argsort(-left), np.argsort(-right)
            high, ranked = left[by_left], right[by_right]
            a, b = self._corner(len(left), len(right))
            best = high[a] + ranked[b]
            bound = min(self.bound, np.partition(best, max(0, len(best) - LEAST))[max(0, len(best) - LEAST)])
            able = np.searchsorted(-high, -(bound - ranked[0]), side="right")
            counts = np.searchsorted(-ranked, -(bound - high[:able]), side="right")
            rows = np.repeat(np.arange(able), counts)
            places = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            out.append(np.sort(by_left[rows] * len(right) + by_right[places]))
        return out

    @staticmethod
    @cache
    def _corner(left: int, right: int) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of the two halves among which the LEAST best sums are."""
        pairs = [(i, j) for i in range(min(left, LEAST)) for j in range(min(right, LEAST // (i + 1)))]
        return np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])


def words_for(vectors: int) -> int:
    return int(min(MAX_WORDS, max(MIN_WORDS, math.ceil((vectors / PER_FILTER) ** (1 / BLOCKS)))))


def unit(rows: list) -> list[np.ndarray | None]:
    """Unit vectors in double precision; None for null, empty and zero vectors and those with null or non-finite parts."""
    out = []
    for v in rows:
        x = None
        if v is not None and len(v) and not any(c is None for c in v):
            x = np.asarray(v, np.float64)
            top = np.abs(x).max()
            if np.isfinite(x).all() and top > 0:
                x = x / top
                x = x / np.linalg.norm(x)
            else:
                x = None
        out.append(x)
    return out


LINKS = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def _inserted(words: int):
    """(rep, filters) of rows (rep, embedding): the sorted numbers of a vector's filters as 32-bit integers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, ProductCode] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                reps, vectors = (batch.slice(lo, 512).column(i).to_pylist() for i in range(2))
                units, rows = unit(vectors), []
                for dim in sorted({len(u) for u in units if u is not None}):
                    code = codes.setdefault(dim, ProductCode(dim, words))
                    own = [i for i, u in enumerate(units) if u is not None and len(u) == dim]
                    rows += [(reps[i], f) for i, f in zip(own, code.decode(np.stack([units[i] for i in own])), strict=True)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], names=["rep", "filters"])

    return run


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [np.asarray(f, "<u4").tobytes() for f in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["rep", "filters"])


def _group(part: pa.Table, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(representatives, links counted here, root in this filter's forest) of the linked rows of one filter's blocks."""
    n = part.num_rows
    # a filter's rows have vectors of one length
    x = part["x"].combine_chunks().flatten().to_numpy().astype(np.float64).reshape(n, -1)
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= threshold
    near.flat[:: n + 1] = False
    if not near.any():
        return None
    block = part["block"].to_numpy()
    if part["lo"][0].as_py() != part["hi"][0].as_py():
        near &= block[:, None] != block[None, :]
    own = np.flatnonzero(near.any(1))
    if not len(own):
        return None
    near, part = near[np.ix_(own, own)], part.take(own)
    counted, members = near, part["members"].to_numpy()
    # a pair that shares several filters is counted in the smallest
    lists = [np.frombuffer(f, "<u4") for f in part["filters"].to_pylist()]
    here = np.uint32(part["filter"][0].as_py() & 0xFFFFFFFF)
    lists = [f[: np.searchsorted(f, here)] for f in lists]
    flat, owner = np.concatenate(lists), np.repeat(np.arange(len(own)), [len(f) for f in lists])
    ids, column = np.unique(flat, return_inverse=True)
    if len(ids):
        # some filters at a time: a vector may have thousands
        shared, width = np.zeros(near.shape, bool), max(256, CELLS // len(own))
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        for lo in range(0, len(ids), width):
            a, b = np.searchsorted(column, [lo, lo + width])
            held = np.zeros((len(own), min(width, len(ids) - lo)), np.float32)
            held[owner[a:b], column[a:b] - lo] = 1
            shared |= held @ held.T > 0
        counted = near & ~shared
    reps = part["rep"].to_numpy()
    label = reps.copy()
    while True:
        least = np.minimum(label, np.where(near, label[None, :], np.iinfo(np.int64).max).min(1))
        if (least == label).all():
            return reps, counted @ members, label
        label = least


def _compared(threshold: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for part in common.group_tables(batches, ["label", "filter", "lo", "hi"]):
            if part.num_rows > 1 and (g := _group(part, threshold)) is not None:
                found.append(g)
                size += len(g[0])
            if size >= 50_000:
                yield _links(found)
                found, size = [], 0
        if found:
            yield _links(found)

    return run


def _links(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*found, strict=True)], schema=LINKS)


def linked_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of vectors(vec_id, embedding, label).

    Vectors are compared where labels are equal and not null, by cosine in double precision. Those that are
    null, empty or zero, or hold a null or non-finite part, and those of different lengths, link with
    nothing. n_links counts the other rows linked directly, component_id is the smallest vec_id reachable,
    kept marks it. Rows with equal vectors and labels are compared once and counted each; rows of one vec_id with
    different vectors are compared each. Rows with a null vec_id link with nothing and have a null component. A label that is no
    whole number is known by a 64-bit hash of its text. Other columns are ignored.

    A threshold below THRESHOLD or above 1 raises ValueError: the filters are laid for THRESHOLD, and nearer vectors share more of them.

    What is sent once for each filter and block of a vector is the vector as it is stored (32-bit parts stay so) and its filters.
    """
    if not THRESHOLD <= threshold <= 1:
        raise ValueError(f"filters find links of a cosine of {THRESHOLD} to 1, not {threshold}")
    spark = vectors.sparkSession
    common.ensure_workers(spark)
    types = {f.name: f.dataType for f in vectors.schema}
    exact = types["embedding"].simpleString() == "array<float>"
    parts = F.col("embedding").cast("array<float>" if exact else "array<double>")
    label = F.col("label").cast("long") if isinstance(types["label"], IntegralType) else F.when(F.col("label").isNotNull(), F.xxhash64(F.col("label").cast("string")))
    fit = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce((F.size(parts) > 0) & F.forall(parts, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(parts, lambda c: c != 0), F.lit(False))
    rows = common.save(spark, vectors.select(F.col("vec_id").cast("long"), label.alias("label"), parts.alias("x"), fit.alias("fit"), F.xxhash64(parts).alias("k1"), F.xxhash64(F.lit(7), parts).alias("k2")), "vectors")
    key = ["label", "k1", "k2"]
    own = rows.where("fit").select("vec_id", *key)
    classes = own.groupBy(*key).agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("members"))
    classes = common.save(spark, classes.withColumn("rep", F.monotonically_increasing_id()), "vector-classes")
    # one row of each class: rows that share an id have other keys, and repeated rows are dropped
    heads = rows.where("fit").select(F.col("vec_id").alias("least"), *key, "x").join(classes, ["least", *key]).dropDuplicates(["least", *key])
    reps = common.save(spark, heads.select("rep", "label", "members", "x"), "vector-reps")
    words = words_for(reps.count())
    drawn = common.save(spark, reps.select("rep", "x").mapInArrow(_inserted(words), "rep long, filters array<long>"), "vector-filters")
    # vectors of another length never meet: the length is part of the filter
    sized = reps.select("rep", "label", "members", "x", F.size("x").cast("long").alias("dim"))
    inserted = drawn.join(sized.select("rep", "label", "dim"), "rep").select("rep", "label", F.explode(F.transform("filters", lambda f: F.col("dim") * (1 << 40) + f)).alias("filter"))
    sizes = inserted.groupBy("label", "filter").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    width = F.ceil(F.col("size") / BLOCK).cast("int")
    met = inserted.join(sizes, ["label", "filter"]).withColumn("block", F.pmod(F.xxhash64("rep"), width).cast("int"))
    dealt = met.withColumn("other", F.explode(F.sequence(F.lit(0), width - 1))).select("rep", "filter", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    group = ["label", "filter", "lo", "hi"]
    full = dealt.join(sized.drop("dim").join(drawn.mapInArrow(_packed, "rep long, filters binary"), "rep"), "rep").select(*group, "block", "rep", "members", "x", "filters").repartition(*group).sortWithinPartitions(*group)
    found = common.save(spark, full.mapInArrow(_compared(threshold), "rep long, links long, root long"), "vector-links")
    joined = components(found.where("rep != root").select(F.col("rep").alias("a"), F.col("root").alias("b")).distinct())
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    known = joined.join(classes.select(F.col("rep").alias("node"), "least"), "node")
    least = common.save(spark, known.groupBy("component").agg(F.min("least").alias("component_id")), "vector-components")
    named = common.looked_up(known, least, "component").select(F.col("node").alias("rep"), "component_id")
    judged = classes.join(links, "rep", "left").join(named, "rep", "left").select(*key, "members", (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    out = common.with_group(own, common.save(spark, judged, "vector-judged"), key, own.count()).select("vec_id", "n_links", "component_id")
    rest = rows.where("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
