"""URL rules by a cascade of Bloom filters, exact over the corpus's complete key universe.

A key is host + path prefix, such as ``example.net/en/``. For each verdict, level 1 encodes the listed
keys; level 2 the other keys of the universe that level 1 lets pass; level 3 the listed keys that level 2
lets pass; and so on until nothing passes wrongly. A key's membership is the parity of the first level
that refuses it. Every key that any url of the corpus can ask for is in the universe, so no answer is
wrong, and the judging scan needs the filters alone: no join.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Chance of a wrong pass on all levels but the first.
LATER_RATE = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; path from there up to ``? #``. Else empty."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


def candidates(host: Column, path: Column, path_lengths: list[int], label_counts: list[int]) -> Column:
    """Keys that a url can be listed under, the longest host first, then the longest path.

    Hosts are the ends of the host with as many labels as rules have; paths are the prefixes of the lengths that rules have. So a
    url has as many keys as rules have shapes, at most, and takes time in proportion to its length.
    """
    labels = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    ends = F.array(*[F.when(labels >= n, F.substring_index(host, ".", -n)) for n in sorted(label_counts, reverse=True)])
    hosts = F.filter(ends, lambda h: h.isNotNull())
    lengths = F.array(*[F.lit(n) for n in sorted(path_lengths, reverse=True)])
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n))
    pairs = F.flatten(F.transform(hosts, lambda h: F.transform(prefixes, lambda p: F.struct(h.alias("h"), p.alias("p")))))
    longest = F.array_sort(pairs, lambda a, b: F.when(F.length(a.h) + F.length(a.p) > F.length(b.h) + F.length(b.p), -1).when(F.length(a.h) + F.length(a.p) < F.length(b.h) + F.length(b.p), 1).when(F.length(a.h) > F.length(b.h), -1).otherwise(1))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(longest, lambda x: F.concat(x.h, x.p)))


def hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key, F.lit(1)), F.xxhash64(key, F.lit(2))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Level:
    """A Bloom filter with hash functions of its own."""

    number: int
    probes: int
    bits: np.ndarray  # uint8, 8 positions a byte

    @staticmethod
    def empty(number: int, n: int, rate: float) -> Level:
        size = max(64, math.ceil(n * -math.log(rate) / math.log(2) ** 2))
        return Level(number, max(1, round(-math.log2(rate))), np.zeros(-(-size // 8), np.uint8))

    def places(self, h1: np.ndarray, h2: np.ndarray) -> Iterator[np.ndarray]:
        salt = np.uint64(0x9E3779B97F4A7C15 * self.number % 2**64)
        a, b, m = _mix(h1.view(np.uint64) + salt), _mix(h2.view(np.uint64) ^ salt) | np.uint64(1), np.uint64(8 * len(self.bits))
        for i in range(self.probes):
            yield (a + np.uint64(i) * b) % m

    def add(self, h1: np.ndarray, h2: np.ndarray) -> None:
        for p in self.places(h1, h2):
            np.bitwise_or.at(self.bits, (p >> np.uint64(3)).astype(np.int64), np.uint8(1) << (p & np.uint64(7)).astype(np.uint8))

    def passes(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        ok = np.ones(len(h1), bool)
        for p in self.places(h1, h2):
            ok &= self.bits[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8) & 1 > 0
        return ok


@dataclass
class Cascade:
    levels: list[Level]

    def holds(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Whether each key is listed: the first level that refuses it is even."""
        member, open_ = np.full(len(h1), len(self.levels) % 2 == 1), np.arange(len(h1))
        for k, level in enumerate(self.levels):
            if not len(open_):
                break
            ok = level.passes(h1[open_], h2[open_])
            member[open_[~ok]] = k % 2 == 1
            open_ = open_[ok]
        return member


def build_cascade(universe: DataFrame, listed: list[str]) -> Cascade:
    """A cascade over universe(key, h1, h2), distinct keys, for the listed ones.

    The list is the driver's own, and what is sent to the workers is bounded by it: level 1 takes a few bytes a listed key and
    is so strict that about as many other keys pass as are listed. The other keys are tested where they are; those that
    pass come to the driver, to be encoded in the next levels.
    """
    spark = universe.sparkSession
    if not listed:
        return Cascade([])
    inside = spark.createDataFrame([(k,) for k in sorted(set(listed))], "key string").select("key", *(h.alias(n) for h, n in zip(hashes(F.col("key")), ("h1", "h2"), strict=True))).toPandas()
    total = universe.count()
    rate = min(0.5, math.sqrt(0.5) * len(inside) / max(total, 1))
    into = inside[["h1", "h2"]].to_numpy(np.int64)
    first = Level.empty(1, len(into), rate)
    first.add(into[:, 0].copy(), into[:, 1].copy())
    known = set(inside["key"])

    def survivors(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = first.passes(pdf["h1"].to_numpy(np.int64), pdf["h2"].to_numpy(np.int64))
            kept = pdf[ok]
            yield kept[~kept["key"].isin(known)][["h1", "h2"]]

    out = universe.mapInPandas(survivors, "h1 long, h2 long").toPandas().to_numpy(np.int64).reshape(-1, 2)
    levels, sides = [first], [into, out]
    while len(sides[1]):
        add, test = sides[1], sides[0]
        if len(levels) > 200:
            raise ValueError("two different keys share both hashes")
        level = Level.empty(len(levels) + 1, len(add), LATER_RATE)
        level.add(add[:, 0].copy(), add[:, 1].copy())
        levels.append(level)
        sides = [add, test[level.passes(test[:, 0].copy(), test[:, 1].copy())]]
    return Cascade(levels)


def judge_urls(pages: DataFrame, block: list[str], allow: list[str], default: str = "allow") -> DataFrame:
    """host, path, rule and verdict for the `url` of each row of pages(page_id, url).

    A rule such as ``example.net/en/`` fits its host and all subdomains where the path starts with the
    rule's path; the longest rule that fits wins (of rules as long, the one with the longer host; of a
    rule that is listed twice, block). Where none fits, the rule is null and the verdict `default`. A null
    url, or one without ``://``, has an empty host and path and fits no rule. Urls are read whole, however long. Repeated rows
    give a row each; other columns are ignored.
    """
    common.ensure_workers(pages.sparkSession)
    rules = [split_rule(r) for r in (*block, *allow)] or [("", "")]
    lengths, label_counts = sorted({len(p) for _, p in rules}), sorted({h.count(".") + 1 for h, _ in rules})
    named = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string").alias("_url"))
    host, path = host_and_path(F.col("_url"))
    split = named.select("page_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    asked = split.withColumn("keys", candidates(F.col("host"), F.col("path"), lengths, label_counts))
    h1, h2 = hashes(F.col("key"))
    universe = common.save(pages.sparkSession, asked.select(F.explode("keys").alias("key")).distinct().select("key", h1.alias("h1"), h2.alias("h2")), "url-keys")
    cascades = [build_cascade(universe, x) for x in (block, [a for a in allow if a not in set(block)])]

    def judge(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes = pdf["h"].map(len).to_numpy()
            flat = np.concatenate([np.asarray(x, np.int64) for x in pdf["h"]]) if sizes.sum() else np.zeros(0, np.int64)
            other = np.concatenate([np.asarray(x, np.int64) for x in pdf["g"]]) if sizes.sum() else np.zeros(0, np.int64)
            verdicts = np.zeros(len(flat), np.int8)
            for code, cascade in ((2, cascades[1]), (1, cascades[0])):
                if cascade.levels and len(flat):
                    verdicts[cascade.holds(flat, other)] = code
            row = np.repeat(np.arange(len(pdf)), sizes)
            place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            hit = np.flatnonzero(verdicts)[::-1]
            first, verdict = np.full(len(pdf), -1), np.zeros(len(pdf), np.int8)
            first[row[hit]], verdict[row[hit]] = place[hit], verdicts[hit]
            keys = pdf["keys"].tolist()
            yield pd.DataFrame({"page_id": pdf["page_id"].array, "host": pdf["host"].array, "path": pdf["path"].array, "rule": [keys[i][p] if p >= 0 else None for i, p in enumerate(first)], "verdict": np.array([default, "block", "allow"], object)[verdict]})

    hashed = asked.select(F.col("page_id"), "host", "path", "keys", F.transform("keys", lambda k: hashes(k)[0]).alias("h"), F.transform("keys", lambda k: hashes(k)[1]).alias("g"))
    return hashed.mapInPandas(judge, "page_id long, host string, path string, rule string, verdict string")
