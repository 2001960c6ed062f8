"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A document is its sequence of words; its k-mers are 5-word shingles, each labelled with its occurrence number, so that
none repeats. For each of SKETCHES hash functions the KEPT smallest labelled shingles are taken in text order:
documents that agree on one such sketch share content in the same order, and become candidates. A
candidate pair is verified by aligning both word sequences within the band that the threshold leaves:
similarity is m / (n1 + n2 - m) for m aligned words, and a link needs THRESHOLD.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, shingles
from .components import components

THRESHOLD = 0.8
#: A pair with the share j of common shingles has a sketch in common with probability 1 - (1 - j ** KEPT) ** SKETCHES:
#: over 1 - 1e-14 for j = 0.8, 0.996 for 0.4, where one word in nine was changed, 0.95 for 0.3.
SKETCHES, KEPT = 32, 2
#: Minima of labelled words in a signature. Words of which m align are common, so of a pair at the threshold each minimum agrees
#: with probability 0.8 at least, and fewer than AGREE with probability below 1e-6.
MINIMA, AGREE = 64, 34
#: Members of a bucket that are compared in one group.
BLOCK = 1024
#: Documents and words that a block of a family holds on average, at most; two blocks are compared in one group.
FAMILY_BLOCK, FAMILY_WORDS = 256, 1_000_000
#: Members of a group of several blocks that all its blocks are compared with at first.
LEADERS = 4
#: Words that the alignment takes at a time.
STRIDE = 512
_SEEDS = np.random.default_rng(7).integers(1, 2**63, (2, MINIMA), np.uint64)
_MULTIPLY, _ADD = (_SEEDS[0] * np.uint64(2) + np.uint64(1))[:, None], _SEEDS[1][:, None]
_PLACE = np.random.default_rng(8).integers(1, 2**63, KEPT, np.uint64) | np.uint64(1)
#: Numbers of a hash matrix that are made at once.
CELLS = 1 << 22


def labelled(grams: np.ndarray) -> np.ndarray:
    """Shingles or words in text order with their occurrence number mixed in: no two are equal."""
    order = np.argsort(grams, kind="stable")
    ordered = grams[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    if new.all():
        return grams
    at = np.arange(len(grams))
    label = np.empty(len(grams), np.uint64)
    label[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return np.where(label > 0, shingles.mix(grams + label * np.uint64(0x9E3779B97F4A7C15)), grams)


def sketch(items: np.ndarray) -> np.ndarray:
    """Bucket key of each ordered sketch of labelled shingles."""
    keep = min(KEPT, len(items))
    chosen = np.empty((SKETCHES, keep), np.int64)
    step = max(1, CELLS // len(items))
    for lo in range(0, SKETCHES, step):
        rows = slice(lo, min(lo + step, SKETCHES))
        cells = items[None, :] * _MULTIPLY[rows] + _ADD[rows]
        each = np.arange(len(cells))
        for k in range(keep):
            chosen[rows, k] = at = cells.argmin(axis=1)
            cells[each, at] = np.iinfo(np.uint64).max
    chosen.sort(axis=1)
    return shingles.mix((items[chosen] * _PLACE[:keep]).sum(axis=1, dtype=np.uint64) + np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def signature(items: np.ndarray) -> np.ndarray:
    """16 bits of the minimum of labelled words by each of MINIMA hash functions."""
    minima = np.empty(MINIMA, np.uint64)
    step = max(1, CELLS // len(items))
    for lo in range(0, MINIMA, step):
        rows = slice(lo, min(lo + step, MINIMA))
        minima[rows] = (items[None, :] * _MULTIPLY[rows] + _ADD[rows]).min(axis=1)
    return (shingles.mix(minima) >> np.uint64(48)).astype("<u2")


def similarity(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """m / (len(a) + len(b) - m) for the longest alignment of m equal words within the threshold's band.

    An alignment that reaches the threshold leaves few words out, so it never strays further than their number
    from the diagonal, and the band loses none. The common beginning and end align with themselves.
    """
    total, short = len(a) + len(b), min(len(a), len(b))
    band = int((1 - threshold) / (1 + threshold) * total + 1e-9)
    if total - 2 * short > band:
        return short / (total - short)
    differ = np.flatnonzero(a[:short] != b[:short])
    first = int(differ[0]) if len(differ) else short
    differ = np.flatnonzero(a[len(a) - short + first :][::-1] != b[len(b) - short + first :][::-1])
    last = int(differ[0]) if len(differ) else short - first
    m = first + last + _aligned_words(a[first : len(a) - last].tolist(), b[first : len(b) - last].tolist(), band)
    return m / max(1, total - m)


def _aligned_words(a: list[int], b: list[int], band: int) -> int:
    """Length of the longest common subsequence whose places differ by at most `band`: one machine word for 64 places of a.

    Bit i of `open_` is 0 where the i-th word of a lengthens the alignment. Places below the band don't change any more and
    are counted and dropped; those above it come in when the band reaches them.
    """
    count, at, open_, size = 0, 0, 0, 0
    for lo in range(0, len(b), STRIDE):
        hi = min(lo + STRIDE, len(b))
        gone = max(0, min(lo - band - at, size))
        if gone:
            count += gone - (open_ & ((1 << gone) - 1)).bit_count()
            open_, at, size = open_ >> gone, at + gone, size - gone
        if lo - band > at + size:
            at = lo - band
        more = min(len(a), hi + band) - at - size
        if more > 0:
            open_ |= ((1 << more) - 1) << size
            size += more
        places: dict[int, int] = {}
        for i, w in enumerate(a[at : at + size]):
            places[w] = places.get(w, 0) | 1 << i
        mask = (1 << size) - 1
        for j in range(lo, hi):
            if (met := places.get(b[j])) is None:
                continue
            below = j - band - at
            if below > 0:
                met = met >> below << below
            met &= (1 << max(0, j + band + 1 - at)) - 1
            step = open_ & met
            open_ = ((open_ + step) | (open_ - step)) & mask
    return count + size - open_.bit_count()


def content_hashes(own: np.ndarray, text: str) -> tuple[int, int]:
    """Two hashes of a text's words in order; of a text without words, of its bytes."""
    if not len(own):
        own = shingles.mix(np.frombuffer(text.encode("utf-8", "replace"), np.uint8).astype(np.uint64))
    places = np.arange(len(own), dtype=np.uint64)
    h1 = shingles.mix(own ^ shingles.mix(places + np.uint64(1))).sum(dtype=np.uint64)
    h2 = shingles.mix(own + shingles.mix(places ^ np.uint64(0xABCDEF0123456789))).sum(dtype=np.uint64) + np.uint64(len(own))
    return int(h1.view(np.int64)), int(h2.view(np.int64))


SKETCHED = pa.schema([("doc_id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int64()), ("keys", pa.list_(pa.int64())), ("sig", pa.binary())])


def _sketches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lo, hi in shingles.grouped(texts):
            hashes, bounds = shingles.words(texts[lo:hi])
            grams, at = shingles.shingles(hashes, bounds)
            rows = []
            for i, (doc, text) in enumerate(zip(ids[lo:hi], texts[lo:hi], strict=True)):
                if not text:
                    rows.append((doc, None, None, 0, [], b""))
                    continue
                own = hashes[bounds[i] : bounds[i + 1]]
                keys, sig = [], b""
                if len(own):
                    keys, sig = sketch(labelled(grams[at[i] : at[i + 1]])).view(np.int64), signature(labelled(own)).tobytes()
                rows.append((doc, *content_hashes(own, text), len(own), keys, sig))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SKETCHED, strict=True)], schema=SKETCHED)


EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _edges(batches: Iterable[pa.RecordBatch], keys: list[str], forest) -> Iterator[pa.RecordBatch]:
    """The forest edges of every group of rows."""
    found, size = [], 0
    for part in common.group_tables(batches, keys):
        if part.num_rows > 1 and len(e := forest(part)):
            found.append(e)
            size += len(e)
        if size >= 50_000:
            yield pa.RecordBatch.from_arrays(list(np.concatenate(found).T.copy()), schema=EDGES)
            found, size = [], 0
    if found:
        yield pa.RecordBatch.from_arrays(list(np.concatenate(found).T.copy()), schema=EDGES)


def _sides(part: pa.Table) -> tuple[np.ndarray, bool]:
    """The rows' blocks, and whether there is one, so that all rows are compared; else those of different blocks are."""
    block = part["block"].to_numpy()
    if part["lo"][0].as_py() == part["hi"][0].as_py():
        return np.zeros(len(block), np.int64), True
    return block, False


def _agreeing(part: pa.Table) -> np.ndarray:
    """Forest edges among the members of a bucket's blocks whose lengths and signatures agree: breadth first from each member."""
    nodes, sizes = part["node"].to_numpy(), part["n"].to_numpy()
    sigs = np.frombuffer(b"".join(part["sig"].to_pylist()), "<u2").reshape(len(nodes), MINIMA)
    block, same = _sides(part)
    left, edges = np.argsort(sizes, kind="stable"), []
    while len(left) > 1:
        queue, left, joined = [left[0]], left[1:], [left[0]]
        while queue and len(left):
            i = queue.pop()
            a, b = np.searchsorted(sizes[left], [int(np.ceil(THRESHOLD * sizes[i] - 1e-9)), int(sizes[i] / THRESHOLD + 1e-9) + 1])
            near = np.zeros(len(left), bool)
            near[a:b] = (sigs[left[a:b]] == sigs[i]).sum(axis=1) >= AGREE
            if not same:
                near &= block[left] != block[i]
            queue += left[near].tolist()
            joined += left[near].tolist()
            left = left[~near]
        if len(joined) > 1:
            edges.append(_star(nodes[joined]))
    return np.concatenate(edges) if edges else np.zeros((0, 2), np.int64)


def _star(nodes: np.ndarray) -> np.ndarray:
    """Edges from the smallest of joined documents to the others: the same ones from many groups."""
    ordered = np.unique(nodes)
    return np.column_stack([np.full(len(ordered) - 1, ordered[0]), ordered[1:]])


def _shared_counts(items: list[np.ndarray]) -> np.ndarray:
    """Common labelled words of all pairs: products of membership rows, some words at a time."""
    n, owner = len(items), np.repeat(np.arange(len(items)), [len(x) for x in items])
    ids, column = np.unique(np.concatenate(items), return_inverse=True)
    often = np.bincount(column, minlength=len(ids)) > 1
    place = np.cumsum(often) - 1
    owner, column = owner[often[column]], place[column[often[column]]]
    total, columns = np.zeros((n, n), np.float32), int(often.sum())
    width = max(1, min(columns, max(256, CELLS // n)))
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for lo in range(0, columns, width):
        a, b = np.searchsorted(column, [lo, lo + width])
        held = np.zeros((n, width), np.float32)
        held[owner[a:b], column[a:b] - lo] = 1
        total += held @ held.T
    return total


def _aligned(threshold: float):
    """Forest edges of links among the documents of a family's blocks. A pair that links already join is not aligned."""

    def forest(part: pa.Table) -> np.ndarray:
        rows = zip(*(part[c].to_pylist() for c in ("node", "h1", "h2", "block", "cls", "text")), strict=True)
        held: dict[int, tuple] = {}
        for node, h1, h2, block, cls, text in rows:
            if node not in held:
                own = shingles.words([text])[0]
                if content_hashes(own, text) == (h1, h2):  # else another text with the same id
                    held[node] = block, own, cls
        if len(held) < 2:
            return np.zeros((0, 2), np.int64)
        nodes, words = np.array(list(held)), [x[1] for x in held.values()]
        block = np.array([x[0] for x in held.values()])
        same = part["lo"][0].as_py() == part["hi"][0].as_py()
        sizes, both = np.array([len(x) for x in words], np.float32), _shared_counts([labelled(x) for x in words])
        # aligned words are common, so pairs with too few common ones need no alignment
        able = both >= threshold * (sizes[:, None] + sizes[None, :] - both) - 1e-3
        first: dict[int, int] = {}
        root = [first.setdefault(x[2], i) for i, x in enumerate(held.values())]

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i in range(len(words)):
            for j in (np.flatnonzero(able[i, i + 1 :]) + i + 1).tolist():
                if (same or block[i] != block[j]) and top(i) != top(j) and similarity(words[i], words[j], threshold) >= threshold - 1e-9:
                    root[top(j)] = top(i)
        tops = np.array([top(i) for i in range(len(words))])
        stars = [_star(nodes[tops == t]) for t in np.flatnonzero(np.bincount(tops) > 1)]
        return np.concatenate(stars) if stars else np.zeros((0, 2), np.int64)

    return forest


def _dealt(df: DataFrame, block, others, carried: list[str]) -> DataFrame:
    """Rows of df with (block, lo, hi): once for each pair of its `block` and one of `others`."""
    placed = df.withColumn("block", block.cast("int")).withColumn("other", F.explode(others))
    return placed.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).select(*carried, "block", "lo", "hi")


def _part(width) -> F.Column:
    return F.pmod(F.xxhash64("node"), width)


def _led(wide: DataFrame, carried: list[str]) -> DataFrame:
    """Up to LEADERS members of each wide group, drawn by their hashes."""
    drawn = wide.groupBy("part", F.pmod(F.xxhash64(F.lit(3), "node"), F.lit(LEADERS)).alias("_s")).agg(F.min(F.struct(F.xxhash64(F.lit(5), "node").alias("_h"), "w", *carried)).alias("_l"))
    return drawn.select("part", "_l.w", *[f"_l.{c}" for c in carried])


def _against_rest(wide: DataFrame, label: DataFrame, carried: list[str]) -> DataFrame:
    """Rows of wide(part, node, u, ..) with (cls, block, lo, hi), so that those outside a group's largest class meet all others.

    A class is what `label` has joined. Members of the largest one don't meet each other: they are joined already.
    """
    spark = wide.sparkSession
    classed = common.save(spark, wide.join(label, "node", "left").withColumn("cls", F.coalesce("component", "node")).drop("component"), "classed")
    each = classed.groupBy("part", "cls").agg(F.count(F.lit(1)).alias("c"), F.sum("u").alias("u"))
    most = each.groupBy("part").agg(F.max(F.struct("c", "cls", "u")).alias("top"), F.sum("u").alias("all"), F.count(F.lit(1)).alias("classes"))
    split = most.where("classes > 1").select("part", F.col("top.cls").alias("main"), F.ceil("top.u").cast("int").alias("wm"), F.ceil(F.col("all") - F.col("top.u") - 1e-6).cast("int").alias("wr"))
    placed = classed.join(common.small(common.save(spark, split, "largest")), "part")
    wr, wm = F.greatest("wr", F.lit(1)), F.greatest("wm", F.lit(1))
    in_main, columns = F.col("cls") == F.col("main"), ["part", "cls", *carried]
    rest = _dealt(placed.where(~in_main), _part(wr), F.sequence(F.lit(0), wr + wm - 1), columns)
    return rest.unionByName(_dealt(placed.where(in_main), wr + _part(wm), F.sequence(F.lit(0), wr - 1), columns))


def _joined(members: DataFrame, wide: DataFrame, body: DataFrame, compare, name: str) -> DataFrame:
    """Edges(a, b) that join what `compare` finds linked among the members(part, node, w, ..) of each group.

    A group has w blocks. At first every member goes, with its row of body(node, ..), to its own block alone, where it meets the
    block's members and the group's leaders. Of wide(part, node, w, u, ..), the stored members of groups of several blocks,
    those that this leaves outside of their group's largest class then meet all others, so a group that hangs together is sent
    about twice, whatever its size, and no pair that could join two classes is left out.
    """
    spark = members.sparkSession
    carried = [c for c in members.columns if c not in ("part", "w", "u")]
    columns, groups = ["part", "cls", *carried], ["part", "lo", "hi"]

    def found(dealt: DataFrame) -> DataFrame:
        return dealt.repartition(*groups).sortWithinPartitions(*groups).mapInArrow(lambda it: _edges(it, groups, compare), "a long, b long")

    alone = members.withColumn("cls", F.col("node"))
    own = _dealt(alone, _part(F.col("w")), F.array(_part(F.col("w")).cast("int")), columns).join(body, "node")
    if wide.isEmpty():
        return common.save(spark, found(own).distinct(), name)
    leaders = common.save(spark, _led(wide, carried).withColumn("cls", F.col("node")).join(body, "node"), "leaders")
    bodies = [c for c in body.columns if c != "node"]
    led = leaders.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("w") - 1))).where(F.col("block") != _part(F.col("w"))).withColumn("lo", F.col("block")).withColumn("hi", F.col("block"))
    first = common.save(spark, found(own.unionByName(led.select(*own.columns))).distinct(), name)
    again = _against_rest(wide, components(first), carried).join(body, "node").select("part", "cls", *carried, "block", "lo", "hi", *bodies)
    return common.save(spark, first.unionByName(found(again)).distinct(), name)


def _classes(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(the sketch of every row, and a stored row for each distinct text): h1, h2, node, members, rep, class_id, is_head.

    A text is the words of its rows, known by two hashes; rep is its smallest id, class_id the smallest of its class, and
    is_head marks one text of each class, that of the smallest id.
    """
    if not THRESHOLD <= threshold <= 1:
        raise ValueError(f"sketches and signatures find pairs of a similarity of {THRESHOLD} to 1, not {threshold}")
    spark = docs.sparkSession
    common.ensure_workers(spark)
    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    drawn = common.save(spark, plain.mapInArrow(_sketches, "doc_id long, h1 long, h2 long, n long, keys array<long>, sig binary"), "sketches")
    real = drawn.where("doc_id is not null and h1 is not null")
    texts = real.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("members"))
    texts = common.save(spark, texts.withColumn("node", F.monotonically_increasing_id()), "texts")
    first = texts.select(F.col("rep").alias("doc_id"), "h1", "h2", "node")
    reps = real.where("n > 0").join(first, ["doc_id", "h1", "h2"]).dropDuplicates(["doc_id", "h1", "h2"])
    reps = common.save(spark, reps.select("node", "n", "keys", "sig"), "representatives")
    buckets = reps.select("node", F.explode("keys").alias("part"))
    shared = common.save(spark, buckets.groupBy("part").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "buckets")
    sized = common.with_group(buckets, shared, ["part"], SKETCHES * reps.count()).select("part", "node", F.ceil(F.col("members") / BLOCK).cast("int").alias("w"))
    large = common.save(spark, shared.where(F.col("members") > BLOCK), "large-buckets")
    wide = common.save(spark, buckets.join(common.small(large), "part").select("part", "node", F.ceil(F.col("members") / BLOCK).cast("int").alias("w"), F.lit(1 / BLOCK).alias("u")), "wide-buckets")
    near = _joined(sized, wide, reps.select("node", "n", "sig"), _agreeing, "agreeing")
    family = components(near).withColumnRenamed("component", "part")
    u = F.greatest(F.lit(1 / FAMILY_BLOCK), F.col("n") / FAMILY_WORDS)
    known = common.save(spark, family.join(reps.select("node", "n"), "node").join(texts.select("node", "rep", "h1", "h2"), "node").withColumn("u", u).drop("n"), "family")
    large = common.save(spark, known.groupBy("part").agg(F.ceil(F.sum("u") - 1e-6).cast("int").alias("w")).where("w > 1"), "large-families")
    sized = known.join(common.small(large), "part", "left").select("part", "node", "h1", "h2", F.coalesce("w", F.lit(1)).alias("w"), "u")
    wanted = common.small(known.select(F.col("rep").alias("doc_id"), "node"))
    bodies = plain.where("text is not null").join(wanted, "doc_id").dropDuplicates(["doc_id", "node", "text"]).select("node", "text")
    links = _joined(sized, common.save(spark, sized.where("w > 1"), "wide-families"), bodies, _aligned(threshold), "links")
    linked = common.save(spark, components(links).join(texts, "node"), "linked")
    heads = common.save(spark, linked.groupBy("component").agg(F.min(F.struct("rep", "node")).alias("head")), "heads")
    placed = common.looked_up(linked, heads, "component").select("node", F.col("head.rep").alias("class_id"), (F.col("node") == F.col("head.node")).alias("is_head"))
    out = texts.join(placed, "node", "left").select("h1", "h2", "node", "members", "rep", F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("is_head", F.lit(True)).alias("is_head"))
    return drawn, common.save(spark, out, "classes")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, is_copy and kept for every row of docs(doc_id, text).

    class_id is the smallest doc_id among documents that links join, directly or through others; kept marks
    it. Documents with the same words in the same order are copies (is_copy but for the one with the
    smallest id) and links are sought between one of each. A text without words is a copy of a text of the same
    marks alone; a null or empty text, or a null doc_id, is a class of its own (class_id is its doc_id). Repeated
    rows each give a row, and rows of one doc_id with different texts are judged each by its own text. Other columns
    are ignored.

    Neither step lists the pairs of a group. Members of a bucket whose signatures agree are joined by a forest; the
    components of all forests are families, which hold every candidate pair. The documents of a family are
    then compared by their whole texts, block against block, aligned where their common words allow the
    threshold, and joined by a forest of links. A pair is left out only if links join it already. A group
    of several blocks is first compared within them and with a few leaders, then what that leaves outside its largest
    class with all the rest (see _joined). A threshold below THRESHOLD or above 1 raises ValueError: sketches are made for THRESHOLD.
    """
    drawn, classes = _classes(docs, threshold)
    real = drawn.where("doc_id is not null and h1 is not null").select("doc_id", "h1", "h2")
    classed = common.with_group(real, classes, ["h1", "h2"], real.count()).select("doc_id", "class_id", (F.col("doc_id") != F.col("rep")).alias("is_copy"))
    alone = drawn.where("doc_id is null or h1 is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(False).alias("is_copy"))
    return classed.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def _hashed(h1: str, h2: str, at: int):
    """Batches with the content hashes of the text at column `at`; null where it has none."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                found = [content_hashes(shingles.words([t])[0], t) if t else (None, None) for t in part.column(at).to_pylist()]
                columns = [pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, h1, h2])

    return run


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class of near_duplicates, the one with the smallest id, with all its columns.

    Rows with a null doc_id or a null or empty text are classes of their own and stay. Of rows with the same doc_id and words one
    stays, any of them; rows with the same doc_id and different texts are judged each by its own text.
    """
    spark = docs.sparkSession
    drawn, classes = _classes(docs, threshold)
    real = drawn.where("doc_id is not null and h1 is not null").select("doc_id", "h1", "h2")
    rows = common.with_group(real, classes, ["h1", "h2"], real.count())
    out_ids = common.save(spark, rows.where((F.col("doc_id") != F.col("rep")) | ~F.col("is_head")).select("doc_id").distinct(), "dropped")
    doc, gone, again = F.col("doc_id").cast("long"), common.fresh(docs, "_gone"), common.fresh(docs, "_again")
    out = docs.join(common.small(out_ids.select(F.col("doc_id").alias(gone))), doc == F.col(gone), "left_anti")
    repeated = common.save(spark, drawn.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias(again)), "repeated")
    if repeated.isEmpty():
        return out
    h1, h2 = common.fresh(docs, "_h1"), common.fresh(docs, "_h2")
    ids, same = common.small(repeated), doc == F.col(again)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", {h1} long, {h2} long"
    hashed = docs.join(ids, same, "left_semi").mapInArrow(_hashed(h1, h2, docs.columns.index("text")), schema)
    first = classes.where("is_head").select(F.col("rep").alias(gone), F.col("h1").alias(again), F.col("h2").alias(common.fresh(docs, "_other")))
    mine = hashed.join(first, (doc == F.col(gone)) & (F.col(h1) == F.col(again)) & (F.col(h2) == F.col(first.columns[2])), "left_semi")
    bare = hashed.where(F.col(h1).isNull()).dropDuplicates(["doc_id", "text"])
    return out.join(ids, same, "left_anti").unionByName(mine.dropDuplicates(["doc_id", h1, h2]).unionByName(bare).drop(h1, h2))
