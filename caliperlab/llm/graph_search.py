"""Nearest vectors by inner product: a robust-pruned directed graph a shard, searched by beams.

Equal vectors are one node, so that copies take no edges. Nodes are dealt to shards of bounded size. In a shard, nodes are inserted in
batches: a beam search from the start node proposes neighbours, and pruning keeps a candidate unless a kept one is nearer to it,
by a factor, than the new node is; kept edges are also drawn back, and full nodes pruned again. An added component makes all nodes of
a shard equally long, so that the least distance is the largest inner product. Every query is searched in every shard; the nodes of the
final beam are scored in double precision on the original vectors, and the best of all shards remain.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

K = 20
#: Nodes of a shard: a graph is built and searched in one task, and is one row of the index.
SHARD_NODES = 8192
#: Edges of a node; beams of building and of searching; nodes of a beam that are followed at a time; factor of pruning.
DEGREE, BUILD_BEAM, SEARCH_BEAM, WIDTH, SLACK = 32, 48, 128, 4, 1.2
#: Rounds of a search whose nodes are neighbours to propose, besides the nearest: those on the way from the start are far.
TRAIL = 8
#: Nodes that are inserted, or queries that are searched, at a time.
BATCH = 256
#: Queries that are sent to every worker at once: so many bytes of vectors; more are taken in rounds.
ROUND_BYTES = 64 << 20
GRAPH = "dim int, shard long, nodes binary, ids binary, id_counts binary, edges binary, start int, wide boolean"
EMPTY = -1


def _distances(x: np.ndarray, norms: np.ndarray, q: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Squared distances, less the square of q, of each row of q to its nodes `at`; infinite where there is none."""
    d = norms[at] - 2 * np.einsum("bnd,bd->bn", x[at], q)
    d[at == EMPTY] = np.inf
    return d


def beam(x: np.ndarray, norms: np.ndarray, edges: np.ndarray, start: int, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of q the `width` nearest nodes met, nearest first, and the first nodes that were followed; EMPTY where there were fewer."""
    trail = []
    rows = np.arange(len(q))[:, None]
    near = np.full((len(q), width), EMPTY, np.int64)
    near[:, 0] = start
    far = _distances(x, norms, q, near)
    open_ = near != EMPTY
    seen = np.zeros((len(q), len(x) + 1), bool)  # the last column stands for EMPTY
    seen[:, start] = seen[:, EMPTY] = True
    while open_.any():
        pick = np.argsort(~open_, axis=1, kind="stable")[:, :WIDTH]
        wanted = np.where(np.take_along_axis(open_, pick, 1), np.take_along_axis(near, pick, 1), EMPTY)
        np.put_along_axis(open_, pick, False, 1)
        if len(trail) < TRAIL:
            trail.append(wanted)
        new = np.where(wanted[:, :, None] == EMPTY, EMPTY, edges[wanted]).reshape(len(q), -1)
        new = np.sort(new, axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = EMPTY
        new[seen[rows, new]] = EMPTY
        full = (new != EMPTY).sum(1).max(initial=0)
        if not full:
            continue
        new = -np.partition(-new, full - 1, axis=1)[:, :full] if full < new.shape[1] else new
        seen[rows, new] = True
        all_near, all_far = np.concatenate([near, new], 1), np.concatenate([far, _distances(x, norms, q, new)], 1)
        all_open = np.concatenate([open_, new != EMPTY], 1)
        order = np.argsort(all_far, axis=1, kind="stable")[:, :width]
        near, far, open_ = (np.take_along_axis(a, order, 1) for a in (all_near, all_far, all_open))
    return near, np.concatenate(trail, 1)


def prune(x: np.ndarray, norms: np.ndarray, own: np.ndarray, among: np.ndarray) -> np.ndarray:
    """DEGREE edges at most for each node of `own` from its candidates `among`: nearest first, without those that a kept one covers.

    Those that are nearer to the node than to any kept one come first, however far, so that neighbours in a dense place don't take all
    edges; what is left is filled under the relaxed rule.
    """
    among = np.sort(among, axis=1)
    among[:, 1:][among[:, 1:] == among[:, :-1]] = EMPTY
    among[among == own[:, None]] = EMPTY
    far = _distances(x, norms, x[own], among) + norms[own][:, None]
    order = np.argsort(far, axis=1, kind="stable")
    among, far = np.take_along_axis(among, order, 1), np.take_along_axis(far, order, 1)
    vectors = x[among]
    between = norms[among][:, :, None] + norms[among][:, None, :] - 2 * np.matmul(vectors, vectors.transpose(0, 2, 1))
    strict, relaxed, rows = among != EMPTY, among != EMPTY, np.arange(len(own))
    out = np.full((len(own), DEGREE), EMPTY, np.int64)
    for k in range(DEGREE):
        alive = np.where(strict.any(1)[:, None], strict, relaxed)
        if not alive.any():
            break
        pick = np.argmax(alive, axis=1)
        none = ~alive[rows, pick][:, None]
        out[:, k] = np.where(none[:, 0], EMPTY, among[rows, pick])
        strict = strict & ((between[rows, pick] > far) | none)
        relaxed = relaxed & ((SLACK**2 * between[rows, pick] > far) | none)
        strict[rows, pick] = relaxed[rows, pick] = False
    return out


def _drawn_back(x: np.ndarray, norms: np.ndarray, edges: np.ndarray, new: np.ndarray) -> None:
    """Add the edges from the neighbours of `new` nodes back to them; nodes with too many are pruned."""
    source = np.repeat(new, DEGREE)
    target = edges[new].ravel()
    source, target = source[target != EMPTY], target[target != EMPTY]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    own, first, counts = np.unique(target, return_index=True, return_counts=True)
    place = np.arange(len(target)) - np.repeat(first, counts)
    row = np.repeat(np.arange(len(own)), counts)
    held = (edges[own] != EMPTY).sum(1)
    fits = held + counts <= DEGREE
    ok = fits[row]
    edges[target[ok], held[row[ok]] + place[ok]] = source[ok]
    over = np.flatnonzero(~fits)
    # nodes with about as many candidates meet, and some at a time, as a hub may have got one from every new node
    over = over[np.argsort(counts[over], kind="stable")]
    for lo in range(0, len(over), 64):
        some = over[lo : lo + 64]
        among = np.full((len(some), DEGREE + counts[some].max()), EMPTY, np.int64)
        among[:, :DEGREE] = edges[own[some]]
        for i, s in enumerate(some):
            among[i, DEGREE : DEGREE + counts[s]] = source[first[s] : first[s] + counts[s]]
        edges[own[some]] = prune(x, norms, own[some], among)


def build(x: np.ndarray) -> tuple[np.ndarray, int]:
    """(edges of every node, start node) of the graph of the rows of x: equally long vectors in 32 bits."""
    n, norms = len(x), np.append((x * x).sum(1), np.float32(0))
    x = np.vstack([x, np.zeros((1, x.shape[1]), x.dtype)])  # the last row stands for EMPTY
    edges = np.full((n + 1, DEGREE), EMPTY, np.int64)
    start = int(np.argmin(((x[:n] - x[:n].mean(0)) ** 2).sum(1)))
    order = np.random.default_rng(n).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    done = 1
    while done < n:
        new = order[done : done + min(BATCH, done)]
        near, trail = beam(x, norms, edges, start, x[new], BUILD_BEAM)
        edges[new] = prune(x, norms, new, np.concatenate([near, trail], 1))
        _drawn_back(x, norms, edges, new)
        done += len(new)
    return edges[:n], start


def lengthened(x: np.ndarray) -> np.ndarray:
    """The vectors scaled into the unit ball, with a component that makes them equally long."""
    x = x.astype(np.float64)
    x = x / (np.abs(x).max(initial=0) or 1.0)
    length = np.linalg.norm(x, axis=1)
    most = length.max(initial=0) or 1.0
    return np.column_stack([x / most, np.sqrt(np.maximum(0, 1 - (length / most) ** 2))]).astype(np.float32)


def _built(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("dim", pa.int32()), ("shard", pa.int64()), *((c, pa.binary()) for c in ("nodes", "ids", "id_counts", "edges")), ("start", pa.int32()), ("wide", pa.bool_())])
    for part in common.group_tables(batches, ["dim", "shard"]):
        dim, column = part["dim"][0].as_py(), part["x"].combine_chunks()
        wide = column.type.value_type == pa.float64()
        x = column.flatten().to_numpy().reshape(-1, dim)
        edges, start = build(lengthened(x))
        ids = part["ids"].combine_chunks()
        cells = [dim, part["shard"][0].as_py(), x.tobytes(), ids.flatten().to_numpy().tobytes(), ids.value_lengths().to_numpy().astype("<i4").tobytes(), edges.astype("<i4").tobytes(), start, wide]
        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, schema.types, strict=True)], schema=schema)


class Shard:
    """A graph of the index, in memory."""

    def __init__(self, row: dict) -> None:
        self.vectors = np.frombuffer(row["nodes"], "<f8" if row["wide"] else "<f4").reshape(-1, row["dim"])
        counts = np.frombuffer(row["id_counts"], "<i4")
        self.first, self.ids = np.concatenate([[0], np.cumsum(counts)]), np.frombuffer(row["ids"], "<i8")
        self.edges = np.vstack([np.frombuffer(row["edges"], "<i4").reshape(-1, DEGREE).astype(np.int64), np.full((1, DEGREE), EMPTY)])
        x = lengthened(self.vectors)
        self.norms = np.append((x * x).sum(1), np.float32(0))
        self.x, self.start = np.vstack([x, np.zeros((1, x.shape[1]), x.dtype)]), row["start"]

    def search(self, query_ids: np.ndarray, q: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place of the query, vec_id, score) of the k best of each query; rows with the query's own id are none."""
        longest = np.abs(q).max(axis=1, keepdims=True)
        unit = np.column_stack([q / longest, np.zeros(len(q))])
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        near, _ = beam(self.x, self.norms, self.edges, self.start, unit.astype(np.float32), max(SEARCH_BEAM, 2 * k))
        place, column = np.nonzero(near != EMPTY)
        node = near[place, column]
        with np.errstate(over="ignore", invalid="ignore"):
            score = (self.vectors[node].astype(np.float64) * q[place]).sum(1)
        many = self.first[node + 1] - self.first[node]
        at = np.repeat(self.first[node] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        place, score, ids = np.repeat(place, many), np.repeat(score, many), self.ids[at]
        other = ids != query_ids[place]
        return best(place[other], ids[other], score[other], k)


def best(place: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k rows of each place with the largest score, equal ones by the smaller id."""
    order = np.lexsort((ids, -score, place))
    place, ids, score = place[order], ids[order], score[order]
    _, first, counts = np.unique(place, return_index=True, return_counts=True)
    own = np.arange(len(place)) - np.repeat(first, counts) < k
    return place[own], ids[own], score[own]


def _searched(queries_of, k: int):
    """The best of a task's shards for each query of a round: (place of the query, vec_id, score)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, by_dim = queries_of.value
        kept = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch[c][i].as_py() for c in batch.schema.names}
                if row["dim"] not in by_dim:
                    continue
                shard, (places, vectors) = Shard(row), by_dim[row["dim"]]
                found = [] if kept is None else [kept]
                for lo in range(0, len(places), BATCH):
                    own = places[lo : lo + BATCH]
                    at, vec, score = shard.search(ids[own], vectors[lo : lo + BATCH].astype(np.float64), k)
                    found.append((own[at], vec, score))
                kept = best(*(np.concatenate(c) for c in zip(*found, strict=True)), k)
        if kept is not None:
            for lo in range(0, len(kept[0]), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + 50_000]) for c in kept], ["place", "vec_id", "score"])

    return run


def _fit(parts: Column) -> Column:
    return F.coalesce((F.size(parts) > 0) & F.forall(parts, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(parts, lambda c: c != 0), F.lit(False))


def indexed(vectors: DataFrame, k: int = K, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """The index of vectors(vec_id, embedding): a stored table of graphs, one row a shard, each of vectors of one length.

    All rows are in it. Of rows with equal vectors the k + 1 smallest ids are named: no other can be among the k best of a query.
    """
    spark = vectors.sparkSession
    common.ensure_workers(spark)
    x = F.col("embedding").cast("array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & _fit(F.col("x")))
    # -0.0 and 0.0 are equal
    rows = rows.select("vec_id", F.transform("x", lambda c: c + F.lit(0).cast("float")).alias("x")).distinct()
    least = rows.withColumn("_r", F.row_number().over(Window.partitionBy("x").orderBy("vec_id"))).where(F.col("_r") <= k + 1)
    nodes = common.save(spark, least.groupBy("x").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "graph-nodes")
    shards = nodes.groupBy(F.size("x").alias("dim")).agg(F.ceil(F.count(F.lit(1)) / shard_nodes).cast("long").alias("shards"))
    dealt = nodes.withColumn("dim", F.size("x")).join(F.broadcast(shards), "dim").select("dim", F.pmod(F.xxhash64("x"), "shards").alias("shard"), "ids", "x")
    n = max(1, shards.agg(F.coalesce(F.sum("shards"), F.lit(0))).first()[0])
    placed = dealt.repartition(n, "dim", "shard").sortWithinPartitions("dim", "shard")
    return common.save(spark, placed.mapInArrow(_built, GRAPH), "graphs")


def nearest(queries: DataFrame, index: DataFrame, k: int = K, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest vectors found in the index for each of queries(vec_id, embedding).

    Nearest is the largest inner product, in double precision; equal ones rank by the smaller vec_id. The rows with the query's own
    vec_id are no candidates, nor are vectors of another length. Null vectors, zero ones, those with a null or non-finite component and rows
    with a null vec_id take no part, as queries or as candidates. A repeated query is asked once; two vectors with one vec_id are two queries.
    Queries are sent to the workers in rounds of `round_bytes`, each against all shards. Other columns are ignored.
    """
    spark = queries.sparkSession
    common.ensure_workers(spark)
    x = F.col("embedding").cast("array<float>" if dict(queries.dtypes)["embedding"] == "array<float>" else "array<double>")
    asked = queries.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & _fit(F.col("x"))).distinct()
    asked = common.save(spark, asked, "queries")
    cells = asked.agg(F.coalesce(F.sum(F.size("x") + 4), F.lit(0))).first()[0]
    rounds, found = max(1, -(-8 * cells // round_bytes)), None
    for i in range(rounds):
        part = asked.where(F.pmod(F.xxhash64("vec_id", "x"), F.lit(rounds)) == i).toArrow().combine_chunks()
        if not part.num_rows:
            continue
        sizes, ids = np.array([len(v) for v in part["x"]]), part["vec_id"].to_numpy()
        by_dim = {int(d): (own := np.flatnonzero(sizes == d), part["x"].take(pa.array(own)).combine_chunks().flatten().to_numpy().reshape(-1, d)) for d in np.unique(sizes)}
        hits = index.mapInArrow(_searched(spark.sparkContext.broadcast((ids, by_dim)), k), "place long, vec_id long, score double")
        names = spark.createDataFrame(pa.table({"place": pa.array(np.arange(len(ids))), "query_id": pa.array(ids)}))
        order = Window.partitionBy("place").orderBy(F.desc("score"), "vec_id")
        top = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).join(F.broadcast(names), "place").select("query_id", "rank", "vec_id", "score")
        top = common.save(spark, top, "nearest") if rounds > 1 else top
        found = top if found is None else found.unionByName(top)
    return found if found is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
