"""Lexical search, graph search and turn repair against brute force and on odd input."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from caliperlab.llm import graph_search, lexical_search, turn_repair

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = [(3, "a b c a"), (1, "a b c a"), (1, "a b c a"), (2, ""), (5, None), (6, "!!! ..."), (7, "word " * 300_000 + "a"), (None, "a b c a"), (8, "É é É1 \x00a_b"), (9, "b b b"), (10, "zz")]
ITEMS = [(1, "A c, a!"), (2, None), (3, ""), (4, "nothing here"), (4, "b é"), (1, "A c, a!"), (None, "word zz")]


def fold(text):
    return Counter(WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)})))


def brute_ranks(docs, items, k, once=True):
    counted = [(d, fold(t)) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n_docs, n_terms = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in counted:
            m = 100 - 90 + (90 * c.total() * n_docs) // n_terms
            weight = lambda t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
            s = sum((1 if once else n) * weight(t) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t, n in fold(text).items() if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize(("once", "round_bytes"), [(True, 300), (False, 1 << 20)])
def test_ranks_equal_brute_force(spark, once, round_bytes):
    docs = spark.createDataFrame([(d, t, 1, 2.0) for d, t in DOCS], "doc_id long, text string, item_id int, score double").repartition(3)
    items = spark.createDataFrame([(i, t, 5) for i, t in ITEMS], "item_id long, text string, rank int")
    got = lexical_search.ranked(docs, items, 3, once, round_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_ranks(DOCS, ITEMS, 3, once)


def test_ranks_over_many_blocks(spark, monkeypatch):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choices("abcdefghij", [50, 20, 10, 5, 4, 3, 2, 1, 1, 1], k=rng.randint(1, 12)))) for i in range(600)]
    items = [(i, " ".join(rng.sample("abcdefghij", 4))) for i in range(20)]
    monkeypatch.setattr(lexical_search, "PIECE", 4)
    assert lexical_search.term_counts(b"Ab ab  cd ef ef") == {b"ab": 2, b"cd": 1, b"ef": 2}
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted((tuple(r) for r in lexical_search.ranked(*frames).collect()), key=str) == brute_ranks(docs, items, 10)
    best = lexical_search.Best(1, 2)
    for block in ([3, 5, 5], [5, 1], [9]):
        best.add(0, np.array(block), np.zeros(len(block), bool), np.arange(len(block)) + 10 * len(block))
    assert [x.tolist() for x in best.held[0]] == [[9, 5], [False, False], [10, 21 - 1]]


def test_ranks_of_empty_tables(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical_search.ranked(docs.limit(0), items).count() == 0 == lexical_search.ranked(docs, items.limit(0)).count()
    assert lexical_search.ranked(docs.where("doc_id in (2, 5, 6)"), items).count() == 0


def brute_nearest(rows, k):
    out = {}
    for q, v in rows:
        found = sorted((-float(np.dot(np.array(v, float), np.array(w, float))), d) for d, w in rows if d != q and len(w) == len(v))[:k]
        out[q] = [(d, -s) for s, d in found]
    return out


def vectors(n, dim, seed, clusters=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim)) * 2
    return [(i, (centres[rng.integers(clusters)] + rng.normal(size=dim)).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize(("shard_nodes", "round_bytes"), [(500, 12_000)])
def test_nearest_by_inner_product(spark, shard_nodes, round_bytes):
    rows = vectors(2000, 24, 3)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = graph_search.nearest(df.where("vec_id % 20 = 0"), graph_search.indexed(df, shard_nodes=shard_nodes), round_bytes=round_bytes).collect()
    want, found = brute_nearest(rows, 20), {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(found) == set(range(0, 2000, 20)) and all(len(f) == 20 for f in found.values())
    exact = dict(rows)
    for q, f in found.items():
        assert f == sorted(f, key=lambda x: (-x[1], x[0])) and q not in dict(f)
        assert all(math.isclose(s, float(np.dot(np.array(exact[q], float), np.array(exact[d], float))), rel_tol=1e-9, abs_tol=1e-9) for d, s in f)
    assert np.mean([len({d for d, _ in found[q]} & {d for d, _ in want[q]}) / 20 for q in found]) >= 0.95


def test_nearest_of_copies_and_odd_vectors(spark):
    """A third of all rows is one vector; the smallest ids among equal ones are found."""
    rows = vectors(400, 8, 4)
    hot = [4.0] * 8
    rows += [(1000 + i, hot) for i in range(200)] + [(2000, [1.0, 2.0]), (2001, [2.0, 1.0]), (2020, [-0.0, 1.0]), (2021, [0.0, 1.0])]
    odd = [(3000, None), (3020, [0.0] * 8), (3040, [1.0, None] * 4), (3060, [float("inf")] * 8), (3080, [float("nan")] * 8), (None, hot), (3100, [])]
    df = spark.createDataFrame([(*r, 1) for r in rows + odd + rows[:1]], "vec_id long, embedding array<float>, rank int").repartition(5)
    found = {}
    for r in graph_search.nearest(df.where("vec_id % 20 = 0 or vec_id >= 2000"), graph_search.indexed(df, shard_nodes=150)).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    want = brute_nearest(rows, 20)
    assert set(found) == {q for q, _ in rows if q % 20 == 0 or q >= 2000}
    assert all(found[q] == [d for d, _ in want[q]] for q in found if 1000 <= q)
    assert found[2020] == [2000, 2001, 2021] and found[1000] == list(range(1001, 1021)) and len(found[0]) == 20
    assert graph_search.nearest(df.limit(0), graph_search.indexed(df)).count() == 0 == graph_search.nearest(df, graph_search.indexed(df.limit(0))).count()


def test_a_dense_cluster_takes_no_edges_from_the_rest():
    """Ten of a hundred vectors are near-equal, at equal distances: the others are found as well as they are without those."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(5000, 48))
    x[:500] = x[0] + 0.05 * rng.normal(size=(500, 48))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    edges, start = graph_search.build(graph_search.lengthened(x))
    row = {"nodes": x.tobytes(), "dim": 48, "wide": False, "id_counts": np.ones(len(x), "<i4").tobytes(), "ids": np.arange(len(x)).tobytes(), "edges": edges.astype("<i4").tobytes(), "start": start}
    own = np.concatenate([np.arange(0, 500, 20), np.arange(500, 5000, 50)])
    place, found, _ = graph_search.Shard(row).search(own, x[own].astype(float), 20)
    score = x[own].astype(float) @ x.astype(float).T
    score[np.arange(len(own)), own] = -9
    shares = [len(set(found[place == i].tolist()) & set(np.argsort(-score[i])[:20].tolist())) / 20 for i in range(len(own))]
    assert np.mean(shares[:25]) >= 0.95 and np.mean(shares[25:]) >= 0.95


def test_vectors_of_64_bits_and_a_narrow_range(spark):
    df = spark.createDataFrame([(i, [1e300 * (i + 1), 1.0]) for i in range(5)] + [(9, [1e-300, 0.0])], "vec_id long, embedding array<double>")
    got = graph_search.nearest(df.where("vec_id = 9"), graph_search.indexed(df)).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [4, 3, 2, 1, 0] and math.isclose(got[0]["score"], 5.0)


def brute_repair(rows):
    """(cost, audit, repaired) by shortest paths over (row, last role), one edit at a time."""
    import heapq

    faults, seen = [], set()
    for role, text in rows:
        last = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
        seen.add((role, text))
    heap, settled = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, out = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            return cost, audit, list(out), faults
        if (i, last, audit) in settled or cost > 3 * len(rows):
            continue
        settled.add((i, last, audit))
        after = "a" if last == "u" else "u"
        full = {"u": "user", "a": "assistant"}[after]
        heapq.heappush(heap, (cost + 2, audit + "I", i, after, (*out, (full, ""))))
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, last, out))
            if faults[i] not in ("blank", "duplicate"):
                more = faults[i] == "truncated"
                if role[:1] == after or role[:1] == "s" and last == "":
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[:1], (*out, (role, text))))
                heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, after, (*out, (full, text))))
    raise AssertionError


def conversations(seed, n, most):
    rng = random.Random(seed)
    texts = ["Yes.", "no", " \t\n", "", "Well! ", "Why?\n", "a ", None, "long. " * 50]
    return [(c if c else None, rng.choice([t, t, t + 1, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "usher"]), rng.choice(texts)) for c in range(n) for t in range(rng.randint(1, most))]


@pytest.mark.parametrize("block", [256, 2])
def test_cheapest_repair(spark, block):
    rows = conversations(11, 60, 7)
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, audit string").repartition(3)
    repaired = turn_repair.repair(df, block)
    got, digests = {r["conv_id"]: r for r in repaired.conversations.collect()}, {r[0]: r[1] for r in turn_repair.digests(repaired).collect()}
    turns = {}
    for r in repaired.turns.collect():
        turns.setdefault(r["conv_id"], []).append((r["place"], r["role"], r["text"]))
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        own = sorted(((t, role if role is not None else " ", text if text is not None else " ") for c, t, role, text in rows if c == conv), key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        cost, audit, out, faults = brute_repair([x[1:] for x in own])
        assert (r["cost"], r["audit"]) == (cost, audit), own
        assert [x[1:] for x in sorted(turns.get(conv, []))] == out and [x[0] for x in sorted(turns.get(conv, []))] == list(range(len(out)))
        assert digests.get(conv, hashlib.sha256().hexdigest()) == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in out).encode()).hexdigest()
        numbers = [x[0] for x in own if x[0] is not None]
        assert r["gaps"] == (max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0)
        assert [r[f] for f in ("blank", "duplicate", "truncated")] == [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        assert r["illegal"] == sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))


def test_a_long_conversation_and_none(spark):
    rows = [(1, i, "user" if i % 3 else "assistant", f"text {i}.") for i in range(3000)] + [(2, 0, "user", "x" * 2_000_000 + ".")]
    df = spark.createDataFrame(rows, "conv_id int, turn long, role string, text string")
    long_, plain = (turn_repair.repair(df, b) for b in (100, 4000))
    key = lambda r: sorted(map(tuple, r.conversations.collect()))
    assert key(long_) == key(plain) and sorted(map(tuple, turn_repair.digests(long_).collect())) == sorted(map(tuple, turn_repair.digests(plain).collect()))
    none = turn_repair.repair(df.limit(0))
    assert none.conversations.count() == 0 == turn_repair.digests(none).count()


def test_damage(spark):
    import zlib

    rows = [(c, t, "assistant", "A. b!") for c in [1, 2, None] for t in [*range(40), None]]
    want = []
    for c, t, role, text in rows:
        f = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if f:
            want += [(c, t, "user" if f == 4 else role, "" if f == 1 else "A b" if f == 2 else text)] * (2 if f == 3 else 1)
    got = turn_repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
