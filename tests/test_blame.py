"""Traced lines, their lives and former writers against files that are rebuilt, and joins of ranges against loops."""

import random

import pytest
from pyspark.sql import functions as F

from caliperlab.operators import blame, intervals


def history(seed, files, revisions, hunks, start=0):
    """(edits, lines, states): the file after each revision as a list of (birth, number there, content); lines from before have birth None."""
    rng = random.Random(seed)
    edits, lines, states = [], [], {}
    for f in range(files):
        now = [(None, i + 1, "old") for i in range(start)]
        for r in range(revisions):
            cuts = sorted(rng.randint(0, len(now)) for _ in range(2 * rng.randint(1, hunks)))
            new, done, delta = [], 0, 0
            own = []
            for a, b in zip(cuts[::2], cuts[1::2], strict=True):
                if own and a <= own[-1][0] + own[-1][1]:
                    continue
                own.append((a, min(b - a, 4), rng.randint(0, 4)))
            for a, removed, added in own or [(0, 0, 0)]:
                new += now[done:a]
                edits.append((f, r, a, removed, added))
                for i in range(added):
                    content = rng.choice("abcde")
                    lines.append((f, r, a + delta + i + 1, content))
                    new.append((r, a + delta + i + 1, content))
                done, delta = a + removed, delta + added - removed
            now = new + now[done:]
            states[f, r] = now
    return edits, lines, states


def frames(spark, edits, lines):
    return spark.createDataFrame(edits, "file long, rev long, at long, removed long, added long").repartition(3), spark.createDataFrame(lines, "file long, rev long, no long, content string")


@pytest.mark.parametrize(("revisions", "hunks", "start"), [(37, 3, 5)])
def test_every_line_of_every_revision(spark, revisions, hunks, start):
    edits, lines, states = history(revisions, 3, revisions, hunks, start)
    want, points = {}, []
    for (f, r), now in states.items():
        for i, (birth, no, _) in enumerate(now):
            want[len(points)] = (birth, no)
            points.append((len(points), f, r, i + 1))
    e, _ = frames(spark, edits, lines)
    got = blame.trace(e, spark.createDataFrame(points, "id long, file long, rev long, pos long")).collect()
    assert len(got) == len(points) and {r["id"]: (r["birth"], r["no"]) for r in got} == want


@pytest.mark.parametrize(("seed", "hunks", "start"), [(2, 3, 0), (3, 2, 6)])
def test_lives_and_former_writers(spark, seed, hunks, start):
    edits, lines, states = history(seed, 2, 25, hunks, start)
    e, ls = frames(spark, edits, lines)
    known = {(r["file"], r["rev"], r["no"]): r for r in blame.lives(e, ls).collect()}
    assert len(known) == len(lines)
    for (f, r), now in states.items():
        own = [known[f, b, n] for b, n, _ in now if b is not None]
        assert [x["place"] for x in own] == sorted(x["place"] for x in own) and all(x["death"] is None or x["death"] > r for x in own)
    for x in known.values():
        assert x["death"] is None or (x["rev"], x["no"], x["content"]) not in states[x["file"], x["death"]]
    if start:
        return
    want = {}
    by_rev = {}
    for f, r, at, removed, added in edits:
        by_rev.setdefault((f, r), []).append((at, removed, added))
    for (f, r), hs in by_rev.items():
        before, delta = states.get((f, r - 1), []), 0
        for at, removed, added in hs:
            own = [c for ff, rr, no, c in lines if (ff, rr) == (f, r) and at + delta < no <= at + delta + added]
            for c, old in zip(own, before[at : at + removed], strict=False):
                want.setdefault((f, r, c), (old[2], next(b for b, _, x in before if x == old[2])))
            delta += added - removed
    got = {(r["file"], r["rev"], r["content"]): (r["preimage"], r["writer"]) for r in blame.former_writers(e, ls).collect()}
    assert got == want


def test_overlaps_once_each(spark):
    rng = random.Random(7)
    ranges = lambda n: [(i, rng.choice("ab"), s := rng.randint(-500, 500), s + rng.choice([-1, 0, 0, 1, 2, 7, 64, 300, 1000])) for i in range(n)]
    a, b = ranges(150), ranges(120)
    got = [(r["i"], r["j"]) for r in intervals.overlap_join(spark.createDataFrame(a, "i int, g string, s long, e long"), spark.createDataFrame(b, "j int, g string, bs long, be long"), ["g"], ("s", "e"), ("bs", "be")).collect()]
    want = {(x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] <= x[3] and y[2] <= y[3] and x[2] <= y[3] and y[2] <= x[3]}
    assert len(got) == len(want) and set(got) == want


def test_near_groups(spark):
    rng = random.Random(8)
    rows = [(g, rng.random() < 0.5, s := rng.randint(0, 4000), s + rng.randint(0, 300)) for g in range(60) for _ in range(rng.randint(1, 5))]
    got = {r["g"] for r in intervals.near_groups(spark.createDataFrame(rows, "g int, x boolean, s long, e long"), ["g"], F.col("x"), 50).collect()}
    assert got == {x[0] for x in rows for y in rows if x[0] == y[0] and x[1] and not y[1] and (abs(x[2] - y[2]) <= 50 or abs(x[3] - y[3]) <= 50)}


def test_tied_lines_stand_as_in_the_table(spark, tmp_path):
    """Lines of one number and part go by file and row, however the files are dealt to tasks: large files are read first."""
    import datetime

    from caliperlab.plans import lineage

    day = datetime.datetime(2024, 1, 1)
    spark.createDataFrame([(0, 1, "O", 1.0, day, "1-URGENT")], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    kinds = "l_orderkey long, l_linenumber int, l_partkey long, l_returnflag string, l_linestatus string"
    for i, (flag, more) in enumerate((("N", 0), ("A", 5000), ("R", 90_000))):
        one = spark.createDataFrame([(0, 1, 7, flag, "O")], kinds)
        one.unionByName(spark.range(more).selectExpr("id + 1 as l_orderkey", "1 as l_linenumber", "id as l_partkey", "'A' as l_returnflag", "'F' as l_linestatus")).coalesce(1).write.parquet(f"{tmp_path}/parts/{i}")
        (part,) = (tmp_path / "parts" / str(i)).glob("part-*.parquet")
        (tmp_path / "lineitem.parquet").mkdir(exist_ok=True)
        part.rename(tmp_path / "lineitem.parquet" / f"part-{i}.parquet")
    lines = lineage._edits(spark, str(tmp_path))[1].where("commit = 0").orderBy("i").collect()
    assert [r["content"][0] for r in lines] == ["N", "A", "R"]


def brute_writers(edits, lines, states):
    want, by_rev, texts = {}, {}, {(f, r, no): c for f, r, no, c in lines}
    for f, r, *hunk in edits:
        by_rev.setdefault((f, r), []).append(hunk)
    for (f, r), hunks in by_rev.items():
        before, delta = states.get((f, r - 1), []), 0
        for at, removed, added in sorted(hunks):
            for i in range(min(removed, added)):
                old = before[at + i][2]
                want.setdefault((f, f"c{r}", texts[f, r, at + delta + i + 1]), (old, "c" + str(next(b for b, _, x in before if x == old))))
            delta += added - removed
    return want


@pytest.mark.parametrize("small_rows", [10**6, 120, 0])
def test_small_files_are_replayed_as_large_ones_are_traced(spark, small_rows):
    """All files replayed, some, and none; revisions by name, files of different sizes, one without a number."""
    edits, lines, states = [], [], {}
    for n, (revisions, hunks) in enumerate([(30, 3), (9, 2), (3, 1), (14, 1)]):
        e, ls, s = history(11 + n, 1, revisions, hunks)
        edits += [(n, *x[1:]) for x in e]
        lines += [(n, *x[1:]) for x in ls]
        states |= {(n, r): now for (_, r), now in s.items()}
    e, ls = frames(spark, edits + [(None, 0, 0, 0, 1)], lines + [(None, 0, 1, "a")])
    named = e.withColumn("commit", F.concat(F.lit("c"), F.col("rev")))
    got = blame.former_writers(named, ls, "commit", small_rows).collect()
    want = brute_writers(edits, lines, states)
    assert len(got) == len(want) > 50 and {(r["file"], r["commit"], r["content"]): (r["preimage"], r["writer"]) for r in got} == want


def test_small_files_take_few_jobs(spark):
    """A job or two for the sizes, none for each bit of a revision's number."""
    from caliperlab.plans import lineage

    sc = spark.sparkContext
    sc.setJobGroup("replay", "replay")
    try:
        lineage.reblame_writers(spark, "/root/testdata/sf0.001").count()
        assert len(sc.statusTracker().getJobIdsForGroup("replay")) < 25
    finally:
        sc._jsc.clearJobGroup()


def test_lines_from_before_all_revisions(spark):
    """They are unknown: no preimage, and places below them stay right."""
    edits = [(1, 0, 4, 1, 2), (1, 1, 4, 2, 1)]
    lines = [(1, 0, 5, "x"), (1, 0, 6, "y"), (1, 1, 5, "z")]
    got = [tuple(r) for r in blame.former_writers(*frames(spark, edits, lines)).collect()]
    assert got == [(1, 1, "z", "x", 0)]
