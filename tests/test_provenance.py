"""Goldens of parsers and formatters of change texts, and the matcher of snapshots against the standard library."""

import difflib

import pytest
from pyspark.sql import functions as F

from caliperlab.functions import provenance, text
from caliperlab.operators import quality, ranges


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_hunk_headers(spark):
    patch = F.lit("@@ -1,2 +10,3 @@ f\n+a\n@@ -5 +20 @@\n@@ -7,1 +30,0 @@\nno @@ -1 +2")
    assert [tuple(r) for r in one(spark, provenance.new_ranges(patch))] == [(10, 12), (20, 20)]
    assert [tuple(r) for r in one(spark, provenance.start_ranges(patch))] == [(10, 25), (20, 35), (30, 45)]
    assert one(spark, provenance.new_ranges(F.lit(""))) == [] and one(spark, provenance.new_ranges(F.lit(None).cast("string"))) is None


def test_blame(spark):
    sha = "ab" * 20
    blame = f"{sha} 1 1 1\nauthor Ann Lee\nauthor-mail <x>\nfilename f\n\t  x\ty \n{sha[::-1]} 2 2\nauthor Bo\n\t\n\nnoise"
    assert [tuple(r) for r in one(spark, provenance.blame_entries(F.lit(blame)))] == [(sha, "Ann Lee", "x\ty"), (sha[::-1], "Bo", "noise")]
    assert one(spark, provenance.blame_entries(F.lit(""))) == []


def test_commit_lines(spark):
    r = spark.range(1).select(*provenance.commit_info(F.lit("s|n|m|d|a|b"), F.lit("x" * 3000), F.lit("y" * 5))).first()
    assert tuple(r[:5]) == ("s", "n", "m", "d", "a|b") and len(r["full_message"]) == 2000 and r["full_diff_stat"] == "yyyyy"
    assert tuple(spark.range(1).select(*provenance.commit_info(F.lit("s|n"), F.lit(""), F.lit(""))).first()) == ("s", "n", "", "", "", "", "")


def test_cuts_and_formats(spark):
    assert one(spark, provenance.first_lines(F.lit("a\nb\nc"), 2)) == "a\nb\n... [truncated: 3 lines total, showing first 2]"
    assert one(spark, provenance.first_lines(F.lit("a\nb"), 2)) == "a\nb"
    windows = F.array(F.struct(F.lit(2).alias("s"), F.lit(3).alias("e")), F.struct(F.lit(9).alias("s"), F.lit(9).alias("e")))
    assert one(spark, provenance.rendered(F.lit("\n".join("abcdefghi")), windows)) == "[lines 2-3]\n2  b\n3  c\n\n[lines 9-9]\n 9  i"
    files = F.array(*[F.struct(F.lit(n).cast("string").alias("filename"), F.lit(p).cast("string").alias("patch")) for n, p in (("f", "+1"), ("g", ""), (None, "+2"))])
    assert one(spark, provenance.patch_text(files)) == "### f\n+1\n\n### ?\n+2"
    assert one(spark, provenance.added_near(F.lit("h\n@@ a\n+x\n+++ y\n@@ b\n-z"))) == f"@@ a\n+x{provenance.ADDED_NEAR}\n+++ y\n\n@@ b\n-z\n"
    assert one(spark, provenance.added_near(F.lit("no hunk"))) == "" == one(spark, provenance.added_near(F.lit(None).cast("string")))
    cut = one(spark, provenance.within_budget(F.lit("x" * 500), 200))
    assert len(cut) == 200 and cut.endswith("omitted.]\n") and one(spark, provenance.within_budget(F.lit("x"), 1)) == "x"
    assert one(spark, text.strip(F.lit("  a "))) == "a"


def test_facts_are_required(spark):
    rows, facts = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x")], "k int, v string")
    with pytest.raises(Exception, match="no facts"):
        quality.required(rows, facts, ["k"]).collect()
    assert [tuple(r) for r in quality.required(rows.where("k = 1"), facts, ["k"]).collect()] == [(1, "x")]


def test_first_source_counts_whole(spark):
    rows = spark.createDataFrame([("g", 1, "bad"), ("g", 2, "good"), ("h", 2, "good")], "grp string, source int, v string")
    assert sorted(r["v"] for r in quality.first_source(rows, "grp", "source").collect()) == ["bad", "good"]


def test_first_existing(spark):
    held = spark.createDataFrame([("r", "b"), ("r", "z"), ("r", "c"), ("r", "a"), ("r", "a"), ("s", "z")], "repo string, path string")
    got = sorted((r["repo"], r["path"], r["place"]) for r in quality.first_existing(held, "repo", "path", ["a", "x", "b", "c"], 2).collect())
    assert got == [("r", "a", 1), ("r", "b", 2)]


def test_equal_ranges_share_a_window(spark):
    df = spark.createDataFrame([(1, 1, 9)] * 3 + [(1, 30, 31)], "f int, s int, e int")
    assert sorted((r["s"], r["e"]) for r in ranges.merge_windows(df, ["f"], 2, F.lit(100)).collect()) == [(1, 11), (28, 33)]


def test_snapshots_match_as_in_the_library(spark):
    pairs = [(1, "a\nb\nc", "b\nc\nd"), (2, "", ""), (3, None, "a"), (4, "x\n" * 300 + "y", "y\n" + "x\n" * 300), (5, "a\na\nb", "a\nb\na")]
    want = set()
    for k, old, new in pairs:
        for a, b, n in difflib.SequenceMatcher(None, (old or "").split("\n"), (new or "").split("\n")).get_matching_blocks():
            want |= {(k, a + i + 1, b + i + 1) for i in range(n)}
    got = [tuple(r) for r in ranges.snapshot_map(spark.createDataFrame(pairs, "id long, old string, new string")).collect()]
    assert len(got) == len(set(got)) and set(got) == want
