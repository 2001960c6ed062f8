"""Small goldens of rules and operators."""

import pytest
from pyspark.sql import functions as F

from caliperlab.functions import dates, paths, text
from caliperlab.operators import agreement, quality, ranges


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_text_rules(spark):
    assert one(spark, text.issue_refs(F.lit("fixes #12 and closes #34 #5"))) == [5, 12, 34]
    assert one(spark, text.commit_class(F.lit('Revert "fix parser"'))) == "BUGFIX"
    assert one(spark, text.keyword_class(F.lit("prefix"))) == "bug-fix"
    assert one(spark, text.comment_lines(F.lit("--- a\n+ # x\ncode\n// y"))) == 3
    assert one(spark, text.numbered_lines(F.lit("a\nb"))) == "1 | a\n2 | b"
    assert one(spark, paths.is_non_code(F.lit("x.initial.ts"))) is True
    assert one(spark, paths.extension(F.lit("a/.gitignore"))) == ""


def test_latency(spark):
    days = [None, -1, 0, 2, 3, 30, 31, 180, 181]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "i int, d int").select("i", dates.latency_bucket(F.col("d")).alias("b"))
    assert [r["b"] for r in df.orderBy("i").collect()] == ["unknown", "unknown", "immediate", "immediate", "short", "short", "medium", "medium", "long"]


def test_windows_merge(spark):
    df = spark.createDataFrame([(1, 10, 12), (1, 60, 61)], "f int, s int, e int")
    got = sorted((r["s"], r["e"]) for r in ranges.merge_windows(df, ["f"], 5, F.lit(100)).collect())
    assert got == [(5, 17), (55, 66)]


def test_cover(spark):
    c = spark.createDataFrame([(1, "C1"), (1, "C2"), (1, "C3")], "g int, i string")
    m = spark.createDataFrame([(1, "C1"), (1, "C2"), (1, "C2")], "g int, i string")
    assert {(r["i"], r["violation"]) for r in quality.cover_violations(c, m, ["g"], "i").collect()} == {("C2", "duplicate"), ("C3", "missing")}


def test_positional_join_needs_equal_groups(spark):
    a = spark.createDataFrame([(1, 1), (1, 2)], "g int, a int")
    b = spark.createDataFrame([(1, 5)], "g int, b int")
    with pytest.raises(Exception, match="differ in size"):
        quality.positional_join(a, b, ["g"], ["a"], ["b"]).collect()


def test_kappa_golden(spark):
    cells = [("y", "y", 213), ("n", "n", 235), ("y", "n", 8), ("n", "y", 24)]
    df = spark.createDataFrame([(a, b) for a, b, n in cells for _ in range(n)], "a string, b string")
    r = agreement.kappa(df, "a", "b").first()
    assert (r["items"], r["agree"], round(r["kappa"], 3)) == (480, 448, 0.867)
    assert agreement.kappa(df.limit(0), "a", "b").first()["kappa"] is None


def test_entry_imports(spark):
    import __spark_entry__ as e

    assert {"greedy_match", "caliper_candidates"} <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() >= 0
