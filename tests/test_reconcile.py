"""Reconciliation, domains, stored upserts and documents against small goldens."""

import pathlib
import random

from pyspark.sql import functions as F

from caliperlab.functions import provenance, text
from caliperlab.operators import reconcile


def test_tables_that_differ(spark):
    schema = "g string, i long, v string"
    rows = [("a", 1, "x"), ("a", 2, None), (None, 3, "y"), ("b", 4, "z"), ("b", 5, "z"), ("b", 5, "z"), ("c", None, "w")]
    got = [("a", 1, "x"), ("a", 2, "q"), ("b", 4, "z"), ("b", 4, "z"), ("b", 5, "z"), ("b", 5, "z"), ("c", None, "w"), ("d", 6, None)]
    for buckets in (1, 64):
        out = reconcile.reconcile(spark.createDataFrame(rows, schema), spark.createDataFrame(got, schema), ["g", "i"], buckets)
        assert {tuple(r) for r in out.collect()} == {("a", 2, "changed", 1), (None, 3, "missing", 0), ("b", 4, "duplicate", 2), ("d", 6, "unexpected", 1)}
    same = spark.createDataFrame(rows, schema)
    assert reconcile.reconcile(same, same.orderBy(F.rand(1)), ["g", "i"]).count() == 0
    assert reconcile.reconcile(same.limit(0), same.limit(0), ["g", "i"]).count() == 0
    assert {r["violation"] for r in reconcile.reconcile(same, same.limit(0), ["g", "i"]).collect()} == {"missing"}


def test_random_tables_against_counts(spark):
    rng = random.Random(3)
    rows = [[(rng.randint(0, 60), rng.choice("ab")) for _ in range(80)] for _ in range(2)]
    e, g = (spark.createDataFrame(r, "k long, v string") for r in rows)
    kinds = {}
    for k in range(61):
        a, b = (sorted(v for x, v in r if x == k) for r in rows)
        if a != b:
            kinds[k] = "missing" if len(b) < len(a) else "unexpected" if not a else "duplicate" if len(b) > len(a) else "changed"
    assert {r["k"]: r["violation"] for r in reconcile.reconcile(e, g, ["k"], 8).collect()} == kinds


def test_domains(spark):
    df = spark.createDataFrame([("YES", "RP1"), ("NO", "RP9"), (None, "RP9"), ("yes", "RP2")], "t string, r string")
    out = {tuple(r) for r in reconcile.domain_violations(df, {"t": ["YES", "NO"], "r": ["RP1", "RP2"]}).collect()}
    assert out == {("t", None, 1), ("t", "yes", 1), ("r", "RP9", 2)}


def test_files_without_a_key_stay(spark, tmp_path):
    path, files = str(tmp_path / "t"), lambda: {str(f.relative_to(tmp_path)) for f in pathlib.Path(tmp_path / "t").rglob("*.parquet")}
    schema, read = "k long, v string", lambda: sorted((r["k"], r["v"]) for r in spark.read.parquet(path).collect())
    reconcile.upsert_stored(spark.createDataFrame([(i, "old") for i in range(40)], schema), path, ["k"], 16)
    before = files()
    reconcile.upsert_stored(spark.createDataFrame([(3, "new"), (99, "new"), (99, "twice")], schema), path, ["k"], 16)
    assert read() == sorted([(i, "old") for i in range(40) if i != 3] + [(3, "new"), (99, "new"), (99, "twice")])
    assert len(before & files()) >= len(before) - 2
    # a write that fails leaves what was there
    now, rows = files(), read()
    bad = spark.createDataFrame([(5, "x")], schema).select("k", F.when(F.col("k") == 5, F.raise_error(F.lit("stop"))).otherwise(F.col("v")).alias("v"))
    try:
        reconcile.upsert_stored(bad, path, ["k"], 16)
    except Exception as e:  # noqa: BLE001
        assert "stop" in str(e)
    assert files() == now and read() == rows
    reconcile.upsert_stored(spark.createDataFrame([], schema), path, ["k"], 16)
    assert read() == rows


def test_issue_counts(spark):
    df = spark.createDataFrame([(None,), ("",), ("key_issues_to_review: []",), ("issue_header: a issue_header",), ("fine",)], "x string")
    assert [r["n"] for r in df.select(text.issue_count(F.col("x")).alias("n")).collect()] == [-1, -1, 0, 2, 0]


def test_fix_documents(spark):
    case = F.struct(F.lit("a.py").alias("path"), F.lit("SZZ_PASSED").alias("verdict"), F.lit(1).alias("additions"), F.lit(2).alias("deletions"), F.lit("+" + "x" * 6000).alias("patch"), F.lit("").alias("diff"))
    issues = F.array(*[F.struct(F.lit(i).alias("number"), F.lit("t" * 200).alias("title")) for i in range(4)])
    doc = lambda blind: spark.range(1).select(provenance.fix_document(F.lit("ab" * 20), F.lit("m"), F.lit("2024-01-02"), F.lit(3), F.lit("short"), F.array(case), issues, blind).alias("d")).first()["d"]
    full = doc(False)
    assert full.startswith("\n" + "─" * 50 + "\n## FIX COMMIT: ababababab\nMessage: m\nDate: 2024-01-02 | Latency: 3 days after PR merge\nLatency bucket: short\n\nFiles from this PR touched by this fix (1):\n\n  File: a.py (+1/-2 lines) [SZZ_PASSED]\n\n  ### STEP 2")
    assert "+" + "x" * 3499 + "\n... [TRUNCATED: PR patch too long, middle omitted] ...\n" + "x" * 2500 + "\n  ```\n\n  Linked issues:" in full
    assert full.endswith("    - #2: " + "t" * 150) and "STEP 3" not in full
    assert doc(True) == full.replace(" (+1/-2 lines) [SZZ_PASSED]", "")


def test_fix_documents_gathers_lines_without_texts(spark):
    from caliperlab.plans import reconcile as plans

    plan = plans.fix_documents(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    at = plan.index("collect_list(") + len("collect_list(")
    depth, end = 1, at
    while depth:
        depth += {"(": 1, ")": -1}.get(plan[end], 0)
        end += 1
    assert "repeat(" in plan and "repeat(" not in plan[at:end]
    # nor is a text made below the aggregate
    assert "repeat(" not in plan[plan.index("Join") :]


def test_cut_by_bytes_is_the_cut_by_characters(spark):
    rows = [("a" * n,) for n in (0, 9, 10, 11, 40)] + [("é" * n,) for n in (5, 9, 10, 11, 30)] + [("aé" * 20,), (None,)]
    df = spark.createDataFrame(rows, "x string")
    got = [r["y"] for r in df.select(provenance._middle_cut(F.col("x"), (10, 4, 3, "|")).alias("y")).collect()]
    assert got == [x if x is None or len(x) <= 10 else x[:4] + "|" + x[-3:] for (x,) in rows]


def test_fix_documents_counts_no_characters(spark):
    """Their number follows from bytes, and cuts are by bytes, made once: the steps hold each step's cut one time."""
    import re

    from caliperlab.plans import reconcile as plans

    plan = plans.fix_documents(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "octet_length(" in plan and not re.search(r"(?<!octet_)length\(", plan)
    df = spark.createDataFrame([(n,) for n in (0, 1, 5999, 6000, 6001, 8000, 8001, 20_000)], "n int").withColumn("x", F.repeat(F.lit("a"), F.col("n")))
    got = df.select(provenance.case_steps(F.col("x"), F.col("x")).alias("a"), provenance.case_steps(F.col("x"), F.col("x"), one_byte=True).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in got) and got[0]["a"] == "" and len({len(r["a"]) for r in got}) == 7  # from 8,001 on both are cut
