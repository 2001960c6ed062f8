"""Queries leave out no row of their tables."""

import os

from pyspark.sql import functions as F

from caliperlab.operators import matching, ordered
from caliperlab.plans import catalog, provenance

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows(spark, name):
    return catalog.queries()[name](spark, SF)


def test_every_row_enters(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_linenumber").distinct()
    assert rows(spark, "running_frames").count() == lines.count()
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    assert rows(spark, "szz_verdict").count() == orders.count() == rows(spark, "positional_join").count()
    assert rows(spark, "timeline").count() == orders.where("o_orderpriority = '1-URGENT'").count()
    events = spark.read.parquet(f"{SF}/events.parquet").count()
    assert {r["reviews"] for r in rows(spark, "detection_by_level").collect()} == {events}
    assert rows(spark, "changed_lines").select("l_orderkey").distinct().count() == lines.select("l_orderkey").distinct().count()


def test_each_pair_of_customers_once(spark):
    c = spark.read.parquet(f"{SF}/customer.parquet").select("c_custkey", "c_nationkey", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("seg")).collect()
    want = {(a[0], b[0]) for a in c for b in c if a[0] < b[0] and a[1] == b[1] and (a[2] is None or b[2] is None or a[2] == b[2])}
    got = [tuple(r) for r in rows(spark, "wildcard_equality_join").collect()]
    assert len(got) == len(want) and set(got) == want


def test_all_pairs_of_documents_that_share_lines(spark, tmp_path):
    lines = {1: range(9), 2: range(10), 3: range(10), 4: range(8, 12), 5: [99]}
    docs = [(d, "s", "\n".join(f"a line {i}" for i in x)) for d, x in lines.items()] + [(6, "other", "a line 1")]
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["a"], r["b"]): r["shared"] for r in catalog.queries()["shared_line_pairs"](spark, str(tmp_path)).collect()}
    assert got == {(1, 2): 9, (1, 3): 9, (2, 3): 10, (1, 4): 1, (2, 4): 2, (3, 4): 2}


def test_pairs_of_members_meet_in_blocks(spark, tmp_path):
    """Blocks of three keys give the pairs of whole groups; documents without a source have none."""
    rows = [(g, f"{g}{c}", k + 100 * i, c + 1) for i, g in enumerate("st") for c in range(5) for k in range(c, 20 - 2 * c)] + [(None, "x", 7, 1), (None, "x", 8, 1)]
    want = {}
    for g, c, k, w in rows:
        for other in (x[2] for x in rows if g and x[:2] == (g, c) and x[2] > k):
            want[k, other] = want.get((k, other), 0) + w
    df = spark.createDataFrame(rows, "g string, c string, k long, w long")
    for block in (3, 1000):
        assert {(r["a"], r["b"]): r["total"] for r in matching.member_pairs(df, "g", "c", "k", "w", block).collect()} == want
    docs = [(1, None, "a long line"), (2, None, "a long line"), (3, "s", "a long line"), (4, "s", "a long line")]
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in catalog.queries()["shared_line_pairs"](spark, str(tmp_path)).collect()] == [(3, 4, 1)]


def test_tasks_grow_with_rows(spark):
    """What one task takes stays the same for larger tables; grouping by more keys deals nothing again."""
    df = spark.range(1_000_000).selectExpr("id % 1000 as k", "id")
    for rows, tasks in ((250_000, 4), (50_000, 20)):
        dealt = ordered.spread(df, "k", task_rows=rows)
        assert dealt.rdd.getNumPartitions() == tasks
    assert dealt.groupBy("k", "id").count().drop("count")._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_siblings_where_lines_have_little(spark, tmp_path):
    """Six lines, one under the limit, one without a number: each of the others has its four largest siblings, moved up after itself."""
    rows = [(1, n, float(q)) for n, q in ((1, 9), (2, 9), (3, 30), (4, 20), (5, 10), (6, 2))] + [(1, None, 99.0), (2, 1, 7.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(r["a"], r["rank"]): r["sibling"] for r in catalog.queries()["top_siblings"](spark, str(tmp_path)).collect()}
    order = [3, 4, 5, 1, 2]
    assert got == {(a, i + 1): s for a in range(1, 7) for i, s in enumerate([x for x in order if x != a][:4])}


def test_texts_are_dealt_to_many_tasks(spark, monkeypatch):
    """Contexts are made of 20 documents a task where that is asked for, and the numbered file once for the three levels that show it."""
    monkeypatch.setattr(provenance, "TASK_TEXTS", 20)
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    plan = rows(spark, "context_levels")._jdf.queryExecution().executedPlan().toString()
    assert f", {-(-n // 20)}), REPARTITION_BY_NUM" in plan
