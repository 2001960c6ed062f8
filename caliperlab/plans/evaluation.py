"""Queries of rater agreement and detector scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import agreement
from ..sources.tables import table


def _raters(spark: SparkSession, sf: str) -> DataFrame:
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels")
    return d.join(lab, "doc_id").select("doc_id", "quality", "toxic", (F.col("n_chars") > 800).cast("int").alias("rule"), F.concat("lang", F.lit("-"), F.col("quality").cast("string")).alias("a"), F.concat("lang", F.lit("-"), (F.col("n_chars") > 800).cast("int").cast("string")).alias("b"))


_R = "r AS (SELECT d.doc_id, l.quality, l.toxic, CAST(d.n_chars > 800 AS INTEGER) AS rule, d.lang || '-' || l.quality AS a, d.lang || '-' || CAST(d.n_chars > 800 AS INTEGER) AS b FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"


def _kappa_sql(a: str, b: str, source: str = "r") -> str:
    return f"""x AS (SELECT CAST({a} AS VARCHAR) AS a, CAST({b} AS VARCHAR) AS b FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL), t AS (SELECT count(*) AS items, count(*) FILTER (a = b) AS agree FROM x),
m AS (SELECT coalesce(sum(CAST(na AS DOUBLE) * nb), 0) AS both_ FROM (SELECT a AS l, count(*) AS na FROM x GROUP BY 1) JOIN (SELECT b AS l, count(*) AS nb FROM x GROUP BY 1) USING (l)),
p AS (SELECT items, agree, agree / nullif(items, 0) AS po, both_ / nullif(CAST(items AS DOUBLE) * items, 0) AS pe FROM t, m) SELECT items, agree, round(po, 6) AS observed, round(pe, 6) AS expected, round((po - pe) / nullif(1 - pe, 0), 6) AS kappa FROM p"""


def kappa_nominal(spark: SparkSession, sf: str) -> DataFrame:
    return agreement.kappa(_raters(spark, sf), "a", "b")


def kappa_binary(spark: SparkSession, sf: str) -> DataFrame:
    return agreement.kappa(_raters(spark, sf), "quality", "rule")


def kappa_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Set-valued raters: exact sets, any overlap, and decisions one by one."""
    r = _raters(spark, sf)
    marks = lambda *on: F.array_sort(F.filter(F.array(*on), lambda x: x.isNotNull()))
    one = lambda c, n: F.when(c, F.lit(n))
    s = r.select("doc_id", marks(one(F.col("quality") == 1, 1), one(F.col("toxic") == 1, 2)).alias("x"), marks(one(F.col("rule") == 1, 1), one(F.col("doc_id") % 9 == 0, 2)).alias("y"))
    exact = s.agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("x") == F.col("y")).alias("exact"), F.count_if((F.size(F.array_intersect("x", "y")) > 0) == (F.size("x") > 0)).alias("any_match"))
    each = s.select(F.explode(F.array(F.lit(1), F.lit(2))).alias("i"), "x", "y").select(F.array_contains("x", F.col("i")).cast("int").alias("p"), F.array_contains("y", F.col("i")).cast("int").alias("q"))
    return exact.crossJoin(agreement.kappa(each, "p", "q").select(F.col("items").alias("decisions"), "agree", "kappa"))


def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "labels").groupBy("quality").pivot("toxic", [0, 1]).agg(F.count(F.lit(1)))
    return n.select("quality", F.coalesce("0", F.lit(0)).cast("long").alias("toxic_0"), F.coalesce("1", F.lit(0)).cast("long").alias("toxic_1"))


def having_single_label(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count_distinct("l_returnflag").alias("labels"), F.min("l_returnflag").alias("label"), F.bool_and(F.col("l_returnflag").eqNullSafe(F.col("l_linestatus"))).alias("same"))
    return g.where("labels = 1").select("l_orderkey", "label", "same")


def ratio_by_category(spark: SparkSession, sf: str) -> DataFrame:
    """Overlap by category: the ratio of sums, and the mean of rounded ratios by case."""
    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    j = li.join(p, li["l_partkey"] == p["p_partkey"]).groupBy("p_brand", "l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("hit"))
    return j.groupBy("p_brand").agg(F.sum("n").alias("n"), F.sum("hit").alias("hit"), F.round(F.sum("hit") / F.greatest(F.sum("n"), F.lit(1)), 6).alias("rate"), F.round(F.avg(F.round(F.col("hit") / F.col("n"), 3)), 6).alias("mean_rate"))


def detection_by_level(spark: SparkSession, sf: str) -> DataFrame:
    """Detection by context level: reviews, valid ones, hits, and distinct targets over all rows and over valid ones."""
    levels = F.array(*[F.lit(f"L{i}") for i in range(1, 6)])
    e = table(spark, sf, "events").select("event_id", "user_id", "value", F.posexplode(levels).alias("i", "level"))
    row = e.select("level", (F.col("user_id") % 50).alias("target"), F.when(F.pmod(F.col("event_id") + F.col("i"), F.lit(7)) != 0, F.col("value") > 50 - 5 * F.col("i")).alias("hit"))
    n = row.groupBy("level").agg(F.count(F.lit(1)).alias("reviews"), F.count_if(F.col("hit").isNotNull()).alias("valid"), F.count_if(F.col("hit")).alias("hits"), F.count_distinct("target").alias("targets"), F.count_distinct(F.when(F.col("hit"), F.col("target"))).alias("matched"))
    return n.select("*", F.round(100 * F.col("hits") / F.greatest("valid", F.lit(1)), 6).alias("hit_rate"), F.round(100 * F.col("matched") / F.greatest("targets", F.lit(1)), 6).alias("target_rate"))


def _findings(spark: SparkSession, sf: str) -> DataFrame:
    """Diagnostics by tool and line, back from a nested map, with their occurrence number."""
    e = table(spark, sf, "events").select((F.col("user_id") % 200).alias("case_id"), F.col("event_type").alias("tool"), F.hour("ts").alias("line"), "event_id")
    lists = e.groupBy("case_id", "tool", "line").agg(F.sort_array(F.collect_list("event_id")).alias("ids"))
    nested = lists.groupBy("case_id", "tool").agg(F.map_from_entries(F.collect_list(F.struct("line", "ids"))).alias("lines"))
    return nested.select("case_id", "tool", F.explode("lines").alias("line", "ids")).select("case_id", "tool", "line", F.posexplode("ids").alias("occurrence", "event_id"))


def finding_eval(spark: SparkSession, sf: str) -> DataFrame:
    """Findings by three states: off the changed lines none hits; of the rest, those answered hit or not, and others are open."""
    f = _findings(spark, sf).withColumn("candidate", F.col("line") % 3 == 0).withColumn("hit", F.when(~F.col("candidate"), False).when(F.col("event_id") % 5 == 0, None).otherwise(F.col("event_id") % 2 == 0))
    n = f.groupBy("tool").agg(F.count(F.lit(1)).alias("total"), F.count_if("candidate").alias("candidates"), F.count_if(F.col("hit").isNull()).alias("open"), F.count_if("hit").alias("matched"), F.count_if(~F.col("hit")).alias("not_matched"), F.max("occurrence").alias("most"))
    return n.select("tool", "total", "candidates", F.col("open").alias("unresolved"), "matched", "not_matched", F.round(F.try_divide("matched", "total"), 4).alias("rate"), (F.col("most") + 1).cast("long").alias("most"))


def chunk_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of 25 findings of a case, in lexical order of their ids."""
    f = _findings(spark, sf).select("case_id", F.concat_ws("|", F.col("case_id").cast("string"), "tool", F.col("line").cast("string"), F.col("occurrence").cast("string")).alias("finding"))
    k = F.floor((F.row_number().over(Window.partitionBy("case_id").orderBy("finding")) - 1) / 25)
    return f.withColumn("chunk", k).groupBy("case_id", "chunk").agg(F.count(F.lit(1)).alias("n"), F.min("finding").alias("first_finding"))


def mode_level_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """Outputs by mode with issues, without, and empty, from the number of headers in their text."""
    text = F.when(F.col("event_id") % 6 == 0, F.lit("")).otherwise(F.repeat(F.lit("issue_header x "), (F.col("user_id") % 3).cast("int")))
    n = F.when(text == "", F.when(F.col("event_id") % 6 == 0, -1).otherwise(0)).otherwise(((F.length(text) - F.length(F.replace(text, F.lit("issue_header"), F.lit("")))) / 12).cast("int"))
    e = table(spark, sf, "events").select("event_type", n.alias("issues"))
    return e.groupBy("event_type").agg(F.count_if(F.col("issues") > 0).alias("with_issues"), F.count_if(F.col("issues") == 0).alias("without"), F.count_if(F.col("issues") < 0).alias("empty"), F.sum("issues").alias("total"))


_F = """e AS (SELECT user_id % 200 AS case_id, event_type AS tool, CAST(hour(ts) AS INTEGER) AS line, event_id FROM events), fi AS (SELECT *, row_number() OVER (PARTITION BY case_id, tool, line ORDER BY event_id) - 1 AS occurrence FROM e)"""
ORACLE = {
    "kappa_nominal": f"WITH {_R}, {_kappa_sql('a', 'b')}",
    "kappa_binary": f"WITH {_R}, {_kappa_sql('quality', 'rule')}",
    "kappa_sets": f"""WITH {_R}, s AS (SELECT doc_id, list_filter([CASE WHEN quality = 1 THEN 1 END, CASE WHEN toxic = 1 THEN 2 END], lambda v: v IS NOT NULL) AS x, list_filter([CASE WHEN rule = 1 THEN 1 END, CASE WHEN doc_id % 9 = 0 THEN 2 END], lambda v: v IS NOT NULL) AS y FROM r),
ex AS (SELECT count(*) AS items0, count(*) FILTER (x = y) AS exact, count(*) FILTER ((len(list_intersect(x, y)) > 0) = (len(x) > 0)) AS any_match FROM s),
ea AS (SELECT CAST(list_contains(x, i) AS INTEGER) AS p0, CAST(list_contains(y, i) AS INTEGER) AS q0 FROM s, (VALUES (1), (2)) v(i)), k AS (WITH {_kappa_sql('p0', 'q0', 'ea')})
SELECT items0 AS items, exact, any_match, k.items AS decisions, k.agree, k.kappa FROM ex, k""",
    "confusion_matrix": "SELECT quality, count(*) FILTER (toxic = 0) AS toxic_0, count(*) FILTER (toxic = 1) AS toxic_1 FROM labels GROUP BY quality",
    "having_single_label": "SELECT l_orderkey, min(l_returnflag) AS label, bool_and(l_returnflag IS NOT DISTINCT FROM l_linestatus) AS same FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 1",
    "ratio_by_category": "WITH j AS (SELECT p_brand, l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS hit FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL) SELECT p_brand, CAST(sum(n) AS BIGINT) AS n, CAST(sum(hit) AS BIGINT) AS hit, round(sum(hit) / greatest(sum(n), 1), 6) AS rate, round(avg(round(hit / n, 3)), 6) AS mean_rate FROM j GROUP BY 1",
    "detection_by_level": """WITH x AS (SELECT 'L' || (i + 1) AS level, user_id % 50 AS target, CASE WHEN (event_id + i) % 7 <> 0 THEN value > 50 - 5 * i END AS hit FROM events, range(5) t(i)),
n AS (SELECT level, count(*) AS reviews, count(hit) AS valid, count(*) FILTER (hit) AS hits, count(DISTINCT target) AS targets, count(DISTINCT target) FILTER (hit) AS matched FROM x GROUP BY 1) SELECT *, round(100 * hits / greatest(valid, 1), 6) AS hit_rate, round(100 * matched / greatest(targets, 1), 6) AS target_rate FROM n""",
    "finding_eval": f"""WITH {_F}, h AS (SELECT *, line % 3 = 0 AS candidate, CASE WHEN line % 3 <> 0 THEN false WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 2 = 0 END AS hit FROM fi)
SELECT tool, count(*) AS total, count(*) FILTER (candidate) AS candidates, count(*) FILTER (hit IS NULL) AS unresolved, count(*) FILTER (hit) AS matched, count(*) FILTER (NOT hit) AS not_matched, round(count(*) FILTER (hit) / nullif(count(*), 0), 4) AS rate, max(occurrence) + 1 AS most FROM h GROUP BY tool""",
    "chunk_ids": f"WITH {_F}, g AS (SELECT case_id, case_id || '|' || tool || '|' || line || '|' || occurrence AS finding FROM fi), c AS (SELECT *, (row_number() OVER (PARTITION BY case_id ORDER BY finding) - 1) // 25 AS chunk FROM g) SELECT case_id, chunk, count(*) AS n, min(finding) AS first_finding FROM c GROUP BY ALL",
    "mode_level_buckets": "WITH x AS (SELECT event_type, CASE WHEN event_id % 6 = 0 THEN -1 ELSE user_id % 3 END AS n FROM events) SELECT event_type, count(*) FILTER (n > 0) AS with_issues, count(*) FILTER (n = 0) AS without, count(*) FILTER (n < 0) AS empty, CAST(sum(n) AS BIGINT) AS total FROM x GROUP BY 1",
}
QUERIES = [kappa_nominal, kappa_binary, kappa_sets, confusion_matrix, having_single_label, ratio_by_category, detection_by_level, finding_eval, chunk_ids, mode_level_buckets]
