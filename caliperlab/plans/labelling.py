"""Queries of labels, checkpoints and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import quality
from ..sources.tables import table


def _valid():
    return F.col("value") > 20


def latest_valid(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return quality.latest_valid(e, ["user_id", "event_type"], ["ts", "event_id"], _valid()).select("user_id", "event_type", "event_id")


def resume_todo(spark: SparkSession, sf: str) -> DataFrame:
    """Customers without a valid answer: an order that is done and large enough. Others are asked (again)."""
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return quality.todo(table(spark, sf, "customer").select("c_custkey"), o, ["c_custkey"], (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 100_000))


def upsert_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's last event; users whose last event is an error get another number."""
    per = table(spark, sf, "events").groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.max_by("event_type", "event_id").alias("kind"))
    new = per.where("kind = 'error'").select("user_id", (F.col("event_id") + 1_000_000).alias("event_id"))
    return quality.upsert(per.drop("kind"), new, ["user_id"])


def source_precedence(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's answer from the first source that has a valid one, and how many were tried."""
    e = table(spark, sf, "events")
    tried = e.select("user_id", "event_id", "value", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("attempt")).where("attempt <= 4")
    return tried.groupBy("user_id").agg(F.min_by(F.col("event_id"), F.when(_valid(), F.col("attempt"))).alias("answer"), F.count(F.lit(1)).alias("tried"))


def _turns(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    turns = table(spark, sf, "conversations").select("conv_id", "turn")
    once = turns.where("turn % 5 <> 3")
    twice = turns.where("turn % 2 = 1 and conv_id % 3 = 0")
    extra = turns.where("turn = 0 and conv_id % 10 = 0").select("conv_id", (F.col("turn") + 1000).alias("turn"))
    return turns, once.unionByName(twice).unionByName(extra)


def exact_cover_violations(spark: SparkSession, sf: str) -> DataFrame:
    turns, members = _turns(spark, sf)
    return quality.cover_violations(turns, members, ["conv_id"], "turn")


def frame_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Expectations on sizes, unique ids and references, with the rows that break them."""
    o, c, li = (table(spark, sf, x) for x in ("orders", "customer", "lineitem"))
    checks = [
        ("orders_unique", o.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("n"))),
        ("orders_have_customer", o.join(c, o["o_custkey"] == c["c_custkey"], "left_anti").agg(F.count(F.lit(1)).alias("n"))),
        ("lines_have_order", li.join(o, li["l_orderkey"] == o["o_orderkey"], "left_anti").agg(F.count(F.lit(1)).alias("n"))),
        ("regions_are_five", table(spark, sf, "region").agg(F.abs(F.count(F.lit(1)) - 5).alias("n"))),
    ]
    out = [df.select(F.lit(name).alias("check_name"), F.col("n").cast("long").alias("violations")) for name, df in checks]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def obligation_union(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters of each conversation's turns: single ones, failed clusterings one by one, clusters, and rejects."""
    t = table(spark, sf, "conversations").select("conv_id", "turn")
    n = F.count(F.lit(1)).over(Window.partitionBy("conv_id"))
    source = F.when(F.col("n") == 2, "single").when(F.col("conv_id") % 5 == 0, "clustering_error").when(F.col("turn") % 4 == 3, "flagged_not_td").otherwise("cluster")
    kind = t.withColumn("n", n).withColumn("source", source)
    key = F.when(F.col("source") == "cluster", F.floor(F.col("turn") / 4)).when(F.col("source") == "single", F.lit(0)).otherwise(F.col("turn"))
    grouped = kind.groupBy("conv_id", "source", key.cast("long").alias("k")).agg(F.count(F.lit(1)).alias("members"), F.min("turn").alias("first_turn"))
    index = F.row_number().over(Window.partitionBy("conv_id").orderBy("first_turn", "source"))
    return grouped.select("conv_id", F.concat(F.lit("O"), index.cast("string")).alias("obligation"), "source", "members", "first_turn")


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    a = o.select((F.col("o_orderkey") % 100).alias("repo"), F.col("o_orderkey").alias("a_key"), F.col("o_orderstatus").alias("a_label"))
    first = li.groupBy("l_orderkey").agg(F.min("l_linestatus").alias("b_label"))
    keys = o.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_totalprice"))
    b = keys.join(first, "l_orderkey", "left").select((F.col("l_orderkey") % 100).alias("repo"), F.col("l_orderkey").alias("b_key"), "o_totalprice", F.coalesce("b_label", F.lit("?")).alias("b_label"))
    return a, b


def positional_join(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _sides(spark, sf)
    return quality.positional_join(a, b, ["repo"], ["a_key"], ["o_totalprice", "b_key"]).select("repo", F.col("position").cast("int").alias("position"), "a_key", "b_key")


def crosswalk_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _sides(spark, sf)
    return quality.positional_join(a, b, ["repo"], ["a_key"], ["b_key"]).where("a_label <> b_label").select("repo", "a_key", "a_label", "b_label")


def repo_report(spark: SparkSession, sf: str) -> DataFrame:
    """Tri-state labels by nation: positives, unknowns, errors and the guarded share of positives."""
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    label = F.when(F.col("o_orderstatus") == "F", "TRUE").when(F.col("o_orderstatus") == "O", "FALSE").when(F.col("o_orderkey") % 2 == 0, "UNKNOWN")
    j = o.join(c, o["o_custkey"] == c["c_custkey"]).select("c_nationkey", label.alias("label"))
    n, yes = F.count(F.lit(1)), F.count_if(F.col("label") == "TRUE")
    return j.groupBy("c_nationkey").agg(n.alias("n"), yes.alias("positive"), F.count_if(F.col("label") == "UNKNOWN").alias("unknown"), F.count_if(F.col("label").isNull()).alias("errors"), F.round(yes / F.greatest(n, F.lit(1)), 6).alias("share"))


def group_histogram(spark: SparkSession, sf: str) -> DataFrame:
    sizes = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("size"))
    hist = sizes.groupBy("size").agg(F.count(F.lit(1)).alias("groups"))
    w = Window.partitionBy()
    return hist.select("size", "groups", F.min("size").over(w).alias("least"), F.max("size").over(w).alias("most"), F.round(F.sum(F.col("size") * F.col("groups")).over(w) / F.sum("groups").over(w), 6).alias("mean"))


def member_bridge_join(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of clusters copied to their members through the member array; the last cluster of a member wins."""
    li = table(spark, sf, "lineitem")
    clusters = li.groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("members"), F.max("l_returnflag").alias("label"))
    bridge = clusters.select("l_orderkey", "label", F.explode("members").alias("part"))
    return bridge.groupBy("part").agg(F.max_by("label", "l_orderkey").alias("label"), F.count(F.lit(1)).alias("clusters"))


ORACLE = {
    "latest_valid": "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE value > 20) WHERE k = 1",
    "resume_todo": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000)",
    "upsert_merge": "SELECT user_id, max(event_id) + CASE WHEN arg_max(event_type, event_id) = 'error' THEN 1000000 ELSE 0 END AS event_id FROM events GROUP BY user_id",
    "source_precedence": "SELECT user_id, arg_min(event_id, CASE WHEN value > 20 THEN k END) AS answer, count(*) AS tried FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) WHERE k <= 4 GROUP BY user_id",
    "exact_cover_violations": """WITH m AS (SELECT conv_id, turn FROM conversations WHERE turn % 5 <> 3 UNION ALL SELECT conv_id, turn FROM conversations WHERE turn % 2 = 1 AND conv_id % 3 = 0 UNION ALL SELECT conv_id, turn + 1000 FROM conversations WHERE turn = 0 AND conv_id % 10 = 0),
n AS (SELECT conv_id, turn, count(*) AS n FROM m GROUP BY ALL), v AS (SELECT coalesce(c.conv_id, n.conv_id) AS conv_id, coalesce(c.turn, n.turn) AS turn, CASE WHEN c.conv_id IS NULL THEN 'unexpected' WHEN n.n IS NULL THEN 'missing' WHEN n.n > 1 THEN 'duplicate' END AS violation
FROM conversations c FULL JOIN n ON n.conv_id = c.conv_id AND n.turn = c.turn) SELECT * FROM v WHERE violation IS NOT NULL""",
    "frame_checks": """SELECT 'orders_unique' AS check_name, count(*) AS violations FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'orders_have_customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'lines_have_order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'regions_are_five', abs(count(*) - 5) FROM region""",
    "obligation_union": """WITH t AS (SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations), s AS (SELECT *, CASE WHEN n = 2 THEN 'single' WHEN conv_id % 5 = 0 THEN 'clustering_error' WHEN turn % 4 = 3 THEN 'flagged_not_td' ELSE 'cluster' END AS source FROM t),
g AS (SELECT conv_id, source, CAST(CASE source WHEN 'cluster' THEN floor(turn / 4) WHEN 'single' THEN 0 ELSE turn END AS BIGINT) AS k, count(*) AS members, min(turn) AS first_turn FROM s GROUP BY ALL)
SELECT conv_id, 'O' || row_number() OVER (PARTITION BY conv_id ORDER BY first_turn, source) AS obligation, source, members, first_turn FROM g""",
    "positional_join": """WITH a AS (SELECT o_orderkey % 100 AS repo, o_orderkey AS a_key, row_number() OVER (PARTITION BY o_orderkey % 100 ORDER BY o_orderkey) AS p FROM orders),
b AS (SELECT o_orderkey % 100 AS repo, o_orderkey AS b_key, row_number() OVER (PARTITION BY o_orderkey % 100 ORDER BY o_totalprice, o_orderkey) AS p FROM orders) SELECT a.repo, CAST(a.p AS INTEGER) AS position, a_key, b_key FROM a JOIN b ON a.repo = b.repo AND a.p = b.p""",
    "crosswalk_mismatch": """WITH f AS (SELECT l_orderkey, min(l_linestatus) AS b FROM lineitem GROUP BY 1) SELECT o_orderkey % 100 AS repo, o_orderkey AS a_key, o_orderstatus AS a_label, coalesce(b, '?') AS b_label FROM orders LEFT JOIN f ON l_orderkey = o_orderkey WHERE o_orderstatus <> coalesce(b, '?')""",
    "repo_report": """WITH j AS (SELECT c_nationkey, CASE WHEN o_orderstatus = 'F' THEN 'TRUE' WHEN o_orderstatus = 'O' THEN 'FALSE' WHEN o_orderkey % 2 = 0 THEN 'UNKNOWN' END AS label FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT c_nationkey, count(*) AS n, count(*) FILTER (label = 'TRUE') AS positive, count(*) FILTER (label = 'UNKNOWN') AS unknown, count(*) FILTER (label IS NULL) AS errors, round(count(*) FILTER (label = 'TRUE') / greatest(count(*), 1), 6) AS share FROM j GROUP BY 1""",
    "group_histogram": "WITH s AS (SELECT count(*) AS size FROM lineitem GROUP BY l_orderkey), h AS (SELECT size, count(*) AS groups FROM s GROUP BY 1) SELECT size, groups, min(size) OVER () AS least, max(size) OVER () AS most, round(sum(size * groups) OVER () / sum(groups) OVER (), 6) AS mean FROM h",
    "member_bridge_join": "WITH c AS (SELECT l_orderkey, max(l_returnflag) AS label FROM lineitem GROUP BY 1), b AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) SELECT l_partkey AS part, arg_max(label, b.l_orderkey) AS label, count(*) AS clusters FROM b JOIN c ON c.l_orderkey = b.l_orderkey GROUP BY 1",
}
QUERIES = [latest_valid, resume_todo, upsert_merge, source_precedence, exact_cover_violations, frame_checks, obligation_union, positional_join, crosswalk_mismatch, repo_report, group_histogram, member_bridge_join]
