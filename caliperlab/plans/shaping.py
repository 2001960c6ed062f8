"""Queries of samples, joins with defaults, predicates, frames and nested rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import ordered, sampling
from ..sources.tables import table


def round_robin_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.round_robin(table(spark, sf, "orders"), "o_orderpriority", ["o_orderkey"], 42).select("o_orderpriority", "o_orderkey", "round")


def hash_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.hash_sample(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), F.col("o_orderkey"), 100)


def budget_chunks(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("source", "doc_id", F.length("text").cast("long").alias("chars"))
    return sampling.budget_chunks(d, "source", "doc_id", "chars", 5, 12_000)


def top_siblings(spark: SparkSession, sf: str) -> DataFrame:
    """Each line's four largest siblings of its order that have content."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity").where("l_orderkey is not null and l_linenumber is not null")
    li = ordered.spread(lines, "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("q"))
    own = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.when(F.col("q") >= 5, F.col("q")).desc_nulls_last(), "l_linenumber"))
    # a line's four largest siblings are among its order's five largest; those after itself move up by one
    first = F.collect_list(F.when((F.col("q") >= 5) & (F.col("own") <= 5), F.struct(F.col("own").alias("at"), F.col("l_linenumber").alias("sibling")))).over(Window.partitionBy("l_orderkey"))
    pairs = li.withColumn("own", own).withColumn("first", first).select("l_orderkey", F.col("l_linenumber").alias("a"), "own", F.inline("first")).where("a <> sibling")
    return pairs.withColumn("rank", F.col("at") - F.when(F.col("own") < F.col("at"), 1).otherwise(0)).where("rank <= 4").select("l_orderkey", "a", "sibling", "rank")


def timeline(spark: SparkSession, sf: str) -> DataFrame:
    """Each urgent order of a customer with the customer's dated orders, itself marked; a blind form hides the status."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day"), "o_orderstatus")
    now = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey", F.col("o_orderkey").alias("current"))
    mark = F.when(F.col("o_orderkey") == F.col("current"), "* ").otherwise("- ")
    line = F.concat(mark, F.date_format("day", "yyyy-MM-dd"), F.lit(" "), F.col("o_orderkey").cast("string"))
    rows = now.join(o, "o_custkey").groupBy("current").agg(F.array_sort(F.collect_list(F.struct("day", "o_orderkey", line.alias("blind"), F.concat(line, F.lit(" "), F.col("o_orderstatus")).alias("full")))).alias("x"))
    show = lambda f: F.md5(F.array_join(F.transform("x", f), "\n"))
    return rows.select("current", F.size("x").cast("long").alias("n"), show(lambda r: r.blind).alias("blind"), show(lambda r: r.full).alias("full"))


def left_join_defaults(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with customer and line facts where known, else defaults; existing facts win over rebuilt ones."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer").where("c_custkey % 5 <> 0")
    n = table(spark, sf, "lineitem").where("l_quantity > 10").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("files"), F.sum("l_linenumber").alias("adds"))
    j = o.join(c, o["o_custkey"] == c["c_custkey"], "left").join(n, o["o_orderkey"] == n["l_orderkey"], "left")
    return j.select("o_orderkey", F.coalesce("c_mktsegment", F.lit("")).alias("segment"), F.coalesce("files", F.lit(0)).cast("long").alias("files"), F.coalesce("adds", F.lit(0)).cast("long").alias("adds"), F.when(F.col("c_custkey").isNull(), "rebuilt").otherwise("known").alias("origin"))


def required_join_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose required partner is missing: what a strict join would fail on."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer").where("c_nationkey <> 3")
    return o.join(c, o["o_custkey"] == c["c_custkey"], "left_anti").select("o_orderkey", "o_custkey")


def status_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """Cases through a chain of exits in fixed order: no linter, error, unsupported, file missing, ok."""
    o = table(spark, sf, "orders")
    ext = F.element_at(F.array(*[F.lit(x) for x in (".py", ".ts", ".go", ".rb", ".js")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"))
    j = o.withColumn("path", F.concat(F.lit("a/b"), ext)).join(li.where("lines > 2"), o["o_orderkey"] == li["l_orderkey"], "left")
    status = F.when(paths.linters(F.col("path")).isNull(), "skip_no_linter").when(F.col("o_totalprice").isNull() | (F.col("o_totalprice") < 5000), "error").when(paths.linters(F.col("path")) == "golangci-lint", "skip_golangci").when(F.col("lines").isNull(), "skip_file_missing").otherwise("ok")
    return j.groupBy(status.alias("status"), paths.extension(F.col("path")).alias("ext")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("final"))


def predicate_suite(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of the filters: membership, tri-state truth, blanks, a text date floor, allow list, exclusion, confidence, domain."""
    o, d = table(spark, sf, "orders"), table(spark, sf, "documents")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    a = o.agg(F.count_if(F.col("o_orderstatus").isin("F", "P")).alias("member"), F.count_if(F.when(F.col("o_orderstatus") == "F", "TRUE").otherwise("UNKNOWN") == "TRUE").alias("positive"), F.count_if(day >= "1995-01-01").alias("floor"), F.count_if(F.col("o_custkey").isin(1, 2, 3, 50)).alias("allowed"), F.count_if(~F.col("o_orderpriority").eqNullSafe("3-MEDIUM")).alias("excluded"), F.count_if(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "5-LOW")).alias("domain"))
    b = d.agg(F.count_if(F.regexp_replace("text", r"^\s+|\s+$", "") != "").alias("not_blank"), F.count_if(F.col("lang") != "en").alias("low"))
    return a.crossJoin(b)


def guarded_ratios(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("hit"), F.count_if(F.col("l_quantity") > 49).alias("n"))
    return g.select("l_suppkey", F.round(F.col("hit") / F.greatest("n", F.lit(1)), 6).alias("guarded"), F.round(F.try_divide("hit", "n"), 6).alias("nullable"), F.greatest(F.least(F.col("n"), F.lit(50)), F.lit(5)).cast("long").alias("clamped"), F.ceil(F.col("hit") * 1.5).cast("long").alias("up"))


def sorted_topn(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", "o_totalprice")


def running_frames(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("p"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    return li.select("l_orderkey", "l_linenumber", F.max("p").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("most_before"), F.count(F.when(F.col("p") % 2 == 0, 1)).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("even_so_far"))


def array_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """Sums and counts over an order's array of lines, a chosen part of a struct, and a fall-back between two shapes."""
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").cast("long").alias("adds"), F.col("l_partkey").alias("dels"))).alias("files"))
    total = lambda f: F.aggregate("files", F.lit(0).cast("long"), lambda acc, x: acc + x[f])
    text = F.when(F.col("l_orderkey") % 2 == 0, F.to_json(F.struct(F.size("files").alias("n"))))
    return li.select("l_orderkey", total("adds").alias("adds"), total("dels").alias("dels"), F.size("files").cast("long").alias("n"), F.coalesce(text, F.lit("as text")).alias("fix"), F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit("Context: "), text)).otherwise("").alias("wrapped"))


def nested_flatten(spark: SparkSession, sf: str) -> DataFrame:
    """One row a nested item of valid results; local ids out of range are dropped and mapped to turns."""
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"), F.bool_or(F.col("role") == "assistant").alias("valid"))
    local = F.array(F.lit(1), F.lit(2), F.lit(9), F.lit(-1))
    ok = F.transform(F.filter(local, lambda i: (i >= 1) & (i <= F.size("turns"))), lambda i: F.element_at("turns", i))
    return c.where("valid").select("conv_id", F.posexplode(ok).alias("i", "turn")).select(F.concat_ws(":", F.col("conv_id").cast("string"), F.concat(F.lit("O"), (F.col("i") + 1).cast("string"))).alias("key"), "turn", F.lit("YES").alias("temporal_status"))


def reblame_preimage(spark: SparkSession, sf: str) -> DataFrame:
    """The deleted line that stood where each rewritten line was added: i-th with i-th of a hunk, in the first hunk that fits."""
    li = table(spark, sf, "lineitem")
    rows = li.select((F.col("l_orderkey") % 1000).alias("diff"), F.col("l_orderkey").alias("hunk"), F.when(F.col("l_returnflag") == "R", "-").otherwise("+").alias("op"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("part"), (F.col("l_partkey") % 50).cast("string").alias("content"))
    ranked = rows.withColumn("i", F.row_number().over(Window.partitionBy("diff", "hunk", "op").orderBy("pos", "part")))
    added, removed = ranked.where("op = '+'").select("diff", "hunk", "i", "content"), ranked.where("op = '-'").select("diff", "hunk", "i", F.col("content").alias("preimage"))
    return added.join(removed, ["diff", "hunk", "i"]).groupBy("diff", "content").agg(F.min_by("preimage", F.struct("hunk", "i")).alias("preimage"))


def tumbling_events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return e.select(F.to_date("w.start").alias("day"), "event_type", "n", "total")


def session_events(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "events").groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))
    return s.select("user_id", "n", "first_event")


ORACLE = {
    "round_robin_sample": "SELECT o_orderpriority, o_orderkey, CAST(r AS INTEGER) AS round FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS r FROM orders) ORDER BY r, o_orderpriority LIMIT 42",
    "hash_sample": "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY md5('42:' || o_orderkey) LIMIT 100",
    "budget_chunks": """WITH RECURSIVE d AS (SELECT source, doc_id, length(text) AS c, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents),
g(source, doc_id, r, chunk, n, total) AS (SELECT source, doc_id, r, CAST(0 AS BIGINT), 1, c FROM d WHERE r = 1 UNION ALL
  SELECT d.source, d.doc_id, d.r, CASE WHEN g.n + 1 > 5 OR g.total + d.c > 12000 THEN g.chunk + 1 ELSE g.chunk END, CASE WHEN g.n + 1 > 5 OR g.total + d.c > 12000 THEN 1 ELSE g.n + 1 END, CASE WHEN g.n + 1 > 5 OR g.total + d.c > 12000 THEN d.c ELSE g.total + d.c END
  FROM g JOIN d ON d.source = g.source AND d.r = g.r + 1) SELECT source, doc_id, chunk FROM g""",
    "top_siblings": """WITH l AS (SELECT l_orderkey, l_linenumber, sum(l_quantity) AS q FROM lineitem GROUP BY ALL), p AS (SELECT a.l_orderkey, a.l_linenumber AS a, b.l_linenumber AS sibling, row_number() OVER (PARTITION BY a.l_orderkey, a.l_linenumber ORDER BY b.q DESC, b.l_linenumber) AS rank
FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber <> b.l_linenumber AND b.q >= 5) SELECT l_orderkey, a, sibling, CAST(rank AS INTEGER) AS rank FROM p WHERE rank <= 4""",
    "timeline": """WITH n AS (SELECT o_custkey, o_orderkey AS current FROM orders WHERE o_orderpriority = '1-URGENT'),
l AS (SELECT n.current, CAST(o.o_orderdate AS DATE) AS day, o.o_orderkey AS k, (CASE WHEN o.o_orderkey = n.current THEN '* ' ELSE '- ' END) || strftime(o.o_orderdate, '%Y-%m-%d') || ' ' || o.o_orderkey AS t, o.o_orderstatus AS s FROM n JOIN orders o ON o.o_custkey = n.o_custkey)
SELECT current, count(*) AS n, md5(string_agg(t, chr(10) ORDER BY day, k)) AS blind, md5(string_agg(t || ' ' || s, chr(10) ORDER BY day, k)) AS "full" FROM l GROUP BY current""",
    "left_join_defaults": """WITH n AS (SELECT l_orderkey, count(*) AS files, CAST(sum(l_linenumber) AS BIGINT) AS adds FROM lineitem WHERE l_quantity > 10 GROUP BY 1)
SELECT o_orderkey, coalesce(c_mktsegment, '') AS segment, coalesce(files, 0) AS files, coalesce(adds, 0) AS adds, CASE WHEN c_custkey IS NULL THEN 'rebuilt' ELSE 'known' END AS origin FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 5 <> 0 LEFT JOIN n ON l_orderkey = o_orderkey""",
    "required_join_violations": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey <> 3)",
    "status_pipeline": """WITH l AS (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 2), j AS (SELECT o.*, (['.py', '.ts', '.go', '.rb', '.js'])[o_orderkey % 5 + 1] AS ext, l.l_orderkey AS f FROM orders o LEFT JOIN l ON l.l_orderkey = o.o_orderkey)
SELECT CASE WHEN ext = '.rb' THEN 'skip_no_linter' WHEN o_totalprice IS NULL OR o_totalprice < 5000 THEN 'error' WHEN ext = '.go' THEN 'skip_golangci' WHEN f IS NULL THEN 'skip_file_missing' ELSE 'ok' END AS status, ext, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS final FROM j GROUP BY 1, 2""",
    "predicate_suite": """WITH a AS (SELECT count(*) FILTER (o_orderstatus IN ('F', 'P')) AS member, count(*) FILTER (o_orderstatus = 'F') AS positive, count(*) FILTER (strftime(o_orderdate, '%Y-%m-%d') >= '1995-01-01') AS floor, count(*) FILTER (o_custkey IN (1, 2, 3, 50)) AS allowed,
  count(*) FILTER (o_orderpriority IS DISTINCT FROM '3-MEDIUM') AS excluded, count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW')) AS domain FROM orders), b AS (SELECT count(*) FILTER (regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> '') AS not_blank, count(*) FILTER (lang <> 'en') AS low FROM documents) SELECT * FROM a, b""",
    "guarded_ratios": "WITH g AS (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R') AS hit, count(*) FILTER (l_quantity > 49) AS n FROM lineitem GROUP BY 1) SELECT l_suppkey, round(hit / greatest(n, 1), 6) AS guarded, round(hit / nullif(n, 0), 6) AS nullable, greatest(least(n, 50), 5) AS clamped, CAST(ceil(hit * 1.5) AS BIGINT) AS up FROM g",
    "sorted_topn": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50",
    "running_frames": """WITH l AS (SELECT l_orderkey, l_linenumber, max(l_partkey) AS p FROM lineitem GROUP BY ALL)
SELECT l_orderkey, l_linenumber, max(p) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most_before, count(CASE WHEN p % 2 = 0 THEN 1 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS even_so_far FROM l WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)""",
    "array_summaries": """WITH g AS (SELECT l_orderkey, CAST(sum(l_linenumber) AS BIGINT) AS adds, CAST(sum(l_partkey) AS BIGINT) AS dels, count(*) AS n FROM lineitem GROUP BY 1)
SELECT *, CASE WHEN l_orderkey % 2 = 0 THEN '{"n":' || n || '}' ELSE 'as text' END AS fix, CASE WHEN l_orderkey % 2 = 0 THEN 'Context: {"n":' || n || '}' ELSE '' END AS wrapped FROM g""",
    "nested_flatten": """WITH c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r, count(*) OVER (PARTITION BY conv_id) AS n, bool_or(role = 'assistant') OVER (PARTITION BY conv_id) AS valid FROM conversations),
k AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY r) AS i FROM c WHERE valid AND r IN (1, 2, 9)) SELECT conv_id || ':O' || i AS key, turn, 'YES' AS temporal_status FROM k""",
    "reblame_preimage": """WITH r AS (SELECT l_orderkey % 1000 AS diff, l_orderkey AS hunk, CASE l_returnflag WHEN 'R' THEN '-' ELSE '+' END AS op, CAST(l_partkey % 50 AS VARCHAR) AS content, row_number() OVER (PARTITION BY l_orderkey, l_returnflag = 'R' ORDER BY l_linenumber, l_partkey) AS i FROM lineitem)
SELECT a.diff, a.content, first(d.content ORDER BY a.hunk, a.i) AS preimage FROM r a JOIN r d ON a.hunk = d.hunk AND a.i = d.i AND a.op = '+' AND d.op = '-' GROUP BY ALL""",
    "tumbling_events": "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "session_events": """WITH s AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), k AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM s)
SELECT user_id, count(*) AS n, min(event_id) AS first_event FROM k GROUP BY user_id, g""",
}
QUERIES = [round_robin_sample, hash_sample, budget_chunks, top_siblings, timeline, left_join_defaults, required_join_violations, status_pipeline, predicate_suite, guarded_ratios, sorted_topn, running_frames, array_summaries, nested_flatten, reblame_preimage, tumbling_events, session_events]
