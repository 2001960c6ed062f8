"""Queries of commit graphs and line tracing, over orders as commits and lineitem as blamed lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import blame, lineage
from ..sources.folders import kept
from ..sources.tables import stored, table


def _parents(spark: SparkSession, sf: str) -> DataFrame:
    """Commits of each customer in order of date and key, seven a round: a mainline (0, 2, 5), a side branch (1, 3) that forks after 0 and that 6 merges,
    and a long branch (4) that goes on from round to round and merges the mainline each time."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    back = {k: F.lag("o_orderkey", k).over(order) for k in (1, 2, 3, 4, 5, 7)}
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("repo"), F.col("o_orderkey").alias("commit"), ((F.row_number().over(order) - 1) % 7).alias("r"), *[c.alias(f"b{k}") for k, c in back.items()])
    first = F.when(F.col("r").isin(2, 3), F.col("b2")).when(F.col("r") == 4, F.coalesce("b7", "b4")).when(F.col("r") == 5, F.col("b3")).otherwise(F.col("b1"))
    second = F.when(F.col("r") == 4, F.col("b5")).when(F.col("r") == 6, F.col("b3"))
    both = o.select("repo", "commit", F.posexplode(F.array(first, second)).alias("pos", "parent"))
    return both.where("parent is not null").select("repo", "commit", "parent", (F.col("pos") + 1).alias("pos"))


_PARENTS = """o AS (
  SELECT o_custkey AS repo, o_orderkey AS commit_, (row_number() OVER w - 1) % 7 AS r, lag(o_orderkey, 1) OVER w AS b1, lag(o_orderkey, 2) OVER w AS b2, lag(o_orderkey, 3) OVER w AS b3,
    lag(o_orderkey, 4) OVER w AS b4, lag(o_orderkey, 5) OVER w AS b5, lag(o_orderkey, 7) OVER w AS b7 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
tp AS (SELECT repo, commit_, CASE WHEN r IN (2, 3) THEN b2 WHEN r = 4 THEN coalesce(b7, b4) WHEN r = 5 THEN b3 ELSE b1 END AS f, CASE r WHEN 4 THEN b5 WHEN 6 THEN b3 END AS g FROM o),
par AS (SELECT repo, commit_, f AS parent, 1 AS pos FROM tp WHERE f IS NOT NULL UNION ALL SELECT repo, commit_, g, 2 FROM tp WHERE g IS NOT NULL)"""
_CLOSURE = _PARENTS + """,
nodes AS (SELECT repo, commit_ FROM par UNION SELECT repo, parent FROM par),
clo(repo, commit_, ancestor) AS (SELECT repo, commit_, commit_ FROM nodes UNION SELECT c.repo, c.commit_, p.parent FROM clo c JOIN par p ON p.repo = c.repo AND p.commit_ = c.ancestor)"""


def commit_closure(spark: SparkSession, sf: str) -> DataFrame:
    """How many ancestors each commit has (itself included), its parents and its first-parent base."""
    p = _parents(spark, sf)
    n = lineage.ancestor_counts(lineage.history(p))
    own = p.groupBy("repo", "commit").agg(F.count(F.lit(1)).alias("parents"), F.min(F.when(F.col("pos") == 1, F.col("parent"))).alias("base"))
    return n.join(own, ["repo", "commit"], "left").select("repo", F.col("commit").alias("commit_"), "ancestors", F.coalesce("parents", F.lit(0)).cast("long").alias("parents"), "base")


def descendant_touches(spark: SparkSession, sf: str) -> DataFrame:
    """Newest three later commits of a customer that touch a path of an earlier one."""
    h = lineage.history(_parents(spark, sf))
    paths_ = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("commit"), (F.col("l_partkey") % 5).alias("path")).distinct()
    dated = table(spark, sf, "orders").select(F.col("o_custkey").alias("repo"), F.col("o_orderkey").alias("commit"), F.to_date("o_orderdate").alias("day"))
    return lineage.newest_later(h, paths_.join(dated, "commit"), ["path"], ["day"], 3).select("ancestor", F.col("commit").alias("commit_"), "path", "rank")


def _bases(spark: SparkSession, sf: str, parents: DataFrame) -> DataFrame:
    """(repo, merge, parents, base, second). A change's base is its first parent; those of low priority were rebased, from the commit before that,
    and those of no priority name a base that the history has lost."""
    own = parents.groupBy("repo", F.col("commit").alias("merge")).agg(F.count(F.lit(1)).alias("parents"), F.min(F.when(F.col("pos") == 1, F.col("parent"))).alias("first"), F.min(F.when(F.col("pos") == 2, F.col("parent"))).alias("second"))
    above = parents.where("pos = 1").select("repo", F.col("commit").alias("first"), F.col("parent").alias("above"))
    given = table(spark, sf, "orders").select(F.col("o_orderkey").alias("merge"), F.col("o_orderpriority").alias("priority"))
    base = F.when(F.col("priority") == "5-LOW", F.coalesce("above", "first")).when(F.col("priority").startswith("4"), -F.col("merge")).otherwise(F.col("first"))
    return own.join(above, ["repo", "first"], "left").join(given, "merge").select("repo", "merge", "parents", base.alias("base"), "second")


def _placed_changes(spark: SparkSession, sf: str) -> tuple[lineage.History, DataFrame]:
    """The history, and each change with its base and second parent placed in it. A base that the history lacks is none."""
    p = _parents(spark, sf)
    h = lineage.history(p)
    own = _bases(spark, sf, p)
    for name in ("merge", "base", "second"):
        own = lineage.placed(own, h, name).drop(f"{name}_spans")
    return h, kept(own.withColumn("base", F.when(F.col("base_pre").isNotNull(), F.col("base"))), "changes")


def _classified(known: DataFrame) -> DataFrame:
    """Rows of changes with (slot, introducer, introducer_spans): the introducer's position to the merge."""
    for name in ("merge", "base", "second"):
        known = lineage.with_ancestry(known, name, "introducer", f"in_{name}")
    return known.select("repo", "merge", "slot", "introducer", lineage.position_class(F.col("introducer"), F.col("merge"), F.col("in_merge"), F.col("parents"), F.col("in_second"), F.col("in_base")).alias("position"))


def _positions(spark: SparkSession, sf: str, h: lineage.History, own: DataFrame) -> DataFrame:
    """Each line of a merge names a commit of its customer's history, anywhere in it, or one that isn't in it. A line's number is its slot."""
    slots = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("merge")).agg(F.collect_set(F.struct("l_linenumber")).alias("n"))
    slots = slots.select("merge", F.array_distinct(F.concat(F.transform("n", lambda x: x.l_linenumber), F.transform("n", lambda x: x.l_linenumber + 1))).alias("slots"))
    numbers = Window.partitionBy("repo")
    ranked = h.index.select("repo", F.row_number().over(numbers.orderBy("commit")).alias("rank"), F.col("commit").alias("introducer"), F.col("spans").alias("introducer_spans"))
    many = h.index.groupBy("repo").agg(F.count(F.lit(1)).alias("many"))
    # what is known of a change goes along with its slots
    asked = own.join(many, "repo").join(slots, "merge").withColumn("slot", F.explode("slots")).drop("slots")
    rank = F.when((F.col("merge") + F.col("slot")) % 11 == 0, 0).otherwise((F.col("merge") * 7 + F.col("slot") * 13) % F.col("many") + 1)
    return _classified(asked.withColumn("rank", rank).drop("many").join(ranked, ["repo", "rank"], "left"))


def _edits(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(edits, lines): one file a customer, a revision an order. It adds the order's lines, and removes half as many as the revision before added, at a place by its key."""
    n = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("added"))
    order = Window.partitionBy("file").orderBy("o_orderdate", "commit")
    o = table(spark, sf, "orders").join(n, "o_orderkey", "left").select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("commit"), "o_orderdate", F.coalesce("added", F.lit(0)).cast("long").alias("added"))
    o = o.withColumn("rev", (F.row_number().over(order) - 1).cast("long")).withColumn("removed", F.floor((F.coalesce(F.lag("added").over(order), F.lit(-1)) + 1) / 2))
    before = F.coalesce(F.sum(F.col("added") - F.col("removed")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edits = kept(o.withColumn("at", (F.col("commit") * 31) % (before - F.col("removed") + 1)).select("file", "rev", "commit", "at", "removed", "added"), "edits")
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "_file", "_row"))
    text = stored(spark, sf, "lineitem").select(F.col("l_orderkey").alias("commit"), place.alias("i"), F.concat_ws(" ", "l_returnflag", "l_linestatus", (F.col("l_partkey") % 7).cast("string")).alias("content"))
    return edits, text.join(edits, "commit").select("file", "rev", "commit", "i", (F.col("at") + F.col("i")).alias("no"), "content")


_EDITS = """ea AS (
  SELECT o_custkey AS file, o_orderkey AS commit_, o_orderdate AS dt, coalesce(n, 0) AS a FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey),
eb AS (SELECT *, row_number() OVER w - 1 AS rev, (coalesce(lag(a) OVER w, -1) + 1) // 2 AS d FROM ea WINDOW w AS (PARTITION BY file ORDER BY dt, commit_)),
ed AS (SELECT *, (commit_ * 31) % (CAST(coalesce(sum(a - d) OVER (PARTITION BY file ORDER BY rev ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) - d + 1) AS pl FROM eb),
el AS (SELECT l_orderkey AS commit_, list(l_returnflag || ' ' || l_linestatus || ' ' || (l_partkey % 7) ORDER BY l_linenumber, l_partkey) AS cs FROM lineitem GROUP BY 1),
sf(file, rev, births, texts) AS (
  SELECT DISTINCT file, CAST(-1 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS VARCHAR[]) FROM ed
  UNION ALL
  SELECT e.file, e.rev, s.births[1:e.pl] || list_transform(range(e.a), lambda x: e.rev) || s.births[e.pl + e.d + 1:], s.texts[1:e.pl] || coalesce(el.cs, []) || s.texts[e.pl + e.d + 1:]
  FROM sf s JOIN ed e ON e.file = s.file AND e.rev = s.rev + 1 LEFT JOIN el ON el.commit_ = e.commit_),
rp AS (
  SELECT e.file, e.commit_, e.rev, el.cs[k] AS content, first(s.texts[e.pl + k] ORDER BY k) AS preimage, any_value(s.births) AS births, any_value(s.texts) AS texts
  FROM ed e JOIN el ON el.commit_ = e.commit_ JOIN sf s ON s.file = e.file AND s.rev = e.rev - 1, unnest(range(1, least(e.a, e.d) + 1)) u(k) GROUP BY e.file, e.commit_, e.rev, el.cs[k]),
rw AS (SELECT rp.file AS repo, rp.commit_, rp.content, rp.preimage, w.commit_ AS writer FROM rp JOIN ed w ON w.file = rp.file AND w.rev = rp.births[list_position(rp.texts, rp.preimage)])"""


def _former_writers(edits: DataFrame, lines: DataFrame) -> DataFrame:
    """(repo, commit, content, preimage, writer), writers by commit."""
    return blame.former_writers(edits, lines.select("file", "rev", "no", "content"), "commit").withColumnRenamed("file", "repo")


def reblame_writers(spark: SparkSession, sf: str) -> DataFrame:
    """For each line that a revision put in place of another: the other's content, and who wrote the first line of that content in the file before."""
    return _former_writers(*_edits(spark, sf)).withColumnRenamed("commit", "commit_")


def position_class(spark: SparkSession, sf: str) -> DataFrame:
    """Position classes of each merge's named introducers."""
    return _positions(spark, sf, *_placed_changes(spark, sf)).groupBy("merge", "position").agg(F.count(F.lit(1)).alias("n"))


_POSITIONS = _CLOSURE + """,
own0 AS (SELECT repo, commit_ AS merge, count(*) AS parents, min(parent) FILTER (pos = 1) AS f, min(parent) FILTER (pos = 2) AS second FROM par GROUP BY ALL),
own AS (
  SELECT w.repo, w.merge, w.parents, w.second, CASE WHEN x.o_orderpriority = '5-LOW' THEN coalesce(a.parent, w.f) WHEN x.o_orderpriority LIKE '4%' THEN NULL ELSE w.f END AS base
  FROM own0 w JOIN orders x ON x.o_orderkey = w.merge LEFT JOIN par a ON a.repo = w.repo AND a.commit_ = w.f AND a.pos = 1),
nr AS (SELECT repo, commit_, row_number() OVER (PARTITION BY repo ORDER BY commit_) AS rank, count(*) OVER (PARTITION BY repo) AS many FROM nodes),
nm AS (SELECT l_orderkey AS merge, l_linenumber AS slot FROM lineitem UNION SELECT l_orderkey, l_linenumber + 1 FROM lineitem),
q AS (SELECT o.*, nm.slot, CASE WHEN (o.merge + nm.slot) % 11 = 0 THEN 0 ELSE (o.merge * 7 + nm.slot * 13) % (SELECT max(many) FROM nr WHERE nr.repo = o.repo) + 1 END AS rank FROM own o JOIN nm ON nm.merge = o.merge),
k AS (SELECT q.*, n.commit_ AS introducer, m.ancestor IS NOT NULL AS in_merge, CASE WHEN q.base IS NOT NULL THEN b.ancestor IS NOT NULL END AS in_base, CASE WHEN q.second IS NOT NULL THEN s.ancestor IS NOT NULL END AS in_second
  FROM q LEFT JOIN nr n ON n.repo = q.repo AND n.rank = q.rank LEFT JOIN clo m ON m.repo = q.repo AND m.commit_ = q.merge AND m.ancestor = n.commit_
  LEFT JOIN clo b ON b.repo = q.repo AND b.commit_ = q.base AND b.ancestor = n.commit_ LEFT JOIN clo s ON s.repo = q.repo AND s.commit_ = q.second AND s.ancestor = n.commit_),
pos AS (SELECT repo, merge, slot, introducer, CASE WHEN introducer IS NULL THEN 'UNKNOWN' WHEN introducer = merge THEN 'PR' WHEN NOT in_merge THEN 'POST_MERGE' WHEN parents >= 2 THEN (CASE WHEN NOT in_second THEN 'PRE_PR' WHEN in_base THEN 'PRE_PR' WHEN NOT in_base THEN 'PR' ELSE 'UNKNOWN' END)
  WHEN in_base THEN 'PRE_PR' WHEN NOT in_base THEN 'CONCURRENT_PR' ELSE 'UNKNOWN' END AS position FROM k)"""


def _blame(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select((F.col("l_orderkey") % 500).alias("file"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_no"), F.col("l_suppkey").alias("sha"), F.concat_ws(" ", "l_returnflag", "l_linestatus", (F.col("l_partkey") % 40).cast("string")).alias("content"))


_BLAME = "bl AS (SELECT l_orderkey % 500 AS file, l_orderkey * 10 + l_linenumber AS line_no, l_suppkey AS sha, l_returnflag || ' ' || l_linestatus || ' ' || (l_partkey % 40) AS content FROM lineitem)"


def first_match_introducer(spark: SparkSession, sf: str) -> DataFrame:
    """Introducers of each file's distinct deleted lines, with how many lines each has."""
    b = _blame(spark, sf).withColumn("sha", F.col("sha") * 1000 + F.col("line_no") % 1000)
    deleted = b.where("line_no % 3 = 0").select("file", "content").distinct()
    return lineage.first_match(deleted, b, ["file"]).groupBy("file", "introducer").agg(F.count(F.lit(1)).alias("line_count"), F.array_join(F.array_sort(F.collect_list("content")), "|").alias("lines"))


def _evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence of each deleted line of a traced change, from the position classes of its introducer and, where that came after the merge,
    of who wrote the line's former self: what the introducer's own line of that number replaced in the customer's file."""
    li, (h, own) = table(spark, sf, "lineitem"), _placed_changes(spark, sf)
    edits, text = _edits(spark, sf)
    text = kept(text, "lines")
    pos = kept(_positions(spark, sf, h, own), "positions")
    lines = li.groupBy(F.col("l_orderkey").alias("merge"), F.col("l_linenumber").alias("slot")).agg(F.max(F.col("l_quantity") > 25).alias("in_change"))
    met = lines.join(pos, ["merge", "slot"])
    later = met.where("position = 'POST_MERGE' and not in_change").select("repo", "merge", "slot", F.col("introducer").alias("commit"))
    there = later.join(edits.where("added > 0").select("commit", "added"), "commit").withColumn("i", F.try_mod(F.col("slot") - 1, "added") + 1).join(text.select("commit", "i", "content"), ["commit", "i"])
    named = there.join(_former_writers(edits, text), ["repo", "commit", "content"]).select("repo", "merge", "slot", F.col("writer").alias("introducer"))
    former = _classified(own.join(lineage.placed(named, h, "introducer").select("repo", "merge", "slot", "introducer", "introducer_spans"), ["repo", "merge"]))
    judged = met.join(former.select("merge", "slot", F.col("position").alias("earlier")), ["merge", "slot"], "left")
    return judged.select("merge", "introducer", "position", lineage.line_evidence(F.col("in_change"), F.col("position"), F.col("earlier")).alias("evidence"))


_EVIDENCE = _POSITIONS + "," + _EDITS + """,
ln AS (SELECT l_orderkey AS merge, l_linenumber AS slot, max(CAST(l_quantity > 25 AS INTEGER)) = 1 AS ic FROM lineitem GROUP BY ALL),
lt AS (SELECT p.repo, p.merge, p.slot, rw.writer FROM pos p JOIN ln ON ln.merge = p.merge AND ln.slot = p.slot AND NOT ln.ic JOIN el ON el.commit_ = p.introducer JOIN rw ON rw.commit_ = p.introducer AND rw.content = el.cs[(p.slot - 1) % len(el.cs) + 1] WHERE p.position = 'POST_MERGE'),
er AS (
  SELECT t.merge, t.slot, CASE WHEN t.writer = t.merge THEN 'PR' WHEN m.ancestor IS NOT NULL AND o.parents >= 2 AND s.ancestor IS NOT NULL AND o.base IS NOT NULL AND b.ancestor IS NULL THEN 'PR' ELSE '' END AS position
  FROM lt t JOIN own o ON o.repo = t.repo AND o.merge = t.merge LEFT JOIN clo m ON m.repo = t.repo AND m.commit_ = t.merge AND m.ancestor = t.writer LEFT JOIN clo s ON s.repo = t.repo AND s.commit_ = o.second AND s.ancestor = t.writer
    LEFT JOIN clo b ON b.repo = t.repo AND b.commit_ = o.base AND b.ancestor = t.writer),
ev AS (SELECT sl.merge, sl.introducer, sl.position, CASE WHEN ic THEN (CASE sl.position WHEN 'PR' THEN 'content+blame-confirm' WHEN 'POST_MERGE' THEN 'content+post-merge-survival' WHEN 'PRE_PR' THEN 'coincidence-refuted' WHEN 'CONCURRENT_PR' THEN 'concurrent-pr-refuted' ELSE 'unconfirmed' END)
  WHEN sl.position = 'PR' THEN 'refactor-penetration' WHEN sl.position = 'POST_MERGE' AND coalesce(er.position, '') = 'PR' THEN 'reblame-penetration' WHEN sl.position = 'POST_MERGE' THEN 'reblame-refuted' ELSE 'unrelated' END AS evidence
  FROM pos sl JOIN ln ON ln.merge = sl.merge AND ln.slot = sl.slot LEFT JOIN er ON er.merge = sl.merge AND er.slot = sl.slot)"""


def line_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return _evidence(spark, sf)


def _verdicts(spark: SparkSession, sf: str) -> DataFrame:
    ev = _evidence(spark, sf).groupBy("merge").agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("evidence").isin(*lineage.RELATED), 1)).alias("related"), F.count_distinct(F.when(F.col("position") == "PR", F.col("introducer"))).alias("own"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("merge"), F.concat(F.lit("src/f"), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 11 == 0, ".md").otherwise(".py")).alias("path"))
    j = o.join(ev, "merge", "left").na.fill(0, ["total", "related", "own"])
    code, deleted = ~paths.is_non_code(F.col("path")), F.when(F.col("merge") % 4 == 0, 0).otherwise(F.col("total"))
    v = lineage.verdict(F.col("related"), F.col("total"), F.lit(3), deleted, F.col("merge") % 8 == 0, code)
    return j.select("merge", "related", "total", "own", F.round(lineage.confidence(F.col("related"), F.col("total"), code), 6).alias("confidence"), v.alias("verdict"))


_VERDICTS = _EVIDENCE + """,
sm AS (SELECT merge, count(*) AS total, count(*) FILTER (evidence IN ('content+blame-confirm', 'content+post-merge-survival', 'refactor-penetration', 'reblame-penetration')) AS related, count(DISTINCT introducer) FILTER (position = 'PR') AS own FROM ev GROUP BY merge),
jn AS (SELECT o.o_orderkey AS merge, coalesce(related, 0) AS related, coalesce(total, 0) AS total, coalesce(own, 0) AS own, o.o_orderkey % 11 <> 0 AS code FROM orders o LEFT JOIN sm ON sm.merge = o.o_orderkey),
vd AS (SELECT merge, related, total, own, round(related / greatest(total, 1) * (CASE WHEN code THEN 1.0 ELSE 0.1 END), 6) AS confidence,
  CASE WHEN NOT code THEN 'NON_CODE_FILE' WHEN merge % 4 = 0 OR total = 0 THEN (CASE WHEN merge % 8 = 0 THEN 'PURE_ADDITIVE_NEAR' ELSE 'PURE_ADDITIVE_FAR' END)
  WHEN related >= 3 AND related / greatest(total, 1) >= 0.2 THEN 'SZZ_PASSED' WHEN related > 0 THEN 'LOW_BLAME_RATIO' ELSE 'NO_BLAME_LINEAGE' END AS verdict FROM jn)"""


def szz_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return _verdicts(spark, sf)


def verdict_counts(spark: SparkSession, sf: str) -> DataFrame:
    n = _verdicts(spark, sf).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("confidence") >= 0.2).alias("confident"))
    return n.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


ORACLE = {
    "commit_closure": f"""WITH RECURSIVE {_CLOSURE}, n AS (SELECT repo, commit_, count(*) AS ancestors FROM clo GROUP BY ALL), w AS (SELECT repo, commit_, count(*) AS parents, min(parent) FILTER (pos = 1) AS base FROM par GROUP BY ALL)
SELECT n.repo, n.commit_, n.ancestors, coalesce(w.parents, 0) AS parents, w.base FROM n LEFT JOIN w ON w.repo = n.repo AND w.commit_ = n.commit_""",
    "descendant_touches": f"""WITH RECURSIVE {_CLOSURE}, t AS (SELECT DISTINCT l_orderkey AS commit_, l_partkey % 5 AS path FROM lineitem),
j AS (SELECT c.ancestor, c.commit_, t.path, row_number() OVER (PARTITION BY c.ancestor, t.path ORDER BY CAST(x.o_orderdate AS DATE) DESC, c.commit_ DESC) AS rank
  FROM clo c JOIN t ON t.commit_ = c.commit_ JOIN t a ON a.commit_ = c.ancestor AND a.path = t.path JOIN orders x ON x.o_orderkey = c.commit_ WHERE c.commit_ <> c.ancestor)
SELECT ancestor, commit_, path, CAST(rank AS INTEGER) AS rank FROM j WHERE rank <= 3""",
    "position_class": f"WITH RECURSIVE {_POSITIONS} SELECT merge, position, count(*) AS n FROM pos GROUP BY ALL",
    "first_match_introducer": f"""WITH {_BLAME}, b AS (SELECT file, line_no, sha * 1000 + line_no % 1000 AS sha, content FROM bl), d AS (SELECT DISTINCT file, content FROM b WHERE line_no % 3 = 0), f AS (SELECT file, content, first(sha ORDER BY line_no, sha) AS introducer FROM b GROUP BY ALL)
SELECT d.file, f.introducer, count(*) AS line_count, string_agg(d.content, '|' ORDER BY d.content) AS lines FROM d LEFT JOIN f ON f.file = d.file AND f.content = d.content GROUP BY ALL""",
    "reblame_writers": f"WITH RECURSIVE {_EDITS} SELECT repo, commit_, content, preimage, writer FROM rw",
    "line_evidence": f"WITH RECURSIVE {_EVIDENCE} SELECT merge, introducer, position, evidence FROM ev",
    "szz_verdict": f"WITH RECURSIVE {_VERDICTS} SELECT * FROM vd",
    "verdict_counts": f"WITH RECURSIVE {_VERDICTS} SELECT verdict, count(*) AS n, count(*) FILTER (confidence >= 0.2) AS confident, round(100 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM vd GROUP BY verdict",
}
QUERIES = [commit_closure, descendant_touches, position_class, first_match_introducer, reblame_writers, line_evidence, szz_verdict, verdict_counts]
