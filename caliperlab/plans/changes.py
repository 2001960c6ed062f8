"""Queries of shared lines, ranges and diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import intervals, matching, ordered, ranges
from ..sources.folders import kept
from ..sources.tables import table


def shared_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Each document with the first holders of its stripped lines of over 5 characters within its source, and how many each holds.

    Lines that two documents share but a third had first count for the third alone; `shared_line_pairs` counts all pairs.
    """
    keyed = _line_keys(spark, sf)
    often = keyed.groupBy("source", "line").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")
    return keyed.join(often, ["source", "line"]).where("doc_id <> first_doc").groupBy("doc_id", "first_doc").agg(F.count(F.lit(1)).alias("shared"))


def shared_line_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair of documents of one source that share stripped lines of over 5 characters, with how many.

    Lines with the same holders are one class that counts for its lines. Pairs grow with the square of a line's holders; they are made in bounded blocks.
    """
    members = kept(_class_members(spark, sf), "holders")
    return matching.member_pairs(members, "source", "class", "doc_id", "lines").select("a", "b", F.col("total").alias("shared"))


def shared_line_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Shared lines as classes: lines with the same holders are one, named by its first line's digest, with a row a holder. The pairs of a class are
    all its holders with each other; rows grow with the holders, not with their pairs.
    """
    return _class_members(spark, sf).select("class", "doc_id", "holders", "lines")


def _class_members(spark: SparkSession, sf: str) -> DataFrame:
    """(source, class, doc_id, holders, lines). A class is known by the number of its holders and two sums of 64-bit hashes of them, so no row holds them all."""
    keyed = _line_keys(spark, sf)
    seen = [F.sum(F.xxhash64(F.lit(seed), "doc_id").cast("decimal(38,0)")).alias(f"h{seed}") for seed in (1, 2)]
    often = keyed.groupBy("source", "line").agg(F.count(F.lit(1)).alias("holders"), *seen).where("holders > 1")
    classes = often.groupBy("source", "holders", "h1", "h2").agg(F.min("line").alias("line"), F.count(F.lit(1)).alias("lines"))
    return keyed.join(classes, ["source", "line"]).select("source", F.col("line").alias("class"), "doc_id", "holders", "lines")


def _line_keys(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, source and the digest of each distinct stripped line of over 5 characters."""
    rows = table(spark, sf, "documents").select("doc_id", "source", F.explode(text.code_lines(F.col("text"))).alias("line"))
    return rows.select("doc_id", "source", F.md5("line").alias("line"))


def comment_line_counts(spark: SparkSession, sf: str) -> DataFrame:
    sign = F.element_at(F.array(*[F.lit(x) for x in ("# ", "+ // ", "", "- ", "--- ", "*", "+", "  ")]), (F.col("doc_id") % 8 + 1).cast("int"))
    made = F.concat(sign, F.col("source"), F.lit("\n"), F.col("text"))
    return table(spark, sf, "documents").select("doc_id", text.comment_lines(made).alias("comments"))


def _ranges(spark: SparkSession, sf: str) -> DataFrame:
    start = (F.col("l_partkey") % 400 + 1).cast("long")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", start.alias("s"), (start + 15).alias("e"))


_RANGES = "r AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_partkey % 400 + 1 AS s, l_partkey % 400 + 16 AS e FROM lineitem)"


def proximity_exists(spark: SparkSession, sf: str) -> DataFrame:
    """Whether an order's added ranges start or end within 50 lines of its others."""
    r = _ranges(spark, sf).withColumn("added", F.coalesce(F.col("l_returnflag") == "N", F.lit(False)))
    near = intervals.near_groups(r, ["l_orderkey"], F.col("added"), 50).withColumn("near", F.lit(True))
    return r.select("l_orderkey").distinct().join(near, "l_orderkey", "left").select("l_orderkey", F.coalesce("near", F.lit(False)).alias("near"))


def merge_windows(spark: SparkSession, sf: str) -> DataFrame:
    return ranges.merge_windows(_ranges(spark, sf), ["l_orderkey"], 40, F.lit(400).cast("long"))


def _diffs(spark: SparkSession, sf: str) -> DataFrame:
    """A small diff for each order, made from its lines: kept, deleted and added ones in two hunks."""
    li = ordered.spread(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag"), "l_orderkey")
    sign = F.when(F.col("l_returnflag") == "R", "-").when(F.col("l_returnflag") == "A", "+").otherwise(" ")
    line = F.concat(sign, F.lit("part "), F.col("l_partkey").cast("string"))
    rows = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag", line.alias("t")))).alias("x"))
    body = F.array_join(F.transform("x", lambda r: r.t), "\n")
    return rows.select("l_orderkey", F.concat(F.lit("--- a\n+++ b\n@@ -10,3 +12,4 @@ f\n"), body, F.lit("\n@@ -40 +50 @@\n-old\n+new\n\\ No newline at end of file")).alias("diff"))


_DIFF_ROWS = """li AS (SELECT l_orderkey, 1 AS hunk, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag) AS i, CASE l_returnflag WHEN 'R' THEN '-' WHEN 'A' THEN '+' ELSE ' ' END AS op, 'part ' || l_partkey AS text FROM lineitem),
h AS (SELECT * FROM li UNION ALL SELECT DISTINCT l_orderkey, 2, 1, '-', 'old' FROM li UNION ALL SELECT DISTINCT l_orderkey, 2, 2, '+', 'new' FROM li),
d AS (SELECT *, CASE WHEN op <> '+' THEN (CASE hunk WHEN 1 THEN 10 ELSE 40 END) + coalesce(sum(CASE WHEN op <> '+' THEN 1 ELSE 0 END) OVER w, 0) END AS old_no,
  CASE WHEN op <> '-' THEN (CASE hunk WHEN 1 THEN 12 ELSE 50 END) + coalesce(sum(CASE WHEN op <> '-' THEN 1 ELSE 0 END) OVER w, 0) END AS new_no
  FROM h WINDOW w AS (PARTITION BY l_orderkey, hunk ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def changed_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Old line numbers that each diff deletes, and new ones that it adds."""
    d = ranges.diff_lines(_diffs(spark, sf), ["l_orderkey"])
    return d.where("op in ('-', '+')").select("l_orderkey", F.col("hunk").cast("int").alias("hunk"), "op", F.coalesce("old_no", "new_no").cast("long").alias("line_no"), "text")


def hunk_annotations(spark: SparkSession, sf: str) -> DataFrame:
    """Hunks with a deleted line, each line after its mark: ``>>`` where an added line of the diff has its text."""
    d = ranges.diff_lines(_diffs(spark, sf), ["l_orderkey"]).where("op <> '\\\\'")
    # one row a line all the way: what else the hunk and the diff hold is seen from it
    some = lambda op, *by: F.coalesce(F.bool_or(F.col("op") == op).over(Window.partitionBy("l_orderkey", *by)), F.lit(False))
    marked = d.withColumn("hit", some("+", "text")).withColumn("touched", some("-", "hunk")).where("touched")
    line = F.concat(F.when((F.col("op") == "-") & F.col("hit"), ">> ").otherwise("   "), F.col("op"), F.col("text"))
    shown = marked.groupBy("l_orderkey", "hunk").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("t")))).alias("x"))
    return shown.select("l_orderkey", F.col("hunk").cast("int").alias("hunk"), F.array_join(F.transform("x", lambda r: r.t), "\n").alias("shown"))


def snapshot_line_map(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of each document found in the next one of its source."""
    nxt = Window.partitionBy("source").orderBy("doc_id")
    pairs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("old"), F.lead("text").over(nxt).alias("new")).where("new is not null")
    return ranges.snapshot_map(pairs)


_STRIP = "regexp_replace(regexp_replace({x}, '^\\s+', ''), '\\s+$', '')"
_L = _STRIP.format(x="l")
_KEYS = f"l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS l FROM documents), k AS (SELECT DISTINCT doc_id, source, md5({_L}) AS line FROM l WHERE length({_L}) > 5)"
ORACLE = {
    "shared_lines": f"""WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS l FROM documents), k AS (SELECT DISTINCT doc_id, source, {_L} AS line FROM l WHERE length({_L}) > 5),
f AS (SELECT source, line, min(doc_id) AS first_doc FROM k GROUP BY ALL HAVING count(*) > 1) SELECT k.doc_id, f.first_doc, count(*) AS shared FROM k JOIN f USING (source, line) WHERE k.doc_id <> f.first_doc GROUP BY ALL""",
    "shared_line_pairs": f"""WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS l FROM documents), k AS (SELECT DISTINCT doc_id, source, {_L} AS line FROM l WHERE length({_L}) > 5)
SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM k a JOIN k b ON a.source = b.source AND a.line = b.line AND a.doc_id < b.doc_id GROUP BY ALL""",
    "shared_line_classes": f"""WITH {_KEYS}, h AS (SELECT source, line, list(doc_id ORDER BY doc_id) AS docs FROM k GROUP BY ALL HAVING count(*) > 1), c AS (SELECT source, docs, min(line) AS line, count(*) AS lines FROM h GROUP BY ALL)
SELECT c.line AS class, unnest(docs) AS doc_id, len(docs) AS holders, lines FROM c""",
    "comment_line_counts": f"""WITH l AS (SELECT doc_id, unnest(string_split((['# ', '+ // ', '', '- ', '--- ', '*', '+', '  '])[doc_id % 8 + 1] || source || chr(10) || text, chr(10))) AS l FROM documents), s AS (SELECT doc_id, {_L} AS s FROM l)
SELECT doc_id, count(*) FILTER (regexp_matches(s, '^(//|#|--|/\\*|\\*|<!--|''''''|\"\"\")') OR regexp_matches(s, '^[+-]\\s*(//|#|--|/\\*|\\*|''''''|\"\"\")')) AS comments FROM s GROUP BY doc_id""",
    "proximity_exists": f"""WITH {_RANGES}, x AS (SELECT DISTINCT a.l_orderkey FROM r a JOIN r b ON a.l_orderkey = b.l_orderkey AND a.l_returnflag = 'N' AND b.l_returnflag <> 'N' AND (abs(a.s - b.s) <= 50 OR abs(a.e - b.e) <= 50))
SELECT DISTINCT r.l_orderkey, x.l_orderkey IS NOT NULL AS near FROM r LEFT JOIN x ON x.l_orderkey = r.l_orderkey""",
    "merge_windows": f"""WITH {_RANGES}, w AS (SELECT l_orderkey, greatest(1, s - 40) AS s, least(400, e + 40) AS e FROM r),
f AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS n FROM w),
i AS (SELECT *, sum(n) OVER (PARTITION BY l_orderkey ORDER BY s, e) AS k FROM f) SELECT l_orderkey, min(s) AS s, max(e) AS e FROM i GROUP BY l_orderkey, k""",
    "changed_lines": f"WITH {_DIFF_ROWS} SELECT l_orderkey, CAST(hunk AS INTEGER) AS hunk, op, CAST(coalesce(old_no, new_no) AS BIGINT) AS line_no, text FROM d WHERE op <> ' '",
    "hunk_annotations": f"""WITH {_DIFF_ROWS} SELECT l_orderkey, CAST(hunk AS INTEGER) AS hunk, string_agg((CASE WHEN op = '-' AND EXISTS (SELECT 1 FROM d x WHERE x.l_orderkey = d.l_orderkey AND x.op = '+' AND x.text = d.text) THEN '>> ' ELSE '   ' END) || op || text, chr(10) ORDER BY i) AS shown
FROM d WHERE EXISTS (SELECT 1 FROM d y WHERE y.l_orderkey = d.l_orderkey AND y.hunk = d.hunk AND y.op = '-') GROUP BY l_orderkey, hunk""",
}
QUERIES = [shared_lines, shared_line_pairs, shared_line_classes, comment_line_counts, proximity_exists, merge_windows, changed_lines, hunk_annotations, snapshot_line_map]
