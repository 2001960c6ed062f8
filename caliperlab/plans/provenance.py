"""Queries of change texts and of where facts come from: hunks, blame, commit lines, contexts, fall-back chains, reuse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths, provenance, text
from ..operators import ordered, quality, ranges
from ..sources import folders, readers
from ..sources.tables import table
from .changes import _DIFF_ROWS, _diffs


def _patches(spark: SparkSession, sf: str) -> DataFrame:
    """A patch of three hunks for each order: with counts (0 now and then), without, and inside a header that only the loose form reads."""
    k = F.col("o_orderkey")
    at = lambda n: (k % n + 1).cast("string")
    patch = F.concat(F.lit("@@ -1,2 +"), at(300), F.lit(","), (k % 4).cast("string"), F.lit(" @@ f\n+x\n@@ -7 +"), at(70), F.lit(" @@\n-y\n+z\n@@ -9, +"), at(11), F.lit(", @@"))
    return table(spark, sf, "orders").select("o_orderkey", patch.alias("patch"))


def hunk_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """New-side ranges of each patch: as counted, and as starts with a fixed reach."""
    p = _patches(spark, sf)
    counted = p.select("o_orderkey", F.lit("counted").alias("form"), F.inline(provenance.new_ranges(F.col("patch"))))
    return counted.unionByName(p.select("o_orderkey", F.lit("reach").alias("form"), F.inline(provenance.start_ranges(F.col("patch")))))


def blame_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of porcelain blame by file."""
    k = F.col("o_orderkey").cast("string")
    block = F.concat(F.left(F.sha2(k, 256), F.lit(40)), F.lit(" "), k, F.lit(" "), k, F.lit(" 1\nauthor "), F.col("o_orderstatus"), F.lit(" ann\nauthor-mail <a@b>\nfilename f.py"), F.when(F.col("o_orderkey") % 8 == 0, F.lit("")).otherwise(F.concat(F.lit("\n\t\t x ="), k, F.lit(" "))))
    files = table(spark, sf, "orders").groupBy((F.col("o_orderkey") % 5000).alias("file")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", block.alias("b")))), lambda x: x.b), "\n").alias("blame"))
    return files.select("file", F.inline(provenance.blame_entries(F.col("blame"))))


def commit_info(spark: SparkSession, sf: str) -> DataFrame:
    """Five parts of log lines, message and stat cut; no row for an empty log."""
    k = F.col("doc_id").cast("string")
    line = F.when(F.col("doc_id") % 9 == 0, "").when(F.col("doc_id") % 7 == 0, F.concat(F.md5(k), F.lit("|ann"))).otherwise(F.concat_ws("|", F.md5(k), F.lit("ann"), F.lit("a@b"), F.lit("2024-01-02 03:04:05 +0000"), F.concat(F.lit("a|b "), k)))
    rows = table(spark, sf, "documents").where("text is not null").select("doc_id", line.alias("line"), "text").where("line <> ''")
    info = rows.select("doc_id", *provenance.commit_info(F.col("line"), F.col("text"), F.concat("text", F.col("text"))))
    return info.select("doc_id", "sha", "author_name", "author_email", "author_date", "subject", F.md5("full_message").alias("message"), F.length("full_diff_stat").cast("long").alias("stat"))


def line_cut(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("text is not null")
    return d.select("doc_id", F.md5(provenance.first_lines(F.col("text"), 3)).alias("digest"), F.size(text.lines(F.col("text"))).cast("long").alias("lines"))


def additive_hunks(spark: SparkSession, sf: str) -> DataFrame:
    """Diffs with each added line marked."""
    shown = provenance.added_near(F.col("diff"))
    return _diffs(spark, sf).select("l_orderkey", F.md5(shown).alias("digest"), F.length(shown).cast("long").alias("chars"))


def candidate_view(spark: SparkSession, sf: str) -> DataFrame:
    """The compact record of each document as a case."""
    d, k = table(spark, sf, "documents").where("text is not null"), F.col("doc_id")
    fields = {"sha": F.when(k % 5 != 0, F.md5(k.cast("string"))), "message": F.when(k % 6 != 0, F.col("text")), "latency": F.when(k % 4 != 3, k % 4), "reasoning": F.col("text")}
    return d.select("doc_id", *provenance.candidate(fields)).withColumn("reasoning", F.md5("reasoning"))


def roster_patches(spark: SparkSession, sf: str) -> DataFrame:
    """Each rostered change with its metadata, which it must have: title or own one, and the patches of its files."""
    li = table(spark, sf, "lineitem")
    name, patch = F.when(F.col("l_linenumber") != 2, F.concat(F.lit("f"), F.col("l_linenumber").cast("string"))), F.when(F.col("l_returnflag") != "R", F.concat(F.lit("+"), F.col("l_partkey").cast("string")))
    files = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", name.alias("filename"), patch.alias("patch")))).alias("files"))
    roster = table(spark, sf, "orders").where("o_orderstatus <> 'P'").join(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderpriority")).alias("title"), F.col("o_orderstatus").alias("own_title"))
    met = quality.required(roster, files.withColumnRenamed("l_orderkey", "o_orderkey"), ["o_orderkey"])
    return met.select("o_orderkey", F.coalesce(F.nullif("title", F.lit("")), "own_title", F.lit("")).alias("title"), F.size("files").cast("long").alias("files"), F.md5(provenance.patch_text(F.col("files"))).alias("patch"))


def convention_files(spark: SparkSession, sf: str) -> DataFrame:
    """The first three files of the priority list that each repository has."""
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("repo"), F.element_at(F.array(*[F.lit(x) for x in provenance.CONVENTIONS]), (F.col("c_custkey") * 7 % 40 + 1).cast("int") % 16 + 1).alias("path")).distinct()
    return quality.first_existing(c, "repo", "path", provenance.CONVENTIONS, 3)


#: Tasks that the documents of one source may lie in where they meet its conventions; texts that a task takes.
DEALS, TASK_TEXTS = 64, 1000


def context_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Context of growing size for a document as a changed file: none, windows around its hunks, the numbered file, with up to
    four others of its change, with up to three convention files of its source; each within its budget of characters.

    Six neighbouring documents of a source are a change. Titles of the first sections are left out.
    """
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", "source", F.floor(F.col("doc_id") / 6).alias("change"), "text")
    n, k = F.size(text.lines(F.col("text"))), F.col("doc_id")
    numbered = lambda most: text.numbered_lines(provenance.first_lines(F.col("text"), most), gap="  ")
    patch = F.concat(F.lit("@@ -1,1 +"), F.least((k % 60 + 1).cast("int"), n).cast("string"), F.lit(","), (k % 4).cast("string"), F.lit(" @@\n@@ -5 +"), n.cast("string"), F.lit(" @@"))
    touched = d.select("doc_id", n.alias("n"), F.inline(provenance.new_ranges(patch)))
    merged = ranges.merge_windows(touched, ["doc_id", "n"], 40, F.col("n")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("windows"))
    titled = F.concat(F.lit("### `"), k.cast("string"), F.lit("` ("), n.cast("string"), F.lit(" lines)\n"), numbered(200))
    others = d.where("text <> ''").select("source", "change", k.alias("other"), F.length("text").alias("size"))
    # texts are much work: tasks take few of them, however large a file's parts are
    few = ordered.spread(table(spark, sf, "documents").select("doc_id", "source", "text"), "doc_id", task_rows=TASK_TEXTS).where("text is not null")
    titles = few.where("text <> ''").select(k.alias("other"), titled.alias("shown"))
    near = d.select("doc_id", "source", "change").join(others, ["source", "change"]).where("doc_id <> other")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("size"), "other"))
    shown = lambda order: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "shown"))), lambda x: x.shown), "\n\n")
    # texts join those that are shown
    siblings = near.withColumn("place", place).where("place <= 4").select("doc_id", "other", "place").join(titles, "other").groupBy("doc_id").agg(shown("place").alias("siblings"))
    named = d.where("text <> '' and doc_id % 50 < 16").select("source", F.element_at(F.array(*[F.lit(x) for x in provenance.CONVENTIONS]), (k % 50 + 1).cast("int")).alias("path"), "doc_id")
    first = named.groupBy("source", "path").agg(F.min("doc_id").alias("doc_id"))
    chosen = quality.first_existing(first, "source", "path", provenance.CONVENTIONS, 3).join(first, ["source", "path"])
    held = chosen.join(d.select("doc_id", F.concat(F.lit("` ("), n.cast("string"), F.lit(" lines)\n"), numbered(200)).alias("body")), "doc_id").withColumn("shown", F.concat(F.lit("### `"), F.col("path"), F.col("body")))
    conventions = held.groupBy("source").agg(shown("place").alias("conventions"))
    # a source's documents meet its conventions in many tasks
    dealt = conventions.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DEALS - 1).cast("long"))))
    all_ = few.join(merged, "doc_id", "left").join(siblings, "doc_id", "left").withColumn("deal", F.pmod(F.xxhash64("doc_id"), F.lit(DEALS))).join(dealt, ["source", "deal"], "left")
    # each is made once, and the longer ones from it
    all_ = all_.withColumn("l3", numbered(400))
    l3 = F.col("l3")
    l4 = F.concat(l3, F.coalesce(F.concat(F.lit("\n\n## Other files changed in this PR\n"), F.col("siblings")), F.lit("")))
    all_ = all_.withColumn("l4", l4)
    l4 = F.col("l4")
    l5 = F.concat(l4, F.coalesce(F.concat(F.lit("\n\n## Repository conventions / documentation\n"), F.col("conventions")), F.lit("")))
    l2 = F.coalesce(provenance.rendered(F.col("text"), F.col("windows")), F.lit(""))
    level = lambda name, x, most: F.struct(F.lit(name).alias("level"), provenance.within_budget(x, most).alias("t"))
    levels = F.array(level("L1", F.lit(""), 0), level("L2", l2, 30_000), level("L3", l3, 50_000), level("L4", l4, 65_000), level("L5", l5, 80_000))
    return all_.select("doc_id", F.inline(levels)).select("doc_id", "level", F.length("t").cast("long").alias("chars"), F.md5("t").alias("digest"))


def snapshot_source(spark: SparkSession, sf: str) -> DataFrame:
    """Merge commit and reviewed snapshot of each change by a chain of sources, with the source that gave the snapshot."""
    k, key = F.col("o_orderkey"), lambda name: F.concat(F.lit(name), F.col("o_orderkey").cast("string"))
    facts = table(spark, sf, "orders").select(k.alias("change"), F.when(k % 5 == 0, key("c")).alias("cached_merge"), F.when(k % 3 == 0, key("h")).alias("cached_head"), F.when(k % 4 != 1, key("g")).alias("found_merge"), F.when(k % 7 == 0, 2).otherwise(1).alias("parents"), F.when(k % 2 == 0, key("a")).alias("fresh_merge"), F.when(k % 11 < 4, key("f")).alias("fresh_head"))
    merge = F.coalesce("cached_merge", "found_merge", "fresh_merge")
    second = F.when((F.col("parents") >= 2) & merge.isNotNull(), F.concat(F.lit("p"), k.cast("string")))
    rest = F.when(merge.isNotNull(), F.coalesce("fresh_head", merge)).otherwise(F.col("fresh_head"))
    source = F.when(F.col("cached_head").isNotNull(), "github_head").when(second.isNotNull(), "merge_second_parent_local").when(F.col("fresh_head").isNotNull(), "github_head").when(merge.isNotNull(), "single_parent_merge_fallback").otherwise("unresolved")
    return facts.withColumn("o_orderkey", F.col("change")).select("change", merge.alias("merge_sha"), F.coalesce("cached_head", second, rest).alias("snapshot_sha"), source.alias("snapshot_source"))


def counterpart_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Valid judgements of controls, each with a made-up row of its counterpart, so that a filter on whole pairs keeps both."""
    o = table(spark, sf, "orders").where("o_orderstatus = 'O' and o_totalprice > 50000")
    own = o.select(F.lit("CONTROL").alias("cohort"), F.col("o_orderkey").alias("key"), (F.col("o_orderkey") % 4).cast("long").alias("obligations"))
    return own.unionByName(o.select(F.lit("AI").alias("cohort"), (-F.col("o_orderkey")).alias("key"), F.lit(1).cast("long").alias("obligations")))


def first_source_whole(spark: SparkSession, sf: str) -> DataFrame:
    """Valid answers of the first source that each group has: that one counts whole, also where later ones know more."""
    e = table(spark, sf, "events").select((F.col("user_id") % 97).alias("grp"), "user_id", "event_id", "value", F.when((F.col("event_type") == "click") & (F.col("user_id") % 97 < 40), 1).otherwise(2).alias("source"))
    return quality.first_source(e, "grp", "source").where("value > 20").groupBy("grp", "user_id").agg(F.max("event_id").alias("event_id"))


def checkpoint_reuse(spark: SparkSession, sf: str) -> DataFrame:
    """Which repositories' checkpoints may be taken up: all settings equal, and rows in them."""
    c = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("repo")).agg((F.max("c_custkey") % 3).alias("version"), (F.count(F.lit(1)) % 2 + 6).cast("long").alias("window"), F.count_if(F.col("c_acctbal") > 9000).alias("rows"))
    same = (F.col("version") == 2) & F.col("window").eqNullSafe(F.lit(7)) & (F.col("rows") > 0)
    return c.select("repo", F.coalesce(same, F.lit(False)).alias("reuse"))


def outputs_reused(spark: SparkSession, sf: str) -> DataFrame:
    """Old outputs of keys that the frame still has, and what is left to do."""
    frame, old = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("key")), table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.max("o_orderkey").alias("output"))
    kept = old.where("output % 3 <> 0").join(frame, "key", "left_semi")
    return kept.unionByName(frame.join(kept, "key", "left_anti").select("key", F.lit(None).cast("long").alias("output")))


def two_source_load(spark: SparkSession, sf: str) -> DataFrame:
    """A file of cases a repository and, where there is one, a second file, of which one verdict's rows come in once more."""
    path = folders.fresh(spark, "cases")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("case_id"), (F.col("o_custkey") % 20).alias("repo"), F.when(F.col("o_orderkey") % 4 == 0, "PURE_ADDITIVE_NEAR").otherwise("SZZ_PASSED").alias("verdict"))
    o.write.partitionBy("repo").json(f"{path}/enriched")
    o.where("repo < 7").write.partitionBy("repo").json(f"{path}/additive")
    cases = readers.read_with_extra(spark, f"{path}/enriched", f"{path}/additive", "case_id long, verdict string, repo long", F.col("verdict") == "PURE_ADDITIVE_NEAR")
    return cases.groupBy("repo", "verdict").agg(F.count(F.lit(1)).alias("n"))


# Columns of the table of matches, in order, by their place in the nested rows.
MATCH_COLUMNS = {
    "ai_repo": "ai.repo", "ai_number": "ai.number", "ai_merged_at": "ai.merged_at", "ai_churn": "ai.code_churn", "ai_files": "ai.changed_files",
    "control_repo": "control.repo", "control_api_repo": "control.api_repo", "control_number": "control.number", "control_merged_at": "control.merged_at",
    "control_churn": "control.code_churn", "control_files": "control.changed_files", "control_author_type": "control.author_type",
    "score": "score", "merge_day_distance": "merge_day_distance", "log_churn_distance": "log_churn_distance", "log_files_distance": "log_files_distance",
}


def flat_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Nested matches written as a flat table and read again."""
    o, path = table(spark, sf, "orders"), folders.fresh(spark, "matches")
    side = lambda sign: F.struct(F.concat(F.lit("o/r"), (F.col("o_custkey") % 9).cast("string")).alias("repo"), F.concat(F.lit("api, \"r"), (F.col("o_custkey") % 9).cast("string")).alias("api_repo"), (F.col("o_orderkey") * sign).alias("number"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("merged_at"), F.col("o_custkey").alias("code_churn"), (F.col("o_orderkey") % 30).alias("changed_files"), F.col("o_orderstatus").alias("author_type"))
    nested = o.select(side(1).alias("ai"), side(-1).alias("control"), (F.col("o_orderkey") % 8 / 8).alias("score"), (F.col("o_orderkey") % 45).alias("merge_day_distance"), F.lit(0.25).alias("log_churn_distance"), F.lit(0.5).alias("log_files_distance"))
    readers.write_csv(nested.select(*[F.col(place).alias(name) for name, place in MATCH_COLUMNS.items()]), path)
    kinds = {"ai_number": "long", "ai_churn": "long", "ai_files": "long", "control_number": "long", "control_churn": "long", "control_files": "long", "merge_day_distance": "long", "score": "double", "log_churn_distance": "double", "log_files_distance": "double"}
    return readers.read_csv(spark, path, ", ".join(f"{n} {kinds.get(n, 'string')}" for n in MATCH_COLUMNS))


def replay_languages(spark: SparkSession, sf: str) -> DataFrame:
    """The languages of each change's files in the order that they are met, and the first."""
    ext = F.element_at(F.array(*[F.lit(x) for x in (".PY", ".tsx", ".md", ".go", ".vue", "", ".h")]), (F.col("l_partkey") % 7 + 1).cast("int"))
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", paths.replay_language(F.concat(F.lit("a/f"), ext)).alias("language"))
    met = li.where("language is not null").groupBy("l_orderkey", "language").agg(F.min(F.struct("l_linenumber", "l_partkey")).alias("at"))
    all_ = met.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "language"))), lambda x: x.language).alias("x"))
    return all_.select("l_orderkey", F.col("x")[0].alias("language"), F.array_join("x", ",").alias("languages"))


_LIST = "[" + ", ".join(f"'{x}'" for x in provenance.CONVENTIONS) + "]"
_NUMBERED = "array_to_string(list_transform({x}, lambda v, i: lpad(CAST(i AS VARCHAR), CAST(length(CAST(len({x}) + 1 AS VARCHAR)) AS INTEGER), ' ') || '  ' || v), chr(10))"
_CUT = "CASE WHEN len(ls) > {n} THEN list_append(ls[1:{n}], '... [truncated: ' || len(ls) || ' lines total, showing first {n}]') ELSE ls END"
_STRIPPED = "regexp_replace(regexp_replace({x}, '^\\s+', ''), '\\s+$', '')"
ORACLE = {
    "hunk_ranges": """WITH o AS (SELECT o_orderkey, o_orderkey % 300 + 1 AS a, o_orderkey % 4 AS n, o_orderkey % 70 + 1 AS b, o_orderkey % 11 + 1 AS c FROM orders)
SELECT o_orderkey, 'counted' AS form, a AS s, a + n - 1 AS e FROM o WHERE n > 0 UNION ALL SELECT o_orderkey, 'counted', b, b FROM o
UNION ALL SELECT o_orderkey, 'reach', a, a + 15 FROM o UNION ALL SELECT o_orderkey, 'reach', b, b + 15 FROM o UNION ALL SELECT o_orderkey, 'reach', c, c + 15 FROM o""",
    "blame_parse": "SELECT o_orderkey % 5000 AS file, left(sha256(CAST(o_orderkey AS VARCHAR)), 40) AS sha, o_orderstatus || ' ann' AS author, CASE WHEN o_orderkey % 8 = 0 THEN '' ELSE 'x =' || o_orderkey END AS content FROM orders",
    "commit_info": """SELECT doc_id, md5(CAST(doc_id AS VARCHAR)) AS sha, 'ann' AS author_name, CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'a@b' END AS author_email, CASE WHEN doc_id % 7 = 0 THEN '' ELSE '2024-01-02 03:04:05 +0000' END AS author_date,
CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'a|b ' || doc_id END AS subject, md5(left(text, 2000)) AS message, least(3000, 2 * length(text)) AS stat FROM documents WHERE text IS NOT NULL AND doc_id % 9 <> 0""",
    "line_cut": f"WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL) SELECT doc_id, md5(array_to_string({_CUT.format(n=3)}, chr(10))) AS digest, len(ls) AS lines FROM d",
    "additive_hunks": f"""WITH {_DIFF_ROWS}, t AS (SELECT l_orderkey, '@@ -10,3 +12,4 @@ f' || chr(10) || string_agg(op || text || CASE WHEN op = '+' THEN '{provenance.ADDED_NEAR}' ELSE '' END, chr(10) ORDER BY i) || chr(10) || chr(10) || '@@ -40 +50 @@' || chr(10) || '-old' || chr(10) || '+new{provenance.ADDED_NEAR}' || chr(10) || '\\ No newline at end of file' || chr(10) AS t FROM li GROUP BY l_orderkey)
SELECT l_orderkey, md5(t) AS digest, length(t) AS chars FROM t""",
    "candidate_view": f"""WITH d AS (SELECT doc_id, text, CASE WHEN doc_id % 6 <> 0 AND text <> '' THEN text ELSE '?' END AS m, {_STRIPPED.format(x="text")} AS r FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN left(md5(CAST(doc_id AS VARCHAR)), 8) ELSE '?' END AS commit_short, left({_STRIPPED.format(x="replace(m, chr(10), ' ')")}, 120) AS commit_msg, CASE WHEN doc_id % 4 IN (0, 3) THEN '?' ELSE CAST(doc_id % 4 AS VARCHAR) END AS latency, md5(CASE WHEN length(r) > 280 THEN left(r, 280) || '...' ELSE r END) AS reasoning FROM d""",
    "roster_patches": """WITH f AS (SELECT l_orderkey, count(*) AS files, string_agg('### ' || CASE WHEN l_linenumber <> 2 THEN 'f' || l_linenumber ELSE '?' END || chr(10) || '+' || l_partkey, chr(10) || chr(10) ORDER BY l_linenumber, l_partkey) FILTER (l_returnflag <> 'R') AS patch FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE o_orderpriority END AS title, files, md5(coalesce(patch, '')) AS patch FROM orders JOIN f ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P'""",
    "convention_files": f"""WITH c AS (SELECT DISTINCT c_nationkey AS repo, (c_custkey * 7 % 40 + 1) % 16 + 1 AS p FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY p) AS k FROM c) SELECT repo, ({_LIST})[p] AS path, CAST(k AS INTEGER) AS place FROM r WHERE k <= 3""",
    "context_levels": f"""WITH d AS (SELECT doc_id, source, doc_id // 6 AS change, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
k AS (SELECT *, len(ls) AS n, {_CUT.format(n=400)} AS l400, {_CUT.format(n=200)} AS l200 FROM d), s AS (SELECT *, {_NUMBERED.format(x="l400")} AS n400, {_NUMBERED.format(x="l200")} AS n200 FROM k),
r AS (SELECT doc_id, n, least(doc_id % 60 + 1, n) AS s, least(doc_id % 60 + 1, n) + doc_id % 4 - 1 AS e FROM k WHERE doc_id % 4 > 0 UNION ALL SELECT doc_id, n, n, n FROM k), w AS (SELECT doc_id, greatest(1, s - 40) AS s, least(n, e + 40) AS e FROM r),
f AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS b FROM w), i AS (SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY s, e) AS g FROM f),
m AS (SELECT doc_id, min(s) AS s, max(e) AS e FROM i GROUP BY doc_id, g), x AS (SELECT m.doc_id, m.s, m.e, k.ls[m.s:m.e] AS part FROM m JOIN k ON k.doc_id = m.doc_id),
l2 AS (SELECT doc_id, string_agg('[lines ' || s || '-' || e || ']' || chr(10) || array_to_string(list_transform(part, lambda v, i: lpad(CAST(s + i - 1 AS VARCHAR), CAST(length(CAST(e + 1 AS VARCHAR)) AS INTEGER), ' ') || '  ' || v), chr(10)), chr(10) || chr(10) ORDER BY s) AS t FROM x GROUP BY doc_id),
o AS (SELECT a.doc_id, b.doc_id AS other, '### `' || b.doc_id || '` (' || b.n || ' lines)' || chr(10) || b.n200 AS t, row_number() OVER (PARTITION BY a.doc_id ORDER BY length(b.text) DESC, b.doc_id) AS p FROM s a JOIN s b ON a.source = b.source AND a.change = b.change AND a.doc_id <> b.doc_id AND b.text <> ''),
sb AS (SELECT doc_id, string_agg(t, chr(10) || chr(10) ORDER BY p) AS t FROM o WHERE p <= 4 GROUP BY 1), c0 AS (SELECT source, doc_id % 50 + 1 AS q, min(doc_id) AS doc_id FROM d WHERE text <> '' AND doc_id % 50 < 16 GROUP BY ALL), c1 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY q) AS p FROM c0),
cv AS (SELECT c1.source, string_agg('### `' || ({_LIST})[q] || '` (' || s.n || ' lines)' || chr(10) || s.n200, chr(10) || chr(10) ORDER BY p) AS t FROM c1 JOIN s ON s.doc_id = c1.doc_id WHERE p <= 3 GROUP BY 1),
l4 AS (SELECT s.*, n400 || coalesce(chr(10) || chr(10) || '## Other files changed in this PR' || chr(10) || sb.t, '') AS t4 FROM s LEFT JOIN sb ON sb.doc_id = s.doc_id),
l5 AS (SELECT l4.*, t4 || coalesce(chr(10) || chr(10) || '## Repository conventions / documentation' || chr(10) || cv.t, '') AS t5 FROM l4 LEFT JOIN cv ON cv.source = l4.source),
u AS (SELECT doc_id, 'L1' AS level, '' AS t, 0 AS b, '0' AS c FROM s UNION ALL SELECT s.doc_id, 'L2', coalesce(l2.t, ''), 30000, '30,000' FROM s LEFT JOIN l2 ON l2.doc_id = s.doc_id UNION ALL SELECT doc_id, 'L3', n400, 50000, '50,000' FROM s UNION ALL SELECT doc_id, 'L4', t4, 65000, '65,000' FROM l4 UNION ALL SELECT doc_id, 'L5', t5, 80000, '80,000' FROM l5),
v AS (SELECT *, chr(10) || chr(10) || '[PR-LEVEL CONTEXT TRUNCATED BY PRE-SPECIFIED ' || c || '-CHAR BUDGET; lower-priority suffix omitted.]' || chr(10) AS note FROM u), z AS (SELECT doc_id, level, CASE WHEN length(t) > b THEN left(t, b - length(note)) || note ELSE t END AS t FROM v)
SELECT doc_id, level, length(t) AS chars, md5(t) AS digest FROM z""",
    "snapshot_source": """WITH f AS (SELECT o_orderkey AS k, coalesce(CASE WHEN o_orderkey % 5 = 0 THEN 'c' || o_orderkey END, CASE WHEN o_orderkey % 4 <> 1 THEN 'g' || o_orderkey END, CASE WHEN o_orderkey % 2 = 0 THEN 'a' || o_orderkey END) AS m, CASE WHEN o_orderkey % 3 = 0 THEN 'h' || o_orderkey END AS h, CASE WHEN o_orderkey % 11 < 4 THEN 'f' || o_orderkey END AS n, o_orderkey % 7 = 0 AS two FROM orders)
SELECT k AS change, m AS merge_sha, CASE WHEN h IS NOT NULL THEN h WHEN two AND m IS NOT NULL THEN 'p' || k WHEN n IS NOT NULL THEN n ELSE m END AS snapshot_sha, CASE WHEN h IS NOT NULL THEN 'github_head' WHEN two AND m IS NOT NULL THEN 'merge_second_parent_local' WHEN n IS NOT NULL THEN 'github_head' WHEN m IS NOT NULL THEN 'single_parent_merge_fallback' ELSE 'unresolved' END AS snapshot_source FROM f""",
    "counterpart_rows": "SELECT 'CONTROL' AS cohort, o_orderkey AS key, o_orderkey % 4 AS obligations FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 50000 UNION ALL SELECT 'AI', -o_orderkey, 1 FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 50000",
    "first_source_whole": """WITH e AS (SELECT *, user_id % 97 AS grp, CASE WHEN event_type = 'click' AND user_id % 97 < 40 THEN 1 ELSE 2 END AS source FROM events), f AS (SELECT grp, min(source) AS source FROM e GROUP BY 1)
SELECT e.grp, user_id, max(event_id) AS event_id FROM e JOIN f ON f.grp = e.grp AND f.source = e.source WHERE value > 20 GROUP BY ALL""",
    "checkpoint_reuse": "SELECT c_nationkey AS repo, max(c_custkey) % 3 = 2 AND count(*) % 2 + 6 = 7 AND count(*) FILTER (c_acctbal > 9000) > 0 AS reuse FROM customer GROUP BY 1",
    "outputs_reused": """WITH p AS (SELECT o_custkey AS key, max(o_orderkey) AS output FROM orders GROUP BY 1) SELECT c_custkey AS key, p.output FROM customer LEFT JOIN p ON p.key = c_custkey AND p.output % 3 <> 0 WHERE c_acctbal > 0""",
    "two_source_load": "SELECT o_custkey % 20 AS repo, CASE WHEN o_orderkey % 4 = 0 THEN 'PURE_ADDITIVE_NEAR' ELSE 'SZZ_PASSED' END AS verdict, count(*) * CASE WHEN o_orderkey % 4 = 0 AND o_custkey % 20 < 7 THEN 2 ELSE 1 END AS n FROM orders GROUP BY o_custkey % 20, o_orderkey % 4 = 0, CASE WHEN o_orderkey % 4 = 0 AND o_custkey % 20 < 7 THEN 2 ELSE 1 END",
    "flat_matches": """SELECT 'o/r' || (o_custkey % 9) AS ai_repo, o_orderkey AS ai_number, strftime(o_orderdate, '%Y-%m-%d') AS ai_merged_at, o_custkey AS ai_churn, o_orderkey % 30 AS ai_files, 'o/r' || (o_custkey % 9) AS control_repo, 'api, "r' || (o_custkey % 9) AS control_api_repo, -o_orderkey AS control_number,
strftime(o_orderdate, '%Y-%m-%d') AS control_merged_at, o_custkey AS control_churn, o_orderkey % 30 AS control_files, o_orderstatus AS control_author_type, o_orderkey % 8 / 8.0 AS score, o_orderkey % 45 AS merge_day_distance, CAST(0.25 AS DOUBLE) AS log_churn_distance, CAST(0.5 AS DOUBLE) AS log_files_distance FROM orders""",
    "replay_languages": """WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, (['python', 'typescript', NULL, 'go', 'vue', NULL, 'c'])[l_partkey % 7 + 1] AS language FROM lineitem), m AS (SELECT l_orderkey, language, min(CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey) AS met FROM l WHERE language IS NOT NULL GROUP BY ALL)
SELECT l_orderkey, first(language ORDER BY met) AS language, string_agg(language, ',' ORDER BY met) AS languages FROM m GROUP BY 1""",
}
QUERIES = [hunk_ranges, blame_parse, commit_info, line_cut, additive_hunks, candidate_view, roster_patches, convention_files, context_levels, snapshot_source, counterpart_rows, first_source_whole, checkpoint_reuse, outputs_reused, two_source_load, flat_matches, replay_languages]
