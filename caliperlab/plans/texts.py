"""Queries of scalar rules on texts, paths and dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, paths, text
from ..sources.tables import table

#: Commit subjects made from order keys; both engines spell them alike.
_VERBS = ["Fix", "feat: add", "Revert \"fix", "refactor:", "v1.2 release", "docs", "Merge pull request", "tests for", "Update wrong", "chore:"]


def _subjects(spark: SparkSession, sf: str) -> DataFrame:
    verb = F.element_at(F.array(*[F.lit(v) for v in _VERBS]), (F.col("o_orderkey") % 10 + 1).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.concat(verb, F.lit(" #"), F.col("o_orderkey").cast("string"), F.lit(" and closes #"), F.col("o_custkey").cast("string"), F.lit(" parser")).alias("subject"))


_SUBJECTS = """s AS (SELECT o_orderkey, o_custkey, (['Fix', 'feat: add', 'Revert "fix', 'refactor:', 'v1.2 release', 'docs', 'Merge pull request', 'tests for', 'Update wrong', 'chore:'])[o_orderkey % 10 + 1]
  || ' #' || o_orderkey || ' and closes #' || o_custkey || ' parser' AS subject FROM orders)"""


def commit_class(spark: SparkSession, sf: str) -> DataFrame:
    return _subjects(spark, sf).groupBy(text.commit_class(F.col("subject")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def keyword_class(spark: SparkSession, sf: str) -> DataFrame:
    own = _subjects(spark, sf).select(F.col("o_orderkey").alias("id"), text.keyword_class(F.col("subject")).alias("kind"))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), text.keyword_class(F.col("text")).alias("kind"))
    return own.unionByName(docs)


def issue_refs(spark: SparkSession, sf: str) -> DataFrame:
    refs = text.issue_refs(F.col("subject"))
    return _subjects(spark, sf).select("o_orderkey", F.array_join(refs.cast("array<string>"), ",").alias("refs"), F.array_join(F.slice(refs, 1, 1).cast("array<string>"), ",").alias("first_ref"))


def _paths(spark: SparkSession, sf: str) -> DataFrame:
    """Page paths with an extension by page id, grouped by host."""
    ext = F.element_at(F.array(*[F.lit(x) for x in (".py", ".ts", ".md", ".JS", ".go", "", ".json", ".x.cs")]), (F.col("page_id") % 8 + 1).cast("int"))
    rest = F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1)
    return table(spark, sf, "pages").select("page_id", (F.col("page_id") % 7).alias("repo"), F.concat(F.lit("src/"), rest, F.lit("/f"), F.col("page_id").cast("string"), ext).alias("path"))


_PATHS = """p AS (SELECT page_id, page_id % 7 AS repo, 'src/' || regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) || '/f' || page_id || (['.py', '.ts', '.md', '.JS', '.go', '', '.json', '.x.cs'])[page_id % 8 + 1] AS path FROM pages)"""
_LANG = "CASE lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in paths.LANGUAGES.items()) + " END"


def path_language_mode(spark: SparkSession, sf: str) -> DataFrame:
    """Most frequent language of each repository's paths; of equal ones the first seen."""
    lang = _paths(spark, sf).withColumn("language", paths.language(F.col("path"))).where("language is not null")
    n = lang.groupBy("repo", "language").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("seen"))
    best = n.withColumn("_r", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("n"), "seen"))).where("_r = 1")
    repos = _paths(spark, sf).select("repo").distinct()
    return repos.join(best, "repo", "left").select("repo", F.coalesce("language", F.lit("Unknown")).alias("language"))


def noncode_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _paths(spark, sf).where(~paths.is_non_code(F.col("path"))).select("page_id", paths.basename(F.col("path")).alias("name"), paths.extension(F.col("path")).alias("ext"))


def truncate_marker(spark: SparkSession, sf: str) -> DataFrame:
    d, t = table(spark, sf, "documents"), F.col("text")
    return d.select("doc_id", F.md5(text.head(t, 280)).alias("head_md5"), F.length(text.head_tail(t, 350, 250)).cast("long").alias("clipped"), text.one_line(t, 120).alias("line"), text.title_or_first_line(F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.col("source")), t).alias("title"))


def date_parse(spark: SparkSession, sf: str) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    raw = F.when(F.col("o_orderkey") % 4 == 0, F.concat(day, F.lit("T10:20:30Z"))).when(F.col("o_orderkey") % 4 == 1, day).when(F.col("o_orderkey") % 4 == 2, F.concat(day, F.lit(" junk"))).otherwise(F.lit("n/a"))
    return table(spark, sf, "orders").select("o_orderkey", dates.parse_day(raw).alias("day"))


def date_midpoint(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.to_date(F.min("o_orderdate")).alias("lo"), F.to_date(F.max("o_orderdate")).alias("hi"))
    return o.select("o_custkey", dates.midpoint(F.col("lo"), F.col("hi")).alias("mid"))


def json_props(spark: SparkSession, sf: str) -> DataFrame:
    fenced = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
    k = F.from_json(text.first_json_object(fenced), "k long")["k"]
    return table(spark, sf, "events").groupBy((k >= 0).alias("valid"), F.pmod(k, F.lit(10)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("total"))


def log_line_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Log rows ``sha|date|subject`` split in three; rows with fewer parts are left out."""
    line = F.when(F.col("o_orderkey") % 9 == 0, F.lit("broken|line")).otherwise(F.concat_ws("|", F.md5(F.col("o_orderkey").cast("string")), F.date_format("o_orderdate", "yyyy-MM-dd"), F.concat(F.lit("a|b "), F.col("o_orderstatus"))))
    parts = table(spark, sf, "orders").select("o_orderkey", F.split(line, r"\|", 3).alias("p")).where(F.size("p") == 3)
    return parts.select("o_orderkey", F.left(F.col("p")[0], F.lit(8)).alias("sha8"), F.col("p")[1].alias("day"), F.col("p")[2].alias("subject"))


def merge_commit_score(spark: SparkSession, sf: str) -> DataFrame:
    """The best-scoring commit of each change by title, number marks and parents; earlier rows win ties."""
    s = _subjects(spark, sf).select(F.col("o_orderkey").alias("sha"), "o_custkey", "subject", F.when(F.col("o_orderkey") % 7 == 0, 2).otherwise(1).alias("parents"))
    n = F.col("o_custkey").cast("string")
    ends = lambda prefix, suffix: F.regexp_like(F.col("subject"), F.concat(F.lit(prefix), n, F.lit(suffix)))
    score = F.when(F.contains(F.col("subject"), F.lit("parser")), 4).otherwise(0) + F.when(ends("Merge pull request #", r"\b"), 3).otherwise(0) + F.when(ends(r"\(#", r"\)"), 2).otherwise(0) + F.when(ends("#", r"\b"), 1).otherwise(0) + F.when(F.col("parents") >= 2, 1).otherwise(0)
    best = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("score"), "sha"))
    return s.withColumn("score", score.cast("long")).where("score > 0").withColumn("_r", best).where("_r = 1").select("o_custkey", "sha", "score")


ORACLE = {
    "commit_class": f"WITH {_SUBJECTS}, k AS (SELECT lower(trim(subject)) AS m FROM s) SELECT CASE " + " ".join(f"WHEN regexp_matches(m, '{p}') THEN '{n}'" for n, p in text.COMMIT_RULES) + " ELSE 'OTHER' END AS kind, count(*) AS n FROM k GROUP BY 1",
    "keyword_class": f"WITH {_SUBJECTS}, k AS (SELECT o_orderkey AS id, lower(subject) AS m FROM s UNION ALL SELECT doc_id, lower(text) FROM documents) SELECT id, CASE " + " ".join("WHEN " + " OR ".join(f"contains(m, '{w}')" for w in ws) + f" THEN '{n}'" for n, ws in text.KEYWORDS.items()) + " ELSE 'other' END AS kind FROM k",
    "issue_refs": f"""WITH {_SUBJECTS}, r AS (SELECT o_orderkey, list_sort(list_distinct(list_filter(list_transform(list_concat(
  regexp_extract_all(subject, '(?i)(?:fix(?:es|ed)?|close[sd]?|resolve[sd]?|ref(?:erence)?s?|addresses?|related\\s+to|see|re|part\\s+of)\\s+#(\\d+)', 1),
  regexp_extract_all(subject, '(?:^|\\s)#(\\d+)', 1)), lambda x: TRY_CAST(x AS BIGINT)), lambda n: n BETWEEN 1 AND 1000000))) AS l FROM s)
SELECT o_orderkey, array_to_string(l, ',') AS refs, array_to_string(l[1:1], ',') AS first_ref FROM r""",
    "path_language_mode": f"""WITH {_PATHS}, l AS (SELECT *, {_LANG} AS language FROM p), n AS (SELECT repo, language, count(*) AS n, min(page_id) AS seen FROM l WHERE language IS NOT NULL GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY n DESC, seen) AS k FROM n) SELECT r.repo, coalesce(b.language, 'Unknown') AS language FROM (SELECT DISTINCT repo FROM p) r LEFT JOIN b ON b.repo = r.repo AND b.k = 1""",
    "noncode_filter": f"WITH {_PATHS} SELECT page_id, split_part(path, '/', -1) AS name, lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1)) AS ext FROM p WHERE NOT (" + " OR ".join(f"contains(path, '{x}')" for x in paths.NON_CODE) + ")",
    "truncate_marker": """SELECT doc_id, md5(CASE WHEN length(text) > 280 THEN left(text, 280) || '...' ELSE text END) AS head_md5,
CASE WHEN length(text) > 600 THEN 605 ELSE length(text) END AS clipped, left(regexp_replace(regexp_replace(replace(text, chr(10), ' '), '^\\s+', ''), '\\s+$', ''), 120) AS line,
coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END, ''), nullif(left(regexp_replace(string_split(text, chr(10))[1], '^# ', ''), 150), ''), 'Unknown') AS title FROM documents""",
    "date_parse": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders",
    "date_midpoint": "SELECT o_custkey, CAST(lo + CAST(floor(date_diff('day', lo, hi) / 2) AS INTEGER) AS DATE) AS mid FROM (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS lo, CAST(max(o_orderdate) AS DATE) AS hi FROM orders GROUP BY 1)",
    "json_props": "WITH k AS (SELECT CAST(props::JSON->>'k' AS BIGINT) AS k FROM events) SELECT k >= 0 AS valid, ((k % 10) + 10) % 10 AS bin, count(*) AS n, CAST(sum(k) AS BIGINT) AS total FROM k GROUP BY 1, 2",
    "log_line_parse": "SELECT o_orderkey, left(md5(CAST(o_orderkey AS VARCHAR)), 8) AS sha8, strftime(o_orderdate, '%Y-%m-%d') AS day, 'a|b ' || o_orderstatus AS subject FROM orders WHERE o_orderkey % 9 <> 0",
    "merge_commit_score": f"""WITH {_SUBJECTS}, c AS (SELECT o_orderkey AS sha, o_custkey, CAST((CASE WHEN contains(subject, 'parser') THEN 4 ELSE 0 END)
  + (CASE WHEN regexp_matches(subject, 'Merge pull request #' || o_custkey || '\\b') THEN 3 ELSE 0 END) + (CASE WHEN regexp_matches(subject, '\\(#' || o_custkey || '\\)') THEN 2 ELSE 0 END)
  + (CASE WHEN regexp_matches(subject, '#' || o_custkey || '\\b') THEN 1 ELSE 0 END) + (CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS score FROM s)
SELECT o_custkey, sha, score FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, sha) AS k FROM c WHERE score > 0) WHERE k = 1""",
}
QUERIES = [commit_class, keyword_class, issue_refs, path_language_mode, noncode_filter, truncate_marker, date_parse, date_midpoint, json_props, log_line_parse, merge_commit_score]
