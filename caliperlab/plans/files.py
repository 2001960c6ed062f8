"""Queries through files and streams: what is written and read again must equal the table it came from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import folders, json_arrays, readers
from ..sources.tables import table
from ..streaming import ingest


def csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Cells with commas, quotes and JSON survive; keys that are no digits are left out."""
    path = folders.fresh(spark, "csv")
    c = table(spark, sf, "customer").select(F.when(F.col("c_custkey") % 50 == 0, F.lit("n/a")).otherwise(F.col("c_custkey").cast("string")).alias("number"), F.concat(F.lit('{"a": "'), "c_name", F.lit('", "b": [1, 2]}')).alias("cell"))
    readers.write_csv(c, path)
    back = readers.read_csv(spark, path, "number string, cell string").where(F.col("number").rlike("^[0-9]+$"))
    return back.select(F.col("number").try_cast("long").alias("c_custkey"), F.from_json("cell", "a string, b array<int>")["a"].alias("c_name")).distinct()


def jsonl_corrupt(spark: SparkSession, sf: str) -> DataFrame:
    path = folders.fresh(spark, "jsonl")
    e = table(spark, sf, "events").select(F.when(F.col("event_id") % 10 == 0, F.lit('{"event_id": ')).otherwise(F.to_json(F.struct("event_id", "event_type"))).alias("value"))
    e.write.text(path)
    return readers.read_jsonl(spark, path, "event_id long, event_type string", tolerant=True).where("event_id is not null")


def json_array_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = folders.fresh(spark, "array")
    n = table(spark, sf, "nation").select(F.struct("n_nationkey", "n_name").alias("x")).agg(F.to_json(F.collect_list("x")).alias("value"))
    n.coalesce(1).write.text(path)
    return readers.read_json_array(spark, path, "n_nationkey int, n_name string")


def json_array_split(spark: SparkSession, sf: str) -> DataFrame:
    """All orders in two files of one array each, read in blocks; notes hold quotes, braces and backslashes."""
    path = folders.fresh(spark, "arrays")
    o = table(spark, sf, "orders")
    note = F.concat(F.lit('{"note\\\\": [\\", '), "o_orderpriority", F.lit(" }],\\"))
    json_arrays.write_arrays(o.select("o_orderkey", F.struct(note.alias("note"), F.array("o_orderstatus", F.lit("]")).alias("states")).alias("of")).repartition(2, "o_orderkey"), path)
    return json_arrays.read_array(spark, path, "o_orderkey long, of struct<note string, states array<string>>").select("o_orderkey", "of.note", F.col("of.states")[0].alias("status"))


def glob_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = folders.fresh(spark, "glob")
    n = table(spark, sf, "nation").select("n_nationkey", "n_name", F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("k"))
    n.write.partitionBy("k").json(path)
    return readers.read_glob(spark, f"{path}/k=r[0-2]/*.json", "n_nationkey int, n_name string").select("n_nationkey", "n_name", F.replace("repo", F.lit("k=r"), F.lit("")).alias("region"))


def gzip_jsonl_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = folders.fresh(spark, "gzip")
    table(spark, sf, "supplier").select("s_suppkey", "s_name").write.option("compression", "gzip").json(path)
    return readers.read_jsonl(spark, path, "s_suppkey long, s_name string")


def wholetext_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = folders.fresh(spark, "whole")
    table(spark, sf, "region").select(F.concat(F.col("r_name"), F.lit("\r\nline\rend")).alias("value")).coalesce(1).write.text(path)
    return readers.read_whole(spark, path).select(F.size(F.split(F.regexp_replace("text", r"\n$", ""), "\n")).cast("long").alias("lines"), (F.instr("text", "\r") > 0).alias("returns"))


def sink_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """An append log in two steps, compacted to the last row of each key."""
    path = folders.fresh(spark, "log")
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    readers.append_log(o.where("o_orderkey % 2 = 0"), f"{path}/log")
    readers.append_log(o.where("o_orderkey % 2 = 1"), f"{path}/log")
    return readers.compact_log(spark, f"{path}/log", f"{path}/compact", ["o_custkey"], "o_orderkey")


def partitioned_sink(spark: SparkSession, sf: str) -> DataFrame:
    """A folder per mode; the second write replaces one mode only."""
    path = folders.fresh(spark, "modes")
    e = table(spark, sf, "events").select("event_id", "event_type")
    readers.write_partitioned(e, path, "event_type")
    readers.write_partitioned(e.where("event_type = 'click' and event_id % 2 = 0"), path, "event_type")
    return spark.read.schema("event_id long, event_type string").json(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def summary_document(spark: SparkSession, sf: str) -> DataFrame:
    path = folders.fresh(spark, "summary")
    o = table(spark, sf, "orders")
    by = o.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("o_orderstatus", "n")))).alias("by_status"), F.sum("n").alias("total"))
    by.coalesce(1).write.json(path)
    return spark.read.schema("by_status map<string,long>, total long").json(path).select("total", F.explode("by_status").alias("status", "n"))


def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a stream in two runs, the second of which meets rows that it has: each event is kept once."""
    path, e = folders.fresh(spark, "stream"), table(spark, sf, "events").select("event_id", "ts", "event_type")
    e.where("event_id % 3 <> 0").write.mode("append").parquet(f"{path}/in")
    ingest.ingest_new(ingest.event_stream(spark, f"{path}/in", e.schema), f"{path}/done", ["event_id"], f"{path}/state")
    e.where("event_id % 3 <> 1").write.mode("append").parquet(f"{path}/in")
    ingest.ingest_new(ingest.event_stream(spark, f"{path}/in", e.schema), f"{path}/done", ["event_id"], f"{path}/state")
    return spark.read.parquet(f"{path}/done").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("ids"))


def stream_daily_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a stream, counted by day and type: the days that the watermark has closed."""
    path, e = folders.fresh(spark, "daily"), table(spark, sf, "events").select("event_id", "ts", "event_type")
    e.write.parquet(f"{path}/in")
    counts = ingest.daily_counts(ingest.event_stream(spark, f"{path}/in", e.schema))
    ingest.run_available(counts.select(F.to_date("window.start").alias("day"), "event_type", "n"), f"{path}/out", f"{path}/state")
    return spark.read.schema("day date, event_type string, n long").parquet(f"{path}/out")


ORACLE = {
    "csv_roundtrip": "SELECT DISTINCT c_custkey, c_name FROM customer WHERE c_custkey % 50 <> 0",
    "jsonl_corrupt": "SELECT event_id, event_type FROM events WHERE event_id % 10 <> 0",
    "json_array_scan": "SELECT n_nationkey, n_name FROM nation",
    "json_array_split": r"""SELECT o_orderkey, '{"note\\": [\", ' || o_orderpriority || ' }],\' AS note, o_orderstatus AS status FROM orders""",
    "glob_scan": "SELECT n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS region FROM nation WHERE n_regionkey <= 2",
    "gzip_jsonl_scan": "SELECT s_suppkey, s_name FROM supplier",
    "wholetext_scan": "SELECT 3 * count(*) AS lines, false AS returns FROM region",
    "sink_roundtrip": "SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1",
    "partitioned_sink": "SELECT event_type, count(*) FILTER (event_type <> 'click' OR event_id % 2 = 0) AS n FROM events GROUP BY 1",
    "summary_document": "SELECT (SELECT count(*) FROM orders) AS total, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY o_orderstatus",
    "stream_daily_counts": "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events WHERE CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 DAY FROM events) GROUP BY 1, 2",
    "stream_ingest": "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS ids FROM events GROUP BY 1",
}
QUERIES = [csv_roundtrip, jsonl_corrupt, json_array_scan, json_array_split, glob_scan, gzip_jsonl_scan, wholetext_scan, sink_roundtrip, partitioned_sink, summary_document, stream_ingest, stream_daily_counts]
