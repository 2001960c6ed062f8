"""JSON arrays read in blocks against the standard library, and resumable ingestion."""

import datetime
import json
import random

import pyarrow as pa
import pytest

from caliperlab.sources import json_arrays
from caliperlab.streaming import ingest


def strings(rng):
    return "".join(rng.choices(['"', "\\", "}", "{", "[", "]", ",", "a", "é", "\n", " ", "\\\\", '\\"'], k=rng.randint(0, 12)))


def values(rng, depth=0):
    kind = rng.randint(0, 6 if depth < 3 else 3)
    if kind <= 1:
        return strings(rng)
    if kind <= 3:
        return rng.choice([None, True, 1, -2.5])
    if kind <= 4:
        return [values(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {strings(rng): values(rng, depth + 1) for _ in range(rng.randint(0, 3))}


@pytest.mark.parametrize("block", [1, 7, 64, 1000])
def test_arrays_at_every_border(spark, tmp_path, block):
    """Blocks of a few bytes: borders lie inside strings, escapes, names and numbers."""
    rng, want = random.Random(block), []
    (tmp_path / "in").mkdir()
    for i in range(3 if block < 64 else 6):
        items = [values(rng) for _ in range(rng.randint(0, 2 + block // 4))]
        text = json.dumps(items, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        (tmp_path / "in" / f"{i}.json").write_text(text + rng.choice(["", "\n"]))
        want += items
    (tmp_path / "in" / "empty.json").write_text("")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = [json.loads(r["text"]) for r in json_arrays.read_elements(spark, str(tmp_path / "in")).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    key = lambda x: json.dumps(x, sort_keys=True)
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_one_array_in_many_tasks(spark, tmp_path):
    rows = spark.range(5000).selectExpr("id", "concat('}\"', id, '\\\\{[') as note")
    json_arrays.write_arrays(rows.coalesce(1), str(tmp_path / "one"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
        back = json_arrays.read_array(spark, str(tmp_path / "one"), "id long, note string")
        assert back.rdd.getNumPartitions() >= 8
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    json_arrays.write_arrays(rows.limit(0), str(tmp_path / "none"))
    assert json_arrays.read_array(spark, str(tmp_path / "none"), "id long, note string").count() == 0


def events(spark, path, rows):
    spark.createDataFrame(rows, "id long, ts timestamp").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema("id long, ts timestamp").parquet(path)


def test_ingestion_keeps_keys_as_state(spark, tmp_path):
    at = lambda day: datetime.datetime(2024, 1, 1) + datetime.timedelta(day)
    new, done, state = (str(tmp_path / x) for x in ("in", "done", "state"))
    ids = lambda: sorted(r["id"] for r in spark.read.parquet(done).collect())
    ingest.ingest_new(events(spark, new, [(1, at(0)), (2, at(1)), (1, at(1))]), done, ["id"], state, "10 days")
    assert ids() == [1, 2]
    ingest.ingest_new(events(spark, new, [(2, at(2)), (3, at(2))]), done, ["id"], state, "10 days")
    assert ids() == [1, 2, 3]
    # nothing new: nothing is written again
    again = ingest.ingest_new(spark.readStream.schema("id long, ts timestamp").parquet(new), done, ["id"], state, "10 days")
    assert ids() == [1, 2, 3] and sum(p["numInputRows"] for p in again) == 0
    # a batch reads its own rows alone, and keys that the watermark has passed leave the state
    ran = ingest.ingest_new(events(spark, new, [(4, at(100)), (5, at(100))]), done, ["id"], state, "10 days")
    ran += ingest.ingest_new(events(spark, new, [(5, at(101)), (1, at(1))]), done, ["id"], state, "10 days")
    assert ids() == [1, 2, 3, 4, 5] and max(p["numInputRows"] for p in ran) == 2
    assert ran[-1]["stateOperators"][0]["numRowsTotal"] == 2


def test_a_batch_that_failed_is_written_once(spark, tmp_path):
    """A run that ends before its batch is marked as finished starts from the state before it."""
    new, done, state = (str(tmp_path / x) for x in ("in", "done", "state"))
    stream = events(spark, new, [(i, datetime.datetime(2024, 1, 1)) for i in range(20)])
    ingest.ingest_new(stream, done, ["id"], state)
    for name in ("0", ".0.crc"):
        (tmp_path / "state" / "commits" / name).unlink(missing_ok=True)
    events(spark, new, [(i, datetime.datetime(2024, 1, 2)) for i in range(10, 30)])
    ingest.ingest_new(stream, done, ["id"], state)
    got = [r["id"] for r in spark.read.parquet(done).collect()]
    assert sorted(got) == list(range(30))


def test_arrays_are_cut_alike_from_any_block(spark, tmp_path):
    """Quotes after runs of backslashes, braces in strings and letters beyond ASCII, in blocks of a few bytes; a batch of rows is written at once."""
    rows = [(i, "\\" * (i % 4) + '"' * (i % 3) + "}],{[ é" + "\\" * (i % 3)) for i in range(400)]
    json_arrays.write_arrays(spark.createDataFrame(rows, "i long, t string").coalesce(1), f"{tmp_path}/a")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for most in ("97", "5000", old):
            spark.conf.set("spark.sql.files.maxPartitionBytes", most)
            assert sorted(tuple(r) for r in json_arrays.read_array(spark, f"{tmp_path}/a", "i long, t string").collect()) == rows
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    data = b'"\\\\" , "a\\"b" , "'
    _, quoted, ended = json_arrays.lexed(data, False)
    assert ended and [at for at in range(len(data)) if data[at : at + 1] == b"," and not quoted[at]] == [5, 14]


def test_many_rows_are_written_by_batches():
    """A batch in gives a batch out: rows one by one took most of the time."""
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(1000)])], ["value"])
    out = [b["value"].to_pylist() for b in json_arrays._bracketed([batch, batch.slice(0, 0), batch])]
    assert [len(x) for x in out] == [1000, 1000, 1] and out[0][:2] == ["[0", ",1"] and out[1][0] == ",0" and out[2] == ["]"]
