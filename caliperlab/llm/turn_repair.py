"""Conversation structure repair: fault flags by windows, and the cheapest edits by a fold in Spark SQL.

Rows are put in order and flagged by windows. A fold with aggregate() over the sorted turns then carries four (cost, audit) structs, one for
each last role of what is kept so far (none, system, user, assistant), and takes the least of all edits with least(). Costs and audits
add up, so a long conversation is folded in blocks of turns, each from all four states it may begin in, and the blocks are folded
in turn: no row holds more than a block of turns. What fixes the text, the repaired turns, is a stream of rows in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Turns of a conversation that one row holds.
BLOCK = 256
#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
STATES = ["none", "system", "user", "assistant"]
_STATE = "struct<cost:bigint,audit:string>"
_FOLD = f"struct<{','.join(f'{s}:{_STATE}' for s in STATES)}>"
_NEXT = {"none": "user", "system": "user", "user": "assistant", "assistant": "user"}


@dataclass
class Repaired:
    """conversations(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit), and turns(conv_id, place, role, text) after
    the edits; each conversation's turns are in one partition, in order."""

    conversations: DataFrame
    turns: DataFrame


def damaged(turns: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) with faults put in by a checksum of conv_id and turn; nulls count as one space.

    Of 20 remainders 0 drops the row, 1 empties its text, 2 removes its sentence ends, 3 repeats it, and 4 makes it the user's.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.pmod(F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))), F.lit(20))
    rows = turns.select("conv_id", "turn", name("role").alias("role"), name("text").alias("text"), fault.alias("_f")).where("_f <> 0")
    text = F.when(F.col("_f") == 1, "").when(F.col("_f") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_f") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(F.col("_f") == 3, 2).otherwise(1))).alias("_copy")).drop("_copy")


def _key(c: Column) -> Column:
    """conv_id as a text that is never null, so that null is a conversation like others."""
    return F.when(c.isNull(), "null").otherwise(F.concat(F.lit("="), c.cast("string")))


def flagged(turns: DataFrame) -> DataFrame:
    """The turns in order, with `_k` (the conversation), `_at` from 0, their fault (null, blank, duplicate or truncated), `_illegal`
    (they don't follow the row before) and `_fresh` (a turn number not met before)."""
    # equal rows are peers, so which comes first doesn't matter
    rows = turns.select(_key(F.col("conv_id")).alias("_k"), "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    order = Window.partitionBy("_k").orderBy(F.asc_nulls_first("turn"), "role", "text")
    at = rows.withColumn("_at", F.row_number().over(order) - 1)
    same = Window.partitionBy("_k", "role", "text").orderBy("_at")
    initial, before = F.substring("role", 1, 1), F.lag("turn").over(order)
    pair = F.concat(F.substring(F.lag("role").over(order), 1, 1), initial)
    last = F.regexp_extract("text", r"(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    marked = at.select("*", (~F.coalesce(pair, F.lit("ua")).isin("su", "ua", "au")).alias("_illegal"), (F.col("turn").isNotNull() & (before.isNull() | (before != F.col("turn")))).alias("_fresh"), initial.alias("_initial"), last.alias("_last"))
    fault = F.when(F.col("_last") == "", "blank").when(F.row_number().over(same) > 1, "duplicate").when(~F.col("_last").isin(".", "!", "?"), "truncated")
    return marked.withColumn("fault", fault).drop("_last")


def _state(cost, audit) -> Column:
    return F.struct(F.lit(cost).cast("long").alias("cost"), F.lit(audit).alias("audit"))


def _step(acc: Column, row: Column) -> Column:
    """The four states after a row: it is kept, reroled or deleted, after an inserted turn or none.

    Two turns inserted before a row are never cheapest: they lead back to what was reached without. Turns inserted before
    deleted ones come after them in the audit, as D is before I.
    """
    must = row.fault.isin("blank", "duplicate")
    stay = F.when(row.fault == "truncated", TRUNCATED).otherwise(0)

    def edited(start: Column, cost: Column | int, letters: str, ok: Column) -> Column:
        return F.when(start.isNotNull() & ok, F.struct((start.cost + cost).alias("cost"), F.concat(start.audit, F.lit(letters)).alias("audit")))

    reached = {s: [edited(acc[s], DELETE, "D", F.lit(True))] for s in STATES}
    for state in STATES:
        if state == "none":
            reached["system"].append(edited(acc[state], stay, "K", ~F.coalesce(must, F.lit(False)) & (row.initial == "s")))
        for inserted in (False, True):
            role, cost, letter = _NEXT[state], 0, ""
            if inserted:
                role, cost, letter = _NEXT[role], INSERT, "I"
            alive = ~F.coalesce(must, F.lit(False))
            reached[role].append(edited(acc[state], stay + cost, letter + "K", alive & (row.initial == role[0])))
            reached[role].append(edited(acc[state], stay + (cost + REROLE), letter + "R", alive))
    return F.struct(*[(F.least(*reached[s]) if len(reached[s]) > 1 else reached[s][0]).alias(s) for s in STATES])


def _begin(state: str) -> Column:
    return F.struct(*[(_state(0, "") if s == state else F.lit(None).cast(_STATE)).alias(s) for s in STATES]).cast(_FOLD)


def _folded(rows: str, state: str) -> Column:
    return F.aggregate(rows, _begin(state), _step)


def _ended(acc: Column) -> Column:
    """The cheapest whole conversation: what lacks a reply gets it, what has a system turn alone gets both."""
    more = lambda s, cost, letters: F.when(s.isNotNull(), F.struct((s.cost + cost).alias("cost"), F.concat(s.audit, F.lit(letters)).alias("audit")))
    return F.least(acc.none, acc.assistant, more(acc.user, INSERT, "I"), more(acc.system, 2 * INSERT, "II"))


def _joined(acc: Column, block: Column) -> Column:
    """The four states after a block, given what it reaches from each of the four."""

    def through(state: str, to: str) -> Column:
        a, b = acc[state], block[f"from_{state}"][to]
        return F.when(a.isNotNull() & b.isNotNull(), F.struct((a.cost + b.cost).alias("cost"), F.concat(a.audit, b.audit).alias("audit")))

    return F.struct(*[F.least(*[through(s, to) for s in STATES]).alias(to) for to in STATES])


def repair(turns: DataFrame, block: int = BLOCK) -> Repaired:
    """The cheapest edits that give each conversation of turns(conv_id, turn, role, text) role initials (s?(ua)+)? and no faults.

    Turns are taken by number, null first, then by role and text; a null role or text is one space. A row's first fault counts: blank (no
    character but space, tab, line ends and the like), duplicate (role and text of an earlier row), truncated (its last such character is
    no sentence end). Keep costs 0, Rerole to user or assistant 2, Delete 3 (a must for blank and duplicate rows), Insert of an empty user or
    assistant turn 2, and a truncated row that stays 1. Of the cheapest edits those with the least audit (the edits' initials in
    order) are taken. gaps counts the turn numbers missing between the least and the greatest (0 where all are null), illegal the adjacent rows
    whose initials aren't su, ua or au. Roles other than the three, the empty one too, can be reroled or deleted; one with the initial of a role that may stand there
    stays as it is. Conversations are the distinct conv_id, null one of them; no rows: no conversations. Other columns are ignored.
    """
    spark = turns.sparkSession
    common.ensure_workers(spark)
    rows = common.save(spark, flagged(turns).withColumn("_block", F.floor(F.col("_at") / block)), "turns")
    one = F.struct(F.col("_at").alias("at"), F.col("_initial").alias("initial"), "fault")
    blocks = rows.groupBy("_k", "_block").agg(F.array_sort(F.collect_list(one)).alias("turns"))
    totals = rows.groupBy("_k").agg(
        F.first("conv_id").alias("conv_id"),
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_if("_fresh"), F.lit(0)).cast("long").alias("gaps"),
        *[F.count_if(F.coalesce(F.col("fault") == x, F.lit(False))).alias(x) for x in ("blank", "duplicate", "truncated")],
        F.count_if("_illegal").alias("illegal"), F.max("_block").alias("_blocks"),
    )
    totals = common.save(spark, totals, "conversations")
    short = blocks.join(totals.where("_blocks = 0").select("_k"), "_k").select("_k", _ended(_folded("turns", "none")).alias("_e"))
    whole = short.select("_k", "_e.cost", "_e.audit")
    long_ = totals.where("_blocks > 0").select("_k")
    several = None if long_.isEmpty() else common.save(spark, blocks.join(long_, "_k").select("_k", "_block", *[_folded("turns", s).alias(f"from_{s}") for s in STATES]), "blocks")
    if several is not None:
        in_order = several.groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("_block", *[f"from_{s}" for s in STATES]))).alias("blocks"))
        whole = whole.unionByName(in_order.select("_k", _ended(F.aggregate("blocks", _begin("none"), _joined)).alias("_e")).select("_k", "_e.cost", "_e.audit"))
    whole = common.save(spark, whole, "audits")
    judged = totals.join(whole, "_k").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    # a conversation's first row brings its edits, a letter a row and one an inserted turn
    edits = whole.select("_k", F.lit(0).alias("_at"), F.col("audit").alias("edits"))
    placed = rows.select("_k", "conv_id", "_at", "role", "text").join(edits, ["_k", "_at"], "left").repartition("_k").sortWithinPartitions("_k", "_at")
    kind = dict(turns.dtypes)["conv_id"]
    return Repaired(judged, placed.mapInArrow(_edited, f"conv_id {kind}, place long, role string, text string"))


def _edited(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The turns after the edits, of rows in order."""
    edits, at, end, place, last = "", 0, 0, 0, None
    for batch in batches:
        rows, held = [], batch.to_pylist()

        def inserted(conv, rows=rows):
            nonlocal place, last, at
            while at < len(edits) and edits[at] == "I":
                last = "assistant" if last == "u" else "user"
                rows.append((conv, place, last, ""))
                place, at, last = place + 1, at + 1, last[0]

        for row in held:
            if row["_at"] == 0:
                edits, at, place, last = row["edits"], 0, 0, None
                end = len(edits.rstrip("I"))
            inserted(row["conv_id"])
            letter, at = edits[at], at + 1
            if letter != "D":
                role = row["role"] if letter == "K" else "assistant" if last == "u" else "user"
                rows.append((row["conv_id"], place, role, row["text"]))
                place, last = place + 1, role[:1]
            if at == end:
                inserted(row["conv_id"])
        columns = list(zip(*rows, strict=True)) or [()] * 4
        kinds = [batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "place", "role", "text"])


def _digested(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    here, digest, out = None, None, []

    def told(kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 2
        return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), pa.array(columns[1], pa.string())], ["conv_id", "repaired_sha256"])

    kind = None
    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for row in batch.to_pylist():
            if row["place"] == 0:
                if digest is not None:
                    out.append((here, digest.hexdigest()))
                here, digest = row["conv_id"], hashlib.sha256()
            digest.update(("\n" * (row["place"] > 0) + row["role"] + ":" + row["text"]).encode())
        if len(out) >= 10_000:
            yield told(kind)
            out = []
    if digest is not None:
        out.append((here, digest.hexdigest()))
    if out:
        yield told(kind)


def digests(repaired: Repaired) -> DataFrame:
    """(conv_id, repaired_sha256): SHA-256 of each conversation's role:text lines after the edits; those without turns have no row."""
    kind = dict(repaired.turns.dtypes)["conv_id"]
    return repaired.turns.mapInArrow(_digested, f"conv_id {kind}, repaired_sha256 string")
