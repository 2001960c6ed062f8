"""Even shards with linked documents together: balanced label propagation in DataFrame operations alone.

Documents with equal texts are linked (through their group, so links number as the documents). Starting
from an even random deal, each round lets linked documents move to the shard where most of their group is,
as far as documents go the other way: linked ones that want to, else unlinked ones, whose place is free to
choose. Shards without unlinked rows exchange linked ones only. Row counts never change, so they stay at most
one apart.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SHARDS = 24
#: Rounds at most; they end when nothing moves.
ROUNDS = 30
#: Exchanges between linked rows end when so many draws of tied shards in a row allow none.
IDLE_DRAWS = 3
#: Rows that a numbering bucket of a shard holds on average; larger groups are numbered across buckets.
BUCKET_ROWS, WHOLE_GROUP = 50_000, 1000


def described(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes + 8; a null text has none), text_crc32, and the SHA-256 of the text as group."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.sha2(text.cast("binary"), 256).alias("grp"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard for every row of docs(doc_id, text).

    The law is ``rows``: shards' row counts are at most one apart. Slots are gapless from 0 in each shard.
    grown_shard is null (it belongs to a law by key). Empty texts are equal texts, a null text is linked to
    nothing. Repeated rows and null ids are rows of their own. A group larger than a shard fills
    shards one after another. Other columns are ignored; an empty table gives no rows. Moves end when none gains; a
    warning says so where they are ended by `rounds`, as every other promise holds then too.
    """
    return placed(docs, shards, rounds).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def placed(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """What shard_documents gives, with grp, for `cut_edges`."""
    spark = docs.sparkSession
    base = common.save(spark, described(docs), "shard-base")
    total = base.count()
    width = max(8, -(-total // (shards * BUCKET_ROWS)))
    by_id = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(width))
    tagged = _with_members(spark, base, total)
    dealt = common.numbered(tagged, [], ["doc_id", "text_crc32", "grp"], F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(width * shards)), "n")
    now = common.save(spark, dealt.withColumn("shard", F.pmod("n", F.lit(shards)).cast("int")).drop("n"), "shard-start")
    for r in range(rounds):
        draws = (_round(now, by_id, width, total, salt) for salt in (None, *range(r * IDLE_DRAWS, (r + 1) * IDLE_DRAWS)))
        moved = next((x for x in draws if x is not None), None)
        if moved is None:
            break
        after = common.save(spark, moved, "shard-round")
        common.drop_saved(spark, now)
        now = after
    else:
        warnings.warn(f"documents still moved after {rounds} rounds", stacklevel=2)
    return common.numbered(now, ["shard"], ["doc_id", "text_crc32", "grp"], by_id, "slot")


def _with_members(spark, base: DataFrame, total: int) -> DataFrame:
    """base with the number of documents of each row's group, 1 for a null one.

    Large groups are at most LARGE_GROUPS, so their rows stay where they are; only the others meet by group.
    """
    linked = base.where("grp is not null")
    groups = common.save(spark, linked.groupBy("grp").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "shard-groups")
    large = F.broadcast(groups.where(F.col("members") * common.LARGE_GROUPS >= total))
    rest = linked.join(large, "grp", "left_anti").join(groups, "grp", "left").withColumn("members", F.coalesce("members", F.lit(1)))
    return linked.join(large, "grp").unionByName(rest).unionByName(base.where("grp is null").withColumn("members", F.lit(1).cast("long")))


def _round(now: DataFrame, by_id, width: int, total: int, salt: int | None) -> DataFrame | None:
    """The table after one round of moves, or None where no document can move with gain.

    Without a salt, groups go to shards that have unlinked rows. With one, to any shard, of equal ones to one drawn
    by the salt: were it always the lower one, rows would want to go one way only and never be exchanged.
    """
    spark = now.sparkSession
    free = now.groupBy("shard").agg(F.count(F.when(F.col("members") == 1, 1)).alias("free"))
    held = now.where("members > 1").groupBy("grp", "shard").agg(F.count(F.lit(1)).alias("here"))
    places = held.join(F.broadcast(free), "shard").withColumn("turn", -F.col("shard").cast("long") if salt is None else F.xxhash64(F.lit(salt), "grp", "shard"))
    # the best shard of each group (without a salt: among those with places to give), and the members it has there
    best = (places.where("free > 0") if salt is None else places).groupBy("grp").agg(F.max(F.struct("here", "turn", "shard")).alias("b")).select("grp", F.col("b.here").alias("there"), F.col("b.turn").alias("first"), F.col("b.shard").alias("to"))
    # of equal shards the first in turn attracts, unless it has no place to give
    tied = (F.col("there") == F.col("here")) & ((F.col("first") > F.col("turn")) | (F.col("free") == 0))
    going = places.join(best, "grp").where((F.col("to") != F.col("shard")) & ((F.col("there") > F.col("here")) | tied))
    going = common.save(spark, going.select("grp", "shard", "to", "here"), "shard-going")
    wish = going.groupBy("shard", "to").agg(F.sum("here").alias("d"))
    back = wish.select(F.col("shard").alias("to"), F.col("to").alias("shard"), F.col("d").alias("r"))
    # flows between pairs of shards: shards * shards rows at most
    met = wish.join(F.broadcast(back), ["shard", "to"], "left").withColumn("swap", F.least("d", F.coalesce("r", F.lit(0)))).join(F.broadcast(free.toDF("to", "free")), "to")
    rest = F.col("d") - F.col("swap")
    order = Window.partitionBy("to").orderBy("shard")
    lent = met.withColumn("asked", F.sum(rest).over(order) - rest).withColumn("lent", F.greatest(F.lit(0), F.least(rest, F.col("free") - F.col("asked"))))
    flows = common.save(spark, lent.select("shard", "to", (F.col("swap") + F.col("lent")).alias("quota"), "lent", (F.sum("lent").over(order) - F.col("lent")).alias("lo")), "shard-flows")
    if flows.agg(F.sum("quota")).first()[0] in (None, 0):
        common.drop_saved(spark, going)
        return None
    # rows of large groups stay where they are: those groups have a row a shard in `going`
    is_large, moves = F.col("members") * common.LARGE_GROUPS >= total, going.select("grp", "shard", "to")
    few = F.broadcast(moves.join(F.broadcast(now.where(is_large).select("grp").distinct()), "grp", "left_semi"))
    wants = now.where(is_large).join(few, ["grp", "shard"], "left").unionByName(now.where(~is_large).join(moves, ["grp", "shard"], "left"))
    kind = F.when(F.col("to").isNotNull(), F.col("to")).when(F.col("members") == 1, F.lit(-1))
    keep_whole = F.when((F.col("members") > 1) & (F.col("members") <= WHOLE_GROUP), F.pmod(F.xxhash64("grp"), F.lit(width))).otherwise(by_id)
    ranked = common.numbered(wants.withColumn("kind", F.coalesce(kind, F.lit(-2))), ["shard", "kind"], ["grp", "doc_id", "text_crc32"], keep_whole, "n")
    quota = F.broadcast(flows.select("shard", F.col("to").alias("kind"), "quota"))
    filled = F.broadcast(flows.where("lent > 0").select(F.col("to").alias("from_"), F.col("shard").alias("into"), "lo", (F.col("lo") + F.col("lent")).alias("hi")))
    go = ranked.join(quota, ["shard", "kind"], "left")
    go = go.join(filled, (F.col("kind") == -1) & (go["shard"] == F.col("from_")) & (F.col("n") >= F.col("lo")) & (F.col("n") < F.col("hi")), "left")
    shard = F.when((F.col("kind") >= 0) & (F.col("n") < F.coalesce("quota", F.lit(0))), F.col("kind")).otherwise(F.coalesce("into", "shard"))
    return go.select("grp", "doc_id", "size", "text_crc32", "members", shard.cast("int").alias("shard"))


def cut_edges(placed: DataFrame) -> DataFrame:
    """One row: documents with equal texts that are not in their group's largest shard, and all linked ones; of placed(grp, shard)."""
    parts = placed.where("grp is not null").groupBy("grp", "shard").agg(F.count(F.lit(1)).alias("n")).groupBy("grp").agg(F.sum("n").alias("all"), F.max("n").alias("top")).where("all > 1")
    return parts.agg(F.coalesce(F.sum(F.col("all") - F.col("top")), F.lit(0)).alias("cut"), F.coalesce(F.sum("all"), F.lit(0)).alias("linked"))
