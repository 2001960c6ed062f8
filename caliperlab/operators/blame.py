"""Who wrote the lines of a file at any revision, out of the offsets of successive diffs.

A diff maps line numbers after it to line numbers before it, or to its own added lines: a few pieces, each a range and a shift. Maps of
successive diffs compose to a map of the same kind; so maps of 1, 2, 4, .. revisions are made of pairs, and a line is traced to its origin in as many steps as
the number of its revision has bits. Neither a file nor its lines are ever rebuilt, but for former_writers() of small files: a task replays these one after the other.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import drop, kept
from ..sources.json_arrays import ensure_workers
from .intervals import overlap_join
from .lineage import preorder

#: Beyond the last line of any file.
END = 1 << 40


def _maps(edits: DataFrame) -> DataFrame:
    """(file, node, s, e, birth, shift): pieces of the map of each revision. Line n in [s, e] is line n + shift of the revision before, or, where
    there is a birth, of the lines that revision added."""
    here = Window.partitionBy("file", "rev").orderBy("at")
    grown = F.col("added") - F.col("removed")
    delta = F.sum(grown).over(here.rowsBetween(Window.unboundedPreceding, 0))
    h = edits.where("added > 0 or removed > 0").withColumn("_after", delta).withColumn("_next", F.lead("at").over(here)).withColumn("_first", F.row_number().over(here) == 1)
    new_at = F.col("at") + F.col("_after") - grown
    last = F.coalesce(F.col("_next") + F.col("_after"), F.lit(END))
    none = F.lit(None).cast("long")
    piece = lambda s, e, birth, shift: F.struct(s.cast("long").alias("s"), e.cast("long").alias("e"), birth.cast("long").alias("birth"), shift.cast("long").alias("shift"))
    pieces = F.array(
        F.when(F.col("_first"), piece(F.lit(1), F.col("at"), none, F.lit(0))),
        piece(new_at + 1, new_at + F.col("added"), F.col("rev"), F.lit(0)),
        piece(new_at + F.col("added") + 1, last, none, -F.col("_after")),
    )
    return h.select("file", F.col("rev").alias("node"), F.inline(F.filter(pieces, lambda p: p.isNotNull() & (p.s <= p.e))))


def trace(edits: DataFrame, points: DataFrame) -> DataFrame:
    """points(id, file, rev, pos) with birth and no: the revision that added line `pos` of the file after `rev`, and its number there.

    edits(file, rev, at, removed, added): of a revision's diff, the hunks: lines kept before it in the file before, lines removed and
    added. A file's revisions are numbered from 0 without gaps; one that changes nothing has a hunk of 0 lines. Lines from before all revisions have no birth and their
    number at the beginning. A point at line 0 or below has none either.
    """
    every = edits.groupBy("file", "rev").agg(F.max(F.col("added") + F.col("removed")).alias("n"))
    idle = every.where("n = 0").select("file", F.col("rev").alias("node"), F.lit(1).cast("long").alias("s"), F.lit(END).alias("e"), F.lit(None).cast("long").alias("birth"), F.lit(0).cast("long").alias("shift"))
    level = kept(_maps(edits).unionByName(idle), "maps")
    at = points.select("id", "file", F.col("pos").cast("long").alias("pos"), (F.col("rev") + 1).cast("long").alias("left"), F.lit(None).cast("long").alias("birth"))
    going = F.col("birth").isNull() & (F.col("pos") > 0)
    for bit in range(bits := int(at.agg(F.max("left")).first()[0] or 0).bit_length()):
        turn = going & (F.col("left") > 0) & (F.col("left").bitwiseAND(1 << bit) != 0)
        asked = at.where(turn).withColumn("node", F.shiftright("left", bit) - 1).withColumn("_to", F.col("pos")).drop("birth")
        met = overlap_join(asked, level, ["file", "node"], ("pos", "_to"), ("s", "e"))
        moved = met.select("id", "file", (F.col("pos") + F.col("shift")).alias("pos"), (F.col("left") - (1 << bit)).alias("left"), "birth")
        at = kept(moved.unionByName(at.where(~F.coalesce(turn, F.lit(False)))), "traced")
        if bit < bits - 1:
            level, old = kept(_composed(level), "maps"), level
            drop(old)
    return points.join(at.select("id", "birth", F.col("pos").alias("no")), "id")


def _composed(level: DataFrame) -> DataFrame:
    """The maps of pairs of neighbours: what the later one copies is looked up in the earlier one. A map without a partner stays behind."""
    later = level.where("node % 2 = 1").withColumn("node", F.shiftright("node", 1))
    earlier = level.where("node % 2 = 0").select("file", F.shiftright("node", 1).alias("node"), F.col("s").alias("_s"), F.col("e").alias("_e"), F.col("birth").alias("_birth"), F.col("shift").alias("_shift"))
    copies = later.where("birth is null").withColumn("_from", F.col("s") + F.col("shift")).withColumn("_to", F.least(F.col("e") + F.col("shift"), F.lit(END)))
    met = overlap_join(copies, earlier, ["file", "node"], ("_from", "_to"), ("_s", "_e"))
    s, e = F.greatest("_from", "_s") - F.col("shift"), F.when(F.least("_to", "_e") >= END, F.lit(END)).otherwise(F.least("_to", "_e") - F.col("shift"))
    through = met.select("file", "node", s.alias("s"), e.alias("e"), F.col("_birth").alias("birth"), (F.col("shift") + F.col("_shift")).alias("shift"))
    return later.where("birth is not null").unionByName(through)


def lives(edits: DataFrame, lines: DataFrame) -> DataFrame:
    """lines(file, rev, no, content), the added ones, with `death`, the revision that removed the line (null: none), and `place`, which
    orders all lines of a file that ever stood in it as they stood: of lines of one revision the upper has the smaller place."""
    here = Window.partitionBy("file", "rev").orderBy("at")
    shift = F.sum(F.col("added") - F.col("removed")).over(here) - (F.col("added") - F.col("removed"))
    hunks = edits.select("file", "rev", "at", "removed", "added", (F.col("at") + shift).alias("new_at"))
    gone = hunks.where("removed > 0").select("file", F.col("rev").alias("death"), (F.col("rev") - 1).alias("rev"), F.explode(F.sequence(F.col("at") + 1, F.col("at") + F.col("removed"))).alias("pos"))
    above = hunks.where("added > 0").select("file", F.col("rev").alias("by"), (F.col("new_at") + 1).alias("first"), (F.col("rev") - 1).alias("rev"), F.col("at").alias("pos"))
    asked = gone.select("file", "rev", "pos", "death", F.lit(None).cast("long").alias("by"), F.lit(None).cast("long").alias("first")).unionByName(above.withColumn("death", F.lit(None).cast("long")).select("file", "rev", "pos", "death", "by", "first"))
    asked = kept(asked.withColumn("id", F.monotonically_increasing_id()), "asked")
    found = kept(trace(edits, asked), "found")
    ends = found.where("death is not null and birth is not null").select("file", F.col("birth").alias("rev"), "no", "death")
    # a line stands after the line above it in its hunk, the first of a hunk after the one that the hunk follows
    key = lambda rev, no: F.shiftleft(rev.cast("long"), 32) + no
    tops = found.where("by is not null").select("file", F.col("by").alias("rev"), F.col("first").alias("no"), F.when(F.col("birth").isNotNull(), key(F.col("birth"), F.col("no"))).otherwise(F.lit(-1) - F.coalesce(F.greatest("no", F.lit(0)), F.lit(0))).alias("up"))
    known = lines.join(tops, ["file", "rev", "no"], "left").withColumn("up", F.coalesce("up", key(F.col("rev"), F.col("no") - 1)))
    tree = known.select(F.col("file").alias("repo"), key(F.col("rev"), F.col("no")).alias("commit"), F.col("up").alias("parent"), F.lit(1).alias("pos"))
    # lines from before all revisions have the keys -1 - number: later ones stand lower, a newer line stands before an older one
    order = [F.when(F.col("commit") < 0, -F.col("commit")), F.desc("commit")]
    places = preorder(tree, order).select(F.col("repo").alias("file"), F.col("commit").alias("_key"), F.col("pre").alias("place"))
    return lines.join(ends, ["file", "rev", "no"], "left").withColumn("_key", key(F.col("rev"), F.col("no"))).join(places, ["file", "_key"]).drop("_key")


#: Hunks, added and removed lines of a file that is replayed; larger ones are traced in rounds over all tasks. Rows that a task replays on average.
SMALL_ROWS, REPLAY_ROWS = 2000, 500_000


def former_writers(edits: DataFrame, lines: DataFrame, name: str = "rev", small_rows: int = SMALL_ROWS) -> DataFrame:
    """(file, <name>, content, preimage, writer) of each content that a revision added in place of another line.

    The line it replaced is the removed one of the same place in its hunk: of lines of that content the first, in the first hunk, that
    has one. The writer is the revision that wrote the first line of that content in the file before. Revisions are given by the column `name` of edits.
    """
    edits, lines = edits.where("file is not null"), lines.where("file is not null")
    sizes = edits.groupBy("file").agg((F.count(F.lit(1)) + F.sum(F.col("added") + F.col("removed"))).alias("n"))
    total, most = sizes.agg(F.sum("n"), F.max("n")).first()
    tasks = max(int(edits.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(total or 0) // REPLAY_ROWS))
    if (most or 0) <= small_rows:
        return _replayed(edits, lines, name, tasks)
    # nothing else is as large, so there are few of them
    wide = kept(sizes.where(F.col("n") > small_rows).select("file"), "wide")
    small, large = ((e, ls) for e, ls in ([x.join(wide, "file", how) for x in (edits, lines)] for how in ("left_anti", "left_semi")))
    return _traced_writers(*large, name).unionByName(_replayed(*small, name, tasks))


def _replayed(edits: DataFrame, lines: DataFrame, name: str, tasks: int) -> DataFrame:
    """former_writers of small files: a task holds one file at a time, of it the lines before and after a revision."""
    ensure_workers(edits.sparkSession)
    kinds = dict(edits.dtypes)
    none = F.lit(None)
    hunks = edits.select("file", "rev", F.lit(0).alias("part"), F.col("at").cast("long").alias("n"), F.col("removed").cast("long").alias("removed"), F.col("added").cast("long").alias("added"), none.cast("string").alias("content"), F.col(name).alias("name"))
    added = lines.select("file", "rev", F.lit(1).alias("part"), F.col("no").cast("long").alias("n"), F.lit(0).cast("long").alias("removed"), F.lit(0).cast("long").alias("added"), "content", none.cast(kinds[name]).alias("name"))
    rows = hunks.unionByName(added).repartition(tasks, "file").sortWithinPartitions("file", "rev", "part", "n")
    return rows.mapInArrow(_replay, f"file {kinds['file']}, `{name}` {kinds[name]}, content string, preimage string, writer {kinds[name]}")


def _replay(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: tuple[list, ...] = ([], [], [], [], [])
    file, rev, own, hunks, added, texts, births = None, None, None, [], {}, [], []

    def revise() -> None:
        """Take the revision that has been read into the file."""
        nonlocal texts, births
        new_texts, new_births, done, seen = [], [], 0, set()
        for at, removed, n in hunks:
            # lines from before all revisions are unknown
            if (short := at + removed - len(texts)) > 0:
                texts, births = texts + [None] * short, births + [None] * short
            new_texts += texts[done:at]
            new_births += births[done:at]
            lines = [added.get(len(new_texts) + i + 1) for i in range(n)]
            for content, before in zip(lines, texts[at : at + removed], strict=False):
                if content is not None and content not in seen:
                    seen.add(content)
                    if before is not None:
                        for x, v in zip(out, (file, own, content, before, births[texts.index(before)]), strict=True):
                            x.append(v)
            new_texts += lines
            new_births += [own] * n
            done = at + removed
        texts, births = new_texts + texts[done:], new_births + births[done:]

    kinds = ()
    for batch in batches:
        field = lambda c: batch.schema.field(c).type  # noqa: E731, B023
        kinds = field("file"), field("name"), pa.string(), pa.string(), field("name")
        # only hunks are named
        named = iter(_values(batch["name"].filter(pc.equal(batch["part"], 0))))
        for f, r, part, n, removed, n_added, content in zip(*(_values(batch[c]) for c in ("file", "rev", "part", "n", "removed", "added", "content")), strict=True):
            if f != file or r != rev:
                if hunks:
                    revise()
                if f != file:
                    texts, births = [], []
                file, rev, own, hunks, added = f, r, None, [], {}
            if part == 0:
                own = next(named)
                hunks.append((n, removed, n_added))
            else:
                added[n] = content
        if len(out[0]) >= 10_000:
            yield _batch(out, kinds)
    if hunks:
        revise()
    if out[0]:
        yield _batch(out, kinds)


def _values(column: pa.Array) -> list:
    """to_pylist, faster for texts and whole numbers."""
    if pa.types.is_string(column.type) or (pa.types.is_integer(column.type) and not column.null_count):
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def _batch(out: tuple[list, ...], kinds: tuple) -> pa.RecordBatch:
    """The rows of out, which is empty after that."""
    made = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], [f"c{i}" for i in range(len(out))])
    for x in out:
        x.clear()
    return made


def _traced_writers(edits: DataFrame, lines: DataFrame, name: str) -> DataFrame:
    """former_writers of large files, in rounds over all tasks."""
    names = kept(edits.select("file", "rev", F.col(name).alias("_name")).distinct(), "names")
    edits, lines = kept(edits.select("file", "rev", "at", "removed", "added"), "edits"), kept(lines.select("file", "rev", "no", "content"), "lines")
    known = kept(lives(edits, lines), "lives")
    here = Window.partitionBy("file", "rev").orderBy("at")
    shift = F.sum(F.col("added") - F.col("removed")).over(here) - (F.col("added") - F.col("removed"))
    hunks = edits.select("file", "rev", "at", "removed", "added", (F.col("at") + shift).alias("new_at"))
    replaced = hunks.where("removed > 0 and added > 0").select("file", "rev", F.inline(F.transform(F.sequence(F.lit(1).cast("long"), F.least("removed", "added").cast("long")), lambda i: F.struct((F.col("new_at") + i).alias("no"), (F.col("at") + i).alias("pos")))))
    replaced = replaced.join(lines, ["file", "rev", "no"]).groupBy("file", "rev", "content").agg(F.min("pos").alias("pos"))
    # the removed line's own content: it died here, and its place among those that did is its place in the diff
    died = known.where("death is not null").withColumn("i", F.row_number().over(Window.partitionBy("file", "death").orderBy("place")))
    gone = hunks.where("removed > 0").select("file", "rev", F.explode(F.sequence(F.col("at") + 1, F.col("at") + F.col("removed"))).alias("pos")).withColumn("i", F.row_number().over(Window.partitionBy("file", "rev").orderBy("pos")))
    texts = gone.join(died.select("file", F.col("death").alias("rev"), "i", F.col("content").alias("preimage")), ["file", "rev", "i"]).select("file", "rev", "pos", "preimage")
    pairs = replaced.join(texts, ["file", "rev", "pos"]).select("file", "rev", "content", "preimage")
    stood = known.select("file", F.col("content").alias("preimage"), F.col("rev").alias("_birth"), (F.coalesce("death", F.lit(END)) - 1).alias("_last"), "place")
    before = pairs.select("file", "preimage", (F.col("rev") - 1).alias("_at")).distinct().withColumn("_to", F.col("_at"))
    first = overlap_join(before, stood, ["file", "preimage"], ("_at", "_to"), ("_birth", "_last")).groupBy("file", "preimage", "_at").agg(F.min_by("_birth", "place").alias("writer"))
    found = pairs.withColumn("_at", F.col("rev") - 1).join(first, ["file", "preimage", "_at"], "left")
    if name == "rev":
        return found.select("file", "rev", "content", "preimage", "writer")
    writers = names.select("file", F.col("rev").alias("writer"), F.col("_name").alias("_writer"))
    return found.join(names, ["file", "rev"]).join(writers, ["file", "writer"], "left").select("file", F.col("_name").alias(name), "content", "preimage", F.col("_writer").alias("writer"))
