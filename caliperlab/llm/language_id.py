"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays.

Each language has a model of ORDER characters, from counts over all training texts. An n-gram's key packs
16 bits a character (letters beyond U+FFFF share the 0x1900 private codes); each order's keys of all languages are one
sorted array with a column of log probabilities per language, so a text is scored for every language with one search a
character. A model of more than PART_ROWS n-grams is made and used in parts by the last character but one, with the same
result: all that a probability needs but the single characters has that character in common, and sums over a text add up.
The language with the lowest cross-entropy per character wins; a text whose cross-entropy is far beyond what
training texts of that language show is rejected.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, shingles

ORDER = 4
START, SPACE = 1, 32
#: Training rows that the sharpness of scores is calibrated on: those with the smallest hashes.
CALIBRATION_ROWS = 3000
#: (language, n-gram) rows of a part of a model, which is built on the driver and sent to every worker. Only the n-grams of one
#: character (as last but one) are never divided.
PART_ROWS = 4_000_000
#: A part's n-grams times all languages, at most so many times PART_ROWS: an n-gram takes a cell of each language, its own or not.
ROW_LANGUAGES = 5
#: Nats a character beyond the worst training text of a language before a text is rejected.
SLACK = 1.0
UNDETERMINED = "und"
_CODES: list[np.ndarray] = []


def _letter_codes() -> np.ndarray:
    """For each code point 16 bits: itself, or a private place, if it is a letter, START for START, else 0."""
    if not _CODES:
        codes = np.zeros(sys.maxunicode + 1, np.uint16)
        letters = np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
        at = np.flatnonzero(letters)
        codes[at] = np.where(at < 0x10000, at, 0xE000 + at % 0x1900)
        codes[START] = START
        _CODES.append(codes)
    return _CODES[0]


def windows(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(key of the ORDER characters up to each character, number of characters of each text): texts in order.

    Texts are lower-cased; each run of other characters than letters is one space. A text without letters
    has no characters.
    """
    common.worker_memory("language")
    pad = chr(START) * (ORDER - 1)
    lowered = [(t or "").lower().replace(chr(START), " ") for t in texts]
    points = np.frombuffer((pad + pad.join(lowered)).encode("utf-32-le", "replace"), "<u4")
    codes = _letter_codes()[points]
    before = np.concatenate([[np.uint16(START)], codes[:-1]])
    space = (codes == 0) & (before > START)
    codes[space] = SPACE
    starts = np.cumsum([0, *(len(t) + ORDER - 1 for t in lowered)])[:-1]
    kept = codes > 0
    place = np.cumsum(kept) - kept
    seq = codes[kept].astype(np.uint64)
    real = seq > START
    keys = seq.copy()
    for k in range(1, ORDER):
        keys[k:] |= seq[:-k] << np.uint64(16 * k)
    owner_start = np.concatenate([place[starts], [len(seq)]])
    counts = np.diff(np.concatenate([[0], np.cumsum(real)])[owner_start])
    return keys[real], counts


def _sum_counts(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their numbers."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


class _Counter:
    """Counts of keys, merged now and then."""

    def __init__(self) -> None:
        self.keys, self.n, self.new, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def add(self, keys: np.ndarray) -> None:
        keys = np.sort(keys)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        self.new.append((keys[first], np.diff(np.append(first, len(keys)))))
        self.size += len(first)
        if self.size > 1_000_000:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        self.keys, self.n = _sum_counts(np.concatenate([self.keys, *(k for k, _ in self.new)]), np.concatenate([self.n, *(n for _, n in self.new)]))
        self.new, self.size = [], 0
        return self.keys, self.n


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counters: dict[str, _Counter] = {}
    for batch in batches:
        texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        order = sorted(range(len(texts)), key=langs.__getitem__)
        texts, langs = [texts[i] for i in order], [langs[i] for i in order]
        for lo, hi in shingles.grouped(texts):
            keys, counts = windows(texts[lo:hi])
            ends = np.cumsum(counts)
            at = lo
            while at < hi:
                stop = next((i for i in range(at, hi) if langs[i] != langs[at]), hi)
                begin = int(ends[at - lo - 1]) if at > lo else 0
                counters.setdefault(langs[at], _Counter()).add(keys[begin : int(ends[stop - lo - 1])])
                at = stop
    for lang, counter in counters.items():
        keys, n = counter.merge()
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "key", "n"])


def ngram_counts(training: DataFrame) -> DataFrame:
    """(lang, key, n) over all rows of training(text, lang): summed in each task before the shuffle."""
    plain = training.where("text is not null and lang is not null").select(F.col("text").cast("string"), F.col("lang").cast("string"))
    return plain.mapInArrow(_counted, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))


def _find(among: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key in a sorted array, or -1."""
    if not len(among):
        return np.full(len(keys), -1)
    at = np.searchsorted(among, keys)
    at[at == len(among)] = 0
    return np.where(among[at] == keys, at, -1)


def discount_of(n1: int, n2: int) -> float:
    n1, n2 = max(1, n1), max(1, n2)
    return min(0.95, max(0.1, n1 / (n1 + 2 * n2)))


class _OneLanguage:
    """Interpolated Kneser-Ney probabilities of one language from its counts of the highest order.

    Of a part of the counts, `discounts` by order and the counts of single characters are those of all parts.
    """

    def __init__(self, keys: np.ndarray, n: np.ndarray, discounts: dict[int, float] | None = None, single: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        self.orders: dict[int, tuple] = {}
        for k in range(ORDER, 0, -1):
            if k == 1 and single is not None:
                keys, n = single
            discount = discounts[k] if discounts else discount_of(int((n == 1).sum()), int((n == 2).sum()))
            contexts, totals = _sum_counts(keys >> np.uint64(16), n)
            types = _sum_counts(keys >> np.uint64(16), np.ones(len(keys), np.int64))[1]
            self.orders[k] = (keys, n, discount, contexts, totals, types)
            # lower orders count the different characters before: continuations
            keys, n = _sum_counts(keys & np.uint64((1 << 16 * (k - 1)) - 1), np.ones(len(keys), np.int64))
        self.floor = 1.0 / (len(self.orders[1][0]) + 1)

    def probability(self, k: int, keys: np.ndarray) -> np.ndarray:
        if k == 0:
            return np.full(len(keys), self.floor)
        own, n, discount, contexts, totals, types = self.orders[k]
        lower = self.probability(k - 1, keys & np.uint64((1 << 16 * (k - 1)) - 1))
        if not len(own):  # a part may hold nothing of a language
            return lower
        at, c = _find(own, keys), _find(contexts, keys >> np.uint64(16))
        seen = np.where(at >= 0, np.maximum(n[at] - discount, 0), 0.0)
        return np.where(c >= 0, (seen + discount * types[c] * lower) / np.maximum(totals[c], 1), lower)

    def backoff(self, k: int, contexts: np.ndarray) -> np.ndarray:
        _, _, discount, own, totals, types = self.orders[k]
        if not len(own):
            return np.ones(len(contexts))
        c = _find(own, contexts)
        return np.where(c >= 0, discount * types[c] / np.maximum(totals[c], 1), 1.0)


@dataclass
class Model:
    langs: list[str]
    #: order -> (sorted keys, log probabilities by language); order -> (sorted contexts, log back-off weights by language)
    grams: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    backs: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    floor: np.ndarray = None

    def log_probabilities(self, keys: np.ndarray, k: int = ORDER) -> np.ndarray:
        """Log probability of each n-gram's last character in each language (rows by n-gram)."""
        if k == 0:
            return np.broadcast_to(self.floor, (len(keys), len(self.langs)))
        own, table = self.grams[k]
        at = _find(own, keys)
        out = table[at]
        missing = np.flatnonzero(at < 0)
        if len(missing):
            rare = keys[missing]
            contexts, weights = self.backs[k]
            c = _find(contexts, rare >> np.uint64(16))
            lower = self.log_probabilities(rare & np.uint64((1 << 16 * (k - 1)) - 1), k - 1)
            out[missing] = lower + np.where((c >= 0)[:, None], weights[c], np.float32(0))
        return out

    def sums(self, texts: list[str | None], part: tuple[int, int] = (0, 1 << 16)) -> tuple[np.ndarray, np.ndarray]:
        """(nats by text and language over the characters whose n-grams are in the part, characters of each text)."""
        keys, counts = windows(texts)
        sums = np.zeros((len(texts), len(self.langs)))
        step = max(1, 2_000_000 // max(1, len(self.langs)))
        ends = np.cumsum(counts)
        for lo in range(0, len(keys), step):
            own, at = keys[lo : lo + step], np.arange(lo, min(lo + step, len(keys)))
            if part != (0, 1 << 16):
                inside = _part_of(own, part)
                own, at = own[inside], at[inside]
            if len(own):
                owner = np.searchsorted(ends, at, side="right")
                cuts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                np.add.at(sums, owner[cuts], np.add.reduceat(self.log_probabilities(own).astype(np.float64), cuts, axis=0))
        return -sums, counts

    def cross_entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(nats a character by text and language, characters of each text)."""
        sums, counts = self.sums(texts)
        return sums / np.maximum(counts, 1)[:, None], counts


def _part_of(keys: np.ndarray, part: tuple[int, int]) -> np.ndarray:
    before = keys >> np.uint64(16) & np.uint64(0xFFFF)
    return (before >= np.uint64(part[0])) & (before < np.uint64(part[1]))


def build(counts: dict[str, tuple[np.ndarray, np.ndarray]], discounts: dict[str, dict[int, float]] | None = None, single: dict[str, tuple[np.ndarray, np.ndarray]] | None = None) -> Model:
    langs = sorted(single or counts)
    nothing = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    own = {x: _OneLanguage(*_sum_counts(*counts.get(x, nothing)), *((discounts[x], single[x]) if single else ())) for x in langs}
    model = Model(langs)
    for k in range(1, ORDER + 1):
        keys = np.unique(np.concatenate([own[x].orders[k][0] for x in langs]))
        contexts = np.unique(np.concatenate([own[x].orders[k][3] for x in langs]))
        model.grams[k] = keys, np.stack([np.log(own[x].probability(k, keys)) for x in langs], axis=1).astype(np.float32)
        model.backs[k] = contexts, np.stack([np.log(own[x].backoff(k, contexts)) for x in langs], axis=1).astype(np.float32)
    model.floor = np.log([own[x].floor for x in langs]).astype(np.float32)
    return model


@dataclass
class Identifier:
    """A model in parts, made when they are asked for from the stored counts; what a judgement needs besides the sums."""

    counts: DataFrame
    langs: list[str]
    parts: list[tuple[int, int]]
    discounts: dict[str, dict[int, float]] | None = None
    single: dict[str, tuple[np.ndarray, np.ndarray]] | None = None
    judge: Judge = None
    whole: Model | None = None

    def part(self, i: int) -> Model:
        if len(self.parts) > 1:
            before = F.shiftrightunsigned("key", 16).bitwiseAND(F.lit(0xFFFF))
            return build(_by_language(self.counts.where((before >= self.parts[i][0]) & (before < self.parts[i][1]))), self.discounts, self.single)
        if self.whole is None:
            self.whole = build(_by_language(self.counts))
        return self.whole


@dataclass
class Judge:
    langs: list[str]
    sharpness: float = 20.0
    bound: np.ndarray = None

    def posterior(self, entropies: np.ndarray) -> np.ndarray:
        e = np.exp(-self.sharpness * (entropies - entropies.min(axis=1, keepdims=True)))
        return e / e.sum(axis=1, keepdims=True)

    def judged(self, sums: np.ndarray, counts: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, cross-entropy, whether it is rejected) of each text."""
        entropies = sums / np.maximum(counts, 1)[:, None]
        won, some, rows = entropies.argmin(axis=1), counts > 0, np.arange(len(counts))
        lang = [self.langs[w] if s else UNDETERMINED for w, s in zip(won, some, strict=True)]
        score = np.where(some, self.posterior(entropies)[rows, won], 0.0)
        return lang, score, np.where(some, entropies[rows, won], np.nan), ~some | (entropies[rows, won] > self.bound[won])


def _by_language(counts: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    table = counts.select("lang", "key", "n").toArrow()
    # codes in place of a string object a row
    lang = table["lang"].combine_chunks().dictionary_encode()
    codes, keys, n = lang.indices.to_numpy(), table["key"].to_numpy().view(np.uint64), table["n"].to_numpy()
    return {x: (keys[codes == i], n[codes == i]) for i, x in enumerate(lang.dictionary.to_pylist())}


def in_parts(counts: DataFrame, part_rows: int) -> Identifier | None:
    """An identifier of stored counts(lang, key, n); None without a row."""
    before = F.shiftrightunsigned("key", 16).bitwiseAND(F.lit(0xFFFF)).cast("int")
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    # a part is a table of its n-grams by all languages
    n = F.greatest(F.sum("rows"), F.ceil(F.count(F.lit(1)) * (len(langs) / ROW_LANGUAGES)))
    sizes = counts.groupBy(before.alias("c"), "key").agg(F.count(F.lit(1)).alias("rows")).groupBy("c").agg(n.alias("n")).orderBy("c").collect()
    if not sizes:
        return None
    cuts, held = [0], 0
    for r in sizes:
        if held and held + r["n"] > part_rows:
            cuts.append(r["c"])
            held = 0
        held += r["n"]
    parts = list(zip(cuts, [*cuts[1:], 1 << 16], strict=True))
    out = Identifier(counts, langs, parts, judge=Judge(langs, bound=np.full(len(langs), np.inf)))
    if len(parts) > 1:
        out.discounts, table = {x: {} for x in langs}, counts
        for k in range(ORDER, 0, -1):
            for r in table.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2")).collect():
                out.discounts[r["lang"]][k] = discount_of(r["n1"], r["n2"])
            if k == 1:
                single = _by_language(table)
                out.single = {x: _sum_counts(*single[x]) for x in langs}
            else:
                table = table.groupBy("lang", F.col("key").bitwiseAND(F.lit((1 << 16 * (k - 1)) - 1)).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return out


def _sums(rows: DataFrame, identifier: Identifier, carried: str) -> DataFrame:
    """(carried, chars, sums) for rows(text, carried): nats of every row's whole text by language."""
    spark = rows.sparkSession
    kind = dict(rows.dtypes)[carried]

    def summed(df: DataFrame, i: int, name: str, kind: str) -> DataFrame:
        shared, part = spark.sparkContext.broadcast(identifier.part(i)), identifier.parts[i]

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(0).to_pylist()
                for lo, hi in shingles.grouped(texts):
                    sums, counts = shared.value.sums(texts[lo:hi], part)
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1) * sums.shape[1], pa.int32()), pa.array(sums.ravel()))
                    yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo), pa.array(counts, pa.int64()), flat], names=[name, "chars", "sums"])

        return df.select(F.col("text").cast("string"), name).mapInArrow(run, f"{name} {kind}, chars long, sums array<double>")

    if len(identifier.parts) == 1:
        return summed(rows, 0, carried, kind)
    stored = common.save(spark, rows.select(F.col("text").cast("string"), carried).withColumn("_row", F.monotonically_increasing_id()), "language-rows")
    each = [common.save(spark, summed(stored, i, "_row", "long"), "language-sums") for i in range(len(identifier.parts))]
    every = each[0]
    for x in each[1:]:
        every = every.unionByName(x)
    total = every.groupBy("_row").agg(F.max("chars").alias("chars"), F.array(*[F.sum(F.col("sums")[k]) for k in range(len(identifier.langs))]).alias("sums"))
    return stored.select("_row", carried).join(total, "_row").drop("_row")


def _calibrate(identifier: Identifier, training: DataFrame, rows: int) -> None:
    """Sharpness of scores: the likeliest for the given languages of the `rows` training rows with the smallest hashes."""
    ids = training.select("doc_id", F.xxhash64(F.lit("calibration"), "doc_id").alias("_h")).orderBy("_h").limit(rows).select("doc_id").distinct()
    seen = _sums(training.join(F.broadcast(ids), "doc_id", "left_semi").select("text", "lang"), identifier, "lang").where("chars > 0").orderBy("chars", "lang").limit(rows).toArrow()
    if not seen.num_rows:
        return
    entropies = np.stack(seen["sums"].to_numpy(zero_copy_only=False)) / seen["chars"].to_numpy()[:, None]
    place = {x: i for i, x in enumerate(identifier.langs)}
    truth = np.array([place[x] for x in seen["lang"].to_pylist()])
    best: tuple[float, float] | None = None
    for s in (1.0, 2.0, 3.0, 5.0, 7.0, 10.0, 15.0, 20.0, 30.0, 50.0):
        identifier.judge.sharpness = s
        loss = -np.log(np.maximum(identifier.judge.posterior(entropies)[np.arange(len(truth)), truth], 1e-6)).mean()
        if best is None or loss < best[0]:
            best = (loss, s)
    identifier.judge.sharpness = best[1]


def _set_bounds(identifier: Identifier, training: DataFrame) -> None:
    """The rejection bound of each language, from all rows of training(text, lang).

    It is SLACK beyond the worst text of the language that the language wins; of a language that wins none of its
    texts, beyond the worst of them.
    """
    place = F.array_position(F.array(*[F.lit(x) for x in identifier.langs]), F.col("lang")).cast("int")
    seen = _sums(training.select("text", "lang"), identifier, "lang").where("chars > 0").select(place.alias("at"), "sums", "chars")
    mine = F.element_at("sums", F.col("at"))
    worst = F.coalesce(F.max(F.when(mine == F.array_min("sums"), mine / F.col("chars"))), F.max(mine / F.col("chars")))
    for r in seen.groupBy("at").agg(worst.alias("worst")).collect():
        identifier.judge.bound[r["at"] - 1] = r["worst"] + SLACK


def train(training: DataFrame, calibration_rows: int = CALIBRATION_ROWS, part_rows: int = PART_ROWS) -> Identifier | None:
    """A model of all languages of training(doc_id, text, lang); None where no row has text and language.

    The model holds every n-gram of all rows, in parts of about part_rows; its rejection bounds are from all rows too. Only the
    sharpness is fitted on a bounded sample.
    """
    spark = training.sparkSession
    common.ensure_workers(spark)
    usable = training.where("text is not null and lang is not null").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    identifier = in_parts(common.save(spark, ngram_counts(usable), "ngrams"), part_rows)
    if identifier is not None:
        _calibrate(identifier, usable, calibration_rows)
        _set_bounds(identifier, usable)
    return identifier


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


PREDICTED = "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean"


def identify(docs: DataFrame, identifier: Identifier | None) -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy and rejected for every row of docs(doc_id, text).

    A text that is null or has no letter is ``und`` with score 0 and is rejected; so is every text without
    a model. Else lang_pred is the language with the lowest cross-entropy (the first in order of names on a
    tie), score its calibrated probability, and rejected says that the cross-entropy is beyond that
    language's bound. Texts are read whole; repeated rows give a row each; other columns are ignored.
    """
    common.ensure_workers(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    if identifier is None:
        return plain.select("doc_id", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"), F.lit(True).alias("rejected"))
    judge = identifier.judge

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sums, counts = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1), batch.column(1).to_numpy()
                lang, score, value, rejected = judge.judged(sums, counts)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang), pa.array(score), pa.array(value, from_pandas=True), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "cross_entropy", "rejected"])

    return _sums(plain, identifier, "doc_id").mapInArrow(run, PREDICTED)


def with_language(docs: DataFrame, identifier: Identifier | None) -> DataFrame:
    """The documents that `identify` doesn't reject, with all their columns; none without a model."""
    spark = docs.sparkSession
    common.ensure_workers(spark)
    if identifier is None:
        return docs.limit(0)
    judge = identifier.judge
    if len(identifier.parts) > 1:
        row = common.fresh(docs, "_row")
        stored = common.save(spark, docs.withColumn(row, F.monotonically_increasing_id()), "language-docs")
        fine = identify(stored.select(F.col(row).alias("doc_id"), "text"), identifier).where("not rejected").select(F.col("doc_id").alias(row))
        return stored.join(fine, row, "left_semi").drop(row)
    shared = spark.sparkContext.broadcast(identifier.part(0))

    def keep():
        return lambda texts: [not r for lo, hi in shingles.grouped(texts) for r in judge.judged(*shared.value.sums(texts[lo:hi]))[3]]

    return common.filtered(docs, keep)
