"""Toxicity by a learned lexicon, met by Levenshtein automata over its trie, and context windows around hits.

The lexicon is words and word beginnings (stems) that labelled toxic documents use and others don't. Its
trie and the Levenshtein automaton of a word are intersected as one lazily determinized automaton: a state
is the set of (trie node, edits) that a prefix can stand for, so every distinct word is read once, and
most die within a few letters. Terms weigh as their odds among toxic documents, hits count as quoted or as abuse by
the marks and words around them, and a logistic model turns the sums into a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .language_id import held_out

#: Labelled rows to fit on: those with the smallest hashes, half for the lexicon, half for the weights.
FIT_ROWS = 20_000
#: A term is in so many toxic documents at least, beyond chance, and so large a share of those that have it is toxic. Copies of a
#: text don't make a term: its toxic documents count no more than the different words around it.
LEAST_DOCS, PURITY = 3, 0.7
#: Terms are words of 3 letters or more, or beginnings of these lengths that no single word accounts for.
LEAST_LETTERS, STEM_LENGTHS, ONE_WORD = 3, (4, 5, 6, 7, 8), 0.6
#: Edits allowed in a word, and in a beginning, of so many letters at least; any ending fits a beginning, so it takes fewer.
EDITS, STEM_EDITS = ((8, 2), (5, 1)), ((7, 1),)
#: Words on each side of a hit that tell quotation from abuse.
WINDOW = 6
#: Parameters of the context windows, for the four languages of the tables: words that report speech, or address someone.
REPORTING = frozenset("said says wrote writes called calls quoted quote word term sagte schrieb nannte zitat wort dit écrit appelé citation mot dijo escribió llamó cita palabra".split())
ADDRESSING = frozenset("you your youre u du dein deine ihr euch tu te toi ton vous votre tú ti usted".split())
QUOTES = frozenset("\"“”„«»‹›")
TOKEN = re.compile(r"\w+|[\"“”„«»‹›]")
#: What a worker keeps: distinct words of at most KEPT_LENGTH letters, and steps of the automaton. Results don't depend on it.
KEPT_WORDS, KEPT_LENGTH, KEPT_STEPS = 200_000, 64, 200_000
FEATURES = ("word", "stem", "quoted", "addressed", "density")
#: Features whose weights may not be negative: a hit never speaks for a text.
HITS = ("word", "stem", "addressed", "density")
#: Terms whose misspellings have log odds below this are met exactly only.
LEAST_ODDS = 1.0


def edits_of(term: str, allowed: tuple = EDITS) -> int:
    return next((d for n, d in allowed if len(term) >= n), 0)


class LexiconAutomaton:
    """The lexicon's trie met with Levenshtein automata; `match` gives (kind, term) of a word, or None.

    A word is a hit if it is within the edits of a lexicon word, or some proper beginning of it within those of a stem;
    terms of `plain` are met exactly only.
    """

    def __init__(self, words: Iterable[str], stems: Iterable[str] = (), plain: Iterable[str] = ()) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.word_at: dict[int, str] = {}
        self.stem_at: dict[int, str] = {}
        self.allowed: list[int] = [0]  # edits that some term below the node allows
        exact = set(plain)
        self.word_edits = {t: 0 if t in exact else edits_of(t) for t in words}
        self.stem_edits = {t: 0 if t in exact else edits_of(t, STEM_EDITS) for t in stems}
        for w in sorted(self.word_edits):
            self._insert(w, self.word_at, self.word_edits[w])
        for s in sorted(self.stem_edits):
            self._insert(s, self.stem_at, self.stem_edits[s])
        self.alphabet = {c for x in self.children for c in x}
        self.start = self._closed({0: 0})
        self._reset()

    def _reset(self) -> None:
        self.states: dict[frozenset, int] = {frozenset(self.start.items()): 0}
        self.items, self.steps, self.n_steps = [self.start], [{}], 0
        self.accepts, self.begins = [self._accept(self.start, self.word_at, self.word_edits)], [self._accept(self.start, self.stem_at, self.stem_edits)]

    def _insert(self, term: str, ends: dict[int, str], edits: int) -> None:
        at = 0
        self.allowed[0] = max(self.allowed[0], edits)
        for c in term:
            if c not in self.children[at]:
                self.children[at][c] = len(self.children)
                self.children.append({})
                self.allowed.append(0)
            at = self.children[at][c]
            self.allowed[at] = max(self.allowed[at], edits)
        ends[at] = term

    def _closed(self, items: dict[int, int]) -> dict[int, int]:
        """With letters of the lexicon left out of the word."""
        todo = list(items)
        while todo:
            node = todo.pop()
            edits = items[node] + 1
            for child in self.children[node].values():
                if edits <= self.allowed[child] and edits < items.get(child, 99):
                    items[child] = edits
                    todo.append(child)
        return items

    @staticmethod
    def _accept(items: dict[int, int], ends: dict[int, str], allowed: dict[str, int]) -> tuple[int, str] | None:
        found = [(edits, ends[node]) for node, edits in items.items() if node in ends and edits <= allowed[ends[node]]]
        return min(found, default=None)

    def _step(self, state: int, letter: str) -> int:
        out: dict[int, int] = {}

        def put(node: int, edits: int) -> None:
            if edits <= self.allowed[node] and edits < out.get(node, 99):
                out[node] = edits

        for node, edits in self.items[state].items():
            put(node, edits + 1)
            for c, child in self.children[node].items():
                if c == letter:
                    if edits < out.get(child, 99):
                        out[child] = edits
                else:
                    put(child, edits + 1)
        out = self._closed(out)
        key = frozenset(out.items())
        if key not in self.states:
            self.states[key] = len(self.items)
            self.items.append(out)
            self.steps.append({})
            self.accepts.append(self._accept(out, self.word_at, self.word_edits))
            self.begins.append(self._accept(out, self.stem_at, self.stem_edits))
        self.steps[state][letter] = self.states[key]
        self.n_steps += 1
        return self.states[key]

    def match(self, word: str) -> tuple[str, str] | None:
        if self.n_steps > KEPT_STEPS:
            self._reset()
        state, stem = 0, None
        for c in word:
            if (begun := self.begins[state]) is not None and (stem is None or begun < stem):
                stem = begun
            c = c if c in self.alphabet else "\0"
            following = self.steps[state].get(c)
            state = self._step(state, c) if following is None else following
            if not self.items[state]:
                found = None
                break
        else:
            found = self.accepts[state]
        if found is not None and found[0] == 0:
            return "exact", found[1]
        if stem is not None and stem[0] == 0:
            return "stem", stem[1]
        best = min((x for x in (found, stem) if x is not None), default=None)
        return None if best is None else ("fuzzy", best[1])


@dataclass
class Model:
    """Words and stems with their log odds; near: the log odds of misspellings of each; plain: terms that are met exactly only."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    near: dict[str, float] = field(default_factory=dict)
    plain: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(FEATURES)))
    bias: float = -10.0
    scale: np.ndarray = field(default_factory=lambda: np.ones(len(FEATURES)))
    reporting: frozenset = REPORTING
    addressing: frozenset = ADDRESSING

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((x / self.scale) @ self.weights + self.bias, -30, 30)))


class Scanner:
    """Features of texts; distinct words are matched once."""

    def __init__(self, model: Model) -> None:
        self.automaton = LexiconAutomaton(model.words, model.stems, model.plain)
        self.model = model
        self.clean: set[str] = set()
        self.toxic: dict[str, tuple[str, str]] = {}

    def hits(self, distinct: set[str]) -> dict[str, tuple[str, str]]:
        """(kind, term) of each of these words that is a hit."""
        found = {}
        for w in distinct - self.clean:
            if (m := self.toxic.get(w)) is None and (m := self.automaton.match(w)) is None:
                if len(w) <= KEPT_LENGTH:
                    self.clean.add(w)
                continue
            found[w] = m
            if len(w) <= KEPT_LENGTH:
                self.toxic[w] = m
        if len(self.clean) + len(self.toxic) > KEPT_WORDS:
            self.clean.clear()
            self.toxic.clear()
        return found

    def features(self, text: str | None) -> list[float]:
        return self.features_and_hits(text)[0]

    def features_and_hits(self, text: str | None) -> tuple[list[float], int]:
        tokens = TOKEN.findall((text or "").lower())
        counts = dict.fromkeys(FEATURES, 0.0)
        found = self.hits(set(tokens))
        if not found:
            return list(counts.values()), 0
        model, depth, hits, n = self.model, 0, 0.0, 0
        for i, t in enumerate(tokens):
            if t in QUOTES:
                depth += 1
            elif t in found:
                kind, term = found[t]
                whole = term in model.words
                weight = (model.words if whole else model.stems)[term] if kind != "fuzzy" else model.near.get(term, 0.0)
                hits += weight
                n += 1
                before, after = tokens[max(0, i - WINDOW) : i], tokens[i + 1 : i + WINDOW + 1]
                marked = not QUOTES.isdisjoint(before) and not QUOTES.isdisjoint(after) and depth % 2 == 1
                if marked or not model.reporting.isdisjoint(before):
                    counts["quoted"] += weight
                else:
                    counts["word" if whole else "stem"] += weight
                    counts["addressed"] += not (model.addressing.isdisjoint(before) and model.addressing.isdisjoint(after))
        for k in FEATURES[:-1]:
            counts[k] = float(np.log1p(counts[k]))
        counts["density"] = hits / len(tokens) if tokens else 0.0
        return list(counts.values()), n


def _terms(text: str) -> tuple[set[str], set[str]]:
    words = {w for w in re.findall(r"\w+", text.lower()) if len(w) >= LEAST_LETTERS and not w.isdigit()}
    return words, {w[:n] for w in words for n in STEM_LENGTHS if len(w) > n}


def _term_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[bool, Counter] = {True: Counter(), False: Counter()}
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words, stems = _terms(text)
            held[toxic == 1].update([("w", w) for w in words] + [("s", s) for s in stems])
    for toxic, counts in held.items():
        items = list(counts.items())
        for lo in range(0, len(items), 50_000):
            part = items[lo : lo + 50_000]
            n = [x[1] for x in part]
            zero = [0] * len(n)
            yield pa.RecordBatch.from_arrays([pa.array([x[0][0] for x in part]), pa.array([x[0][1] for x in part]), pa.array(n if toxic else zero, pa.int64()), pa.array(zero if toxic else n, pa.int64())], names=["kind", "term", "toxic", "other"])


def _contexts(candidates: dict[str, set[str]]):
    """(kind, term, toxic, context) of candidate terms in batches of (text, toxic): the word with its neighbours, hashed."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = re.findall(r"\w+", text.lower())
                for i, w in enumerate(words):
                    here = [("w", w)] if w in candidates["w"] else []
                    here += [("s", w[:n]) for n in STEM_LENGTHS if len(w) > n and w[:n] in candidates["s"]]
                    if here:
                        around = crc32(" ".join(words[max(0, i - 1) : i + 2]).encode())
                        found.update((kind, term, toxic == 1, around) for kind, term in here)
            rows = list(zip(*found, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.bool_()), pa.array(rows[3], pa.int64())], names=["kind", "term", "toxic", "around"])

    return run


def _beyond_chance(toxic: Column, other: Column, base: float) -> Column:
    """Chernoff's bound, as a logarithm, on a term of its frequency being so toxic at the base rate."""
    n = toxic + other
    clean = F.when(other > 0, other * F.ln(other / n / (1 - base))).otherwise(0.0)
    return F.when(toxic > n * base, toxic * F.ln(toxic / n / base) + clean).otherwise(0.0)


def _lexicon(labelled: DataFrame) -> Model:
    """Words and stems with their log odds, from rows of (text, toxic); no terms where labels are all alike."""
    spark = labelled.sparkSession
    n_toxic, n_rows = labelled.agg(F.count_if(F.col("toxic") == 1), F.count(F.lit(1))).first()
    if not 0 < n_toxic < n_rows:
        return Model()
    base = n_toxic / n_rows
    counts = labelled.select("text", "toxic").mapInArrow(_term_counts, "kind string, term string, toxic long, other long").groupBy("kind", "term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    often = common.save(spark, counts.where(F.col("toxic") >= LEAST_DOCS), "toxicity-terms")
    least = float(np.log(max(often.count(), 2)))  # one chance hit among all terms
    pure = lambda t: (t >= PURITY * (t + F.col("other"))) & (_beyond_chance(t, F.col("other"), base) >= least)
    able = common.save(spark, often.where(pure(F.col("toxic"))), "toxicity-candidates")
    candidates: dict[str, set[str]] = {"w": set(), "s": set()}
    for r in able.select("kind", "term").toLocalIterator():
        candidates[r["kind"]].add(r["term"])
    shared = spark.sparkContext.broadcast(candidates)
    around = labelled.select("text", "toxic").mapInArrow(lambda it: _contexts(shared.value)(it), "kind string, term string, toxic boolean, around long")
    places = around.where("toxic").groupBy("kind", "term").agg(F.count_distinct("around").alias("places"))
    kept = able.join(places, ["kind", "term"]).withColumn("toxic", F.least("toxic", "places")).where((F.col("toxic") >= LEAST_DOCS) & pure(F.col("toxic")))
    odds = F.ln((F.col("toxic") + 0.5) / (F.col("other") + 0.5) * float((1 - base) / base))
    rows = kept.select("kind", "term", "toxic", "other", odds.alias("odds"), _beyond_chance(F.col("toxic"), F.col("other"), base).alias("evidence")).collect()
    words = {r["term"]: r for r in rows if r["kind"] == "w"}
    most: dict[str, int] = {}
    for w, r in words.items():
        for k in STEM_LENGTHS:
            if len(w) > k:
                most[w[:k]] = max(most.get(w[:k], 0), r["toxic"])
    stems, beginnings = {}, set()
    for r in sorted((r for r in rows if r["kind"] == "s"), key=lambda r: (-r["evidence"], -len(r["term"]), r["term"])):
        s = r["term"]
        if most.get(s, 0) < ONE_WORD * r["toxic"] and s not in beginnings and not any(s[:k] in stems for k in STEM_LENGTHS):
            stems[s] = r["odds"]
            beginnings |= {s[:k] for k in STEM_LENGTHS}
    alone = {w: r["odds"] for w, r in words.items() if not any(len(w) > k and w[:k] in stems for k in STEM_LENGTHS)}
    model = Model(alone, stems)
    share = {r["term"]: (r["toxic"] + 0.5) / (r["toxic"] + r["other"] + 1) for r in rows}
    model.near = _near_odds(labelled, model, share, base)
    model.plain = sorted(t for t, x in model.near.items() if x < LEAST_ODDS)
    return model


def _near_odds(labelled: DataFrame, model: Model, share: dict[str, float], base: float) -> dict[str, float]:
    """Log odds of misspellings of each term: those of the term, as one document, with the documents that hold words near it.

    Clean ones count twice, and half a one is added: a misspelling that was never seen says less than the term.
    """
    shared = labelled.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, counts = Scanner(shared.value), Counter()
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                near = {term for kind, term in scanner.hits(set(TOKEN.findall(text.lower()))).values() if kind == "fuzzy"}
                counts.update((t, toxic == 1) for t in near)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.bool_()), pa.array(list(counts.values()), pa.int64())], names=["term", "toxic", "n"])

    seen = labelled.select("text", "toxic").mapInArrow(run, "term string, toxic boolean, n long").groupBy("term", "toxic").agg(F.sum("n").alias("n")).collect()
    n = {(r["term"], r["toxic"]): r["n"] for r in seen}
    return {t: float(np.log((share[t] + n.get((t, True), 0)) / (1.5 - share[t] + 2 * n.get((t, False), 0)) * (1 - base) / base)) for t in (*model.words, *model.stems)}


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, bias and scale of a ridge logistic regression; those of HITS are zero where they would be negative."""
    scale = np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1.0)
    use = list(range(x.shape[1]))
    while True:
        a = np.column_stack([x[:, use] / scale[use], np.ones(len(x))])
        w, penalty = np.zeros(a.shape[1]), np.append(np.full(len(use), ridge), 1e-6)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty + 1e-9), a.T @ (p - y) + penalty * w)
            w = w - step
            if np.abs(step).max() < 1e-8:
                break
        bad = [k for k, i in enumerate(use) if FEATURES[i] in HITS and w[k] < 0]
        if not bad:
            weights = np.zeros(x.shape[1])
            weights[use] = w[:-1]
            return weights, float(w[-1]), scale
        use.pop(min(bad, key=lambda k: w[k]))


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, reporting: Iterable[str] = REPORTING, addressing: Iterable[str] = ADDRESSING, quoted: float = 0.0) -> Model:
    """Lexicon and weights from at most fit_rows labelled rows of labels(doc_id, toxic) that are not held out.

    Rows with a null id, text or label teach nothing; of a doc_id with several labels the greatest counts, and rows of a repeated
    doc_id each teach. The lexicon has no bound of its own: it grows with the different words of those rows at most.
    `reporting` and `addressing` are the words that tell quotation and address in a context window. The weight of quoted terms
    is learned like the others, and may be below zero; where the rows hold none it is `quoted`, for each log(1 + odds) of them.
    Without a toxic row the lexicon is empty and every score near 0.
    """
    spark = docs.sparkSession
    common.ensure_workers(spark)
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    taken = usable.withColumn("_h", F.xxhash64(F.lit("toxicity"), "_id")).orderBy("_h", "_id").limit(fit_rows)
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(taken), "_id")
    rows = common.save(spark, rows.select("text", "toxic", (F.pmod("_h", F.lit(2)) == 0).alias("first")), "toxicity-fit")
    model = _lexicon(rows.where("first"))
    model.reporting, model.addressing = frozenset(reporting), frozenset(addressing)
    seen = rows.where("not first").mapInArrow(_features(spark.sparkContext.broadcast(model)), "toxic int, x array<double>").toArrow()
    y = seen["toxic"].to_numpy()
    if len(y) and 0 < y.sum() < len(y) and (model.words or model.stems):
        x, at = np.stack(seen["x"].to_numpy(zero_copy_only=False)), FEATURES.index("quoted")
        model.weights, model.bias, model.scale = _logistic(x, (y == 1).astype(float))
        if not x[:, at].any():
            model.weights[at] = quoted
    return model


def _features(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(shared.value)
        for batch in batches:
            x = [scanner.features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int32()), pa.array(x, pa.list_(pa.float64()))], names=["toxic", "x"])

    return run


SCORED = "doc_id long, score double, predicted int, n_hits long"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted and n_hits for every row of docs(doc_id, text).

    A null or empty text has the score of a text without hits. Texts are read whole; repeated rows give a
    row each; other columns are ignored. predicted is 1 for scores of 0.5 or more.
    """
    spark = docs.sparkSession
    common.ensure_workers(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                ids, texts = (batch.slice(lo, 1024).column(i) for i in (0, 1))
                rows = [scanner.features_and_hits(t) for t in texts.to_pylist()]
                s = shared.value.scores(np.array([r[0] for r in rows]).reshape(-1, len(FEATURES)))
                hits = np.array([r[1] for r in rows], np.int64)
                yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(hits)], names=["doc_id", "score", "predicted", "n_hits"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCORED)


def _scanner(model: Model) -> Scanner:
    """A worker's scanner of a model, which keeps what it learned of words from task to task."""
    kept = common.worker_memory("toxicity")
    key = (tuple(sorted(model.words.items())), tuple(sorted(model.stems.items())), tuple(sorted(model.near.items())), tuple(sorted(model.plain)), model.reporting, model.addressing)
    if key not in kept:
        kept.clear()
        kept[key] = Scanner(model)
    return kept[key]


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that `score` gives less than 0.5, with all their columns; null and empty texts stay."""
    common.ensure_workers(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep():
        model, scanner = shared.value, _scanner(shared.value)
        return lambda texts: (model.scores(np.array([scanner.features(t) for t in texts]).reshape(-1, len(FEATURES))) < 0.5).tolist()

    return common.filtered(docs, keep)
