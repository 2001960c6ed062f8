"""Large groups, many languages, edits and quotations, and what the operators refuse."""

import random
from itertools import combinations

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from caliperlab.llm import bpe_automaton, common, language_id, order_minhash, spherical_filters, toxicity


def wide_group(spark, n, rest):
    """A group of n members, all but the first `rest` joined."""
    u = 1 / order_minhash.FAMILY_BLOCK
    wide = common.save(spark, spark.range(n).select(F.lit(7).cast("long").alias("part"), F.col("id").alias("node"), F.lit(u).alias("u")), "wide")
    label = wide.where(F.col("node") >= rest).select("node", F.lit(rest).cast("long").alias("component"))
    return order_minhash._against_rest(wide, label, ["node"])


def test_what_is_sent_grows_with_the_group(spark):
    for n in (1000, 4000, 16000):
        assert n <= wide_group(spark, n, 10).count() <= 1.1 * n + 20
    assert wide_group(spark, 1000, 0).count() == 0


def test_the_rest_meets_all(spark, monkeypatch):
    monkeypatch.setattr(order_minhash, "FAMILY_BLOCK", 4)
    for n, rest in ((40, 11), (40, 1), (30, 30)):
        met, groups = set(), {}
        for r in wide_group(spark, n, rest).collect():
            groups.setdefault((r["lo"], r["hi"]), []).append((r["node"], r["block"]))
        for (lo, hi), rows in groups.items():
            met |= {tuple(sorted((a, b))) for (a, x), (b, y) in combinations(rows, 2) if lo == hi or x != y}
        # members of the largest class needn't meet; of those that no link joins one is that class
        assert met == {p for p in combinations(range(n), 2) if p[0] < rest}


def test_wide_groups_of_several_classes(spark, monkeypatch):
    for name, value in (("BLOCK", 3), ("FAMILY_BLOCK", 3), ("LEADERS", 1)):
        monkeypatch.setattr(order_minhash, name, value)
    # shared beginnings make one family of three classes that don't link
    head = [f"h{i}" for i in range(50)]
    texts = {100 * c + i: " ".join([*head, *(f"c{c}w{k}" for k in range(24)), f"own{c}x{i}"]) for c in range(3) for i in range(8)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(df).collect()}
    assert got == {d: d // 100 * 100 for d in texts}


def test_thresholds_that_candidates_cannot_serve(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0], 1)], "vec_id long, embedding array<double>, label int")
    for bad in (0.6, 1.1):
        for f in (order_minhash.near_duplicates, order_minhash.one_of_each):
            with pytest.raises(ValueError, match="similarity"):
                f(docs, bad)
        with pytest.raises(ValueError, match="cosine"):
            spherical_filters.linked_vectors(vectors, bad)


def test_large_keys_are_looked_up(spark, monkeypatch):
    rows = spark.range(500).select(F.when(F.col("id") < 400, 3).otherwise(F.col("id")).alias("k"), "id")
    table = common.save(spark, spark.range(450).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")), "table")
    want = {how: sorted(map(tuple, rows.join(table, "k", how).collect()), key=str) for how in ("inner", "left")}
    monkeypatch.setattr(common, "BROADCAST_ROWS", 10)
    for large in (1000, 3):
        monkeypatch.setattr(common, "LARGE_GROUPS", large)
        for how, expected in want.items():
            assert sorted(map(tuple, common.looked_up(rows, table, "k", how).collect()), key=str) == expected


def test_tokenizers_with_a_decoder_are_refused():
    with pytest.raises(ValueError, match="decoder"):
        bpe_automaton.Automaton(public_tokenizers.path("byte_bpe_50k.json"))


def test_parts_of_many_languages(spark):
    rng, rows = random.Random(4), []
    for x in range(60):
        letters = [chr(0x4E00 + 12 * x + k) for k in range(12)]
        rows += [(3 * x + k, " ".join("".join(rng.choices(letters, k=4)) for _ in range(25)), f"l{x:02}") for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one = language_id.train(df, calibration_rows=50)
    bound = 50_000
    many = language_id.train(df, calibration_rows=50, part_rows=bound)
    assert len(one.parts) == 1 and 2 <= len(many.parts) <= 12
    held = lambda m: sum(a.nbytes for t in (m.grams, m.backs) for pair in t.values() for a in pair)
    sizes = [held(many.part(i)) for i in range(len(many.parts))]
    # two tables of 4 bytes a cell in each order
    assert max(sizes) <= 8 * language_id.ORDER * language_id.ROW_LANGUAGES * bound < held(one.part(0)) * 2
    a, b = ({r["doc_id"]: (r["lang_pred"], round(r["score"], 6)) for r in language_id.identify(df, m).collect()} for m in (one, many))
    assert a == b and all(v[0] == f"l{k // 3:02}" for k, v in a.items())


PLAIN = ["river", "table", "green", "walks", "under", "stone", "lamp", "cloud"]


def insults(quotations):
    rng = random.Random(11)
    words = lambda n: " ".join(rng.choice(PLAIN) for _ in range(n))
    rows = [(words(8) + " blargon " + words(8), 1) for _ in range(300)] + [(words(17), 0) for _ in range(900)]
    rows += [(words(5) + ' he said " blargon " ' + words(6), 0) for _ in range(quotations)]
    return [(i, *r) for i, r in enumerate(rows)]


def scores(spark, model, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r["predicted"] for r in toxicity.score(df, model).collect()}


BEFORE, AFTER = "river stone lamp cloud green table", "walks under river stone lamp cloud green table"
DIRECT, SPELLED, QUOTED, REPORTED = (f"{BEFORE} {x} {AFTER}" for x in ("blargon", "blargen", '" blargon "', "she said blargon"))


def trained(spark, rows, **more):
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    return toxicity.train(docs, labels, **more)


def test_edits_and_windows_change_verdicts(spark):
    model = trained(spark, insults(60))
    assert set(model.words) == {"blargon"} and model.weights[toxicity.FEATURES.index("quoted")] < 0
    texts = [DIRECT, SPELLED, QUOTED, REPORTED]
    assert scores(spark, model, texts) == {0: 1, 1: 1, 2: 0, 3: 0}
    # edits off: the misspelled insult passes
    exact = toxicity.Model(**(vars(model) | {"plain": sorted(model.words)}))
    assert scores(spark, exact, texts) == {0: 1, 1: 0, 2: 0, 3: 0}
    # windows off: what is quoted or reported counts like an insult
    blind = toxicity.Model(**(vars(model) | {"reporting": frozenset()}))
    assert scores(spark, blind, [DIRECT, SPELLED, REPORTED]) == {0: 1, 1: 1, 2: 1}


def test_a_set_weight_of_quotations(spark):
    unset, given = (trained(spark, insults(0), quoted=w) for w in (0.0, -6.0))
    assert scores(spark, unset, [DIRECT, QUOTED])[0] == scores(spark, given, [DIRECT, QUOTED])[0] == 1
    assert scores(spark, given, [DIRECT, QUOTED])[1] == 0
