"""Neighbour search, quality and toxicity: recall, held-out accuracy and defined edges."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeloom.llm import collision_ann, rules_quality, toxicity
from edgeloom.llm.queries import ORACLE, QUERIES
from llm_cases import clashing, none, rows_of, small  # noqa: F401

DATA = "/root/testdata"


def nearest_by_hand(rows, k):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], np.float64)
    out = {}
    for q in np.flatnonzero(ids % 100 == 0):
        far = np.sqrt(((x - x[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, far)) if ids[i] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[i]), float(far[i])) for i in order]
    return out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_neighbour_recall(spark, sf):
    table = spark.read.parquet(f"{DATA}/{sf}/embeddings.parquet")
    want = nearest_by_hand([(r.vec_id, r.embedding) for r in table.collect()], 10)
    got = QUERIES["op4_collision_ann"](spark, f"{DATA}/{sf}").collect()
    found = {(r.query_id, r.vec_id): r.score for r in got}
    hits = [(q, v) in found for q, own in want.items() for v, _ in own]
    assert np.mean(hits) >= 0.9 and len(got) == sum(len(x) for x in want.values())
    assert all(found[q, v] == pytest.approx(s, abs=1e-12) for q, own in want.items() for v, s in own if (q, v) in found)
    assert all(0 < r.rank <= 10 for r in got)


def test_neighbour_edges(spark):
    rng = random.Random(1)
    vector = lambda: [rng.gauss(0, 1) for _ in range(8)]
    same = vector()
    rows = [(i, same if i % 3 == 0 else vector()) for i in range(1, 60)] + [(100, same), (200, vector()), (100, same)]
    rows += [(300, None), (400, [0.0] * 8), (500, [float("nan")] * 8), (600, [None] * 8), (None, vector()), (700, []), (800, [1.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("block", F.lit("x")).withColumn("score", F.lit(1))
    got = collision_ann.nearest(table, F.col("vec_id") % 100 == 0, 10).orderBy("query_id", "rank").collect()
    assert {r.query_id for r in got} == {100, 200}
    assert [(r.vec_id, r.score) for r in got if r.query_id == 100] == [(3 * i, 0.0) for i in range(1, 11)]
    assert collision_ann.nearest(table.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    few = collision_ann.nearest(table.where("vec_id in (100, 1, 2)"), F.col("vec_id") % 100 == 0).collect()
    assert sorted(r.vec_id for r in few) == [1, 2]


def held_out_figures(spark, name, label):
    sf = f"{DATA}/sf0.1"
    got = QUERIES[name](spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert got.where("score is null or score < 0 or score > 1 or predicted not in (0, 1)").count() == 0
    rows = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    import zlib

    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    return np.array([r.predicted for r in rows]), np.array([r[label] for r in rows])


def test_quality_held_out(spark):
    said, truth = held_out_figures(spark, "op6_rule_quality", "quality")
    assert (said == truth).mean() >= 0.97


def test_toxicity_held_out(spark):
    said, truth = held_out_figures(spark, "op9_toxicity", "toxic")
    assert said[truth == 1].mean() >= 0.85 and said[truth == 0].mean() <= 0.02


def test_rules_compile_to_what_they_predict(spark, small, none, clashing):
    docs = small[1]
    found, names = rules_quality.with_statistics(docs)
    x = np.nan_to_num(np.array(rows_of(found.select(*names)), float))
    rng = np.random.default_rng(0)
    y = (x[:, names.index("s_words")] > 30).astype(float)
    model = rules_quality.fit(x, y, names)
    assert model.rules and ((model.predict(x) >= 0.5) == (y == 1)).mean() > 0.95
    scored = found.withColumn("score", model.score()).select(*names, "score").collect()
    assert np.allclose([r.score for r in scored], model.predict(np.array([[float(v) for v in r[:-1]] for r in scored])))
    assert rules_quality.score_documents(none, model).count() == 0
    out = rules_quality.score_documents(clashing, model)
    assert out.count() == len(small[0]) and out.where("score is null").count() == 0
    one = rules_quality.fit(x, np.ones(len(x)), names)
    assert not one.rules and 0 <= float(one.predict(x)[0]) <= 1
    assert rules_quality.train(none, none.select("doc_id").withColumn("quality", F.lit(1))).rules == ()
    assert rng is not None


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(3)
    words, stems = ["abcab", "abcba", "ccbaab", "ab", "bbbbb"], ["caca"]
    machine = toxicity.automaton(words, stems)
    probes = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 9))) for _ in range(4000)]
    text = " ".join(probes)
    codes = toxicity._codes(text)
    start, length = toxicity.word_places(codes)
    kinds = machine.run(codes, start, length)
    for probe, kind in zip(probes, kinds):
        exact = probe in words or any(probe.startswith(s) and probe != s for s in stems)
        near = any(distance(probe, w) <= 1 for w in words if len(w) >= 5)
        assert kind == (1 if exact else 2 if near else 0), probe


def test_quotation_counts_less(spark, none, clashing, small):
    words = ("abusive", "horrid")
    model = toxicity.ToxicModel(words, (), frozenset(), (-3.0, 3.0, 2.0, 0.1, 0.5, 0.5, 0.5))
    rows = [(1, "you abusive horrid thing"), (2, 'he said "abusive" and wrote "horrid"'), (3, "you abusve horrrid thing"), (4, "nothing"), (5, None), (6, ""), (None, "abusive")]
    got = {r.doc_id: r for r in toxicity.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got[1].score > got[2].score and got[3].score > got[4].score and got[5].score == got[6].score == got[4].score
    assert [h.word for h in got[1].hits] == ["abusive", "horrid"] and all(h.quoted for h in got[2].hits) and len(got) == 7
    assert toxicity.score_documents(none, model).count() == 0 and toxicity.score_documents(clashing, model).count() == len(small[0])
    empty = toxicity.train(none, none.select("doc_id").withColumn("toxic", F.lit(1)), given=("nasty",))
    assert empty.words == ("nasty",)


def test_quotations_longer_than_400_characters(spark):
    model = toxicity.ToxicModel(("abusive", "horrid"), (), frozenset(), (-3.0, 3.0, 2.0, 0.1, 0.5, 0.5, 0.5))
    text = 'horrid "\nthey shouted "' + "filler " * 100 + 'abusive" and horrid'
    (got,) = toxicity.score_documents(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).collect()
    assert [(h.word, h.quoted) for h in got.hits] == [("horrid", False), ("abusive", True), ("horrid", False)]


def test_lexicon_keeps_every_term(spark):
    terms = [f"{a}{b}{c}z{a}{c}" for a in "bcdfgh" for b in "aeiou" for c in "klmnp"]
    rows = [(i, " ".join(terms) if i % 2 else "plain filler text") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic")))
    assert set(model.words) == set(terms) and len(terms) == 150


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in QUERIES} == {*(f"op{i}" for i in range(1, 11)), "pipeline"} and set(ORACLE) <= set(QUERIES)
