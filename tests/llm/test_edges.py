"""Clashing columns in every pipeline stage, vectors whose squares overflow, one very long text."""

import numpy as np
import pytest
from llm_cases import SCHEMA, clashing, none, rows_of, small  # noqa: F401
from oracle import DATA
from pyspark.sql import functions as F

import corpus_pipeline
from edgeloom.llm import collision_ann, packing

SF_DIR = f"{DATA}/sf0.001"
NAMES = ("t", "n", "w", "own", "s_words", "score", "predicted", "__found", "__key", "__chosen", "row_key", "line_no", "gone", "lines", "words", "n_lines", "a.b")


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_keep_clashing_columns(spark, small, none, name, stage):  # noqa: F811
    docs = small[1]
    plain = stage(spark, docs, SF_DIR)
    marked = stage(spark, docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in NAMES}), SF_DIR)
    again = marked.select(*[f"`{c}`" for c in plain.columns])
    assert sorted(rows_of(again), key=repr) == sorted(rows_of(plain), key=repr)
    if name != "packing":
        assert marked.columns == [*docs.columns, *NAMES]
        assert all(r[c] == (None if r.doc_id is None else f"{c}{r.doc_id}") for r in marked.collect() for c in NAMES)
    bare = stage(spark, none.select("doc_id", "text"), SF_DIR)
    assert bare.count() == 0 and (name == "packing" or bare.columns == ["doc_id", "text"])


def test_vectors_near_the_end_of_doubles(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.uniform(-1.7, 1.7, 6) * (1e308 if i % 3 else 1.0)]) for i in range(60)]
    got = collision_ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0, 4).collect()
    want = []
    with np.errstate(over="ignore"):
        for q, v in rows[::10]:
            far = sorted((float(np.sqrt(((np.array(x) - np.array(v)) ** 2).sum())), i) for i, x in rows if i != q)
            want += [(q, k + 1, i, d) for k, (d, i) in enumerate(far[:4])]
    assert sorted(map(tuple, got)) == sorted(want)


def test_a_long_text_is_cut_in_one_pass(spark):
    words = [f"w{k % 977}" for k in range(400_000)]
    docs = spark.createDataFrame([(1, " \n".join(words)), (2, "a b"), (3, None)], "doc_id long, text string")
    pieces = sorted(packing.pack(docs, 2048).where("doc_id = 1").collect(), key=lambda r: r.piece)
    assert [r.n_words for r in pieces[:-1]] == [2048] * (len(pieces) - 1)
    assert " ".join(r.text for r in pieces) == " ".join(words)
    without = packing.pack(docs, 2048, keep_text=False)
    assert sorted(map(tuple, packing.pack(docs, 2048).drop("text").collect()), key=repr) == sorted(map(tuple, without.collect()), key=repr)
