"""Innermost functions by dyadic intervals against a loop over lines."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from edgeloom.operators import findings as D
from edgeloom.plans import text_queries as Q
from edgeloom.plans.inputs import Tables


def nested(rng, n):
    out = [("a", f"f{i}", s, s + rng.choice([0, 1, 2, 5, 17, 64, 200])) for i, s in enumerate(rng.choices(range(1, 300), k=n))]
    return out + [("b", "only", 4, 4), ("b", "empty", 9, 8), ("c", "whole", 1, 4096), ("c", "part", 1000, 1007)]


@pytest.mark.parametrize("seed", range(3))
def test_innermost(spark, seed):
    functions = nested(random.Random(seed), 40)
    want = {}
    for file, func, s, e in functions:
        for line in range(s, e + 1):
            best = (e - s, -s, func)
            want[file, line] = min(want.get((file, line), best), best)
    df = spark.createDataFrame(functions, "file string, func string, start_line bigint, end_line bigint").repartition(3)
    got = {(r.file, r.line): (r.func, r.start_line) for r in D.innermost(df).collect()}
    assert got == {k: (v[2], -v[1]) for k, v in want.items()}
    points = spark.createDataFrame([(f, x) for f in "abcd" for x in (1, 4, 5, 250, 1003, 4096, 4097)], "file string, line bigint")
    assert rows(D.owners(points, df), "file", "line", "func") == sorted(((f, x, want[f, x][2]) for f in "abcd" for x in (1, 4, 5, 250, 1003, 4096, 4097) if (f, x) in want), key=repr)


def test_a_long_function_is_few_intervals(spark):
    df = spark.createDataFrame([("a", "f", 3, 10_000_000)], "file string, func string, start_line bigint, end_line bigint")
    assert D._dyadic(df).count() <= 48
    points = spark.createDataFrame([("a", 2), ("a", 3), ("a", 10_000_000), ("a", 10_000_001)], "file string, line bigint")
    assert rows(D.owners(points, df), "line") == [(10_000_000,), (3,)]
    notes = spark.createDataFrame([("a", 5)], "file string, line bigint")
    assert D.comment_density(notes, df, F.lit(True), threshold=0.0).count() == 1


def test_functions_of_documents_are_counted_once(spark, tmp_path):
    """line counts of odd texts equal the lines themselves, and what uses the functions reads no text again."""
    texts = ["", "\n", "a", "a\n", "a\n\n", "a\r\nb\r\n", "\n\n\n", "x\ny\nz\n", None, "1\n2\n3\n4\n5\n6\n7\n8"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    t = Tables(spark, str(tmp_path))
    found = Q.doc_functions(t)
    want = {str(i): len(x.removesuffix("\n").split("\n")) for i, x in enumerate(texts) if x is not None}
    assert {r.file: r.end_line for r in found.filter("func = 'outer' AND end_line IS NOT NULL").collect()} == want
    assert rows(found.filter("func = 'inner'")) == sorted([(k, "inner", 2, min(n, 6)) for k, n in want.items() if n >= 3], key=repr)
    assert not any("documents.parquet" in f for f in D.innermost(found).inputFiles())


def test_functions_are_never_broadcast(spark, tmp_path):
    """written functions look small to Spark, but they grow with the documents and would go through the driver."""
    texts = ["a,\nb\nc,\nd,\ne\nf,\ng,\nh\n", "a,\nb,\nc\n", "a\nb\nc\n", "a,\n", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    t = Tables(spark, str(tmp_path))
    functions = Q.doc_functions(t)
    density = D.comment_density(Q.doc_lines(t), functions, F.contains("text", F.lit(",")))
    assert rows(density) == [("0", "inner", 2, 1.5, 1.0), ("0", "outer", 1, 2.0, 1.0)]
    inner = D.innermost(functions).select("file", "line", "func")
    assert rows(inner)[:8] == [("0", i, "inner" if 2 <= i <= 6 else "outer") for i in range(1, 9)]
    for df in (density, inner):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_findings_are_found_once_before_they_are_ordered(spark, tmp_path):
    """the order reads written findings, not the lines again for its samples."""
    data = [("b", 2, "r", "info"), ("a", 9, "r", "critical"), ("a", 3, "s", "warning"), ("a", 3, "r", "warning"), ("b", 1, "r", "error")]
    spark.createDataFrame(data, "file string, line long, rule string, severity string").write.parquet(f"{tmp_path}/lines")
    found = spark.read.parquet(f"{tmp_path}/lines")
    placed = D.ranked(found).orderBy("place").collect()
    assert [(r.file, r.line, r.rule) for r in placed] == [("a", 9, "r"), ("a", 3, "r"), ("a", 3, "s"), ("b", 1, "r"), ("b", 2, "r")]
    assert [(r.file, r.line) for r in D.ordered(found).collect()] == [("a", 9), ("a", 3), ("a", 3), ("b", 1), ("b", 2)]
    assert not any(str(tmp_path) in f for f in D.ordered(found).inputFiles())
