"""Chunked scans and folds against straight loops, with every key split."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from edgeloom.operators import evidence as E
from edgeloom.operators.scans import chunked, ordered_scan, streaks


def events(seed, n=400):
    rng = random.Random(seed)
    return [(i * 3 + rng.randrange(3), rng.choice("aaaab"), rng.choice([None, "x", "x", "y"]), rng.randrange(4)) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("hot_rows", [0, 150, 10**6])
def test_scans_equal_loops(spark, seed, hot_rows):
    data = events(seed)
    df = spark.createDataFrame(data, "seq bigint, k string, v string, w int")
    want_scan, want_streak = [], []
    for key in "ab":
        prev = last = None
        total = streak = runs = count = 0
        for seq, _, v, w in sorted(r for r in data if r[1] == key):
            total += w
            want_scan.append((seq, prev, total, last))
            if v is None:
                streak = runs = count = 0
            else:
                streak = streak + 1 if prev == v else 1
                runs, count = runs + (prev != v), count + 1
            want_streak.append((seq, streak, runs, count))
            prev, last = v, v if v is not None else last
    split = {"hot_rows": hot_rows, "chunk_rows": 16}
    got = ordered_scan(df, ["k"], "seq", prev={"p": "v"}, running={"t": F.col("w")}, last_before={"l": F.col("v")}, **split)
    assert rows(got, "seq", "p", "t", "l") == sorted(want_scan, key=repr)
    assert rows(streaks(df, ["k"], "seq", "v", **split), "seq", "streak", "runs", "rows") == sorted(want_streak, key=repr)


@pytest.mark.parametrize("fold_rows", [3, 64, 4096])
def test_posterior_equals_loop(spark, fold_rows):
    rng = random.Random(fold_rows)
    data = [(i, i, rng.choice([1, 1, 1, 2]), rng.choice(["supports", "conflicts"]), rng.choice([0.0, 0.3, 1.0, 0.99]), rng.choice(["deduction", "verification", "exploration"])) for i in range(500)]
    df = spark.createDataFrame(data, "seq bigint, evidence_id bigint, conclusion_id bigint, relation string, confidence double, bond_type string")
    want = {}
    for _, _, c, rel, conf, bond in data:
        p = min(max(want.get(c, 0.5), 0.01), 0.99)
        eff = conf * E.BOND_WEIGHTS[bond]
        like = min(max(0.5 + (eff if rel == "supports" else -eff) / 2, 0.01), 0.99)
        want[c] = p * like / (p * like + (1 - p) * (1 - like))
    got = {r.conclusion_id: r.posterior for r in E.posterior(df, fold_rows=fold_rows).collect()}
    assert got == pytest.approx(want, abs=1e-8)


def test_reduce_cases(spark):
    cases = [
        ("c2", "supports", 0.8), ("c2", "supports", 0.6), ("c2", "conflicts", 0.2), ("c1", "supports", 0.9), ("c1", "supports", 0.8), ("c3", "supports", 0.1), ("c4", "supports", 1.5),
    ]
    df = spark.createDataFrame([(str(i), *c, "deduction") for i, c in enumerate(cases)], "evidence_id string, conclusion_id string, relation string, confidence double, bond_type string")
    assert [(r.conclusion_id, r.verdict) for r in E.ordered(E.reduce(df)).collect()] == [("c2", "contested"), ("c3", "investigate"), ("c1", "act")]
    assert [r.conclusion_id for r in E.rejected(df).collect()] == ["c4"]
    one = df.filter("conclusion_id = 'c3'").withColumn("confidence", F.lit(0.3))
    assert [(r.confidence, r.verdict) for r in E.reduce(one, act=0.6).collect()] == [(0.65, "act")]


def test_chunks_are_alike_where_a_key_crowds(spark):
    """Half the rows of a key stand in a hundredth of its range: no chunk is over twice the mean."""
    rng = random.Random(3)
    crowd = rng.sample(range(1_000_000), 8000)
    spread = rng.sample(range(1_000_000, 100_000_000), 8000)
    df = spark.createDataFrame([(i, "a") for i in crowd + spread] + [(i, "b") for i in range(50)], "seq bigint, k string").repartition(6)
    got = chunked(df, ["k"], "seq", hot_rows=1000, chunk_rows=500)
    sizes = [r["count"] for r in got.filter("k = 'a'").groupBy("_chunk").count().collect()]
    assert sum(sizes) == 16000 and len(sizes) >= 28 and max(sizes) <= 2 * 16000 / len(sizes)
    assert got.filter("k = 'b'").agg(F.max("_chunk"), F.count("*")).first() == (0, 50)
