"""Graph operators against brute force on random graphs."""

import random

import pytest
from conftest import rows

from edgeloom.operators import dag as D
from edgeloom.operators import reach as G


def graph(seed, n=24, m=34):
    rng = random.Random(seed)
    return sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(m)})


def distances(edges, start, limit):
    out, seen, front = {}, set(), {start}
    for d in range(1, limit + 1):
        front = {b for a, b in edges if a in front} - seen
        seen |= front
        out |= {v: d for v in front}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_reach_and_components(spark, seed):
    edges = graph(seed)
    df = spark.createDataFrame(edges, "src bigint, dst bigint")
    seeds = spark.createDataFrame([(0,), (5,), (7,)], "seed bigint")
    want = [(s, v, d) for s in (0, 5, 7) for v, d in distances(edges, s, 4).items()]
    assert rows(G.reach(df, seeds, 4), "seed", "node", "depth") == sorted(want, key=repr)
    far = {v: distances(edges, v, 99) for v in range(24)}
    cyclic = {v for v in far if v in far[v]}
    want = {v: max(w for w in cyclic if w in far[v] and v in far[w]) for v in cyclic}
    assert dict(rows(D.components(df), "node", "component")) == want
    for s, steps in {r.seed: None for r in G.cycle_paths(df, seeds).collect()}.items():
        path = [r.node for r in G.cycle_paths(df, seeds).filter(f"seed = {s}").orderBy("step").collect()]
        assert path[0] == s and all((a, b) in edges for a, b in zip(path, path[1:] + path[:1]))
        assert len(path) == far[s][s]


def test_depth_limits(spark):
    df = spark.createDataFrame([(1, 2)], "src bigint, dst bigint")
    seeds = spark.createDataFrame([(1,)], "seed bigint")
    assert G.reach(df, seeds, 0).count() == 0
    with pytest.raises(ValueError):
        G.reach(df, seeds, 101)


@pytest.mark.parametrize("seed", [3, 4])
def test_layers(spark, seed):
    rng = random.Random(seed)
    deps = sorted({(b, a) for _ in range(40) for a, b in [sorted(rng.sample(range(20), 2))]}) + [(30, 31), (31, 30), (32, 31)]
    nodes = list(range(20)) + [30, 31, 32]
    depth = {}
    for v in range(20):
        depth[v] = max((depth[d] + 1 for x, d in deps if x == v), default=0)
    want = [(v, depth.get(v)) for v in nodes]
    got = D.layers(spark.createDataFrame([(v,) for v in nodes], "node bigint"), spark.createDataFrame(deps, "node bigint, dep bigint"))
    assert rows(got, "node", "layer") == sorted(want, key=repr)


def test_inherit_deep_chain(spark):
    chain = [(i, i - 1 if i else None, "top" if i == 0 else ("mid" if i == 40 else None)) for i in range(100)]
    got = dict(rows(D.inherit(spark.createDataFrame(chain, "node bigint, parent bigint, layer string"), "layer")))
    assert got == {i: "top" if i < 40 else "mid" for i in range(100)}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_a_ring_and_many_small_ones(spark, seed):
    rng = random.Random(seed)
    names = rng.sample(range(10_000), 120)
    ring = [(names[i], names[(i + 1) % 60]) for i in range(60)]
    small = [(names[60 + 3 * k + i], names[60 + 3 * k + (i + 1) % 3]) for k in range(20) for i in range(3)]
    links = [(names[a], names[b]) for a, b in (sorted(rng.sample(range(120), 2)) for _ in range(80)) if a // 60 != b // 60 or (a >= 60 and (a - 60) // 3 != (b - 60) // 3)]
    chain = [(20_000 + i, 20_001 + i) for i in range(30)] + [(7, 7)]
    edges = ring + small + links + chain
    rng.shuffle(edges)
    want = {7: 7} | {n: max(names[:60]) for n in names[:60]}
    for k in range(20):
        own = names[60 + 3 * k : 63 + 3 * k]
        want |= {n: max(own) for n in own}
    got = D.components(spark.createDataFrame(edges, "src bigint, dst bigint").repartition(4))
    assert dict(rows(got, "node", "component")) == want
