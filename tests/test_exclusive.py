"""Compare-and-set and leases as tables: against loops, on one key with all rows, and with nulls."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from edgeloom.functions.labels import STATES, TRANSITIONS
from edgeloom.operators import exclusive as E
from edgeloom.operators.ordering import positions


def change(current, want, to):
    pairs = {(a, b) for a, bs in TRANSITIONS.items() for b in bs}
    want, to = want or "", to or ""
    if to not in STATES or (want and want not in STATES):
        return "invalid_state", current
    if want and want != to and (want, to) not in pairs:
        return "invalid_transition", current
    if want and current != want:
        return "conflict", current
    return ("no-op", current) if current == to else ("moved", to)


@pytest.mark.parametrize("block,keys", [(2, 1), (4, 3), (64, 2)])
def test_state_changes(spark, block, keys):
    rng = random.Random(block)
    some = ["", None, "nonsense", *STATES]
    data = [(seq * 3, rng.choice([*range(keys), None]) if keys > 1 else 7, rng.choice(some if rng.random() < 0.6 else [""]), rng.choice(some)) for seq in range(300)]
    want, now = [], {}
    for seq, issue, a, b in data:
        verdict, now[issue] = change(now.get(issue), a, b)
        want.append((seq, issue, verdict, now[issue]))
    rng.shuffle(data)
    table = spark.createDataFrame(data, "seq bigint, issue bigint, want_from string, state string").repartition(5)
    got = E.state_changes(table, block_rows=block)
    assert rows(got, "seq", "issue", "verdict", "current") == sorted(want, key=repr)
    assert E.state_changes(table.limit(0)).count() == 0


def lease_loop(data):
    out, now = [], {}
    for seq, issue, owner, op, at, ttl in sorted(data, key=lambda r: (r[4], r[0])):
        holder, until = now.get(issue, ("", 0))
        if op == "acquire":
            outcome = "denied" if holder and at < until else "granted"
        elif op == "refresh":
            outcome = "not_held" if not holder else "owner_mismatch" if holder != owner else "expired" if at >= until else "refreshed"
        else:
            outcome = "owner_mismatch" if holder and holder != owner else "released"
        if outcome in ("granted", "refreshed"):
            holder, until = owner, at + ttl
        elif outcome == "released":
            holder, until = "", at
        now[issue] = (holder, until)
        out.append((seq, issue, owner, op, outcome, holder, until))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_leases(spark, seed):
    """Short, long and zero leases; many rows at one moment; one issue with most rows, in many chunks."""
    rng = random.Random(seed)
    data = [
        (seq, 1 if rng.random() < 0.7 else rng.randrange(4), rng.choice("abc"), rng.choice(["acquire", "acquire", "refresh", "release"] if seed else ["refresh", "acquire"]), seq // rng.choice([1, 4]), rng.choice([0, 1, 3, 10, 40]))
        for seq in range(400)
    ]
    got = E.leases(spark.createDataFrame(data, "seq bigint, issue bigint, owner string, op string, at_s bigint, ttl_s bigint").repartition(4), hot_rows=50 if seed else 10**6, chunk_rows=20)
    assert rows(got) == lease_loop(data)


def test_leases_of_nothing(spark):
    empty = spark.createDataFrame([], "seq bigint, issue bigint, owner string, op string, at_s bigint, ttl_s bigint")
    assert E.leases(empty).count() == 0


def test_positions(spark):
    rng = random.Random(1)
    data = [(rng.choice(["a", "a", "a", "b", None]), i, rng.random()) for i in range(500)]
    table = spark.createDataFrame(data, "k string, i bigint, v double").repartition(3)
    want = {}
    for k, i, v in sorted(data, key=lambda r: -r[2]):
        want.setdefault(k, []).append(i)
    want = {(k, i): n for k, ids in want.items() for n, i in enumerate(ids, 1)}
    got = positions(table, ["k"], [F.desc("v")])
    assert {(r.k, r.i): r.pos for r in got.collect()} == want
    whole = positions(table, [], ["v"], "n")
    assert [r.i for r in whole.orderBy("n").collect()] == [i for _, i, _ in sorted(data, key=lambda r: r[2])]
    assert "SinglePartition" not in whole._jdf.queryExecution().toString()
    assert positions(table.limit(0), [], ["v"]).count() == 0


@pytest.mark.parametrize("hot_rows", [10**6, 30])
def test_leases_of_null_issues_and_of_few_rows(spark, hot_rows):
    """Issues below the bound are followed in one pass, without a round of pointers; a null issue keeps its rows."""
    rng = random.Random(5)
    data = [(seq, rng.choice([None, 1, 1, 1, *range(2, 40)]), rng.choice("ab"), rng.choice(["acquire", "refresh", "release"]), rng.choice([seq // 2, None]), rng.choice([1, 9, None])) for seq in range(600)]
    table = spark.createDataFrame(data, "seq bigint, issue bigint, owner string, op string, at_s bigint, ttl_s bigint").repartition(4)
    got = E.leases(table, hot_rows=hot_rows, chunk_rows=20)
    assert rows(got) == lease_loop([(s, i, o, p, at or 0, ttl or 0) for s, i, o, p, at, ttl in data])
    assert ("Join" in got._jdf.queryExecution().sparkPlan().toString()) == (hot_rows < 600)
