"""Cases that a rule of the library must get right whatever the sample tables hold."""

from datetime import datetime

from conftest import rows

from edgeloom.operators import dag, evidence as E, lifecycle as L, reach as R


def test_cascade_reaches_the_end_of_a_long_chain(spark):
    items = spark.createDataFrame([(i, i == 0) for i in range(107)], "id int, failed boolean")
    deps = spark.createDataFrame([(i, i - 1) for i in range(1, 107)], "id int, dep int")
    got = rows(dag.failure_cascade(items, deps, transitive=True))
    assert got == sorted([(i, i == 0, i > 0) for i in range(107)], key=repr)


def test_long_ring_is_a_cycle(spark):
    edges = spark.createDataFrame([(i, (i + 1) % 104) for i in range(104)], "src int, dst int")
    seeds = spark.createDataFrame([(7,)], "seed int")
    assert rows(R.cycles_through(edges, seeds)) == [(7, 104)]


def test_unkeyed_run_leaves_the_latest_key(spark):
    runs = spark.createDataFrame([(i, 1, "r", "plan", h) for i, h in enumerate(["h", "", "h", "g", "h"])], "seq bigint, issue bigint, repo string, phase string, input_hash string")
    assert [a for _, a in rows(L.idempotent_runs(runs), "seq", "action")] == ["record", "unkeyed", "no-op", "record", "record"]


def test_refused_status_does_not_stick(spark):
    asked = ["completed", "completed", "in_progress", "pending", "completed", "in_progress", "completed"]
    events = spark.createDataFrame([(i, k, s) for k in (1, 2) for i, s in enumerate(asked)], "seq bigint, id bigint, status string")
    blocked = spark.createDataFrame([(2,)], "id bigint")
    got = rows(L.status_log(events, blocked), "id", "seq", "from_status", "verdict")
    bad, ok = "invalid_transition", "ok"
    assert [(f, v) for k, _, f, v in got if k == 1] == [
        ("pending", bad), ("pending", bad), ("pending", ok), ("in_progress", bad), ("in_progress", ok), ("completed", bad), ("completed", ok)
    ]
    assert [v for k, _, _, v in got if k == 2] == [bad, bad, "blocked", ok, bad, "blocked", bad]


def test_local_attempts_have_keys_of_their_own(spark):
    data = [(i, 1, 1, "fail", "reason_code=X", "", "", datetime(2024, 1, 1, 0, i)) for i in range(4)]
    attempts = spark.createDataFrame(data, "seq bigint, issue bigint, pr bigint, outcome string, log string, run_id string, run_attempt string, run_at timestamp")
    assert [n for _, n in rows(L.gate_retries(L.parse_attempts(attempts), 2), "seq", "retry_count")] == [1, 1, 1, 1]


def test_posterior_of_negative_sequence(spark):
    data = [(s, "c", "supports", 0.6, "causal") for s in (-3, 2, 5000)]
    got = E.posterior(spark.createDataFrame(data, "seq bigint, conclusion_id string, relation string, confidence double, bond_type string").selectExpr("*", "'e' || seq AS evidence_id"), fold_rows=4).collect()
    assert [(r.conclusion_id, r.evidence_count) for r in got] == [("c", 3)]


def test_values_pass_down_long_hierarchies_and_stop_on_cycles(spark):
    data = [(i, i - 1 if i else None, "top" if i == 0 else None) for i in range(90)] + [(200, 201, None), (201, 200, None)]
    got = dict(rows(dag.inherit(spark.createDataFrame(data, "node int, parent int, layer string"), "layer")))
    assert all(got[i] == "top" for i in range(90)) and got[200] is None
