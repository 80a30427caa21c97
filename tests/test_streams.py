"""Streams over several micro-batches against the batch operators and against loops."""

import random
from datetime import datetime, timedelta, timezone

from conftest import rows
from pyspark.sql import functions as F

from edgeloom.functions.labels import STATES
from edgeloom.operators import exclusive as X
from edgeloom.operators import lifecycle as L
from edgeloom.streaming import operators as O
from edgeloom.streaming.keyed import run_to_table, split_late


START = datetime(2024, 1, 1, tzinfo=timezone.utc)
at = lambda minutes: START + timedelta(minutes=minutes)


def files(spark, folder, data, schema, parts=4):
    """The rows as a stream of several files, one per micro-batch."""
    size = len(data) // parts + 1
    for i in range(parts):
        spark.createDataFrame(data[i * size : (i + 1) * size], schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def mixed(rng, data, reach, tail):
    """Rows up to ``reach`` places from where they belong, and two rows without a key that let the watermark pass all."""
    order = sorted(range(len(data)), key=lambda i: i + rng.uniform(0, reach))
    return [data[i] for i in order] + tail


def test_retries_over_batches_out_of_order(spark, tmp_path):
    rng = random.Random(5)
    schema = "seq bigint, issue bigint, pr bigint, outcome string, log string, run_id string, run_attempt string, run_at timestamp"
    data = [(i, rng.randrange(3), 1, rng.choice(["pass", "fail", "fail", "fail"]), f"reason_code=X head_sha=h{rng.randrange(2)}", "", "", at(i // 2)) for i in range(200)]
    tail = [(None, None, 1, "pass", "", "", "", at(9000 + k)) for k in range(2)]
    got = run_to_table(O.gate_retries(files(spark, tmp_path / "in", mixed(rng, data, 60, tail), schema, 6), 2, delay="1 hour"), "t")
    want = L.gate_retries(L.parse_attempts(spark.createDataFrame(data, schema)), 2, hot_rows=10, chunk_rows=7)
    columns = ["seq", "retry_count", "escalated", "comment"]
    assert rows(got, *columns) == rows(want, *columns)


def test_states_and_leases_over_shuffled_batches(spark, tmp_path):
    rng = random.Random(8)
    schema = "seq bigint, ts timestamp, issue bigint, want_from string, state string"
    data = [(i, at(i), i % 3, rng.choice(["", "", None, *STATES[:3]]), rng.choice(STATES[:4])) for i in range(150)]
    tail = [(None, at(9000 + k), None, None, None) for k in range(2)]
    got = run_to_table(O.transitions(files(spark, tmp_path / "s", mixed(rng, data, 40, tail), schema, 5)), "t")
    assert rows(got) == rows(X.state_changes(spark.createDataFrame(data, schema)))
    schema = "seq bigint, ts timestamp, issue bigint, owner string, op string, at_s bigint, ttl_s bigint"
    data = [(i, at(i), i % 2, rng.choice("ab"), rng.choice(["acquire", "refresh", "release"]), i * 60, rng.choice([60, 300])) for i in range(150)]
    tail = [(None, at(9000 + k), None, None, None, None, None) for k in range(2)]
    got = run_to_table(O.leases(files(spark, tmp_path / "l", mixed(rng, data, 40, tail), schema, 5)), "t")
    assert rows(got) == rows(X.leases(spark.createDataFrame(data, schema)))


def test_rows_wait_for_the_watermark(spark, tmp_path):
    """Rows inside the delay are held back: nothing of the last hour comes out."""
    schema = "seq bigint, ts timestamp, issue bigint, repo string, phase string, input_hash string"
    data = [(i, at(m), 1, "r", "plan", h) for i, (m, h) in enumerate([(0, "A"), (30, "B"), (20, "A"), (90, "A"), (200, "B")])]
    got = run_to_table(O.idempotent_runs(files(spark, tmp_path / "in", data, schema, 5)), "t")
    assert [(r.seq, r.action) for r in got.orderBy("seq").collect()] == [(0, "record"), (1, "record"), (2, "no-op"), (3, "record")]


def test_lease_life_and_expiry_rows(spark, tmp_path):
    schema = "seq bigint, ts timestamp, issue bigint, owner string, op string, at_s bigint, ttl_s bigint"
    zero = int(START.timestamp())
    ops = [("a", "acquire", 0), ("b", "acquire", 50), ("a", "refresh", 90), ("b", "acquire", 120), ("b", "acquire", 190), ("a", "refresh", 191), ("a", "release", 192), ("b", "release", 193), ("a", "release", 194), ("c", "acquire", 300)]
    data = [(i, START + timedelta(seconds=s), 1, o, op, zero + s, 100) for i, (o, op, s) in enumerate(ops)]
    tail = [(None, at(900 + k), None, None, None, None, None) for k in range(2)]
    got = run_to_table(O.leases(files(spark, tmp_path / "a", data + tail, schema, 4)), "t")
    assert [r.outcome for r in got.orderBy("seq").collect()] == ["granted", "denied", "refreshed", "denied", "granted", "owner_mismatch", "owner_mismatch", "released", "released", "granted"]
    got = run_to_table(O.leases(files(spark, tmp_path / "b", data + tail, schema, 4), expire_rows=True), "t")
    lapsed = [(r.owner, r.expires_s - zero, r.outcome) for r in got.where("seq IS NULL").orderBy("expires_s").collect()]
    assert lapsed == [("a", 190, "expired"), ("c", 400, "expired")]


def test_silence_timers(spark, tmp_path):
    """Human comments at 0 and 5 minutes; warning at 15, end at 45; a bot comment changes nothing, /hold stops the timers."""
    data = [(1, at(5), "more"), (1, at(0), "hi"), (1, at(12), "<!-- BOT:PLAN_DRAFT issue=1 -->"), (2, at(13), "/finalize"), (3, at(20), "tick"), (3, at(25), "/hold"), (3, at(90), "tick"), (None, at(900), "x"), (None, at(901), "x")]
    stream = files(spark, tmp_path / "in", data, "issue bigint, ts timestamp, body string", 5)
    got = run_to_table(O.convergence(stream), "t").withColumn("m", F.round((F.col("at_ms") - int(START.timestamp() * 1000)) / 60000))
    assert rows(got, "issue", "m", "reason") == [(1, 15.0, "silence_warn"), (1, 45.0, "warning_timeout_finalize"), (2, 13.0, "command_finalize")]


def test_late_rows_go_to_a_table_of_their_own(spark, tmp_path):
    data = [(0, at(0)), (1, at(50)), (2, at(200)), (3, at(150)), (4, at(139)), (5, at(140)), (6, None), (7, at(201)), (8, at(10))]
    split_late(files(spark, tmp_path / "in", data, "id bigint, ts timestamp", 3), "ts", 3600, str(tmp_path / "out"))
    read = lambda side: sorted(r.id for r in spark.read.schema("id bigint").parquet(f"{tmp_path}/out/{side}").collect())
    assert read("late") == [4, 5, 8] and read("accepted") == [0, 1, 2, 3, 6, 7]


def test_routes_stream(spark, tmp_path):
    schema = "event_id bigint, workflow string, event_name string, payload string"
    data = [(1, "flow-plan.yml", "issues", '{"label": {"name": "bot:fix"}}'), (2, "plan", "push", "{}"), (3, "x", "issues", "{}"), (4, "review", "issues", "{bad")]
    got = run_to_table(O.routes(files(spark, tmp_path / "in", data, schema, 2)), "t")
    assert rows(got, "event_id", "decision") == [(1, "run"), (2, "skip"), (3, "fail"), (4, "fail")]


def test_keys_share_a_bucket(spark, tmp_path):
    """Keys of one bucket keep their own states, timers and rows, whatever the number of buckets."""
    rng = random.Random(3)
    zero = int(START.timestamp())
    schema = "seq bigint, ts timestamp, issue bigint, owner string, op string, at_s bigint, ttl_s bigint"
    data = [(i, at(i), i % 7, rng.choice("ab"), rng.choice(["acquire", "refresh", "release"]), zero + i * 60, rng.choice([60, 1200])) for i in range(140)]
    tail = [(None, at(9000 + k), None, None, None, None, None) for k in range(2)]
    stream = files(spark, tmp_path / "in", mixed(rng, data, 30, tail), schema, 4)
    one, many = (run_to_table(O.leases(stream, expire_rows=True, buckets=n), "t") for n in (1, 50))
    assert rows(one) == rows(many) and one.where("seq IS NOT NULL").count() == 140 and one.where("seq IS NULL").count() > 7


def test_upserts_from_loads_of_several_files(spark, monkeypatch):
    from edgeloom.plans import graph_queries
    from edgeloom.plans.inputs import Tables
    from edgeloom.plans.registry import ORACLE
    from oracle import DATA, compare, duck

    monkeypatch.setattr(graph_queries, "ROWS_PER_FILE", 2500)
    sf_dir = f"{DATA}/sf0.001"
    assert compare(graph_queries.merged_by_batches(Tables(spark, sf_dir)), duck(sf_dir), ORACLE["stream_upserts"]) is None
