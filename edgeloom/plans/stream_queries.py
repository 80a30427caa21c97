"""Structured Streaming runs over the events table; checks are those of the batch forms where both exist."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.operators import exclusive as X
from edgeloom.plans import event_queries as V
from edgeloom.plans import history_queries as H
from edgeloom.plans.inputs import INPUTS, needed
from edgeloom.plans.registry import query
from edgeloom.session import Scratch
from edgeloom.streaming import operators as O
from edgeloom.streaming.keyed import run_to_table, split_late

# How the streams below are cut: thirds of the month, of which every other row comes one file later.
FILE = "least(div(day(ts) - 1, 10), 2) + event_id % 2"
DELAY_DAYS = 12
ROWS_PER_FILE = 500_000
ROWS_PER_BUCKET = 16_000


def over(t, name: str, source: DataFrame) -> DataFrame:
    """A logical input over a stream of events."""
    source.createOrReplaceTempView("events")
    ctes = ", ".join(f"{n} AS ({INPUTS[n]})" for n in needed([name]) if n != name)
    return t.spark.sql((f"WITH {ctes} " if ctes else "") + INPUTS[name])


def stream(t, name: str) -> DataFrame:
    """A logical input over the events table as a stream of its files."""
    return over(t, name, t.spark.readStream.schema(t("events").schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir))


def files(t, file: str, last: int, closing: bool) -> DataFrame:
    """The events table as a stream of several micro-batches, out of order as ``file`` deals the rows.

    ``closing`` adds a row without a key far in the future, which lets the watermark pass all others.
    """
    folder = f"{Scratch(t.spark, 'shuffled').root}/events"
    events = t("events")
    parts = 2 + events.count() // (ROWS_PER_FILE * (last + 1))
    for k in range(last + 1):
        events.where(F.expr(f"{file} = {k}")).repartition(parts, "event_id").write.mode("append").parquet(folder)
    if closing:
        far = [(-1 - k, datetime(2100 + k, 1, 1), None, "view", 0.0, '{"k": 3}') for k in range(2)]
        for row in far:
            tick = t.spark.createDataFrame([row], "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string")
            tick.select(*[F.col(f.name).cast(f.dataType) for f in events.schema]).coalesce(1).write.mode("append").parquet(folder)
    return t.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", parts).parquet(folder)


def shuffled(t, name: str) -> DataFrame:
    return over(t, name, files(t, FILE, 3, closing=True))


def folded(t, operator, name: str, *args, **more) -> DataFrame:
    """The rows of a stream operator over shuffled micro-batches."""
    buckets = 64 + t("events").count() // ROWS_PER_BUCKET
    return run_to_table(operator(shuffled(t, name), *args, delay=f"{DELAY_DAYS} days", buckets=buckets, **more), name)


query("stream_event_routes", V.ROUTE_SQL, V.ROUTE)(lambda t: run_to_table(O.routes(stream(t, "wf_events")), "routes"))
query("stream_idempotent_runs", V.IDEM_SQL, V.IDEM)(lambda t: folded(t, O.idempotent_runs, "runs"))
query("stream_gate_retries", V.RETRY_SQL, V.RETRY)(lambda t: folded(t, O.gate_retries, "attempts", 2))
query(
    "stream_posteriors",
    "SELECT s.seq, f.conclusion_id, ROUND(p, 6) AS posterior, f.i AS evidence_count FROM fold f JOIN sq s ON s.conclusion_id = f.conclusion_id AND s.i = f.i",
    H.BAYES.replace("SELECT conclusion_id, ROW_NUMBER()", "SELECT seq, conclusion_id, ROW_NUMBER()"),
)(lambda t: folded(t, O.posteriors, "evidence").withColumn("posterior", F.round("posterior", 6)))
CAS = f"""
sr AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY issue ORDER BY seq) AS i FROM state_events),
sv AS (SELECT *, CASE WHEN NOT list_contains({V.STATES}, state) OR (want_from <> '' AND NOT list_contains({V.STATES}, want_from)) THEN 'invalid_state'
  WHEN want_from <> '' AND want_from <> state AND NOT list_contains({V.PAIRS}, want_from || '>' || state) THEN 'invalid_transition' END AS early FROM sr),
cas AS (SELECT DISTINCT issue, 0::BIGINT AS i, CAST(NULL AS VARCHAR) AS cur, CAST(NULL AS VARCHAR) AS verdict, 0::BIGINT AS seq FROM state_events
  UNION ALL SELECT c.issue, s.i, CASE WHEN early IS NULL AND (want_from = '' OR c.cur = want_from) THEN s.state ELSE c.cur END,
    CASE WHEN early IS NOT NULL THEN early WHEN want_from <> '' AND (c.cur IS NULL OR c.cur <> want_from) THEN 'conflict' WHEN c.cur = s.state THEN 'no-op' ELSE 'moved' END, s.seq
  FROM cas c JOIN sv s ON s.issue = c.issue AND s.i = c.i + 1)
"""
CAS_SQL = "SELECT seq, issue, verdict, cur AS current FROM cas WHERE i > 0"
query("state_changes", CAS_SQL, CAS)(lambda t: X.state_changes(t("state_events")))
query("stream_state_changes", CAS_SQL, CAS)(lambda t: folded(t, O.transitions, "state_events"))
LEASE = """
lo AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY issue ORDER BY seq) AS i FROM lease_ops),
le AS (SELECT DISTINCT issue, 0::BIGINT AS i, '' AS holder, 0::BIGINT AS expires, '' AS outcome, 0::BIGINT AS seq, '' AS owner, '' AS op FROM lease_ops
  UNION ALL SELECT issue, i, CASE outcome WHEN 'granted' THEN owner WHEN 'released' THEN '' ELSE holder END, CASE outcome WHEN 'granted' THEN at_s + ttl_s WHEN 'refreshed' THEN at_s + ttl_s WHEN 'released' THEN at_s ELSE expires END, outcome, seq, owner, op
  FROM (SELECT l.issue, l.i, e.holder, e.expires, l.seq, l.owner, l.op, l.at_s, l.ttl_s, CASE
      WHEN l.op = 'acquire' THEN CASE WHEN e.holder <> '' AND l.at_s < e.expires THEN 'denied' ELSE 'granted' END
      WHEN l.op = 'refresh' THEN CASE WHEN e.holder = '' THEN 'not_held' WHEN e.holder <> l.owner THEN 'owner_mismatch' WHEN l.at_s >= e.expires THEN 'expired' ELSE 'refreshed' END
      WHEN e.holder <> '' AND e.holder <> l.owner THEN 'owner_mismatch' ELSE 'released' END AS outcome FROM le e JOIN lo l ON l.issue = e.issue AND l.i = e.i + 1))
"""
LEASE_SQL = "SELECT seq, issue, owner, op, outcome, holder, expires AS expires_s FROM le WHERE i > 0"
query("lease_outcomes", LEASE_SQL, LEASE)(lambda t: X.leases(t("lease_ops")))
query("stream_leases", LEASE_SQL, LEASE)(lambda t: folded(t, O.leases, "lease_ops"))

# Leases that end by themselves: rows of op 'expire' come from timers, not from input.
LAPSE = """
lo AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY issue ORDER BY seq) AS i FROM lease_times),
le AS (SELECT DISTINCT issue, 0::BIGINT AS i, '' AS holder, 0::BIGINT AS expires, '' AS outcome, 0::BIGINT AS seq, '' AS owner, '' AS op, 0::BIGINT AS shown FROM lease_times
  UNION ALL SELECT issue, i, CASE outcome WHEN 'granted' THEN owner WHEN 'released' THEN '' ELSE holder END,
    CASE outcome WHEN 'granted' THEN at_s + ttl_s WHEN 'refreshed' THEN at_s + ttl_s WHEN 'released' THEN 0 ELSE expires END, outcome, seq, owner, op,
    CASE outcome WHEN 'granted' THEN at_s + ttl_s WHEN 'refreshed' THEN at_s + ttl_s WHEN 'released' THEN at_s ELSE expires END
  FROM (SELECT *, CASE
      WHEN op = 'acquire' THEN CASE WHEN holder <> '' THEN 'denied' ELSE 'granted' END
      WHEN op = 'refresh' THEN CASE WHEN holder = '' THEN 'not_held' WHEN holder <> owner THEN 'owner_mismatch' ELSE 'refreshed' END
      WHEN holder <> '' AND holder <> owner THEN 'owner_mismatch' ELSE 'released' END AS outcome
    FROM (SELECT l.issue, l.i, l.seq, l.owner, l.op, l.at_s, l.ttl_s, CASE WHEN e.expires <= l.at_s THEN '' ELSE e.holder END AS holder, CASE WHEN e.holder = '' OR e.expires <= l.at_s THEN 0 ELSE e.expires END AS expires
          FROM le e JOIN lo l ON l.issue = e.issue AND l.i = e.i + 1)))
"""
query(
    "stream_lease_expiry",
    """SELECT seq, issue, owner, op, outcome, holder, shown AS expires_s FROM le WHERE i > 0
      UNION ALL SELECT NULL, le.issue, holder, 'expire', 'expired', '', expires FROM le LEFT JOIN lo ON lo.issue = le.issue AND lo.i = le.i + 1
      WHERE holder <> '' AND (lo.at_s IS NULL OR expires <= lo.at_s)""",
    LAPSE,
)(lambda t: folded(t, O.leases, "lease_times", expire_rows=True))

# Discussion timers: hours of silence here, as the issues of the given events are quieter than people.
WARN_S, END_S = 6 * 3600, 12 * 3600
TALK = f"""
tm AS (SELECT issue, epoch_us(ts) // 1000 AS ms, CASE WHEN regexp_matches(body, '(?m)^/finalize$') THEN '/finalize' WHEN body = '/hold' THEN '/hold' ELSE '' END AS command FROM talk WHERE NOT contains(body, '<!-- BOT:')),
tr AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY issue ORDER BY ms, command) AS i FROM tm),
tk AS (SELECT DISTINCT issue, 0::BIGINT AS i, 'open' AS phase, CAST(NULL AS BIGINT) AS due, '' AS told, 0::BIGINT AS ms FROM tm
  UNION ALL SELECT issue, i, CASE WHEN command = '/finalize' THEN 'closed' WHEN command = '/hold' THEN 'held' WHEN phase IN ('closed', 'held') THEN phase ELSE 'warn' END,
    CASE WHEN command <> '' OR phase IN ('closed', 'held') THEN NULL ELSE ms + {WARN_S} * 1000 END, command, ms
  FROM (SELECT r.issue, r.i, r.ms, r.command, CASE WHEN k.due + (CASE k.phase WHEN 'warn' THEN {END_S} * 1000 ELSE 0 END) <= r.ms THEN 'closed' ELSE k.phase END AS phase
        FROM tk k JOIN tr r ON r.issue = k.issue AND r.i = k.i + 1)),
tn AS (SELECT tk.issue, tk.due, tr.ms AS until FROM tk LEFT JOIN tr ON tr.issue = tk.issue AND tr.i = tk.i + 1 WHERE tk.due IS NOT NULL)
"""
query(
    "stream_convergence",
    f"""SELECT issue, ms AS at_ms, 'finalize' AS result, 'command_finalize' AS reason FROM tk WHERE told = '/finalize'
      UNION ALL SELECT issue, due, 'warn', 'silence_warn' FROM tn WHERE until IS NULL OR due <= until
      UNION ALL SELECT issue, due + {END_S} * 1000, 'finalize', 'warning_timeout_finalize' FROM tn WHERE until IS NULL OR due + {END_S} * 1000 <= until""",
    TALK,
)(lambda t: folded(t, O.convergence, "talk", warn_s=WARN_S, finalize_s=END_S))

# Every eleventh event comes after all others; those behind the watermark by then are late.
LATE_FILE = f"if(event_id % 11 = 0, 4, {FILE})"


def late_split(t) -> DataFrame:
    folder = f"{Scratch(t.spark, 'late').root}/out"
    split_late(files(t, LATE_FILE, 4, closing=False), "ts", DELAY_DAYS * 86400, folder)
    both = [t.spark.read.schema(t("events").schema).parquet(f"{folder}/{side}").select("event_id", "user_id", F.lit(side == "late").alias("late")) for side in ("accepted", "late")]
    return both[0].unionByName(both[1])


query(
    "late_events",
    f"SELECT event_id, user_id, event_id % 11 = 0 AND ts <= (SELECT MAX(ts) FROM events WHERE event_id % 11 <> 0) - INTERVAL {DELAY_DAYS} DAY AS late FROM events",
)(late_split)
