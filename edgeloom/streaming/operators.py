"""Stream forms of the stateful operators.

All but the routing take events with an event time ``ts``, in any order within ``delay``, and give the rows of the batch
forms over events in the order of (ts, seq).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.functions.labels import STATES, TRANSITIONS
from edgeloom.operators import lifecycle as L
from edgeloom.operators.evidence import PRIOR, weight
from edgeloom.streaming.keyed import BUCKETS, DELAY, fold


def routes(events: DataFrame) -> DataFrame:
    """Routing holds no state: the table function works on a stream as it is."""
    return L.route(events)


def idempotent_runs(runs: DataFrame, delay: str = DELAY, buckets: int = BUCKETS) -> DataFrame:
    """(seq, issue, phase, key, action); the latest key per issue and phase is kept, older keys are not."""

    def step(state, row):
        if row.key is None:
            return state, (row.seq, row.issue, row.phase, None, "unkeyed")
        action = "no-op" if row.key == state[0] else "record"
        return (row.key,), (row.seq, row.issue, row.phase, row.key, action)

    enabled = (F.col("issue") > 0) & (F.trim("phase") != "") & (F.trim("input_hash") != "")
    key = F.when(enabled, L.idempotency_key(F.col("repo"), F.col("issue"), F.col("phase"), F.col("input_hash")))
    keyed = runs.select("seq", "ts", "issue", F.trim("phase").alias("phase"), key.alias("key"))
    return fold(keyed, ["issue", "phase"], step, (None,), "seq bigint, issue bigint, phase string, key string, action string", delay=delay, buckets=buckets)


def transitions(requests: DataFrame, delay: str = DELAY, buckets: int = BUCKETS) -> DataFrame:
    """(seq, issue, verdict, current): compare-and-set state changes of requests(seq, ts, issue, want_from, state)."""
    pairs = {(a, b) for a, bs in TRANSITIONS.items() for b in bs}
    known = set(STATES)

    def step(state, row):
        current, want, to = state[0], row.want_from, row.state
        if to not in known or (want and want not in known):
            verdict = "invalid_state"
        elif want and want != to and (want, to) not in pairs:
            verdict = "invalid_transition"
        elif want and current != want:
            verdict = "conflict"
        elif current == to:
            verdict = "no-op"
        else:
            verdict, current = "moved", to
        return (current,), (row.seq, row.issue, verdict, current)

    columns = requests.select("seq", "ts", "issue", "want_from", "state")
    return fold(columns, ["issue"], step, (None,), "seq bigint, issue bigint, verdict string, current string", delay=delay, buckets=buckets)


def leases(ops: DataFrame, delay: str = DELAY, expire_rows: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """(seq, issue, owner, op, outcome, holder, expires_s) of ops(seq, ts, issue, owner, op, at_s, ttl_s).

    acquire: granted when free or expired, else denied; refresh: only by the owner
    before expiry; release: by the owner, or when nobody holds the lease.

    With ``expire_rows``, ``at_s`` must be the event time in seconds: a lease that reaches its expiry ends with a row
    (null, issue, owner, expire, expired, '', expires_s) when the watermark gets there, and its key is cleared; so what
    comes later finds the lease free.
    """

    def step(state, row):
        holder, expires = state
        at, ttl = row.at_s or 0, row.ttl_s or 0
        if row.op == "acquire":
            if holder and at < expires:
                outcome = "denied"
            else:
                outcome, holder, expires = "granted", row.owner, at + ttl
        elif row.op == "refresh":
            if not holder:
                outcome = "not_held"
            elif holder != row.owner:
                outcome = "owner_mismatch"
            elif at >= expires:
                outcome = "expired"
            else:
                outcome, expires = "refreshed", at + ttl
        elif holder and holder != row.owner:
            outcome = "owner_mismatch"
        else:
            outcome, holder, expires = "released", "", at
        told = (row.seq, row.issue, row.owner, row.op, outcome, holder, expires)
        return (None if expire_rows and not holder else (holder, expires)), told

    def lapse(state, at, key):
        return None, (None, key[0], state[0], "expire", "expired", "", state[1])

    timed = {"due": lambda state: state[1] * 1000 if state[0] else None, "expire": lapse} if expire_rows else {}
    return fold(
        ops.select("seq", "ts", "issue", "owner", "op", "at_s", "ttl_s"), ["issue"], step, ("", 0),
        "seq bigint, issue bigint, owner string, op string, outcome string, holder string, expires_s bigint", delay=delay, buckets=buckets, **timed,
    )


def gate_retries(attempts: DataFrame, max_retries: int = L.GATE_RETRIES, delay: str = DELAY, buckets: int = BUCKETS) -> DataFrame:
    """Stream form of the gate retry counter over raw attempt logs; ``run_at`` is the event time."""

    def step(state, row):
        count, key, told = state
        if row.result != "code":
            return (0, "", told), (row.seq, row.issue, row.result, 0, 0, False, False)
        count = count + 1 if key == row.key else 1
        escalated = count > max_retries
        comment = escalated and not told
        return (count, row.key, told or escalated), (row.seq, row.issue, row.result, count, count - 1, escalated, comment)

    return fold(
        L.parse_attempts(attempts, "run_at").withColumnRenamed("run_at", "ts"), ["issue"], step, (0, "", False),
        "seq bigint, issue bigint, result string, retry_count bigint, stored_before bigint, escalated boolean, comment boolean", delay=delay, buckets=buckets,
    )


def posteriors(evidence: DataFrame, delay: str = DELAY, buckets: int = BUCKETS) -> DataFrame:
    """(seq, conclusion_id, posterior, evidence_count) after every piece of evidence."""

    def step(state, row):
        p, n = min(max(state[0], 0.01), 0.99), state[1] + 1
        eff = min(max(row.confidence * row.w, 0.0), 1.0)
        like = min(max(0.5 + (eff if row.relation == "supports" else -eff) / 2, 0.01), 0.99)
        p = p * like / (p * like + (1 - p) * (1 - like))
        return (p, n), (row.seq, row.conclusion_id, p, n)

    rows = evidence.filter("confidence >= 0 AND confidence <= 1").select("seq", "ts", "conclusion_id", "relation", "confidence", weight(F.col("bond_type")).alias("w"))
    return fold(
        rows, ["conclusion_id"], step, (PRIOR, 0), "seq bigint, conclusion_id bigint, posterior double, evidence_count bigint", delay=delay, buckets=buckets
    )


def convergence(comments: DataFrame, delay: str = DELAY, warn_s: int = L.SILENCE_WARN, finalize_s: int = L.SILENCE_FINALIZE, buckets: int = BUCKETS) -> DataFrame:
    """(issue, at_ms, result, reason) decisions of comments(issue, ts, body): a warning after 10 quiet minutes, the end 30 minutes later.

    A new human comment voids the warning; /finalize ends at once and /hold stops the timers; bot comments do not break
    the silence. Comments of one moment count /finalize last.
    """

    def step(state, row):
        due, phase = state
        if row.command == "/finalize":
            return (None, "closed"), (row.issue, row.ms, "finalize", "command_finalize")
        if row.command == "/hold":
            return (None, "held"), None
        return ((due, phase) if phase in ("closed", "held") else (row.ms + warn_s * 1000, "warn")), None

    def expire(state, at, key):
        if state[1] == "warn":
            return (at + finalize_s * 1000, "finalize"), (key[0], at, "warn", "silence_warn")
        return (None, "closed"), (key[0], at, "finalize", "warning_timeout_finalize")

    human = comments.filter(~L.is_bot_text(F.col("body"))).select("issue", "ts", F.coalesce(L.command_of(F.col("body")), F.lit("")).alias("command"))
    return fold(
        human, ["issue"], step, (None, "open"), "issue bigint, at_ms bigint, result string, reason string",
        order=("command",), delay=delay, buckets=buckets, due=lambda s: s[0], expire=expire,
    )
