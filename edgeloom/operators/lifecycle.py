"""Workflow events, retries, leases and task decisions as tables.

Order-dependent operators use chunked scans, so an issue that owns a third of
all events is still worked on by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.functions import labels as L
from edgeloom.functions import text as X
from edgeloom.operators.scans import ordered_scan, streaks
from edgeloom.session import Scratch
from edgeloom.sources.records import event_fields

# Deferred failure reasons.
DEFERRED_REASONS = (
    "CHECKS_QUERY_FAILED", "NETWORK_TRANSIENT", "AUTH_FAILED", "RATE_LIMITED", "REQUIRED_JOBS_PENDING", "PENDING_RETRYING", "PENDING_BLOCKED",
    "REQUIRED_JOBS_MISSING", "CRITICAL_REGRESSION_MISSING", "INSUFFICIENT_COVERAGE_FOR_HIGH_RISK", "REQUIRED_JOBS_NOT_EXECUTED", "REQUIRED_JOBS_TIMEOUT",
    "TIMEOUT_RETRYING", "TIMEOUT_BLOCKED",
)
# Routing.
ORCHESTRATE_LABELS = ("bot:orchestrate", "bot:queued", "bot:pr-reviewable", "bot:premerged")
LABEL_WORKFLOWS = {"plan": ("bot:fix",), "implement": ("bot:plan-final", "bot:plan-approved"), "review": ("bot:pr-created",)}
DISPATCH_SOURCE = "close-after-integration-merge"
# The deployment's own names; pass others where they differ.
WORKFLOW_PREFIX, DISPATCH_ACTION = "flow-", "flow.task.completed"
ACTIVE_STATUSES = ("pending", "in-progress", "blocked", "failed")
SILENCE_WARN, SILENCE_FINALIZE, RECOVERY_COOLDOWN = 600, 1800, 300
CONFLICT_RETRIES, GATE_RETRIES = 3, 3
STATUS_STEPS = ("pending>pending", "pending>in_progress", "in_progress>in_progress", "in_progress>completed", "completed>completed")


# -- routing -------------------------------------------------------------------


def workflow_name(raw: Column, prefix: str = WORKFLOW_PREFIX) -> Column:
    w = F.lower(F.trim(raw))
    for pattern in (r"\.yml$", r"\.yaml$", rf"^{prefix}", r"-reusable$"):
        w = F.regexp_replace(w, pattern, "")
    return w


def route(events: DataFrame, prefix: str = WORKFLOW_PREFIX, dispatch_action: str = DISPATCH_ACTION) -> DataFrame:
    """Adds normalised workflow, decision, action, reason to events(workflow, event_name, payload).

    ``prefix`` is cut from workflow names; ``dispatch_action`` is the one dispatch
    that may run. Stateless, so the same function serves a table and a stream.
    """
    parsed = event_fields(events)
    w, e = workflow_name(F.col("workflow"), prefix), F.trim("event_name")
    verdict = lambda decision, action, reason: F.struct(F.lit(decision).alias("decision"), F.lit(action).alias("action"), F.lit(reason).alias("reason"))
    bad = F.col("bad_payload")
    no_label = bad | (F.col("label") == "")

    def by_label(action: str, allowed: tuple[str, ...]) -> Column:
        return (
            F.when(no_label, verdict("fail", action, "fail_invalid_event_payload"))
            .when(~F.col("label").isin(*allowed), verdict("skip", "none", "skip_label_not_routable"))
            .otherwise(verdict("run", action, "run_routable"))
        )

    run = verdict("run", "orchestrate", "run_routable")
    broken = verdict("fail", "orchestrate", "fail_invalid_event_payload")
    orchestrate = (
        F.when(e == "issues", by_label("orchestrate", ORCHESTRATE_LABELS))
        .when(
            e == "repository_dispatch",
            F.when(bad, broken)
            .when(F.col("action") != dispatch_action, verdict("skip", "none", "skip_dispatch_action_not_allowed"))
            .when(F.col("source") != DISPATCH_SOURCE, verdict("skip", "none", "skip_dispatch_source_not_allowed"))
            .otherwise(run),
        )
        .when(
            e == "pull_request",
            F.when(bad, broken).when((F.col("action") != "closed") | ~F.col("merged"), verdict("skip", "none", "skip_state_not_applicable")).otherwise(run),
        )
        .when(e == "schedule", run)
        .otherwise(verdict("skip", "none", "skip_event_not_supported"))
    )
    choice = F.when(w == "orchestrate", orchestrate)
    for name, allowed in LABEL_WORKFLOWS.items():
        choice = choice.when(w == name, F.when(e != "issues", verdict("skip", "none", "skip_event_not_supported")).otherwise(by_label(name, allowed)))
    choice = choice.otherwise(verdict("fail", "none", "fail_unsupported_workflow"))
    kept = [c for c in events.columns if c not in ("workflow", "event_name", "payload")]
    return parsed.select(*kept, w.alias("workflow"), e.alias("event_name"), choice.alias("v")).select(*kept, "workflow", "event_name", "v.*")


# -- idempotency and state -------------------------------------------------------


def idempotency_key(repo: Column, issue: Column, phase: Column, input_hash: Column) -> Column:
    return F.sha2(F.concat_ws("\n", F.trim(repo), issue.cast("string"), F.trim(phase), F.trim(input_hash)), 256)


def idempotent_runs(runs: DataFrame, **split) -> DataFrame:
    """(seq, issue, phase, key, action): record, no-op (same key as the latest of its phase) or unkeyed; unkeyed runs leave the latest key alone."""
    enabled = (F.col("issue") > 0) & (F.trim("phase") != "") & (F.trim("input_hash") != "")
    key = F.when(enabled, idempotency_key(F.col("repo"), F.col("issue"), F.col("phase"), F.col("input_hash")))
    keyed = runs.select("seq", "issue", F.trim("phase").alias("phase"), key.alias("key"))
    scanned = ordered_scan(keyed, ["issue", "phase"], "seq", last_before={"before": F.col("key")}, **split)
    return scanned.select(
        "seq", "issue", "phase", "key",
        F.when(F.col("key").isNull(), "unkeyed").when(F.col("key") == F.col("before"), "no-op").otherwise("record").alias("action"),
    )


def transition_log(events: DataFrame, **split) -> DataFrame:
    """(seq, issue, from_state, to_state, verdict) of an observed state log."""
    scanned = ordered_scan(events.select("seq", "issue", "state"), ["issue"], "seq", prev={"from_state": "state"}, **split)
    a, b = F.col("from_state"), F.col("state")
    verdict = (
        F.when(~b.isin(*L.STATES), "invalid_state").when(a.isNull(), "first").when(a == b, "no-op").when(L.valid_pair(a, b), "ok").otherwise("invalid_transition")
    )
    return scanned.select("seq", "issue", a.alias("from_state"), b.alias("to_state"), verdict.alias("verdict"))


def heal(issues: DataFrame) -> DataFrame:
    """(issue, state, labels) for issues with more than one valid state and no invalid one."""
    labels = F.col("labels")
    return issues.filter(L.current(labels) == "multiple").select(
        "issue", L.healed(labels).alias("state"), F.array_join(L.with_state(labels, L.healed(labels)), ",").alias("labels")
    )


# -- retries ---------------------------------------------------------------------


def failure_class(reason: Column) -> Column:
    return F.when(F.upper(F.trim(reason)).isin(*DEFERRED_REASONS), "deferred").otherwise("code")


def attempt_key(issue: Column, pr: Column, head: Column, run_id: Column, run_attempt: Column, at: Column) -> Column:
    """Key by head SHA, else by run, else by local time; ``at`` is a yyyyMMddHHmmss text."""
    sha = F.lower(F.trim(head))
    base = F.concat(F.lit("issue-"), issue.cast("string"), F.lit("-pr-"), pr.cast("string"))
    attempt = F.coalesce(F.nullif(F.trim(run_attempt), F.lit("")), F.lit("1"))
    return (
        F.when((sha != "") & (sha != "unknown"), F.concat(base, F.lit("-head-"), sha))
        .when(F.trim(run_id) != "", F.concat(base, F.lit("-run-"), F.trim(run_id), F.lit("-attempt-"), attempt))
        .otherwise(F.concat(base, F.lit("-local-"), at))
    )


def parse_attempts(attempts: DataFrame, *kept: str) -> DataFrame:
    """(seq, issue, result, reason, key): pass, deferred or code results of gate logs; ``run_at`` is the time of the run. ``kept`` columns stay."""
    reason = F.upper(F.trim(X.gate_field(F.col("log"), "reason_code")))
    reason = F.when(reason == "", "UNKNOWN").otherwise(reason)
    key = attempt_key(F.col("issue"), F.col("pr"), X.gate_field(F.col("log"), "head_sha"), F.col("run_id"), F.col("run_attempt"), F.date_format("run_at", "yyyyMMddHHmmss"))
    passed = F.col("outcome") == "pass"
    return attempts.select(
        "seq", "issue", F.when(passed, "pass").otherwise(failure_class(reason)).alias("result"),
        F.when(passed, "PASS").otherwise(reason).alias("reason"), F.when(~passed, key).alias("key"), *kept,
    )


def gate_retries(attempts: DataFrame, max_retries: int = GATE_RETRIES, **split) -> DataFrame:
    """(seq, issue, result, retry_count, stored_before, escalated, comment) of parse_attempts rows.

    Pass and deferred reset to 0; a failure counts on from the previous row only
    when that row failed with the same key. ``stored_before`` is the count before
    this failure; the escalation comment is written once per issue.
    """
    # the slim parsed rows and their counts are each read twice; written, the logs are parsed once
    scratch = Scratch(attempts.sparkSession, "retries")
    rows = scratch.save(attempts.select("seq", "issue", "result", F.when(F.col("result") == "code", F.col("key")).alias("fkey")), "parsed")
    counted = streaks(rows, ["issue"], "seq", "fkey", **split).withColumn("escalated", F.col("streak") > max_retries)
    counted = scratch.save(counted.select("seq", "issue", "result", "streak", "escalated"), "counted")
    first = counted.filter("escalated").groupBy("issue").agg(F.min("seq").alias("first_seq"))
    return counted.join(first, "issue", "left").select(
        "seq", "issue", "result", F.col("streak").alias("retry_count"), F.greatest(F.col("streak") - 1, F.lit(0)).cast("bigint").alias("stored_before"), "escalated",
        F.coalesce(F.col("seq") == F.col("first_seq"), F.lit(False)).alias("comment"),
    )


def integration_retries(attempts: DataFrame, max_retries: int = GATE_RETRIES, **split) -> DataFrame:
    """(seq, issue, retry_count, status): repeats of the last processed key are ignored, a pass clears count and key.

    attempts(seq, issue, passed, key); a failure without a key is never a repeat.
    """
    own = F.when(F.col("key") == "", F.concat(F.lit("seq "), F.col("seq").cast("string"))).otherwise(F.col("key"))
    rows = attempts.select("seq", "issue", "passed", F.when(~F.col("passed"), own).alias("fkey"))
    rows = Scratch(attempts.sparkSession, "retries").save(rows, "parsed")
    n = F.col("runs")
    return streaks(rows, ["issue"], "seq", "fkey", **split).select(
        "seq", "issue", n.alias("retry_count"),
        F.when(F.col("passed"), "passed").when(F.col("streak") > 1, "ignored").when(n > max_retries, "escalated").otherwise("retrying").alias("status"),
    )


def conflict_retries(events: DataFrame, threshold: int = CONFLICT_RETRIES, **split) -> DataFrame:
    """(seq, issue, retry_count, status) of events(seq, issue, kind conflict|recovered); recovery resets."""
    rows = events.select("seq", "issue", "kind", F.when(F.col("kind") == "conflict", "conflict").alias("hit"))
    count = F.least(F.col("rows"), F.lit(threshold + 1))
    return streaks(rows, ["issue"], "seq", "hit", **split).select(
        "seq", "issue", count.alias("retry_count"),
        F.when(F.col("hit").isNull(), "reset").when(count > threshold, "escalate").otherwise("needs_fix").alias("status"),
    )


# -- discussion --------------------------------------------------------------------


def latest_markers(markers: DataFrame) -> DataFrame:
    """Marker with the highest revision per (type, issue); the first one on ties."""
    rest = [c for c in markers.columns if c not in ("type", "issue")]
    best = F.min_by(F.struct(*rest), F.struct(-F.col("rev"), F.col("issue_key"), F.col("pos"), F.col("line")))
    return markers.groupBy("type", "issue").agg(best.alias("m")).select("type", "issue", "m.*")


def command_of(body: Column) -> Column:
    """First /finalize or /hold line of a comment, null if none."""
    rows = F.transform(F.split(F.trim(body), "\n"), lambda x: F.trim(x))
    return F.try_element_at(F.filter(rows, lambda x: x.isin("/finalize", "/hold")), F.lit(1))


def last_commands(comments: DataFrame) -> DataFrame:
    """(issue, command): the newest comment with a command decides."""
    c = comments.select("issue", "pos", command_of(F.col("body")).alias("command")).filter("command IS NOT NULL")
    return c.groupBy("issue").agg(F.max_by("command", "pos").alias("command"))


def is_bot_author(author: Column, author_type: Column | None = None) -> Column:
    by_name = author.endswith("[bot]")
    return by_name if author_type is None else by_name | (author_type == "Bot")


def is_bot_text(body: Column) -> Column:
    return body.contains("<!-- BOT:")


def prompt_window(comments: DataFrame, last_human: int) -> DataFrame:
    """(issue, pos): the last N human comments and the newest bot summary; N <= 0 keeps all; blank bodies drop.

    Blank bodies count as comments until the end, as they occupy a place in the window.
    """
    filled = F.trim("body") != ""
    if last_human <= 0:
        return comments.filter(filled).select("issue", "pos")
    bot = is_bot_author(F.col("author"))
    w = Window.partitionBy("issue").orderBy(F.desc("pos"))
    human = comments.filter(~bot).select("issue", "pos", "body", F.row_number().over(w).alias("rank")).filter(F.col("rank") <= last_human)
    summary = comments.filter(bot & F.col("body").contains("BOT:DISCUSSION_SUMMARY")).groupBy("issue").agg(F.max_by(F.struct("pos", "body"), "pos").alias("s"))
    both = human.select("issue", "pos", "body").unionByName(summary.select("issue", "s.pos", "s.body"))
    return both.filter(filled).select("issue", "pos")


def context_budget(comments: DataFrame, budget: int, separator: int = 7, **split) -> DataFrame:
    """(issue, pos, kept): oldest comments drop until the rest fits the budget in characters."""
    size = F.length("body") + separator
    rows = comments.select("issue", "pos", size.cast("bigint").alias("n"))
    scanned = ordered_scan(rows, ["issue"], "pos", running={"upto": F.col("n")}, **split)
    total = rows.groupBy("issue").agg(F.sum("n").alias("total"))
    tail = F.col("total") - F.col("upto") + F.col("n") - separator
    return scanned.join(total, "issue").select("issue", "pos", (tail <= budget).alias("kept"))


def trim_fields(fields: list[str], budget: int) -> dict[str, Column]:
    """Field lengths cut in the given order until all fields together fit."""
    total = sum((F.length(F.coalesce(f, F.lit(""))) for f in fields), F.lit(0))
    overflow = F.greatest(total - budget, F.lit(0))
    out = {}
    for f in fields:
        have = F.length(F.coalesce(f, F.lit("")))
        cut = F.least(have, overflow)
        out[f] = F.substring(F.coalesce(f, F.lit("")), F.lit(1), have - cut)
        overflow = overflow - cut
    return out


def publish_rounds(rounds: DataFrame, every: int = 1, only_on_change: bool = False, **split) -> DataFrame:
    """(issue, round, publish) of rounds(issue, round, finish)."""
    scanned = ordered_scan(rounds, ["issue"], "round", prev={"before": "finish"}, **split)
    on_round = F.lit(True) if every <= 1 else F.col("round") % every == 0
    publish = F.coalesce(F.col("before") != F.col("finish"), F.lit(True)) if only_on_change else on_round
    return scanned.select("issue", "round", publish.alias("publish"))


def convergence(comments: DataFrame, markers: DataFrame, now: DataFrame, max_round: int = 0) -> DataFrame:
    """(issue, result, reason, round_limited) at now(issue, now_s).

    comments(issue, pos, at_s, body); markers as read from the comments. Order:
    last command, should-finish flag, human silence with or without a valid warning.
    """
    bot = is_bot_text(F.col("body"))
    facts = comments.withColumn("command", command_of(F.col("body"))).groupBy("issue").agg(
        F.max_by("command", F.when(F.col("command").isNotNull(), F.col("pos"))).alias("command"),
        F.max(F.when(~bot, F.col("at_s"))).alias("human_s"),
    )
    own = markers.filter("issue = issue_key")
    place = F.struct(-F.col("rev"), F.col("pos"), F.col("line"))
    summary = own.filter("type = 'BOT:DISCUSSION_SUMMARY'").groupBy("issue").agg(F.min_by("finish", place).alias("finish"), F.max("rev").alias("round"))
    warn_at = own.filter("type = 'BOT:CONVERGE_WARNING'").groupBy("issue").agg(F.min_by("pos", place).alias("pos"))
    warned = warn_at.join(comments.select("issue", "pos", F.col("at_s").alias("warn_s")), ["issue", "pos"]).select("issue", "warn_s")
    rows = facts.join(now, "issue").join(summary, "issue", "left").join(warned, "issue", "left")
    c, human, warn, at = F.col("command"), F.col("human_s"), F.col("warn_s"), F.col("now_s")
    pick = lambda result, reason: F.struct(F.lit(result).alias("result"), F.lit(reason).alias("reason"))
    valid_warning = warn.isNotNull() & (human <= warn)
    choice = (
        F.when(c == "/finalize", pick("finalize", "command_finalize"))
        .when(c == "/hold", pick("not_converged", "command_hold"))
        .when(F.col("finish"), pick("finalize", "ai_should_finish"))
        .when(human.isNull(), pick("not_converged", "no_human_comments"))
        .when(valid_warning & (at - warn >= SILENCE_FINALIZE), pick("finalize", "warning_timeout_finalize"))
        .when(valid_warning, pick("not_converged", "warning_waiting"))
        .when(at - human >= SILENCE_WARN, pick("warn", "silence_warn"))
        .when(warn.isNotNull(), pick("not_converged", "warning_invalidated_by_new_human_comment"))
        .otherwise(pick("not_converged", "continue_discussion"))
    )
    limited = F.lit(False) if max_round <= 0 else F.coalesce((F.col("round") > 0) & (F.col("round") >= max_round), F.lit(False))
    return rows.select("issue", choice.alias("v"), limited.alias("round_limited")).select("issue", "v.*", "round_limited")


# -- label guard and recovery ----------------------------------------------------------


def label_guard(events: DataFrame, allowed: list[str], mode: str = "dry-run") -> DataFrame:
    """(issue, label, action, actor, seq, outcome, compensate): first unauthorised change per issue, label and action."""
    if mode not in ("dry-run", "enforce"):
        raise ValueError("mode is dry-run or enforce")
    bad = events.filter(L.is_state_label(F.col("label")) & ~F.col("actor").isin(*allowed))
    first = bad.groupBy("issue", "label", "action").agg(F.min(F.struct("seq", "actor")).alias("f"))
    undo = F.when(F.col("action") == "labeled", "remove").otherwise("add")
    return first.select(
        "issue", "label", "action", F.col("f.actor").alias("actor"), F.col("f.seq").alias("seq"),
        F.lit("rolled_back" if mode == "enforce" else "warned").alias("outcome"), (undo if mode == "enforce" else F.lit("none")).alias("compensate"),
    )


def recovery(issues: DataFrame, now_s: int) -> DataFrame:
    """(issue, removed, kept): escalated issues that may flow again.

    issues(issue, labels, escalated_s, mergeable, gate_status): cooled down, needs-human with a blocking label, mergeable, gate passed.
    """
    labels = F.col("labels")
    has = lambda x: F.array_contains("labels", x)
    cooled = F.col("escalated_s").isNull() | (F.lit(now_s) - F.col("escalated_s") >= RECOVERY_COOLDOWN)
    blocked = has(L.NEEDS_HUMAN) & (has(L.CONFLICT) | has(L.GATE_FAILED))
    gate_ok = ~has(L.GATE_FAILED) | (F.col("gate_status") == "passed")
    drop = L.AUX_LABELS
    return issues.filter(cooled & blocked & F.col("mergeable") & gate_ok).select(
        "issue", F.array_join(F.array_sort(L.removed(labels, drop)), ",").alias("removed"),
        F.array_join(L.with_state(L.kept(labels, drop), F.lit("bot:pr-reviewable")), ",").alias("kept"),
    )


# -- tasks ------------------------------------------------------------------------------


def task_status(raw: Column) -> Column:
    low = F.lower(raw)
    return F.when(low.isin("pending", "completed", "deleted"), low).when(low.isin("in-progress", "in_progress"), "in-progress").otherwise(raw)


def is_active(status: Column) -> Column:
    return task_status(status).isin(*ACTIVE_STATUSES)


def representative_tasks(tasks: DataFrame) -> DataFrame:
    """(issue, task_id, branch, active): first active task of an issue, else its last one."""
    active = is_active(F.col("status"))
    order = F.struct(F.when(active, 0).otherwise(1), F.when(active, F.col("pos")).otherwise(-F.col("pos")), F.col("task_id"))
    best = F.min_by(F.struct("task_id", "branch", active.alias("active")), order)
    return tasks.filter("issue > 0").groupBy("issue").agg(best.alias("t")).select("issue", "t.*")


def create_or_reuse(requests: DataFrame, tasks: DataFrame) -> DataFrame:
    """(issue, task_id, reused): the first active task is reused, otherwise one is created."""
    first = tasks.filter(is_active(F.col("status"))).groupBy("issue").agg(F.min_by("task_id", F.struct("pos", "task_id")).alias("task_id"))
    return requests.select("issue").distinct().join(first, "issue", "left").select("issue", "task_id", F.col("task_id").isNotNull().alias("reused"))


def integration_branch(requests: DataFrame, tasks: DataFrame) -> DataFrame:
    """(issue, branch, problem): branch of each positive requested issue; missing tasks and mismatches are marked.

    The expected branch is that of the smallest issue that has a task; it is read by a scalar subquery, not by a join.
    """
    wanted = requests.filter("issue > 0").select("issue").distinct()
    rows = wanted.join(representative_tasks(tasks).select("issue", "branch"), "issue", "left")
    expected = rows.agg(F.min_by("branch", F.when(F.col("branch").isNotNull(), F.col("issue"))).alias("expected"))
    problem = F.when(F.col("branch").isNull(), "missing_task").when(F.col("branch") != expected.scalar(), "branch_mismatch")
    return rows.select("issue", "branch", problem.alias("problem"))


def issue_numbers(tasks: DataFrame, column: str = "issue") -> DataFrame:
    """(issue): the distinct positive numbers of a column; null and other numbers drop."""
    return tasks.select(F.col(column).alias("issue")).filter("issue > 0").distinct()


def declared_dependencies(issues: DataFrame, inferred: DataFrame, grammar: str = "line") -> DataFrame:
    """(issue, dep, source): declared dependencies within the known issues; inferred ones only where nothing is declared."""
    deps = issues.select("issue", X.depends_on(F.col("body"), grammar).alias("deps"))
    known = issues.select(F.col("issue").alias("dep"))
    owners = deps.filter(F.size("deps") > 0)
    declared = owners.select("issue", F.explode("deps").alias("dep")).withColumn("source", F.lit("declared"))
    guessed = inferred.select("issue", "dep").join(owners.select("issue"), "issue", "left_anti").withColumn("source", F.lit("inferred"))
    guessed = guessed.join(issues.select("issue"), "issue", "left_semi")
    return declared.unionByName(guessed).filter("issue <> dep").distinct().join(known, "dep", "left_semi").select("issue", "dep", "source")


def persisted_dependencies(deps: DataFrame, tasks: DataFrame) -> DataFrame:
    """(issue, deps, persisted): false when the issue or one of its dependencies has no task."""
    have = tasks.filter("issue > 0").select("issue").distinct()
    rows = deps.join(have.withColumn("own", F.lit(True)), "issue", "left").join(have.select(F.col("issue").alias("dep"), F.lit(True).alias("other")), "dep", "left")
    return rows.groupBy("issue").agg(F.count("*").alias("deps"), F.bool_and(F.col("own").isNotNull() & F.col("other").isNotNull()).alias("persisted"))


def parent_progress(issues: DataFrame, tasks: DataFrame) -> DataFrame:
    """(parent, children, completed, open_children, all_completed, close_ready) of issues(issue, state, body)."""
    kids = issues.select(X.parent_issue(F.col("body")).alias("parent"), "issue", F.lower("state").alias("state")).filter("parent > 0")
    status = tasks.filter("issue > 0").groupBy("issue").agg(F.max_by(task_status(F.col("status")), F.struct("pos", "task_id")).alias("status"))
    done = F.coalesce(F.col("status") == "completed", F.lit(False))
    return (
        kids.join(status, "issue", "left").groupBy("parent")
        .agg(F.count("*").alias("children"), F.count_if(done).alias("completed"), F.count_if(F.col("state") != "closed").alias("open_children"), F.bool_and(done).alias("all_completed"))
        .withColumn("close_ready", F.col("open_children") == 0)
    )


def status_log(events: DataFrame, blocked: DataFrame) -> DataFrame:
    """(seq, id, from_status, to_status, verdict) of events(seq, id, status); blocked(id) may not advance.

    A refused update leaves the status as it was. Legal steps only go forward, so a task is in progress after the first
    such request and completed after the first completion that follows it: two minima instead of a scan.
    """
    rows = events.select("seq", "id", "status").join(blocked.select("id").distinct().withColumn("b", F.lit(True)), "id", "left")
    starts = rows.filter("b IS NULL AND status = 'in_progress'").groupBy("id").agg(F.min("seq").alias("started"))
    rows = rows.join(starts, "id", "left")
    ends = rows.filter("status = 'completed' AND seq > started").groupBy("id").agg(F.min("seq").alias("ended"))
    rows = rows.join(ends, "id", "left")
    now = F.when(F.col("seq") > F.col("ended"), "completed").when(F.col("seq") > F.col("started"), "in_progress").otherwise("pending")
    rows = rows.withColumn("from_status", now)
    legal = F.concat_ws(">", "from_status", "status").isin(*STATUS_STEPS)
    verdict = F.when(~legal, "invalid_transition").when(F.col("b").isNotNull() & F.col("status").isin("in_progress", "completed"), "blocked").otherwise("ok")
    return rows.select("seq", "id", "from_status", F.col("status").alias("to_status"), verdict.alias("verdict"))


def merge_metadata(patches: DataFrame) -> DataFrame:
    """(id, key, value): last value per key, keys whose last value is null are gone. patches(seq, id, key, value)."""
    last = patches.groupBy("id", "key").agg(F.max_by(F.struct("value"), "seq").alias("v"))
    return last.select("id", "key", "v.value").filter("value IS NOT NULL")


def admit(queue: DataFrame, deps: DataFrame, done: DataFrame, max_failures: int, slots: int) -> DataFrame:
    """(issue, pos): queued issues to start now, in queue order, up to the free slots.

    queue(issue, pos, running, failures); an issue waits while one of deps(issue, dep) is not in done(issue).
    """
    waiting = deps.join(done.select(F.col("issue").alias("dep")), "dep", "left_anti").select("issue")
    free = queue.filter(~F.col("running"))
    if max_failures > 0:
        free = free.filter(F.col("failures") < max_failures)
    return free.join(waiting, "issue", "left_anti").orderBy("pos").limit(slots).select("issue", "pos")


def review_outcome(merged: Column, pr: Column, mergeable: Column) -> Column:
    return (
        F.when(merged, "done")
        .when((pr > 0) & (mergeable == "MERGEABLE"), "merge_and_done")
        .when((pr > 0) & (mergeable == "CONFLICTING"), "queued")
        .otherwise("wait")
    )


def reconcile_due(last_run: Column, interval_s: int, now: Column) -> Column:
    """True when never run, when the text is no timestamp, or when the interval is over."""
    t = F.try_to_timestamp(last_run)
    return t.isNull() | (F.unix_timestamp(now) - F.unix_timestamp(t) >= interval_s)


def hydrate(issues: DataFrame, tasks: DataFrame, intake: str) -> DataFrame:
    """Open issues with a valid state and without an active task; issues still at intake are left out."""
    active = tasks.filter(is_active(F.col("status"))).select("issue")
    labels = F.col("labels")
    picked = issues.filter((F.lower("state") == "open") & (F.size(L.states(labels)) > 0) & ~F.array_contains("labels", intake))
    return picked.join(active, "issue", "left_anti").select("issue")


def prune_tasks(issues: DataFrame, tasks: DataFrame) -> DataFrame:
    """Active tasks of closed issues, to be completed."""
    closed = issues.filter(F.lower("state") == "closed").select("issue")
    return tasks.filter(is_active(F.col("status"))).join(closed, "issue", "left_semi").select("issue", "task_id", F.lit("completed").alias("new_status"))


def clean_closed(issues: DataFrame) -> DataFrame:
    """(issue, needs_done, has_aux): closed issues whose state or auxiliary labels must be cleaned."""
    labels = F.col("labels")
    s = L.states(labels)
    needs = (F.size(L.invalid_states(labels)) == 0) & (F.size(s) > 0) & ((F.size(s) > 1) | (F.try_element_at(s, F.lit(1)) != "bot:done"))
    aux = F.arrays_overlap(labels, F.array(*[F.lit(a) for a in L.AUX_LABELS]))
    return issues.filter(F.lower("state") == "closed").select("issue", F.coalesce(needs, F.lit(False)).alias("needs_done"), aux.alias("has_aux")).filter("needs_done OR has_aux")


def metadata_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, key, value) of new(id, key, value) that differ from old(id, key, value)."""
    before = old.select("id", "key", F.col("value").alias("before"))
    return new.filter("value <> ''").join(before, ["id", "key"], "left").filter("NOT (value <=> before)").select("id", "key", "value")


def branch_slug(branch: Column, prefix: str = "integration/") -> Column:
    """Slug after the branch prefix, '' for other branches."""
    return F.when(branch.startswith(prefix), F.substr(branch, F.lit(len(prefix) + 1))).otherwise("")
