"""Labels, routing, retries, discussions and task decisions over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgeloom.functions import labels as B
from edgeloom.functions import text as X
from edgeloom.operators import lifecycle as L
from edgeloom.plans.registry import query
from edgeloom.sources import documents as S

# small limits, so that the hot-key path runs on the test tables too
lst = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
STATES, AUX = lst(B.STATES), lst(B.AUX_LABELS)


def issues(t):
    return t("issues").withColumn("labels", F.split("labels", ","))


# -- labels --------------------------------------------------------------------------
LAB = f"""
lb AS (SELECT issue, state, body, title, string_split(labels, ',') AS labels FROM issues),
ls AS (SELECT *, list_filter(labels, lambda x, i: list_contains({STATES}, x) AND list_position(labels, x) = i) AS st,
  list_filter(labels, lambda x: starts_with(trim(x), 'bot:') AND NOT list_contains({STATES}, x)) AS bad, list_filter(labels, lambda x: NOT starts_with(trim(x), 'bot:')) AS oth FROM lb),
lc AS (SELECT *, CASE WHEN len(bad) > 0 THEN 'invalid' WHEN len(st) = 0 THEN 'none' WHEN len(st) = 1 THEN 'one' ELSE 'multiple' END AS cur FROM ls)
"""
query(
    "label_states",
    "SELECT issue, array_to_string(st, ',') AS states, array_to_string(bad, ',') AS invalid, array_to_string(oth, ',') AS other, cur AS current FROM lc",
    LAB,
)(
    lambda t: issues(t).select(
        "issue", *[F.array_join(f(F.col("labels")), ",").alias(n) for n, f in (("states", B.states), ("invalid", B.invalid_states), ("other", B.other_labels))], B.current(F.col("labels")).alias("current")
    )
)
query(
    "healed_states",
    f"""SELECT issue, st[list_position(r, list_min(r))] AS state, array_to_string(list_append(oth, st[list_position(r, list_min(r))]), ',') AS labels
    FROM (SELECT issue, st, oth, list_transform(st, lambda x: list_position({lst(B.PRIORITY)}, x)) AS r FROM lc WHERE cur = 'multiple')""",
    LAB,
)(lambda t: L.heal(issues(t)))
query(
    "escalation_labels",
    f"""SELECT issue, array_to_string(list_filter({AUX}, lambda x: list_contains(labels, x)), ',') AS removed, array_to_string(list_filter(labels, lambda x: NOT list_contains({AUX}, x)), ',') AS kept,
      array_to_string(list_filter(['integration-conflict', 'integration-gate-failed'], lambda x: list_contains(labels, x)), ',') AS blocking FROM lb""",
    LAB,
)(
    lambda t: issues(t).select(
        "issue", F.array_join(B.removed(F.col("labels"), B.AUX_LABELS), ",").alias("removed"), F.array_join(B.kept(F.col("labels"), B.AUX_LABELS), ",").alias("kept"), F.array_join(B.blocking(F.col("labels")), ",").alias("blocking")
    )
)
query(
    "label_guard",
    """SELECT issue, label, action, arg_min(actor, seq) AS actor, MIN(seq) AS seq, 'rolled_back' AS outcome, CASE action WHEN 'labeled' THEN 'remove' ELSE 'add' END AS compensate
    FROM label_events WHERE starts_with(label, 'bot:') AND actor NOT IN ('ops-bot', 'release-bot') GROUP BY issue, label, action""",
)(lambda t: L.label_guard(t("label_events"), ["ops-bot", "release-bot"], "enforce"))
query(
    "label_guard_dry_run",
    """SELECT issue, label, action, arg_min(actor, seq) AS actor, MIN(seq) AS seq, 'warned' AS outcome, 'none' AS compensate
    FROM label_events WHERE starts_with(label, 'bot:') AND actor <> 'ops-bot' GROUP BY issue, label, action""",
)(lambda t: L.label_guard(t("label_events"), ["ops-bot"]))
REC = LAB + """,
rc AS (SELECT issue, labels, oth, CASE WHEN issue % 5 = 0 THEN NULL ELSE 1000 + issue % 10 * 60 END AS escalated_s, issue % 3 <> 0 AS mergeable, CASE WHEN issue % 2 = 0 THEN 'passed' ELSE 'failed' END AS gate_status FROM lc)
"""
query(
    "recovered_issues",
    f"""SELECT issue, array_to_string(list_sort(list_filter({AUX}, lambda x: list_contains(labels, x))), ',') AS removed,
      array_to_string(list_append(list_filter(oth, lambda x: NOT list_contains({AUX}, x)), 'bot:pr-reviewable'), ',') AS kept
    FROM rc WHERE (escalated_s IS NULL OR 1500 - escalated_s >= 300) AND list_contains(labels, 'needs-human') AND (list_contains(labels, 'integration-conflict') OR list_contains(labels, 'integration-gate-failed'))
      AND mergeable AND (NOT list_contains(labels, 'integration-gate-failed') OR gate_status = 'passed')""",
    REC,
)(
    lambda t: L.recovery(
        issues(t).select(
            "issue", "labels", F.when(F.col("issue") % 5 != 0, 1000 + F.col("issue") % 10 * 60).alias("escalated_s"), (F.col("issue") % 3 != 0).alias("mergeable"),
            F.when(F.col("issue") % 2 == 0, "passed").otherwise("failed").alias("gate_status"),
        ),
        1500,
    )
)

# -- routing ---------------------------------------------------------------------------
ROUTE = """
rt AS (SELECT event_id, regexp_replace(regexp_replace(regexp_replace(lower(trim(workflow)), '\\.ya?ml$', ''), '^flow-', ''), '-reusable$', '') AS workflow, trim(event_name) AS event_name,
  NOT json_valid(payload) AS bad, CASE WHEN json_valid(payload) THEN payload ELSE '{}' END AS p FROM wf_events),
rf AS (SELECT *, COALESCE(trim(json_extract_string(p, '$.label.name')), '') AS label, COALESCE(json_extract_string(p, '$.action'), '') AS act, COALESCE(json_extract_string(p, '$.client_payload.event_source'), '') AS src,
  COALESCE(json_extract_string(p, '$.pull_request.merged'), 'false') = 'true' AS merged FROM rt),
rv AS (SELECT event_id, workflow, event_name, CASE
  WHEN workflow NOT IN ('orchestrate', 'plan', 'implement', 'review') THEN 'fail|none|fail_unsupported_workflow'
  WHEN workflow = 'orchestrate' AND event_name = 'schedule' THEN 'run|orchestrate|run_routable'
  WHEN event_name = 'issues' THEN CASE WHEN bad OR label = '' THEN 'fail|' || workflow || '|fail_invalid_event_payload'
    WHEN (workflow = 'orchestrate' AND label IN ('bot:orchestrate', 'bot:queued', 'bot:pr-reviewable', 'bot:premerged')) OR (workflow = 'plan' AND label = 'bot:fix')
      OR (workflow = 'implement' AND label IN ('bot:plan-final', 'bot:plan-approved')) OR (workflow = 'review' AND label = 'bot:pr-created') THEN 'run|' || workflow || '|run_routable' ELSE 'skip|none|skip_label_not_routable' END
  WHEN workflow <> 'orchestrate' OR event_name NOT IN ('repository_dispatch', 'pull_request') THEN 'skip|none|skip_event_not_supported'
  WHEN bad THEN 'fail|orchestrate|fail_invalid_event_payload'
  WHEN event_name = 'repository_dispatch' THEN CASE WHEN act <> 'flow.task.completed' THEN 'skip|none|skip_dispatch_action_not_allowed' WHEN src <> 'close-after-integration-merge' THEN 'skip|none|skip_dispatch_source_not_allowed' ELSE 'run|orchestrate|run_routable' END
  WHEN act <> 'closed' OR NOT merged THEN 'skip|none|skip_state_not_applicable' ELSE 'run|orchestrate|run_routable' END AS v FROM rf)
"""
ROUTE_SQL = "SELECT event_id, workflow, event_name, split_part(v, '|', 1) AS decision, split_part(v, '|', 2) AS action, split_part(v, '|', 3) AS reason FROM rv"
query("event_routes", ROUTE_SQL, ROUTE)(lambda t: L.route(t("wf_events")))
query("event_route_counts", "SELECT decision, reason, COUNT(*) AS n FROM (" + ROUTE_SQL + ") GROUP BY decision, reason", ROUTE)(
    lambda t: L.route(t("wf_events")).groupBy("decision", "reason").agg(F.count("*").alias("n"))
)

# -- idempotency, transitions, retries ---------------------------------------------------
IDEM = """
ik AS (SELECT seq, issue, phase, CASE WHEN issue > 0 AND phase <> '' AND input_hash <> '' THEN sha256(repo || chr(10) || CAST(issue AS VARCHAR) || chr(10) || phase || chr(10) || input_hash) END AS key FROM runs)
"""
IDEM_SQL = "SELECT seq, issue, phase, key, CASE WHEN key IS NULL THEN 'unkeyed' WHEN key = LAST_VALUE(key IGNORE NULLS) OVER (PARTITION BY issue, phase ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 'no-op' ELSE 'record' END AS action FROM ik"
query("idempotent_runs", IDEM_SQL, IDEM)(lambda t: L.idempotent_runs(t("runs")))
PAIRS = lst(f"{a}>{b}" for a, bs in B.TRANSITIONS.items() for b in bs)
TRANS_SQL = f"""SELECT seq, issue, f AS from_state, state AS to_state, CASE WHEN NOT list_contains({STATES}, state) THEN 'invalid_state' WHEN f IS NULL THEN 'first' WHEN f = state THEN 'no-op'
  WHEN list_contains({PAIRS}, f || '>' || state) THEN 'ok' ELSE 'invalid_transition' END AS verdict FROM (SELECT *, LAG(state) OVER (PARTITION BY issue ORDER BY seq) AS f FROM state_events)"""
query("state_transitions", TRANS_SQL)(lambda t: L.transition_log(t("state_events")))
ATT = f"""
at0 AS (SELECT *, COALESCE(NULLIF(upper(regexp_extract(log, '(?:^|\\s)reason_code=(\\S+)', 1)), ''), 'UNKNOWN') AS reason0, lower(regexp_extract(log, '(?:^|\\s)head_sha=(\\S+)', 1)) AS sha FROM attempts),
at1 AS (SELECT seq, issue, CASE WHEN outcome = 'pass' THEN 'pass' WHEN list_contains({lst(L.DEFERRED_REASONS)}, reason0) THEN 'deferred' ELSE 'code' END AS result, CASE WHEN outcome = 'pass' THEN 'PASS' ELSE reason0 END AS reason,
  CASE WHEN outcome <> 'pass' THEN 'issue-' || CAST(issue AS VARCHAR) || '-pr-' || CAST(pr AS VARCHAR) || CASE WHEN sha NOT IN ('', 'unknown') THEN '-head-' || sha WHEN run_id <> '' THEN '-run-' || run_id || '-attempt-' || COALESCE(NULLIF(run_attempt, ''), '1') ELSE '-local-' || strftime(run_at, '%Y%m%d%H%M%S') END END AS key FROM at0)
"""
query("gate_attempts", "SELECT * FROM at1", ATT)(lambda t: L.parse_attempts(t("attempts")))
RETRY = ATT + """,
ar AS (SELECT *, result = 'code' AS f, LAG(CASE WHEN result = 'code' THEN key END) OVER (PARTITION BY issue ORDER BY seq) AS pk FROM at1),
ag AS (SELECT *, SUM(CASE WHEN NOT f OR pk IS NULL OR pk <> key THEN 1 ELSE 0 END) OVER (PARTITION BY issue ORDER BY seq ROWS UNBOUNDED PRECEDING) AS g FROM ar),
ac AS (SELECT *, CASE WHEN f THEN ROW_NUMBER() OVER (PARTITION BY issue, g ORDER BY seq) ELSE 0 END AS n FROM ag),
ae AS (SELECT *, f AND n > 2 AS e FROM ac)
"""
RETRY_SQL = "SELECT seq, issue, result, n AS retry_count, greatest(n - 1, 0) AS stored_before, e AS escalated, e AND ROW_NUMBER() OVER (PARTITION BY issue, e ORDER BY seq) = 1 AS comment FROM ae"
query("gate_retries", RETRY_SQL, RETRY)(lambda t: L.gate_retries(L.parse_attempts(t("attempts")), 2))
IRETRY = ATT + """,
ir AS (SELECT seq, issue, result = 'pass' AS passed, COALESCE(key, '') AS key, LAG(CASE WHEN result <> 'pass' THEN key END) OVER (PARTITION BY issue ORDER BY seq) AS pk FROM at1),
ic AS (SELECT *, NOT passed AND (pk IS NULL OR pk <> key) AS c, SUM(CASE WHEN passed THEN 1 ELSE 0 END) OVER (PARTITION BY issue ORDER BY seq ROWS UNBOUNDED PRECEDING) AS g FROM ir),
inn AS (SELECT *, SUM(CASE WHEN c THEN 1 ELSE 0 END) OVER (PARTITION BY issue, g ORDER BY seq ROWS UNBOUNDED PRECEDING) AS n FROM ic)
"""
query(
    "integration_gate_retries",
    "SELECT seq, issue, CASE WHEN passed THEN 0 ELSE n END::BIGINT AS retry_count, CASE WHEN passed THEN 'passed' WHEN NOT c THEN 'ignored' WHEN n > 3 THEN 'escalated' ELSE 'retrying' END AS status FROM inn",
    IRETRY,
)(lambda t: L.integration_retries(L.parse_attempts(t("attempts")).select("seq", "issue", (F.col("result") == "pass").alias("passed"), F.coalesce("key", F.lit("")).alias("key")), 3))
CONFL = """
ce AS (SELECT event_id AS seq, user_id AS issue, CASE WHEN event_type IN ('click', 'view', 'error') THEN 'conflict' ELSE 'recovered' END AS kind FROM events),
cg AS (SELECT *, SUM(CASE WHEN kind = 'recovered' THEN 1 ELSE 0 END) OVER (PARTITION BY issue ORDER BY seq ROWS UNBOUNDED PRECEDING) AS g FROM ce),
cn AS (SELECT *, least(SUM(CASE WHEN kind = 'conflict' THEN 1 ELSE 0 END) OVER (PARTITION BY issue, g ORDER BY seq ROWS UNBOUNDED PRECEDING), 4) AS n FROM cg)
"""


def conflict_events(t):
    return t("events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("issue"), F.when(F.col("event_type").isin("click", "view", "error"), "conflict").otherwise("recovered").alias("kind"))


query(
    "conflict_retries",
    "SELECT seq, issue, CASE kind WHEN 'conflict' THEN n ELSE 0 END::BIGINT AS retry_count, CASE WHEN kind <> 'conflict' THEN 'reset' WHEN n > 3 THEN 'escalate' ELSE 'needs_fix' END AS status FROM cn",
    CONFL,
)(lambda t: L.conflict_retries(conflict_events(t), 3))

# -- comments ----------------------------------------------------------------------------
MARK = r"""
cl AS (SELECT issue AS issue_key, pos, i AS line, ls[i] AS text FROM (SELECT issue, pos, string_split(body, chr(10)) AS ls FROM comments), LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS i)),
mt AS (SELECT issue_key, pos, line, regexp_extract(text, '<!--\s+(BOT:\w+)((?:\s+\w+=\S+)*)\s+-->', 1) AS type, regexp_extract(text, '<!--\s+(BOT:\w+)((?:\s+\w+=\S+)*)\s+-->', 2) || ' ' AS kv FROM cl),
mk AS (SELECT issue_key, pos, line, type, COALESCE(TRY_CAST(regexp_extract(kv, '\sissue=(\S+)', 1) AS BIGINT), 0) AS issue, COALESCE(TRY_CAST(regexp_extract(kv, '\srev=(\S+)', 1) AS BIGINT), 0) AS rev,
  regexp_extract(kv, '\sfinish=(\S+)', 1) IN ('1', 'true') AS finish, regexp_extract(kv, '\sdecision=(\S+)', 1) AS decision, COALESCE(TRY_CAST(regexp_extract(kv, '\sdcount=(\S+)', 1) AS BIGINT), 0) AS dcount, regexp_extract(kv, '\sakey=(\S+)', 1) AS akey
  FROM mt WHERE type IN ('BOT:DISCUSSION_SUMMARY', 'BOT:CONVERGE_WARNING', 'BOT:GATE_RETRY')),
cmd AS (SELECT issue_key AS issue, pos, arg_min(trim(text), line) AS command FROM cl WHERE trim(text) IN ('/finalize', '/hold') GROUP BY issue_key, pos)
"""
M_COLS = ["issue_key", "pos", "line", "type", "issue", "rev", "finish", "decision", "dcount", "akey"]
query("comment_markers", "SELECT * FROM mk", MARK)(lambda t: S.markers(t("comments")).select(*M_COLS))
query("latest_markers", "SELECT type, issue, rev, pos, line FROM mk QUALIFY ROW_NUMBER() OVER (PARTITION BY type, issue ORDER BY rev DESC, issue_key, pos, line) = 1", MARK)(
    lambda t: L.latest_markers(S.markers(t("comments"))).select("type", "issue", "rev", "pos", "line")
)
query("last_commands", "SELECT issue, arg_max(command, pos) AS command FROM cmd GROUP BY issue", MARK)(lambda t: L.last_commands(t("comments")))
query(
    "prompt_window",
    """SELECT issue, pos FROM (SELECT issue, pos, body, author LIKE '%[bot]' AS bot, ROW_NUMBER() OVER (PARTITION BY issue, author LIKE '%[bot]' ORDER BY pos DESC) AS r FROM comments) WHERE NOT bot AND r <= 2 AND trim(body) <> ''
    UNION ALL SELECT issue, MAX(pos) FROM comments WHERE author LIKE '%[bot]' AND contains(body, 'BOT:DISCUSSION_SUMMARY') GROUP BY issue""",
)(lambda t: L.prompt_window(t("comments"), 2))
query(
    "context_budget",
    """SELECT issue, pos, SUM(length(body) + 7) OVER (PARTITION BY issue ORDER BY pos DESC ROWS UNBOUNDED PRECEDING) - 7 <= 1500 AS kept FROM comments""",
)(lambda t: L.context_budget(t("comments"), 1500))
query(
    "trimmed_fields",
    """SELECT issue, pos, substr(body, 1, length(body) - least(length(body), over)::INT) AS body, substr(author, 1, length(author) - least(length(author), over - least(length(body), over))::INT) AS author
    FROM (SELECT *, greatest(length(body) + length(author) - 200, 0) AS over FROM comments)""",
)(lambda t: (lambda cut: t("comments").select("issue", "pos", cut["body"].alias("body"), cut["author"].alias("author")))(L.trim_fields(["body", "author"], 200)))
ROUNDS = "ro AS (SELECT issue, pos + 1 AS round, length(body) % 3 = 0 AS finish FROM comments)"


def rounds(t):
    return t("comments").select("issue", (F.col("pos") + 1).alias("round"), (F.length("body") % 3 == 0).alias("finish"))


query("publish_on_change", "SELECT issue, round, COALESCE(LAG(finish) OVER (PARTITION BY issue ORDER BY round) <> finish, TRUE) AS publish FROM ro", ROUNDS)(lambda t: L.publish_rounds(rounds(t), only_on_change=True))
query("publish_every_two", "SELECT issue, round, round % 2 = 0 AS publish FROM ro", ROUNDS)(lambda t: L.publish_rounds(rounds(t), every=2))
CONV = MARK + """,
cf AS (SELECT c.issue, arg_max(m.command, c.pos) FILTER (WHERE m.command IS NOT NULL) AS command, MAX(CASE WHEN NOT contains(body, '<!-- BOT:') THEN at_s END) AS human, MAX(at_s) + 200 * (c.issue % 14) AS now_s
  FROM comments c LEFT JOIN cmd m ON m.issue = c.issue AND m.pos = c.pos GROUP BY c.issue),
sm AS (SELECT issue, arg_min(finish, (-rev, pos, line)) AS finish, MAX(rev) AS round FROM mk WHERE type = 'BOT:DISCUSSION_SUMMARY' AND issue = issue_key GROUP BY issue),
wn AS (SELECT w.issue, c.at_s AS warn FROM (SELECT issue, arg_min(pos, (-rev, pos, line)) AS pos FROM mk WHERE type = 'BOT:CONVERGE_WARNING' AND issue = issue_key GROUP BY issue) w JOIN comments c ON c.issue = w.issue AND c.pos = w.pos),
cv AS (SELECT cf.issue, CASE WHEN command = '/finalize' THEN 'finalize|command_finalize' WHEN command = '/hold' THEN 'not_converged|command_hold' WHEN finish THEN 'finalize|ai_should_finish' WHEN human IS NULL THEN 'not_converged|no_human_comments'
  WHEN warn IS NOT NULL AND human <= warn AND now_s - warn >= 1800 THEN 'finalize|warning_timeout_finalize' WHEN warn IS NOT NULL AND human <= warn THEN 'not_converged|warning_waiting'
  WHEN now_s - human >= 600 THEN 'warn|silence_warn' WHEN warn IS NOT NULL THEN 'not_converged|warning_invalidated_by_new_human_comment' ELSE 'not_converged|continue_discussion' END AS v,
  COALESCE(round > 0 AND round >= 2, FALSE) AS round_limited FROM cf LEFT JOIN sm ON sm.issue = cf.issue LEFT JOIN wn ON wn.issue = cf.issue)
"""


def now_of(t):
    return t("comments").groupBy("issue").agg((F.max("at_s")).alias("m")).select("issue", (F.col("m") + 200 * (F.col("issue") % 14)).alias("now_s"))


query("discussion_convergence", "SELECT issue, split_part(v, '|', 1) AS result, split_part(v, '|', 2) AS reason, round_limited FROM cv", CONV)(
    lambda t: L.convergence(t("comments"), S.markers(t("comments")), now_of(t), 2)
)

# -- issue declarations ---------------------------------------------------------------------
DECL = r"""
dp AS (SELECT issue, list_transform(regexp_extract_all(regexp_extract(body, '(?i)depends[- ]on:\s*((?:#\d+[\s,]*)+)', 1), '#(\d+)', 1), lambda x: CAST(x AS BIGINT)) AS line_deps,
  list_transform(regexp_extract_all(array_to_string(regexp_extract_all(body, '(?im)^(?:depends[- ]on|blocked[- ]by):\s*(.+)$', 1), ' '), '(?:[\w\-]+/[\w\-]+)?#(\d+)', 1), lambda x: CAST(x AS BIGINT)) AS multi_deps,
  COALESCE(CAST(NULLIF(regexp_extract(body, '(?i)parent(?:\s+issue)?:\s*#(\d+)', 1), '') AS BIGINT), 0) AS parent FROM issues)
"""
query("declared_parents_and_dependencies", "SELECT issue, array_to_string(line_deps, ',') AS line_deps, (SELECT string_agg(CAST(v AS VARCHAR), ',' ORDER BY i) FROM (SELECT v, MIN(i) AS i FROM (SELECT unnest(multi_deps) AS v, unnest(range(len(multi_deps))) AS i) GROUP BY v)) AS multi_deps, parent FROM dp", DECL)(
    lambda t: t("issues").select(
        "issue", F.array_join(X.depends_on(F.col("body")), ",").alias("line_deps"), F.nullif(F.array_join(X.depends_on(F.col("body"), "multi"), ","), F.lit("")).alias("multi_deps"), X.parent_issue(F.col("body")).alias("parent")
    )
)
INF = "inf AS (SELECT o_orderkey + 1 AS issue, o_custkey + 2 AS dep FROM orders UNION ALL SELECT o_orderkey + 1, o_orderkey + 1 FROM orders)"


def inferred(t):
    k = (F.col("o_orderkey") + 1).alias("issue")
    return t("orders").select(k, (F.col("o_custkey") + 2).alias("dep")).union(t("orders").select(k, F.col("o_orderkey") + 1))


ID = DECL + "," + INF + """,
idp AS (SELECT DISTINCT issue, dep, 'declared' AS source FROM (SELECT issue, unnest(line_deps) AS dep FROM dp) WHERE issue <> dep AND dep IN (SELECT issue FROM issues)
  UNION SELECT issue, dep, 'inferred' FROM inf WHERE issue <> dep AND dep IN (SELECT issue FROM issues) AND issue IN (SELECT issue FROM dp WHERE len(line_deps) = 0))
"""
query("issue_dependencies", "SELECT * FROM idp", ID)(lambda t: L.declared_dependencies(t("issues"), inferred(t)))
query(
    "persisted_dependencies",
    """SELECT issue, COUNT(*) AS deps, bool_and(issue IN (SELECT issue FROM issue_tasks) AND dep IN (SELECT issue FROM issue_tasks)) AS persisted FROM idp GROUP BY issue""",
    ID,
)(lambda t: L.persisted_dependencies(L.declared_dependencies(t("issues"), inferred(t)), t("issue_tasks")))
ACTIVE = "lower(replace(status, '_', '-')) IN ('pending', 'in-progress') OR status IN ('blocked', 'failed')"
REP = f"""
tk AS (SELECT *, {ACTIVE} AS active FROM issue_tasks),
rp AS (SELECT issue, arg_min({{'task_id': task_id, 'branch': branch, 'active': active}}, (CASE WHEN active THEN 0 ELSE 1 END, CASE WHEN active THEN pos ELSE -pos END)) AS r FROM tk GROUP BY issue)
"""
query("representative_tasks", "SELECT issue, r.task_id AS task_id, r.branch AS branch, r.active AS active FROM rp", REP)(lambda t: L.representative_tasks(t("issue_tasks")))
query(
    "task_reuse",
    "SELECT i.issue, k.task_id, k.task_id IS NOT NULL AS reused FROM issues i LEFT JOIN (SELECT issue, arg_min(task_id, pos) AS task_id FROM tk WHERE active GROUP BY issue) k ON k.issue = i.issue",
    REP,
)(lambda t: L.create_or_reuse(t("issues"), t("issue_tasks")))
query(
    "integration_branches",
    """SELECT w.issue, r.branch AS branch, CASE WHEN r.branch IS NULL THEN 'missing_task' WHEN r.branch <> (SELECT arg_min(r.branch, p.issue) FROM rp p WHERE p.issue > 0) THEN 'branch_mismatch' END AS problem
    FROM (SELECT DISTINCT issue FROM issues) w LEFT JOIN rp ON rp.issue = w.issue""",
    REP,
)(lambda t: L.integration_branch(t("issues"), t("issue_tasks")))
query("branch_slugs", "SELECT task_id, CASE WHEN starts_with(branch, 'integration/') THEN substr(branch, 13) ELSE '' END AS slug FROM issue_tasks")(
    lambda t: t("issue_tasks").select("task_id", L.branch_slug(F.col("branch")).alias("slug"))
)
query("task_statuses", f"SELECT task_id, CASE lower(status) WHEN 'in_progress' THEN 'in-progress' WHEN 'completed' THEN 'completed' ELSE status END AS status, {ACTIVE} AS active FROM issue_tasks")(
    lambda t: t("issue_tasks").select("task_id", L.task_status(F.col("status")).alias("status"), L.is_active(F.col("status")).alias("active"))
)
query(
    "parent_progress",
    """SELECT parent, COUNT(*) AS children, COUNT(*) FILTER (WHERE done) AS completed, COUNT(*) FILTER (WHERE state <> 'closed') AS open_children, bool_and(done) AS all_completed, COUNT(*) FILTER (WHERE state <> 'closed') = 0 AS close_ready
    FROM (SELECT d.parent, i.state, COALESCE(lower(s.status) = 'completed', FALSE) AS done FROM dp d JOIN issues i ON i.issue = d.issue LEFT JOIN (SELECT issue, arg_max(status, pos) AS status FROM issue_tasks GROUP BY issue) s ON s.issue = d.issue WHERE d.parent > 0) GROUP BY parent""",
    DECL,
)(lambda t: L.parent_progress(t("issues"), t("issue_tasks")))
SLOG = """
se AS (SELECT event_id AS seq, user_id AS id, CASE WHEN k % 10 < 4 THEN 'pending' WHEN k % 10 < 8 THEN 'in_progress' ELSE 'completed' END AS status FROM event_k),
sn AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY seq) AS i, id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 2000) AS b FROM se),
sp AS (SELECT DISTINCT id, 0::BIGINT AS i, 'pending' AS now, '' AS f, '' AS status, '' AS verdict, 0::BIGINT AS seq FROM se
  UNION ALL SELECT id, i, CASE verdict WHEN 'ok' THEN status ELSE f END, f, status, verdict, seq FROM (SELECT n.id, n.i, p.now AS f, n.status, n.seq,
    CASE WHEN p.now || '>' || n.status NOT IN ('pending>pending', 'pending>in_progress', 'in_progress>in_progress', 'in_progress>completed', 'completed>completed') THEN 'invalid_transition'
      WHEN n.b AND n.status <> 'pending' THEN 'blocked' ELSE 'ok' END AS verdict FROM sp p JOIN sn n ON n.id = p.id AND n.i = p.i + 1))
"""


def status_events(t):
    k = F.col("k") % 10
    return t("event_k").select(F.col("event_id").alias("seq"), F.col("user_id").alias("id"), F.when(k < 4, "pending").when(k < 8, "in_progress").otherwise("completed").alias("status"))


query(
    "task_status_log",
    "SELECT seq, id, f AS from_status, status AS to_status, verdict FROM sp WHERE i > 0",
    SLOG,
)(lambda t: L.status_log(status_events(t), t("supplier").filter("s_acctbal < 2000").select(F.col("s_suppkey").alias("id"))))
query(
    "merged_metadata",
    """SELECT user_id AS id, event_type AS key, arg_max(v, event_id) AS value FROM (SELECT event_id, user_id, event_type, CASE WHEN k % 4 = 0 THEN '' ELSE 'v' || CAST(k AS VARCHAR) END AS v FROM event_k) GROUP BY user_id, event_type HAVING arg_max(v, event_id) <> ''""",
)(
    lambda t: L.merge_metadata(
        t("event_k").select(F.col("event_id").alias("seq"), F.col("user_id").alias("id"), F.col("event_type").alias("key"), F.when(F.col("k") % 4 != 0, F.concat(F.lit("v"), F.col("k").cast("string"))).alias("value"))
    )
)
query(
    "metadata_changes",
    """SELECT issue AS id, 'slug' AS key, n AS value FROM (SELECT issue, arg_min(branch, pos) AS o, arg_max(branch, pos) AS n FROM issue_tasks GROUP BY issue) WHERE o <> n""",
)(
    lambda t: L.metadata_changes(
        t("issue_tasks").groupBy(F.col("issue").alias("id")).agg(F.min_by("branch", "pos").alias("value")).withColumn("key", F.lit("slug")),
        t("issue_tasks").groupBy(F.col("issue").alias("id")).agg(F.max_by("branch", "pos").alias("value")).withColumn("key", F.lit("slug")),
    )
)
QUEUE = """
qu AS (SELECT o_orderkey + 1 AS issue, o_orderkey AS pos, o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' AS running, o_custkey % 4 AS failures FROM orders WHERE o_orderstatus <> 'F'),
qd AS (SELECT o_orderkey + 1 AS issue, o_custkey + 1 AS dep FROM orders WHERE o_orderpriority <> '5-LOW'), qf AS (SELECT o_orderkey + 1 AS issue FROM orders WHERE o_orderstatus = 'F')
"""
query(
    "admitted_issues",
    "SELECT issue, pos FROM qu WHERE NOT running AND failures < 3 AND NOT EXISTS (SELECT 1 FROM qd WHERE qd.issue = qu.issue AND qd.dep NOT IN (SELECT issue FROM qf)) ORDER BY pos LIMIT 20",
    QUEUE,
)(
    lambda t: L.admit(
        t("orders").filter("o_orderstatus <> 'F'").select((F.col("o_orderkey") + 1).alias("issue"), F.col("o_orderkey").alias("pos"), ((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "O")).alias("running"), (F.col("o_custkey") % 4).alias("failures")),
        t("orders").filter("o_orderpriority <> '5-LOW'").select((F.col("o_orderkey") + 1).alias("issue"), (F.col("o_custkey") + 1).alias("dep")),
        t("orders").filter("o_orderstatus = 'F'").select((F.col("o_orderkey") + 1).alias("issue")),
        3,
        20,
    )
)
query(
    "review_outcomes",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_custkey % 5 > 0 AND o_orderkey % 3 = 0 THEN 'merge_and_done' WHEN o_custkey % 5 > 0 AND o_orderkey % 3 = 1 THEN 'queued' ELSE 'wait' END AS outcome FROM orders""",
)(
    lambda t: t("orders").select(
        "o_orderkey", L.review_outcome(F.col("o_orderstatus") == "F", F.col("o_custkey") % 5, F.when(F.col("o_orderkey") % 3 == 0, "MERGEABLE").when(F.col("o_orderkey") % 3 == 1, "CONFLICTING").otherwise("UNKNOWN")).alias("outcome")
    )
)
query(
    "reconcile_due",
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN TRUE WHEN 1 THEN TRUE ELSE o_orderkey % 97 * 60 >= 3600 END AS due FROM orders""",
)(
    lambda t: t("orders").select(
        "o_orderkey",
        L.reconcile_due(
            F.when(F.col("o_orderkey") % 5 == 0, None).when(F.col("o_orderkey") % 5 == 1, "not a time").otherwise(F.date_format(F.timestamp_seconds(F.lit(1700000000) - F.col("o_orderkey") % 97 * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
            3600, F.timestamp_seconds(F.lit(1700000000)),
        ).alias("due"),
    )
)
query(
    "hydrated_issues",
    "SELECT issue FROM lc WHERE state = 'open' AND len(st) > 0 AND NOT list_contains(labels, 'bot:orchestrate') AND issue NOT IN (SELECT issue FROM tk WHERE active)",
    LAB + "," + REP,
)(lambda t: L.hydrate(issues(t), t("issue_tasks"), "bot:orchestrate"))
query("pruned_tasks", "SELECT issue, task_id, 'completed' AS new_status FROM tk WHERE active AND issue IN (SELECT issue FROM issues WHERE state = 'closed')", REP)(lambda t: L.prune_tasks(t("issues"), t("issue_tasks")))
query(
    "closed_issue_cleanup",
    f"""SELECT issue, nd AS needs_done, aux AS has_aux FROM (SELECT issue, len(bad) = 0 AND len(st) > 0 AND (len(st) > 1 OR st[1] <> 'bot:done') AS nd, list_has_any(labels, {AUX}) AS aux FROM lc WHERE state = 'closed') WHERE nd OR aux""",
    LAB,
)(lambda t: L.clean_closed(issues(t)))
query("issue_numbers", "SELECT DISTINCT o_custkey AS issue FROM orders WHERE o_custkey > 0")(lambda t: L.issue_numbers(t("orders"), "o_custkey"))
