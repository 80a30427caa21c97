"""Logical inputs derived from the given tables.

Each input is one SELECT that reads the same in Spark SQL and in ANSI SQL, so a
query and its check start from the same rows. Inputs may use earlier inputs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from edgeloom.operators.relations import relation_weights
from edgeloom.session import Scratch

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

INPUTS: dict[str, str] = {}

# -- files, references, modules ------------------------------------------------
INPUTS["refs"] = """
SELECT 'cust/' || CAST(o_custkey AS STRING) || '.ts' AS src_path,
       'supp/' || CAST(l_suppkey AS STRING) || '.ts' AS dst_path,
       CASE WHEN l_returnflag = 'N' THEN 'import' ELSE 'call' END AS kind
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""
INPUTS["path_module"] = """
SELECT 'cust/' || CAST(c_custkey AS STRING) || '.ts' AS path, n_name AS module
FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL
SELECT 'supp/' || CAST(s_suppkey AS STRING) || '.ts' AS path, n_name AS module
FROM supplier JOIN nation ON s_nationkey = n_nationkey
"""
INPUTS["relations"] = """
SELECT a.module AS caller, b.module AS callee,
       CAST(SUM(CASE WHEN kind = 'import' THEN 1 ELSE 0 END) AS BIGINT) AS import_edges,
       CAST(SUM(CASE WHEN kind = 'call' THEN 1 ELSE 0 END) AS BIGINT) AS call_edges,
       COUNT(*) AS total_edges
FROM refs JOIN path_module a ON src_path = a.path JOIN path_module b ON dst_path = b.path
WHERE a.module <> b.module
GROUP BY a.module, b.module
"""
INPUTS["allow"] = """
SELECT caller, callee FROM relations WHERE import_edges % 3 <> 0
UNION
SELECT n_name AS caller, 'EXTERNAL_' || CAST(n_regionkey AS STRING) AS callee FROM nation
"""
INPUTS["forbid"] = """
SELECT caller, callee FROM relations WHERE total_edges % 7 = 0
UNION
SELECT 'EXTERNAL_' || CAST(n_regionkey AS STRING) AS caller, n_name AS callee FROM nation
"""
INPUTS["temporary_allow"] = "SELECT caller, callee FROM relations WHERE import_edges % 3 = 0 AND total_edges % 5 <> 1"
INPUTS["blocked"] = "SELECT caller, callee FROM relations WHERE total_edges % 11 = 2"
INPUTS["gates"] = """
SELECT 'transition' AS profile, 'unexpected_edges_count' AS metric, 0 AS limit_value
UNION ALL SELECT 'transition', 'forbidden_edges_count', 5
UNION ALL SELECT 'transition', 'forbidden_total_edges', 26
UNION ALL SELECT 'transition', 'missing_edges_count', 0
UNION ALL SELECT 'transition', 'directed_density_pct', 75
UNION ALL SELECT 'transition', 'bidirectional_pair_count', 20
UNION ALL SELECT 'target', 'unexpected_edges_count', 0
UNION ALL SELECT 'target', 'forbidden_edges_count', 0
UNION ALL SELECT 'target', 'forbidden_total_edges', 0
UNION ALL SELECT 'target', 'missing_edges_count', 0
UNION ALL SELECT 'target', 'directed_density_pct', 40
UNION ALL SELECT 'target', 'bidirectional_pair_count', 5
"""
INPUTS["expected"] = """
SELECT caller, callee, total_edges % 4 <> 0 AS allowed FROM relations WHERE total_edges % 3 <> 0
UNION ALL
SELECT 'EXTERNAL_' || CAST(n_regionkey AS STRING) AS caller, n_name AS callee, n_nationkey % 2 = 0 AS allowed FROM nation
"""
INPUTS["modules"] = """
SELECT n_name AS module_id, 'REGION_' || CAST(n_regionkey AS STRING) AS parent,
       CASE WHEN n_nationkey % 3 = 0 THEN 'L' || CAST(n_nationkey % 4 AS STRING) END AS layer
FROM nation
UNION ALL
SELECT 'REGION_' || CAST(r_regionkey AS STRING), CAST(NULL AS STRING),
       CASE WHEN r_regionkey < 4 THEN 'L' || CAST(r_regionkey AS STRING) END
FROM region
"""
INPUTS["region_expected"] = """
SELECT 'REGION_' || CAST(a.r_regionkey AS STRING) AS caller,
       'REGION_' || CAST((a.r_regionkey + 1) % 5 AS STRING) AS callee, a.r_regionkey % 2 = 0 AS allowed
FROM region a
UNION ALL
SELECT n_name AS caller, 'REGION_' || CAST((n_regionkey + 2) % 5 AS STRING) AS callee, n_nationkey % 3 <> 0 AS allowed FROM nation
UNION ALL
SELECT caller, callee, total_edges % 4 <> 0 AS allowed FROM relations WHERE total_edges % 5 = 0
"""
INPUTS["part_paths"] = """
SELECT p_partkey AS id,
       'src/' || CASE WHEN p_size <= 10 THEN 'api' WHEN p_size <= 20 THEN 'service' WHEN p_size <= 30 THEN 'dao'
                      WHEN p_size <= 40 THEN 'util' ELSE 'misc' END
       || '/' || lower(p_type) || '/' || lower(replace(p_brand, '#', '_')) || '/F'
       || CAST(p_partkey AS STRING) || CASE p_partkey % 6 WHEN 0 THEN '.ts' WHEN 1 THEN '.go' WHEN 2 THEN '.ex'
          WHEN 3 THEN '.rs' WHEN 4 THEN '.py' ELSE '_test.go' END AS path,
       p_brand AS module, p_size AS size
FROM part
"""
INPUTS["path_rules"] = """
SELECT DISTINCT 'type_' || lower(p_type) AS module_id, CAST(100 AS BIGINT) AS precedence,
       'src/*/' || lower(p_type) || '/**' AS include_glob,
       'src/api/' || lower(p_type) || '/brand_1*/*' AS exclude_glob
FROM part
UNION ALL
SELECT DISTINCT lower(replace(p_brand, '#', '_')), CAST(50 AS BIGINT),
       'src/misc/**/' || lower(replace(p_brand, '#', '_')) || '/*.ts', 'none/**'
FROM part
UNION ALL
SELECT DISTINCT 'api', CAST(NULL AS BIGINT), 'src/api/**', 'src/api/**/*.py' FROM part
"""
# -- graphs --------------------------------------------------------------------
INPUTS["dag_edges"] = """
SELECT p_partkey AS src, CAST(floor(p_partkey / 2) AS BIGINT) AS dst FROM part WHERE p_partkey >= 2
UNION
SELECT p_partkey AS src, CAST(floor(p_partkey / 3) AS BIGINT) AS dst FROM part WHERE p_partkey >= 3
"""
INPUTS["cyc_edges"] = """
SELECT s_suppkey AS src, (s_suppkey * s_suppkey + 1) % (SELECT COUNT(*) FROM supplier) AS dst FROM supplier
UNION
SELECT s_suppkey AS src, (s_suppkey + 7) % (SELECT COUNT(*) FROM supplier) AS dst FROM supplier WHERE s_suppkey % 13 = 0
"""
INPUTS["hierarchy"] = """
SELECT s_suppkey AS node, CASE WHEN s_suppkey >= 1 THEN CAST(floor(s_suppkey / 2) AS BIGINT) END AS parent,
       CASE WHEN s_suppkey % 5 = 0 THEN 'L' || CAST(s_suppkey % 4 AS STRING) END AS layer
FROM supplier
"""
INPUTS["tasks"] = """
SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN 'completed' WHEN p_size % 4 = 1 THEN 'in_progress' ELSE 'pending' END AS status,
       p_size % 7 = 1 AS integrated
FROM part
"""
INPUTS["broken_hierarchy"] = """
SELECT s_suppkey AS node, CASE WHEN s_suppkey % 23 = 5 THEN s_suppkey + 1000000000 WHEN s_suppkey IN (2, 3) THEN s_suppkey * 2
       WHEN s_suppkey >= 1 THEN CAST(floor(s_suppkey / 2) AS BIGINT) END AS parent
FROM supplier
"""
INPUTS["seeds"] = "SELECT MAX(p_partkey) AS seed FROM part GROUP BY p_brand"
INPUTS["low_seeds"] = "SELECT MIN(p_partkey) AS seed FROM part WHERE p_partkey > 0 GROUP BY p_brand"
INPUTS["ring_seeds"] = "SELECT MAX(s_suppkey) AS seed FROM supplier GROUP BY s_nationkey"
INPUTS["blocked_by"] = """
SELECT src AS id, dst AS dep FROM cyc_edges WHERE src <> dst
UNION ALL SELECT s_suppkey AS id, s_suppkey + 1000000000 AS dep FROM supplier WHERE s_suppkey % 17 = 3
"""
INPUTS["blocks"] = """
SELECT dst AS id, src AS blocked FROM cyc_edges WHERE src <> dst AND (src + dst) % 5 <> 0
UNION ALL SELECT s_suppkey AS id, s_suppkey + 2000000000 AS blocked FROM supplier WHERE s_suppkey % 21 = 4
UNION ALL SELECT s_suppkey AS id, s_suppkey + 1 AS blocked FROM supplier WHERE s_suppkey = 1
"""
INPUTS["commit_functions"] = """
SELECT 'c' || CAST(l_orderkey AS STRING) AS commit_hash, l_partkey AS function_id,
       CASE l_linenumber % 3 WHEN 0 THEN 'add' WHEN 1 THEN 'modify' ELSE 'delete' END AS change_type
FROM lineitem
"""
# -- evidence ------------------------------------------------------------------
INPUTS["evidence"] = """
SELECT event_id AS seq, ts, event_id AS evidence_id, user_id AS conclusion_id,
       CASE WHEN event_type = 'error' OR (event_type = 'view' AND event_id % 3 = 0) THEN 'conflicts' ELSE 'supports' END AS relation,
       value / 60 AS confidence,
       CASE event_type WHEN 'click' THEN 'deduction' WHEN 'view' THEN 'verification' WHEN 'error' THEN 'verification' ELSE 'exploration' END AS bond_type
FROM events
"""
# -- history -------------------------------------------------------------------
INPUTS["commits"] = """
SELECT 'c' || CAST(o_orderkey AS STRING) AS hash,
       CASE o_orderkey % 7 WHEN 0 THEN 'fix null type in page offset' WHEN 1 THEN 'Export: rollback transaction'
            WHEN 2 THEN 'closes #' || CAST(o_custkey AS STRING) || ' utc timezone'
            WHEN 3 THEN 'refs #' || CAST(o_custkey AS STRING) || ' (#' || CAST(o_orderkey AS STRING) || ') concurrent xss'
            WHEN 4 THEN 'fixes #' || CAST(o_custkey AS STRING) || ' #' || CAST(o_custkey AS STRING) || ' #7'
            WHEN 5 THEN 'Merge pull request #' || CAST(o_orderkey AS STRING) || ' sub( #' || CAST(o_custkey AS STRING) || ' ) parent(#3)'
            ELSE 'tidy ' || lower(o_orderpriority) END AS message,
       'dev' || CAST(o_custkey AS STRING) AS author,
       CAST(CAST(o_orderdate AS DATE) AS STRING) AS date,
       o_orderkey AS ord
FROM orders
"""
INPUTS["changed_files"] = """
SELECT 'c' || CAST(l_orderkey AS STRING) AS hash, l_linenumber * 1000000000000 + l_partkey AS line_no,
       CASE l_partkey % 8 WHEN 0 THEN 'app/controllers/OrderItemController.php' WHEN 1 THEN 'app/models/PayModel.php'
            WHEN 2 THEN 'app/Services/' || lower(p_type) || '/index.php' WHEN 3 THEN 'lib/shop/order/cart_handler.ex'
            WHEN 4 THEN 'src/' || lower(p_type) || '/MainQuery.ts' WHEN 5 THEN 'auth/traits/Login' || CAST(p_size AS STRING) || 'Trait.php'
            WHEN 6 THEN 'tests/app/' || replace(p_name, ' ', '') || 'Test.php' ELSE 'deploy/' || replace(p_name, ' ', '_') || '.go' END AS path,
       CAST(l_quantity AS BIGINT) AS add, CAST(l_linenumber AS BIGINT) AS del
FROM lineitem JOIN part ON l_partkey = p_partkey
"""
# -- issues, tasks, labels -----------------------------------------------------
INPUTS["issues"] = """
SELECT o_orderkey + 1 AS issue, o_orderkey AS pos,
       CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'open' END AS state,
       'Work on ' || o_orderpriority || ' item' AS title,
       CASE o_orderkey % 6
            WHEN 0 THEN 'Depends-on: #' || CAST(o_custkey AS STRING) || ', #' || CAST(o_orderkey AS STRING) || ' #' || CAST(o_custkey AS STRING) || chr(10) || 'parent: #' || CAST(1 + o_custkey % 40 AS STRING)
            WHEN 1 THEN 'intro' || chr(10) || 'blocked by: acme/web#' || CAST(o_custkey AS STRING) || ' and #' || CAST(o_orderkey + 1 AS STRING)
            WHEN 2 THEN 'Parent issue: #' || CAST(1 + o_custkey % 40 AS STRING) || chr(10) || 'text'
            WHEN 3 THEN 'see pull request #5, closes #' || CAST(o_custkey AS STRING) || ' (#9) refs #0'
            WHEN 4 THEN 'depends on: #99999999' ELSE 'nothing here' END AS body,
       CASE o_orderkey % 8 WHEN 0 THEN 'bot:queued' WHEN 1 THEN 'bot:done' WHEN 2 THEN 'bot:fix,bot:plan-draft'
            WHEN 3 THEN 'bot:unknown,needs-human' WHEN 4 THEN 'needs-human,integration-conflict,bot:pr-needs-fix'
            WHEN 5 THEN 'bot:orchestrate,area' WHEN 6 THEN 'area,bug' ELSE 'bot:implementing,bot:implementing,integration-gate-failed' END AS labels
FROM orders
"""
INPUTS["issue_tasks"] = """
SELECT l_orderkey + 1 AS issue, l_orderkey * 10 + l_linenumber AS task_id, l_linenumber AS pos,
       CASE l_partkey % 7 WHEN 0 THEN 'pending' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'Completed' WHEN 3 THEN 'deleted'
            WHEN 4 THEN 'blocked' WHEN 5 THEN 'completed' ELSE 'completed' END AS status,
       CASE WHEN l_suppkey % 3 = 0 THEN 'main' ELSE 'integration/meta-' || CAST(l_suppkey % 3 AS STRING) END AS branch
FROM (SELECT l_orderkey, l_linenumber, MIN(l_partkey) AS l_partkey, MIN(l_suppkey) AS l_suppkey FROM lineitem GROUP BY l_orderkey, l_linenumber) one_line
"""
# -- comments ------------------------------------------------------------------
INPUTS["comments"] = """
SELECT conv_id AS issue, turn AS pos, CASE WHEN role = 'assistant' THEN 'helper[bot]' ELSE 'dev' END AS author,
       turn * 420 + (conv_id % 7) * 60 AS at_s,
       text || chr(10)
       || CASE (conv_id + turn) % 6 WHEN 0 THEN '<!-- BOT:DISCUSSION_SUMMARY issue=' || CAST(conv_id AS STRING) || ' rev=' || CAST(turn % 3 AS STRING) || ' finish=' || CAST(conv_id % 2 AS STRING) || ' decision=merge risk=low dcount=x -->'
            WHEN 1 THEN '/hold' WHEN 2 THEN ' /finalize ' || chr(10) || '/hold'
            WHEN 3 THEN '<!-- BOT:CONVERGE_WARNING issue=' || CAST(conv_id AS STRING) || ' rev=' || CAST(turn AS STRING) || ' -->'
            WHEN 4 THEN 'x <!-- BOT:MYSTERY issue=1 --> <!--  BOT:GATE_RETRY issue=' || CAST(conv_id AS STRING) || ' rev=1 akey=k-' || CAST(turn AS STRING) || '  -->'
            ELSE '' END AS body
FROM conversations
"""
# -- workflow events -----------------------------------------------------------
INPUTS["event_k"] = "SELECT event_id, ts, user_id, event_type, value, CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k FROM events"
INPUTS["wf_events"] = """
SELECT event_id,
       CASE k % 9 WHEN 0 THEN 'flow-plan.yml' WHEN 1 THEN 'Implement' WHEN 2 THEN 'flow-review-reusable.yaml'
            WHEN 3 THEN 'deploy' ELSE ' flow-orchestrate-reusable.yml ' END AS workflow,
       CASE event_type WHEN 'click' THEN 'issues' WHEN 'view' THEN 'repository_dispatch' WHEN 'error' THEN 'pull_request'
            WHEN 'signup' THEN 'schedule' ELSE CASE WHEN k % 2 = 0 THEN 'issues' ELSE 'push' END END AS event_name,
       CASE WHEN k % 23 = 0 THEN '{broken'
            WHEN event_type IN ('click', 'purchase') THEN
              CASE k % 6 WHEN 0 THEN '{"label": {"name": "bot:queued"}}' WHEN 1 THEN '{"label": {"name": " bot:fix "}}'
                   WHEN 2 THEN '{"label": {"name": "bot:plan-final"}}' WHEN 3 THEN '{"label": {"name": "bot:pr-created"}}'
                   WHEN 4 THEN '{"label": {"name": " "}}' ELSE '{"label": {"name": "bug"}}' END
            WHEN event_type = 'view' THEN
              CASE k % 3 WHEN 0 THEN '{"action": "flow.task.completed", "client_payload": {"event_source": "close-after-integration-merge"}}'
                   WHEN 1 THEN '{"action": "flow.task.completed", "client_payload": {"event_source": "manual"}}' ELSE '{"action": "other"}' END
            WHEN event_type = 'error' THEN
              CASE k % 3 WHEN 0 THEN '{"action": "closed", "pull_request": {"merged": true}}'
                   WHEN 1 THEN '{"action": "closed", "pull_request": {"merged": false}}' ELSE '{"action": "opened"}' END
            ELSE '{}' END AS payload
FROM event_k
"""
INPUTS["state_events"] = """
SELECT event_id AS seq, ts, user_id AS issue,
       CASE WHEN k % 10 < 5 THEN 'bot:queued' WHEN k % 10 < 7 THEN 'bot:fix' WHEN k % 10 = 7 THEN 'bot:plan-draft' WHEN k % 10 = 8 THEN '' ELSE 'bot:nonsense' END AS want_from,
       CASE event_type WHEN 'click' THEN 'bot:queued' WHEN 'view' THEN 'bot:fix' WHEN 'error' THEN 'bot:plan-draft'
            WHEN 'signup' THEN 'bot:plan-final' ELSE 'bot:implementing' END AS state
FROM event_k
"""
INPUTS["runs"] = """
SELECT event_id AS seq, ts, user_id AS issue, 'acme/web' AS repo,
       CASE WHEN k % 17 = 0 THEN '' ELSE event_type END AS phase, CASE WHEN k % 5 = 0 THEN '' ELSE 'h' || CAST(k % 2 AS STRING) END AS input_hash
FROM event_k
"""
INPUTS["attempts"] = """
SELECT event_id AS seq, ts AS run_at, user_id AS issue, user_id % 20 AS pr,
       CASE event_type WHEN 'signup' THEN 'pass' ELSE 'fail' END AS outcome,
       'gate log' || chr(10) || '[gate] reason_code=' || CASE WHEN event_type = 'purchase' THEN 'auth_failed' WHEN k % 13 = 0 THEN 'RATE_LIMITED' ELSE 'TESTS_FAILED' END
         || ' head_sha=' || CASE WHEN k % 4 = 0 THEN 'unknown' ELSE 'AB' || CAST(k % 3 AS STRING) END || ' x=1' AS log,
       CASE WHEN k % 8 = 0 THEN '' ELSE CAST(CAST(floor(event_id / 500) AS BIGINT) AS STRING) END AS run_id,
       CASE WHEN k % 3 = 0 THEN '' ELSE '2' END AS run_attempt
FROM event_k
"""
INPUTS["lease_ops"] = """
SELECT event_id AS seq, ts, user_id AS issue, 'w' || CAST(k % 3 AS STRING) AS owner,
       CASE event_type WHEN 'error' THEN 'release' WHEN 'signup' THEN 'refresh' ELSE 'acquire' END AS op,
       event_id AS at_s, CAST(100 + (k % 5) * 150 AS BIGINT) AS ttl_s
FROM event_k
"""
INPUTS["lease_times"] = """
SELECT event_id AS seq, ts, user_id AS issue, 'w' || CAST(k % 3 AS STRING) AS owner,
       CASE event_type WHEN 'error' THEN 'release' WHEN 'signup' THEN 'refresh' ELSE 'acquire' END AS op,
       CAST(((EXTRACT(YEAR FROM ts) - 1970) * 365 + FLOOR((EXTRACT(YEAR FROM ts) - 1969) / 4) + EXTRACT(DOY FROM ts) - 1) * 86400
            + EXTRACT(HOUR FROM ts) * 3600 + EXTRACT(MINUTE FROM ts) * 60 + FLOOR(EXTRACT(SECOND FROM ts)) AS BIGINT) AS at_s,
       CAST((1 + k % 5) * 14400 AS BIGINT) AS ttl_s
FROM event_k
"""
INPUTS["talk"] = """
SELECT event_id AS seq, ts, user_id AS issue,
       CASE WHEN k % 31 = 0 THEN 'done' || chr(10) || '/finalize' WHEN k % 37 = 1 THEN '/hold' WHEN k % 5 = 2 THEN '<!-- BOT:PLAN_DRAFT issue=1 -->' ELSE 'words' END AS body
FROM event_k
"""
INPUTS["label_events"] = """
SELECT event_id AS seq, user_id AS issue,
       CASE k % 5 WHEN 0 THEN 'ops-bot' WHEN 1 THEN 'release-bot' ELSE 'dev' || CAST(k % 5 AS STRING) END AS actor,
       CASE WHEN event_type IN ('click', 'view') THEN 'labeled' ELSE 'unlabeled' END AS action,
       CASE k % 4 WHEN 0 THEN 'bot:queued' WHEN 1 THEN 'bot:fix' WHEN 2 THEN 'bug' ELSE 'bot:done' END AS label
FROM event_k
"""
# -- text ----------------------------------------------------------------------
INPUTS["code_lines"] = """
SELECT 'src/m' || CAST(user_id % 12 AS STRING) || '/f' || CAST(user_id AS STRING) || '.' ||
         CASE user_id % 4 WHEN 0 THEN 'py' WHEN 1 THEN 'ts' WHEN 2 THEN 'ex' ELSE 'rs' END AS file,
       CASE user_id % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 2 THEN 'elixir' ELSE 'rust' END AS lang,
       event_id + 1 AS line,
       CASE k % 29 WHEN 0 THEN 'api_key = "abcd' || CAST(event_id AS STRING) || '"' WHEN 1 THEN 'password: "Enter your password"'
            WHEN 2 THEN 'secret_key = os.environ["abcdefgh12"]' WHEN 3 THEN 'cursor.execute("select " + name)'
            WHEN 4 THEN 'x = pickle.loads(blob)' WHEN 5 THEN 'y = eval(expr)' WHEN 6 THEN 'z = yaml.load(f)'
            WHEN 7 THEN 'h = hashlib.md5(data)' WHEN 8 THEN 'logger.info("password %s", pw)' WHEN 9 THEN '# TODO tidy'
            WHEN 10 THEN '  except Exception as e:' WHEN 11 THEN '    pass' WHEN 12 THEN 'except:'
            WHEN 13 THEN '# increment the counter' WHEN 14 THEN 'increment the_counter' WHEN 15 THEN ''
            WHEN 16 THEN 'try { go() } catch (e) { }' WHEN 17 THEN 'catch { stop() }' WHEN 18 THEN '  rescue'
            WHEN 19 THEN '  _ -> :ok' WHEN 20 THEN 'rescue _ -> nil' WHEN 21 THEN 'let _ = send(x);'
            WHEN 22 THEN '# call(a, b);' WHEN 23 THEN '// if (x) { y = 1; }' WHEN 24 THEN 'except ValueError:'
            WHEN 25 THEN '# plain words here' WHEN 26 THEN 'console.log(secret)' WHEN 27 THEN '    ...' ELSE 'value = compute(' || CAST(k AS STRING) || ')' END AS text
FROM event_k
"""
INPUTS["dsl_docs"] = """
SELECT o_orderkey AS doc,
       '# header comment' || chr(10) || CASE WHEN o_orderkey % 19 = 0 THEN 'GIVEN stray step' || chr(10) ELSE '' END
       || '[SCENARIO: SC-' || CAST(o_orderkey AS STRING) || '] TITLE: Check The ' || o_orderstatus || ' TAGS: '
       || CASE o_orderkey % 5 WHEN 0 THEN 'integration strict_evidence' WHEN 1 THEN 'e2e' WHEN 2 THEN 'unit strict_interaction' WHEN 3 THEN 'strict_snapshot' ELSE 'strict_unique integration' END || chr(10)
       || 'GIVEN create_product product_id="P' || CAST(o_custkey % 9 AS STRING) || '"' || chr(10)
       || 'WHEN ' || CASE o_orderkey % 4 WHEN 0 THEN 'try_pay' WHEN 1 THEN 'broadcast_event sleep' WHEN 2 THEN 'submit_order first' ELSE 'pay index=1' END || ' amount=3' || chr(10)
       || CASE o_orderkey % 7 WHEN 0 THEN 'THEN assert_noop' WHEN 1 THEN 'THEN assert_http_snapshot name=a' WHEN 2 THEN 'THEN assert_order_state state=paid'
               WHEN 3 THEN 'THEN assert_mail_sent was called' WHEN 4 THEN 'THEN then_seed_contract_should_hold' WHEN 5 THEN 'THEN assert_eventually_done via Repo' ELSE '' END || chr(10)
       || chr(10) || '[SCENARIO: SC-' || CAST(o_orderkey % 400 AS STRING) || '-SEED-K' || CAST(o_custkey % 50 AS STRING) || '] TITLE: second' || chr(10)
       || 'WHEN submit_order' || chr(10) || 'THEN ' || CASE o_orderkey % 3 WHEN 0 THEN 'assert_noop' WHEN 1 THEN 'then_seed_contract_should_hold' ELSE 'assert_last_error code=x' END AS text
FROM orders
"""
INPUTS["instructions"] = """
SELECT 'assert_noop' AS name, 'then' AS kind, 'weak' AS assert_class, FALSE AS is_async, FALSE AS is_eventually, CAST(NULL AS STRING) AS boundary
UNION ALL SELECT 'assert_http_snapshot', 'then', 'B', FALSE, FALSE, 'http'
UNION ALL SELECT 'assert_order_state', 'then', 'A', FALSE, FALSE, 'domain'
UNION ALL SELECT 'assert_mail_sent', 'then', 'C', FALSE, FALSE, 'service'
UNION ALL SELECT 'assert_eventually_done', 'then', 'D', FALSE, TRUE, 'external_io'
UNION ALL SELECT 'assert_last_error', 'then', 'error', FALSE, FALSE, 'domain'
UNION ALL SELECT 'broadcast_event', 'when', CAST(NULL AS STRING), TRUE, FALSE, 'event'
UNION ALL SELECT 'submit_order', 'when', CAST(NULL AS STRING), FALSE, FALSE, 'http'
UNION ALL SELECT 'create_product', 'given', CAST(NULL AS STRING), FALSE, FALSE, 'domain'
"""
INPUTS["seed_contracts"] = """
SELECT DISTINCT 'K' || CAST(o_custkey % 50 AS STRING) AS contract_id,
       CASE o_custkey % 50 % 4 WHEN 0 THEN 'workflow_contract' WHEN 1 THEN 'determination_contract' WHEN 2 THEN 'reactor_contract' ELSE 'call_contract' END AS edge_class,
       CAST(o_custkey % 50 % 3 AS BIGINT) AS action_steps, CAST(o_custkey % 50 % 2 AS BIGINT) AS branch_hints, CAST(o_custkey % 50 % 5 AS BIGINT) AS facts
FROM orders
"""
INPUTS["md_docs"] = """
SELECT o_orderkey AS doc,
       'Intro ' || o_orderstatus || chr(10) || '```' || chr(10) || 'plain' || chr(10)
       || CASE WHEN o_orderkey % 3 = 0 THEN '```BDD  ' || chr(10) || 'step one' || chr(10) || '```dsl' || chr(10) || 'step two' || chr(10) || ' ``` ' || chr(10) ELSE '' END
       || CASE WHEN o_orderkey % 5 = 0 THEN '```bdd-dsl' || chr(10) || '```' || chr(10) ELSE '' END
       || CASE WHEN o_orderkey % 11 = 0 THEN 'text' || chr(10) || '```dsl' || chr(10) || 'open ended' ELSE 'end' END AS text
FROM orders
"""
INPUTS["section_docs"] = """
SELECT o_orderkey AS doc,
       'Top' || chr(10) || '## Role' || chr(10) || CASE WHEN o_orderkey % 3 = 0 THEN '  ' ELSE 'does things' END || chr(10)
       || CASE WHEN o_orderkey % 4 = 0 THEN '## Limits' || chr(10) || chr(10) || '## Flow' || chr(10) || 'a' ELSE '## Flow' || chr(10) || 'b ## Limits inline' END
       || CASE WHEN o_orderkey % 7 = 0 THEN chr(10) || '## Errors' ELSE '' END AS text
FROM orders
"""
INPUTS["conflict_docs"] = """
SELECT l_orderkey * 10 + l_linenumber AS doc,
       CASE l_partkey % 9 WHEN 0 THEN 'docs/readme.md' WHEN 1 THEN 'db/Migration_1.rb' WHEN 2 THEN 'pkg/a_test.go' WHEN 3 THEN 'src/lib.rs'
            WHEN 4 THEN 'lib/a.ex' WHEN 5 THEN 'pkg/main.go' WHEN 6 THEN 'q.sql' WHEN 7 THEN 'CHANGELOG.txt' ELSE 'web/app.ts' END AS path,
       'package a' || chr(10) || '<<<<<<< ours' || chr(10)
       || CASE l_suppkey % 6 WHEN 0 THEN 'import "fmt"' WHEN 1 THEN 'use a::b;' WHEN 2 THEN 'alias A.B' WHEN 3 THEN '// note' WHEN 4 THEN 'type X interface {' ELSE 'x = ' || CAST(l_quantity AS STRING) END || chr(10)
       || '=======' || chr(10)
       || CASE l_suppkey % 6 WHEN 0 THEN 'import "os"' WHEN 1 THEN 'use a::c;' WHEN 2 THEN 'import A' WHEN 3 THEN '// other  note' WHEN 4 THEN 'impl X' ELSE 'x = 2' END || chr(10)
       || '>>>>>>> theirs' || chr(10) || 'tail'
       || CASE WHEN l_linenumber % 3 = 0 THEN chr(10) || '<<<<<<< ours' || chr(10) || 'a' || chr(10) || '=======' || chr(10) || 'b' || chr(10) || '>>>>>>> theirs' ELSE '' END
       || CASE WHEN l_partkey % 37 = 0 THEN chr(10) || '<<<<<<< ours' || chr(10) || 'open' ELSE '' END AS text
FROM lineitem
"""
# Merge conflicts of every kind that the tier rules tell apart: many paths, hunk counts and sides.
INPUTS["tier_docs"] = """
SELECT DISTINCT l_orderkey * 10 + l_linenumber AS doc,
       CASE l_partkey % 13 WHEN 0 THEN 'docs/a.rb' WHEN 1 THEN '.github/w.cfg' WHEN 2 THEN 'a/READ.MD' WHEN 3 THEN 'b.mdx' WHEN 4 THEN 'db/Migration_1.rb' WHEN 5 THEN 'q.sql'
            WHEN 6 THEN 'src/lib.rs' WHEN 7 THEN 'lib/a.ex' WHEN 8 THEN 'lib/b.exs' WHEN 9 THEN 'pkg/main.go' WHEN 10 THEN 'conf/x.yml' WHEN 11 THEN 'web/app.ts' ELSE 'a/b.rs' END AS path,
       'head' || chr(10) || repeat('<<<<<<< ours' || chr(10)
       || CASE l_orderkey % 17 WHEN 0 THEN 'import "fmt"' WHEN 1 THEN '(' || chr(10) || '_ "os"' || chr(10) || ')' WHEN 2 THEN 'use a::b;' WHEN 3 THEN 'alias A.B' WHEN 4 THEN '// note'
               WHEN 5 THEN '# hash' WHEN 6 THEN '/* block' || chr(10) || ' more */ x = 1' WHEN 7 THEN '<!-- m -->' || chr(10) || 'x=1' WHEN 8 THEN 'type X interface {' WHEN 9 THEN 'a'
               WHEN 10 THEN 'impl X' WHEN 11 THEN 'a' WHEN 12 THEN ' unsafe { }' WHEN 13 THEN repeat('x = 1' || chr(10), 13) WHEN 14 THEN repeat('x = 1' || chr(10), 70) WHEN 15 THEN 'x = 1' ELSE '' END || chr(10)
       || '=======' || chr(10)
       || CASE l_orderkey % 17 WHEN 0 THEN 'import "os" // c' WHEN 1 THEN 'x "y"' WHEN 2 THEN 'use a::{c, d};' || chr(10) || '// n' WHEN 3 THEN 'import A' || chr(10) || chr(10) || ' use B' WHEN 4 THEN '// other  note'
               WHEN 5 THEN '' WHEN 6 THEN 'x   = 1' WHEN 7 THEN 'x =' || chr(10) || '1' WHEN 8 THEN 'b' WHEN 9 THEN 'var i interface{}'
               WHEN 10 THEN 'b' WHEN 11 THEN '  pub trait Y' WHEN 12 THEN 'macro_rules! m' WHEN 13 THEN 'b' WHEN 14 THEN repeat('y = 2' || chr(10), 60) WHEN 15 THEN 'x = 2' ELSE '' END || chr(10)
       || '>>>>>>> theirs' || chr(10), CAST(l_suppkey % 8 AS INT))
       || CASE WHEN l_linenumber = 2 THEN '<<<<<<< ours' || chr(10) || 'alias Z' || chr(10) || '=======' || chr(10) || '// z' || chr(10) || '>>>>>>> theirs' || chr(10) ELSE '' END
       || CASE WHEN l_partkey % 37 = 0 THEN '<<<<<<< ours' || chr(10) || 'open' ELSE '' END AS text
FROM lineitem
"""


def _words(sql: str) -> set[str]:
    return set(re.findall(r"[a-z_]+", sql))


def _sources(sql: str) -> set[str]:
    """Names an input reads from."""
    return set(re.findall(r"(?:FROM|JOIN) ([a-z_]+)", sql))


def needed(names: list[str]) -> list[str]:
    """The inputs behind ``names`` in definition order."""
    want = set()
    stack = [n for n in names if n in INPUTS]
    while stack:
        n = stack.pop()
        if n not in want:
            want.add(n)
            stack += [w for w in _sources(INPUTS[n]) if w in INPUTS]
    return [n for n in INPUTS if n in want]


def with_inputs(sql: str, extra: str = "") -> str:
    """``sql`` with the inputs it names put in front as common table expressions.

    ``extra`` holds further CTEs (``name AS (...)``, comma separated) of the check itself.
    """
    ctes = [f"{n} AS ({INPUTS[n]})" for n in needed(list(_words(sql + " " + extra)))]
    if extra:
        ctes.append(extra)
    return ("WITH RECURSIVE " + ", ".join(ctes) + " " if ctes else "") + sql


class Tables:
    """Loads given tables and logical inputs for one query run.

    The relation table is the one costly shared input; a run that uses it more
    than once works from one written copy instead of repeating its joins.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._relations: DataFrame | None = None

    def wide(self, name: str, rows: int | None = None) -> DataFrame:
        """A table or input for heavy per-row text work, spread over all cores.

        The given tables are single files with one row group, which one task would
        read. With at least as many input splits as cores this changes nothing. With ``rows`` no task gets many more rows
        than that: a split of narrow rows may stand for far more text than its size says.
        """
        return self(name, True, rows)

    def _table(self, name: str, spread: bool, rows: int | None = None) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        parts = self.spark.sparkContext.defaultParallelism if spread else 1
        if rows:
            parts = max(parts, -(-df.count() // rows))
        return df.repartition(parts) if spread and df.rdd.getNumPartitions() < parts else df

    def __call__(self, name: str, spread: bool = False, rows: int | None = None) -> DataFrame:
        if name in TABLES:
            return self._table(name, spread, rows)
        if name == "relations":
            return self.relations()
        names = needed([name])
        if "relations" in names:
            self.relations().createOrReplaceTempView("relations")
            names = [n for n in needed_without(name, "relations")]
        text = " ".join(INPUTS[n] for n in names)
        for table in TABLES:
            if table in _sources(text):
                self._table(table, spread, rows).createOrReplaceTempView(table)
        ctes = ", ".join(f"{n} AS ({INPUTS[n]})" for n in names if n != name)
        return self.spark.sql((f"WITH {ctes} " if ctes else "") + INPUTS[name])

    def relations(self) -> DataFrame:
        if self._relations is None:
            weights = relation_weights(self.wide("refs"), self("path_module"))
            self._relations = Scratch(self.spark, "relations").save(weights, "relations")
        return self._relations


def needed_without(name: str, stop: str) -> list[str]:
    """Inputs behind ``name`` that are not only reached through ``stop``."""
    want, stack = set(), [name]
    while stack:
        n = stack.pop()
        if n not in want and n != stop:
            want.add(n)
            stack += [w for w in _sources(INPUTS[n]) if w in INPUTS]
    return [n for n in INPUTS if n in want]
