"""Commit history, evidence, drift, conflicts and overlap over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgeloom.functions import text as X
from edgeloom.operators import drift as R
from edgeloom.operators import evidence as E
from edgeloom.operators import findings as D
from edgeloom.operators import history as H
from edgeloom.plans.registry import query
from edgeloom.session import Scratch
from edgeloom.plans.text_queries import MODULE_SQL
from edgeloom.sources import documents as S
from edgeloom.sources import records as J

# -- commits -----------------------------------------------------------------------
TAGS = ", ".join(
    f"CASE WHEN {' OR '.join(f'contains(lower(message), ' + chr(39) + w + chr(39) + ')' for w in words)} THEN '{tag}' END" for tag, words in X.TAG_RULES
)
INV = (
    "fp AS (SELECT DISTINCT path FROM changed_files),"
    + MODULE_SQL
    + f""",
per AS (SELECT hash, SUM(add + del)::BIGINT AS total_lines, arg_min(path, line_no) AS first_path,
  bool_or(ends_with(path, '.php') AND regexp_matches(lower(path), 'controller|model|trait|service|logic|provider')) AS backend FROM changed_files GROUP BY hash),
inv AS (SELECT c.hash, message, author, date, total_lines, CASE WHEN total_lines <= 10 THEN 'A' WHEN total_lines <= 50 THEN 'B' ELSE 'C' END AS grade, m.module,
  array_to_string(list_filter([{TAGS}], lambda x: x IS NOT NULL), ',') AS tags FROM commits c JOIN per p ON p.hash = c.hash AND p.backend JOIN mod_of m ON m.path = p.first_path)
"""
)


def inventory(t, grades=None):
    return H.inventory(t("commits"), t.wide("changed_files"), "php", grades)


query("commit_inventory", "SELECT * FROM inv", INV)(inventory)
query("commit_inventory_small", "SELECT * FROM inv WHERE grade IN ('A', 'B')", INV)(lambda t: inventory(t, ["A", "B"]))
query("commit_grades", "SELECT grade, COUNT(*) AS commits FROM inv GROUP BY grade", INV)(lambda t: H.grade_counts(inventory(t)))
query("newest_commits", "SELECT hash, date FROM inv ORDER BY date DESC, hash LIMIT 25", INV)(lambda t: H.newest(inventory(t), 25).select("hash", "date"))
query("ranked_commits", "SELECT hash, ROW_NUMBER() OVER (ORDER BY date DESC, hash) AS place FROM inv", INV)(lambda t: H.ranked(inventory(t).select("hash", "date")).select("hash", "place"))


def commit_log(t):
    """Raw log records as the log command prints them; a few hashes occur twice."""
    stat = t.wide("changed_files").groupBy("hash").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("line_no", "path", "add", "del"))),
                lambda r: F.concat_ws("\t", F.when(r["add"] == 7, "-").otherwise(r["add"].cast("string")), r["del"].cast("string"), r["path"]),
            ),
            "\n",
        ).alias("stat")
    )
    rows = t("commits").join(stat, "hash", "left")
    text = F.concat(
        F.col("hash"), F.lit("\n__MSG__"), "message", F.lit("\n__AUTHOR__"), "author", F.lit("\n__DATE__"), "date", F.lit(" 10:30:00 +0800\n\n"), F.coalesce("stat", F.lit("")), F.lit("\n")
    )
    log = rows.select(text.alias("value"), "ord")
    again = rows.filter("ord % 31 = 0").select(F.concat("hash", F.lit("\n__MSG__second copy\n__DATE__2030-01-01 x")).alias("value"), (F.col("ord") + 10**9).alias("ord"))
    return log.unionByName(again)


query(
    "parsed_commits",
    """SELECT c.hash, message, author, date, COALESCE(s.n, 0)::BIGINT AS total_lines, COALESCE(m.module, '') AS module FROM commits c
    LEFT JOIN (SELECT hash, SUM(CASE WHEN add = 7 THEN 0 ELSE add END + del) AS n, arg_min(path, line_no) AS p FROM changed_files GROUP BY hash) s ON s.hash = c.hash LEFT JOIN mod_of m ON m.path = s.p""",
    "fp AS (SELECT DISTINCT path FROM changed_files)," + MODULE_SQL,
)(lambda t: J.parse_commits(commit_log(t)).drop("files"))


def log_from_files(t):
    """The first copies of the log, written as log files and read back record by record."""
    folder = Scratch(t.spark, "log").root
    commit_log(t).filter("ord < 1000000000").select("value").write.option("lineSep", "__COMMIT__").text(folder)
    return J.read_commit_log(t.spark, folder)


query(
    "commit_log_files",
    """SELECT c.hash, c.message, c.author, c.date, COUNT(f.path) AS files, COALESCE(SUM(CASE WHEN f.add = 7 THEN 0 ELSE f.add END + f.del), 0)::BIGINT AS total_lines
    FROM commits c LEFT JOIN changed_files f ON f.hash = c.hash GROUP BY ALL""",
)(lambda t: J.parse_commits(log_from_files(t)).select("hash", "message", "author", "date", F.size("files").cast("bigint").alias("files"), "total_lines"))
query(
    "parsed_changed_files",
    """SELECT hash, path, CASE WHEN add = 7 THEN 0 ELSE add END AS add, del, CASE WHEN lower(path) LIKE '%controller%' THEN 'controller' WHEN lower(path) LIKE '%model%' THEN 'model' WHEN lower(path) LIKE '%trait%' THEN 'trait'
      WHEN lower(path) LIKE '%service%' THEN 'service' ELSE 'other' END AS kind FROM changed_files""",
)(lambda t: J.changed_files(J.parse_commits(commit_log(t))))
query(
    "commit_issue_numbers",
    """SELECT hash, array_to_string(list_filter(n, lambda x, i: i = 1 OR x <> n[i - 1]), ',') AS numbers FROM (SELECT hash, list_transform(regexp_extract_all(message, '#([0-9]+)', 1), lambda x: CAST(x AS BIGINT)) AS n FROM commits)""",
)(lambda t: t("commits").select("hash", F.array_join(X.commit_refs(F.col("message")), ",").alias("numbers")))
query(
    "commit_closing_refs",
    """SELECT hash, array_to_string(regexp_extract_all(message, '(?i)(?:closes|fixes|resolves)\\s*#([0-9]+)', 1), ',') AS numbers FROM commits""",
)(lambda t: t("commits").select("hash", F.array_join(X.closing_refs(F.col("message")), ",").alias("numbers")))
REFS = " UNION ALL ".join(
    f"SELECT id, unnest(regexp_extract_all(c, '{p}', 1)) AS n FROM cleaned" for p in X.REF_PATTERNS
)
query(
    "issue_references",
    "SELECT id, string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) AS refs FROM (SELECT DISTINCT id, CAST(n AS BIGINT) AS n FROM (" + REFS + ")) WHERE n > 0 GROUP BY id",
    f"cleaned AS (SELECT hash AS id, regexp_replace(message, '{X.PULL_REQUEST}', '', 'g') AS c FROM commits UNION ALL SELECT 'i' || CAST(issue AS STRING), regexp_replace(body, '{X.PULL_REQUEST}', '', 'g') FROM issues)",
)(
    lambda t: t("commits").select(F.col("hash").alias("id"), F.col("message").alias("x")).union(t("issues").select(F.concat(F.lit("i"), F.col("issue").cast("string")), "body"))
    .select("id", F.array_join(X.issue_refs(F.col("x")), ",").alias("refs")).filter("refs <> ''")
)
query(
    "commit_issue_links",
    """SELECT hash, CAST(NULLIF(regexp_extract(message, '#([0-9]+)', 1), '') AS BIGINT) AS issue, i.title FROM commits c LEFT JOIN issues i ON i.issue = CAST(NULLIF(regexp_extract(message, '#([0-9]+)', 1), '') AS BIGINT)""",
)(lambda t: H.link_issues(t("commits"), t("issues").select("issue", "title")).select("hash", "issue", "title"))
query(
    "merged_issue_texts",
    """SELECT doc_id AS number, 'd' || CAST(doc_id AS VARCHAR) || ' (PR #' || CAST(doc_id + 1 AS VARCHAR) || ')' AS title,
      CASE WHEN strlen(h1 || text || h2 || text || 'x') > 4000 THEN h1 || CASE WHEN length(text) <= 2000 THEN text ELSE substr(text, 1, 2000) || '...(truncated)' END || h2 || CASE WHEN length(text || 'x') <= 2000 THEN text || 'x' ELSE substr(text || 'x', 1, 2000) || '...(truncated)' END
      ELSE h1 || text || h2 || text || 'x' END AS body
    FROM (SELECT *, '## 原始需求' || chr(10) AS h1, chr(10) || chr(10) || '## 实现方案 (PR #' || CAST(doc_id + 1 AS VARCHAR) || ')' || chr(10) AS h2 FROM documents)""",
)(
    lambda t: H.merge_bodies(
        t("documents").select(F.col("doc_id").alias("number"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("title"), F.col("text").alias("body"), (F.col("doc_id") + 1).alias("pr"), F.concat("text", F.lit("x")).alias("pr_body"))
    )
)
SPECS = INV + """,
sp AS (SELECT CASE o_orderkey % 4 WHEN 0 THEN 'c' || CAST(o_orderkey AS STRING) || 'zz' ELSE 'c' || CAST(o_orderkey AS STRING) END AS hash, CASE WHEN o_orderkey % 3 = 0 THEN 'own' ELSE '' END AS module, o_orderkey % 10 = 1 AS skip FROM orders),
spm AS (SELECT s.hash, COALESCE(NULLIF(s.module, ''), i.module, j.module, 'unknown') AS module, s.skip FROM sp s LEFT JOIN inv i ON i.hash = s.hash LEFT JOIN (SELECT substr(hash, 1, 6) AS short, MIN(module) AS module FROM inv GROUP BY 1) j ON j.short = substr(s.hash, 1, 6))
"""


def specs(t):
    base = F.concat(F.lit("c"), F.col("o_orderkey").cast("string"))
    return t("orders").select(
        F.when(F.col("o_orderkey") % 4 == 0, F.concat(base, F.lit("zz"))).otherwise(base).alias("hash"), F.when(F.col("o_orderkey") % 3 == 0, "own").otherwise("").alias("module"), (F.col("o_orderkey") % 10 == 1).alias("skip")
    )


query("spec_modules", "SELECT * FROM spm", SPECS)(lambda t: H.spec_modules(specs(t), inventory(t)))
query("specs_per_module", "SELECT module, COUNT(*) FILTER (WHERE NOT skip) AS specs, COUNT(*) FILTER (WHERE skip) AS skipped FROM spm GROUP BY ROLLUP (module)", SPECS)(lambda t: H.specs_per_module(H.spec_modules(specs(t), inventory(t))))
query("stale_artifacts", "SELECT hash FROM sp WHERE hash NOT IN (SELECT hash FROM inv)", SPECS)(lambda t: H.stale(specs(t), inventory(t)).select("hash"))
DIFF = """
df AS (SELECT l_orderkey AS doc, 'diff --git a/x b/f' || CAST(l_orderkey % 3 AS VARCHAR) || chr(10) || '--- a/x' || chr(10) || '+++ b/x' || chr(10)
  || string_agg('@@ -1,2 +' || CAST(l_partkey AS VARCHAR) || ',3 @@ fn' || chr(10) || ' ctx' || chr(10) || '-old' || chr(10) || '+new' || CAST(l_suppkey AS VARCHAR) || chr(10) || '+more', chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey) AS text FROM lineitem GROUP BY l_orderkey),
ch AS (SELECT l_orderkey AS doc, 'f' || CAST(l_orderkey % 3 AS VARCHAR) AS file, l_partkey + 1 AS line_no FROM lineitem UNION ALL SELECT l_orderkey, 'f' || CAST(l_orderkey % 3 AS VARCHAR), l_partkey + 2 FROM lineitem)
"""


def diffs(t):
    # numbers are collected, text is put together behind the shuffle
    block = lambda r: F.concat(F.lit("@@ -1,2 +"), r["l_partkey"].cast("string"), F.lit(",3 @@ fn\n ctx\n-old\n+new"), r["l_suppkey"].cast("string"), F.lit("\n+more"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))), block), "\n")
    head = F.concat(F.lit("diff --git a/x b/f"), (F.col("doc") % 3).cast("string"), F.lit("\n--- a/x\n+++ b/x\n"))
    return t("lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(joined.alias("b")).select("doc", F.concat(head, "b").alias("text"))


query("diff_changed_lines", "SELECT * FROM ch", DIFF)(lambda t: S.changed_lines(diffs(t)))
query(
    "changed_functions",
    """SELECT c.doc, c.file, c.line_no, f.func, f.start_line FROM ch c JOIN fr f ON f.file = c.file AND c.line_no >= f.start_line AND c.line_no < f.start_line + f.length""",
    DIFF + ", fr AS (SELECT 'f' || CAST(p_partkey % 3 AS VARCHAR) AS file, 'fn' || CAST(p_partkey AS VARCHAR) AS func, p_partkey AS start_line, (p_size % 4)::BIGINT AS length FROM part)",
)(
    lambda t: D.lines_in_functions(
        S.changed_lines(diffs(t)),
        t("part").select(F.concat(F.lit("f"), (F.col("p_partkey") % 3).cast("string")).alias("file"), F.concat(F.lit("fn"), F.col("p_partkey").cast("string")).alias("func"), F.col("p_partkey").alias("start_line"), (F.col("p_size") % 4).cast("bigint").alias("length")),
    ).select("doc", "file", "line_no", "func", "start_line")
)

# -- evidence --------------------------------------------------------------------------
WEIGHTED = """
ok AS (SELECT *, CASE bond_type WHEN 'deduction' THEN 1.0 WHEN 'verification' THEN 0.7 WHEN 'exploration' THEN 0.3 ELSE 1.0 END::DOUBLE AS w FROM evidence WHERE confidence BETWEEN 0 AND 1),
red AS (SELECT conclusion_id, COUNT(*) FILTER (WHERE relation = 'supports') AS supports, COUNT(*) FILTER (WHERE relation = 'conflicts') AS conflicts,
  ROUND(least(greatest(CASE WHEN SUM(w) = 0 THEN 0.5 ELSE 0.5 + SUM(CASE relation WHEN 'supports' THEN confidence * w ELSE -confidence * w END) / (2 * SUM(w)) END, 0), 1), 9)::DOUBLE AS confidence FROM ok GROUP BY conclusion_id),
con AS (SELECT *, CASE WHEN supports > 0 AND conflicts > 0 THEN 'contested' WHEN confidence >= 0.7 THEN 'act' ELSE 'investigate' END AS verdict FROM red)
"""
query("evidence_conclusions", "SELECT * FROM con", WEIGHTED)(lambda t: E.ordered(E.reduce(t("evidence"))))
query(
    "ranked_conclusions",
    """SELECT conclusion_id, verdict, ROW_NUMBER() OVER (ORDER BY CASE verdict WHEN 'contested' THEN 0 WHEN 'investigate' THEN 1 ELSE 2 END, confidence, conclusion_id) AS place FROM con""",
    WEIGHTED,
)(lambda t: E.ranked(E.reduce(t("evidence"))).select("conclusion_id", "verdict", "place"))
query("evidence_rejected", "SELECT evidence_id, conclusion_id, confidence FROM evidence WHERE NOT (confidence BETWEEN 0 AND 1)")(lambda t: E.rejected(t("evidence")))
query("evidence_lists", "SELECT conclusion_id, relation, evidence_id FROM ok", WEIGHTED)(lambda t: E.evidence_lists(t("evidence")))
query(
    "verdict_counts",
    "SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE verdict = 'act') AS act_count, COUNT(*) FILTER (WHERE verdict = 'investigate') AS investigate_count, COUNT(*) FILTER (WHERE verdict = 'contested') AS contested_count FROM con",
    WEIGHTED,
)(lambda t: E.verdict_counts(E.reduce(t("evidence"))))
query(
    "evidence_conflicts",
    """SELECT o.conclusion_id, o.relation, o.evidence_id, COUNT(*) AS partners, MIN(p.evidence_id) AS first_partner FROM ok o JOIN ok p ON p.conclusion_id = o.conclusion_id AND p.relation <> o.relation GROUP BY o.conclusion_id, o.relation, o.evidence_id""",
    WEIGHTED,
)(lambda t: E.conflict_pairs(t("evidence")))
BAYES = WEIGHTED + """,
sq AS (SELECT conclusion_id, ROW_NUMBER() OVER (PARTITION BY conclusion_id ORDER BY seq) AS i,
  CASE relation WHEN 'supports' THEN least(greatest(0.5 + least(greatest(confidence * w, 0), 1) / 2, 0.01), 0.99) ELSE least(greatest(0.5 - least(greatest(confidence * w, 0), 1) / 2, 0.01), 0.99) END::DOUBLE AS l FROM ok),
fold AS (SELECT DISTINCT conclusion_id, 0::BIGINT AS i, 0.5::DOUBLE AS p FROM sq
  UNION ALL SELECT f.conclusion_id, s.i, q * l / (q * l + (1 - q) * (1 - l)) FROM (SELECT *, least(greatest(p, 0.01), 0.99) AS q FROM fold) f JOIN sq s ON s.conclusion_id = f.conclusion_id AND s.i = f.i + 1)
"""
query(
    "evidence_posterior",
    """SELECT conclusion_id, ROUND(p, 6) AS posterior, i AS evidence_count, CASE WHEN ROUND(p, 9) >= 0.7 THEN 'act' ELSE 'investigate' END AS verdict FROM fold QUALIFY ROW_NUMBER() OVER (PARTITION BY conclusion_id ORDER BY i DESC) = 1""",
    BAYES,
)(lambda t: E.posterior(t("evidence")).withColumn("posterior", F.round("posterior", 6)))

# -- plans and dependencies ----------------------------------------------------------------
PLAN = """
pl AS (SELECT l_suppkey AS plan, CASE l_partkey % 6 WHEN 0 THEN './src/' WHEN 1 THEN 'src//' WHEN 2 THEN '../' ELSE 'src/' END || 'f' || CAST(l_partkey % 40 AS VARCHAR) AS path FROM lineitem WHERE l_returnflag = 'N'),
ac AS (SELECT l_suppkey + 1 AS plan, 'src/./f' || CAST(l_partkey % 50 AS VARCHAR) AS path FROM lineitem WHERE l_returnflag <> 'N'),
plc AS (SELECT DISTINCT plan, 'src/f' || split_part(path, 'f', -1) AS path FROM pl WHERE NOT contains(path, '..')),
acc AS (SELECT DISTINCT plan, 'src/f' || split_part(path, 'f', -1) AS path FROM ac WHERE plan IN (SELECT plan FROM pl))
"""


def plan_files(t):
    k, n = F.col("l_partkey") % 6, F.col("l_partkey")
    head = F.when(k == 0, "./src/").when(k == 1, "src//").when(k == 2, "../").otherwise("src/")
    pl = t("lineitem").filter("l_returnflag = 'N'").select(F.col("l_suppkey").alias("plan"), F.concat(head, F.lit("f"), (n % 40).cast("string")).alias("path"))
    ac = t("lineitem").filter("l_returnflag <> 'N'").select((F.col("l_suppkey") + 1).alias("plan"), F.concat(F.lit("src/./f"), (n % 50).cast("string")).alias("path"))
    return pl, ac


query(
    "plan_drift",
    "SELECT plan, path, 'extra' AS drift FROM (SELECT * FROM acc EXCEPT SELECT * FROM plc) UNION ALL SELECT plan, path, 'missing' FROM (SELECT * FROM plc EXCEPT SELECT * FROM acc)",
    PLAN,
)(lambda t: R.plan_drift(*plan_files(t), "plan"))
DEPS = """
ed AS (SELECT o_orderkey AS issue, o_custkey AS dep FROM orders WHERE o_orderkey > 0 AND o_custkey > 0 AND o_orderkey <> o_custkey AND o_orderstatus <> 'P'),
cd AS (SELECT o_orderkey AS issue, o_custkey + o_orderkey % 2 AS dep FROM orders WHERE o_orderkey > 0 AND o_custkey + o_orderkey % 2 > 0 AND o_orderkey <> o_custkey + o_orderkey % 2 AND o_orderstatus <> 'F'),
dd AS (SELECT *, 'add' AS change FROM (SELECT * FROM ed EXCEPT SELECT * FROM cd) UNION ALL SELECT *, 'remove' FROM (SELECT * FROM cd EXCEPT SELECT * FROM ed))
"""


def dep_diff(t):
    o = t("orders")
    e = o.filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("issue"), F.col("o_custkey").alias("dep"))
    c = o.filter("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("issue"), (F.col("o_custkey") + F.col("o_orderkey") % 2).alias("dep"))
    return R.dependency_diff(e, c)


query("dependency_diff", "SELECT * FROM dd", DEPS)(dep_diff)
query("dependency_diff_totals", "SELECT COUNT(*) FILTER (WHERE change = 'add') AS adds, COUNT(*) FILTER (WHERE change = 'remove') AS removes FROM dd", DEPS)(lambda t: R.diff_totals(dep_diff(t)))
HEXSUM = ", ".join(f"CAST(COALESCE(SUM(('0x' || substr(h, {1 + 12 * i}, 12))::BIGINT), 0) AS VARCHAR)" for i in range(5))
query(
    "dag_fingerprint",
    f"SELECT COUNT(*) AS edges, sha256(concat_ws(',', CAST(COUNT(*) AS VARCHAR), {HEXSUM})) AS fingerprint FROM (SELECT sha256(CAST(src AS VARCHAR) || '->' || CAST(dst AS VARCHAR)) AS h FROM (SELECT DISTINCT src, dst FROM dag_edges))",
)(lambda t: R.fingerprint(t("dag_edges"), ["src", "dst"]))
TE = """
ti AS (SELECT p_partkey AS task_id, CASE WHEN p_size % 6 = 0 THEN 0 ELSE p_partkey + 5 END AS issue FROM part),
te AS (SELECT a.issue AS from_issue, b.issue AS to_issue, COALESCE(a.issue, 0) <= 0 OR COALESCE(b.issue, 0) <= 0 AS skipped FROM dag_edges e JOIN ti b ON b.task_id = e.src JOIN ti a ON a.task_id = e.dst)
"""


def issue_edges(t):
    tasks = t("part").select(F.col("p_partkey").alias("task_id"), F.when(F.col("p_size") % 6 == 0, 0).otherwise(F.col("p_partkey") + 5).alias("issue"))
    return R.task_edges(tasks, t("dag_edges").toDF("task_id", "dep"))


query("issue_edges", "SELECT CASE WHEN from_issue > 0 THEN from_issue END AS from_issue, CASE WHEN to_issue > 0 THEN to_issue END AS to_issue, skipped FROM te", TE)(issue_edges)
query(
    "skipped_edge_ratio",
    "SELECT COUNT(*) AS total_edges, COUNT(*) FILTER (WHERE skipped) AS skipped_edges, ROUND(COUNT(*) FILTER (WHERE skipped) / COUNT(*), 6) AS ratio, COUNT(*) FILTER (WHERE skipped) / COUNT(*) > 0.1 AS exceeded FROM te",
    TE,
)(lambda t: R.skipped_ratio(issue_edges(t), 0.1))

# -- manifests ---------------------------------------------------------------------------


def manifest(t, new: bool):
    """One contract per part; the current side drops, adds and retypes by part attributes."""
    s, k = F.col("p_size"), F.col("p_partkey")
    m = lambda **kv: F.map_filter(F.map_from_arrays(F.array(*[F.lit(x) for x in kv]), F.array(*kv.values())), lambda _, v: v.isNotNull())
    old = not new
    part = t("part").filter(s > 2 if new else s < 50)
    none = F.lit(None).cast("string")
    fields = m(
        id=F.lit("int!"), name=F.lit("string?") if old else F.when(s % 5 == 0, "string!").otherwise("string?"),
        state=F.lit("enum[a|b|c]") if old else F.when(s % 7 == 0, "enum[a|c|d]").otherwise("enum[a|b|c]"), gone=F.lit("int") if old else F.when(s % 3 == 0, none).otherwise("int"), extra=none if old else F.when(s % 4 == 0, "int"),
    )
    inp = m(q=F.lit("int?") if old else F.when(s % 6 == 0, "int!").otherwise("int?"), more=none if old else F.when(s % 8 == 0, "int!").otherwise("int?"))
    act = F.struct(
        F.when(F.lit(old) | (s % 9 != 0), "list").otherwise("browse").alias("action_key"),
        (F.lit("query") if old else F.when(s % 11 == 0, "mutation").otherwise("query")).alias("kind"), inp.alias("input"), m(rows=F.lit("int")).alias("output"),
    )
    return part.select(
        F.concat(F.lit("k"), k.cast("string")).alias("contract_key"), (F.lit("type") if old else F.when(s % 13 == 0, "input").otherwise("type")).alias("kind"), fields.alias("fields"), F.array(act).alias("actions")
    )


MAN = """
mb AS (SELECT 'k' || CAST(p_partkey AS VARCHAR) AS c, p_size AS s FROM part WHERE p_size > 2 AND p_size < 50),
md AS (
 SELECT 'BREAKING:contract_removed:k' || CAST(p_partkey AS VARCHAR) AS id, 'BREAKING' AS category FROM part WHERE p_size <= 2
 UNION ALL SELECT 'SAFE:contract_added:k' || CAST(p_partkey AS VARCHAR), 'SAFE' FROM part WHERE p_size >= 50
 UNION ALL SELECT 'BREAKING:contract_graphql_kind_changed:' || c, 'BREAKING' FROM mb WHERE s % 13 = 0
 UNION ALL SELECT 'BREAKING:field_non_null:' || c || '.fields.name', 'BREAKING' FROM mb WHERE s % 5 = 0
 UNION ALL SELECT 'BREAKING:type_changed:' || c || '.fields.state', 'BREAKING' FROM mb WHERE s % 7 = 0
 UNION ALL SELECT 'DANGEROUS:enum_value_removed:' || c || '.fields.state:b', 'DANGEROUS' FROM mb WHERE s % 7 = 0
 UNION ALL SELECT 'BREAKING:field_removed:' || c || '.fields.gone', 'BREAKING' FROM mb WHERE s % 3 = 0
 UNION ALL SELECT 'SAFE:field_added:' || c || '.fields.extra', 'SAFE' FROM mb WHERE s % 4 = 0
 UNION ALL SELECT 'BREAKING:action_removed:' || c || ':list', 'BREAKING' FROM mb WHERE s % 9 = 0
 UNION ALL SELECT 'SAFE:action_added:' || c || ':browse', 'SAFE' FROM mb WHERE s % 9 = 0
 UNION ALL SELECT 'BREAKING:action_graphql_kind_changed:' || c || ':list', 'BREAKING' FROM mb WHERE s % 9 <> 0 AND s % 11 = 0
 UNION ALL SELECT 'DANGEROUS:input_required:' || c || '.list.input.q', 'DANGEROUS' FROM mb WHERE s % 9 <> 0 AND s % 6 = 0
 UNION ALL SELECT CASE WHEN s % 8 = 0 THEN 'DANGEROUS:required_argument_added:' ELSE 'SAFE:field_added:' END || c || '.list.input.more', CASE WHEN s % 8 = 0 THEN 'DANGEROUS' ELSE 'SAFE' END FROM mb WHERE s % 9 <> 0)
"""


def drifted(t):
    return R.manifest_diff(manifest(t, False), manifest(t, True))


query("manifest_drift", "SELECT * FROM md", MAN)(drifted)
GATED = MAN + """,
wl AS (SELECT 'BREAKING:field_removed:k' || CAST(p_partkey AS VARCHAR) || '.fields.gone' AS id, 1000000 + (p_partkey % 30 - 10) * 86400 AS expires_at FROM part WHERE p_brand <> 'Brand#2'),
gt AS (SELECT md.id, category, CASE WHEN expires_at IS NULL THEN 'unwhitelisted' WHEN expires_at < 1000000 THEN 'expired_whitelist' WHEN expires_at <= 1000000 + 7 * 86400 THEN 'expiring' ELSE 'whitelisted' END AS status
  FROM md LEFT JOIN wl ON wl.id = md.id WHERE category <> 'SAFE')
"""


def gated(t):
    wl = t("part").filter("p_brand <> 'Brand#2'").select(
        F.concat(F.lit("BREAKING:field_removed:k"), F.col("p_partkey").cast("string"), F.lit(".fields.gone")).alias("id"), (F.lit(1000000) + (F.col("p_partkey") % 30 - 10) * 86400).alias("expires_at")
    )
    return R.whitelist_gate(drifted(t), wl, F.lit(1000000))


query("manifest_gate", "SELECT * FROM gt", GATED)(gated)
query(
    "manifest_gate_result",
    """SELECT COUNT(*) FILTER (WHERE status IN ('unwhitelisted', 'expired_whitelist')) AS violations, COUNT(*) FILTER (WHERE status = 'expiring') AS warnings,
      COUNT(*) FILTER (WHERE status = 'expired_whitelist' OR (status = 'unwhitelisted' AND category = 'BREAKING')) = 0 AS strict_passed, TRUE AS warn_passed FROM gt""",
    GATED,
)(lambda t: R.gate_result(gated(t)))

# -- conflicts and overlap -----------------------------------------------------------------
CONF = r"""
hk AS (SELECT doc, path, regexp_extract_all(text, '(?ms)^<<<<<<<[^\n]*\n(.*?)^=======[^\n]*\n(.*?)^>>>>>>>', 1) AS ours, regexp_extract_all(text, '(?ms)^<<<<<<<[^\n]*\n(.*?)^=======[^\n]*\n(.*?)^>>>>>>>', 2) AS theirs,
  regexp_matches(regexp_replace(text, '(?ms)^<<<<<<<[^\n]*\n(.*?)^=======[^\n]*\n(.*?)^>>>>>>>', '', 'g'), '(?m)^<<<<<<<') AS bad FROM conflict_docs),
hn AS (SELECT doc, path, len(ours)::INT AS n, trim(ours[1], chr(10)) AS o, trim(theirs[1], chr(10)) AS h, lower(path) AS p FROM hk WHERE NOT bad)
"""


def hunked(t):
    return R.conflict_hunks(t.wide("conflict_docs"))


query("conflict_hunks", "SELECT doc, path, n AS hunks FROM hn", CONF)(lambda t: R.conflict_counts(hunked(t)))
query("conflict_errors", "SELECT doc, path, 'unclosed_conflict' AS error FROM hk WHERE bad", CONF)(lambda t: R.conflict_errors(hunked(t)))
query("conflict_total", "SELECT COUNT(*) AS files, SUM(n)::BIGINT AS hunks FROM hn", CONF)(lambda t: R.conflict_total(R.conflict_counts(hunked(t))))
query(
    "conflict_tiers",
    """SELECT doc, path, CASE WHEN starts_with(path, 'docs/') OR ends_with(p, '.md') THEN 'auto'
      WHEN n = 1 AND starts_with(o, '// note') THEN 'auto'
      WHEN contains(p, 'migration') OR ends_with(p, '.sql') THEN 'human'
      WHEN ends_with(p, '.rs') AND starts_with(h, 'impl ') THEN 'human'
      WHEN NOT ends_with(p, '.rs') AND starts_with(o, 'type X interface') THEN 'human' ELSE 'assist' END AS tier FROM hn""",
    CONF,
)(lambda t: R.conflict_tiers(hunked(t)))
FILLED = "list_filter(list_transform(string_split({x}, chr(10)), lambda v: trim(v)), lambda v: v <> '')"
BARE = (
    "regexp_replace(array_to_string(list_filter(" + FILLED.format(x=r"regexp_replace({x}, '(?ms)^\s*/\*.*?(\*/|\z)', '', 'g')")
    + ", lambda v: NOT (starts_with(v, '//') OR starts_with(v, '*/') OR starts_with(v, '<!--') OR starts_with(v, '-->') OR (hashed AND starts_with(v, '#')))), ''), '\\s+', '', 'g')"
)
# one row per side of a hunk, then per hunk, then per file
TIERS = CONF.replace("conflict_docs", "tier_docs").replace("SELECT doc, path, regexp", "SELECT doc, path, text, regexp") + r""",
sd AS (SELECT doc, path, text, i, side, p, regexp_matches(p, '\.(md|markdown|yml|yaml|toml|sh|py|ini|conf|txt|gitignore)$') AS hashed, ends_with(p, '.rs') AS rust, x
  FROM (SELECT doc, path, text, p, unnest(range(1, n + 1)) AS i, ours, theirs FROM (SELECT *, lower(path) AS p, len(ours) AS n FROM hk WHERE NOT bad)), LATERAL (SELECT 'o' AS side, ours[i] AS x UNION ALL SELECT 't', theirs[i])),
fl AS (SELECT *, """ + FILLED.format(x="x") + " AS f, " + BARE.format(x="x") + r""" AS bare FROM sd),
hs AS (SELECT doc, path, text, i, COUNT(DISTINCT bare) = 1 AS same, SUM(len(f)) AS lines, MAX(len(f)) <= 12 AS small,
  bool_or(CASE WHEN rust THEN len(list_filter(f, lambda v: regexp_matches(v, '^(trait |pub trait |impl |impl<|unsafe |macro_rules!)'))) > 0
    ELSE len(list_filter(f, lambda v: (contains(lower(v), 'type ') AND contains(lower(v), ' interface')) OR contains(lower(v), 'interface{'))) > 0 END) AS core,
  bool_and(len(list_filter(f, lambda v: regexp_matches(v, '^(import\s+)?(([A-Za-z_][A-Za-z0-9_]*|\.)\s+)?"\S*"\s*(//.*)?$'))) > 0
    AND len(list_filter(f, lambda v: NOT regexp_matches(v, '^(import\s+)?(([A-Za-z_][A-Za-z0-9_]*|\.)\s+)?"\S*"\s*(//.*)?$') AND NOT regexp_matches(v, '^(\(|\)|//.*)$'))) = 0) AS imports,
  bool_and(rust AND len(list_filter(f, lambda v: regexp_matches(v, '^use\s+[\w:]+(::\{\s*[\w\s,]+\s*\})?\s*;\s*$'))) > 0
    AND len(list_filter(f, lambda v: NOT regexp_matches(v, '^use\s+[\w:]+(::\{\s*[\w\s,]+\s*\})?\s*;\s*$') AND NOT starts_with(v, '//'))) = 0) AS uses,
  bool_and(len(f) > 0 AND len(list_filter(f, lambda v: NOT regexp_matches(v, '^(alias|import|use) '))) = 0) AS light
  FROM fl GROUP BY doc, path, text, i),
fs AS (SELECT doc, path, text, COUNT(*) AS n, bool_and(same) AS same, SUM(lines) AS lines, bool_and(small) AS small, bool_or(core) AS core, bool_and(imports) AS imports, bool_and(uses) AS uses, bool_and(light) AS light FROM hs GROUP BY doc, path, text)
"""
query(
    "conflict_tier_rules",
    """SELECT k.doc, k.path, CASE WHEN n IS NULL THEN 'human'
      WHEN starts_with(k.path, 'docs/') OR starts_with(k.path, '.github/') OR ends_with(lower(k.path), '.md') OR ends_with(lower(k.path), '.mdx') THEN
        CASE WHEN n <= 3 THEN 'auto' WHEN core OR n > 6 OR lines > 120 THEN 'human' WHEN imports OR (n <= 2 AND small) THEN 'assist' ELSE 'human' END
      WHEN same THEN 'auto'
      WHEN contains(lower(k.path), 'migration') OR ends_with(lower(k.path), '.sql') OR n > 6 OR core OR lines > 120 THEN 'human'
      WHEN imports OR uses OR (regexp_matches(lower(k.path), '[.]exs?$') AND n <= 3 AND small AND light) OR (n <= 2 AND small) THEN 'assist' ELSE 'human' END AS tier
    FROM hk k LEFT JOIN fs ON fs.doc = k.doc AND fs.path = k.path AND fs.text = k.text WHERE NOT k.bad""",
    TIERS,
)(lambda t: R.conflict_tiers(R.conflict_hunks(t.wide("tier_docs"))))
query(
    "conflict_profiles",
    """SELECT DISTINCT CASE WHEN path LIKE '%.go' THEN 'go' WHEN path LIKE '%.ex' THEN 'elixir' WHEN path LIKE '%.rs' THEN 'rust' END AS profile, path FROM part_paths""",
)(lambda t: R.profile_files(t("part_paths")))
query("conflict_profiles_included", "SELECT DISTINCT CASE WHEN path LIKE '%.go' THEN 'go' ELSE 'rust' END AS profile, path FROM part_paths WHERE path LIKE '%.go' OR path LIKE '%.rs'")(
    lambda t: R.profile_files(t("part_paths"), include=["go", "rust"])
)
query("conflict_profiles_excluded", "SELECT DISTINCT CASE WHEN path LIKE '%.ex' THEN 'elixir' ELSE 'rust' END AS profile, path FROM part_paths WHERE path LIKE '%.ex' OR path LIKE '%.rs'")(
    lambda t: R.profile_files(t("part_paths"), exclude=["go"])
)
OVER = """
ov AS (SELECT DISTINCT o_orderpriority || '/' || o_orderstatus AS target, o_custkey AS issue, l_suppkey AS path FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
cand AS (SELECT target, MIN(issue) AS issue FROM ov GROUP BY target), sz AS (SELECT target, issue, COUNT(*) AS n FROM ov GROUP BY target, issue)
"""


def overlap(t):
    f = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("target"), F.col("o_custkey").alias("issue"), F.col("l_suppkey").alias("path"))
    return R.overlap(f, f.groupBy("target").agg(F.min("issue").alias("issue")))


query(
    "file_overlap",
    """SELECT target, candidate, issue, shared, ROUND(ratio, 6) AS ratio, CASE WHEN ROUND(ratio, 6) >= 0.3 THEN 'serialise' WHEN ROUND(ratio, 6) > 0.1 THEN 'caution' ELSE 'parallel' END AS advice FROM
      (SELECT c.target, c.issue AS candidate, b.issue, COUNT(*) AS shared, COUNT(*)::DOUBLE / least(MIN(s.n), MIN(r.n)) AS ratio FROM cand c JOIN ov a ON a.target = c.target AND a.issue = c.issue
       JOIN ov b ON b.target = a.target AND b.path = a.path AND b.issue <> a.issue JOIN sz s ON s.target = b.target AND s.issue = b.issue JOIN sz r ON r.target = a.target AND r.issue = a.issue GROUP BY c.target, c.issue, b.issue)""",
    OVER,
)(overlap)
