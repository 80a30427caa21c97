"""Relations, contracts, gates, layers, flows and the health score over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgeloom.functions import paths as P
from edgeloom.operators import contracts as C
from edgeloom.operators import dag, relations as R, score as S
from edgeloom.plans.registry import query


def rel(t):
    return t("relations")


def limits(t):
    return t("gates").withColumnRenamed("limit_value", "limit")


def target(t):
    return C.evaluate("target", rel(t), t("allow"), t("forbid"))


def transition(t):
    return C.evaluate(
        "transition", rel(t), C.edge_set(t("allow"), t("temporary_allow")), C.edge_set(t("forbid"), t("blocked"))
    )


query("relation_weights", "SELECT * FROM relations")(lambda t: R.relation_weights(t.wide("refs"), t("path_module")))

CLASSED = """
marks AS (SELECT caller, callee, MAX(a) AS a, MAX(f) AS f FROM
  (SELECT caller, callee, 1 AS a, 0 AS f FROM allow UNION ALL SELECT caller, callee, 0, 1 FROM forbid) GROUP BY caller, callee),
classed AS (SELECT r.*, CASE WHEN f = 1 THEN 'forbidden' WHEN a = 1 THEN 'matched' ELSE 'unexpected' END AS class
  FROM relations r LEFT JOIN marks m ON r.caller = m.caller AND r.callee = m.callee)
"""
EVAL = """
SELECT '{name}' AS name, (SELECT COUNT(*) FROM {al}) AS allow_count, (SELECT COUNT(*) FROM {fo}) AS forbid_count,
 COUNT(*) FILTER (WHERE NOT f AND a) AS matched_edges_count,
 CAST(COALESCE(SUM(total_edges) FILTER (WHERE NOT f AND a), 0) AS BIGINT) AS matched_total_edges,
 COUNT(*) FILTER (WHERE NOT f AND NOT a) AS unexpected_edges_count,
 CAST(COALESCE(SUM(total_edges) FILTER (WHERE NOT f AND NOT a), 0) AS BIGINT) AS unexpected_total_edges,
 COUNT(*) FILTER (WHERE f) AS forbidden_edges_count,
 CAST(COALESCE(SUM(total_edges) FILTER (WHERE f), 0) AS BIGINT) AS forbidden_total_edges,
 (SELECT COUNT(*) FROM {al} x WHERE NOT EXISTS (SELECT 1 FROM relations r WHERE r.caller = x.caller AND r.callee = x.callee)) AS missing_edges_count
FROM (SELECT total_edges, EXISTS (SELECT 1 FROM {al} y WHERE y.caller = r.caller AND y.callee = r.callee) AS a,
             EXISTS (SELECT 1 FROM {fo} y WHERE y.caller = r.caller AND y.callee = r.callee) AS f FROM relations r)
"""
TRANSITION_SETS = """
t_allow AS (SELECT caller, callee FROM allow UNION SELECT caller, callee FROM temporary_allow),
t_forbid AS (SELECT caller, callee FROM forbid UNION SELECT caller, callee FROM blocked)
"""
EVAL_T = EVAL.format(name="target", al="allow", fo="forbid")
EVAL_X = EVAL.format(name="transition", al="t_allow", fo="t_forbid")
STRUCTURE = """
SELECT m AS modules_count, m * (m - 1) AS directed_edges_possible, e AS directed_edges_actual,
 CASE WHEN m * (m - 1) = 0 THEN 0.0 ELSE ROUND(e * 100.0 / (m * (m - 1)), 2) END::DOUBLE AS directed_density_pct,
 w AS total_module_edge_weight, b AS bidirectional_pair_count
FROM (SELECT COUNT(DISTINCT m) AS m FROM (SELECT caller AS m FROM relations UNION ALL SELECT callee FROM relations)),
 (SELECT COUNT(*) AS e, CAST(COALESCE(SUM(total_edges), 0) AS BIGINT) AS w FROM relations),
 (SELECT COUNT(*) AS b FROM relations x JOIN relations y ON x.caller = y.callee AND x.callee = y.caller AND x.caller < x.callee)
"""

query("edge_classes", "SELECT * FROM classed", CLASSED)(lambda t: C.edge_classes(rel(t), t("allow"), t("forbid")))
query(
    "missing_edges",
    "SELECT caller, callee FROM allow a WHERE NOT EXISTS (SELECT 1 FROM relations r WHERE r.caller = a.caller AND r.callee = a.callee)",
)(lambda t: C.missing_edges(rel(t), t("allow")))
query("scenario_target", EVAL_T)(target)
query("scenario_transition", EVAL_X, TRANSITION_SETS)(transition)
query("structure_stats", STRUCTURE)(lambda t: C.structure(rel(t)))
query(
    "bidirectional_pairs",
    """SELECT x.caller AS a, x.callee AS b, x.total_edges AS ab, y.total_edges AS ba, x.total_edges + y.total_edges AS total
    FROM relations x JOIN relations y ON x.caller = y.callee AND x.callee = y.caller AND x.caller < x.callee""",
)(lambda t: C.bidirectional_pairs(rel(t)))
query(
    "top_bidirectional_pairs",
    """SELECT x.caller AS a, x.callee AS b, x.total_edges AS ab, y.total_edges AS ba, x.total_edges + y.total_edges AS total
    FROM relations x JOIN relations y ON x.caller = y.callee AND x.callee = y.caller AND x.caller < x.callee
    ORDER BY total DESC, a, b LIMIT 10""",
)(lambda t: C.top_pairs(rel(t)))

GATE_CTES = (
    TRANSITION_SETS
    + f", scen AS (SELECT * FROM ({EVAL_T}) UNION ALL SELECT * FROM ({EVAL_X})), struct_row AS ({STRUCTURE})"
    + """, long AS (
 SELECT name AS profile, 'unexpected_edges_count' AS metric, unexpected_edges_count::DOUBLE AS actual FROM scen
 UNION ALL SELECT name, 'forbidden_edges_count', forbidden_edges_count FROM scen
 UNION ALL SELECT name, 'forbidden_total_edges', forbidden_total_edges FROM scen
 UNION ALL SELECT name, 'missing_edges_count', missing_edges_count FROM scen
 UNION ALL SELECT name, 'directed_density_pct', directed_density_pct FROM scen, struct_row
 UNION ALL SELECT name, 'bidirectional_pair_count', bidirectional_pair_count FROM scen, struct_row),
gate AS (SELECT l.profile, l.metric, actual, limit_value::BIGINT AS "limit", actual <= limit_value AS pass
  FROM long l JOIN gates g ON l.profile = g.profile AND l.metric = g.metric)"""
)


def gates(t):
    return C.gate_rows(target(t).unionByName(transition(t)), C.structure(rel(t)), limits(t))


query("gate_rows", "SELECT * FROM gate", GATE_CTES)(gates)
query(
    "gate_verdicts",
    "SELECT profile, bool_and(pass) AS pass, COUNT(*) FILTER (WHERE NOT pass) AS failed FROM gate GROUP BY profile",
    GATE_CTES,
)(lambda t: C.gate_verdicts(gates(t)))
query(
    "top_edges_by_class",
    """SELECT class, caller, callee, total_edges, rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY class ORDER BY total_edges DESC, caller, callee)::INT AS rank
    FROM classed WHERE class <> 'matched') WHERE rank <= 20""",
    CLASSED,
)(lambda t: C.top_by_class(C.edge_classes(rel(t), t("allow"), t("forbid"))))
query(
    "remediation_rows",
    "SELECT CASE class WHEN 'forbidden' THEN 'blocked' ELSE 'temporary_allow' END AS remedy, caller, callee, total_edges FROM classed WHERE class <> 'matched'",
    CLASSED,
)(lambda t: C.remediation(C.edge_classes(rel(t), t("allow"), t("forbid"))))
query(
    "contract_sets",
    """SELECT 'allow' AS side, caller, callee FROM t_allow UNION ALL SELECT 'forbid', caller, callee FROM t_forbid""",
    TRANSITION_SETS,
)(
    lambda t: C.edge_set(t("allow"), t("temporary_allow")).select(F.lit("allow").alias("side"), "*")
    .unionByName(C.edge_set(t("forbid"), t("blocked")).select(F.lit("forbid").alias("side"), "*"))
)
query(
    "derived_contracts",
    """SELECT caller, callee, CASE WHEN allowed THEN 'allow' ELSE 'forbid' END AS contract FROM expected
    UNION ALL SELECT caller, callee, 'blocked' FROM expected WHERE NOT allowed
    UNION ALL SELECT caller, callee, 'temporary_allow' FROM relations r
      WHERE NOT EXISTS (SELECT 1 FROM expected e WHERE e.caller = r.caller AND e.callee = r.callee)""",
)(lambda t: C.derive_contracts(rel(t), t("expected")))
query("default_contracts", "SELECT caller, callee, 'allow' AS contract FROM relations")(
    lambda t: C.derive_contracts(rel(t), None)
)
query(
    "inherited_contracts",
    """SELECT r.caller, r.callee, CASE
      WHEN own.allowed IS NOT NULL THEN CASE WHEN own.allowed THEN 'allow' ELSE 'forbid' END
      WHEN COALESCE(e1.allowed, e2.allowed, e3.allowed) IS NOT NULL THEN
        CASE WHEN COALESCE(e1.allowed, TRUE) AND COALESCE(e2.allowed, TRUE) AND COALESCE(e3.allowed, TRUE) THEN 'inherited_allow' ELSE 'inherited_forbid' END
      WHEN p.parent = q.parent THEN 'sibling_allow' ELSE 'undeclared' END AS contract
    FROM relations r LEFT JOIN modules p ON r.caller = p.module_id LEFT JOIN modules q ON r.callee = q.module_id
    LEFT JOIN flags own ON own.caller = r.caller AND own.callee = r.callee
    LEFT JOIN flags e1 ON e1.caller = p.parent AND e1.callee = r.callee
    LEFT JOIN flags e2 ON e2.caller = r.caller AND e2.callee = q.parent
    LEFT JOIN flags e3 ON e3.caller = p.parent AND e3.callee = q.parent""",
    "flags AS (SELECT caller, callee, bool_and(allowed) AS allowed FROM region_expected GROUP BY caller, callee)",
)(lambda t: C.inherited_classes(rel(t), t("region_expected"), t("modules")))
query(
    "inheritance_counts",
    """SELECT caller, callee, allowed,
      (1 + (SELECT COUNT(*) FROM modules m WHERE m.parent = e.caller)) * (1 + (SELECT COUNT(*) FROM modules m WHERE m.parent = e.callee)) AS edges
    FROM region_expected e""",
)(lambda t: C.expansion_counts(t("region_expected"), t("modules")))

LAYERED = """
layered AS (SELECT m.module_id AS module, COALESCE(m.layer, p.layer) AS layer FROM modules m LEFT JOIN modules p ON m.parent = p.module_id),
lrank AS (SELECT 'L0' AS layer, 1 AS precedence UNION ALL SELECT 'L1', 2 UNION ALL SELECT 'L2', 3),
lforbid AS (SELECT 'L0' AS from_layer, 'L2' AS to_layer), lallow AS (SELECT 'L2' AS from_layer, 'L0' AS to_layer),
lchecked AS (SELECT r.caller, r.callee, r.total_edges, a.layer AS from_layer, b.layer AS to_layer,
  CASE WHEN a.layer IS NULL OR b.layer IS NULL THEN 'skipped' WHEN a.layer = b.layer THEN 'ok'
       WHEN EXISTS (SELECT 1 FROM lforbid f WHERE f.from_layer = a.layer AND f.to_layer = b.layer) THEN 'violation'
       WHEN EXISTS (SELECT 1 FROM lallow f WHERE f.from_layer = a.layer AND f.to_layer = b.layer) THEN 'ok'
       WHEN x.precedence IS NULL OR y.precedence IS NULL THEN 'ok' WHEN x.precedence < y.precedence THEN 'ok' ELSE 'violation' END AS verdict
  FROM relations r LEFT JOIN layered a ON r.caller = a.module LEFT JOIN layered b ON r.callee = b.module
  LEFT JOIN lrank x ON x.layer = a.layer LEFT JOIN lrank y ON y.layer = b.layer)
"""


def layered(t):
    tree = t("modules").select(F.col("module_id").alias("node"), "parent", "layer")
    return dag.inherit(tree, "layer").toDF("module", "layer")


def layer_check(t):
    spark = t("nation").sparkSession
    pair = "from_layer string, to_layer string"
    return C.layer_violations(
        rel(t),
        layered(t),
        spark.createDataFrame([("L0", "L2")], pair),
        spark.createDataFrame([("L2", "L0")], pair),
        spark.createDataFrame([("L0", 1), ("L1", 2), ("L2", 3)], "layer string, precedence int"),
    )


query("layer_violations", "SELECT * FROM lchecked", LAYERED)(layer_check)

LAYER_RULES = [("util", "misc/*/brand_1"), ("api", "src/api")]
LAYER_CASE = """CASE WHEN regexp_matches(path, 'misc/.*/brand_1') THEN 'util' WHEN regexp_matches(path, 'src/api') THEN 'api'
 WHEN contains(lower(path), 'controller') OR contains(lower(path), 'api') THEN 'api'
 WHEN contains(lower(path), 'service') OR contains(lower(path), 'biz') THEN 'service'
 WHEN contains(lower(path), 'dao') OR contains(lower(path), 'repository') OR contains(lower(path), 'model') THEN 'dao'
 WHEN contains(lower(path), 'util') OR contains(lower(path), 'helper') THEN 'util' ELSE '' END"""
query("layer_of_path", f"SELECT id, {LAYER_CASE} AS layer FROM part_paths")(
    lambda t: t("part_paths").select("id", P.layer_by_rules(F.col("path"), LAYER_RULES).alias("layer"))
)
CALL_LAYERS = f"""
pl AS (SELECT id, {LAYER_CASE} AS layer FROM part_paths),
cl AS (SELECT e.src, e.dst, a.layer AS from_layer, b.layer AS to_layer,
  CASE WHEN a.layer = '' OR b.layer = '' OR a.layer = b.layer OR (a.layer = 'dao' AND b.layer = 'service') THEN NULL
       WHEN a.layer = 'api' AND b.layer = 'dao' THEN 'skip_layer'
       WHEN list_position(['api', 'service', 'dao', 'util'], a.layer) > list_position(['api', 'service', 'dao', 'util'], b.layer) AND b.layer <> 'util' THEN 'reverse_dep' END AS violation
  FROM dag_edges e JOIN pl a ON a.id = e.src JOIN pl b ON b.id = e.dst WHERE a.layer <> '')
"""


def call_layers(t):
    nodes = t("part_paths").select("id", P.layer_by_rules(F.col("path"), LAYER_RULES).alias("layer"))
    return C.call_layer_violations(t("dag_edges"), nodes, [("dao", "service")])


query("call_layer_violations", "SELECT * FROM cl WHERE violation IS NOT NULL", CALL_LAYERS)(
    lambda t: call_layers(t).filter("violation IS NOT NULL")
)
query(
    "call_layer_stats",
    "SELECT (SELECT COUNT(*) FROM pl) AS total_functions, COUNT(*) AS checked_deps, COUNT(violation) AS violations FROM cl",
    CALL_LAYERS,
)(
    lambda t: call_layers(t).agg(F.count("*").alias("checked_deps"), F.count("violation").alias("violations")).withColumn("k", F.lit(1))
    .join(t("part_paths").agg(F.count("*").alias("total_functions")).withColumn("k", F.lit(1)), "k")
    .select("total_functions", "checked_deps", "violations")
)

# -- flows, boundaries, events --------------------------------------------------
FLOW_SQL = """
hop AS (SELECT caller, MIN(callee) AS callee FROM relations WHERE total_edges % 2 = 0 GROUP BY caller),
fsteps AS (
  SELECT 'flow_' || h.caller AS flow, 0 AS step, h.caller AS caller, h.callee AS callee, 'a,b' AS outs, '' AS ins FROM hop h
  UNION ALL SELECT 'flow_' || h.caller, 1, h.callee, g.callee, 'b', 'a,x' FROM hop h JOIN hop g ON g.caller = h.callee
  UNION ALL SELECT 'flow_' || h.caller, 2, g.callee, 'GHOST', '', 'b,c' FROM hop h JOIN hop g ON g.caller = h.callee)
"""


def flows(t):
    r = rel(t).filter("total_edges % 2 = 0").groupBy("caller").agg(F.min("callee").alias("callee"))
    h, g = r.toDF("c0", "c1"), r.toDF("c1", "c2")
    m = lambda *ks: F.create_map(*[F.lit(x) for k in ks for x in (k, "string")]) if ks else F.expr("cast(map() as map<string,string>)")
    step = lambda a, b, i, o: F.struct(F.col(a).alias("from") if a != "GHOST" else F.lit(a).alias("from"), (F.lit(b) if b == "GHOST" else F.col(b)).alias("to"), m(*i).alias("input"), m(*o).alias("output"))
    return h.join(g, "c1", "left").select(
        F.concat(F.lit("flow_"), F.col("c0")).alias("name"),
        F.when(
            F.col("c2").isNotNull(),
            F.array(step("c0", "c1", (), ("a", "b")), step("c1", "c2", ("a", "x"), ("b",)), step("c2", "GHOST", ("b", "c"), ())),
        ).otherwise(F.array(step("c0", "c1", (), ("a", "b")))).alias("steps"),
    )


query(
    "flow_missing_edges",
    "SELECT flow, step, caller, callee FROM fsteps f WHERE NOT EXISTS (SELECT 1 FROM relations r WHERE r.caller = f.caller AND r.callee = f.callee)",
    FLOW_SQL,
)(lambda t: C.flow_missing(flows(t), rel(t)))
query(
    "flow_shortcuts",
    """SELECT a.flow, r.caller, r.callee, a.pos::INT AS i, b.pos::INT AS j,
      (SELECT string_agg(node, ',' ORDER BY pos) FROM fnodes n WHERE n.flow = a.flow AND n.pos > a.pos AND n.pos < b.pos) AS bypassed
    FROM fnodes a JOIN fnodes b ON a.flow = b.flow AND b.pos >= a.pos + 2 JOIN relations r ON r.caller = a.node AND r.callee = b.node""",
    FLOW_SQL + ", fnodes AS (SELECT flow, 0 AS pos, caller AS node FROM fsteps WHERE step = 0 UNION ALL SELECT flow, step + 1, callee FROM fsteps)",
)(lambda t: C.flow_shortcuts(flows(t), rel(t)))
query(
    "flow_field_gaps",
    """SELECT a.flow, a.step, f.field FROM fsteps a JOIN fsteps b ON a.flow = b.flow AND b.step = a.step + 1,
      LATERAL (SELECT unnest(string_split(b.ins, ',')) AS field) f
    WHERE a.outs <> '' AND b.ins <> '' AND NOT list_contains(string_split(a.outs, ','), f.field)""",
    FLOW_SQL,
)(lambda t: C.flow_continuity(flows(t)))

BOUND_SQL = "bounds AS (SELECT n_name AS module_id, n_nationkey AS k FROM nation UNION ALL SELECT 'NOWHERE', 99)"


def boundaries(t):
    return t("nation").select(
        F.col("n_name").alias("module_id"),
        F.array(F.concat(F.lit("supp/*"), (F.col("n_nationkey") % 10).cast("string"), F.lit(".ts")), F.lit("public/**")).alias("public_paths"),
    )


query(
    "boundary_leaks",
    """SELECT b.module_id, COUNT(*) AS total_refs,
      COUNT(*) FILTER (WHERE NOT regexp_matches(r.dst_path, '^supp/[^/]*' || CAST(b.k % 10 AS VARCHAR) || '\\.ts$')) AS leaked_refs
    FROM refs r JOIN path_module a ON r.src_path = a.path JOIN path_module c ON r.dst_path = c.path JOIN bounds b ON b.module_id = c.module
    WHERE a.module <> c.module GROUP BY b.module_id""",
    BOUND_SQL,
)(lambda t: C.boundary_leaks(t("refs"), t("path_module"), boundaries(t)))

EV_SQL = """
ev AS (SELECT 'ev_' || n_name AS event, n_name AS producer, 'NATION_' || CAST((n_nationkey * 3 + 1) % 30 AS VARCHAR) AS consumer,
  n_nationkey % 5 = 0 AS orphan FROM nation)
"""


def event_decls(t):
    other = F.concat(F.lit("NATION_"), ((F.col("n_nationkey") * 3 + 1) % 30).cast("string"))
    return t("nation").select(
        F.concat(F.lit("ev_"), F.col("n_name")).alias("name"),
        F.array("n_name").alias("producers"),
        F.when(F.col("n_nationkey") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(other)).alias("consumers"),
        F.create_map(F.lit("id"), F.lit("int")).alias("payload"),
    )


query(
    "event_contract_findings",
    """SELECT event, 'orphan' AS finding, NULL::VARCHAR AS producer, NULL::VARCHAR AS consumer FROM ev WHERE orphan
    UNION ALL SELECT event, 'ghost_consumer', NULL, consumer FROM ev WHERE NOT orphan AND consumer NOT IN (SELECT module_id FROM modules)
    UNION ALL SELECT event, 'missing_edge', producer, consumer FROM ev WHERE NOT orphan AND NOT EXISTS (SELECT 1 FROM relations r WHERE r.caller = producer AND r.callee = consumer)
    UNION ALL SELECT event, 'reverse_edge', producer, consumer FROM ev WHERE NOT orphan AND EXISTS (SELECT 1 FROM relations r WHERE r.callee = producer AND r.caller = consumer)""",
    EV_SQL,
)(lambda t: C.event_findings(event_decls(t), t("modules"), rel(t)))


LINK_SQL = """
ep AS (SELECT DISTINCT 'part_' || CAST(l_partkey AS VARCHAR) AS event, n_name AS producer FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey),
ec AS (SELECT DISTINCT 'part_' || CAST(l_partkey AS VARCHAR) AS event, n_name AS consumer FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
lr AS (SELECT DISTINCT caller, callee FROM relations WHERE (length(caller) * 2 + length(callee)) % 3 <> 0)
"""


def part_events(t):
    """One event per part: nations that supply it produce, nations that order it consume."""
    lines, nation = t("lineitem"), t("nation").select("n_nationkey", "n_name")
    name = F.concat(F.lit("part_"), F.col("l_partkey").cast("string")).alias("name")
    of = lambda rows, key, side: rows.join(nation, F.col(key) == F.col("n_nationkey")).groupBy(name).agg(F.collect_set("n_name").alias(side))
    made = of(lines.join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")), "s_nationkey", "producers")
    ordered = lines.join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return made.join(of(ordered, "c_nationkey", "consumers"), "name")


query(
    "event_links",
    """SELECT c.event, c.consumer, COUNT(*) AS producers, COUNT(r.caller) AS linked, COUNT(*) - COUNT(r.caller) AS missing, COUNT(b.caller) AS reversed
    FROM ec c JOIN ep p ON p.event = c.event LEFT JOIN lr r ON r.caller = p.producer AND r.callee = c.consumer LEFT JOIN lr b ON b.callee = p.producer AND b.caller = c.consumer
    GROUP BY c.event, c.consumer""",
    LINK_SQL,
)(lambda t: C.event_links(part_events(t), rel(t).filter((F.length("caller") * 2 + F.length("callee")) % 3 != 0)))


def decl_contracts(t):
    kind = F.element_at(F.array(*[F.lit(x) for x in ("crud", "query", "command")]), F.col("n_nationkey") % 3 + 1)
    return t("nation").select(F.col("n_name").alias("module_id"), F.lit("main").alias("name"), kind.alias("kind"))


query(
    "contract_complexity",
    """SELECT n_name AS module_id, 'main' AS contract, CASE WHEN n_nationkey % 3 = 0 THEN 'crud'
      WHEN NOT inf AND NOT ine AND oute <= 1 THEN CASE n_nationkey % 3 WHEN 1 THEN 'crud' ELSE 'simple_command' END
      WHEN inf THEN 'flow_participant' WHEN ine THEN 'event_participant' WHEN oute >= 2 THEN 'complex_orchestration' ELSE 'simple_command' END AS complexity
    FROM (SELECT *, EXISTS (SELECT 1 FROM fsteps f WHERE f.caller = n_name OR f.callee = n_name) AS inf,
      EXISTS (SELECT 1 FROM ev e WHERE e.producer = n_name OR (e.consumer = n_name AND NOT orphan)) AS ine,
      (SELECT COUNT(*) FROM expected x WHERE x.caller = n_name AND x.allowed) AS oute FROM nation)""",
    FLOW_SQL + "," + EV_SQL,
)(lambda t: C.contract_complexity(decl_contracts(t), flows(t), event_decls(t), t("expected")))


def bound_contracts(t):
    names = lambda *ks: F.create_map(*[F.lit(x) for k in ks for x in (k, "int")])
    return t("nation").select(
        F.col("n_name").alias("module_id"),
        F.array(F.struct(F.lit("main").alias("name"), names("q", "id").alias("input"), names("rows").alias("output"))).alias("contracts"),
    )


query(
    "contract_source_rows",
    """SELECT 'flow' AS source, flow AS owner, caller || '->' || callee AS item, CASE step WHEN 0 THEN 'a,b' WHEN 1 THEN 'a,b,x' ELSE 'b,c' END AS fields FROM fsteps
    UNION ALL SELECT 'boundary', n_name, 'main', 'id,q,rows' FROM nation
    UNION ALL SELECT 'event', event, consumer, 'id' FROM ev WHERE NOT orphan""",
    FLOW_SQL + "," + EV_SQL,
)(lambda t: C.contract_sources(flows(t), bound_contracts(t), event_decls(t)))

# -- edge detail -----------------------------------------------------------------
query(
    "edge_severity",
    """SELECT caller, callee, SUM(n)::BIGINT AS total_edges, ROUND(SUM(c)::DOUBLE / SUM(n), 4) AS call_ratio, COUNT(DISTINCT src_path) AS src_file_count,
      COUNT(DISTINCT dst_path) AS dst_file_count,
      ROUND(MAX(sn) * 100.0 / SUM(n), 2)::DOUBLE AS top_src_share_pct, ROUND(MAX(dn) * 100.0 / SUM(n), 2)::DOUBLE AS top_dst_share_pct,
      arg_min(src_path, (-sn, src_path)) AS top_src, arg_min(dst_path, (-dn, dst_path)) AS top_dst
    FROM (SELECT *, SUM(n) OVER (PARTITION BY caller, callee, src_path) AS sn, SUM(n) OVER (PARTITION BY caller, callee, dst_path) AS dn
      FROM (SELECT a.module AS caller, b.module AS callee, src_path, dst_path, COUNT(*) AS n, COUNT(*) FILTER (WHERE kind = 'call') AS c
        FROM refs JOIN path_module a ON src_path = a.path JOIN path_module b ON dst_path = b.path WHERE a.module <> b.module GROUP BY ALL))
    GROUP BY caller, callee""",
)(lambda t: R.edge_severity(t.wide("refs"), t("path_module")))

HINTS = """
hints AS (SELECT c.n_name AS caller, s.n_name AS callee,
  CASE CAST(l_quantity AS BIGINT) % 4 WHEN 0 THEN ' Framework ' WHEN 1 THEN 'external_lib' ELSE CASE WHEN (c.n_nationkey + s.n_nationkey) % 3 = 0 THEN 'direct' ELSE 'framework' END END AS call_type_hint,
  'via_' || l_returnflag AS via, l_discount * ((c.n_nationkey + s.n_nationkey) % 11) AS confidence, 'det_' || CAST(l_linenumber AS VARCHAR) AS detector, 'r_' || l_linestatus AS reason
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation c ON c_nationkey = c.n_nationkey JOIN nation s ON s_nationkey = s.n_nationkey
  WHERE c.n_nationkey <> s.n_nationkey),
h2 AS (SELECT caller, callee, CASE trim(lower(call_type_hint)) WHEN 'framework' THEN 'framework_injection' WHEN 'external_lib' THEN 'external_registration' ELSE 'direct_call' END AS call_type,
  via, least(greatest(confidence, 0), 1) AS confidence, detector, reason FROM hints),
h3 AS (SELECT *, CASE call_type WHEN 'external_registration' THEN 3 WHEN 'framework_injection' THEN 2 ELSE 1 END AS p FROM h2),
best AS (SELECT caller, callee, arg_max(struct_pack(ct := call_type, v := via, c := confidence, d := detector, r := reason), (p, confidence, length(via), length(detector), via, detector, reason)) AS b
  FROM h3 WHERE call_type = 'direct_call' OR confidence >= 0.75 GROUP BY caller, callee),
weak AS (SELECT caller, callee, arg_max(confidence, (p, confidence)) AS c FROM h3 WHERE call_type <> 'direct_call' GROUP BY caller, callee)
"""


def hints(t):
    n = t("nation").select("n_nationkey", "n_name")
    quarter, ends = F.col("l_quantity").cast("int") % 4, F.col("c_nationkey") + F.col("s_nationkey")
    # orders meet customers first: lineitem, the large table, is shuffled for one join only
    buyers = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    return (
        t("lineitem").join(buyers, F.col("l_orderkey") == F.col("o_orderkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .filter("c_nationkey <> s_nationkey")
        .join(n.toDF("c_nationkey", "caller"), "c_nationkey").join(n.toDF("s_nationkey", "callee"), "s_nationkey")
        .select(
            "caller", "callee",
            F.when(quarter == 0, " Framework ").when(quarter == 1, "external_lib").when(ends % 3 == 0, "direct").otherwise("framework").alias("call_type_hint"),
            F.concat(F.lit("via_"), "l_returnflag").alias("via"), (F.col("l_discount") * (ends % 11)).alias("confidence"),
            F.concat(F.lit("det_"), F.col("l_linenumber").cast("string")).alias("detector"), F.concat(F.lit("r_"), "l_linestatus").alias("reason"),
        )
    )


query(
    "edge_classification",
    """SELECT r.caller, r.callee, COALESCE(b.ct, 'direct_call') AS call_type, COALESCE(b.v, '') AS via, COALESCE(b.c, 1.0)::DOUBLE AS confidence,
      CASE WHEN b IS NULL THEN 'fallback' ELSE 'ast_hint' END AS source, COALESCE(b.d, '') AS detector,
      COALESCE(b.r, CASE WHEN w.c IS NOT NULL THEN printf('hint confidence %.2f below threshold 0.75', w.c) ELSE 'no relation hint' END) AS reason
    FROM relations r LEFT JOIN best ON best.caller = r.caller AND best.callee = r.callee LEFT JOIN weak w ON w.caller = r.caller AND w.callee = r.callee""",
    HINTS,
)(lambda t: R.classify_edges(rel(t), hints(t)))

# -- score -----------------------------------------------------------------------
QUALITY = "SELECT CASE WHEN k = 7 THEN 'critical' WHEN k % 40 = 1 THEN 'error' WHEN k % 30 = 2 THEN 'warning' ELSE 'info' END AS severity FROM event_k"
DIMS = (
    LAYERED
    + f", scen AS ({EVAL_T}), st AS ({STRUCTURE}), cov AS (SELECT (SELECT COUNT(*) FROM labels)::DOUBLE / COUNT(*) AS bdd, "
    + "(SELECT COUNT(*) FILTER (WHERE module_id IN (SELECT caller FROM allow UNION SELECT callee FROM allow))::DOUBLE / COUNT(*) FROM modules) AS contract FROM documents), "
    + """dims AS (
 SELECT 'compliance' AS dimension, 0.30::DOUBLE AS weight, CASE WHEN tot > 0 THEN least(m / tot * 100, 100) ELSE 100 END::DOUBLE AS score, u = 0 AND f = 0 AS passed, TRUE AS blocking
   FROM (SELECT matched_edges_count AS m, unexpected_edges_count AS u, forbidden_edges_count AS f, matched_edges_count + unexpected_edges_count * 1.5::DOUBLE + forbidden_edges_count * 2.0::DOUBLE AS tot FROM scen)
 UNION ALL SELECT 'density', 0.25, CASE WHEN d BETWEEN 10 AND 40 THEN 100 WHEN d < 10 THEN 60 + d / 10 * 40 WHEN d < 75 THEN 100 - (d - 40) / 35 * 100 ELSE 0 END, d <= 75, TRUE FROM (SELECT directed_density_pct AS d FROM st)
 UNION ALL SELECT 'layering', 0.25, CASE WHEN n > 0 THEN (n - b)::DOUBLE / n * 100 ELSE 100 END, b = 0, TRUE FROM (SELECT COUNT(*) FILTER (WHERE verdict <> 'skipped') AS n, COUNT(*) FILTER (WHERE verdict = 'violation') AS b FROM lchecked)
 UNION ALL SELECT 'acyclic', 0.10, 100 - least(bidirectional_pair_count * 10.0, 100), bidirectional_pair_count <= 0, TRUE FROM st
 UNION ALL SELECT 'coverage', 0.10, (bdd * 0.4 + contract * 0.6) * 100, bdd >= 0.6 AND contract >= 0.6, FALSE FROM cov
 UNION ALL SELECT 'code_quality', 0.10, greatest(100.0 - c * 20 - e * 10 - w * 2, 0), greatest(100.0 - c * 20 - e * 10 - w * 2, 0) >= 60 AND c = 0, TRUE
   FROM (SELECT COUNT(*) FILTER (WHERE severity = 'critical') AS c, COUNT(*) FILTER (WHERE severity = 'error') AS e, COUNT(*) FILTER (WHERE severity = 'warning') AS w FROM (""" + QUALITY + """)))
"""
)


def findings_of_events(t):
    k = F.col("k")
    return t("event_k").select(
        F.when(k == 7, "critical").when(k % 40 == 1, "error").when(k % 30 == 2, "warning").otherwise("info").alias("severity")
    )


def coverage_ratios(t):
    one = lambda df: df.withColumn("k", F.lit(1))
    return (
        one(t("labels").agg(F.count("*").alias("n"))).join(one(t("documents").agg(F.count("*").alias("d"))), "k")
        .join(one(S.contract_ratio(t("modules"), t("allow"))), "k").select((F.col("n") / F.col("d")).alias("bdd"), "contract")
    )


def score_dims(t):
    st = C.structure(rel(t))
    return S.dimensions(
        S.compliance(target(t)), S.density(st), S.layering(layer_check(t)), S.acyclic(st), S.coverage(coverage_ratios(t)),
        S.code_quality(findings_of_events(t)),
    )


query("score_dimensions", "SELECT dimension, weight, ROUND(score, 6) AS score, passed, blocking FROM dims", DIMS)(
    lambda t: score_dims(t).withColumn("score", F.round("score", 6))
)
query(
    "score_total",
    """SELECT mode, ROUND(raw, 6) AS raw, ROUND(total, 6) AS total,
      CASE WHEN total >= 90 THEN 'A' WHEN total >= 80 THEN 'B' WHEN total >= 70 THEN 'C' WHEN total >= 60 THEN 'D' ELSE 'F' END AS grade, bad AS blocking_failures,
      CASE mode WHEN 'strict' THEN bad = 0 AND total >= 60 WHEN 'lenient' THEN total >= 60 ELSE TRUE END AS passed
    FROM (SELECT mode, raw, bad, CASE mode WHEN 'strict' THEN CASE WHEN bad > 0 THEN 0 ELSE raw END WHEN 'lenient' THEN greatest(raw - bad * 20, 0) ELSE raw END AS total
      FROM (SELECT SUM(score * weight) / SUM(weight) AS raw, COUNT(*) FILTER (WHERE blocking AND NOT passed) AS bad FROM dims), (SELECT unnest(['strict', 'lenient', 'warning']) AS mode))""",
    DIMS,
)(lambda t: S.total(score_dims(t)).withColumns({"raw": F.round("raw", 6), "total": F.round("total", 6)}))

ISSUES = CLASSED + """, issues_of AS (
 SELECT 'compliance' AS dimension, CASE class WHEN 'forbidden' THEN 'critical' ELSE 'error' END AS severity, caller || '->' || callee AS location FROM classed WHERE class <> 'matched'
 UNION ALL SELECT 'acyclic', 'warning', x.caller || '<->' || x.callee FROM relations x JOIN relations y ON x.caller = y.callee AND x.callee = y.caller AND x.caller < x.callee)
"""


def score_issues(t):
    c = C.edge_classes(rel(t), t("allow"), t("forbid")).filter("class <> 'matched'")
    a = c.select(F.lit("compliance").alias("dimension"), F.when(F.col("class") == "forbidden", "critical").otherwise("error").alias("severity"), F.concat_ws("->", "caller", "callee").alias("location"))
    b = C.bidirectional_pairs(rel(t)).select(F.lit("acyclic").alias("dimension"), F.lit("warning").alias("severity"), F.concat_ws("<->", "a", "b").alias("location"))
    return a.unionByName(b)


query(
    "score_issue_summary",
    """SELECT COUNT(*) AS total_issues, COUNT(*) FILTER (WHERE severity = 'critical') AS critical_issues, COUNT(*) FILTER (WHERE severity = 'error') AS error_issues,
      COUNT(*) FILTER (WHERE severity = 'warning') AS warning_issues, COUNT(*) FILTER (WHERE severity = 'info') AS info_issues FROM issues_of""",
    ISSUES,
)(lambda t: S.issue_summary(score_issues(t)))
query(
    "score_recommendations",
    """SELECT d.dimension, ROUND(d.score, 6) AS score, CASE WHEN blocking AND d.score < 60 THEN 'high' WHEN d.score < 60 THEN 'medium' ELSE 'low' END AS priority, location, rank
    FROM (SELECT * FROM dims WHERE dimension IN (SELECT dimension FROM issues_of) ORDER BY CASE WHEN blocking THEN 1000 ELSE 0 END - score DESC, dimension LIMIT 5) d
    JOIN (SELECT dimension, location, ROW_NUMBER() OVER (PARTITION BY dimension ORDER BY location)::INT AS rank FROM issues_of) i ON i.dimension = d.dimension AND i.rank <= 5""",
    DIMS + "," + ISSUES,
)(lambda t: S.recommendations(score_dims(t), score_issues(t)).withColumn("score", F.round("score", 6)))


def versions(t):
    v1 = S.dimensions(S.compliance(target(t)), S.density(C.structure(rel(t)))).select(F.lit("v1").alias("version"), "dimension", "score")
    v2 = S.dimensions(S.compliance(transition(t)), S.density(C.structure(rel(t)))).select(F.lit("v2").alias("version"), "dimension", "score")
    return v1.unionByName(v2)


query(
    "score_compare",
    f"""SELECT 'compliance' AS dimension, (SELECT ROUND(m / (m + u * 1.5 + f * 2.0) * 100, 6) FROM e1)::DOUBLE AS v1, (SELECT ROUND(m / (m + u * 1.5 + f * 2.0) * 100, 6) FROM e2)::DOUBLE AS v2
    UNION ALL SELECT 'density', d, d FROM (SELECT ROUND(CASE WHEN d BETWEEN 10 AND 40 THEN 100 WHEN d < 10 THEN 60 + d / 10 * 40 WHEN d < 75 THEN 100 - (d - 40) / 35 * 100 ELSE 0 END, 6)::DOUBLE AS d FROM (SELECT directed_density_pct AS d FROM ({STRUCTURE})))""",
    TRANSITION_SETS
    + f", e1 AS (SELECT matched_edges_count::DOUBLE AS m, unexpected_edges_count AS u, forbidden_edges_count AS f FROM ({EVAL_T}))"
    + f", e2 AS (SELECT matched_edges_count::DOUBLE AS m, unexpected_edges_count AS u, forbidden_edges_count AS f FROM ({EVAL_X}))",
)(lambda t: S.compare(versions(t), ["v1", "v2"]).select("dimension", F.round("v1", 6).alias("v1"), F.round("v2", 6).alias("v2")))


def verdict(t):
    v = C.gate_verdicts(gates(t)).groupBy().agg(
        F.bool_and(F.when(F.col("profile") == "target", F.col("pass"))).alias("target_gate"),
        F.bool_and(F.when(F.col("profile") == "transition", F.col("pass"))).alias("transition_gate"),
    ).withColumn("k", F.lit(1))
    e = target(t).select(F.col("forbidden_edges_count").alias("forbidden"), F.lit(1).alias("k"))
    lv = layer_check(t).agg(F.count_if(F.col("verdict") == "violation").alias("layer")).withColumn("k", F.lit(1))
    fn = C.event_findings(event_decls(t), t("modules"), rel(t)).agg(F.count("*").alias("findings")).withColumn("k", F.lit(1))
    row = v.join(e, "k").join(lv, "k").join(fn, "k")
    args = [F.col(c) for c in ("target_gate", "transition_gate", "forbidden", "layer", "findings")]
    return row.select(*[C.verdict_code(m, *args).alias(f"code_{m}") for m in ("target", "transition", "both")])


query(
    "run_verdict",
    """SELECT CASE WHEN f > 0 OR NOT tg OR lv > 0 THEN 2 WHEN n > 0 THEN 1 ELSE 0 END AS code_target, CASE WHEN f > 0 OR NOT xg OR lv > 0 THEN 2 WHEN n > 0 THEN 1 ELSE 0 END AS code_transition,
      CASE WHEN f > 0 OR NOT tg OR NOT xg OR lv > 0 THEN 2 WHEN n > 0 THEN 1 ELSE 0 END AS code_both
    FROM (SELECT (SELECT forbidden_edges_count FROM scen WHERE name = 'target') AS f, (SELECT bool_and(pass) FROM gate WHERE profile = 'target') AS tg,
      (SELECT bool_and(pass) FROM gate WHERE profile = 'transition') AS xg, (SELECT COUNT(*) FROM lchecked WHERE verdict = 'violation') AS lv, (SELECT COUNT(*) FROM ev) AS n)""",
    GATE_CTES + "," + LAYERED + "," + EV_SQL,
)(verdict)

# -- path to module ---------------------------------------------------------------


def rules(t):
    return t("path_rules").select("module_id", "precedence", F.array("include_glob").alias("include"), F.array("exclude_glob").alias("exclude"))


def glob_sql(c):
    return (
        f"'^' || replace(replace(replace(regexp_replace({c}, '([.+?^$()|\\[\\]{{}}\\\\])', '\\\\\\1', 'g'), '**', chr(1)), '*', '[^/]*'), chr(1), '.*') || '$'"
    )


query(
    "path_modules",
    f"""SELECT path, arg_min(module_id, (precedence, module_id)) AS module FROM (SELECT p.path, r.module_id, COALESCE(r.precedence, 1000) AS precedence
      FROM part_paths p JOIN path_rules r ON regexp_matches(p.path, {glob_sql('r.include_glob')}) AND NOT regexp_matches(p.path, {glob_sql('r.exclude_glob')})) GROUP BY path""",
)(lambda t: R.map_paths(t.wide("part_paths"), rules(t)))
query(
    "module_map_by_folder",
    """SELECT key, arg_min(module, (id, path)) AS module FROM (SELECT id, path, module, regexp_replace(path, '/[^/]*$', '') AS key FROM part_paths) GROUP BY key""",
)(lambda t: R.export_module_map(t("part_paths").select(F.col("id").alias("pos"), "path", F.col("module").alias("module_id")), "dir"))
query("module_map_by_file", "SELECT path AS key, module FROM part_paths")(
    lambda t: R.export_module_map(t("part_paths").select(F.col("id").alias("pos"), "path", F.col("module").alias("module_id")))
)
