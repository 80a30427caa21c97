"""Reachability, layers, cycles, hierarchies and task readiness over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgeloom.operators import dag, reach as G
from edgeloom.plans.registry import query
from edgeloom.session import Scratch
from edgeloom.sources import store

BFS = """
bfs AS (SELECT seed, seed AS node, 0 AS depth FROM {seeds}
  UNION SELECT b.seed, e.{to}, b.depth + 1 FROM bfs b JOIN {edges} e ON e.{frm} = b.node WHERE b.depth < {depth}),
dist AS (SELECT seed, node, MIN(depth)::BIGINT AS depth FROM bfs WHERE depth > 0 GROUP BY seed, node)
"""


def bfs(edges, seeds, depth, back=False):
    frm, to = ("dst", "src") if back else ("src", "dst")
    return BFS.format(edges=edges, seeds=seeds, depth=depth, frm=frm, to=to)


cut = ["seed", "node", "depth"]
query("reach_dependencies", "SELECT * FROM dist", bfs("dag_edges", "seeds", 5))(
    lambda t: G.reach(t("dag_edges"), t("seeds"), 5).select(*cut)
)
query("reach_dependents", "SELECT * FROM dist", bfs("dag_edges", "low_seeds", 5, True))(
    lambda t: G.reach(t("dag_edges"), t("low_seeds"), 5, reverse=True).select(*cut)
)
query("reach_on_cycles", "SELECT * FROM dist", bfs("cyc_edges", "ring_seeds", 12))(
    lambda t: G.reach(t("cyc_edges"), t("ring_seeds"), 12).select(*cut)
)
query("cycles_through_nodes", "SELECT seed, depth AS length FROM dist WHERE seed = node", bfs("cyc_edges", "ring_seeds", 99))(
    lambda t: G.cycles_through(t("cyc_edges"), t("ring_seeds"))
)


def walk(edges, seeds):
    """Checks of shortest cycles: of equally near parents the least one is taken."""
    return (
        bfs(edges, seeds, 99)
        + f""", par AS (SELECT d.seed, d.node, d.depth, MIN(e.src) AS parent FROM dist d JOIN {edges} e ON e.dst = d.node
      LEFT JOIN dist u ON u.seed = d.seed AND u.node = e.src WHERE (d.depth = 1 AND e.src = d.seed) OR u.depth = d.depth - 1 GROUP BY d.seed, d.node, d.depth),
    walk AS (SELECT seed, depth AS step, parent AS node FROM par WHERE seed = node
      UNION SELECT w.seed, w.step - 1, p.parent FROM walk w JOIN par p ON p.seed = w.seed AND p.node = w.node WHERE w.step > 1)"""
    )


query("cycle_paths", "SELECT seed, step - 1 AS step, node FROM walk", walk("cyc_edges", "ring_seeds"))(lambda t: G.cycle_paths(t("cyc_edges"), t("ring_seeds")))
query(
    "circular_inheritance",
    "SELECT seed, step - 1 AS step, node FROM walk",
    "ext AS (SELECT src, dst FROM cyc_edges WHERE src % 7 <> 3), cls_seeds AS (SELECT s_suppkey AS seed FROM supplier)," + walk("ext", "cls_seeds"),
)(
    lambda t: G.circular_inheritance(
        t("cyc_edges").select(F.col("src").alias("child"), F.col("dst").alias("parent"), F.when(F.col("src") % 7 != 3, "extends").otherwise("implements").alias("kind")),
        t("supplier").select(F.col("s_suppkey").alias("seed")),
    )
)

IMPACT = """
changed AS (SELECT MAX(p_partkey) AS node FROM part WHERE p_size > 25 GROUP BY p_type),
imp_d AS (SELECT node, 0 AS depth FROM changed UNION SELECT e.dst, depth + 1 FROM imp_d b JOIN dag_edges e ON e.src = b.node WHERE depth < 3),
imp_u AS (SELECT node, 0 AS depth FROM changed UNION SELECT e.src, depth + 1 FROM imp_u b JOIN dag_edges e ON e.dst = b.node WHERE depth < 3)
"""
query(
    "change_impact",
    """SELECT node, 'direct' AS relation, 0::BIGINT AS depth FROM changed
    UNION ALL SELECT node, 'downstream', MIN(depth) FROM imp_d WHERE depth > 0 GROUP BY node
    UNION ALL SELECT node, 'upstream', MIN(depth) FROM imp_u WHERE depth > 0 GROUP BY node""",
    IMPACT,
)(lambda t: G.impact(t("dag_edges"), t("part").filter("p_size > 25").groupBy("p_type").agg(F.max("p_partkey").alias("node")).select("node")))

SEARCH = bfs("dag_edges", "seeds", 2, True).replace("bfs", "up").replace("dist", "up_d") + "," + bfs("dag_edges", "seeds", 2).replace("bfs", "dn").replace("dist", "dn_d") + """,
found AS (SELECT seed, node, 0 AS rank, depth FROM up_d UNION ALL SELECT seed, node, 1, depth FROM dn_d
  UNION ALL SELECT s.seed, o.p_partkey, 2, 1 FROM seeds s JOIN part h ON h.p_partkey = s.seed JOIN part o ON o.p_name = h.p_name AND o.p_type = h.p_type AND o.p_size = h.p_size
  UNION ALL SELECT s.seed, o.p_partkey, 3, 1 FROM seeds s JOIN part h ON h.p_partkey = s.seed JOIN part o ON o.p_brand = h.p_brand)
"""


def search_nodes(t):
    return t("part").select(
        F.col("p_partkey").alias("id"), F.concat_ws("/", "p_name", "p_type", F.col("p_size").cast("string")).alias("file"), F.col("p_brand").alias("module")
    )


SEARCH_ROWS = """SELECT seed, node, CASE r.rank WHEN 0 THEN 'caller' WHEN 1 THEN 'callee' WHEN 2 THEN 'same_file' ELSE 'same_module' END AS relation, r.depth AS depth
 FROM (SELECT seed, node, MIN({'rank': rank, 'depth': depth}) AS r FROM found WHERE seed <> node GROUP BY seed, node)"""
query("graph_search", SEARCH_ROWS, SEARCH)(lambda t: G.search(t("dag_edges"), search_nodes(t), t("seeds"), 2))
query("graph_search_counts", f"SELECT relation, COUNT(*) AS n FROM ({SEARCH_ROWS}) GROUP BY relation", SEARCH)(
    lambda t: G.search(t("dag_edges"), search_nodes(t), t("seeds"), 2).groupBy("relation").agg(F.count("*").alias("n"))
)
query(
    "graph_search_groups",
    f"""SELECT seed, relation, CASE relation WHEN 'same_file' THEN h.p_name || '/' || h.p_type || '/' || CAST(h.p_size AS VARCHAR) ELSE h.p_brand END AS home, COUNT(*) AS found
    FROM ({SEARCH_ROWS}) JOIN part h ON h.p_partkey = seed WHERE relation IN ('same_file', 'same_module') GROUP BY ALL""",
    SEARCH,
)(lambda t: G.search_groups(t("dag_edges"), search_nodes(t), t("seeds"), 2))
query(
    "functions_changed_by_commit",
    """SELECT f.commit_hash, f.function_id, f.change_type, p.p_name AS name FROM commit_functions f JOIN part p ON p.p_partkey = f.function_id
    WHERE f.commit_hash IN (SELECT hash FROM commits WHERE message LIKE 'closes%')""",
)(
    lambda t: G.functions_changed(
        t("commit_functions"), t("part").select(F.col("p_partkey").alias("function_id"), F.col("p_name").alias("name")),
        t("commits").filter("message LIKE 'closes%'").select(F.col("hash").alias("commit_hash")),
    )
)

LONGEST = """
ld AS (SELECT p_partkey AS node, 0 AS depth FROM part WHERE p_partkey NOT IN (SELECT src FROM dag_edges)
  UNION SELECT e.src, depth + 1 FROM ld JOIN dag_edges e ON e.dst = ld.node),
lay AS (SELECT node, MAX(depth)::BIGINT AS layer FROM ld GROUP BY node)
"""


def part_layers(t):
    return dag.layers(t("part").select(F.col("p_partkey").alias("node")), t("dag_edges").toDF("node", "dep"))


query("dag_layers", "SELECT * FROM lay", LONGEST)(part_layers)
query("dag_layer_sizes", "SELECT layer, COUNT(*) AS nodes FROM lay GROUP BY layer", LONGEST)(lambda t: dag.layer_sizes(part_layers(t)))
query(
    "task_dag_nodes",
    """SELECT l.node AS id, t.status, l.layer AS depth, (SELECT COUNT(*) FROM dag_edges e WHERE e.src = l.node) AS blocked_by,
      (SELECT COUNT(*) FROM dag_edges e WHERE e.dst = l.node) AS blocks FROM lay l JOIN tasks t ON t.id = l.node""",
    LONGEST,
)(
    lambda t: dag.node_table(t("tasks").select(F.col("id").alias("node"), "status"), t("dag_edges").toDF("node", "dep"), part_layers(t)).withColumnRenamed("node", "id")
)

CLOSURE = """
clo AS (SELECT src, dst FROM {edges} UNION SELECT c.src, e.dst FROM clo c JOIN {edges} e ON c.dst = e.src),
scc AS (SELECT c.src AS node, MAX(c.dst) AS component FROM clo c JOIN clo r ON r.src = c.dst AND r.dst = c.src GROUP BY c.src)
"""
query("cycle_components", "SELECT node, component FROM scc", CLOSURE.format(edges="cyc_edges"))(
    lambda t: dag.components(t("cyc_edges"))
)
DAG_ERR = "cyc AS (SELECT id AS src, dep AS dst FROM blocked_by)," + CLOSURE.format(edges="cyc")


def broken_nodes(t):
    n = t("supplier").select(F.col("s_suppkey").alias("node"))
    return n.unionByName(t("supplier").filter("s_suppkey % 19 = 0").select(F.col("s_suppkey").alias("node")))


query(
    "dag_errors",
    """SELECT 'duplicate_node' AS error, s_suppkey AS node, NULL::BIGINT AS dep FROM supplier WHERE s_suppkey % 19 = 0
    UNION ALL SELECT DISTINCT 'missing_dependency', id, dep FROM blocked_by WHERE dep NOT IN (SELECT s_suppkey FROM supplier)
    UNION ALL SELECT 'cycle', node, NULL FROM scc""",
    DAG_ERR,
)(lambda t: dag.dag_errors(broken_nodes(t), t("blocked_by").toDF("node", "dep")))
query(
    "dag_cycle_errors",
    """SELECT seed AS component, COUNT(*) AS length, string_agg(CAST(node AS VARCHAR), ' -> ' ORDER BY step) || ' -> ' || CAST(seed AS VARCHAR) AS path FROM walk GROUP BY seed""",
    DAG_ERR + ", heads AS (SELECT DISTINCT component AS seed FROM scc)," + walk("cyc", "heads"),
)(lambda t: dag.cycle_errors(t("blocked_by").toDF("node", "dep")))
query(
    "task_store_errors",
    """SELECT 'blocked_by_missing' AS error, id, dep AS other FROM blocked_by WHERE dep NOT IN (SELECT s_suppkey FROM supplier)
    UNION ALL SELECT 'blocks_missing', id, blocked FROM blocks WHERE blocked NOT IN (SELECT s_suppkey FROM supplier)
    UNION ALL SELECT 'not_symmetric', id, dep FROM blocked_by b WHERE dep IN (SELECT s_suppkey FROM supplier) AND NOT EXISTS (SELECT 1 FROM blocks k WHERE k.id = b.dep AND k.blocked = b.id)
    UNION ALL SELECT 'not_symmetric', id, blocked FROM blocks k WHERE blocked IN (SELECT s_suppkey FROM supplier) AND NOT EXISTS (SELECT 1 FROM blocked_by b WHERE k.id = b.dep AND k.blocked = b.id)
    UNION ALL SELECT 'cycle', node, NULL FROM scc""",
    DAG_ERR,
)(lambda t: dag.store_errors(t("supplier").select(F.col("s_suppkey").alias("id")), t("blocked_by"), t("blocks")))
query(
    "ready_tasks",
    """SELECT t.id, COUNT(o.id) AS unresolved, COUNT(o.id) = 0 AS ready FROM tasks t LEFT JOIN dag_edges e ON e.src = t.id
      LEFT JOIN tasks o ON o.id = e.dst AND o.status <> 'completed' AND NOT o.integrated WHERE t.status = 'pending' GROUP BY t.id""",
)(lambda t: dag.readiness(t("tasks"), t("dag_edges").toDF("id", "dep")))
query(
    "remove_tasks",
    """SELECT src AS id, dst AS dep FROM dag_edges WHERE src NOT IN (SELECT id FROM tasks WHERE integrated) AND dst NOT IN (SELECT id FROM tasks WHERE integrated)""",
)(lambda t: dag.remove_nodes(t("dag_edges").toDF("id", "dep"), t("tasks").filter("integrated")))


def edge_requests(t):
    b = t("blocked_by")
    loops = t("supplier").filter("s_nationkey = 3").select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("dep"))
    return b.unionByName(loops)


REQ = "req AS (SELECT * FROM blocked_by UNION ALL SELECT s_suppkey, s_suppkey FROM supplier WHERE s_nationkey = 3)"
query(
    "add_task_edges",
    """SELECT id, dep FROM blocks_t UNION SELECT id, dep FROM req WHERE id <> dep AND dep IN (SELECT s_suppkey FROM supplier)""",
    REQ + ", blocks_t AS (SELECT src AS id, dst AS dep FROM cyc_edges)",
)(
    lambda t: dag.add_edges(
        t("supplier").select(F.col("s_suppkey").alias("id")), t("cyc_edges").toDF("id", "dep"), edge_requests(t)
    )[0]
)
query(
    "rejected_task_edges",
    """SELECT id, dep, CASE WHEN id = dep THEN 'self_dependency' ELSE 'missing_task' END AS reason FROM req WHERE id = dep OR dep NOT IN (SELECT s_suppkey FROM supplier)""",
    REQ,
)(lambda t: dag.add_edges(t("supplier").select(F.col("s_suppkey").alias("id")), t("cyc_edges").toDF("id", "dep"), edge_requests(t))[1].select("id", "dep", "reason"))
FAILED = "f AS (SELECT p_partkey AS id, p_size = 50 AS failed FROM part)"


def items(t):
    return t("part").select(F.col("p_partkey").alias("id"), (F.col("p_size") == 50).alias("failed"))


query(
    "failure_cascade",
    """SELECT id, failed, NOT failed AND EXISTS (SELECT 1 FROM dag_edges e JOIN f g ON g.id = e.dst AND g.failed WHERE e.src = f.id) AS skipped FROM f""",
    FAILED,
)(lambda t: dag.failure_cascade(items(t), t("dag_edges").toDF("id", "dep")))
query(
    "failure_cascade_transitive",
    """SELECT id, failed, NOT failed AND id IN (SELECT id FROM hit) AS skipped FROM f""",
    FAILED + ", hit AS (SELECT e.src AS id FROM dag_edges e JOIN f ON f.id = e.dst AND failed UNION SELECT e.src FROM hit JOIN dag_edges e ON e.dst = hit.id)",
)(lambda t: dag.failure_cascade(items(t), t("dag_edges").toDF("id", "dep"), transitive=True))
query(
    "inherited_layers",
    "SELECT node, arg_min(layer, d) AS layer FROM anc GROUP BY node",
    """anc AS (SELECT node, node AS at, parent, layer, 0 AS d FROM hierarchy UNION SELECT a.node, h.node, h.parent, h.layer, d + 1 FROM anc a JOIN hierarchy h ON h.node = a.parent)""",
)(lambda t: dag.inherit(t("hierarchy"), "layer"))
query(
    "hierarchy_errors",
    """SELECT 'unknown_parent' AS error, node FROM broken_hierarchy WHERE parent IS NOT NULL AND parent NOT IN (SELECT node FROM broken_hierarchy)
    UNION ALL SELECT 'circular_parent', node FROM scc""",
    "par AS (SELECT node AS src, parent AS dst FROM broken_hierarchy WHERE parent IS NOT NULL)," + CLOSURE.format(edges="par"),
)(lambda t: dag.hierarchy_errors(t("broken_hierarchy")))

# -- graph tables ------------------------------------------------------------------


def snapshot_rows(t, days, tag):
    """Two loads of a function table: keys repeat, the later load wins."""
    return t("lineitem").filter(days).select(
        F.concat(F.lit("repo"), (F.col("l_suppkey") % 4).cast("string")).alias("repo_id"), F.col("l_partkey").alias("id"),
        F.concat(F.lit(tag), "l_returnflag", F.col("l_linenumber").cast("string")).alias("signature"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber") + (1 if tag == "new_" else 0) * 10**12).alias("indexed_at"),
    )


UPS = """
ups AS (SELECT 'repo' || CAST(l_suppkey % 4 AS VARCHAR) AS repo_id, l_partkey AS id, CASE WHEN l_shipdate >= TIMESTAMP '2000-01-01' THEN 'new_' ELSE 'old_' END || l_returnflag || CAST(l_linenumber AS VARCHAR) AS signature,
 l_orderkey * 10 + l_linenumber + CASE WHEN l_shipdate >= TIMESTAMP '2000-01-01' THEN 1000000000000 ELSE 0 END AS indexed_at FROM lineitem)
"""


LAST = "SELECT repo_id, id, signature, indexed_at FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY repo_id, id ORDER BY indexed_at DESC, signature DESC) AS rn FROM ups) WHERE rn = 1"


def merged(t):
    old = snapshot_rows(t, "l_shipdate < '2000-01-01'", "old_")
    new = snapshot_rows(t, "l_shipdate >= '2000-01-01'", "new_")
    return store.upsert(old, new, ["repo_id", "id"], "indexed_at")


query("upsert_functions", LAST, UPS)(merged)
query("repositories", "SELECT DISTINCT repo_id FROM ups", UPS)(lambda t: store.repositories(merged(t)))
query("without_repository", f"SELECT * FROM ({LAST}) WHERE repo_id <> 'repo1'", UPS)(
    lambda t: store.without_repository(merged(t), "repo1")
)
query("functions_by_module", "SELECT p_partkey, p_name FROM part WHERE p_brand = 'Brand#3'")(
    lambda t: store.lookup(t("part"), "p_brand", "Brand#3").select("p_partkey", "p_name")
)
query("functions_by_name", "SELECT p_partkey, p_brand FROM part WHERE p_name = 'red widget'")(
    lambda t: store.lookup(t("part"), "p_name", "red widget").select("p_partkey", "p_brand")
)
CLASSES = """
cls AS (SELECT s_suppkey AS id, 'C' || CAST(s_suppkey % 40 AS VARCHAR) AS name, 'm' || CAST(s_nationkey AS VARCHAR) AS module,
  'src/m' || CAST(s_nationkey AS VARCHAR) || '/f' || CAST(s_suppkey % 90 AS VARCHAR) || '.ts' AS file_path, s_suppkey % 300 AS start_line FROM supplier),
fun AS (SELECT p_partkey AS id, p_name AS name, 'm' || CAST(p_partkey % 25 AS VARCHAR) AS module, 'src/m' || CAST(p_partkey % 25 AS VARCHAR) || '/f' || CAST(p_partkey % 90 AS VARCHAR) || '.ts' AS file_path,
  p_partkey % 300 AS start_line FROM part)
"""


def classes(t):
    m = F.concat(F.lit("m"), F.col("s_nationkey").cast("string"))
    path = F.concat(F.lit("src/"), m, F.lit("/f"), (F.col("s_suppkey") % 90).cast("string"), F.lit(".ts"))
    return t("supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("C"), (F.col("s_suppkey") % 40).cast("string")).alias("name"), m.alias("module"), path.alias("file_path"), (F.col("s_suppkey") % 300).alias("start_line"))


def functions(t):
    m = F.concat(F.lit("m"), (F.col("p_partkey") % 25).cast("string"))
    path = F.concat(F.lit("src/"), m, F.lit("/f"), (F.col("p_partkey") % 90).cast("string"), F.lit(".ts"))
    return t("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), m.alias("module"), path.alias("file_path"), (F.col("p_partkey") % 300).alias("start_line"))


query("classes_by_name", "SELECT * FROM cls WHERE name = 'C7'", CLASSES)(lambda t: store.lookup(classes(t), "name", "C7"))
query("classes_by_module", "SELECT * FROM cls WHERE module = 'm3'", CLASSES)(lambda t: store.lookup(classes(t), "module", "m3"))
query("functions_by_id", "SELECT * FROM fun WHERE id = 11", CLASSES)(lambda t: store.lookup(functions(t), "id", 11))
query("functions_by_file", "SELECT * FROM fun WHERE file_path = 'src/m7/f7.ts'", CLASSES)(lambda t: store.lookup(functions(t), "file_path", "src/m7/f7.ts"))
query(
    "module_table",
    """SELECT module, COUNT(DISTINCT file_path) AS files, COUNT(*) FILTER (f) AS functions, COUNT(*) FILTER (NOT f) AS classes
      FROM (SELECT module, file_path, TRUE AS f FROM fun UNION ALL SELECT module, file_path, FALSE FROM cls) GROUP BY module""",
    CLASSES,
)(lambda t: store.modules_of(functions(t), classes(t)))
query(
    "language_stats",
    """SELECT CASE WHEN path LIKE '%.ts' THEN 'typescript' WHEN path LIKE '%.go' THEN 'go' WHEN path LIKE '%.ex' THEN 'elixir' WHEN path LIKE '%.rs' THEN 'rust' WHEN path LIKE '%.py' THEN 'python' ELSE 'unknown' END AS language,
      COUNT(*) AS file_count, SUM(size)::BIGINT AS line_count FROM part_paths GROUP BY 1""",
)(lambda t: store.language_stats(t("part_paths").withColumnRenamed("size", "loc")))


ROWS_PER_FILE = 2_000_000


def merged_by_batches(t):
    """The same upsert as a stream: the files of a load are one micro-batch merged into a table of hashed buckets."""
    scratch = Scratch(t.spark, "upserts")
    rows = snapshot_rows(t, "true", "").withColumn("signature", F.concat(F.when(F.col("indexed_at") % 2 == 0, "even_").otherwise("odd_"), "signature"))
    parts = 1 + t("lineitem").count() // ROWS_PER_FILE
    for load in range(3):
        rows.where(F.pmod("id", F.lit(3)) == load).repartition(parts, "id", "indexed_at").write.mode("append").parquet(f"{scratch.root}/loads")
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", parts).parquet(f"{scratch.root}/loads")
    table = store.VersionedTable(t.spark, f"{scratch.root}/table", rows.schema, ["repo_id", "id"], "indexed_at")
    stream.writeStream.foreachBatch(table.merge).option("checkpointLocation", f"{scratch.root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return table.read().select("repo_id", "id", "signature", "indexed_at")


query(
    "stream_upserts",
    """SELECT repo_id, id, signature, indexed_at FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY repo_id, id ORDER BY indexed_at DESC, signature DESC) AS rn
      FROM (SELECT 'repo' || CAST(l_suppkey % 4 AS VARCHAR) AS repo_id, l_partkey AS id, l_orderkey * 10 + l_linenumber AS indexed_at,
        CASE WHEN (l_orderkey * 10 + l_linenumber) % 2 = 0 THEN 'even_' ELSE 'odd_' END || l_returnflag || CAST(l_linenumber AS VARCHAR) AS signature FROM lineitem)) WHERE rn = 1""",
)(merged_by_batches)
