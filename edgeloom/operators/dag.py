"""Layers, cycles, hierarchies, readiness and consistency of dependency tables.

Rounds follow the graph's depth (layers), its longest paths (components) or the
logarithm of the hierarchy depth (ancestors). Rounds of layers write what is left, those of components what changed.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edgeloom.session import Scratch


def layers(nodes: DataFrame, deps: DataFrame) -> DataFrame:
    """(node, layer): 0 without dependencies, else 1 + the deepest dependency; null on or behind a cycle.

    nodes(node), deps(node, dep). Dependencies outside ``nodes`` are ignored here and
    reported by :func:`dag_errors`. Sort by (layer, node) for a topological order.
    """
    scratch = Scratch(nodes.sparkSession, "layers")
    names = nodes.select("node").distinct()
    edges = deps.select("node", "dep").distinct().join(names.toDF("dep"), "dep", "left_semi")
    edges = scratch.save(edges.join(names, "node", "left_semi"), "edges")
    need = edges.groupBy("node").agg(F.count("*").alias("need"))
    state = names.join(need, "node", "left").select(
        "node", F.coalesce("need", F.lit(0)).cast("bigint").alias("need"), (F.coalesce("need", F.lit(0)) == 0).alias("ready")
    )
    _, n_ready = scratch.save_counted(state, "round=0", F.col("ready"), ("ready",))
    k = 0
    while n_ready:
        peeled = scratch.read(f"round={k}", state).filter("ready").select("node")
        hits = edges.join(peeled.toDF("dep"), "dep").groupBy("node").agg(F.count("*").alias("hit"))
        rest = scratch.read(f"round={k}", state).filter("NOT ready").select("node", "need")
        left = F.col("need") - F.coalesce("hit", F.lit(0))
        k += 1
        nxt = rest.join(hits, "node", "left").select("node", left.alias("need"), (left == 0).alias("ready"))
        _, n_ready = scratch.save_counted(nxt, f"round={k}", F.col("ready"), ("ready",))
    out = scratch.read(f"round={k}", state).filter("NOT ready").select("node", F.lit(None).cast("bigint").alias("layer"))
    # All rounds at once: the folder names carry the layer.
    shape = T.StructType([*state.schema.fields, T.StructField("round", T.LongType())])
    rounds = nodes.sparkSession.read.schema(shape).option("basePath", scratch.root).parquet(f"{scratch.root}/round=*")
    return out.unionByName(rounds.filter("ready").select("node", F.col("round").alias("layer")))


def node_table(nodes: DataFrame, deps: DataFrame, layered: DataFrame) -> DataFrame:
    """nodes(node, ...) with ``depth``, ``blocked_by`` and ``blocks``: the layer and the numbers of edges out and in.

    ``layered`` are the layers of the same graph; nodes without one (on or behind a cycle) are left out.
    """
    ends = deps.select(F.col("node"), F.lit(1).alias("out"), F.lit(0).alias("in_")).unionByName(deps.select(F.col("dep").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in_")))
    counts = ends.groupBy("node").agg(F.sum("out").alias("out"), F.sum("in_").alias("in_"))
    rows = layered.where("layer IS NOT NULL").withColumnRenamed("layer", "depth").join(nodes, "node").join(counts, "node", "left")
    return rows.select(*nodes.columns, "depth", F.coalesce("out", F.lit(0)).alias("blocked_by"), F.coalesce("in_", F.lit(0)).alias("blocks"))


def layer_sizes(layered: DataFrame) -> DataFrame:
    return layered.filter("layer IS NOT NULL").groupBy("layer").agg(F.count("*").alias("nodes"))


def dag_errors(nodes: DataFrame, deps: DataFrame) -> DataFrame:
    """(error, node, dep): duplicate_node, missing_dependency, cycle."""
    none = F.lit(None).cast(nodes.schema["node"].dataType)
    twice = nodes.groupBy("node").count().filter("count > 1").select(F.lit("duplicate_node").alias("error"), "node", none.alias("dep"))
    missing = (
        deps.select("node", "dep").distinct().join(nodes.select(F.col("node").alias("dep")), "dep", "left_anti")
        .select(F.lit("missing_dependency").alias("error"), "node", "dep")
    )
    cyclic = components(deps.select(F.col("node").alias("src"), F.col("dep").alias("dst"))).select(
        F.lit("cycle").alias("error"), "node", none.alias("dep")
    )
    return twice.unionByName(missing).unionByName(cyclic)


def cycle_errors(deps: DataFrame) -> DataFrame:
    """(component, length, path): for every strongly connected component of deps(node, dep) a shortest cycle through its greatest node.

    ``path`` runs from that node along dependencies back to it, joined by arrows.
    """
    from edgeloom.operators.reach import cycle_paths, inside_components

    edges = deps.select(F.col("node").alias("src"), F.col("dep").alias("dst")).distinct()
    found = components(edges)
    steps = cycle_paths(*inside_components(edges, found.select(F.col("component").alias("seed"))))
    walk = F.transform(F.array_sort(F.collect_list(F.struct("step", "node"))), lambda r: r["node"].cast("string"))
    paths = steps.groupBy(F.col("seed").alias("component")).agg(F.count("*").alias("length"), walk.alias("walk"))
    return paths.select("component", "length", F.concat_ws(" -> ", "walk", F.col("component").cast("string")).alias("path"))


def _trim(scratch: Scratch, edges: DataFrame, size: int, tag: str) -> tuple[DataFrame, int]:
    """Drop edges that cannot lie on a cycle: sources nobody enters, targets nobody leaves.

    Only a reduction: it goes on while a round still drops a quarter of the edges. The search below is exact.
    """
    for i in count() if size else ():
        live = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        live = live.join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        edges, left = scratch.save_counted(live.select("src", "dst"), f"{tag}-trim={i}")
        size, before = left, size
        if left == 0 or 4 * (before - left) < before:
            break
    return edges, size


def _reached(scratch: Scratch, live: DataFrame, tag: str) -> DataFrame:
    """(node, down, up): the node of the greatest rank that reaches each node, and the one of the greatest rank it reaches.

    Ranks are hashes of the ids. Both ways run in the same rounds. A node takes the best of what its neighbours were
    found to be reached from, and of what the node that reaches it is itself reached from, which skips most of a long
    path (a ring of 300 takes 43 rounds). Every round writes only the nodes that changed.
    """
    rank = lambda c: F.struct(F.xxhash64(F.lit(tag), c).alias("rank"), F.col(c).alias("id"))
    ways = live.select(F.lit(0).alias("way"), "src", "dst").unionByName(live.select(F.lit(1).alias("way"), F.col("dst").alias("src"), F.col("src").alias("dst")))
    start = ways.select("way", F.col("src").alias("node")).union(ways.select("way", "dst")).distinct().withColumn("best", rank("node"))
    moved, n_moved = scratch.save_counted(start, f"{tag}-0")
    names = [f"{tag}-0"]
    while n_moved:
        known = scratch.read_many(names, start).groupBy("way", "node").agg(F.max("best").alias("best"))
        near = ways.join(moved.select("way", F.col("node").alias("src"), F.col("best").alias("offer")), ["way", "src"]).select("way", F.col("dst").alias("node"), "offer")
        jump = known.select("way", "node", F.col("best.id").alias("over")).join(moved.select("way", F.col("node").alias("over"), F.col("best").alias("offer")), ["way", "over"])
        offers = near.unionByName(jump.select("way", "node", "offer")).groupBy("way", "node").agg(F.max("offer").alias("offer"))
        better = offers.join(known, ["way", "node"]).where("offer > best").select("way", "node", F.col("offer").alias("best"))
        names.append(f"{tag}-{len(names)}")
        moved, n_moved = scratch.save_counted(better, names[-1])
    best = scratch.read_many(names, start).groupBy("node")
    of = lambda way: F.max(F.when(F.col("way") == way, F.col("best")))["id"]
    return best.agg(of(0).alias("down"), of(1).alias("up"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): every node on a cycle with its strongly connected component, named by its greatest id.

    A round finds for every node the best-ranked node that reaches it and the best-ranked one it reaches. Where both are
    one, they share its component and leave; components lie inside groups of nodes that agree on both, so all other
    edges are dropped. What is left is ranked anew.
    """
    scratch = Scratch(edges.sparkSession, "scc")
    edges = scratch.save(edges.select("src", "dst").distinct(), "edges")
    loops = edges.filter("src = dst").select(F.col("src").alias("node"))
    live, size = scratch.save_counted(edges.filter("src <> dst"), "plain")
    live, size = _trim(scratch, live, size, "t0")
    shape = live.select(F.col("src").alias("node"), F.col("src").alias("root"))
    parts: list[str] = []
    while size:
        turn = len(parts) + 1
        found = scratch.save(_reached(scratch, live, f"reach{turn}"), f"found{turn}")
        parts.append(f"part{turn}")
        scratch.save(found.where("down = up").select("node", F.col("down").alias("root")), parts[-1])
        a, b = found.toDF("src", "ad", "au"), found.toDF("dst", "bd", "bu")
        rest = live.join(a.where("ad <> au"), "src").join(b, "dst").where("ad = bd AND au = bu").select("src", "dst")
        live, size = scratch.save_counted(rest, f"rest{turn}")
        live, size = _trim(scratch, live, size, f"t{turn}")
    found = scratch.read_many(parts, shape) if parts else shape.filter(F.lit(False))
    sizes = found.groupBy("root").agg(F.count("*").alias("n"), F.max("node").alias("component")).filter("n > 1")
    big = found.join(sizes, "root").select("node", "component")
    alone = loops.join(big.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
    return big.unionByName(alone)


def inherit(hierarchy: DataFrame, value: str) -> DataFrame:
    """(node, value): own value, else the nearest ancestor's, by pointer jumping (log of depth rounds).

    hierarchy(node, parent, <value>). Nodes on a parent cycle without a value stay null.
    """
    scratch = Scratch(hierarchy.sparkSession, "inherit")
    open_rows = F.col("ptr").isNotNull()
    state, left = scratch.save_counted(
        hierarchy.select("node", F.when(F.col(value).isNull(), F.col("parent")).alias("ptr"), F.col(value).alias("value")), "jump=0", open_rows
    )
    # What is open after as many doublings as the open nodes allow stands on a cycle.
    for k in range(1, left.bit_length() + 2):
        if not left:
            break
        up = state.select(F.col("node").alias("ptr"), F.col("ptr").alias("up_ptr"), F.col("value").alias("up_value"))
        jumped = state.join(up, "ptr", "left").select("node", F.col("up_ptr").alias("ptr"), F.coalesce("value", "up_value").alias("value"))
        state, left = scratch.save_counted(jumped, f"jump={k}", open_rows)
    return state.select("node", F.col("value").alias(value))


def hierarchy_errors(hierarchy: DataFrame) -> DataFrame:
    """(error, node): unknown_parent, circular_parent."""
    known = hierarchy.select(F.col("node").alias("parent"))
    unknown = hierarchy.filter("parent IS NOT NULL").join(known, "parent", "left_anti")
    loop = components(hierarchy.filter("parent IS NOT NULL").select(F.col("node").alias("src"), F.col("parent").alias("dst")))
    return unknown.select(F.lit("unknown_parent").alias("error"), "node").unionByName(
        loop.select(F.lit("circular_parent").alias("error"), "node")
    )


def readiness(tasks: DataFrame, deps: DataFrame) -> DataFrame:
    """(id, unresolved, ready): pending tasks whose dependencies are completed or integrated.

    tasks(id, status, integrated BOOLEAN), deps(id, dep); a missing dependency counts as unresolved.
    """
    done = tasks.filter((F.col("status") == "completed") | F.col("integrated")).select(F.col("id").alias("dep"))
    open_deps = deps.select("id", "dep").distinct().join(done, "dep", "left_anti").groupBy("id").agg(F.count("*").alias("n"))
    pending = tasks.filter("status = 'pending'").select("id").join(open_deps, "id", "left")
    unresolved = F.coalesce("n", F.lit(0))
    return pending.select("id", unresolved.alias("unresolved"), (unresolved == 0).alias("ready"))


def store_errors(tasks: DataFrame, blocked_by: DataFrame, blocks: DataFrame) -> DataFrame:
    """(error, id, other): blocked_by_missing, blocks_missing, asymmetric links, cycle.

    blocked_by(id, dep) and blocks(id, blocked) are the two sides as stored.
    """
    ids = tasks.select("id")
    down = blocked_by.select(F.col("id").alias("a"), F.col("dep").alias("b")).distinct()
    up = blocks.select(F.col("blocked").alias("a"), F.col("id").alias("b")).distinct()
    known = ids.select(F.col("id").alias("b"))
    known_a = ids.select(F.col("id").alias("a"))
    shaped = lambda df, error, x, y: df.select(F.lit(error).alias("error"), F.col(x).alias("id"), F.col(y).alias("other"))
    out = shaped(down.join(known, "b", "left_anti"), "blocked_by_missing", "a", "b")
    out = out.unionByName(shaped(up.join(known_a, "a", "left_anti"), "blocks_missing", "b", "a"))
    one_way = down.join(known, "b", "left_semi").join(up, ["a", "b"], "left_anti")
    out = out.unionByName(shaped(one_way, "not_symmetric", "a", "b"))
    other_way = up.join(known_a, "a", "left_semi").join(down, ["a", "b"], "left_anti")
    out = out.unionByName(shaped(other_way, "not_symmetric", "b", "a"))
    loop = components(down.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    return out.unionByName(loop.select(F.lit("cycle").alias("error"), F.col("node").alias("id"), F.lit(None).cast("bigint").alias("other")))


def remove_nodes(deps: DataFrame, removed: DataFrame) -> DataFrame:
    """deps(id, dep) without every edge that touches removed(id)."""
    return deps.join(removed.select("id"), "id", "left_anti").join(removed.select(F.col("id").alias("dep")), "dep", "left_anti").select("id", "dep")


def add_edges(tasks: DataFrame, deps: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, rejected): accepted edges join the table; self and missing ends are rejected with a reason."""
    known = tasks.select("id").distinct()
    checked = (
        new.select("id", "dep")
        .join(known.withColumn("has_id", F.lit(True)), "id", "left")
        .join(known.select(F.col("id").alias("dep"), F.lit(True).alias("has_dep")), "dep", "left")
        .select(
            "id",
            "dep",
            F.when(F.col("id") == F.col("dep"), "self_dependency")
            .when(F.col("has_id").isNull() | F.col("has_dep").isNull(), "missing_task")
            .alias("reason"),
        )
    )
    accepted = deps.select("id", "dep").union(checked.filter("reason IS NULL").select("id", "dep")).distinct()
    return accepted, checked.filter("reason IS NOT NULL")


def failure_cascade(items: DataFrame, deps: DataFrame, transitive: bool = False) -> DataFrame:
    """(id, failed, skipped): an item is skipped when a direct dependency failed.

    A skipped item does not count as failed, so the default stops after one hop;
    ``transitive`` follows the dependents of every failed item.
    """
    failed = items.filter("failed").select("id")
    if transitive:
        from edgeloom.operators.reach import reach

        edges = deps.select(F.col("dep").alias("src"), F.col("id").alias("dst"))
        hit = reach(edges, failed.select(F.lit("failed").alias("seed"), F.col("id").alias("node")), None).select(F.col("node").alias("id"))
    else:
        hit = deps.join(failed.select(F.col("id").alias("dep")), "dep", "left_semi").select("id")
    marked = hit.distinct().withColumn("hit", F.lit(True))
    return items.select("id", "failed").join(marked, "id", "left").select(
        "id", "failed", (F.col("hit").isNotNull() & ~F.col("failed")).alias("skipped")
    )
