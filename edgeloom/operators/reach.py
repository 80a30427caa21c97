"""Bounded reachability, cycles through a node, impact and relation search.

Each round joins only the new frontier with the edges and drops visited pairs;
the frontier is written as one more part of the visited table, so a round costs
the frontier's fan-out and nothing already found is rewritten.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.session import Scratch

MAX_DEPTH = 100
PAIR = ["seed", "node"]


def reach(edges: DataFrame, seeds: DataFrame, depth: int | None, reverse: bool = False) -> DataFrame:
    """(seed, node, depth, parent): nodes within ``depth`` hops of each seed, shortest depth.

    edges(src, dst); seeds has ``seed`` and optionally ``node`` (a group of start
    nodes may share one seed label). A seed on a cycle is returned with the cycle
    length. Depth 0 is empty, above 100 is an error; None goes on until nothing new is met.
    """
    if depth is not None and not 0 <= depth <= MAX_DEPTH:
        raise ValueError("depth must be within 0..100")
    spark = edges.sparkSession
    scratch = Scratch(spark, "reach")
    a, b = ("dst", "src") if reverse else ("src", "dst")
    steps = scratch.save(edges.select(F.col(a).alias("node"), F.col(b).alias("next")).distinct(), "steps")
    start = seeds if "node" in seeds.columns else seeds.withColumn("node", F.col("seed"))
    frontier = start.select(*PAIR).distinct()
    found: list[str] = []
    shape = frontier.select(*PAIR, F.lit(0).cast("bigint").alias("depth"), F.col("node").alias("parent"))
    for k in count(1) if depth is None else range(1, depth + 1):
        new = (
            frontier.join(steps, "node")
            .groupBy("seed", F.col("next").alias("node"))
            .agg(F.min("node").alias("parent"))
        )
        if found:
            new = new.join(scratch.read_many(found, shape).select(*PAIR), PAIR, "left_anti")
        part, n = scratch.save_counted(new.select(*PAIR, F.lit(k).cast("bigint").alias("depth"), "parent"), f"depth={k}/part")
        if n == 0:
            break
        found.append(f"depth={k}/part")
        frontier = part.select(*PAIR)
    return scratch.read_many(found, shape) if found else shape.filter(F.lit(False))


def cycles_through(edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """(seed, length) of one shortest cycle through each seed that lies on one."""
    return reach(edges, seeds, depth).filter("seed = node").select("seed", F.col("depth").alias("length"))


def cycle_paths(edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """(seed, step, node): nodes of one shortest cycle per seed, step 0 being the seed."""
    tree = reach(edges, seeds, depth)
    scratch = Scratch(edges.sparkSession, "cycle")
    more = F.col("step") > 1
    at, left = scratch.save_counted(
        tree.filter("seed = node").select("seed", F.col("depth").alias("step"), F.col("parent").alias("node")), "back=0", more
    )
    parts, k = ["back=0"], 0
    while left:
        k += 1
        back = at.filter(more).join(tree.select(*PAIR, "parent"), PAIR)
        at, left = scratch.save_counted(
            back.select("seed", (F.col("step") - 1).alias("step"), F.col("parent").alias("node")), f"back={k}", more
        )
        parts.append(f"back={k}")
    walked = scratch.read_many(parts, at)
    return walked.select("seed", (F.col("step") - 1).alias("step"), "node")


def circular_inheritance(inherits: DataFrame, classes: DataFrame, kind: str = "extends") -> DataFrame:
    """(seed, step, node): one shortest inheritance cycle of each of classes(seed) that lies on one, over edges of ``kind``.

    inherits(child, parent, kind); edges of other kinds, such as implemented interfaces, close no cycle. The search stays
    inside the strongly connected components of the seeds.
    """
    edges = inherits.filter(F.col("kind") == kind).select(F.col("child").alias("src"), F.col("parent").alias("dst")).distinct()
    return cycle_paths(*inside_components(edges, classes))


def inside_components(edges: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges inside strongly connected components that hold a seed, and the seeds on cycles; no cycle is lost."""
    from edgeloom.operators.dag import components

    scratch = Scratch(edges.sparkSession, "inside")
    edges = scratch.save(edges.select("src", "dst"), "edges")
    found = scratch.save(components(edges), "components")
    own = scratch.save(seeds.select("seed").distinct().join(found.withColumnRenamed("node", "seed"), "seed"), "seeds")
    wanted = found.join(own.select("component").distinct(), "component", "left_semi")
    a, b = wanted.toDF("component", "src"), wanted.toDF("component_b", "dst")
    live = edges.join(a, "src").join(b, "dst").where("component = component_b").select("src", "dst")
    return scratch.save(live, "live"), own.select("seed")


def impact(edges: DataFrame, changed: DataFrame, hops: int = 3) -> DataFrame:
    """(node, relation, depth) for changed(node): the nodes themselves, upstream and downstream."""
    group = changed.select(F.lit("set").alias("seed"), "node").distinct()
    direct = group.select("node", F.lit("direct").alias("relation"), F.lit(0).cast("bigint").alias("depth"))
    down = reach(edges, group, hops).select("node", F.lit("downstream").alias("relation"), "depth")
    up = reach(edges, group, hops, reverse=True).select("node", F.lit("upstream").alias("relation"), "depth")
    return direct.unionByName(up).unionByName(down)


def search_groups(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(seed, relation, home, found): :func:`search` with the members of the seed's file and module as counts.

    ``relation`` is same_file or same_module, ``home`` that file or module, and ``found`` the number of its nodes that no
    nearer relation has; those nodes are the rows of ``nodes`` in that home. Group sizes are counted once for all seeds and
    corrected by the callers and callees, so a large module is never paired with its seeds. A node has one row in ``nodes``.
    """
    homes = nodes.select(F.col("id").alias("node"), "file", "module")
    wanted = seeds.select("seed").distinct()
    own = wanted.join(homes.withColumnRenamed("node", "seed"), "seed")
    near = reach(edges, wanted, depth, reverse=True).select(*PAIR).unionByName(reach(edges, wanted, depth).select(*PAIR))
    near = near.distinct().filter("seed <> node").join(homes, "node")
    at = own.select("seed", F.col("file").alias("own_file"), F.col("module").alias("own_module"))
    here, there = (F.coalesce(F.col(c) == F.col(f"own_{c}"), F.lit(False)) for c in ("file", "module"))
    taken = near.join(at, "seed").groupBy("seed").agg(
        F.count_if(here).alias("near_file"), F.count_if(there & ~here).alias("near_module")
    )
    cells = nodes.groupBy("file", "module").agg(F.count("*").alias("in_both"))
    files = nodes.groupBy("file").agg(F.count("*").alias("in_file"))
    modules = nodes.groupBy("module").agg(F.count("*").alias("in_module"))
    sized = own.join(taken, "seed", "left")
    for table, keys in ((files, ["file"]), (modules, ["module"]), (cells, ["file", "module"])):
        sized = sized.join(table, keys, "left")
    sized = sized.fillna(0, ["near_file", "near_module", "in_file", "in_module", "in_both"])
    alone = F.when(F.col("file").isNull(), 1).otherwise(0)  # the seed itself, where no file counts it
    counts = F.array(
        F.struct(F.lit("same_file").alias("relation"), F.col("file").alias("home"), (F.col("in_file") - 1 - F.col("near_file")).alias("found")),
        F.struct(
            F.lit("same_module").alias("relation"), F.col("module").alias("home"),
            (F.col("in_module") - F.col("in_both") - alone - F.col("near_module")).alias("found"),
        ),
    )
    return sized.select("seed", F.explode(counts).alias("c")).select("seed", "c.*").filter("home IS NOT NULL AND found > 0")


def search(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(seed, node, relation, depth): callers, callees, same file, same module; first relation wins."""
    callers = reach(edges, seeds, depth, reverse=True).select(*PAIR, F.lit(0).alias("rank"), "depth")
    callees = reach(edges, seeds, depth).select(*PAIR, F.lit(1).alias("rank"), "depth")
    one = F.lit(1).cast("bigint").alias("depth")

    def same(column: str, rank: int) -> DataFrame:
        home = seeds.select("seed").join(nodes.select(F.col("id").alias("seed"), column), "seed")
        return home.join(nodes.select(F.col("id").alias("node"), column), column).select(
            *PAIR, F.lit(rank).alias("rank"), one
        )

    every = callers.unionByName(callees).unionByName(same("file", 2)).unionByName(same("module", 3))
    names = F.array(*[F.lit(n) for n in ("caller", "callee", "same_file", "same_module")])
    return (
        every.filter("seed <> node")
        .groupBy(*PAIR)
        .agg(F.min(F.struct("rank", "depth")).alias("b"))
        .select(*PAIR, F.get(names, F.col("b.rank")).alias("relation"), F.col("b.depth").alias("depth"))
    )


def functions_changed(commit_functions: DataFrame, functions: DataFrame, commits: DataFrame) -> DataFrame:
    """Functions touched by the given commits(commit_hash)."""
    return commit_functions.join(commits, "commit_hash", "left_semi").join(functions, "function_id")
