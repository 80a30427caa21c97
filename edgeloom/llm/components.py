"""Connected components of an edge table, by joins and minimum aggregates over written rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.session import Scratch


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node it is connected with.

    Every round hooks each node to its smallest neighbour, follows these pointers to their end by doubling, and
    contracts the edges; the nodes left at least halve. An empty table gives an empty one; loops and repeats are harmless.
    """
    scratch = Scratch(edges.sparkSession, "components")
    left, n = scratch.save_counted(edges.where("a <> b").distinct(), "edges0")
    known, step = None, 0
    while n:
        step += 1
        ends = left.select(F.col("a").alias("node"), F.col("b").alias("other")).union(left.select("b", "a"))
        up = ends.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("root"))
        hop, moved = 0, 1
        up = scratch.save(up, f"up{step}-0")
        while moved:
            hop += 1
            above = up.select(F.col("node").alias("root"), F.col("root").alias("above"))
            up, moved = scratch.save_counted(up.join(above, "root").select("node", F.col("above").alias("root"), (F.col("above") < F.col("root")).alias("moved")), f"up{step}-{hop}", F.col("moved"))
            up = up.drop("moved")
        if known is None:
            known = up
        else:
            later = up.select(F.col("node").alias("root"), F.col("root").alias("above"))
            known = scratch.save(known.join(later, "root", "left").select("node", F.coalesce("above", "root").alias("root")), f"known{step}")
        a, b = up.select(F.col("node").alias("a"), F.col("root").alias("ra")), up.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        joined = left.join(a, "a").join(b, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
        left, n = scratch.save_counted(joined, f"edges{step}")
    return known if known is not None else left.select(F.col("a").alias("node"), F.col("b").alias("root"))
