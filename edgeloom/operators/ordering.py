"""Exact places in a total order, without one task that sees the whole order.

Rows are dealt into ranges of (keys, order) by Spark's sampled bounds and written, so the ranges stay as they are. Each
range numbers its own rows; a table with one row per key and range tells how many rows stand before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.session import Scratch


def same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Equality of key columns of two tables, in which nulls are equal."""
    out = F.lit(True)
    for k in keys:
        out = out & left[k].eqNullSafe(right[k])
    return out


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "pos") -> DataFrame:
    """``df`` with the 1-based place of each row inside its key; nulls of a key are one key.

    ``order`` should be unique inside a key: places of equal rows are dealt in any way. Without keys it is one order over
    all rows; then the driver sees one count per range. An empty table gives an empty one.
    """
    keys = list(keys)
    scratch = Scratch(df.sparkSession, "positions")
    spread = scratch.save(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "spread")
    inside = Window.partitionBy(*keys, "_part").orderBy(*order)
    numbered = spread.withColumn("_at", F.row_number().over(inside))
    sizes = spread.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    if keys:
        before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        ahead = sizes.select(*keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    else:
        total, rows = 0, []
        for part, n in sorted((r["_part"], r["_n"]) for r in sizes.collect()):  # one row per range
            rows.append((part, total))
            total += n
        ahead = df.sparkSession.createDataFrame(rows, "_part int, _ahead bigint")
    placed = numbered.join(ahead, same(numbered, ahead, [*keys, "_part"]))
    return placed.select(*[numbered[c] for c in df.columns], (F.col("_at") + F.col("_ahead")).cast("bigint").alias(name))
