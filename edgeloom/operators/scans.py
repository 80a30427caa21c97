"""Ordered per-key scans that stay parallel when one key holds most rows.

A plain ``Window.partitionBy(key)`` sends a whole key to one task. Here keys with
more than ``hot_rows`` rows are cut into chunks along their integer order column:
windows run inside a chunk, each chunk is reduced to one carry row, the carries
are scanned per key, and the result is joined back on (key, chunk). Other keys
keep a single chunk and cost what a plain window costs. The answers are equal.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.session import Scratch

HOT_ROWS = 1_000_000
CHUNK_ROWS = 65_536


def chunked(df: DataFrame, keys: Sequence[str], order: str, hot_rows: int = HOT_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Adds ``_chunk``: blocks of about ``chunk_rows`` rows along the order column for hot keys, 0 for the others.

    The bounds of the blocks are order statistics that Spark samples when it deals the hot rows into ranges, so blocks
    are alike however the order column is spread. The hot rows are written, which keeps the blocks as they are. Keys are
    counted by a job of its own; without hot keys the rows go on as they came.
    """
    scratch = Scratch(df.sparkSession, "chunks")
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > hot_rows)
    hot, n_hot = scratch.save_counted(sizes, "hot")
    plain = F.lit(0).cast("bigint")
    if not n_hot:
        return df.withColumn("_chunk", plain)
    names = hot.select(*[F.col(k).alias(f"_hot_{k}") for k in keys])
    is_hot = F.lit(True)
    for k in keys:
        is_hot = is_hot & df[k].eqNullSafe(names[f"_hot_{k}"])
    blocks = max(1, -(-hot.agg(F.sum("_n")).first()[0] // chunk_rows))
    dealt = df.join(names, is_hot, "left_semi").repartitionByRange(blocks, *keys, order)
    dealt = scratch.save(dealt.withColumn("_chunk", F.spark_partition_id().cast("bigint")), "dealt")
    return dealt.unionByName(df.join(names, is_hot, "left_anti").withColumn("_chunk", plain))


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    prev: dict[str, str] | None = None,
    running: dict[str, Column] | None = None,
    last_before: dict[str, Column] | None = None,
    hot_rows: int = HOT_ROWS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add scan columns to ``df``; ``order`` is an integer column, unique inside a key.

    prev         value of a column on the previous row of the key (null first)
    running      inclusive running sum of an expression
    last_before  last non-null value of an expression on strictly earlier rows
    """
    prev, running, last_before = prev or {}, running or {}, last_before or {}
    keys = list(keys)
    local = Window.partitionBy(*keys, "_chunk").orderBy(order)
    earlier = local.rowsBetween(Window.unboundedPreceding, -1)
    rows = chunked(df, keys, order, hot_rows, chunk_rows)
    rows = rows.withColumns({f"_r_{n}": e.cast("bigint") for n, e in running.items()} | {f"_l_{n}": e for n, e in last_before.items()})

    tails = [F.max_by(F.struct(F.col(c).alias("v")), order).alias(f"_tp_{n}") for n, c in prev.items()]
    tails += [F.sum(f"_r_{n}").alias(f"_tr_{n}") for n in running]
    tails += [F.max_by(f"_l_{n}", F.when(F.col(f"_l_{n}").isNotNull(), F.col(order))).alias(f"_tl_{n}") for n in last_before]
    across = Window.partitionBy(*keys).orderBy("_chunk")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        rows.groupBy(*keys, "_chunk")
        .agg(*tails)
        .select(
            *keys,
            "_chunk",
            *[F.lag(f"_tp_{n}").over(across).alias(f"_cp_{n}") for n in prev],
            *[F.coalesce(F.sum(f"_tr_{n}").over(before), F.lit(0)).alias(f"_cr_{n}") for n in running],
            *[F.last(f"_tl_{n}", ignorenulls=True).over(before).alias(f"_cl_{n}") for n in last_before],
        )
    )
    scanned = rows.withColumns(
        {f"_p_{n}": F.lag(F.struct(F.col(c).alias("v"))).over(local) for n, c in prev.items()}
        | {f"_s_{n}": F.sum(f"_r_{n}").over(local.rowsBetween(Window.unboundedPreceding, 0)) for n in running}
        | {f"_b_{n}": F.last(f"_l_{n}", ignorenulls=True).over(earlier) for n in last_before}
    ).join(carry, [*keys, "_chunk"])
    return scanned.select(
        *df.columns,
        *[F.coalesce(f"_p_{n}", f"_cp_{n}")["v"].alias(n) for n in prev],
        *[(F.col(f"_s_{n}") + F.col(f"_cr_{n}")).alias(n) for n in running],
        *[F.coalesce(f"_b_{n}", f"_cl_{n}").alias(n) for n in last_before],
    )


def streaks(df: DataFrame, keys: Sequence[str], order: str, value: str, hot_rows: int = HOT_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Counts along each key, where a null ``value`` resets.

    streak  rows in a row with this value up to here
    runs    changes of value since the last reset (a repeat in a row counts once)
    rows    rows since the last reset

    All three are 0 on a reset row.
    """
    keys = list(keys)
    local = Window.partitionBy(*keys, "_chunk").orderBy(order)
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    v, filled = F.col(value), F.col(value).isNotNull()
    since = lambda total, mark: F.col(total) - F.coalesce(F.last(F.when(mark, F.col(total)), ignorenulls=True).over(upto), F.lit(0))
    rows = (
        chunked(df, keys, order, hot_rows, chunk_rows)
        .withColumn("_same", F.coalesce(F.lag(v).over(local) == v, F.lit(False)))
        .withColumn("_start", filled & ~F.col("_same"))
        .withColumns(
            {
                "_nn": F.sum(filled.cast("bigint")).over(upto),
                "_ss": F.sum(F.col("_start").cast("bigint")).over(upto),
                "_seg": F.sum((~filled).cast("bigint")).over(upto),
            }
        )
        .withColumns(
            {
                "_rows": F.when(filled, since("_nn", ~filled)).otherwise(0),
                "_runs": F.when(filled, since("_ss", ~filled)).otherwise(0),
                "_streak": F.when(filled, since("_nn", F.col("_start")) + 1).otherwise(0),
                "_lead": filled & (F.col("_ss") == 1) & (F.col("_seg") == 0),
            }
        )
    )
    tail = lambda c: F.max_by(c, order).alias(c)
    chunks = rows.groupBy(*keys, "_chunk").agg(
        F.min_by(F.struct(v.alias("v")), order)["v"].alias("_first"), F.max_by(F.struct(v.alias("v")), order)["v"].alias("_final"),
        F.bool_or(~filled).alias("_reset"), F.bool_and("_lead").alias("_one_run"), tail("_rows"), tail("_runs"), tail("_streak"),
    )
    across = Window.partitionBy(*keys).orderBy("_chunk")
    so_far = across.rowsBetween(Window.unboundedPreceding, 0)
    joined = F.coalesce(F.lag("_final").over(across) == F.col("_first"), F.lit(False))
    chunks = chunks.withColumn("_joined", joined).withColumns(
        {
            "_gr": F.sum(F.col("_reset").cast("int")).over(so_far),
            "_gs": F.sum((~(F.col("_one_run") & F.col("_joined"))).cast("int")).over(so_far),
            "_add": F.col("_runs") - (F.col("_joined") & ~F.col("_reset")).cast("bigint"),
        }
    )
    in_reset = Window.partitionBy(*keys, "_gr").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, 0)
    in_run = Window.partitionBy(*keys, "_gs").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, 0)
    chunks = chunks.withColumns(
        {"_xr": F.sum("_rows").over(in_reset), "_xn": F.sum("_add").over(in_reset), "_xs": F.sum("_streak").over(in_run)}
    )
    into = lambda c: F.coalesce(F.lag(c).over(across), F.lit(0))
    carry = chunks.select(*keys, "_chunk", "_joined", into("_xr").alias("_cr"), into("_xn").alias("_cn"), into("_xs").alias("_cs"))
    open_start = filled & (F.col("_seg") == 0)
    return rows.join(carry, [*keys, "_chunk"]).select(
        *df.columns,
        (F.col("_streak") + F.when(F.col("_lead") & F.col("_joined"), F.col("_cs")).otherwise(0)).alias("streak"),
        (F.col("_runs") + F.when(open_start, F.col("_cn") - F.col("_joined").cast("bigint")).otherwise(0)).alias("runs"),
        (F.col("_rows") + F.when(open_start, F.col("_cr")).otherwise(0)).alias("rows"),
    )
