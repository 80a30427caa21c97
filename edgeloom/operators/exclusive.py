"""Compare-and-set states and leases over a table, where every answer depends on all earlier rows of a key.

States: a row is a map from the state before to the state after. Blocks of rows are composed into one map, blocks of
blocks again, and the states go down the same tree, so a key with all rows is worked on by as many tasks as it has
blocks. Leases: issues are followed row by row, many in a task. Of an issue with very many rows the row that takes effect
next after a row depends on that row alone; these pointers are doubled along the chain that starts at the first row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.functions import labels as L
from edgeloom.operators.ordering import positions
from edgeloom.operators.scans import HOT_ROWS, ordered_scan
from edgeloom.session import Scratch

BLOCK_ROWS = 64


def _code(state: Column) -> Column:
    """Place of a state in the list of states from 1; 0 for none."""
    return F.coalesce(F.array_position(F.array(*[F.lit(s) for s in L.STATES]), state), F.lit(0)).cast("int")


def state_changes(requests: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(seq, issue, verdict, current) of requests(seq, issue, want_from, state), seq unique inside an issue.

    A request moves its issue to ``state`` if ``want_from`` is empty or the current state; an issue starts without one.
    Verdicts: invalid_state, invalid_transition, conflict, no-op, moved. A null want_from is empty; a null state is
    invalid; rows of a null issue are one issue. Equal to the stream form over rows in the order of seq.
    """
    scratch = Scratch(requests.sparkSession, "state-changes")
    want, to = F.coalesce("want_from", F.lit("")), F.coalesce("state", F.lit(""))
    known = lambda c: c.isin(*L.STATES)
    early = (
        F.when(~known(to) | ((want != "") & ~known(want)), "invalid_state")
        .when((want != "") & (want != to) & ~L.valid_pair(want, to), "invalid_transition")
    )
    rows = requests.select("seq", "issue", _code(want).alias("w"), _code(to).alias("t"), early.alias("early"))
    placed = positions(rows, ["issue"], ["seq"]).withColumn("block", F.floor((F.col("pos") - 1) / block_rows))
    items = F.sort_array(F.collect_list(F.struct("pos", "seq", "w", "t", "early"))).alias("items")
    leaves = scratch.save(placed.groupBy("issue", "block").agg(items), "leaves")
    highest = leaves.agg(F.max("block")).first()[0]
    if highest is None:
        return requests.sparkSession.createDataFrame([], _answer(requests))
    n = len(L.STATES)
    step = "if(r.early is null and (r.w = 0 or s = r.w), r.t, s)"
    maps = leaves.select("issue", "block", F.expr(f"aggregate(items, sequence(0, {n}), (m, r) -> transform(m, s -> {step}))").alias("map"))
    levels: list[DataFrame] = []  # groups of child maps, the lowest first
    while highest > 0:
        group = F.sort_array(F.collect_list(F.struct("block", "map"))).alias("items")
        level = maps.withColumn("up", F.floor(F.col("block") / block_rows)).groupBy("issue", F.col("up").alias("above")).agg(group)
        level = scratch.save(level, f"level{len(levels)}")
        levels.append(level)
        maps = level.select("issue", F.col("above").alias("block"), F.expr(f"aggregate(items, sequence(0, {n}), (m, r) -> transform(m, s -> r.map[s]))").alias("map"))
        highest //= block_rows
    # The states before each block, from the top of the tree down.
    before = leaves.select("issue", F.lit(0).cast("bigint").alias("block"), F.lit(0).alias("start")).distinct()
    for i, level in reversed(list(enumerate(levels))):
        opened = _with_start(level, before)
        walk = "aggregate(items, struct(start as s, cast(array() as array<struct<block: bigint, start: int>>) as out), (a, r) -> struct(r.map[a.s] as s, concat(a.out, array(struct(r.block as block, a.s as start))) as out), a -> a.out)"
        before = scratch.save(opened.select("issue", F.explode(F.expr(walk)).alias("x")).select("issue", "x.block", "x.start"), f"before{i}")
    opened = _with_start(leaves.withColumnRenamed("block", "above"), before)
    after = step.replace(" s)", " a.s)").replace("s = r.w", "a.s = r.w")
    walk = (
        "aggregate(items, struct(start as s, cast(array() as array<struct<seq: bigint, w: int, t: int, early: string, s: int>>) as out), "
        f"(a, r) -> struct({after} as s, concat(a.out, array(struct(cast(r.seq as bigint) as seq, r.w as w, r.t as t, r.early as early, a.s as s))) as out), a -> a.out)"
    )
    each = opened.select("issue", F.explode(F.expr(walk)).alias("x")).select("issue", "x.*")
    names = F.array(F.lit(None).cast("string"), *[F.lit(s) for s in L.STATES])
    lost = (F.col("w") != 0) & (F.col("s") != F.col("w"))
    verdict = F.coalesce("early", F.when(lost, "conflict").when(F.col("s") == F.col("t"), "no-op").otherwise("moved"))
    current = F.when(verdict == "moved", F.col("t")).otherwise(F.col("s"))
    return each.select(F.col("seq").cast(requests.schema["seq"].dataType).alias("seq"), "issue", verdict.alias("verdict"), names[current].alias("current"))


def _answer(requests: DataFrame) -> str:
    return f"seq {requests.schema['seq'].dataType.simpleString()}, issue {requests.schema['issue'].dataType.simpleString()}, verdict string, current string"


def _with_start(groups: DataFrame, before: DataFrame) -> DataFrame:
    """Groups of blocks (issue, above, items) with the state before the first of them."""
    entry = before.select(F.col("issue").alias("b_issue"), F.col("block").alias("b_block"), "start")
    return groups.join(entry, groups["issue"].eqNullSafe(F.col("b_issue")) & (F.col("above") == F.col("b_block"))).select("issue", "items", "start")


def leases(ops: DataFrame, hot_rows: int = HOT_ROWS, **split) -> DataFrame:
    """(seq, issue, owner, op, outcome, holder, expires_s) of ops(seq, issue, owner, op, at_s, ttl_s).

    acquire is granted when the lease is free or expired, else denied; refresh works for the holder before expiry;
    release for the holder, or when nobody holds the lease. Rows are ordered by (at_s, seq), unique inside an issue;
    the answer is that of the stream form over rows in this order. A null at_s or ttl_s counts as 0; rows of a null issue
    are one issue.

    Issues of up to ``hot_rows`` rows are dealt to tasks whole and followed row by row. Those of more are split by
    :func:`_chained`, but for the null issue; both give the same answers.
    """
    sizes = ops.where("issue IS NOT NULL").groupBy("issue").agg(F.count("*").alias("n")).where(F.col("n") > hot_rows)
    hot, n_hot = Scratch(ops.sparkSession, "leases").save_counted(sizes.select(F.col("issue").alias("hot_issue")), "hot")
    if not n_hot:
        return _followed(ops)
    is_hot = ops["issue"] == hot["hot_issue"]
    return _followed(ops.join(hot, is_hot, "left_anti")).unionByName(_chained(ops.join(hot, is_hot, "left_semi"), hot_rows=hot_rows, **split))


def _followed(ops: DataFrame) -> DataFrame:
    """:func:`leases` in one pass over rows that stand in order inside their partition; a task holds one batch of them."""

    def follow(batches):
        import pyarrow as pa

        key, holder, expires = object(), "", 0
        for batch in batches:
            told = []
            for issue, owner, op, at, ttl in zip(*(batch.column(c).to_pylist() for c in ("issue", "owner", "op", "at", "ttl"))):
                if issue != key:
                    key, holder, expires = issue, "", 0
                if op == "acquire":
                    outcome = "denied" if holder and at < expires else "granted"
                elif op == "refresh":
                    outcome = "not_held" if not holder else "owner_mismatch" if holder != owner else "expired" if at >= expires else "refreshed"
                else:
                    outcome = "owner_mismatch" if holder and holder != owner else "released"
                if outcome in ("granted", "refreshed"):
                    holder, expires = owner, at + ttl
                elif outcome == "released":
                    holder, expires = "", at
                told.append((outcome, holder, expires))
            outcomes, holders, ends = zip(*told) if told else ((), (), ())
            kept = [batch.column(c) for c in ("seq", "issue", "owner", "op")]
            more = [pa.array(outcomes, pa.string()), pa.array(holders, pa.string()), pa.array(ends, pa.int64())]
            yield pa.RecordBatch.from_arrays(kept + more, ["seq", "issue", "owner", "op", "outcome", "holder", "expires_s"])

    slim = ops.select("seq", "issue", "owner", "op", F.coalesce("at_s", F.lit(0)).cast("bigint").alias("at"), F.coalesce("ttl_s", F.lit(0)).cast("bigint").alias("ttl"))
    kind = lambda c: ops.schema[c].dataType.simpleString()
    schema = f"seq {kind('seq')}, issue {kind('issue')}, owner string, op string, outcome string, holder string, expires_s bigint"
    return slim.repartition("issue").sortWithinPartitions("issue", "at", "seq").mapInArrow(follow, schema)


def _chained(ops: DataFrame, **split) -> DataFrame:
    """:func:`leases` for issues of any size, none of them null.

    After a row that took effect the lease is known from that row alone: its owner until at_s + ttl_s, or free. So each
    row points to the next one that would take effect, the earliest of: the first acquire at or after the expiry, the
    owner's next refresh before it, the owner's next release. The rows that did take effect are those on the pointer
    chain of the first acquire or release; the chain is marked by doubling the pointers. ``split`` goes to the scans.
    """
    spark = ops.sparkSession
    scratch = Scratch(spark, "leases")
    slim = ops.select("seq", "issue", "owner", "op", F.coalesce("at_s", F.lit(0)).cast("bigint").alias("at"), F.coalesce("ttl_s", F.lit(0)).cast("bigint").alias("ttl"))
    rows = scratch.save(positions(slim, ["issue"], ["at", "seq"]).withColumn("expires", F.col("at") + F.col("ttl")), "rows")
    takes = F.col("op").isin("acquire", "refresh")
    frees = F.col("op") == "release"
    at_pos = lambda mark: F.when(mark, F.col("pos"))

    # The owner's next refresh and release. Scans look back, so the order is turned round.
    own = ordered_scan(
        rows.select("issue", "owner", "pos", "op", "at", "expires", (-F.col("pos")).alias("back")), ["issue", "owner"], "back",
        last_before={"refresh": F.when(F.col("op") == "refresh", F.struct("pos", "at")), "release": at_pos(frees)}, **split,
    )
    # The first acquire at or after the expiry: probes stand in one order with the acquires, right after their own row
    # when they expire at once. Behind a release, whoever acquires or releases next takes effect.
    later = F.col("expires") > F.col("at")
    probe = rows.where(takes).select("issue", F.when(later, F.col("expires")).otherwise(F.col("at")).alias("time"), F.when(later, F.lit(0)).otherwise(F.col("pos")).alias("behind"), F.lit(1).alias("kind"), "pos")
    mark = rows.where(F.col("op") == "acquire").select("issue", F.col("at").alias("time"), F.col("pos").alias("behind"), F.lit(0).alias("kind"), "pos")
    line = positions(probe.unionByName(mark), ["issue"], ["time", "behind", "kind", "pos"], "place")
    found = ordered_scan(line.select("issue", "pos", "kind", (-F.col("place")).alias("back")), ["issue"], "back", last_before={"acquire": F.when(F.col("kind") == 0, F.col("pos"))}, **split)
    found = found.where("kind = 1").select("issue", "pos", "acquire")
    open_next = ordered_scan(rows.select("issue", "pos", "op", (-F.col("pos")).alias("back")), ["issue"], "back", last_before={"next_open": at_pos(F.col("op").isin("acquire", "release"))}, **split)
    refresh = F.when(F.col("refresh.at") < F.col("expires"), F.col("refresh.pos"))
    held = own.where(takes).join(found, ["issue", "pos"], "left").select("issue", "pos", F.least("acquire", refresh, "release").alias("next"))
    freed = open_next.where(frees).select("issue", "pos", F.col("next_open").alias("next"))
    jump = scratch.save(held.unionByName(freed), "jump0")

    first = rows.where(F.col("op").isin("acquire", "release")).groupBy("issue").agg(F.min("pos").alias("pos"))
    marked, new = scratch.save_counted(first, "marked0")
    names, k = ["marked0"], 0
    while new:
        # All marked rows jump as far as the pointers reach; the marked stretch of each chain doubles.
        reached = scratch.read_many(names, first).join(jump, ["issue", "pos"]).where("next is not null").select("issue", F.col("next").alias("pos"))
        k += 1
        _, new = scratch.save_counted(reached, f"marked{k}")
        names.append(f"marked{k}")
        if new:
            far = jump.select("issue", F.col("pos").alias("next"), F.col("next").alias("after"))
            jump = scratch.save(jump.where("next is not null").join(far, ["issue", "next"]).select("issue", "pos", F.col("after").alias("next")), f"jump{k}")
    took = scratch.read_many(names, first).select("issue", "pos", F.lit(True).alias("took"))

    acted = rows.join(took, ["issue", "pos"], "left").withColumn("took", F.coalesce("took", F.lit(False)))
    state = F.struct(F.when(frees, "").otherwise(F.col("owner")).alias("holder"), F.when(frees, F.col("at")).otherwise(F.col("expires")).alias("expires"))
    told = ordered_scan(acted, ["issue"], "pos", last_before={"before": F.when(F.col("took"), state)}, **split)
    holder, until = F.coalesce("before.holder", F.lit("")), F.coalesce("before.expires", F.lit(0).cast("bigint"))
    done = F.when(frees, "released").when(F.col("op") == "refresh", "refreshed").otherwise("granted")
    refused = F.when(F.col("op") == "acquire", "denied").when(frees, "owner_mismatch").when(holder == "", "not_held").when(holder != F.col("owner"), "owner_mismatch").otherwise("expired")
    return told.select(
        "seq", "issue", "owner", "op", F.when(F.col("took"), done).otherwise(refused).alias("outcome"),
        F.when(F.col("took"), state["holder"]).otherwise(holder).alias("holder"), F.when(F.col("took"), state["expires"]).otherwise(until).alias("expires_s"),
    )
