"""Prefix tree of conversations as a z-fast trie.

A conversation is a string of turns; a prefix is known by a 128-bit number. Compacted nodes are rows of one table, each
with the edge above it. A node's handle is the prefix whose length is the two-fattest number of its edge. A conversation
finds its exit node by fat binary search: the two-fattest length of the interval left is looked up among the handles, so
some log2(length) equi joins place all conversations at once. They are inserted in batches: of all that leave the trie at
one place by one turn, one enters and the rest search again, which takes about log2(conversations) batches. At last sums
over subtrees go up by doubled ancestor pointers and the edges are expanded to one row per prefix.

Strings are cut into segments of SEGMENT turns, each a string of a trie of its own below the node where the one before
ends. So no row holds a whole conversation, however long, and copies of a segment are one string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from edgeloom.llm.words import mix, run_hashes
from edgeloom.session import Scratch

SEGMENT = 1024
IDS_PER_CHUNK = 4096
_WORD = r"[^ \t\n\x0B\f\r]+"
_LANES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_ROOT = bytes(16)
_TURNS = "array<struct<sig: binary, words: bigint>>"
NODE = f"sig binary, parent binary, base long, top int, edge {_TURNS}"


def _numbered(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, pos (from 1), a, b, words: turns in order; a conversation of any length is spread over range partitions."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    words = F.regexp_count(text, F.lit(_WORD)).cast("long")
    slim = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"),
        F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit("second"), text, role).alias("b"), words.alias("words"),
    )
    slim = scratch.save(slim, "turns").withColumn("copy", F.monotonically_increasing_id())
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "a", "b", "copy"]
    spread = scratch.save(slim.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "spread")
    inside = Window.partitionBy("conv_id", "part").orderBy(*order[1:])
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = spread.groupBy("conv_id", "part").agg(F.count("*").alias("n")).select("conv_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    numbered = spread.withColumn("at", F.row_number().over(inside)).join(ahead, ["conv_id", "part"])
    return scratch.save(numbered.select("conv_id", (F.col("at") + F.col("ahead")).alias("pos"), "a", "b", "words"), "numbered")


def plain_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) as they stand: conv_id, depth, a, b, words; and conv_id, length."""
    scratch = Scratch(turns.sparkSession, "prefix-trie-turns")
    numbered = _numbered(turns, scratch)
    return numbered.withColumnRenamed("pos", "depth"), numbered.groupBy("conv_id").agg(F.max("pos").alias("length"))


def rebuilt_turns(turns: DataFrame, family: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) after each conversation c took the first crc32(c) % heads turns of conversation c - c % family."""
    scratch = Scratch(turns.sparkSession, "prefix-trie-turns")
    numbered = _numbered(turns, scratch)
    base = F.col("conv_id") - F.col("conv_id") % family
    convs = numbered.groupBy("conv_id").agg(F.max("pos").alias("n")).withColumns({"head": F.crc32(F.col("conv_id").cast("string")) % heads, "base": base})
    first = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = convs.join(first, "base", "left").withColumn("taken", F.least("head", F.coalesce("n_base", F.lit(0))))
    length = F.col("taken") + F.greatest(F.col("n") - F.col("head"), F.lit(0))
    convs = scratch.save(convs.select("conv_id", "base", "head", "taken", length.alias("length")), "convs")
    opening = numbered.where(F.col("pos") < heads).withColumnRenamed("conv_id", "base").withColumnRenamed("pos", "depth")
    taken = convs.select("conv_id", "base", "taken").join(opening, "base").where("depth <= taken").select("conv_id", "depth", "a", "b", "words")
    own = numbered.join(convs.select("conv_id", "head", "taken"), "conv_id").where("pos > head")
    own = own.select("conv_id", (F.col("pos") - F.col("head") + F.col("taken")).alias("depth"), "a", "b", "words")
    return scratch.save(taken.union(own), "rebuilt"), convs.select("conv_id", "length")


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments with symbol lists a, b to segments with the number of every prefix and the words up to it."""
    for batch in batches:
        lists = {c: batch.column(c) for c in ("a", "b", "words")}
        offsets = np.asarray(lists["a"].offsets, np.int64)
        offsets, low = offsets - offsets[0], offsets[0]
        n, sizes = int(offsets[-1]), np.diff(offsets)
        flat = {c: np.asarray(x.values, np.int64)[low : low + n] for c, x in lists.items()}
        start, end = np.repeat(offsets[:-1], sizes), np.arange(1, n + 1)
        lanes = []
        for name, root, step in zip("ab", ("root_a", "root_b"), _LANES):
            above = np.asarray(batch.column(root), np.int64).view(np.uint64)
            lanes.append(mix(run_hashes(flat[name].view(np.uint64), start, end, step) + np.repeat(above, sizes)))
        sigs = np.stack(lanes, axis=1).tobytes()
        total = np.r_[0, np.cumsum(flat["words"])]
        words = total[end] - total[start] + np.repeat(np.asarray(batch.column("words_before"), np.int64), sizes)
        sig = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * 16).astype(np.int32)), pa.py_buffer(sigs)])
        turns = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([sig, pa.array(words)], ["sig", "words"]))
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("seg"), turns], ["conv_id", "seg", "turns"])


def _segments(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, seg, turns, top: a string of at most SEGMENT prefixes and the number of the node it hangs from."""
    seg = F.floor((F.col("depth") - 1) / SEGMENT).cast("int")
    items = F.sort_array(F.collect_list(F.struct("depth", "a", "b", "words")))
    cut = turns.withColumn("seg", seg).groupBy("conv_id", "seg").agg(items.alias("t"))
    cut = cut.select("conv_id", "seg", F.col("t.a").alias("a"), F.col("t.b").alias("b"), F.col("t.words").alias("words"))
    above = Window.partitionBy("conv_id").orderBy("seg")
    before = above.rowsBetween(Window.unboundedPreceding, -1)
    digest = lambda *salt: F.coalesce(F.sum(F.xxhash64(*salt, "seg", "a", "b").cast("decimal(20,0)")).over(before), F.lit(0))
    words = F.aggregate("words", F.lit(0).cast("long"), lambda x, y: x + y)
    sums = cut.withColumns({"x": digest(), "y": digest(F.lit("second")), "words_before": F.coalesce(F.sum(words).over(before), F.lit(0))})
    rooted = sums.withColumns({"root_a": F.xxhash64("x", "y"), "root_b": F.xxhash64("y", "x", "seg")}).drop("x", "y")
    signed = rooted.mapInArrow(_signatures, f"conv_id long, seg int, turns {_TURNS}")
    last = F.lag(F.element_at("turns", -1)["sig"]).over(above)
    return scratch.save(signed.withColumn("top", F.coalesce(last, F.lit(bytearray(_ROOT)))), "segments")


def _two_fattest(low: str, high: str) -> str:
    """SQL of the number in (low, high] that the greatest power of two divides."""
    return f"({high} & shiftleft(-1, length(bin({low} ^ {high})) - 1))"


def _locate(waiting: DataFrame, nodes: DataFrame, steps: int) -> DataFrame:
    """Adds node (its number; null: the segment's top), and met: how many of its turns lead there from the top.

    ``met`` ends inside the node's edge, or at the node when no child of it goes on with the string's next turn.
    """
    handle = F.expr(f"edge[{_two_fattest('top', '(top + size(edge))')} - top - 1].sig")
    handles = nodes.select(handle.alias("probe"), F.col("sig").alias("hit"), (F.col("top") + F.size("edge")).alias("hit_at"))
    spread = F.xxhash64("conv_id", "seg").cast("string").cast("binary")  # no such number: searches that ended stay spread
    at = waiting.withColumns({"low": F.lit(0), "high": F.size("turns"), "node": F.lit(None).cast("binary")})
    for _ in range(steps):
        f = F.when(F.expr("low < high"), F.expr(f"turns[greatest({_two_fattest('low', 'high')}, 1) - 1].sig")).otherwise(spread)
        tried = at.withColumn("probe", f).join(handles, "probe", "left").drop("probe")
        found = F.col("hit").isNotNull()
        missed = F.when(F.expr("low < high"), F.expr(f"{_two_fattest('low', 'high')} - 1")).otherwise(F.col("high"))
        at = tried.withColumns({"node": F.coalesce("hit", "node"), "high": F.when(found, F.col("high")).otherwise(missed), "low": F.coalesce("hit_at", "low")}).drop("hit", "hit_at")
    on_path = F.expr("node is null or (low <= size(turns) and turns[greatest(low, 1) - 1].sig = node)")
    goes_on = F.expr("low < size(turns)")
    by_first = nodes.select(F.col("edge")[0]["sig"].alias("next"), F.col("sig").alias("child"))
    at = at.withColumn("next", F.when(on_path & goes_on, F.expr("turns[least(low, size(turns) - 1)].sig")).otherwise(spread))
    at = at.join(by_first, "next", "left").withColumns({"node": F.coalesce("child", "node"), "whole": on_path & F.col("child").isNull()})
    edges = nodes.select(F.col("sig").alias("edge_of"), "top", "edge")
    key = F.when(F.col("whole"), spread).otherwise(F.col("node"))
    at = at.withColumn("edge_of", key).join(edges, "edge_of", "left")
    same = F.expr("size(filter(sequence(1, least(size(turns) - top, size(edge))), i -> turns[top + i - 1].sig = edge[i - 1].sig))")
    met = F.when(F.col("whole"), F.col("low")).otherwise(F.col("top") + same)
    return at.select("conv_id", "seg", "above", "turns", "node", "whole", met.alias("met"))


def _cut_edges(nodes: DataFrame, cuts: DataFrame) -> DataFrame:
    """Nodes with their edges cut at the given depths (node, depths)."""
    joined = nodes.join(cuts.withColumnRenamed("node", "sig"), "sig", "left")
    bounds = "array_sort(array_union(array(top, top + size(edge)), coalesce(depths, array())))"
    pieces = joined.withColumn("b", F.expr(bounds)).withColumn("i", F.explode(F.expr("sequence(1, size(b) - 1)")))
    pieces = pieces.withColumns({"from": F.expr("b[i - 1]"), "to": F.expr("b[i]")})
    return pieces.select(
        F.expr("edge[`to` - top - 1].sig").alias("sig"), F.expr("case when i = 1 then parent else edge[`from` - top - 1].sig end").alias("parent"),
        "base", F.col("from").alias("top"), F.expr("slice(edge, `from` - top + 1, `to` - `from`)").alias("edge"),
    )


def build(segments: DataFrame, scratch: Scratch) -> DataFrame:
    """Compacted nodes of all distinct segments: sig, parent, base (turns above the segment), top (parent's depth in it), edge."""
    last = F.element_at("turns", -1)["sig"]
    one = F.min_by(F.struct("conv_id", "turns"), "conv_id").alias("one")
    waiting = segments.groupBy("seg", F.col("top").alias("above"), last.alias("last")).agg(one)
    waiting = waiting.select("seg", "above", "one.*")
    waiting, left = scratch.save_counted(waiting, "waiting0")
    longest = waiting.agg(F.max(F.size("turns"))).first()[0] or 0
    nodes, batch = scratch.spark.createDataFrame([], NODE), 0
    while left:
        found = waiting.withColumns({"node": F.lit(None).cast("binary"), "whole": F.lit(True), "met": F.lit(0)}) if batch == 0 else _locate(waiting, nodes, int(longest).bit_length())
        found = scratch.save(found, f"found{batch}")
        going = found.where(F.col("met") < F.size("turns")).withColumn("next", F.expr("turns[met].sig"))
        entry = F.min_by(F.struct("conv_id", "seg", "above", "turns", "met"), F.xxhash64("conv_id", "seg"))
        chosen = scratch.save(going.groupBy("next").agg(entry.alias("e")).select("e.*"), f"chosen{batch}")
        leaves = chosen.select(
            F.element_at("turns", -1)["sig"].alias("sig"), F.expr("case when met = 0 then above else turns[met - 1].sig end").alias("parent"),
            (F.col("seg") * F.lit(SEGMENT).cast("long")).alias("base"), F.col("met").alias("top"), F.expr("slice(turns, met + 1, size(turns) - met)").alias("edge"),
        )
        cuts = found.where("not whole").groupBy("node").agg(F.collect_set("met").alias("depths"))  # fewer than SEGMENT of an edge
        nodes = scratch.save(_cut_edges(nodes, cuts).union(leaves), f"nodes{batch}")
        rest = going.join(chosen.select("conv_id", "seg"), ["conv_id", "seg"], "left_anti").select("conv_id", "seg", "above", "turns")
        batch += 1
        waiting, left = scratch.save_counted(rest, f"waiting{batch}")
    return nodes


def _id_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (sig, conv_id) in order to rows (sig, first conv_id, ids joined by commas) of at most IDS_PER_CHUNK ids."""
    sig, ids, out = None, [], ([], [], [])

    def close() -> None:
        if ids:
            for held, x in zip(out, (sig, ids[0], ",".join(map(str, ids)))):
                held.append(x)
            ids.clear()

    def flush() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], ["sig", "first", "ids"])
        for held in out:
            held.clear()
        return made

    for batch in batches:
        for s, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if s != sig or len(ids) == IDS_PER_CHUNK:
                close()
                sig = s
            ids.append(c)
        if out[0]:
            yield flush()
    close()
    if out[0]:
        yield flush()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in order to (sig, lowercase hex of SHA-256), one chunk in memory at a time."""
    sig, state = None, None
    for batch in batches:
        done: tuple[list, list] = ([], [])
        for s, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if s != sig:
                if state is not None:
                    done[0].append(sig)
                    done[1].append(state.hexdigest())
                sig, state = s, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        if done[0]:
            yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.binary()), pa.array(done[1], pa.string())], ["sig", "sha"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([sig], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["sig", "sha"])


def _ends_digest(ends: DataFrame, scratch: Scratch) -> DataFrame:
    """(sig, sha): ids of the conversations that end at a node. Ids of one node are chunked by many tasks before one task digests its chunks."""
    spread = ends.repartitionByRange("sig", "conv_id").sortWithinPartitions("sig", "conv_id")
    chunks = scratch.save(spread.mapInArrow(_id_chunks, "sig binary, first long, ids string"), "chunks")
    gathered = chunks.repartition("sig").sortWithinPartitions("sig", "first").select("sig", "ids")
    return gathered.mapInArrow(_digests, "sig binary, sha string")


def _subtree_sums(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds to each node the sums of its subtree: after k rounds over all nodes less than 2 ** k edges below."""
    sums = {c: F.sum(c).alias(f"{c}_more") for c in ("n", "leaves", "through", "below")}
    table, left = scratch.save_counted(nodes.select("sig", F.col("parent").alias("ancestor"), "n", "least", "leaves", "through", "below"), "sums0", F.col("ancestor").isNotNull())
    step = 0
    while left:
        step += 1
        more = table.where("ancestor is not null").groupBy("ancestor").agg(F.min("least").alias("least_more"), *sums.values()).withColumnRenamed("ancestor", "sig")
        jump = table.where("ancestor is not null").select(F.col("sig").alias("ancestor"), F.col("ancestor").alias("next"))
        added = table.join(more, "sig", "left").join(jump, "ancestor", "left")
        plus = [(F.col(c) + F.coalesce(f"{c}_more", F.lit(0))).alias(c) for c in sums]
        table, left = scratch.save_counted(added.select("sig", F.col("next").alias("ancestor"), F.least("least", "least_more").alias("least"), *plus), f"sums{step}", F.col("ancestor").isNotNull())
    return table.drop("ancestor")


def trie_nodes(strings: tuple[DataFrame, DataFrame]) -> DataFrame:
    """One row per distinct prefix: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``strings`` are (conv_id, depth from 1, a, b, words) and (conv_id, length) as ``rebuilt_turns`` or ``plain_turns``
    give them. conv_id is the smallest member of the node, that of the parent is null at the root; saved_tokens sums
    (members - 1) * words of the last turn over the subtree; ends_sha256 is the digest of the ids that end there.

    Null roles and texts are empty. Turns are ordered by turn, null first, equal turns by role and then by a number of
    the text; repeated rows are turns of their own. Rows without conv_id are left out. Other columns are not read. An
    empty table gives an empty result, without a root. Texts of any length are read once and not kept; conversations of
    any length and any number of copies are spread over tasks.
    """
    turns, convs = strings
    spark = turns.sparkSession
    scratch = Scratch(spark, "prefix-trie")
    segments = _segments(turns, scratch)
    nodes = build(segments, scratch)

    end_seg = F.floor((F.col("length") - 1) / SEGMENT).cast("int")
    tails = segments.select("conv_id", "seg", F.element_at("turns", -1).alias("tail"))
    ends = convs.withColumn("seg", F.when(F.col("length") > 0, end_seg)).join(tails, ["conv_id", "seg"], "left")
    ends = scratch.save(ends.select("conv_id", F.coalesce("tail.sig", F.lit(bytearray(_ROOT))).alias("sig"), F.coalesce("tail.words", F.lit(0).cast("long")).alias("words")), "ends")
    at_end = ends.groupBy("sig").agg(F.count("*").alias("n"), F.min("conv_id").alias("least"), F.sum("words").alias("through"))

    children = nodes.groupBy(F.col("parent").alias("sig")).agg(F.count("*").alias("children"))
    root = ends.select(F.lit(bytearray(_ROOT)).alias("sig")).distinct().select("sig", F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("base"), F.lit(0).alias("top"), F.expr(f"cast(array() as {_TURNS})").alias("edge"))
    all_nodes = nodes.union(root).join(at_end, "sig", "left").join(children, "sig", "left").join(_ends_digest(ends.select("sig", "conv_id"), scratch), "sig", "left")
    words_at = F.expr("case when size(edge) > 0 then edge[size(edge) - 1].words else 0L end")
    all_nodes = all_nodes.select("sig", "parent", "base", "top", "edge", "n", "least", "through", "children", "sha", words_at.alias("words"))
    all_nodes = scratch.save(all_nodes, "all")
    above = all_nodes.select(F.col("sig").alias("parent"), F.col("words").alias("words_above"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    own = all_nodes.join(above, "parent", "left").select(
        "sig", "parent", zero("n").alias("n"), "least", F.when(zero("children") == 0, 1).otherwise(0).cast("long").alias("leaves"), zero("through").alias("through"), (F.col("words") - zero("words_above")).alias("below")
    )
    totals = scratch.save(_subtree_sums(own, scratch), "totals")
    full = all_nodes.select("sig", "parent", "base", "top", "edge", "children", "sha").join(totals, "sig")
    parents = all_nodes.select(F.col("sig").alias("parent"), F.col("words").alias("words_above")).join(totals.select(F.col("sig").alias("parent"), F.col("least").alias("parent_least")), "parent")
    full = full.join(parents, "parent", "left")

    before = "case when i = 1 then coalesce(words_above, 0) else edge[i - 2].words end"
    saved = f"through - n * ({before}) - (below - (({before}) - coalesce(words_above, 0)))"
    nothing = hashlib.sha256(b"").hexdigest()
    rows = full.where(F.size("edge") > 0).withColumn("i", F.explode(F.expr("sequence(1, size(edge))"))).withColumn("end", F.expr("i = size(edge)"))
    expanded = rows.select(
        F.col("least").alias("conv_id"), (F.col("base") + F.col("top") + F.col("i")).cast("long").alias("depth"), F.when(F.col("i") == 1, F.col("parent_least")).otherwise(F.col("least")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(F.col("end"), zero("children")).otherwise(1).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"), F.expr(saved).cast("long").alias("saved_tokens"),
        F.when(F.col("end"), F.coalesce("sha", F.lit(nothing))).otherwise(F.lit(nothing)).alias("ends_sha256"),
    )
    tops = full.where(F.size("edge") == 0).select(
        F.col("least").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.col("n").alias("n_convs"), zero("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), (F.col("through") - F.col("below")).cast("long").alias("saved_tokens"), F.coalesce("sha", F.lit(nothing)).alias("ends_sha256"),
    )
    return expanded.union(tops)


#: DuckDB: every prefix of every rebuilt conversation, its members, and sums over its extensions. crc32 is worked out bit by bit.
SQL = """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos
           FROM conversations WHERE conv_id IS NOT NULL),
c0 AS (SELECT conv_id, max(pos) AS n, list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i::INT, 1))::BIGINT) AS b FROM t GROUP BY conv_id),
c AS (SELECT conv_id, n, conv_id - conv_id % 20 AS base,
             xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda x, y: list_reduce(list_prepend(xor(x, y), [1::BIGINT, 2, 3, 4, 5, 6, 7, 8]), lambda z, k: xor(z >> 1, 3988292384 * (z & 1)))), 4294967295::BIGINT) % 4 AS h
      FROM c0),
k AS (SELECT c.conv_id, c.base, c.h, least(c.h, coalesce(o.n, 0)) AS taken FROM c LEFT JOIN c o ON o.conv_id = c.base),
turns AS (SELECT k.conv_id, pos AS depth, role, text FROM k JOIN t ON t.conv_id = k.base AND t.pos <= k.h
          UNION ALL SELECT k.conv_id, pos - h + taken, role, text FROM k JOIN t ON t.conv_id = k.conv_id AND t.pos > h),
marks AS (SELECT conv_id, depth, sha256(length(role)::VARCHAR || ':' || role || text) AS m, len(list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS words FROM turns),
p AS (SELECT conv_id, depth, words, string_agg(m, ' ') OVER (PARTITION BY conv_id ORDER BY depth) AS key FROM marks
      UNION ALL SELECT conv_id, 0, 0, '' FROM k),
size AS (SELECT conv_id, max(depth) AS d FROM p GROUP BY conv_id),
node AS (SELECT key, min(depth) AS depth, min(p.conv_id) AS conv_id, count(*) AS n_convs, min(words) AS words,
                sha256(coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (depth = d), '')) AS ends
         FROM p JOIN size USING (conv_id) GROUP BY key),
up AS (SELECT x.key, y.key AS above, y.depth AS above_depth, x.depth FROM node x JOIN p y ON y.conv_id = x.conv_id AND y.depth <= x.depth),
kids AS (SELECT above AS key, count(*) AS n_children FROM up WHERE above_depth = depth - 1 GROUP BY above),
below AS (SELECT above AS key, sum((n.n_convs - 1) * n.words) AS saved, count(*) FILTER (kids.key IS NULL) AS n_leaves FROM up JOIN node n ON n.key = up.key LEFT JOIN kids ON kids.key = up.key GROUP BY above)
SELECT node.conv_id, node.depth::BIGINT AS depth, o.conv_id AS parent_conv_id, node.n_convs::BIGINT AS n_convs, coalesce(kids.n_children, 0)::BIGINT AS n_children, below.n_leaves::BIGINT AS n_leaves,
       below.saved::BIGINT AS saved_tokens, node.ends AS ends_sha256
FROM node JOIN below USING (key) LEFT JOIN kids USING (key) LEFT JOIN up ON up.key = node.key AND up.above_depth = node.depth - 1 LEFT JOIN node o ON o.key = up.above
"""
