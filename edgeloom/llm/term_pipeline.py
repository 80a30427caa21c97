"""Ranked search by pipelined term partitioning.

Terms are dealt to owners by falling weight, each owner with about twice the postings of the one before. Bundles of items
visit the owners in turn: a stage cogroups the sparse accumulators of a bundle and a shard of documents with the owner's
postings of that shard, adds the integer contributions and passes on. After every stage the 50th best sum of an item so
far bounds its result from below, and what the later owners can add at most bounds every document from above: sums that
can't reach the result any more are not passed on. All that can reach it stay, so the final selection is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from edgeloom.llm.long_texts import text_parts
from edgeloom.llm.words import LOWER, run_hashes
from edgeloom.session import Scratch

TERM = np.zeros(256, bool)
TERM[48:58] = TERM[65:91] = TERM[97:123] = TERM[128:] = True
TERM_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_STEP = 0x9E3779B97F4A7C15
TERMS_TO_SEND = 2_000_000  # numbers of item terms given to the tasks that read documents: 16 MB
OWNERS = 6
ITEMS_PER_BUNDLE = 200
SHARD_DOCS = 2048
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_ACCUMULATORS = "shard long, bundle int, slots array<int>, docs array<int>, sums array<long>, best_slots array<int>, best_sums array<long>"


def _terms(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number, start, end, part) of every term."""
    inside = TERM[data]
    opens, shuts = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    shuts[:-1] &= ~inside[1:]
    edges = bounds[(bounds > 0) & (bounds < len(data))]
    opens[edges] = inside[edges]
    shuts[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(shuts) + 1
    return run_hashes(data, start, end, _STEP), start, end, np.searchsorted(bounds, start, side="right") - 1


def _index(wanted: np.ndarray | None, doc_type: pa.DataType):
    """Postings of each shard of documents: a row for each of its terms (all terms without ``wanted``), and one for the shard."""

    def shard_rows(number: int, ids: pa.Array, lengths: np.ndarray, found: list[tuple[np.ndarray, ...]], texts: dict[int, str]) -> Iterator[pa.RecordBatch]:
        n = len(ids)
        head = pa.array([0, n], pa.int32())
        rows = pa.RecordBatch.from_arrays(
            [
                pa.array([number], pa.int64()), pa.array([None], pa.string()), pa.array([None], pa.list_(pa.int32())), pa.array([None], pa.list_(pa.int32())),
                pa.ListArray.from_arrays(head, pa.array(lengths)), pa.ListArray.from_arrays(head, ids.cast(doc_type)),
            ],
            ["shard", "term", "docs", "counts", "lengths", "doc_ids"],
        )
        yield rows
        if not found:
            return
        docs, numbers, counts = (np.concatenate([f[i] for f in found]) for i in range(3))
        order = np.lexsort((docs, numbers))  # parts of one long text come as several rows of a document and term
        docs, numbers, counts = docs[order], numbers[order], counts[order]
        new = np.r_[True, (docs[1:] != docs[:-1]) | (numbers[1:] != numbers[:-1])]
        counts = np.add.reduceat(counts, np.flatnonzero(new))
        docs, numbers = docs[new], numbers[new]
        first = np.flatnonzero(np.r_[True, numbers[1:] != numbers[:-1]])
        for a in range(0, len(first), 4096):
            some = first[a : a + 4096]
            end = first[a + 4096] if a + 4096 < len(first) else len(numbers)
            cuts = pa.array(np.r_[some, end] - some[0], pa.int32())
            part = slice(some[0], end)
            lists = [pa.ListArray.from_arrays(cuts, pa.array(x[part].astype(np.int32))) for x in (docs, counts)]
            own = pa.ListArray.from_arrays(cuts, pa.array(lengths[docs[part]]))
            none = pa.nulls(len(some), pa.list_(doc_type))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(some), number)), pa.array([texts[int(x)] for x in numbers[some]], pa.string()), *lists, own, none],
                ["shard", "term", "docs", "counts", "lengths", "doc_ids"],
            )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for whole in batches:
            for low in range(0, whole.num_rows, SHARD_DOCS):
                batch = whole.slice(low, SHARD_DOCS)
                lengths, found, texts = np.zeros(batch.num_rows, np.int64), [], {}
                for rows, data, bounds in text_parts(batch, ~TERM):
                    data = LOWER[data]
                    numbers, start, end, part = _terms(data, bounds)
                    np.add.at(lengths, rows, np.bincount(part, minlength=len(rows))[: len(rows)])
                    if wanted is not None and len(numbers):
                        at = np.minimum(np.searchsorted(wanted, numbers), len(wanted) - 1) if len(wanted) else None
                        keep = wanted[at] == numbers if at is not None else np.zeros(len(numbers), bool)
                        numbers, start, end, part = numbers[keep], start[keep], end[keep], part[keep]
                    if not len(numbers):
                        continue
                    order = np.lexsort((numbers, part))
                    n, p = numbers[order], part[order]
                    new = np.flatnonzero(np.r_[True, (n[1:] != n[:-1]) | (p[1:] != p[:-1])])
                    found.append((rows[p[new]], n[new], np.diff(np.r_[new, len(n)])))
                    unique, where = np.unique(numbers, return_index=True)
                    raw = data.tobytes()
                    for x, at in zip(unique.tolist(), where):
                        if x not in texts:
                            texts[x] = raw[start[at] : end[at]].decode("utf-8", "replace")
                yield from shard_rows(number, batch.column(0), lengths, found, texts)
                number += 1

    return work


def term_numbers(terms: list[str]) -> np.ndarray:
    """Sorted numbers of terms, as the index has them."""
    if not terms:
        return np.zeros(0, np.uint64)
    raw = [t.encode() for t in terms]
    ends = np.cumsum([len(r) for r in raw])
    data = np.frombuffer(b"".join(raw), np.uint8)
    return np.unique(run_hashes(data, ends - np.array([len(r) for r in raw]), ends, _STEP))


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term), each once; rows of one item_id are one item, those without an id none."""
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = F.regexp_extract_all(lowered, F.lit(TERM_PATTERN), F.lit(0))
    return items.where("item_id is not null and text is not null").select("item_id", F.explode(terms).alias("term")).distinct()


def _share(count: str, length: str, n: int, total: int) -> str:
    """SQL of (1000000000 tf) div (1000 tf + 20 m) with m = 100 - 50 + (50 n N) div L."""
    return f"((1000000000L * {count}) div (1000L * {count} + 20L * (50L + (50L * {length} * {n}L) div {total}L)))"


def _owner(weights: dict[int, int], owners: int) -> Column:
    """The stage of a weight: falling weights, postings about doubling from stage to stage."""
    total, seen, stage, out = sum(weights.values()), 0, 0, F.lit(owners - 1)
    limits = [total / 2 ** (owners - 1 - k) for k in range(owners)]
    lowest: dict[int, int] = {}
    for w in sorted(weights, reverse=True):
        while stage < owners - 1 and seen + weights[w] > limits[stage] and seen > 0:
            stage += 1
        lowest[stage] = w
        seen += weights[w]
    for stage in sorted(lowest, reverse=True):
        out = F.when(F.col("weight") >= lowest[stage], F.lit(stage)).otherwise(out)
    return out


def _add(top: int, n_docs: int, n_terms: int):
    """Adds an owner's contributions to the accumulators of one bundle and shard."""

    def work(key: tuple, tickets: pa.Table, postings: pa.Table) -> pa.Table:
        ticket = {c: tickets.column(c)[0] for c in tickets.column_names} if tickets.num_rows else None
        if ticket is None:
            return pa.table({f.name: pa.array([], f.type) for f in schema}, schema=schema)
        array = lambda name, kind: np.asarray(ticket[name].values.to_numpy(zero_copy_only=False) if ticket[name].is_valid else [], kind)
        rest_before, rest_after, least = array("rest_before", np.int64), array("rest_after", np.int64), array("least", np.int64)
        slots, docs, sums = array("slots", np.int64), array("docs", np.int64), array("sums", np.int64)
        items, width = len(least), int(ticket["n_docs"].as_py())
        table = np.zeros((items, width), np.int64)
        table[slots, docs] = sums
        active = (rest_before >= least) | np.isin(np.arange(items), slots)
        for k in range(postings.num_rows):
            mine = np.asarray(postings.column("item_slots")[k].values, np.int64)
            mine = mine[active[mine]]
            if not len(mine):
                continue
            at, tf, length = (np.asarray(postings.column(c)[k].values, np.int64) for c in ("docs", "counts", "lengths"))
            m = 50 + (50 * length * n_docs) // n_terms
            gain = int(postings.column("weight")[k].as_py()) * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
            table[np.ix_(mine, at)] += gain[None, :]
        if width > top:
            own = np.partition(table, width - top, axis=1)[:, width - top]
            floor = np.maximum(np.maximum(least, own), 1)
        else:
            floor = np.maximum(least, 1)
        slots, docs = np.nonzero((table > 0) & (table + rest_after[:, None] >= floor[:, None]))
        sums = table[slots, docs]
        order = np.lexsort((-sums, slots))
        first = np.searchsorted(slots[order], np.arange(items))
        place = np.arange(len(order)) - first[slots[order]]
        best = order[place < top]
        lists = [slots.astype(np.int32), docs.astype(np.int32), sums, slots[best].astype(np.int32), sums[best]]
        columns = [pa.array([x], pa.list_(pa.from_numpy_dtype(x.dtype))) for x in lists]
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([key[1].as_py()], pa.int32()), *columns], schema=schema)

    ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
    schema = pa.schema([("shard", pa.int64()), ("bundle", pa.int32()), ("slots", ints), ("docs", ints), ("sums", longs), ("best_slots", ints), ("best_sums", longs)])
    return work


def search(docs: DataFrame, items: DataFrame, top: int = 50, owners: int = OWNERS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``top`` documents of the greatest score above 0, ties by doc_id.

    Terms are maximal runs of ASCII letters, digits and all characters beyond ASCII, A-Z lower-cased. With N documents
    that hold a term, L terms in all and df documents of a term, its weight is floor(1000 ln((2N+2)/(2df+1))); a document
    of n terms, tf of them this one, adds weight * ((10^9 tf) div (1000 tf + 20 m)), m = 50 + (50 n N) div L.

    Null and empty texts hold no term. Every row of ``docs`` is a document, repeated ids as well; one without an id counts
    in N, L and df, but can't be named and is not ranked. Rows of one item_id are one item with the terms of all its
    texts; items without an id are left out. Equal scores of equal ids take any order. Other columns are not read; an
    empty table on either side gives an empty result. Texts of any length are read part by part.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "term-pipeline")
    from pyspark.sql.pandas.types import to_arrow_type

    asked = scratch.save(item_terms(items), "asked")
    vocabulary, n_vocabulary = scratch.save_counted(asked.select("term").distinct(), "vocabulary")
    wanted = term_numbers([r.term for r in vocabulary.collect()]) if n_vocabulary <= TERMS_TO_SEND else None
    doc_type = docs.schema["doc_id"].dataType
    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType().add("shard", "long").add("term", "string").add("docs", ints).add("counts", ints).add("lengths", T.ArrayType(T.LongType())).add("doc_ids", T.ArrayType(doc_type))
    rows = spark.conf.get(_BATCH_ROWS)
    if int(rows) <= 0 or int(rows) > SHARD_DOCS:
        spark.conf.set(_BATCH_ROWS, str(SHARD_DOCS))  # a batch is a shard; five times the texts took more than 3 GB of an executor
    try:
        index = scratch.save(docs.select("doc_id", "text").mapInArrow(_index(wanted, to_arrow_type(doc_type)), schema), "index")
    finally:
        spark.conf.set(_BATCH_ROWS, rows)
    shards = index.where("term is null").select("shard", "lengths", "doc_ids")
    facts = shards.select(F.explode("lengths").alias("n")).agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = facts.docs or 0, facts.terms or 0
    result = T.StructType([items.schema["item_id"], T.StructField("rank", T.IntegerType()), T.StructField("doc_id", doc_type), T.StructField("score", T.LongType())])
    if not n_terms or not n_vocabulary:
        return spark.createDataFrame([], result)

    postings = index.where("term is not null").select("shard", "term", "docs", "counts", "lengths")
    share = F.expr(f"array_max(zip_with(counts, lengths, (tf, n) -> {_share('cast(tf as bigint)', 'n', n_docs, n_terms)}))")
    terms = postings.join(vocabulary, "term", "left_semi").groupBy("term").agg(F.sum(F.size("docs")).alias("df"), F.max(share).alias("most"))
    weight = F.floor(F.lit(1000.0) * F.log((F.lit(2.0 * n_docs + 2.0)) / (2.0 * F.col("df") + 1.0))).cast("long")
    terms = scratch.save(terms.withColumn("weight", weight).where("weight > 0"), "terms")
    histogram = {r.weight: r.n for r in terms.groupBy("weight").agg(F.sum("df").alias("n")).collect()}  # at most 1000 ln(2N+2) rows
    terms = scratch.save(terms.withColumn("owner", _owner(histogram, owners)), "owned")

    n_items = asked.select("item_id").distinct().count()
    bundle = F.pmod(F.xxhash64("item_id"), F.lit(max(1, -(-n_items // ITEMS_PER_BUNDLE)))).cast("int")
    members = asked.select("item_id", bundle.alias("bundle")).distinct().groupBy("bundle").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    slots = scratch.save(members.select("bundle", F.posexplode("items").alias("slot", "item_id")), "slots")
    stages = F.create_map(*[x for k in range(owners) for x in (F.lit(k), F.sum(F.when(F.col("owner") >= k, F.col("weight") * F.col("most")).otherwise(0)))])
    use = scratch.save(asked.join(slots, "item_id").join(terms, "term"), "use")
    rest = scratch.save(slots.join(use.groupBy("bundle", "slot").agg(stages.alias("rest")), ["bundle", "slot"], "left"), "rest")
    lists = use.groupBy("owner", "bundle", "term", "weight").agg(F.collect_list("slot").alias("item_slots"))
    lists = scratch.save(lists, "lists")

    bundles = F.explode(F.sequence(F.lit(0), F.lit(max(1, -(-n_items // ITEMS_PER_BUNDLE)) - 1)))
    tickets = shards.select("shard", F.size("doc_ids").alias("n_docs"), bundles.alias("bundle"))
    tickets = scratch.save(tickets.join(members.select("bundle"), "bundle", "left_semi"), "tickets")
    sums, least = None, slots.select("bundle", "slot", F.lit(0).cast("long").alias("least"))
    for stage in range(owners):
        here = F.coalesce(F.col("rest")[stage], F.lit(0).cast("long"))
        later = F.coalesce(F.col("rest")[stage + 1], F.lit(0).cast("long")) if stage + 1 < owners else F.lit(0).cast("long")
        bounds = rest.join(least, ["bundle", "slot"]).groupBy("bundle").agg(F.sort_array(F.collect_list(F.struct("slot", here.alias("here"), later.alias("later"), "least"))).alias("b"))
        bounds = bounds.select("bundle", F.col("b.here").alias("rest_before"), F.col("b.later").alias("rest_after"), F.col("b.least").alias("least"))
        left = tickets.join(bounds, "bundle")
        left = left.join(sums.select("shard", "bundle", "slots", "docs", "sums"), ["shard", "bundle"], "left") if sums is not None else left.withColumns(
            {"slots": F.lit(None).cast("array<int>"), "docs": F.lit(None).cast("array<int>"), "sums": F.lit(None).cast("array<long>")}
        )
        own = postings.join(lists.where(F.col("owner") == stage).drop("owner"), "term").select("shard", "bundle", "weight", "item_slots", "docs", "counts", "lengths")
        out = left.groupBy("shard", "bundle").cogroup(own.groupBy("shard", "bundle")).applyInArrow(_add(top, n_docs, n_terms), _ACCUMULATORS)
        sums = scratch.save(out, f"sums{stage}")
        if stage + 1 < owners:
            best = sums.select("bundle", F.explode(F.arrays_zip("best_slots", "best_sums")).alias("b")).select("bundle", F.col("b.best_slots").alias("slot"), F.col("b.best_sums").alias("sum"))
            nth = F.row_number().over(Window.partitionBy("bundle", "slot").orderBy(F.desc("sum")))
            reached = best.withColumn("nth", nth).where(F.col("nth") <= top).groupBy("bundle", "slot").agg(F.min("sum").alias("low"), F.count("*").alias("n"))
            floor = F.when(F.col("n") == top, F.col("low")).otherwise(0).cast("long")
            least = scratch.save(slots.join(reached, ["bundle", "slot"], "left").select("bundle", "slot", F.coalesce(floor, F.lit(0).cast("long")).alias("least")), f"least{stage}")
    named = sums.join(shards.select("shard", "doc_ids"), "shard").select("bundle", F.explode(F.expr("zip_with(arrays_zip(slots, docs), sums, (p, s) -> struct(p.slots as slot, doc_ids[p.docs] as doc_id, s as score))")).alias("x"))
    named = named.select("bundle", "x.*").where("doc_id is not null").join(slots, ["bundle", "slot"])
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return named.withColumn("rank", rank).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


#: DuckDB: the same ranking straight from the formula.
SQL = """
WITH t AS (SELECT doc_id, row_number() OVER () AS r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
           FROM documents),
tf AS (SELECT doc_id, r, term, count(*) AS tf FROM t GROUP BY ALL),
n AS (SELECT r, sum(tf)::BIGINT AS n FROM tf GROUP BY r),
total AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM n),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, total),
s AS (SELECT item_id, doc_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * n_docs) // n_terms)))))::BIGINT AS score
      FROM q JOIN w USING (term) JOIN tf USING (term) JOIN n USING (r), total GROUP BY ALL),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
