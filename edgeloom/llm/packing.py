"""Batches of documents of similar length.

The histogram of piece lengths is global and has at most ``max_words`` entries, whatever the corpus. Dynamic programming
over it picks the bucket lengths of least total padding. Each bucket is filled into batches of a token budget.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SHARD_PIECES = 100_000
_WORD = r"[^ \t\n\x0B\f\r]+"


def bucket_lengths(histogram: dict[int, int], buckets: int) -> list[int]:
    """Increasing bucket lengths, at most ``buckets``, of the least padding; ties take the fewest, then the shortest."""
    lengths = sorted(k for k, n in histogram.items() if k > 0 and n > 0)
    if not lengths:
        return []
    size = np.array(lengths, np.int64)
    count = np.r_[0, np.cumsum([histogram[k] for k in lengths])].astype(np.int64)
    total = np.r_[0, np.cumsum(size * np.diff(count))].astype(np.int64)
    n = len(size)
    best = np.full(n + 1, np.iinfo(np.int64).max // 2)
    best[0] = 0
    cuts, costs = [], []
    for _ in range(min(buckets, n)):
        now, cut = np.full(n + 1, np.iinfo(np.int64).max // 2), np.zeros(n + 1, np.int64)
        for j in range(1, n + 1):
            padding = best[:j] + size[j - 1] * (count[j] - count[:j]) - (total[j] - total[:j])
            cut[j] = int(np.argmin(padding))
            now[j] = padding[cut[j]]
        best = now
        cuts.append(cut)
        costs.append(int(best[n]))
    level, at, out = costs.index(min(costs)), n, []
    for cut in cuts[level::-1]:
        out.append(int(size[at - 1]))
        at = int(cut[at])
    return out[::-1]


def _piece_texts(n_words: Column, last: Column, max_words: int) -> Column:
    """The texts of all pieces of a document. The words stand in an array of one row, so that they are split once."""
    words = F.filter(F.split("text", r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    cut = lambda w: F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(w, i * max_words + 1, max_words), " "))
    return F.when(n_words <= max_words, F.array("text")).otherwise(F.flatten(F.transform(F.array(words), cut)))


def pack(docs: DataFrame, max_words: int = 2048, buckets: int = 8, budget: int = 16384, keep_text: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start_word, n_words, bucket, bucket_words, batch, slot, padding and, if asked for, text.

    A text of more than ``max_words`` words (whitespace-separated) becomes several pieces, joined by single spaces; a
    shorter one is one piece, unchanged. A batch of a bucket of length b holds max(1, budget // b) pieces, full but for
    the last of a bucket. Pieces of a bucket are numbered in hashed shards of about SHARD_PIECES, so no task orders a
    whole bucket. Null and empty texts are one piece of no words without bucket, batch or slot. Repeated rows are
    pieces of their own; a null doc_id is kept; other columns are not read. An empty table gives an empty one.
    """
    n_words = F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0))
    base = docs.select("doc_id", "text").withColumn("total", n_words).withColumn("row_key", F.xxhash64("doc_id", "text"))
    last = F.greatest(F.lit(0), F.ceil(F.col("total") / max_words).cast("int") - 1)
    size = F.least(F.lit(max_words), F.col("total") - F.col("piece") * max_words)
    numbers = base.select("doc_id", "row_key", "total", F.explode(F.sequence(F.lit(0), last)).alias("piece")).withColumn("n_words", size)
    histogram = {r.n_words: r["count"] for r in numbers.groupBy("n_words").count().collect()}  # at most max_words + 1 rows
    bounds = bucket_lengths(histogram, buckets)
    bucket, reach = F.lit(None).cast("int"), F.lit(None).cast("int")
    for i in reversed(range(len(bounds))):
        bucket = F.when(F.col("n_words") <= bounds[i], F.lit(i)).otherwise(bucket)
        reach = F.when(F.col("n_words") <= bounds[i], F.lit(bounds[i])).otherwise(reach)
    shards = max(1, math.ceil(sum(histogram.values()) / SHARD_PIECES))
    pieces = numbers
    if keep_text:
        texts = F.posexplode(_piece_texts(F.col("total"), last, max_words)).alias("piece", "text")
        pieces = base.where("total > 0").select("doc_id", "row_key", "total", texts).withColumn("n_words", size)
    placed = pieces.where("n_words > 0").withColumns({"bucket": bucket, "bucket_words": reach, "shard": F.pmod(F.xxhash64("row_key", "piece"), F.lit(shards)).cast("int")})
    sizes = placed.groupBy("bucket", "shard").agg(F.count("*").alias("n"))
    before = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bucket", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    columns = ["doc_id", "piece", "n_words", "bucket", "bucket_words", "shard", "row_key"]
    columns += ["text"] if keep_text else []
    inside = Window.partitionBy("bucket", "shard").orderBy("doc_id", "row_key", "piece")
    seat = F.col("offset") + F.row_number().over(inside) - 1
    seats = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket_words")))
    numbered = placed.select(*columns).join(offsets, ["bucket", "shard"]).withColumn("seat", seat)
    kept = ["text"] if keep_text else []
    start = (F.col("piece") * max_words).cast("long").alias("start_word")
    full = numbered.select(
        "doc_id", "piece", start, F.col("n_words").cast("long").alias("n_words"), "bucket", "bucket_words",
        F.floor(F.col("seat") / seats).cast("long").alias("batch"), (F.col("seat") % seats).cast("long").alias("slot"), (F.col("bucket_words") - F.col("n_words")).cast("long").alias("padding"), *kept,
    )
    none = lambda kind: F.lit(None).cast(kind)
    blank = base.where("total = 0").withColumn("piece", F.lit(0)).select(
        "doc_id", "piece", start, F.lit(0).cast("long").alias("n_words"), none("int").alias("bucket"), none("int").alias("bucket_words"),
        none("long").alias("batch"), none("long").alias("slot"), none("long").alias("padding"), *kept,
    )
    return full.union(blank)
