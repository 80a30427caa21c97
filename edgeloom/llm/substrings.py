"""Removal of word sequences that occur more than once in the corpus, by difference-cover anchors.

A difference cover D of a period v holds, for every shift d, two members that differ by d modulo v. Windows of
``length - v + 1`` words are hashed only at places p with ``p mod v`` in D. Two equal runs of ``length`` words at i and
j have an offset k < v with i + k and j + k both such places, so they share an aligned anchor. Runs of ``length`` words
around the anchors that recur (the only ones that can recur) are then hashed in full; those that recur are removed.

Two packed shuffles of numbers, one shuffle of texts to meet their anchors, and one of the texts that hold any.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.recurring import Entries, recurring
from edgeloom.llm.words import Words, text_words
from edgeloom.session import Scratch

# Perfect difference sets, period to cover.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16)}


def cover_for(length: int) -> tuple[int, tuple[int, ...]]:
    """The largest period that leaves anchors of at least two fifths of the run."""
    period = max(v for v in COVERS if length - v + 1 >= max(1, 2 * length // 5))
    return period, COVERS[period]


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _covered(n_words: int, starts: np.ndarray, length: int) -> np.ndarray:
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + length, n_words), -1)
    return np.cumsum(edge[:-1]) > 0


def _removed(batches: Iterable[pa.RecordBatch], length: int, keep_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, starts = batch.column("row_key").to_numpy(), batch.column("starts")
        for low, high, words in text_words(batch):
            rows = []
            for i in range(low, high):
                here = words.word_bytes(i - low)
                own = starts[i].as_py()
                gone = np.zeros(len(here), bool) if not own else _covered(len(here), np.asarray(own), length)
                kept = [w for w, g in zip(here, gone) if not g] if gone.any() else here
                rows.append((keys[i], len(here), int(gone.sum()), _digest(kept), b" ".join(kept).decode() if keep_text else None))
            columns = list(zip(*rows))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["row_key", "n_words", "n_removed", "kept_sha256", "kept"])


def _untouched(batches: Iterable[pa.RecordBatch], keep_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, words in text_words(batch):
            here = [words.word_bytes(i) for i in range(high - low)]
            columns = [batch.column("doc_id").slice(low, high - low), batch.column("row_key").slice(low, high - low), pa.array(words.counts, pa.int64())]
            columns += [pa.array(map(_digest, here), pa.string()), pa.array([b" ".join(w).decode() if keep_text else None for w in here], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row_key", "n_words", "kept_sha256", "kept"])


def _anchors(length: int):
    period, cover = cover_for(length)
    size = length - period + 1
    wanted = np.isin(np.arange(period), cover)

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[Entries]:
        for batch in batches:
            keys = batch.column("row_key").to_numpy()
            for low, _, words in text_words(batch):
                starts = words.window_starts(size)
                owner = words.owners()[starts] if len(starts) else starts
                place = starts - words.first[owner]
                take = wanted[place % period] & (words.counts[owner] >= length)
                starts, owner, place = starts[take], owner[take], place[take]
                yield words.windows(starts, size), keys[low + owner], place.astype(np.int32)

    return emit, size


def _runs_at_anchors(length: int, size: int):
    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[Entries]:
        for batch in batches:
            keys, anchors = batch.column("row_key").to_numpy(), batch.column("anchors")
            for low, high, words in text_words(batch):
                found = [_starts_around(words, i - low, np.asarray(anchors[i].as_py(), np.int64), length, size) for i in range(low, high)]
                starts = np.concatenate(found)
                owner = np.repeat(np.arange(high - low), [len(x) for x in found])
                yield words.windows(starts, length), keys[low + owner], (starts - words.first[owner]).astype(np.int32)

    return emit


def _starts_around(words: Words, i: int, anchors: np.ndarray, length: int, size: int) -> np.ndarray:
    n = int(words.counts[i])
    edge = np.zeros(n + 2, np.int64)
    np.add.at(edge, np.maximum(anchors - (length - size), 0), 1)
    np.add.at(edge, np.minimum(anchors + 1, n + 1), -1)
    near = np.flatnonzero(np.cumsum(edge)[: max(0, n - length + 1)] > 0)
    return words.first[i] + near


def remove_repeats(docs: DataFrame, length: int = 35, keep_text: bool = True) -> DataFrame:
    """Per input row: doc_id, n_words, n_removed, kept_sha256 and, with ``keep_text``, the kept words as ``kept``.

    A word goes when a run of ``length`` words over it also starts anywhere else, in another row or the same one.
    Null and empty texts have no words; a text shorter than ``length`` keeps all; a repeated row is a repeat like any
    other; a null doc_id is an ordinary row. Columns other than doc_id and text are not read. 64-bit hashes stand for
    runs (n equal-run candidates collide by chance with probability near n squared over 2 ** 65).
    """
    scratch = Scratch(docs.sparkSession, "substrings")
    base = docs.select("doc_id", "text").withColumn("row_key", F.xxhash64("doc_id", "text"))
    emit, size = _anchors(length)
    anchors = recurring(base.select("row_key", "text"), emit).groupBy(F.col("owner").alias("row_key")).agg(F.collect_set("place").alias("anchors"))
    held = scratch.save(base.select("row_key", "text").join(anchors, "row_key"), "held")
    runs = recurring(held, _runs_at_anchors(length, size)).groupBy(F.col("owner").alias("row_key")).agg(F.collect_set("place").alias("starts"))
    one = held.select("row_key", "text").join(runs, "row_key")
    changed = one.mapInArrow(lambda b: _removed(b, length, keep_text), "row_key long, n_words long, n_removed long, kept_sha256 string, kept string").dropDuplicates(["row_key"])  # of repeated rows one
    plain = base.mapInArrow(lambda b: _untouched(b, keep_text), "doc_id long, row_key long, n_words long, kept_sha256 string, kept string")
    cut = changed.select("row_key", F.col("n_removed").alias("gone"), F.col("kept_sha256").alias("cut_sha256"), F.col("kept").alias("cut"))
    joined = plain.join(cut, "row_key", "left")
    out = joined.select(
        "doc_id", "n_words", F.coalesce("gone", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("cut_sha256", "kept_sha256").alias("kept_sha256"), F.coalesce("cut", "kept").alias("kept")
    )
    return out if keep_text else out.drop("kept")
