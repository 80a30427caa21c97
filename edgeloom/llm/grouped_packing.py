"""Documents packed into as few token sequences as possible: linear grouping, few-size configurations, best fit.

Pieces of one length are alike, so the packing is planned on the histogram of lengths, which has at most ``capacity``
entries whatever the corpus. Large lengths are sorted into groups of equal cardinality and rounded up to the longest of
their group. A linear program over configurations of these few sizes is solved by column generation and rounded down;
its slots are filled with the actual lengths of their group. What is left, and all small lengths, go where they fit best.
The plan names for every length which of its pieces, counted over all tasks, takes which place.
"""

from __future__ import annotations

import math
import string
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from edgeloom.llm.long_texts import text_parts
from edgeloom.llm.words import SPACE, Words
from edgeloom.session import Scratch

SHARD_PIECES = 100_000
KNOWN_WORDS = 1 << 19
WORDS_AT_ONCE = 1 << 14
END = 0

# ASCII marks that part words without joining letters; an apostrophe may start a piece with letters.
_MARKS = string.punctuation.replace("'", "")
# Byte-level pieces show each byte as a printable sign: itself, or the next one from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_SIGNS = {b: chr(b) for b in _SHOWN} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}

Pattern = tuple[int, dict[int, int]]  # number of sequences, pieces of each length in one of them


def _best_configuration(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes within capacity of the greatest worth, by layers of one more piece each."""
    reach = np.arange(capacity + 1)[None, :] - sizes[:, None]
    fits, reach = reach >= 0, np.maximum(reach, 0)
    best, picks = np.zeros(capacity + 1), []
    for _ in range(capacity // int(sizes.min())):
        with_one = np.where(fits, best[reach] + worth[:, None], -1.0)
        pick = with_one.argmax(axis=0)
        now = with_one[pick, np.arange(capacity + 1)]
        better = now > best + 1e-12
        if not better.any():
            break
        picks.append(np.where(better, pick, -1))
        best = np.where(better, now, best)
    used, at = np.zeros(len(sizes)), capacity
    for pick in reversed(picks):
        if pick[at] >= 0:
            used[pick[at]] += 1
            at -= int(sizes[pick[at]])
    return float(worth @ used), used


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """(columns, times): a basic solution of the configuration program, columns @ times = demand. Any round's basis is feasible."""
    m = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    times = demand / np.diag(basis)
    for _ in range(rounds):
        worth = np.linalg.solve(basis.T, np.ones(m))
        value, column = _best_configuration(sizes, np.maximum(worth, 0), capacity)
        if value <= 1 + 1e-7:
            break
        move = np.linalg.solve(basis, column)
        rising = move > 1e-9
        if not rising.any():
            break
        ratio = np.where(rising, times / np.where(rising, move, 1), np.inf)
        out = int(np.argmin(ratio))
        times = np.maximum(times - ratio[out] * move, 0)
        times[out] = ratio[out]
        basis[:, out] = column
    return basis, times


class _Open:
    """Sequences by what is free in them; pieces of one length go to the tightest ones first."""

    def __init__(self, capacity: int):
        self.capacity, self.gaps, self.of, self.full = capacity, [], {}, []

    def add(self, n: int, pieces: dict[int, int]) -> None:
        if n <= 0:
            return
        gap = self.capacity - sum(k * v for k, v in pieces.items())
        if gap == 0:
            self.full.append((n, pieces))
            return
        if gap not in self.of:
            insort(self.gaps, gap)
            self.of[gap] = []
        self.of[gap].append((n, pieces))

    def place(self, length: int, n: int) -> None:
        """Best fit of n pieces one after the other: the tightest sequence takes as many as it holds."""
        while n:
            k = bisect_left(self.gaps, length)
            if k == len(self.gaps):
                each = self.capacity // length
                self.add(n // each, {length: each})
                if n % each:
                    self.add(1, {length: n % each})
                return
            gap = self.gaps[k]
            m, pieces = self.of[gap].pop()
            if not self.of[gap]:
                del self.of[gap], self.gaps[k]
            each = gap // length
            whole = min(m, n // each)
            self.add(whole, pieces | {length: pieces.get(length, 0) + each})
            n, m = n - whole * each, m - whole
            if m and n:
                self.add(1, pieces | {length: pieces.get(length, 0) + n})
                m, n = m - 1, 0
            self.add(m, pieces)

    def patterns(self) -> list[Pattern]:
        return self.full + [x for gap in self.gaps for x in self.of[gap]]


def _groups(lengths: list[int], histogram: dict[int, int], groups: int) -> list[list[list[int]]]:
    """Runs [length, pieces] of each group, longest first; all groups but the last have the same number of pieces."""
    each = max(1, math.ceil(sum(histogram[k] for k in lengths) / groups))
    out, room = [], 0
    for length in lengths:
        left = histogram[length]
        while left:
            if room == 0:
                out.append([])
                room = each
            take = min(left, room)
            out[-1].append([length, take])
            left, room = left - take, room - take
    return out


def plan(histogram: dict[int, int], capacity: int, groups: int = 64, shares: tuple[int, ...] = (8, 6, 4, 3, 2)) -> list[Pattern]:
    """Patterns that hold exactly the pieces of the histogram, in the fewest sequences over the shares of ``plan_for``."""
    plans = [plan_for(histogram, capacity, groups, max(1, capacity // share)) for share in shares]
    return min(plans, key=lambda patterns: sum(n for n, _ in patterns))


def plan_for(histogram: dict[int, int], capacity: int, groups: int, small: int) -> list[Pattern]:
    """The plan that groups lengths over ``small``; up to it they are placed by best fit only."""
    histogram = {k: n for k, n in histogram.items() if n > 0}
    if any(k < 1 or k > capacity for k in histogram):
        raise ValueError("lengths must be between 1 and the capacity")
    opened = _Open(capacity)
    opened.add(histogram.get(capacity, 0), {capacity: 1})
    large = sorted((k for k in histogram if small < k < capacity), reverse=True)
    rest = {k: n for k, n in histogram.items() if k <= small}
    if large:
        runs: dict[int, list[list[int]]] = {}  # rounded size -> actual runs; groups of one longest length are one
        for group in _groups(large, histogram, groups):
            runs.setdefault(group[0][0], []).extend(group)
        sizes = np.array(sorted(runs, reverse=True), np.int64)
        demand = np.array([sum(n for _, n in runs[s]) for s in sizes], float)
        columns, times = configurations(sizes, demand, capacity)
        for column, n in zip(columns.T.astype(int), np.floor(times + 1e-6).astype(int)):
            slots = [(runs[int(s)], k) for s, k in zip(sizes, column) if k]
            while n > 0:
                if any(sum(c for _, c in have) < k for have, k in slots):
                    break  # rounding left fewer than planned; the pieces stay for the best fit
                alike = min(next(c for _, c in have if c) // k for have, k in slots)
                m, pieces = min(n, max(1, alike)), {}
                for have, k in slots:
                    need = k * m
                    for run in have:
                        take = min(run[1], need)
                        if take:
                            pieces[run[0]] = pieces.get(run[0], 0) + take // m
                            run[1], need = run[1] - take, need - take
                opened.add(m, pieces)
                n -= m
        for have in runs.values():
            for length, n in have:
                if n:
                    rest[length] = rest.get(length, 0) + n
    for length in sorted(rest, reverse=True):
        opened.place(length, rest[length])
    return opened.patterns()


def seats(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """Runs of places by length and rank: pieces from ``rank`` on fill ``each`` places of one sequence after the other from ``sequence`` on."""
    rows, taken, sequence = [], {}, 0
    for n, pieces in patterns:
        offset = 0
        for length, each in sorted(pieces.items(), reverse=True):
            rows.append((length, taken.get(length, 0), each, sequence, offset))
            taken[length] = taken.get(length, 0) + n * each
            offset += length * each
        sequence += n
    rows.sort()
    names = ("length", "rank", "each", "sequence", "offset")
    return dict(zip(names, np.array(rows, np.int64).reshape(-1, 5).T))


def _texts(words: Words, which: np.ndarray) -> list[str]:
    """The given words, gathered into one line of bytes that is decoded and split once; no word holds a line end."""
    sizes = words.end[which] - words.start[which] + 1
    ends = np.cumsum(sizes)
    at = np.repeat(words.start[which] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))
    line = words.data[np.minimum(at, len(words.data) - 1)]
    line[ends - 1] = 10
    return line[:-1].tobytes().decode("utf-8", "replace").split("\n")


class WordIds:
    """Token ids of words, kept for up to KNOWN_WORDS words of a worker. Words stand alone, as no token spans white space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.hashes, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        self.starts, self.counts, self.uses = (np.zeros(0, np.int64) for _ in range(3))

    def forget(self) -> None:
        """Keeps the words that came more than once, if they leave room."""
        keep = self.uses > 1
        if 2 * keep.sum() > KNOWN_WORDS:
            keep[:] = False
        counts = self.counts[keep]
        ends = np.cumsum(counts)
        self.ids = self.ids[np.repeat(self.starts[keep] - (ends - counts), counts) + np.arange(int(counts.sum()))]
        self.hashes, self.starts, self.counts, self.uses = self.hashes[keep], ends - counts, counts, self.uses[keep] * 0

    def encode(self, words: list[str]) -> list[list[int]]:
        """Ids of each word. Plain lower-case words between marks are pieces of their own for the tokenizer, so its model gets them at once."""
        model, out, rest = self.tokenizer.model, [], []
        for k, word in enumerate(words):
            core = word.strip(_MARKS)
            plain = core.isascii()
            if not core.isalpha() or not (core.islower() if plain else core == core.lower() and is_normalized("NFC", core)) or "<|" in word:
                rest.append(k)
                out.append([])
                continue
            shown = core if plain else core.encode().decode("latin-1").translate(_BYTE_SIGNS)
            if len(core) == len(word):
                out.append([t.id for t in model.tokenize(shown)])
                continue
            at = word.find(core)
            out.append([t.id for run in (word[:at], shown, word[at + len(core) :]) if run for t in model.tokenize(run)])
        for k, found in zip(rest, self.tokenizer.encode_batch_fast([words[k] for k in rest], add_special_tokens=False)):
            out[k] = found.ids
        return out

    def learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        made, counts = [self.ids], []
        for low in range(0, len(texts), WORDS_AT_ONCE):
            found = self.encode(texts[low : low + WORDS_AT_ONCE])
            counts.append(np.fromiter(map(len, found), np.int64, len(found)))
            made.append(np.fromiter(chain.from_iterable(found), np.uint32, int(counts[-1].sum())))
        new = np.concatenate(counts)
        starts = len(self.ids) + np.cumsum(new) - new
        self.ids = np.concatenate(made)
        hashes = np.concatenate([self.hashes, hashes])
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.starts, self.counts = np.concatenate([self.starts, starts])[order], np.concatenate([self.counts, new])[order]
        self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)])[order]

    def places(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        return np.where(self.hashes[at] == hashes, at, -1) if len(self.hashes) else np.full(len(hashes), -1)

    def of(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in order, number of ids of each text)."""
        unique, first, back = np.unique(words.hashes, return_index=True, return_inverse=True)
        at = self.places(unique)
        if (at < 0).any():
            if len(self.hashes) + int((at < 0).sum()) > KNOWN_WORDS:
                self.forget()
                at = self.places(unique)
            new = first[at < 0]
            self.learn(words.hashes[new], _texts(words, new))
            at = self.places(unique)
        self.uses[at] += 1
        counts, starts = self.counts[at][back], self.starts[at][back]
        ends = np.cumsum(counts)
        ids = self.ids[np.repeat(starts - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)]
        total = np.r_[0, ends]
        return ids, np.diff(total[words.first])


_workers: dict[str, WordIds] = {}


def _token_pieces(path: str, capacity: int, keep_ids: bool, id_type: pa.DataType):
    """Batches of (doc_id, text) to batches of (doc_id, piece, start, length, ids_crc32 and, if asked for, ids)."""

    def pieces_of(batch: pa.RecordBatch, encoder: WordIds) -> Iterator[tuple[int, int, np.ndarray]]:
        """(row, first id, ids); the ids of one text come in order, all but the last ``capacity`` long."""
        pending: list[np.ndarray] = []
        held, start, row = 0, 0, None

        def rest() -> Iterator[tuple[int, int, np.ndarray]]:
            ids = np.concatenate([*pending, np.array([END], np.uint32)])
            for at in range(0, len(ids), capacity):
                yield row, start + at, ids[at : at + capacity]

        for rows, data, bounds in text_parts(batch, SPACE):
            marked = b"<|" in data.tobytes()  # only the tokenizer's own marks tell cases apart
            ids, counts = encoder.of(Words(data, bounds, lower=not marked))
            low = 0
            for r, n in zip(rows, counts):
                if r != row:
                    if row is not None:
                        yield from rest()
                    pending, held, start, row = [], 0, 0, r
                pending.append(ids[low : low + n])
                held, low = held + n, low + n
                if held >= 256 * capacity:  # of a very long text, whole pieces leave early
                    joined, whole = np.concatenate(pending), held // capacity * capacity
                    for at in range(0, whole, capacity):
                        yield row, start + at, joined[at : at + capacity]
                    pending, held, start = [joined[whole:]], held - whole, start + whole
        if row is not None:
            yield from rest()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _workers:
            _workers[path] = WordIds(path)
        for batch in batches:
            names = batch.schema.names
            owner, starts, lengths, crcs, ids = [], [], [], [], []

            def flush() -> pa.RecordBatch:
                start = np.array(starts, np.int64)
                columns = [
                    batch.column(names.index("doc_id")).take(pa.array(owner, pa.int64())).cast(id_type),
                    pa.array((start // capacity).astype(np.int32)), pa.array(start), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64()),
                ]
                if keep_ids:
                    columns.append(pa.array([x.tolist() for x in ids], pa.list_(pa.int32())))
                out = pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"] + (["ids"] if keep_ids else []))
                for held in (owner, starts, lengths, crcs, ids):
                    held.clear()
                return out

            for row, start, piece in pieces_of(batch, _workers[path]):
                owner.append(row)
                starts.append(start)
                lengths.append(len(piece))
                crcs.append(zlib.crc32(piece.astype("<u4").tobytes()))
                if keep_ids:
                    ids.append(piece)
                if len(owner) >= (1000 if keep_ids else 50_000):
                    yield flush()
            if owner:
                yield flush()

    return work


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids: each text's ids and a closing 0, cut every ``capacity`` ids."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind)]).add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long")
    if keep_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))
    id_type = to_arrow_type(kind)
    return docs.select("doc_id", "text").mapInArrow(_token_pieces(tokenizer, capacity, keep_ids, id_type), schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, groups: int = 64, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset and, if asked for, ids.

    A document is its ids by the tokenizer file (no special tokens added) and then id 0; only longer ones are cut into
    pieces of ``capacity``. Each sequence holds its pieces without gaps from offset 0 and at most ``capacity`` ids.
    Sequence numbers run from 0. Null and empty texts are the single id 0. Rows with a null or repeated doc_id are
    documents of their own; the id keeps its type; other columns are not read; an empty table gives an empty one.
    Very long texts are read part by part. Ties: pieces of one length take places in order of hashed shard, doc_id and
    piece. The driver sees the histogram of lengths, at most ``capacity`` rows; the plan has a few rows for each of them.
    """
    scratch = Scratch(docs.sparkSession, "grouped-packing")
    pieces = scratch.save(token_pieces(docs, tokenizer, capacity, keep_ids), "pieces")
    histogram = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}
    places = seats(plan(histogram, capacity, groups))
    shards = max(1, math.ceil(sum(histogram.values()) / SHARD_PIECES))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)).cast("int"))
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("length", "shard").agg(F.count("*").alias("n"))
    sizes = sizes.select("length", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("length", "shard").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("rank", F.row_number().over(inside) - 1).join(sizes, ["length", "shard"]).withColumn("rank", F.col("rank") + F.col("ahead"))
    wide = 1 << 44  # pieces of one length; a corpus has fewer
    keys = places["length"] * wide + places["rank"]

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd

        size, rank = length.to_numpy(), rank.to_numpy()
        run = np.searchsorted(keys, size * wide + rank, side="right") - 1
        nth = rank - places["rank"][run]
        each = places["each"][run]
        return pd.DataFrame({"sequence_id": places["sequence"][run] + nth // each, "offset": places["offset"][run] + nth % each * size})

    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset"] + (["ids"] if keep_ids else [])
    return ranked.withColumn("at", place("length", F.col("rank").cast("long"))).select(*columns)
