"""Which of very many numbers occur more than once, in one shuffle.

Every task sorts its own numbers first: a number met twice there is settled on the spot and sent on once as a mark, so
a number that a third of all documents hold costs its reducer one mark per task. Numbers travel packed, a few long
binary rows per task and bucket, and a reducer holds one bucket partition (total / spark.sql.shuffle.partitions).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PACK = 1 << 20
_SENT = "bucket int, settled boolean, hashes binary, owners binary, owner_at binary, places binary"
_FOUND = "hash long, owner long, place int"
Entries = tuple[np.ndarray, np.ndarray, np.ndarray]


def _packed(bucket: int, settled: bool, hashes: np.ndarray, owners: np.ndarray, places: np.ndarray) -> tuple:
    own, at = np.unique(owners, return_inverse=True)
    at = at.astype(np.uint16 if len(own) < 1 << 16 else np.uint32)
    return bucket, settled, hashes.tobytes(), own.tobytes(), at.tobytes(), places.astype(np.int32).tobytes()


def _unpacked(row: dict) -> Entries:
    hashes = np.frombuffer(row["hashes"], np.uint64)
    own = np.frombuffer(row["owners"], np.int64)
    at = np.frombuffer(row["owner_at"], np.uint16 if len(own) < 1 << 16 else np.uint32)
    return hashes, own[at], np.frombuffer(row["places"], np.int32)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    names = ("bucket", "settled", "hashes", "owners", "owner_at", "places")
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=list(names))


def _runs(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by number, and for each place of that order the length of its run of equal numbers."""
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    edge = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1], True]) if len(ordered) else np.zeros(1, int)
    size = np.diff(edge)
    return order, np.repeat(size, size)


def _dealt(found: Entries, buckets: int) -> Iterator[pa.RecordBatch]:
    hashes, owners, places = found
    order, size = _runs(hashes)
    hashes, owners, places = hashes[order], owners[order], places[order]
    twice = size > 1
    rows = []
    if twice.any():
        rows = [_packed(int(hashes[twice][k] % np.uint64(buckets)), True, *(x[twice][k : k + PACK // 16] for x in (hashes, owners, places))) for k in range(0, int(twice.sum()), PACK // 16)]
    first = np.r_[True, hashes[1:] != hashes[:-1]]
    hashes, owners, places = hashes[first], owners[first], np.where(twice, -1, places)[first]
    owners = np.where(places < 0, 0, owners)
    bucket = (hashes % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    hashes, owners, places, bucket = hashes[order], owners[order], places[order], bucket[order]
    edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
    rows += [_packed(int(bucket[a]), False, hashes[a:b], owners[a:b], places[a:b]) for a, b in zip(edge[:-1], edge[1:])]
    for k in range(0, len(rows), 256):
        yield _batch(rows[k : k + 256])


def _as_found(hashes: np.ndarray, owners: np.ndarray, places: np.ndarray) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(hashes), 1 << 16):
        part = [x[k : k + (1 << 16)] for x in (hashes.view(np.int64), owners, places)]
        yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int64()), pa.array(part[1], pa.int64()), pa.array(part[2], pa.int32())], names=["hash", "owner", "place"])


def recurring(df: DataFrame, emit: Callable[[Iterable[pa.RecordBatch]], Iterator[Entries]]) -> DataFrame:
    """(hash, owner, place) of every emitted entry whose hash is emitted at least twice. Places must be 0 or more."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = parts * 4

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Entries] = []
        for found in emit(batches):
            held.append(found)
            if sum(len(x[0]) for x in held) >= PACK:
                yield from _dealt(tuple(map(np.concatenate, zip(*held))), buckets)
                held = []
        if sum(len(x[0]) for x in held):
            yield from _dealt(tuple(map(np.concatenate, zip(*held))), buckets)

    def settle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Entries] = []
        for batch in batches:
            for row in batch.to_pylist():
                if row["settled"]:
                    yield from _as_found(*_unpacked(row))
                else:
                    held.append(_unpacked(row))
        if held:
            hashes, owners, places = map(np.concatenate, zip(*held))
            order, size = _runs(hashes)
            take = order[(size > 1) & (places[order] >= 0)]
            yield from _as_found(hashes[take], owners[take], places[take])

    return df.mapInArrow(send, _SENT).repartition(parts, "bucket").mapInArrow(settle, _FOUND)
