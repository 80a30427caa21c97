"""Exact Jaccard join of documents on word n-grams, by universe partitioning and the pigeonhole principle.

Equal sets are one node. Sizes fall into bands of ratio 1.5; a pair is found under the band of its larger set. Two sets
of a band that reach the similarity differ in at most ``limit`` elements. The universe is cut into segments by hash;
with one segment more than ``limit``, one must be equal (some more make sure of one that is not empty). A segment that
also offers each of its one-deletion neighbours stands for two, so there can be fewer: how many is chosen for each band
by the cost of keys and of chance meetings.

Sets that share a segment key form a group; groups with the same least member are one cluster. A cluster of bounded
weight is joined exactly inside one task (prefix filter, then whole sets) and gives only links that connect what was not
connected, so no task and no output holds the pairs of a group (members that size and sketch rule out for all others do
not even send their sets). A heavier cluster is compared with its leader alone: two sets near each other must then share
differences from the leader, and those, rarest first and only as many as an overlap cannot do without, make new, smaller
groups, and so on until no cluster is heavy.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from edgeloom.llm.components import components
from edgeloom.llm.recurring import Entries, recurring
from edgeloom.llm.words import Words, mix, run_hashes, text_words
from edgeloom.session import Scratch

RATIO = 1.5
WEIGHT = 4_000_000  # elements of a cluster that one task joins; heavier ones take the exact way by a leader
PAIRS_A_SALT = 4096
SKETCH = 128  # counts of a set's elements by hash; their distance is never more than the difference of the sets
SKETCHED = 512  # sets of a cluster that are sieved by their sketches; larger clusters go on as they are
_MEETING = 0.005  # keys that it costs if two sets have one element or none in a segment: such meet one time in 10,000, at 50 keys


def band_of(n: int) -> int:
    k = int(math.log(n) / math.log(RATIO))
    while band_low(k + 1) <= n:
        k += 1
    while band_low(k) > n:
        k -= 1
    return k


def band_low(k: int) -> int:
    return math.ceil(RATIO**k)


def limit(size: int, percent: int) -> int:
    """Most elements in which two sets of ``size`` together can differ and reach the similarity."""
    return size * (100 - percent) // (100 + percent)


def allocation(band: int, sets: int, percent: int) -> tuple[int, int]:
    """(segments, how many of them offer one-deletion neighbours) of the least cost for a band that holds ``sets`` sets.

    There are as many segments beyond the limit as sets of the band leave empty (three deviations over the mean), so
    that a pair also shares one that is not empty, and empty segments need no keys. How many that takes depends on the
    number of wide segments: an empty one of them counts twice, and so there is one that a deletion would empty.
    """
    n = band_low(band + 1) - 1
    least = limit(2 * n, percent) + 1

    def needed(wide: int) -> int:
        spare = 0
        for _ in range(8 if n >= 40 else 0):  # a small set that leaves a segment empty has its key
            m = max(least + spare - wide, wide, 1)
            empty, lone = math.exp(-n / m), math.exp(-n / m) * n / m
            mean = (m + wide) * empty + wide * lone
            spare = math.ceil(mean + 3 * math.sqrt((m + 3 * wide) * empty + wide * lone))
        return least + spare

    def cost(wide: int) -> float:
        m = needed(wide) - wide
        weak = math.exp(-n / m) * (1 + n / m)  # a segment of one element or none
        return m + wide * n / m + _MEETING * sets * (m - wide + wide * (1 + n / m)) * weak**2

    wide = min((w for w in range(needed(0) // 2 + 1) if 2 * w <= needed(w)), key=cost)
    return needed(wide) - wide, wide


def spare_weight(size: int, band: int, segments: int, wide: int, percent: int) -> int:
    """The weight of segments that a set of ``size`` may leave without a key and still share another one with every partner
    of the band: 1 for a narrow segment, 2 for a wide one, 1 for a wide one that has a key, but not that of its deletion."""
    return segments + wide - 1 - limit(size + band_low(band + 1) - 1, percent)


def shingle_sets(words: Words, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; a shorter text is one n-gram, an empty one none."""
    starts = words.window_starts(n)
    hashes = words.windows(starts, n)
    first = np.searchsorted(starts, words.first)
    for i, count in enumerate(words.counts):
        if count >= n:
            yield np.unique(hashes[first[i] : first[i + 1]])
        elif count:
            yield run_hashes(words.hashes, words.first[i : i + 1], words.first[i + 1 : i + 2], 3)
        else:
            yield np.zeros(0, np.uint64)


def set_key(elements: np.ndarray) -> int:
    if not len(elements):
        return 0
    return int(mix(np.array([mix(elements).sum(dtype=np.uint64) + np.uint64(len(elements))], np.uint64)).view(np.int64)[0])


def sketch(elements: np.ndarray) -> bytes:
    counts = np.bincount((mix(elements ^ np.uint64(0xA5A5)) % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def segment_keys(elements: np.ndarray, band: int, segments: int, wide: int, percent: int) -> np.ndarray:
    """The keys of a set in a band; those of empty segments only if it has more than it can spare.

    The key of an empty wide segment is also the deletion of every set with one element there: it says nothing, and a
    constant share of a band would meet under it. A set that can spare all keys of nothing has none, and so shares some
    other key with every partner, whether that one spares its own or not. Else it may still spare those of narrow ones,
    which such sets do alike.
    """
    tag = mix(np.array([band + 1], np.uint64))[0]
    segment = (mix(elements ^ tag) % np.uint64(segments)).astype(np.int64)
    order = np.argsort(segment, kind="stable")
    segment, worth = segment[order], mix(elements + np.uint64(0x51ED270B))[order]
    edge = np.searchsorted(segment, np.arange(segments + 1))
    total = np.zeros(len(worth) + 1, np.uint64)
    np.cumsum(worth, out=total[1:])
    sums = total[edge[1:]] - total[edge[:-1]]
    names = mix(np.arange(segments, dtype=np.uint64) * np.uint64(2654435761) + tag)
    keys = mix(sums + names)
    count = np.diff(edge)
    empty, inner = count == 0, segment < wide
    spare = spare_weight(len(elements), band, segments, wide, percent)
    if empty.sum() + empty[:wide].sum() + (count[:wide] == 1).sum() <= spare:
        keys = keys[~empty]
        inner &= count[segment] > 1
    elif empty[wide:].sum() <= spare:
        keys = keys[np.r_[np.ones(wide, bool), ~empty[wide:]]]
    if wide:
        keys = np.r_[keys, mix(sums[segment[inner]] - worth[inner] + names[segment[inner]])]
    return keys


def _slim(batches: Iterable[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, words in text_words(batch, lower=True):
            sets = list(shingle_sets(words, n))
            sizes = [len(x) for x in sets]
            columns = [batch.column(c).slice(low, high - low) for c in ("doc_id", "row_key")]
            columns += [pa.array([set_key(x) for x in sets], pa.int64()), pa.array(sizes, pa.int64()), pa.array([band_of(s) if s else -1 for s in sizes], pa.int32()), pa.array([sketch(x) for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row_key", "set_key", "n_shingles", "band", "sketch"])


def _keys(n: int, percent: int, plan: dict[int, tuple[int, int]]):
    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[Entries]:
        seen: set[int] = set()  # equal sets of this task
        for batch in batches:
            for _, _, words in text_words(batch, lower=True):
                keys, owners = [], []
                for elements in shingle_sets(words, n):
                    key = set_key(elements)
                    if not len(elements) or key in seen:
                        continue
                    seen.add(key)
                    band = band_of(len(elements))
                    while 100 * len(elements) >= percent * band_low(band):
                        if band in plan:
                            keys.append(segment_keys(elements, band, *plan[band], percent))
                            owners.append(np.full(len(keys[-1]), key, np.int64))
                        band += 1
                if keys:
                    keys, owners = np.concatenate(keys), np.concatenate(owners)
                    yield keys, owners, np.zeros(len(keys), np.int32)

    return emit


def _elements(batches: Iterable[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, words in text_words(batch, lower=True):
            sets = list(shingle_sets(words, n))
            columns = [pa.array([set_key(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["set_key", "elements"])


def links_of(keys: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links (by key) that connect what all pairs of the sets at or over the similarity connect."""
    every, rank = np.unique(np.concatenate(sets), return_inverse=True)
    times = np.bincount(rank, minlength=len(every))
    place = np.empty(len(every), np.int64)
    order = np.lexsort((every, times))
    place[order] = np.arange(len(every))
    rank = place[rank]
    edge = np.r_[0, np.cumsum([len(x) for x in sets])]
    own = [np.sort(rank[a:b]) for a, b in zip(edge[:-1], edge[1:])]
    shared = times[order] > 1
    above = list(range(len(sets)))

    def top(i: int) -> int:
        while above[i] != i:
            above[i] = above[above[i]]
            i = above[i]
        return i

    postings: dict[int, list[int]] = {}
    out = []
    for i in sorted(range(len(sets)), key=lambda k: len(own[k])):
        n = len(own[i])
        prefix = own[i][: n - -(-n * percent // 100) + 1]
        prefix = prefix[shared[prefix]].tolist()
        near = set()
        for e in prefix:
            near.update(postings.setdefault(e, []))
            postings[e].append(i)
        for j in near:
            if 100 * len(own[j]) >= percent * n and top(i) != top(j):
                both = len(np.intersect1d(own[i], own[j], assume_unique=True))
                if 100 * both >= percent * (n + len(own[j]) - both):
                    above[top(i)] = top(j)
                    out.append((int(keys[i]), int(keys[j])))
    return out


def _sieved(percent: int):
    """Members of a cluster that some other member could be similar to, by size and by the distance of their sketches."""

    def sieve(cluster: pa.Table) -> pa.Table:
        size = cluster.column("size").to_numpy()
        counts = np.frombuffer(b"".join(x.as_buffer().to_pybytes() for x in cluster.column("sketch")), np.uint8).reshape(len(size), SKETCH).astype(np.int16)
        apart = np.zeros((len(size), len(size)), np.int32)
        for i in range(len(size)):
            apart[i] = np.abs(counts - counts[i]).sum(1)
        most = (size[:, None] + size[None]) * (100 - percent) // (100 + percent)
        fits = apart <= most
        np.fill_diagonal(fits, False)
        kept = fits.any(1)
        kept |= kept.any() & (cluster.column("owner").to_numpy() == cluster.column("leader").to_numpy())  # a heavy cluster needs its leader
        return cluster.select(["leader", "owner", "size"]).filter(pa.array(kept))

    return sieve


def _joined(percent: int):
    def join(cluster: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in cluster.column("elements")]
        found = links_of(cluster.column("owner").to_numpy(), sets, percent)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})

    return join


def _compared(batches: Iterable[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        linked, delta, size = [], [], []
        for x, y in zip(batch.column("a_elements"), batch.column("b_elements")):
            a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            apart = np.setxor1d(a, b, assume_unique=True)
            both = (len(a) + len(b) - len(apart)) // 2
            linked.append(100 * both >= percent * (len(a) + len(b) - both))
            size.append(len(b))
            delta.append(apart.view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_()), pa.array(size, pa.int32()), pa.array(delta, pa.list_(pa.int64()))],
            names=["a", "b", "linked", "size", "delta"],
        )


def compare_with_leaders(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked, size of b, delta) of leader a and member b. Leaders of many are spread over salts."""
    asked = pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS_A_SALT).cast("int").alias("salts"))
    sets = held.select("set_key", "elements")
    leaders = sets.withColumnsRenamed({"set_key": "a", "elements": "a_elements"}).join(asked, "a")
    leaders = leaders.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    members = pairs.join(asked, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int")).drop("salts")
    both = members.join(sets.withColumnsRenamed({"set_key": "b", "elements": "b_elements"}), "b").join(leaders, ["a", "salt"])
    columns = both.select("a", "b", "a_elements", "b_elements")
    return columns.mapInArrow(lambda x: _compared(x, percent), "a long, b long, linked boolean, size int, delta array<long>")


def _regrouped(seen: DataFrame, percent: int, level: int) -> DataFrame:
    """Groups (hash, owner) of sets that share one of the differences from a leader that an overlap cannot do without."""
    own = seen.where(F.size("delta") > 0).select("a", "b", "size", "delta", F.size("delta").alias("d"))
    step = math.log(RATIO)
    most = F.floor((F.col("size") + F.floor(F.col("size") * 100 / percent)) * (100 - percent) / (100 + percent))  # differences from a partner
    places = own.select("a", "b", "d", most.cast("int").alias("most"), F.explode("delta").alias("x"))
    rare = places.groupBy("a", "x").agg(F.count("*").alias("times"))
    ranked = places.join(rare, ["a", "x"]).where("times > 1").withColumn("rank", F.row_number().over(Window.partitionBy("a", "b").orderBy("times", "x")))
    # Differences that no other set has come first in the order; they need no row of their own.
    alone = places.join(rare, ["a", "x"]).groupBy("a", "b").agg(F.count_if(F.col("times") == 1).alias("alone"))
    ranked = ranked.join(alone, ["a", "b"]).withColumn("rank", F.col("rank") + F.col("alone"))
    kind = lambda c: F.floor(F.log(c.cast("double")) / step + 1e-9).cast("int")
    low, high = kind(F.greatest(F.lit(1), F.col("d") - F.col("most"))), kind(F.col("d") + F.col("most"))
    spread = ranked.withColumn("mine", kind(F.col("d"))).withColumn("other", F.explode(F.sequence(low, high)))
    least = F.ceil(F.pow(F.lit(RATIO), F.col("other")) - 1e-6)
    need = F.greatest(F.lit(1), F.ceil((F.col("d") + least - F.col("most")) / 2))
    kept = spread.where(F.col("rank") <= F.col("d") - need + 1)
    key = F.xxhash64(F.lit(level), "a", "x", F.least("mine", "other"), F.greatest("mine", "other"))
    return kept.select(key.alias("hash"), F.col("b").alias("owner")).distinct()


def _connected(docs: DataFrame, words: int, percent: int, weight: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row_key, set_key, n_shingles, band) of all rows and (set_key, root, component_id) of all sets."""
    scratch = Scratch(docs.sparkSession, "setjoin")
    base = docs.select("doc_id", "text").withColumn("row_key", F.xxhash64("doc_id", "text"))
    slim = scratch.save(base.mapInArrow(lambda b: _slim(b, words), "doc_id long, row_key long, set_key long, n_shingles long, band int, sketch binary"), "slim")
    one = slim.where("n_shingles > 0").groupBy("set_key").agg(F.min("row_key").alias("row_key"), F.first("band").alias("band"), F.min("doc_id").alias("least"), F.first("n_shingles").alias("size"), F.first("sketch").alias("sketch"))
    bands = {r.band: r.n for r in one.groupBy("band").agg(F.count("*").alias("n")).collect()}  # as many rows as bands
    plan = {k: allocation(k, n, percent) for k, n in bands.items()}
    groups = recurring(base.select("text"), _keys(words, percent, plan)).select("hash", "owner").distinct()

    links, level, held, heavy = [], 0, None, 1
    while heavy:
        groups = scratch.save(groups, f"groups{level}")
        led = groups.groupBy("hash").agg(F.min("owner").alias("leader"), F.count("*").alias("n")).where("n > 1")
        members = scratch.save(groups.join(led, "hash").select("leader", "owner").distinct(), f"members{level}")
        counted = members.join(members.groupBy("leader").agg(F.count("*").alias("n")), "leader")
        sized = counted.join(one.select(F.col("set_key").alias("owner"), "size", "sketch"), "owner")
        sieved = sized.where(F.col("n") <= SKETCHED).select("leader", "owner", "size", "sketch").groupBy("leader").applyInArrow(_sieved(percent), "leader long, owner long, size long")
        members = scratch.save(sieved.union(sized.where(F.col("n") > SKETCHED).select("leader", "owner", "size")), f"near{level}")
        if held is None:
            rows = one.join(members.select(F.col("owner").alias("set_key")).distinct(), "set_key").select("row_key")
            sets = base.select("row_key", "text").join(rows, "row_key").dropDuplicates(["row_key"]).select("text")
            held = scratch.save(sets.mapInArrow(lambda b: _elements(b, words), "set_key long, elements binary"), "held")
        weighed = members.groupBy("leader").agg(F.sum("size").alias("weight"))
        weighed, heavy = scratch.save_counted(weighed, f"weights{level}", F.col("weight") > weight)
        light = members.join(weighed.where(F.col("weight") <= weight), "leader").select("leader", "owner")
        light = light.join(held.select(F.col("set_key").alias("owner"), "elements"), "owner")
        links.append(scratch.save(light.groupBy("leader").applyInArrow(_joined(percent), "a long, b long"), f"links{level}"))
        if heavy:
            pairs = members.join(weighed.where(F.col("weight") > weight), "leader").where("leader <> owner").select(F.col("leader").alias("a"), F.col("owner").alias("b"))
            seen = scratch.save(compare_with_leaders(pairs, held, percent), f"seen{level}")
            links.append(seen.where("linked").select("a", "b"))
            groups = _regrouped(seen, percent, level)
            level += 1

    met = components(reduce(DataFrame.union, links))
    sets = one.select("set_key", "least").join(met.withColumnRenamed("node", "set_key"), "set_key", "left").withColumn("root", F.coalesce("root", "set_key"))
    lowest = sets.groupBy("root").agg(F.min("least").alias("component_id"))
    return slim, sets.join(lowest, "root").select("set_key", "root", "component_id")

def similar_documents(docs: DataFrame, words: int = 5, percent: int = 80, weight: int = WEIGHT) -> DataFrame:
    """Per input row: doc_id, n_shingles, component_id (least doc_id that links reach, its own included).

    Texts are lower-cased (A-Z); a set holds the distinct runs of ``words`` words, or the whole text if it is shorter.
    Sets link at 100 * common >= percent * united. Empty and null texts have no set and link with nothing; repeated rows
    link with each other; a row without doc_id takes the component of what it links with, else null. Other columns are
    not read. An empty table gives an empty one. Elements and sets are told apart by 64-bit hashes.
    """
    slim, sets = _connected(docs, words, percent, weight)
    sets = sets.drop("root")
    return slim.join(sets, "set_key", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that no smaller row of their component stands for: of each component the least doc_id (a
    null one last) stays, of repeated rows one. Rows without words are linked with nothing and all stay."""
    slim, sets = _connected(docs, words, percent, WEIGHT)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")
    # Equal texts meet by their set first, so a component is chosen from one row of each set.
    each = slim.where("n_shingles > 0").groupBy("set_key").agg(F.min(order).alias("row")).join(sets, "set_key")
    chosen = each.groupBy("root").agg(F.min("row").alias("row")).select(F.col("row.row_key").alias("__chosen"))
    key = F.xxhash64("doc_id", "text")
    blank = F.coalesce(F.trim(F.translate(F.coalesce("text", F.lit("")), "\t\n\x0b\f\r", "     ")) == "", F.lit(True))
    own = docs.columns
    full = docs.where(~blank).withColumn("__key", key).join(chosen, F.col("__key") == F.col("__chosen")).dropDuplicates(["__key"]).select(*own)
    return full.union(docs.where(blank))
