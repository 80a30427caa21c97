"""Benchmark passages in documents, in Spark columns only.

Windows of a document as long as an item (in words), or all of a shorter document, get a SimHash over their word shingles. Fingerprints within the
radius are found by multi-index Hamming blocks: of six blocks one differs in at most a sixth of the radius, and items are
listed under every block value that near; so the search misses no fingerprint within the radius. Candidates are then
verified by the exact weighted Jaccard similarity of the shingles (a shingle weighs as often as it occurs).

A window can only reach the similarity if it shares shingles with the item, and enough of them that one stands at a
multiple of a stride. So only windows around such shared shingles are hashed; equal windows are hashed once.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.session import Scratch

RADIUS = 17
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))  # (first bit, bits)
LANE = 0x0001000100010001
SHINGLES_TO_BROADCAST = 2_000_000  # of the items, 16 bytes each; more are joined by a shuffle


def _with_words(df: DataFrame) -> DataFrame:
    """``df`` and its lower-cased words; none for a null text. A column of its own, so that no lambda splits the text again."""
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    return df.withColumn("words", words)


def _runs(words: Column, width: int, stride: int = 1) -> Column:
    """Hashes of the runs of ``width`` words at every ``stride``-th place."""
    last = F.size(words) - width
    run = lambda i: F.xxhash64(*[F.element_at(words, i + k + 1) for k in range(width)])
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last, F.lit(stride)), run)).otherwise(F.array().cast("array<bigint>"))


def stride_for(sizes: list[int], percent: int) -> int:
    """The longest stride that meets an unbroken shingle of every window similar enough to an item of these many shingles."""
    spans = [(n, m) for n in sizes for m in range(-(-percent * n // 100), n + 1)]  # shorter ones are whole texts
    fits = lambda s: all(m // s > m - _least_common(n, m, percent) for n, m in spans)
    return max((s for s in range(1, 9) if fits(s)), default=1)


def _least_common(n: int, m: int, percent: int) -> int:
    """Common shingles that multisets of n and m need: 100 * c >= percent * (n + m - c)."""
    return -(-(n + m) * percent // (100 + percent))


def _simhash(windows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and fingerprint of windows (keys, shingles).

    Shingles are tagged by occurrence first: one that is repeated with its weight would sway all 64 bits alone.
    Sixteen sums hold four 16-bit counters each, so windows may have up to 65,535 shingles.
    """
    each = windows.select(*keys, F.explode(_tagged(F.col("shingles"))).alias("h")).withColumn("h", F.xxhash64("h", F.lit(7)))
    sums = [F.sum(F.shiftrightunsigned("h", k).bitwiseAND(F.lit(LANE))).alias(f"s{k}") for k in range(16)]
    sums.append(F.count("*").alias("size"))
    counted = each.groupBy(*keys).agg(*sums)
    bits = " | ".join(f"IF(2 * (shiftrightunsigned(s{k}, {16 * j}) & 65535) > size, shiftleft(1L, {16 * j + k}), 0L)" for k in range(16) for j in range(4))
    return counted.select(*keys, F.expr(bits).alias("fingerprint"))


def _block(fingerprint: Column, first: int, bits: int) -> Column:
    return F.shiftrightunsigned(fingerprint, first).bitwiseAND(F.lit((1 << bits) - 1))


def _flips(bits: int, most: int) -> list[int]:
    return [sum(1 << b for b in some) for r in range(most + 1) for some in combinations(range(bits), r)]


def near_fingerprints(windows: DataFrame, items: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(n, window, item_id) of all windows (n, window, fingerprint) and items (n, item_id, fingerprint) of one n whose
    fingerprints differ in at most ``radius`` bits."""
    most = radius // len(BLOCKS)
    listed = [_listed(k, _block(F.col("fingerprint"), first, bits), _flips(bits, most)) for k, (first, bits) in enumerate(BLOCKS)]
    under = items.select("n", "item_id", F.col("fingerprint").alias("of_item"), F.explode(F.flatten(F.array(*listed))).alias("b")).select("n", "item_id", "of_item", "b.*")
    own = F.array(*[F.struct(F.lit(k).alias("block"), _block(F.col("fingerprint"), first, bits).alias("value")) for k, (first, bits) in enumerate(BLOCKS)])
    asked = windows.select("n", "window", "fingerprint", F.explode(own).alias("b")).select("n", "window", "fingerprint", "b.*")
    met = asked.join(under, ["n", "block", "value"]).where(F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("of_item"))) <= radius)
    return met.select("n", "window", "item_id").distinct()


def _listed(block: int, value: Column, flips: list[int]) -> Column:
    return F.transform(F.expr(f"array({', '.join(f'{x}L' for x in flips)})"), lambda x: F.struct(F.lit(block).alias("block"), value.bitwiseXOR(x).alias("value")))


def _tagged(shingles: Column) -> Column:
    """Shingles made distinct by how often they occurred before, so that an intersection counts weights. In any order."""
    tag = lambda s: F.transform(s, lambda x, i: F.xxhash64(x, (i + 1 - F.array_position(s, x)).cast("int")))
    count = F.element_at(F.transform(F.array(F.array_sort(shingles)), tag), 1)  # sorted once for all elements
    return F.when(F.size(F.array_distinct(shingles)) == F.size(shingles), F.transform(shingles, lambda x: F.xxhash64(x, F.lit(0)))).otherwise(count)


def find_passages(docs: DataFrame, items: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words): for each document and each item found in it the best window.

    Words are lower-cased runs without white space. A text with fewer words than an item is compared as a whole, so
    n_words may be less than the item's. Ties of similarity go to the first window. Items and texts of fewer than
    ``width`` words, and null or empty ones, match nothing. Items with one item_id and different texts count
    as that item each; repeated rows of either table change nothing. Rows without doc_id (or item_id) are matched under
    null. An empty table on either side gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "passages")
    known = _with_words(items.select("item_id", "text")).select("item_id", _runs(F.col("words"), width).alias("shingles")).withColumn("n", F.size("shingles")).where("n > 0").distinct()
    known = scratch.save(known.withColumn("item", F.xxhash64("item_id", "shingles")), "items")
    sizes = [r.n for r in known.select("n").distinct().collect()]  # as many rows as different item lengths
    stride = stride_for(sizes, percent)
    marks, total = scratch.save_counted(known.select(F.explode("shingles").alias("h"), "n").distinct(), "marks")
    marks = F.broadcast(marks) if total <= SHINGLES_TO_BROADCAST else marks

    base = docs.select("doc_id", "text").withColumn("row_key", F.xxhash64("doc_id", "text"))
    spots = _with_words(base).select("row_key", F.posexplode(_runs(F.col("words"), width, stride)).alias("at", "h"))
    hits = spots.join(marks, "h").groupBy("row_key").agg(F.collect_set(F.struct((F.col("at") * stride).alias("at"), "n")).alias("hits"))  # one document's own
    held = _with_words(base.join(hits, "row_key").dropDuplicates(["row_key"])).select("row_key", "doc_id", _runs(F.col("words"), width).alias("all"), "hits")
    held = scratch.save(held, "held")
    starts = F.transform("hits", lambda x: F.transform(F.sequence(F.greatest(F.lit(0), x["at"] - x["n"] + 1), x["at"]), lambda s: F.struct(x["n"].alias("n"), s.alias("start"))))
    whole = lambda s: (s["start"] == 0) & (s["n"] > F.size("all")) & (100 * F.size("all") >= percent * s["n"])
    starts = F.filter(F.array_distinct(F.flatten(starts)), lambda s: (s["start"] + s["n"] <= F.size("all")) | whole(s))
    spans = F.transform("starts", lambda s: F.struct(s["n"].alias("n"), s["start"].alias("start"), F.slice("all", s["start"] + 1, s["n"]).alias("shingles")))
    # Written between, so that the starts are not worked out again for every span.
    cut = scratch.save(held.withColumn("starts", starts), "starts").select("row_key", "doc_id", F.explode(spans).alias("s")).select("row_key", "doc_id", "s.*")
    cut = scratch.save(cut.withColumn("window", F.xxhash64("n", "shingles")), "windows")
    kinds = scratch.save(cut.groupBy("n", "window").agg(F.first("shingles").alias("shingles")), "kinds")

    prints = _simhash(kinds, ["n", "window"])
    of_items = _simhash(known.select("n", "item", "shingles"), ["n", "item"]).withColumnRenamed("item", "item_id")
    pairs = near_fingerprints(prints, of_items).withColumnRenamed("item_id", "item")
    both = pairs.join(kinds.select("n", "window", _tagged(F.col("shingles")).alias("own")), ["n", "window"]).join(known.select("item", "item_id", _tagged(F.col("shingles")).alias("of_item")), "item")
    shared = F.size(F.array_intersect("own", "of_item"))
    either = F.col("n") + F.col("size") - F.col("shared")
    sure = both.withColumns({"shared": shared, "size": F.size("own")}).where(100 * F.col("shared") >= percent * either)
    sure = sure.select("n", "window", "size", "item_id", (F.col("shared") / either).alias("similarity"))
    found = cut.select("row_key", "doc_id", "n", "start", "window").join(sure, ["n", "window"])
    best = found.groupBy("row_key", "doc_id", "item_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "start", "size")).alias("b"))
    return best.select("doc_id", "item_id", (-F.col("b.s")).alias("similarity"), F.col("b.start").cast("long").alias("start_word"), (F.col("b.size") + width - 1).cast("long").alias("n_words"))


def drop_contaminated(docs: DataFrame, items: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the documents that hold a benchmark passage. Rows without doc_id are told by their text."""
    key = F.xxhash64("doc_id", "text")
    named = docs.select("doc_id", "text").withColumn("doc_id", key)
    found = find_passages(named, items, width, percent).select(F.col("doc_id").alias("__found")).distinct()
    return docs.join(found, key == F.col("__found"), "left_anti")


#: ``find_passages`` with its defaults, over ``documents`` and ``benchmark``, for tables whose ids are distinct; but it leaves
#: out documents that are shorter than the item.
SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(COALESCE(text, '')), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS words FROM documents),
i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(COALESCE(text, '')), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS words FROM benchmark),
ds AS (SELECT doc_id, p, array_to_string(words[p + 1:p + 5], ' ') AS h FROM (SELECT doc_id, words, unnest(range(len(words) - 4)) AS p FROM w WHERE len(words) >= 5)),
its AS (SELECT item_id, array_to_string(words[p + 1:p + 5], ' ') AS h FROM (SELECT item_id, words, unnest(range(len(words) - 4)) AS p FROM i WHERE len(words) >= 5)),
size AS (SELECT item_id, COUNT(*) AS n FROM its GROUP BY item_id),
ic AS (SELECT item_id, h, COUNT(*) AS c FROM its GROUP BY item_id, h),
dn AS (SELECT doc_id, len(words) - 4 AS total FROM w),
hit AS (SELECT d.doc_id, c.item_id, d.p, d.h, c.c AS weight, s.n FROM ds d JOIN ic c ON c.h = d.h JOIN size s ON s.item_id = c.item_id),
opened AS (SELECT DISTINCT doc_id, item_id, n, unnest(range(GREATEST(0, p - n + 1), p + 1)) AS start FROM hit),
kept AS (SELECT o.* FROM opened o JOIN dn ON dn.doc_id = o.doc_id WHERE o.start + o.n <= dn.total),
per AS (SELECT k.doc_id, k.item_id, k.n, k.start, h.h, LEAST(COUNT(*), ANY_VALUE(h.weight)) AS c FROM kept k JOIN hit h ON h.doc_id = k.doc_id AND h.item_id = k.item_id AND h.p >= k.start AND h.p < k.start + k.n GROUP BY k.doc_id, k.item_id, k.n, k.start, h.h),
sim AS (SELECT doc_id, item_id, n, start, SUM(c) AS shared FROM per GROUP BY doc_id, item_id, n, start),
good AS (SELECT *, shared / (2 * n - shared) AS similarity FROM sim WHERE 100 * shared >= 80 * (2 * n - shared)),
best AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) AS rn FROM good)
SELECT doc_id, item_id, CAST(similarity AS DOUBLE) AS similarity, CAST(start AS BIGINT) AS start_word, CAST(n + 4 AS BIGINT) AS n_words FROM best WHERE rn = 1
"""
