"""Approximate nearest neighbours by query-aware collision counting.

Every vector is projected on single random directions; each block of vectors keeps a sorted array per direction. A query
opens a window around its own projection in each array and widens all of them together (virtual rehashing). A vector met
in enough windows is verified by its exact distance. A query ends in a block when its k-th verified distance is within the
radius that the windows stand for, or the windows hold the whole block.

Stated queries meet all vectors block by block: a task has one block of vectors and one of queries, both of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DIRECTIONS = 40
THRESHOLD = 0.7  # share of the windows that a vector must be met in
WIDTH = 2.72  # window per radius: a vector at the radius is met in 83 of 100 windows
GROWTH = 1.25
BLOCK, MOST_BLOCK, QUERY_BLOCK = 4096, 131_072, 2048
SAMPLE = 1024  # vectors that the first radius is taken from
_OUT = "query_id long, vec_id long, score double"


def sound(embedding: Column) -> Column:
    """Not null, not empty, all components finite, and not all zero."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return embedding.isNotNull() & (F.size(embedding) > 0) & ~bad & F.exists(embedding, lambda x: x != 0)


def directions(dim: int, n: int = DIRECTIONS) -> np.ndarray:
    return np.random.default_rng(20_011 + dim).standard_normal((dim, n))


def first_radius(sample: np.ndarray, k: int) -> float:
    """Half the median distance to the k-th neighbour in the sample, shrunk for its size; 1 without any finite one."""
    if len(sample) < 3:
        return 1.0
    with np.errstate(over="ignore", invalid="ignore"):
        square = (sample**2).sum(1)
        apart = np.sqrt(np.maximum(square[:, None] + square[None] - 2 * sample @ sample.T, 0))
        apart.sort(1)
        near = np.median(apart[:, min(k, len(sample) - 1)])
    return float(near / 2) if 0 < near < np.inf else 1.0


def _scale(*parts: np.ndarray) -> float:
    """1, or the power of two that brings very large vectors below 1, so that no projection overflows."""
    most = max((float(np.abs(x).max()) for x in parts if x.size), default=0.0)
    return 1.0 if most < 2.0**900 else 2.0 ** -math.frexp(most)[1]


def _within(far: float, reach: float, scale: float) -> bool:
    return bool(far < np.inf and far * scale <= reach)


def search_block(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, radius: float) -> list[tuple[int, int, float]]:
    """The k nearest found in one block for each query, its own id left out.

    Where squares overflow a distance is infinite, as by the plain formula; such a query is compared with the whole block.
    """
    n = len(ids)
    a = directions(vectors.shape[1])
    scale = _scale(vectors, queries)
    projected = (vectors * scale) @ a
    order = np.argsort(projected, axis=0, kind="stable")
    ordered = np.take_along_axis(projected, order, 0)
    order, ordered = np.ascontiguousarray(order.T), np.ascontiguousarray(ordered.T)
    own = (queries * scale) @ a
    m = a.shape[1]
    enough = math.ceil(THRESHOLD * m)
    out = []
    for q in range(len(query_ids)):
        met = np.zeros(n, np.int64)
        checked = np.zeros(n, bool)
        best_id, best = np.zeros(0, np.int64), np.zeros(0)
        low = [int(np.searchsorted(ordered[j], own[q, j])) for j in range(m)]
        high = list(low)
        reach, want = max(radius * scale, 2.0**-1000), k + 1  # in scaled units
        while True:
            half, whole, fresh = WIDTH * reach / 2, True, []
            for j in range(m):
                lo, hi = (int(x) for x in ordered[j].searchsorted((own[q, j] - half, own[q, j] + half)))
                lo, hi = min(lo, low[j]), max(hi, high[j])
                fresh += [order[j, lo : low[j]], order[j, high[j] : hi]]
                low[j], high[j] = lo, hi
                whole &= lo == 0 and hi == n
            met += np.bincount(np.concatenate(fresh), minlength=n)
            new = np.flatnonzero((met >= enough) & ~checked)
            if len(new):
                checked[new] = True
                with np.errstate(over="ignore"):
                    far = np.sqrt(((vectors[new] - queries[q]) ** 2).sum(1))
                best_id, best = np.r_[best_id, ids[new]], np.r_[best, far]
                if len(best) > 4 * want:
                    top = np.lexsort((best_id, best))[:want]
                    best_id, best = best_id[top], best[top]
            if whole or (len(best) >= want and _within(np.partition(best, want - 1)[want - 1], reach, scale)):
                break
            reach *= GROWTH
        take = best_id != query_ids[q]
        best_id, best = best_id[take], best[take]
        for i in np.lexsort((best_id, best))[:k]:
            out.append((int(query_ids[q]), int(best_id[i]), float(best[i])))
    return out


def _searcher(k: int, radius: dict[int, float]) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def search(block: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(block) or not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        stack = lambda x: np.array(x["embedding"].tolist(), np.float64)
        vectors, queries = stack(block), stack(asked)
        found = search_block(block["vec_id"].to_numpy(), vectors, asked["vec_id"].to_numpy(), queries, k, radius.get(vectors.shape[1], 1.0))
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    return search


def nearest(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): up to k nearest found for each row of ``vectors`` (vec_id, embedding) that is a query.

    Score is the Euclidean distance in double precision on the original vectors; equal scores go to the smaller vec_id.
    Vectors that are null, empty, all zero or hold a null or non-finite component, and rows without vec_id, take no
    part. Of rows with one vec_id the least vector counts. Vectors of another number of components are not compared.
    An empty table gives an empty one; other columns are not read.
    """
    kept = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & sound(F.col("embedding")))
    kept = kept.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("dim", F.size("embedding"))
    sizes = {r.dim: r for r in kept.groupBy("dim").agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).collect()}  # as many rows as lengths
    sample = kept.where(F.col("dim").isin(list(sizes)[:64])).orderBy(F.xxhash64("vec_id")).limit(SAMPLE).collect()
    radius = {d: first_radius(np.array([r.embedding for r in sample if r.dim == d], np.float64), k) for d in {r.dim for r in sample}}
    blocks = {d: max(1, math.ceil(r.n / min(MOST_BLOCK, max(BLOCK, r.n // 64)))) for d, r in sizes.items()}
    asks = {d: max(1, math.ceil(r.q / QUERY_BLOCK)) for d, r in sizes.items()}

    def of(table: dict[int, int]) -> Column:
        out = F.lit(1)
        for d, v in table.items():
            out = F.when(F.col("dim") == d, F.lit(v)).otherwise(out)
        return out

    spread = lambda n: F.pmod(F.xxhash64("vec_id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    here = kept.withColumn("block", spread(of(blocks))).withColumn("ask", every(of(asks)))
    asked = kept.where(is_query).withColumn("ask", spread(of(asks))).withColumn("block", every(of(blocks)))
    keys = ["dim", "block", "ask"]
    found = here.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(_searcher(k, radius), _OUT)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
