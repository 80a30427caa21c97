"""Quality score by a sparse ensemble of rules over statistics of the text.

Boosted shallow trees over a bounded sample of labelled rows propose conjunctive rules (every path from a root); an
L1-penalised logistic fit keeps few of them. The fitted rules are compiled into one Spark column over the statistics,
which are Spark columns too, so scoring is a single pass without Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 20_000  # labelled rows the fit may take, by least hash of doc_id
_SPACES = r"[ \t\n\x0B\f\r]+"


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id's text divisible by 5 (a null id counts as an empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def with_statistics(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` (with text) and its statistics as double columns named ``s_*``; null texts count as empty."""
    base = docs.withColumn("t", F.coalesce("text", F.lit("")))
    base = base.withColumn("w", F.filter(F.split("t", _SPACES), lambda x: x != ""))
    base = base.withColumn("n", F.size("w")).withColumn("own", F.size(F.array_distinct("w")))
    share = lambda a, b: (a / F.greatest(b, F.lit(1))).cast("double")
    repeats = F.aggregate(
        "w", F.struct(F.lit("").alias("last"), F.lit(0).alias("same")), lambda acc, x: F.struct(x.alias("last"), (acc.same + (acc.last == x).cast("int")).alias("same")), lambda acc: acc.same
    )
    count = lambda pattern: F.regexp_count("t", F.lit(pattern))
    lines = F.filter(F.split("t", "\n"), lambda x: x != "")
    stats = {
        "s_chars": F.length("t").cast("double"),
        "s_words": F.col("n").cast("double"),
        "s_word_length": share(F.length("t"), F.col("n")),
        "s_distinct": share(F.col("own"), F.col("n")),
        "s_distinct_log": (F.log(F.col("own") + 1.0) / F.log(F.col("n") + 1.0 + 1e-9)).cast("double"),
        "s_repeats": share(repeats, F.col("n")),
        "s_upper": share(count(r"\p{Lu}"), F.length("t")),
        "s_digits": share(count(r"[0-9]"), F.length("t")),
        "s_symbols": share(count(r"[^\p{L}\p{N}\s.,;:'\"!?()-]"), F.col("n")),
        "s_marks": share(count(r"[!?]"), F.col("n")),
        "s_stops": share(count(r"[.,;:]"), F.col("n")),
        "s_lines": F.size(lines).cast("double"),
        "s_distinct_lines": share(F.size(F.array_distinct(lines)), F.size(lines)),
        "s_line_words": share(F.col("n"), F.size(lines)),
    }
    return base.withColumns(stats).drop("t", "w", "n", "own"), list(stats)


@dataclass(frozen=True)
class Rule:
    """All of the terms (statistic, is above, bound) hold."""

    terms: tuple[tuple[int, bool, float], ...]

    def on(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for at, above, bound in self.terms:
            out &= (x[:, at] > bound) if above else (x[:, at] <= bound)
        return out

    def column(self, names: list[str]) -> Column:
        out = F.lit(True)
        for at, above, bound in self.terms:
            out = out & ((F.col(names[at]) > bound) if above else (F.col(names[at]) <= bound))
        return out


@dataclass(frozen=True)
class RuleModel:
    names: list[str]
    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(rule.column(self.names), F.lit(weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = self.intercept + sum((w * r.on(x) for r, w in self.rules), np.zeros(len(x)))
        return 1 / (1 + np.exp(-total))


def _bounds(x: np.ndarray, most: int = 48) -> list[np.ndarray]:
    return [np.unique(np.quantile(x[:, k], np.linspace(0.02, 0.98, most))) for k in range(x.shape[1])]


def _grow(binned: np.ndarray, bounds: list[np.ndarray], slope: np.ndarray, bend: np.ndarray, depth: int, least: int) -> tuple[list[Rule], np.ndarray]:
    """Paths of one tree and its value per row, by the gain of second-order boosting."""
    value, paths = np.zeros(len(slope)), []

    def split(rows: np.ndarray, terms: tuple, left: int) -> None:
        g, h = slope[rows], bend[rows]
        if terms:
            paths.append(Rule(tuple(sorted(terms))))
        best = (1e-6, -1, -1)
        if left and len(rows) >= 2 * least:
            for k, cuts in enumerate(bounds):
                if not len(cuts):
                    continue
                at = binned[rows, k]
                gs, hs, ns = (np.cumsum(np.bincount(at, weights=v, minlength=len(cuts) + 1))[:-1] for v in (g, h, np.ones(len(rows))))
                gain = gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - g.sum() ** 2 / (h.sum() + 1)
                gain[(ns < least) | (len(rows) - ns < least)] = -1
                if gain.max() > best[0]:
                    best = (gain.max(), k, int(gain.argmax()))
        if best[1] < 0:
            value[rows] = -g.sum() / (h.sum() + 1)
            return
        _, k, cut = best
        low = binned[rows, k] <= cut
        split(rows[low], (*terms, (k, False, float(bounds[k][cut]))), left - 1)
        split(rows[~low], (*terms, (k, True, float(bounds[k][cut]))), left - 1)

    split(np.arange(len(slope)), (), depth)
    return paths, value


def _lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int) -> tuple[float, np.ndarray]:
    """L1-penalised logistic weights over standardised columns, by accelerated proximal steps; the intercept is free."""
    mean, dev = z.mean(0), z.std(0) + 1e-6
    a = np.c_[np.ones(len(z), np.float32), ((z - mean) / dev).astype(np.float32)]
    probe = np.ones(a.shape[1], np.float32)
    for _ in range(15):
        probe = a.T @ (a @ probe)
        probe /= np.linalg.norm(probe)
    step = 4 * len(y) / float(np.linalg.norm(a @ probe) ** 2) * 0.95
    w = v = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(steps):
        slope = a.T @ ((1 / (1 + np.exp(-(a @ v.astype(np.float32)))) - y).astype(np.float32)) / len(y)
        nxt = v - step * slope
        nxt[1:] = np.sign(nxt[1:]) * np.maximum(np.abs(nxt[1:]) - step * penalty, 0)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, w, t = nxt + (t - 1) / t2 * (nxt - w), nxt, t2
    weights = w[1:] / dev
    return float(w[0] - (weights * mean).sum()), weights


def fit(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 24, depth: int = 3, penalty: float = 5e-4, steps: int = 300) -> RuleModel:
    """The ensemble for 0/1 labels ``y``; one class alone gives a constant."""
    rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base = float(np.log(rate / (1 - rate)))
    if len(y) < 20 or y.min() == y.max():
        return RuleModel(names, base, ())
    bounds = _bounds(x)
    binned = np.stack([np.searchsorted(b, x[:, k]) for k, b in enumerate(bounds)], 1)
    total, rules = np.full(len(y), base), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        paths, value = _grow(binned, bounds, p - y, p * (1 - p), depth, max(5, len(y) // 500))
        rules |= dict.fromkeys(paths)
        total = total + 0.3 * value
    rules = list(rules)
    if not rules:
        return RuleModel(names, base, ())
    intercept, weights = _lasso(np.stack([r.on(x) for r in rules], 1).astype(np.float32), y, penalty, steps)
    return RuleModel(names, intercept, tuple((r, round(float(w), 6)) for r, w in zip(rules, weights) if abs(w) > 1e-4))


def labelled_sample(labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, y) of at most ``rows`` labelled documents outside the held-out fold; of repeated labels the greatest counts."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return known.groupBy("doc_id").agg(F.max(label).cast("double").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> RuleModel:
    """A model from at most ``rows`` labelled documents; the sample's ids are broadcast, their statistics fetched."""
    sample = F.broadcast(labelled_sample(labels, label, rows))  # 16 bytes a row, at most ``rows``
    found, names = with_statistics(docs.select("doc_id", "text").join(sample, "doc_id"))
    got = found.groupBy("doc_id").agg(F.max("y").alias("y"), F.min(F.array(*names)).alias("x")).orderBy("doc_id").collect()
    x = np.array([r.x for r in got], float).reshape(len(got), len(names))
    return fit(np.nan_to_num(x), np.array([r.y for r in got]), names)


def score_documents(docs: DataFrame, model: RuleModel, threshold: float = 0.3) -> DataFrame:
    """``docs`` with score (0 to 1, higher is better) and predicted (1 from ``threshold`` on). Null and empty texts are
    scored as texts without words; clashing input columns named score, predicted or s_* are replaced."""
    names = {*model.names, "score", "predicted", "t", "w", "n", "own"}
    kept = [c for c in docs.columns if c.lower() not in names]
    found, _ = with_statistics(docs.select(*kept))
    return found.withColumn("score", model.score()).withColumn("predicted", (F.col("score") >= threshold).cast("int")).select(*kept, "score", "predicted")
