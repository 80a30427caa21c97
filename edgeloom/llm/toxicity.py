"""Toxicity score by a lexicon that is matched with spelling mistakes.

The lexicon (whole words and word stems) is learned from a bounded sample of labelled rows, beside given terms. Its
trie is intersected with the Levenshtein automaton of distance one and made deterministic; the tasks then run the
automaton over all words of a batch at once, one character place after the other. Every hit is weighed by its context:
the density of hits around it counts for abuse; quotation marks and words of reporting count against it. A small
logistic model over these sums gives the score.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.rules_quality import held_out, labelled_sample
from edgeloom.session import Scratch

SAMPLE_ROWS = 10_000  # labelled rows the fit may take
MISSPELL_LETTERS = 5  # shorter words must be spelled right
NEAR = 12  # words on either side that make a context
# Words that report what others said.
REPORTING = ("said", "says", "wrote", "called", "quote", "quoted", "sagte", "schrieb", "zitat", "dit", "écrit", "dijo", "escribió")
QUOTES = "\"“”„«»"
FEATURES = ("abuse", "abuse_misspelled", "quoted", "dense", "terms", "share")


@dataclass(frozen=True)
class Automaton:
    """table[state, symbol] is the next state; 0 is dead, 1 the start. kind: 0 none, 1 spelled right, 2 misspelled."""

    table: np.ndarray
    kind: np.ndarray
    symbol: np.ndarray
    steps: int

    def run(self, codes: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The kind of match of each word."""
        symbols = self.symbol[np.minimum(codes, len(self.symbol) - 1)]
        state = np.ones(len(start), np.int32)
        live = np.arange(len(start))
        for at in range(self.steps):
            live = live[(length[live] > at) & (state[live] > 0)]
            if not len(live):
                break
            state[live] = self.table[state[live], symbols[start[live] + at]]
        out = self.kind[state]
        out[(length > self.steps) & (out != 3)] = 0
        return np.where(out == 3, 1, out)


def automaton(words: Iterable[str], stems: Iterable[str] = (), misspell_letters: int = MISSPELL_LETTERS) -> Automaton:
    """Accepts the words, those of enough letters also within Levenshtein distance 1, and all that goes on after a stem."""
    child: list[dict[str, int]] = [{}]
    ends: list[tuple[bool, bool]] = [(False, False)]
    depth = [0]
    for text, stem in [*((w, False) for w in sorted(set(words))), *((s, True) for s in sorted(set(stems)))]:
        node = 0
        for c in text:
            if c not in child[node]:
                child[node][c] = len(child)
                child.append({})
                ends.append((False, False))
                depth.append(depth[node] + 1)
            node = child[node][c]
        ends[node] = (ends[node][0] or not stem, ends[node][1] or stem)
    deepest: list[int] = list(depth)  # longest word below each node, as only long ones may err
    for node in range(len(child) - 1, -1, -1):
        below = [deepest[k] for k in child[node].values()]
        deepest[node] = max([depth[node] if ends[node][0] else 0, *below])
    may_err = [d >= misspell_letters for d in deepest]

    def closed(places: set[tuple[int, int]]) -> frozenset:
        lost = {(k, 1) for node, e in places if e == 0 for k in child[node].values() if may_err[k]}
        return frozenset(places | {(n, e) for n, e in lost if (n, 0) not in places})

    alphabet = sorted({c for kids in child for c in kids})
    start = closed({(0, 0)})
    begun = frozenset({(-1, 0)})
    names, table, kind = {frozenset(): 0, start: 1, begun: 2}, [], []
    queue = [frozenset(), start, begun]
    for places in queue:
        if places == begun:
            kind.append(3)
            table.append([names[places]] * (len(alphabet) + 1))  # a stem and more: whatever follows
            continue
        exact = any(e == 0 and ends[n][0] for n, e in places)
        near = any(e == 1 and ends[n][0] and depth[n] >= misspell_letters for n, e in places)
        kind.append(1 if exact else 2 if near else 0)
        row = []
        if any(e == 0 and ends[n][1] for n, e in places):
            table.append([names[begun]] * (len(alphabet) + 1))
            continue
        for c in [None, *alphabet]:
            nxt: set[tuple[int, int]] = set()
            for n, e in places:
                if c in child[n] and (e == 0 or may_err[child[n][c]]):
                    nxt.add((child[n][c], e))
                if e == 0:
                    nxt.update((k, 1) for k in child[n].values() if may_err[k])
                    if may_err[n]:
                        nxt.add((n, 1))
            state = closed(nxt) if nxt else frozenset()
            if state not in names:
                names[state] = len(names)
                queue.append(state)
            row.append(names[state])
        table.append(row)
    symbol = np.zeros(max([ord(c) for c in alphabet], default=0) + 2, np.int32)
    for i, c in enumerate(alphabet):
        symbol[ord(c)] = i + 1
    return Automaton(np.array(table, np.int32), np.array(kind, np.int8), symbol, max([len(w) + 1 for w in words] + [len(s) for s in stems], default=1) + 1)


_LETTER = np.array([chr(c).isalnum() for c in range(0x3000)], bool)
_SIGN = np.zeros(0x3000, bool)
_SIGN[[ord(c) for c in "@$*!|'’-_"]] = True
_QUOTE = np.zeros(0x3000, bool)
_QUOTE[[ord(c) for c in QUOTES]] = True


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)


def word_places(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of runs of letters and digits; a single sign between two of these belongs to the word."""
    low = np.minimum(codes, 0x2FFF)
    inside = _LETTER[low] | (codes >= 0x3000)
    sign = _SIGN[low] & (codes < 0x3000)
    if len(codes) > 2:
        mid = sign[1:-1] & inside[:-2] & inside[2:]
        inside = inside.copy()
        inside[1:-1] |= mid
    edge = np.diff(np.r_[0, inside.astype(np.int8), 0])
    start = np.flatnonzero(edge == 1)
    return start, np.flatnonzero(edge == -1) - start


@dataclass(frozen=True)
class ToxicModel:
    words: tuple[str, ...]
    stems: tuple[str, ...]
    known: frozenset[str]  # near a lexicon word, but words of their own
    weights: tuple[float, ...]


def _hits(text: str, machine: Automaton, known: frozenset[str]) -> tuple[np.ndarray, int, list[tuple[int, str, int, bool]]]:
    """Number of words and (word number, word, kind, quoted) of every hit."""
    codes = _codes(text)
    start, length = word_places(codes)
    kind = machine.run(codes, start, length)
    found = np.flatnonzero(kind)
    out = []
    if len(found):
        low = text.lower()
        low = low if len(low) == len(codes) else codes.tobytes().decode("utf-32-le")
        spell = lambda i: low[start[i] : start[i] + length[i]]
        marks = np.r_[0, np.cumsum(_QUOTE[np.minimum(codes, 0x2FFF)])]  # quotation marks before each place
        line = np.r_[0, np.flatnonzero(codes == 10) + 1]
        line = line[np.searchsorted(line, start[found], side="right") - 1]
        inside = (marks[start[found]] - marks[line]) % 2 == 1
        for k, i in enumerate(found):
            word = spell(i)
            if kind[i] == 2 and word in known:
                continue
            told = any(spell(j) in REPORTING for j in range(max(0, i - 4), i))
            out.append((int(i), word, int(kind[i]), bool(inside[k]) or told))
    return start, len(start), out


def features(text: str, machine: Automaton, known: frozenset[str]) -> list[float]:
    """The sums the score is made of, in the order of FEATURES."""
    _, n, hits = _hits(text, machine, known)
    if not hits:
        return [0.0] * len(FEATURES)
    at = np.array([h[0] for h in hits])
    near = np.searchsorted(at, at + NEAR, side="right") - np.searchsorted(at, at - NEAR)
    quoted = np.array([h[3] for h in hits])
    right = np.array([h[2] == 1 for h in hits])
    open_ = ~quoted
    return [
        float(np.log1p((open_ & right).sum())), float(np.log1p((open_ & ~right).sum())), float(np.log1p(quoted.sum())),
        float(np.log(near[open_].max()) if open_.any() else 0.0), float(np.log1p(len({h[1] for h in hits if not h[3]}))), float(min(0.2, open_.sum() / max(n, 1)) * 10),
    ]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic weights, intercept first, by Newton steps."""
    a = np.c_[np.ones(len(x)), x]
    w = np.zeros(a.shape[1])
    hold = np.r_[1e-3, np.full(a.shape[1] - 1, ridge)]
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(hold), a.T @ (p - y) + hold * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _lexicon(sample: DataFrame, given: tuple[str, ...]) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Terms that are far commoner in toxic texts: (words, stems), by the likelihood ratio; all that pass."""
    total = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0.0)).alias("t")).first()
    n, t = float(total.n), float(total.t)
    if not t or t == n:
        return tuple(sorted(given)), ()
    word = F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("word")
    words = sample.select("y", word).where(F.length("word").between(3, 30)).groupBy("word").agg(F.count("*").alias("df"), F.sum("y").alias("tf"))
    stems = words.select(F.explode(F.transform(F.sequence(F.lit(4), F.lit(8)), lambda k: F.when(F.length("word") > k, F.col("word").substr(F.lit(1), k)))).alias("term"), "df", "tf", "word")
    stems = stems.where(F.col("term").isNotNull()).groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"), F.max("tf").alias("top")).withColumn("stem", F.lit(True))
    every = words.select(F.col("word").alias("term"), "df", "tf", F.col("tf").alias("top"), F.lit(False).alias("stem")).union(stems.select("term", "df", "tf", "top", "stem"))
    part = lambda k, of, rate: F.when(k > 0, k * F.log(k / (of * rate))).otherwise(0.0)
    rate = t / n
    gain = 2 * (part(F.col("tf"), F.col("df"), rate) + part(F.col("df") - F.col("tf"), F.col("df"), 1 - rate))
    odds = F.log((F.col("tf") + 0.5) / (t + 1)) - F.log((F.col("df") - F.col("tf") + 0.5) / (n - t + 1))
    ranked = every.withColumns({"gain": gain, "odds": odds}).where((F.col("gain") >= 40) & (F.col("odds") >= 3) & (F.col("tf") >= 8))
    best = ranked.orderBy(F.desc("gain"), "term", "stem").collect()  # terms of the bounded sample
    words_, stems_ = set(given), set()
    for r in best:
        if any(r.term.startswith(s) or (r.stem and s.startswith(r.term)) for s in stems_) or (r.stem and r.top >= 0.6 * r.tf):
            continue
        if r.stem:
            words_ -= {w for w in words_ if w.startswith(r.term) and w not in given}
        (stems_ if r.stem else words_).add(r.term)
    return tuple(sorted(words_)), tuple(sorted(stems_))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", given: tuple[str, ...] = (), rows: int = SAMPLE_ROWS) -> ToxicModel:
    """A model from at most ``rows`` labelled documents outside the held-out fold. Without labels of both kinds the
    given terms alone speak, with fixed weights."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    ids = F.broadcast(labelled_sample(labels, label, rows))  # 16 bytes a row, at most ``rows``
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(ids, "doc_id").dropDuplicates(["doc_id"])
    sample = scratch.save(found, "sample")
    words, stems = _lexicon(sample, tuple(given))
    machine = automaton(words, stems)

    def variants(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [(h[1], y) for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()) for h in {x[1]: x for x in _hits(text, machine, frozenset())[2] if x[2] == 2}.values()]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in seen], pa.string()), pa.array([y for _, y in seen], pa.float64())], names=["word", "y"])

    seen = sample.select("text", "y").mapInArrow(variants, "word string, y double").groupBy("word").agg(F.count("*").alias("df"), F.sum("y").alias("tf"))
    known = frozenset(r.word for r in seen.where(F.col("df") - F.col("tf") > F.col("tf")).collect())  # words of the bounded sample

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(text, machine, known) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(pa.float64())), batch.column("y")], names=["doc_id", "x", "y"])

    got = sample.mapInArrow(sums, "doc_id long, x array<double>, y double").orderBy("doc_id").collect()
    y = np.array([r.y for r in got])
    if len(got) < 20 or y.min() == y.max():
        return ToxicModel(words, stems, known, (-3.0, 3.0, 2.0, 0.3, 0.5, 0.5, 0.5))
    return ToxicModel(words, stems, known, tuple(_logistic(np.array([r.x for r in got]), y)))


def score_documents(docs: DataFrame, model: ToxicModel, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher is more toxic), predicted, n_hits and the hits as (start, end, word, quoted).

    Places are characters of the lower-cased text. Null and empty texts have no hits and the score of a text without;
    repeated rows are scored alike; a null doc_id is kept (held_out as of an empty id). Other columns are not read.
    """
    machine = automaton(model.words, model.stems)
    weights = np.array(model.weights)
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("word", pa.string()), ("quoted", pa.bool_())]))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value, hits = [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                start, _, found = _hits(text, machine, model.known)
                value.append(float(1 / (1 + np.exp(-(weights[0] + np.dot(weights[1:], features(text, machine, model.known) if found else np.zeros(len(FEATURES))))))))
                hits.append([{"start": int(start[i]), "end": int(start[i]) + len(w), "word": w, "quoted": q} for i, w, _, q in found])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(value, pa.float64()), pa.array(hits, spans)], names=["doc_id", "score", "hits"])

    scored = docs.select("doc_id", "text").mapInArrow(score, "doc_id long, score double, hits array<struct<start: long, end: long, word: string, quoted: boolean>>")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), F.size("hits").cast("long").alias("n_hits"), "hits")
