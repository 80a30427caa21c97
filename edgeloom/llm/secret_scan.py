"""Secrets in texts: three fixed patterns, and a linear-chain conditional random field that adds what they miss.

The field tags the pieces (runs of letters and digits, single signs) of every suspicious word as secret begin, inside or
outside. A word is suspicious when it has six characters or more and a digit, one of ``_+/=`` or a capital after a small
letter; all other words, and white space, are fixed to outside, so each suspicious word is a chain of its own and the
best tagging of the text is the best of each chain (Viterbi). Features are piece shapes, the words before, and
features of the file. It is trained here on what the patterns find in a bounded sample.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 6_000  # documents the fit may read
SAMPLE_CHAINS = 20_000  # chains it may take of them
# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "model")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
NEAR_WORDS = {"password", "passwd", "pwd", "secret", "token", "key", "apikey", "api_key", "bearer", "credential", "auth", "authorization"}
_SUSPECT = re.compile(r"[0-9_+/=]|[a-z][A-Z]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_PIECE = re.compile(r"[A-Za-z0-9]+|[^A-Za-z0-9]")
_SIGNS = {"-": "dash", "_": "under", "/": "slash", "+": "plus", "=": "equals", ".": "dot", "@": "at", ":": "colon", '"': "quote", "'": "quote", "`": "quote"}
TAGS = 3  # outside, begin, inside
LONGEST_FIT = 64  # pieces of a chain used in the fit

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each pattern, whole match, in order of start and then kind."""
    found: list[Span] = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return ordered(found)


def value_spans(text: str) -> list[tuple[int, int]]:
    """The secret values of the base matches."""
    found = [(m.start(), m.end()) for p in (ACCESS, HEX) for m in p.finditer(text)]
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [m.span(2) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    return found


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


@dataclass(frozen=True)
class Chain:
    """Pieces of one suspicious word: places in the text, and a set of features for each."""

    places: list[tuple[int, int]]
    features: list[list[str]]


def _bucket(n: int, edges: tuple[int, ...]) -> int:
    return sum(n >= e for e in edges)


def _shape(piece: str) -> list[str]:
    if not piece[0].isascii() or not piece[0].isalnum():
        return ["sign=" + _SIGNS.get(piece, "other")]
    digits = sum(c.isdigit() for c in piece)
    upper, lower = piece.upper() == piece, piece.lower() == piece
    kind = "digits" if digits == len(piece) else ("mixed" if digits else "letters") + ("-upper" if upper else "-lower" if lower else "-title" if piece.istitle() else "-both")
    counts = Counter(piece).values()
    bits = -sum(k / len(piece) * math.log2(k / len(piece)) for k in counts)
    out = [f"kind={kind}", f"size={_bucket(len(piece), (2, 4, 6, 9, 13, 16, 17, 20, 24, 32))}", f"bits={_bucket(int(bits * 10), (15, 25, 30, 35, 40))}"]
    if len(piece) >= 6 and all(c in "0123456789abcdef" for c in piece):
        out.append("hex")
    return [*out, f"{kind}:{out[1]}"]


def chains(text: str) -> Iterator[Chain]:
    """The suspicious words of a text, in order."""
    at, n = 0, len(text)
    words: list[tuple[str, int]] = []
    while (m := _SUSPECT.search(text, at)) is not None:
        start = m.start()
        while start > 0 and text[start - 1] not in " \t\n\x0b\f\r":
            start -= 1
        word = _WORD.match(text, start)
        at = word.end()
        if word.end() - start >= 6:
            words.append((word[0], start))
        if at >= n:
            break
    if not words:
        return
    low = text.lower()
    file = [f"file-words={_bucket(len(words), (2, 5, 20, 100))}", f"file-dense={_bucket(len(words) * 1000 // max(1, n), (1, 5, 20))}"]
    file += ["file-keyword"] if any(k in low for k in KEYWORDS) else []
    for word, start in words:
        before = [w.strip("\"'`.,;()[]{}<>").lower() for w in _WORD.findall(text[max(0, start - 60) : start])][-3:]
        near = [f"near{k}" for k, w in enumerate(reversed(before)) if w.rstrip(":=") in NEAR_WORDS]
        near += ["after-set"] if before and (before[-1][-1:] in (":", "=") or before[-1] in ("is", "=")) else []
        near += ["has-at"] if "@" in word else []
        near += ["has-link"] if "://" in word else []
        near += [f"dots={min(3, word.count('.'))}"]
        pieces = [(m[0], start + m.start(), start + m.end()) for m in _PIECE.finditer(word)]
        shapes = [_shape(p) for p, _, _ in pieces]
        seen, features = False, []
        for i, (piece, _, _) in enumerate(pieces):
            own = [*shapes[i], *near, *file, "before=" + (shapes[i - 1][0] if i else "edge"), "after=" + (shapes[i + 1][0] if i + 1 < len(pieces) else "edge")]
            own += ["in-keyword"] if seen else []
            own += ["kind-near=" + shapes[i][0]] if any(x.startswith("near") for x in near) or seen else []
            features.append(own)
            seen = seen or piece.lower() in NEAR_WORDS
        yield Chain([(a, b) for _, a, b in pieces], features)


def tags_of(chain: Chain, values: list[tuple[int, int]]) -> list[int]:
    """0, 1 (the first piece of a value) or 2 for each piece."""
    out, last = [], None
    for a, b in chain.places:
        hit = next((v for v in values if v[0] <= a and b <= v[1]), None)
        out.append(0 if hit is None else 2 if hit == last else 1)
        last = hit
    return out


@dataclass(frozen=True)
class Field:
    """emit: tag scores by feature name; step: scores of one tag after another; the chain stands between outsides."""

    emit: dict[str, tuple[float, float, float]]
    step: tuple[tuple[float, float, float], ...]

    def decode(self, chain: Chain) -> list[int]:
        """The tagging of the greatest score (Viterbi); ties take the lower tag."""
        score, back = [self.step[0][t] for t in range(TAGS)], []
        for i, own in enumerate(chain.features):
            here = [0.0] * TAGS
            for f in own:
                for t, w in enumerate(self.emit.get(f, (0.0, 0.0, 0.0))):
                    here[t] += w
            if i:
                from_ = [max(range(TAGS), key=lambda s: (score[s] + self.step[s][t], -s)) for t in range(TAGS)]
                score = [score[from_[t]] + self.step[from_[t]][t] + here[t] for t in range(TAGS)]
                back.append(from_)
            else:
                score = [score[t] + here[t] for t in range(TAGS)]
        tag = max(range(TAGS), key=lambda s: (score[s] + self.step[s][0], -s))
        out = [tag]
        for from_ in reversed(back):
            out.append(from_[out[-1]])
        return out[::-1]

    def spans(self, text: str) -> list[tuple[int, int]]:
        out: list[list[int]] = []
        for chain in chains(text):
            last = 0
            for (a, b), tag in zip(chain.places, self.decode(chain)):
                if tag == 1 or (tag == 2 and last == 0):
                    out.append([a, b])
                elif tag == 2:
                    out[-1][1] = b
                last = tag
        return [(a, b) for a, b in out]


def fit(sequences: list[tuple[list[list[str]], list[int]]], steps: int = 250, ridge: float = 0.02) -> Field:
    """Maximum likelihood with a ridge, by Adam over all chains at once; a begin may not follow nothing but outside or a
    value, and an inside never follows outside."""
    names = sorted({f for feats, _ in sequences for own in feats for f in own})
    at = {f: i for i, f in enumerate(names)}
    longest = max((len(t) for _, t in sequences), default=1)
    n = len(sequences)
    if not n or not any(any(t) for _, t in sequences):
        return Field({}, ((0.0, -9.0, -9.0),) * TAGS)
    width = max(len(own) for feats, _ in sequences for own in feats)
    ids = np.full((n, longest, width), len(names), np.int32)
    gold = np.zeros((n, longest), np.int64)
    size = np.array([len(t) for _, t in sequences])
    for i, (feats, tags) in enumerate(sequences):
        gold[i, : len(tags)] = tags
        for j, own in enumerate(feats):
            ids[i, j, : len(own)] = [at[f] for f in own]
    live = np.arange(longest)[None, :] < size[:, None]
    w, a = np.zeros((len(names) + 1, TAGS)), np.zeros((TAGS, TAGS))
    banned = np.zeros((TAGS, TAGS))
    banned[0, 2] = -30.0
    want_w, want_a = np.zeros_like(w), np.zeros_like(a)
    rows, cols = np.nonzero(live)
    hot = np.eye(TAGS)[gold[rows, cols]]
    np.add.at(want_w, ids[rows, cols].ravel(), np.repeat(hot, width, axis=0))
    before = np.where(cols > 0, gold[rows, cols - 1], 0)
    np.add.at(want_a, (before, gold[rows, cols]), 1)
    np.add.at(want_a, (gold[np.arange(n), size - 1], np.zeros(n, int)), 1)
    m1 = [np.zeros_like(w), np.zeros_like(a)]
    m2 = [np.zeros_like(w), np.zeros_like(a)]
    total = lambda x, axis: (x.max(axis, keepdims=True) + np.log(np.exp(x - x.max(axis, keepdims=True)).sum(axis, keepdims=True))).squeeze(axis)
    for step in range(1, steps + 1):
        w[-1] = 0
        e, t = w[ids].sum(2), a + banned
        alpha, beta = np.zeros((n, longest, TAGS)), np.zeros((n, longest, TAGS))
        alpha[:, 0] = t[0] + e[:, 0]
        for j in range(1, longest):
            alpha[:, j] = np.where(live[:, j, None], total(alpha[:, j - 1, :, None] + t, 1) + e[:, j], alpha[:, j - 1])
        beta[:] = t[:, 0]
        for j in range(longest - 2, -1, -1):
            beta[:, j] = np.where(live[:, j + 1, None], total(t + (e[:, j + 1] + beta[:, j + 1])[:, None, :], 2), t[:, 0])
        z = total(alpha[:, -1] + t[:, 0], 1)
        unary = np.exp(alpha + beta - z[:, None, None]) * live[..., None]
        got_w, got_a = np.zeros_like(w), np.zeros_like(a)
        np.add.at(got_w, ids[rows, cols].ravel(), np.repeat(unary[rows, cols], width, axis=0))
        got_a[0] += unary[:, 0].sum(0)
        got_a[:, 0] += unary[np.arange(n), size - 1].sum(0)
        for j in range(1, longest):
            if live[:, j].any():
                k = live[:, j]
                pair = alpha[k, j - 1, :, None] + t + (e[k, j] + beta[k, j])[:, None, :] - z[k, None, None]
                got_a += np.exp(pair).sum(0)
        for x, got, want, u, v in ((w, got_w, want_w, m1[0], m2[0]), (a, got_a, want_a, m1[1], m2[1])):
            slope = (got - want) / n * 20 + ridge * x
            u[:] = 0.9 * u + 0.1 * slope
            v[:] = 0.99 * v + 0.01 * slope**2
            x -= 0.1 * (u / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    step_ = a + banned
    return Field({f: tuple(float(x) for x in w[i]) for f, i in at.items()}, tuple(tuple(float(x) for x in r) for r in step_))


def train(docs: DataFrame, rows: int = SAMPLE_ROWS, most: int = SAMPLE_CHAINS) -> Field:
    """A field from at most ``most`` chains of at most ``rows`` documents (least hash of doc_id), taught by the patterns."""
    ids = F.broadcast(docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))  # 8 bytes a row

    def taught(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            feats, tags, order = [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                values = value_spans(text or "")
                for chain in chains(text or ""):
                    feats.append([" ".join(own) for own in chain.features[:LONGEST_FIT]])
                    tags.append(tags_of(chain, values)[:LONGEST_FIT])
                    order.append(hashlib.md5(f"{doc}:{chain.places[0][0]}".encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(order, pa.string()), pa.array(feats, pa.list_(pa.string())), pa.array(tags, pa.list_(pa.int32()))], names=["ord", "feats", "tags"])

    found = docs.select("doc_id", "text").join(ids, "doc_id").mapInArrow(taught, "ord string, feats array<string>, tags array<int>")
    got = found.orderBy("ord").limit(most).collect()
    return fit([([f.split(" ") for f in r.feats], list(r.tags)) for r in got])


def scan(docs: DataFrame, field: Field) -> DataFrame:
    """Per input row: doc_id, n_assign, n_access, n_hex, n_model, base_sha256, spans and the found strings as ``secrets``.

    Places are code points, end exclusive; spans of the field that touch a base span are left to it. Null texts count as
    empty and have no spans; repeated rows give equal rows; a null doc_id is kept. Other columns are not read.
    """

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                text = text.as_py() or ""
                base = base_spans(text)
                added = [("model", a, b) for a, b in field.spans(text) if not any(a < y and x < b for _, x, y in base)]
                every = ordered(base + added)
                n = Counter(k for k, _, _ in every)
                rows.append((n["assign"], n["access"], n["hex"], n["model"], hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), [text[a:b] for _, a, b in every]))
            kinds = (*[pa.int64()] * 4, pa.string(), pa.string(), pa.list_(pa.string()))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_assign", "n_access", "n_hex", "n_model", "base_sha256", "spans", "secrets"])

    return docs.select("doc_id", "text").mapInArrow(read, "doc_id long, n_assign long, n_access long, n_hex long, n_model long, base_sha256 string, spans string, secrets array<string>")
