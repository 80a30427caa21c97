"""Words of whole texts as 64-bit numbers, for a batch of documents at once.

A word is a run of bytes other than space and ``\\x09-\\x0D``. Hashes are polynomial over the bytes, then mixed;
windows of words are polynomial over word hashes, then mixed, so any window costs two look-ups in a running sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20
_BYTE_STEP, _WORD_STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_tables: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2 ** 64."""
    have = _tables.get(base)
    if have is None or len(have) <= n:
        steps = np.full(max(n + 1, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = _tables[base] = np.cumprod(steps, dtype=np.uint64)
    return have


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of values[s:e] for each pair, equal for equal runs wherever they stand."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values))[: len(values)], out=total[1:])
    span = (total[ends] - total[starts]) * powers(inverse(base), len(values))[starts]
    return mix(span + (ends - starts).astype(np.uint64))


class Words:
    """hashes: of all words; first[i]:first[i+1] are those of text i; start, end: byte places in ``data``."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, lower: bool = False):
        self.data = LOWER[data] if lower else data
        self.bounds = bounds
        solid = ~SPACE[self.data]
        opens, shuts = solid.copy(), solid.copy()
        opens[1:] &= ~solid[:-1]
        shuts[:-1] &= ~solid[1:]
        inner = bounds[(bounds > 0) & (bounds < len(data))]
        opens[inner] = solid[inner]
        shuts[inner - 1] = solid[inner - 1]
        self.start, self.end = np.flatnonzero(opens), np.flatnonzero(shuts) + 1
        self.hashes = run_hashes(self.data, self.start, self.end, _BYTE_STEP)
        self.first = np.searchsorted(self.start, bounds)
        self.counts = np.diff(self.first)

    def owners(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def window_starts(self, n: int) -> np.ndarray:
        """Places of the first word of every run of n words inside one text."""
        owner = self.owners()
        at = np.arange(len(owner))
        return at[at + n <= self.first[owner + 1]]

    def windows(self, starts: np.ndarray, n: int) -> np.ndarray:
        return run_hashes(self.hashes, starts, starts + n, _WORD_STEP)

    def word_bytes(self, i: int) -> list[bytes]:
        """The words of text i, unchanged but for the lower case asked for."""
        return self.data[self.bounds[i] : self.bounds[i + 1]].tobytes().split()


def text_chunks(batch: pa.RecordBatch, column: str = "text", size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, bytes, bounds) of about ``size`` bytes each; a longer text is a chunk of its own. Null is empty."""
    texts = batch.column(column)
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    texts = texts.fill_null("") if texts.null_count else texts
    n = len(texts)
    if n == 0:
        return
    _, offsets, data = texts.buffers()
    places = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(places, places[low] + size, side="right")) - 1)
        high = min(high, n)
        yield low, high, raw[places[low] : places[high]], places[low : high + 1] - places[low]
        low = high


def text_words(batch: pa.RecordBatch, lower: bool = False, column: str = "text") -> Iterator[tuple[int, int, Words]]:
    for low, high, data, bounds in text_chunks(batch, column):
        yield low, high, Words(data, bounds, lower)
