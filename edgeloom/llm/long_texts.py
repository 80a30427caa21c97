"""Pieces of texts that end at a separator, so that tokens of very long texts are made in bounded memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from edgeloom.llm.words import text_chunks

PART_BYTES = 1 << 18


def _cuts(data: np.ndarray, low: int, high: int, breaks: np.ndarray, size: int) -> list[int]:
    """Places in low..high where a separator stands, at least ``size`` bytes apart."""
    out, at = [], low + size
    while at < high:
        look = at
        while look < high and not breaks[data[look : look + size]].any():
            look += size
        if look >= high:
            break
        at = look + int(np.argmax(breaks[data[look : min(look + size, high)]]))
        if at >= high:
            break
        out.append(at)
        at += size
    return out


def text_parts(batch: pa.RecordBatch, breaks: np.ndarray, column: str = "text", size: int = PART_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of each part, bytes, bounds of the parts in them): whole texts together up to 2 * size bytes, longer texts part by part.

    No token crosses a part, as parts begin at a byte of ``breaks``; a run without separators stays whole. Null is empty.
    """
    for low, high, data, bounds in text_chunks(batch, column, 2 * size):
        if high - low > 1 or bounds[-1] <= 2 * size:
            yield np.arange(low, high), data, bounds
            continue
        edges = [0, *_cuts(data, 0, int(bounds[-1]), breaks, size), int(bounds[-1])]
        for a, b in zip(edges, edges[1:]):
            yield np.array([low]), data[a:b], np.array([0, b - a])
