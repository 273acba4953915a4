"""Words, hashes and sliding windows over many texts at once, as numpy arrays inside a task.

A word is a run of bytes other than space and \\x09-\\x0D, which is what ``bytes.split()`` gives.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; it bounds memory, not results.
CHUNK_BYTES = 1 << 20
WHITESPACE = b" \t\n\x0b\x0c\r"
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def byte_texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """The texts of an Arrow string column as UTF-8 bytes; null is empty."""
    return [text or b"" for text in column.cast(pa.binary()).to_pylist()]


def chunks(column: pa.ChunkedArray | pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(row of the first, texts) in runs of about ``limit`` bytes; a longer text is a run of its own."""
    arrays = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    at = 0
    for array in arrays:
        start = 0
        sizes = pc.fill_null(pc.binary_length(array.cast(pa.binary())), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.cumsum(sizes)
        while start < len(array):
            before = total[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(total, before + limit, side="right")))
            yield at + start, byte_texts(array.slice(start, stop - start))
            start = stop
        at += len(array)


def flat_words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """All words in order, and for each text the position of its first word (one more entry at the end)."""
    words: list[bytes] = []
    ends = np.zeros(len(texts) + 1, np.int64)
    for i, text in enumerate(texts):
        words += text.split()
        ends[i + 1] = len(words)
    return words, ends


def hash_words(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word, the same in every process."""
    if not words:
        return np.zeros(0, np.uint64)
    array = np.empty(len(words), object)
    array[:] = words
    return pd.util.hash_array(array, categorize=False)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every ``width`` consecutive values, by differences of one running sum."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * _powers(_ODD, len(values)), dtype=np.uint64)))
    return mix((sums[width:] - sums[:-width]) * _powers(_INVERSE, n))


def whole_windows(ends: np.ndarray, width: int) -> np.ndarray:
    """For each start of a window over flat values: does it end in the text it starts in?"""
    n = max(0, int(ends[-1]) - width + 1)
    room = np.repeat(ends[1:], np.diff(ends))[:n]
    return np.arange(n) + width <= room


def sliding(values: np.ndarray, width: int, least: bool = True) -> np.ndarray:
    """Minimum (or maximum) of every ``width`` consecutive values."""
    take, out, have = (np.minimum if least else np.maximum), values, 1
    while have < width:
        step = min(have, width - have)
        out = take(out[:-step], out[step:])
        have += step
    return out


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n positions lie in a window of ``width`` from any of ``starts``."""
    edges = np.zeros(n + 1, np.int32)
    np.add.at(edges, starts, 1)
    np.subtract.at(edges, starts + width, 1)
    return np.cumsum(edges[:-1]) > 0


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
