"""Suffix arrays by induced sorting, with numpy doing a whole bucket at a time."""

from __future__ import annotations

import numpy as np


def s_type(text: np.ndarray) -> np.ndarray:
    """For each suffix: is it smaller than the next one? The last is, as if an end of text smaller than all followed it twice."""
    n = len(text)
    rises = np.zeros(n, np.int8)
    rises[:-1] = np.sign(text[1:].astype(np.int64) - text[:-1])
    rises[-1] = -1
    # equal neighbours are of one type: take over the next decided one
    decided = np.where(rises != 0, np.arange(n), n)
    following = np.minimum.accumulate(decided[::-1])[::-1]
    return rises[following] > 0


class _Buckets:
    """Positions queued by first symbol, in the order they came."""

    def __init__(self, size: int):
        self.parts: list[list[np.ndarray]] = [[] for _ in range(size)]

    def put(self, symbols: np.ndarray, positions: np.ndarray) -> None:
        order = np.argsort(symbols, kind="stable")
        symbols, positions = symbols[order], positions[order]
        cuts = np.flatnonzero(np.concatenate(([True], symbols[1:] != symbols[:-1])))
        for start, end in zip(cuts, [*cuts[1:], len(symbols)], strict=True):
            self.parts[symbols[start]].append(positions[start:end])

    def take(self, symbol: int) -> np.ndarray:
        parts, self.parts[symbol] = self.parts[symbol], []
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _spread(text: np.ndarray, seeds: _Buckets, wanted: np.ndarray, symbols: range, first: np.ndarray | None) -> dict[int, np.ndarray]:
    """One induction pass: bucket by bucket, each suffix puts the one before it, if ``wanted``, behind those already in its bucket.

    ``seeds`` are scanned after what the pass itself put into their bucket.
    """
    made, done = _Buckets(symbols.stop if symbols.step > 0 else symbols.start + 1), {}
    if first is not None and len(first):
        made.put(text[first], first)

    def induce(scanned: np.ndarray, symbol: int) -> np.ndarray:
        before = scanned[scanned > 0] - 1
        before = before[wanted[before]]
        own = text[before] == symbol
        if not own.all():
            made.put(text[before[~own]], before[~own])
        return before[own]

    for symbol in symbols:
        wave, found = made.take(symbol), []
        while len(wave):
            found.append(wave)
            wave = induce(wave, symbol)
        done[symbol] = np.concatenate(found) if found else np.zeros(0, np.int64)
        late = seeds.take(symbol)
        if len(late):
            induce(late, symbol)
    return done


def induced(text: np.ndarray, small: np.ndarray, leftmost: np.ndarray, size: int) -> np.ndarray:
    """All suffixes in order, from the order of the leftmost smaller ones, in two linear passes."""
    seeds = _Buckets(size)
    if len(leftmost):
        seeds.put(text[leftmost], leftmost)
    last = np.array([len(text) - 1], np.int64)
    large = _spread(text, seeds, ~small, range(0, size), last[~small[last]])
    queue = _Buckets(size)
    for symbol, found in large.items():
        if len(found):
            queue.parts[symbol].append(found[::-1])
    less = _spread(text, queue, small, range(size - 1, -1, -1), None)
    return np.concatenate([x for symbol in range(size) for x in (large[symbol], less[symbol][::-1])])


def _ranks(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def suffix_array(text: np.ndarray, size: int = 257, depth: int | None = None) -> np.ndarray:
    """Positions of all suffixes in ascending order (of their first ``depth`` symbols at least, if given).

    Leftmost smaller substrings are sorted and named by one induction; the string of names, being over a large alphabet, is
    sorted by doubling where names repeat; a second induction gives the array.
    """
    n = len(text)
    if n < 2:
        return np.arange(n)
    small = s_type(text)
    places = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if not len(places):
        return induced(text, small, places, size)
    rough = induced(text, small, places, size)
    leftmost = np.zeros(n, bool)
    leftmost[places] = True
    rough = rough[leftmost[rough]]
    # equal substrings, from one leftmost smaller position to the next, get one name
    number = np.cumsum(leftmost) - 1
    ends = np.append(places[1:], n - 1)[number[rough]]
    lengths = ends - rough + 1
    differ = np.ones(len(rough), bool)
    same = np.flatnonzero(lengths[1:] == lengths[:-1]) + 1
    if len(same):
        offsets = np.arange(lengths[same].sum()) - np.repeat(np.cumsum(lengths[same]) - lengths[same], lengths[same])
        unequal = text[np.repeat(rough[same], lengths[same]) + offsets] != text[np.repeat(rough[same - 1], lengths[same]) + offsets]
        differ[same] = np.logical_or.reduceat(unequal, np.cumsum(lengths[same]) - lengths[same])
    names = np.empty(len(places), np.int64)
    names[number[rough]] = np.cumsum(differ) - 1
    span = 1  # names are in order of this many substrings, each of two symbols at least but for its shared end
    while names.max() + 1 < len(names) and (depth is None or span < depth):
        after = np.zeros(len(names), np.int64)
        after[:-span] = names[span:] + 1
        names = _ranks(names * (len(names) + 1) + after)
        span *= 2
    return induced(text, small, places[np.argsort(names, kind="stable")], size)


def reaches(order: np.ndarray, hashes: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """In text order: has a suffix as long a common prefix with the one before it in the array as ``hashes`` are of?"""
    before = np.full(len(order), -1, np.int64)
    before[order[1:]] = order[:-1]
    out = np.zeros(len(order), bool)
    at = np.flatnonzero(valid & (before >= 0))
    at = at[valid[before[at]]]
    out[at] = hashes[at] == hashes[before[at]]
    return out
