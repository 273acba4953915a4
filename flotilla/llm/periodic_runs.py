"""Periodic runs of words inside texts: stretches that repeat themselves at least twice.

Two places share a suffix class at level l if their next l words are equal. Classes are united in the order of falling
longest common prefixes, from the neighbours of a suffix array, by union-find; each class keeps its places in order. When two classes
meet at level l, places that become neighbours at a distance of d <= l are the ends of two equal stretches without gap: the words from the
first place on have period d up to l words behind the second, and no further. Every run is found from its first place, with
its smallest period: a place in between would mean a smaller one.

A run of at least ``least`` words with two periods or more has a first place whose next ``(least + 1) // 2`` words come again, so only
places with such a window are sorted at all. Texts are worked on many at a time, as numpy arrays inside a task.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .tables import unwrapped, wrapped

LEAST_WORDS = 12
END = 1 << 62
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_RESULT = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


class OrderedPlaces:
    """Places in order, in pieces of bounded length, so that a place is added without moving all behind it."""

    PIECE = 512
    __slots__ = ("pieces", "tops", "size")

    def __init__(self, place: int):
        self.pieces, self.tops, self.size = [[place]], [place], 1

    def add(self, place: int) -> tuple[int, int]:
        """Put a new place in; its neighbours are returned, -1 where there is none."""
        at = min(bisect_left(self.tops, place), len(self.tops) - 1)
        piece = self.pieces[at]
        i = bisect_left(piece, place)
        below = piece[i - 1] if i else self.tops[at - 1] if at else -1
        above = piece[i] if i < len(piece) else -1
        piece.insert(i, place)
        self.tops[at] = piece[-1]
        self.size += 1
        if len(piece) > self.PIECE:
            half = len(piece) // 2
            self.pieces[at:at + 1] = [piece[:half], piece[half:]]
            self.tops[at:at + 1] = [piece[half - 1], piece[-1]]
        return below, above

    def __iter__(self) -> Iterator[int]:
        for piece in self.pieces:
            yield from piece


def _ranked(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The rank, from 0, of each pair of numbers below 2**31; equal pairs have one rank."""
    return np.unique(first.astype(np.int64) << 32 | second.astype(np.int64), return_inverse=True)[1].astype(np.int32)


def sorted_suffixes(values: np.ndarray, room: np.ndarray, open_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places ``open_at`` in the order of what follows them in their text, and each one's longest common prefix with the one before.

    ``values`` are non-negative numbers of words, ``room`` the words from each place to the end of its text: no prefix goes beyond it. Ranks of
    doubled length tell places apart until all differ; common prefixes are put together from the ranks, the longest first.
    """
    n = len(values)
    past = np.arange(n) + room
    levels, width, ranks = [], 1, values.astype(np.int32)
    longest = int(room.max(initial=0))
    while True:
        levels.append(ranks)
        if width >= longest or len(np.unique(ranks[open_at])) == len(open_at):
            break
        inside = np.arange(n) + width < past
        follow = np.where(inside, ranks[np.minimum(np.arange(n) + width, n - 1)] + 1, 0)
        ranks = _ranked(ranks, follow)
        width *= 2
    order = open_at[np.argsort(levels[-1][open_at], kind="stable")]
    left, right = order[:-1].copy(), order[1:].copy()
    common = np.zeros(len(left), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        width, ranks = 1 << level, levels[level]
        fits = (common + width <= room[order[:-1]]) & (common + width <= room[order[1:]])
        same = fits & (ranks[np.minimum(left, n - 1)] == ranks[np.minimum(right, n - 1)])
        common[same] += width
        left[same] += width
        right[same] += width
    return order, common


def _seeds(order: list[int], common: list[int], least_common: int) -> Iterator[tuple[int, int, int]]:
    """(place, distance, level) of places that become neighbours at a distance within the level at which their classes meet."""
    parent = list(range(len(order)))
    held: list[OrderedPlaces | None] = [OrderedPlaces(place) for place in order]

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    joints = sorted((i for i, level in enumerate(common) if level >= least_common), key=lambda i: -common[i])
    for i in joints:
        level, a, b = common[i], root(i), root(i + 1)
        if held[a].size < held[b].size:
            a, b = b, a
        large, small = held[a], held[b]
        parent[b], held[b] = a, None
        places = list(small)
        # neighbours of one class met before, at their own level
        for place, last, following in zip(places, [-1, *places[:-1]], [*places[1:], END], strict=True):
            below, above = large.add(place)
            if -1 < below != last and place - below <= level:
                yield below, place - below, level
            if -1 < above < following and above - place <= level:
                yield place, above - place, level


def runs_of(values: np.ndarray, ends: np.ndarray, least: int = LEAST_WORDS) -> list[tuple[int, int, int]]:
    """All runs as (start, length, period), by start and period, of texts whose words are numbered in ``values``.

    ``ends`` has the place of each text's first word, and the end of the last one. Runs don't go from text to text. A run has at
    least ``least`` words and two periods.
    """
    n, window = len(values), (least + 1) // 2
    if n < least:
        return []
    room = np.repeat(ends[1:], np.diff(ends)) - np.arange(n)
    text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    # windows that come again in their text, by hash: equal windows have equal hashes, and more does no harm
    hashes = W.window_hashes(W.mix(values.astype(np.uint64) + np.uint64(1)), window) ^ W.mix(text[:n - window + 1].astype(np.uint64) + np.uint64(7))
    whole = np.flatnonzero(room[:n - window + 1] >= window)
    by = np.argsort(hashes[whole], kind="stable")
    near = hashes[whole][by]
    again = np.concatenate(([False], near[1:] == near[:-1]))
    again[:-1] |= again[1:]
    open_at = np.sort(whole[by[again]])
    if not len(open_at):
        return []
    # sort only the texts that have any
    wanted = np.unique(text[open_at])
    keep = np.isin(text, wanted)
    back = np.flatnonzero(keep)
    place = np.cumsum(keep) - 1
    # a text's own numbers, so that no two texts have a common prefix
    own = np.unique(text[back] << 32 | values[back].astype(np.int64), return_inverse=True)[1]
    order, common = sorted_suffixes(own, room[back], place[open_at])
    found: dict[tuple[int, int], int] = {}
    for start, period, level in _seeds(order.tolist(), common.tolist(), window):
        key = start + period + level, period
        found[key] = min(found.get(key, start), start)
    return sorted((int(back[start]), end - start, period) for (end, period), start in found.items() if end - start >= least)


def find_runs(docs: DataFrame, text: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """Rows of ``docs`` with ``n_words``, ``runs`` and ``collapsed``.

    ``runs`` are structs ``start, length, period`` by start, then period, in words from 0: stretches that have their smallest period
    throughout, two of it or more and at least ``least`` words, and that no neighbouring word extends. ``collapsed`` is the text's words joined by one
    space, without those that some run holds behind its first period. Null and empty texts have no words, no runs and an empty ``collapsed``.
    Each row is looked at by itself, without a shuffle: repeated rows get equal results. Results replace columns of their names. An empty table
    gives an empty table. Memory is that of 1 MB of text, or of one text where that is longer.
    """
    rows = wrapped(docs, text=F.col(text).cast("string"))
    schema = T.StructType([rows.schema["row"], *T._parse_datatype_string(_RESULT).fields])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in W.chunks(batch.column("text")):
                lists, counts, collapsed = _looked_at(texts, least)
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(at, len(texts)), counts, lists, collapsed], [f.name for f in schema.fields])

    return unwrapped(rows.mapInArrow(look, schema), {f.name: F.col(f.name) for f in schema.fields[1:]})


def _looked_at(texts: list[bytes], least: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    words, ends = W.flat_words(texts)
    values = pd.factorize(np.array(words, object))[0] if words else np.zeros(0, np.int64)
    runs = runs_of(values, ends, least)
    starts, lengths, periods = (np.array([r[i] for r in runs], np.int64) for i in range(3))
    owner = np.searchsorted(ends, starts, side="right") - 1
    offsets = np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32)
    flat = pa.StructArray.from_arrays([pa.array(starts - ends[owner]), pa.array(lengths), pa.array(periods)], fields=list(_RUN))
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, starts + periods, 1)
    np.subtract.at(edges, starts + lengths, 1)
    stay = np.cumsum(edges[:-1]) == 0
    short = set(np.unique(owner).tolist())
    collapsed = [b" ".join(words[k] for k in (np.flatnonzero(stay[a:b]) + a).tolist()) if i in short else b" ".join(words[a:b])
                 for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))]
    return (pa.ListArray.from_arrays(pa.array(offsets), flat), pa.array(np.diff(ends)),
            pa.array([x.decode(errors="replace") for x in collapsed], pa.string()))


def longest(runs: Column) -> Column:
    """The run of greatest length, the first of those by start and period; null without runs."""
    return F.array_min(F.transform(runs, lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period"))))
