"""Suffix-array dedup: byte strings of ``width`` that occur anywhere else.

Each string of ``width`` bytes names its anchor, the least hash of the ``ANCHOR``-byte strings in it; equal strings have equal
anchors. Neighbouring strings with one anchor are a stretch. Blocks of documents ask about their anchors: one
that occurs once in the corpus makes its stretch unique; one that always occurs in the same stretch, byte for byte,
makes the whole stretch repeated. Only where an anchor occurs in different stretches is it open which strings
repeat. Those stretches are cut into shards and a suffix array is built of each by induced sorting. Where the common
prefix of neighbours in the array, brought back to text order, reaches ``width``, the strings are equal; one of each group
of equals asks the other blocks.

A string is taken as equal if its 64-bit hash is.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import words as W
from .suffix_array import reaches, suffix_array
from .tables import KEEPING, workers_with

WIDTH = 200
ANCHOR = 64
#: Bytes whose hashes are worked on at once, so few that their arrays stay in a core's cache, and bytes of stretches in a suffix array.
#: A longer text or stretch is not cut.
CHUNK_BYTES = 24 << 10
SHARD_BYTES = 1 << 19
BLOCK_BYTES = 4 << 20
UNIQUE, REPEATED, OPEN = 0, 1, 2
_RESULT = "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"
_BYTE = np.random.default_rng(64).integers(0, 1 << 64, 258, dtype=np.uint64)  # a fixed 64-bit value for each byte and for a border


@dataclass
class Stretches:
    """Neighbouring strings with one anchor: starts ``first`` to ``last`` in the block's bytes."""

    anchor: np.ndarray  # its hash, spread evenly
    content: np.ndarray  # hash of all their bytes
    places: np.ndarray  # how often the anchor occurs in them
    first: np.ndarray
    last: np.ndarray

    def of(self, chosen: np.ndarray) -> Stretches:
        return Stretches(*(x[chosen] for x in (self.anchor, self.content, self.places, self.first, self.last)))


def stretches(data: np.ndarray, ends: np.ndarray, width: int, anchor: int) -> Stretches:
    """Of texts that follow each other in ``data``."""
    inside = W.whole_windows(ends, width)
    if not inside.any():
        return Stretches(*[np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64)])
    values = _BYTE[data]
    small = W.window_hashes(values, anchor)
    least = W.sliding(small, width - anchor + 1)
    known = np.zeros(len(small) + 2 * (width - anchor), np.uint64)
    known[width - anchor:][np.flatnonzero(inside)] = least[:len(inside)][inside]
    is_place = W.sliding(known, width - anchor + 1, least=False)[:len(small)] == small
    del known, values
    begins = inside.copy()
    begins[1:] &= (least[1:len(inside)] != least[:len(inside) - 1]) | ~inside[:-1]
    starts = np.zeros(len(inside), bool)
    starts[ends[:-1][ends[:-1] < len(inside)]] = True
    first = np.flatnonzero(begins | (inside & starts))
    stops = np.append(first[1:], len(inside))
    counted = np.concatenate(([0], np.cumsum(inside)))
    last = first + counted[stops] - counted[first] - 1
    # an anchor's places between the first string's start and the last one's end
    at = np.flatnonzero(is_place)
    by_value = np.lexsort((at, small[at]))
    value, at = small[at][by_value], at[by_value]
    own = least[first]
    count = lambda limits, side: _between(value, at, own, limits, side)
    places = count(last + width - anchor, "right") - count(first, "left")
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * W._powers(W._ODD, len(data)), dtype=np.uint64)))
    content = (sums[last + width] - sums[first]) * W._powers(W._INVERSE, len(data))[first]
    content = W.mix(content ^ W.mix((last - first + width).astype(np.uint64)))
    # least hashes lie close to zero, where all would meet in the first buckets
    return Stretches(W.mix(own), np.maximum(content, 1), places, first, last)


def _between(value: np.ndarray, at: np.ndarray, wanted: np.ndarray, limit: np.ndarray, side: str) -> np.ndarray:
    """How many (value, at), sorted, come before (wanted, limit)."""
    start = np.searchsorted(value, wanted, side="left")
    ranks = np.unique(value, return_inverse=True)[1].astype(np.int64)
    wide = int(max(at.max(initial=0), limit.max(initial=0))) + 2
    del start
    rank = np.searchsorted(np.unique(value), wanted)
    return np.searchsorted(ranks * wide + at, rank * wide + limit, side=side)


class _Block:
    def __init__(self, group: pa.Table, width: int, anchor: int):
        self.group, self.width, self.anchor = group, width, anchor
        found, ends, whole, at = [], [np.zeros(1, np.int64)], [], 0
        for _, texts in W.chunks(group["text"], CHUNK_BYTES):
            data = np.frombuffer(b"".join(texts), np.uint8)
            own = np.concatenate(([0], np.cumsum([len(x) for x in texts]))).astype(np.int64)
            part = stretches(data, own, width, anchor)
            part.first, part.last = part.first + at, part.last + at
            found.append(part)
            ends.append(own[1:] + at)
            whole.append(data)
            at += len(data)
        self.ends, self.data = np.concatenate(ends), np.concatenate(whole) if whole else np.zeros(0, np.uint8)
        self.all = Stretches(*[np.concatenate([getattr(x, name) for x in found]) if found else np.zeros(0, np.int64) for name in ("anchor", "content", "places", "first", "last")])
        order = np.argsort(self.all.anchor, kind="stable")
        self.all = self.all.of(order)
        self.first_of = B.runs(self.all.anchor)[0] if len(order) else np.zeros(0, bool)
        self.keys = self.all.anchor[self.first_of]
        self.number = np.cumsum(self.first_of) - 1

    def local(self) -> tuple[np.ndarray, np.ndarray]:
        """What the block alone says of each anchor, and the one stretch it occurs in, 0 if there are several."""
        if not len(self.keys):
            return np.zeros(0, np.uint8), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.first_of)
        one = np.minimum.reduceat(self.all.content, at) == np.maximum.reduceat(self.all.content, at)
        often, places = np.diff(np.append(at, len(self.number))), np.add.reduceat(self.all.places, at)
        says = np.where(places == 1, UNIQUE, np.where(one & (places == often), REPEATED, OPEN)).astype(np.uint8)
        return says, np.where(says == OPEN, 0, self.all.content[at]).astype(np.uint64)

    def status(self, answered: pa.Table, buckets: int) -> np.ndarray:
        """UNIQUE, REPEATED or OPEN for each stretch."""
        return np.maximum(self.local()[0], B.read_answers(answered, self.keys, buckets, 0, np.uint8))[self.number]

    def shards(self, open_: np.ndarray):
        """(symbols, start of each in the block's bytes, is it the start of a string, hashes of the strings) of open stretches, by anchor."""
        chosen = self.all.of(open_)
        sizes = chosen.last - chosen.first + self.width + 1
        cuts = np.searchsorted(np.cumsum(sizes), np.arange(SHARD_BYTES, sizes.sum() + SHARD_BYTES, SHARD_BYTES))
        start = 0
        for cut in np.unique(np.minimum(cuts + 1, len(sizes))):
            own, size = slice(start, cut), sizes[start:cut]
            start = cut
            if not len(size):
                continue
            begin = np.cumsum(size) - size
            at = np.repeat(chosen.first[own] - begin, size) + np.arange(size.sum())
            border = np.zeros(len(at), bool)
            border[begin + size - 1] = True
            symbols = np.where(border, 0, self.data[np.minimum(at, len(self.data) - 1)].astype(np.int16) + 1)
            valid = np.zeros(len(at), bool)
            room = len(at) - self.width + 1
            offset = np.arange(len(at)) - np.repeat(begin, size)
            valid[:room] = (offset < np.repeat(size - self.width, size))[:room]
            hashes = np.zeros(len(at), np.uint64)
            hashes[:room] = W.window_hashes(_BYTE[symbols], self.width)
            yield symbols, at, valid, hashes


def _equal_groups(own: _Block, open_: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct strings of open stretches, by hash, and at how many places of the block each occurs (2 stands for more)."""
    keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for symbols, at, valid, hashes in own.shards(open_):
        order = suffix_array(symbols, 257, width)
        alike = reaches(order, hashes, valid)
        sorted_ = order[valid[order]]
        first = np.flatnonzero(~alike[sorted_])
        low, high = np.minimum.reduceat(at[sorted_], first), np.maximum.reduceat(at[sorted_], first)
        keys.append(hashes[sorted_[first]])
        counts.append(np.where(low < high, 2, 1))
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    named, place = np.unique(keys, return_inverse=True)
    return named, np.minimum(np.bincount(place, counts, len(named)), 2).astype(np.uint32)


def _same_stretch(keys: np.ndarray, blocks: np.ndarray, content: np.ndarray) -> np.ndarray:
    """For anchors: UNIQUE if no other block has it, REPEATED if all have it in one stretch, else OPEN."""
    first, often = B.runs(keys)
    at, number = np.flatnonzero(first), np.cumsum(first) - 1
    low, high = np.minimum.reduceat(content, at)[number], np.maximum.reduceat(content, at)[number]
    return np.where(often == 1, UNIQUE, np.where((low == high) & (low > 0), REPEATED, OPEN)).astype(np.uint8)


def _twice(keys: np.ndarray, blocks: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return (B.in_all_blocks(keys, blocks, counts) > 1).astype(np.uint8)


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH, anchor: int = ANCHOR,
                   block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) of each row: its UTF-8 bytes without those in a repeated string of ``width`` bytes.

    Strings don't cross rows. All places of a repeated string go, the first included. Null texts are empty. Every row is a
    document of its own, also if its key is null or repeated. ``kept`` is binary, for a cut may split a character. Other columns
    are not read. Empty in, empty out.
    """
    spark = docs.sparkSession
    (rows, *_), total = B.measured_blocks(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")), "id", "text", block_bytes)
    buckets = B.buckets_for(spark, total)

    def ask_anchors(group: pa.Table) -> pa.Table:
        own = _Block(group, width, anchor)
        return B.questions(group["block"][0].as_py(), own.keys, buckets, 0, own.local()[1])

    def ask_strings(group: pa.Table, answered: pa.Table) -> pa.Table:
        if not len(group):
            return B.ASKED_SCHEMA.empty_table()
        own = _Block(group, width, anchor)
        keys, counts = _equal_groups(own, own.status(answered, buckets) == OPEN, width)
        return B.questions(group["block"][0].as_py(), keys, buckets, 1, counts)

    def cut(group: pa.Table, answered: pa.Table) -> pa.Table:
        own = _Block(group, width, anchor)
        status = own.status(answered, buckets)
        edges = np.zeros(len(own.data) + 1, np.int32)
        sure = own.all.of(status == REPEATED)
        np.add.at(edges, sure.first, 1)
        np.subtract.at(edges, sure.last + width, 1)
        parts = [(at[valid], hashes[valid]) for _, at, valid, hashes in own.shards(status == OPEN)]
        if parts:
            at, hashes = (np.concatenate(x) for x in zip(*parts, strict=True))
            named, place = np.unique(hashes, return_inverse=True)
            at = at[B.read_answers(answered, named, buckets, 1, np.uint8)[place] > 0]
            np.add.at(edges, at, 1)
            np.subtract.at(edges, at + width, 1)
        gone = np.cumsum(edges[:-1]) > 0
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        begins[own.ends[:-1][own.ends[:-1] < len(gone)]] |= gone[own.ends[:-1][own.ends[:-1] < len(gone)]]
        per_row = lambda marks: np.diff(np.concatenate(([0], np.cumsum(marks)))[own.ends])
        kept = [own.data[a:b][~gone[a:b]].tobytes() for a, b in zip(own.ends[:-1], own.ends[1:], strict=True)]
        return pa.table({"id": group["id"], "n_bytes": np.diff(own.ends), "n_removed": per_row(gone), "n_spans": per_row(begins), "kept": pa.array(kept, pa.binary())})

    with workers_with(spark, KEEPING):
        asked = rows.groupBy("block").applyInArrow(ask_anchors, B.ASKED)
        first = B.answers(asked, _same_stretch, np.uint8, np.uint64)
        asked = rows.groupBy("block").cogroup(first.groupBy("block")).applyInArrow(ask_strings, B.ASKED)
        second = B.answers(asked, _twice, np.uint8)
        return rows.groupBy("block").cogroup(first.union(second).groupBy("block")).applyInArrow(cut, _RESULT)
