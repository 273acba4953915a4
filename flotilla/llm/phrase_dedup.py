"""Substring dedup: relative Lempel-Ziv factors of word phrases.

Every block of documents is a reference. Its index holds the hashes of its phrases (``width`` words each); the
indexes of all blocks are merged by hash bucket, and each phrase is answered with whether an earlier block has
it. A document is then factored greedily, left to right: a factor starts at a word whose phrase is in the
references before it (earlier blocks, earlier documents of its block, earlier places of its own), and grows word
by word while the phrase ending at the next word is in them too. Where a factor ends, the phrases across the
boundary are looked up as well, so that a factor may start inside the one before it. A factor has at least ``width``
words by construction; its words are the duplicate span.

Which phrases go into an index at all is settled first. Each phrase names its anchor: the smallest hash of its
``ANCHOR`` consecutive words. Equal phrases have equal anchors, so a phrase whose anchor occurs once in the
corpus is unique and needs no entry. About one word in seven is an anchor.

A phrase is taken as equal if its 64-bit hash is.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks as B
from . import words as W
from .tables import release, shuffle_partitions, unwrapped, wrapped

WIDTH = 20
ANCHOR = 6
_WORD = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")
_RESULTS = "kept_text string, n_words bigint, n_removed bigint, n_factors bigint"


class _Block:
    """The phrases of one block: a range of doc_id, null first, or some rows of one doc_id (``split``)."""

    def __init__(self, group: pa.Table, width: int, anchor: int, split: bool = False):
        release()
        self.group, self.width, self.split = group, width, split
        hashes, counts = [], [np.zeros(1, np.int64)]
        for _, texts in W.chunks(group["text"]):
            words, ends = W.flat_words(texts)
            hashes.append(W.hash_words(words))
            counts.append(np.diff(ends))
        self.ends = np.cumsum(np.concatenate(counts))
        flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.n = len(flat)
        self.inside = np.flatnonzero(W.whole_windows(self.ends, width))  # starts of phrases that end in their document
        if not len(self.inside):
            self.anchors = self.phrases = np.zeros(0, np.uint64)
            self.repeated = self.keys = self.anchors
            return
        small = W.window_hashes(flat, anchor)
        least = W.sliding(small, width - anchor + 1)[:self.n - width + 1]
        self.anchors = least[self.inside]  # of each phrase
        self.phrases = W.window_hashes(flat, width)[self.inside]
        # places of anchors: a place is one if it is the least of some whole phrase around it
        known = np.zeros(len(small) + 2 * (width - anchor), np.uint64)
        known[width - anchor:][self.inside] = self.anchors
        most = W.sliding(known, width - anchor + 1, least=False)[:len(small)]
        places = np.sort(small[most == small])
        self.keys = np.unique(self.anchors)
        self.repeated = np.unique(places[1:][places[1:] == places[:-1]])

    def candidates(self, answered: pa.Table, buckets: int) -> np.ndarray:
        """Which phrases have an anchor that occurs elsewhere."""
        if not len(self.keys):
            return np.zeros(0, bool)
        elsewhere = B.read_answers(answered, self.keys, buckets, 0) | np.isin(self.keys, self.repeated)
        return elsewhere[np.searchsorted(self.keys, self.anchors)]

    def places(self, chosen: np.ndarray) -> np.ndarray:
        """(rank of doc_id, start in the document) of phrases as one ascending number. The rank holds for all blocks of a split range."""
        ids = self.group["id"].combine_chunks().fill_null(B.LEAST).to_numpy()
        # ids of such a range are one as doubles, which differ from them by a thousand or so at most
        rank = ids - ids.astype(np.float64).astype(np.int64) + 2048 if self.split else np.unique(ids, return_inverse=True)[1]
        row = np.searchsorted(self.ends, self.inside[chosen], side="right") - 1
        return (rank[row].astype(np.int64) << 32) + self.inside[chosen] - self.ends[row]

    def least(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct phrases, sorted, and the first place of each in the block."""
        phrases, places = self.phrases[chosen], self.places(chosen)
        order = np.lexsort((places, phrases))
        phrases, places = phrases[order], places[order]
        first = B.runs(phrases)[0] if len(phrases) else np.zeros(0, bool)
        return phrases[first], places[first]


def _duplicates(block: _Block, chosen: np.ndarray, answered: pa.Table, buckets: int) -> np.ndarray:
    """Starts of the phrases that the references before them hold."""
    if not len(chosen):
        return np.zeros(0, np.int64)
    phrases, least = block.least(chosen)
    earlier = B.read_answers(answered, phrases, buckets, 1)
    if block.split:
        least = B.read_answers(answered, phrases, buckets, 2, np.int64)
    at = np.searchsorted(phrases, block.phrases[chosen])
    return block.inside[chosen[earlier[at] | (block.places(chosen) > least[at])]]


def _cut(text: bytes, gone: np.ndarray) -> bytes:
    """``text`` without the words marked as gone and the white space after them."""
    found = _WORD.findall(text)
    lead = text[:len(text) - sum(map(len, found))]
    return lead + b"".join(word for word, drop in zip(found, gone, strict=True) if not drop)


def _cut_rows(docs: DataFrame, text: str, key: str, width: int, anchor: int, block_bytes: int) -> DataFrame:
    buckets = shuffle_partitions(docs.sparkSession)
    rows, pieces, split = B.with_blocks(wrapped(docs, id=F.col(key).cast("long"), text=F.col(text)), "id", "text", block_bytes)
    schema = T.StructType([rows.schema["row"], *T._parse_datatype_string(_RESULTS).fields])

    def block_of(group: pa.Table) -> _Block:
        return _Block(group, width, anchor, group["block"][0].as_py() // pieces in split)

    def ask_anchors(group: pa.Table) -> pa.Table:
        own = _Block(group, width, anchor)
        return B.questions(group["block"][0].as_py(), own.keys, buckets)

    def ask_phrases(group: pa.Table, answered: pa.Table) -> pa.Table:
        if not len(group):
            return B.ASKED_SCHEMA.empty_table()
        own, block = block_of(group), group["block"][0].as_py()
        keys, places = own.least(np.flatnonzero(own.candidates(answered, buckets)))
        asked = B.questions(block, keys, buckets, 1)
        return pa.concat_tables([asked, B.questions(block, keys, buckets, 2, places)]) if own.split else asked

    def cut(group: pa.Table, answered: pa.Table) -> pa.Table:
        own = block_of(group)
        starts = np.sort(_duplicates(own, np.flatnonzero(own.candidates(answered, buckets)), answered, buckets))
        gone = W.covered(starts, width, own.n)
        first = np.ones(len(starts), bool)  # a factor goes on while the next phrase is held too
        first[1:] = starts[1:] != starts[:-1] + 1
        per_row = lambda marks: np.diff(np.concatenate(([0], np.cumsum(marks)))[own.ends])
        factor_at = np.zeros(own.n, np.int64)
        factor_at[starts[first]] = 1
        removed, factors = per_row(gone), per_row(factor_at)
        kept: list[bytes | None] = []
        texts = group["text"]
        for at, part in W.chunks(texts):
            for i, value in enumerate(part, at):
                kept.append(_cut(value, gone[own.ends[i]:own.ends[i + 1]]) if removed[i] else value)
        nulls = texts.is_null().to_pylist()
        return pa.table({"row": group["row"], "kept_text": pa.array([None if null else x for null, x in zip(nulls, kept, strict=True)], pa.binary()).cast(pa.string()),
                         "n_words": np.diff(own.ends), "n_removed": removed, "n_factors": factors})

    asked = rows.groupBy("block").applyInArrow(ask_anchors, B.ASKED)
    elsewhere = B.answers(asked, B.in_other_block)
    asked = rows.groupBy("block").cogroup(elsewhere.groupBy("block")).applyInArrow(ask_phrases, B.ASKED)
    earlier = B.answers(asked, B.in_earlier_range(pieces), phases={2: (B.least_in_range(pieces), np.int64, np.int64)})
    return rows.groupBy("block").cogroup(elsewhere.union(earlier).groupBy("block")).applyInArrow(cut, schema)


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH,
                   anchor: int = ANCHOR, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """Remove every word in a ``width``-word phrase that also starts earlier: in a smaller ``key``, or before it in its row.

    Returns the rows of ``docs`` with ``kept_text`` (the text itself if nothing is removed), ``n_words``, ``n_removed``
    and ``n_factors``. Null texts have no words and stay null. A null key comes before all others. Rows that repeat a
    key are one place: neither makes the other a duplicate, however often a row is repeated. Texts shorter than
    ``width`` words lose nothing. An empty table gives an empty table. Input columns stay; a result replaces an
    input column of its name.
    """
    rows = _cut_rows(docs, text, key, width, anchor, block_bytes)
    return unwrapped(rows, {name: F.col(name) for name in rows.columns[1:]})


def without_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH, anchor: int = ANCHOR,
                    block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` with their own columns only, ``text`` being what is kept."""
    rows = _cut_rows(docs, text, key, width, anchor, block_bytes)
    return rows.select(*[F.col("kept_text" if name == text else f"row.`{name}`").alias(name) for name in docs.columns])
