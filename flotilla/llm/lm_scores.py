"""Language-model scores: stupid backoff over n-gram counts of the whole corpus.

Each block of documents counts its own n-grams and sends each distinct one, with its count, to the n-gram's hash bucket.
The buckets are the count tables: they add up what the blocks sent and answer each block with the totals, which it joins
to the n-grams of its documents and sums by document. A word that a third of all documents hold is one entry a block.

A word scores count(n-gram) / count(its first n - 1 words) if the corpus has the n-gram ``min_count`` times or more, else
``backoff`` times the score by the last n - 1 words; a single word scores count / all words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import words as W
from .tables import shuffle_partitions

ORDER = 2
BACKOFF = 0.4
#: An n-gram of two or more words that occurs less often isn't in the tables: its only place would vouch for itself.
MIN_COUNT = 2
BLOCK_BYTES = 16 << 20
_RESULT = "id bigint, n_words bigint, n_backed_off bigint, log_score double"
_ALL = np.zeros(1, np.uint64)  # the n-gram of no words


class _Block:
    def __init__(self, group: pa.Table, order: int):
        hashes, counts = [], [np.zeros(1, np.int64)]
        for _, texts in W.chunks(group["text"]):
            words, ends = W.flat_words(texts)
            hashes.append(W.hash_words(words))
            counts.append(np.diff(ends))
        self.ends = np.cumsum(np.concatenate(counts))
        self.words = W.mix(np.concatenate(hashes)) if hashes else _ALL[:0]
        self.order = order

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-grams that lie in one document, and the places of their last words."""
        inside = np.flatnonzero(W.whole_windows(self.ends, n))
        return (self.words if n == 1 else W.window_hashes(self.words, n))[inside], inside + n - 1


def _counted(block: int, grams: np.ndarray, buckets: int, phase: int) -> pa.Table:
    keys, counts = np.unique(grams, return_counts=True)
    return B.questions(block, keys, buckets, phase, counts.astype(np.uint32))


def _ask(group: pa.Table, order: int, buckets: int) -> pa.Table:
    own, block = _Block(group, order), group["block"][0].as_py()
    asked = [B.questions(block, _ALL, buckets, 0, np.array([len(own.words)], np.uint32))]
    for n in range(1, order + 1):
        asked.append(_counted(block, own.grams(n)[0], buckets, n))
    return pa.concat_tables(asked)


def _score(group: pa.Table, answered: pa.Table, order: int, buckets: int, backoff: float, min_count: int) -> pa.Table:
    own = _Block(group, order)
    total = B.read_answers(answered, _ALL, buckets, 0, np.int64)[0]
    score, backed_off = np.zeros(len(own.words)), np.zeros(len(own.words), bool)
    shorter = np.zeros(0, np.int64)
    for n in range(1, order + 1):
        keys, at = own.grams(n)
        named, place = np.unique(keys, return_inverse=True)
        counts = B.read_answers(answered, named, buckets, n, np.int64)[place]
        by_end = np.zeros(len(own.words), np.int64)
        by_end[at] = counts
        if n == 1:
            score = counts / max(total, 1)
        else:
            known = counts >= min_count
            score[at] = np.where(known, counts / np.maximum(shorter[at - 1], 1), backoff * score[at])
            backed_off[at] = ~known
        shorter = by_end
    per_row = lambda values: np.diff(np.concatenate(([0], np.cumsum(values)))[own.ends])
    row = np.repeat(np.arange(len(group)), np.diff(own.ends))
    return pa.table({"id": group["id"], "n_words": np.diff(own.ends), "n_backed_off": per_row(backed_off),
                     "log_score": np.bincount(row, np.log(score), len(group))})


def scores(docs: DataFrame, text: str = "text", key: str = "doc_id", order: int = ORDER, backoff: float = BACKOFF,
           min_count: int = MIN_COUNT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, n_words, n_backed_off, log_score) of each row of ``docs``, under the counts of all of them.

    ``log_score`` is the sum of the natural logs of the words' scores, 0 for null texts and texts without words; ``n_backed_off`` counts the
    words scored without their longest n-gram though there was room for one. Rows that repeat a key, or have none, are rows
    of their own and count as often as they come. Other columns are not read. Empty in, empty out.
    """
    spark = docs.sparkSession
    buckets = shuffle_partitions(spark)
    rows = B.with_blocks(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")), "id", "text", block_bytes).rows

    def ask(group: pa.Table) -> pa.Table:
        return _ask(group, order, buckets)

    def score(group: pa.Table, answered: pa.Table) -> pa.Table:
        return _score(group, answered, order, buckets, backoff, min_count)

    totals = B.answers(rows.groupBy("block").applyInArrow(ask, B.ASKED), B.in_all_blocks, np.int64)
    return rows.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(score, _RESULT)
