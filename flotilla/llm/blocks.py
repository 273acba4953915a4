"""Corpus-wide questions about 64-bit keys, asked block by block.

Documents are dealt into blocks: ranges of doc_id, cut by running bytes so that each is small enough for one task. The rows of one
doc_id (or of none) that are too many for a task are dealt over several blocks by a hash of their text. A block sends every
key it holds **once**, however often it occurs in it, to the bucket of that key; the bucket merges what
the blocks sent and answers each block in the order of its keys, so the keys themselves are not sent back.
A key that occurs in a third of all documents costs a bucket one entry a block, not one a document.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import landed, shuffle_partitions

#: Bytes of text in a block. Larger blocks send fewer, longer messages and need more memory in a task.
BLOCK_BYTES = 8 << 20
#: Bytes of text whose keys a bucket has, where there are fewer shuffle partitions than that needs.
BUCKET_BYTES = 32 << 20
LEAST = -(1 << 63)
ASKED = "bucket int, block bigint, phase int, keys binary, counts binary"
ANSWERED = "block bigint, bucket int, phase int, answer binary"
ASKED_SCHEMA = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("phase", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
#: (sorted keys, block of each, how often it has it or None) -> an answer to each.
Answer = Callable[[np.ndarray, np.ndarray, np.ndarray | None], np.ndarray]


class Blocks(NamedTuple):
    """Rows with ``block``. ``block // pieces`` is the range of a block; ``split`` are the ranges of one key that lie in several blocks."""

    rows: DataFrame
    pieces: int
    split: frozenset[int]


def with_blocks(rows: DataFrame, key: str, text: str, block_bytes: int = BLOCK_BYTES) -> Blocks:
    """Add ``block``: the range of ``key`` that a row is in, ascending, null first, times ``pieces``, plus the row's piece.

    There is at least one range for each shuffle partition, and more if blocks would else have over ``block_bytes`` of text. A range has up
    to as much, and one key more. A key that alone has more is a range of its own, whose rows are dealt by a hash of ``text`` over a power of two of pieces;
    what stays together is a single row and rows alike in key and text. Keys that are one double count as one key here. The driver
    holds one number a range. Which block a row is in depends on its key, its text and the sizes by key only.
    """
    return measured_blocks(rows, key, text, block_bytes)[0]


def measured_blocks(rows: DataFrame, key: str, text: str, block_bytes: int = BLOCK_BYTES) -> tuple[Blocks, int]:
    """``with_blocks``, and the bytes of all texts."""
    spark = rows.sparkSession
    at = F.coalesce(F.col(key), F.lit(LEAST)).cast("double")
    sizes = landed(rows.select(at.alias("at"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("bytes"))
                   .groupBy("at").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")), "block-sizes")
    parts = shuffle_partitions(spark)
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    size = max(1, math.ceil(total / max(parts, math.ceil(total / block_bytes))))
    # running bytes: by coarse ranges first, whose sums the driver adds up, and inside each by a window
    bounds = sizes.stat.approxQuantile("at", [i / parts for i in range(1, parts)], 1 / (4 * parts)) if parts > 1 else []
    coarse = _ranges(sizes, "at", bounds, "coarse")
    before, base = 0, {}
    for r in coarse.groupBy("coarse").agg(F.sum("bytes").alias("bytes")).orderBy("coarse").collect():
        base[r.coarse] = before
        before += r.bytes
    running = F.sum("bytes").over(Window.partitionBy("coarse").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    start = F.element_at(F.create_map(*[F.lit(x).cast("long") for pair in base.items() for x in pair]), F.col("coarse").cast("long")) if base else F.lit(0)
    placed = coarse.withColumn("range", F.floor((start + F.coalesce(running, F.lit(0))) / size))
    large = (F.col("bytes") > block_bytes) & (F.col("n") > 1)
    firsts = placed.groupBy("range").agg(F.min("at").alias("first")).collect()
    hot = sizes.where(large).select("at", "bytes").collect()  # each has more than a block: at most as many as there are blocks
    cuts = sorted({r.first for r in firsts} | {r.at for r in hot})
    place = {at: i for i, at in enumerate(cuts)}
    by_pieces: dict[int, list[int]] = defaultdict(list)
    for r in hot:
        by_pieces[1 << (math.ceil(r.bytes / block_bytes) - 1).bit_length()].append(place[r.at])
    pieces = max(by_pieces, default=1)
    piece, spread = F.lit(0).cast("long"), F.xxhash64(F.col(text))
    for n, of in by_pieces.items():
        piece = F.when(F.col("__range").isin(of), F.pmod(spread, F.lit(n).cast("long"))).otherwise(piece)
    dealt = _ranges(rows.withColumn("__at", at), "__at", cuts[1:], "__range")
    dealt = dealt.withColumn("block", F.col("__range").cast("long") * pieces + piece).drop("__at", "__range")
    return Blocks(dealt, pieces, frozenset(x for of in by_pieces.values() for x in of)), total


def _ranges(rows: DataFrame, at: str, bounds: list[float], into: str) -> DataFrame:
    """Add the number of bounds that are not above a row's double."""
    splits = [-math.inf, *sorted({x for x in bounds if x > -math.inf}), math.inf]
    if len(splits) < 3:
        return rows.withColumn(into, F.lit(0))
    return Bucketizer(splits=splits, inputCol=at, outputCol=into).transform(rows).withColumn(into, F.col(into).cast("int"))


def buckets_for(spark: SparkSession, total: int) -> int:
    """So many buckets that what one merges does not grow with the ``total`` bytes of text, whatever the number of partitions."""
    return max(shuffle_partitions(spark), math.ceil(total / BUCKET_BYTES))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each key: equal ranges of the 64-bit values, so sorted keys are sorted by bucket too."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def packed(keys: np.ndarray) -> bytes:
    """Sorted keys as the first one and the gaps between them, in as many bytes as the largest gap needs."""
    gaps = np.diff(keys)
    width = max(1, (int(gaps.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + keys[:1].astype("<u8").tobytes() + gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    body = np.frombuffer(data, np.uint8, offset=9).reshape(-1, data[0])
    gaps = np.zeros((len(body) + 1, 8), np.uint8)
    gaps[0] = np.frombuffer(data, np.uint8, 8, 1)
    gaps[1:, :data[0]] = body
    return np.cumsum(gaps.view("<u8").ravel(), dtype=np.uint64)


def questions(block: int, keys: np.ndarray, buckets: int, phase: int = 0, counts: np.ndarray | None = None) -> pa.Table:
    """Rows of ASKED for sorted distinct ``keys``, with a number for each (how often the block has it, say) if that is asked."""
    cuts = np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1))
    full = np.flatnonzero(np.diff(cuts))
    parts = lambda values: [values[cuts[b]:cuts[b + 1]] for b in full]
    same = lambda value: pa.array(np.full(len(full), value), pa.int32())
    return pa.table([pa.array(full, pa.int32()), pa.array(np.full(len(full), block), pa.int64()), same(phase), pa.array(map(packed, parts(keys)), pa.binary()),
                     pa.array([None] * len(full) if counts is None else [x.tobytes() for x in parts(counts)], pa.binary())], schema=ASKED_SCHEMA)


def answers(asked: DataFrame, answer: Answer, width: np.dtype | None = None, sent: np.dtype = np.uint32,
            phases: dict[int, tuple[Answer, np.dtype | None, np.dtype]] | None = None) -> DataFrame:
    """Rows of ANSWERED, by what ``answer`` says of the sorted keys of a bucket, equal keys by ascending block.

    ``width`` None: answers are booleans, sent as bits. ``sent``: the type of the numbers that came with the keys. ``phases``: these
    three for phases that are answered in another way.
    """
    usual, others = (answer, width, sent), phases or {}

    def merge(group: pa.Table) -> pa.Table:
        group = group.sort_by([("phase", "ascending"), ("block", "ascending")])
        out: dict[str, list] = {"block": [], "bucket": [], "phase": [], "answer": []}
        for phase in np.unique(group["phase"].to_numpy()):
            part = group.filter(pc.equal(group["phase"], int(phase)))
            answer, width, sent = others.get(int(phase), usual)
            held = [unpacked(x) for x in part["keys"].to_pylist()]
            sizes = np.array([len(x) for x in held])
            keys, blocks = np.concatenate(held), np.repeat(part["block"].to_numpy(), sizes)
            order = np.argsort(keys, kind="stable")
            counts = None if part["counts"].null_count else np.concatenate([np.frombuffer(x, sent) for x in part["counts"].to_pylist()])[order]
            back = np.empty(len(keys), bool if width is None else width)
            back[order] = answer(keys[order], blocks[order], counts)
            ends = np.concatenate(([0], np.cumsum(sizes)))
            for i, block in enumerate(part["block"].to_pylist()):
                own = back[ends[i]:ends[i + 1]]
                out["block"].append(block)
                out["bucket"].append(part["bucket"][i].as_py())
                out["phase"].append(int(phase))
                out["answer"].append((np.packbits(own) if width is None else own).tobytes())
        return pa.table(out, pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("phase", pa.int32()), ("answer", pa.binary())]))

    return asked.groupBy("bucket").applyInArrow(merge, ANSWERED)


def read_answers(answered: pa.Table, keys: np.ndarray, buckets: int, phase: int = 0, width: np.dtype | None = None) -> np.ndarray:
    """The answers to a block's sorted distinct ``keys``, in their order."""
    out = np.zeros(len(keys), bool if width is None else width)
    cuts = np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1))
    mine = answered.filter(pc.equal(answered["phase"], phase))
    for bucket, data in zip(mine["bucket"].to_pylist(), mine["answer"].to_pylist(), strict=True):
        start, end = cuts[bucket], cuts[bucket + 1]
        if width is None:
            out[start:end] = np.unpackbits(np.frombuffer(data, np.uint8), count=end - start)
        else:
            out[start:end] = np.frombuffer(data, width)
    return out


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted keys: is each the first of its run, and the length of its run."""
    first = np.concatenate(([True], keys[1:] != keys[:-1]))
    at = np.flatnonzero(first)
    return first, np.repeat(np.diff(np.append(at, len(keys))), np.diff(np.append(at, len(keys))))


def in_other_block(keys: np.ndarray, blocks: np.ndarray, counts: np.ndarray | None) -> np.ndarray:
    return runs(keys)[1] > 1


def in_earlier_range(pieces: int) -> Answer:
    """Does a block of a range before have the key?"""

    def answer(keys: np.ndarray, blocks: np.ndarray, counts: np.ndarray | None) -> np.ndarray:
        first = np.flatnonzero(runs(keys)[0])
        ranges = blocks // pieces
        return ranges > np.repeat(ranges[first], np.diff(np.append(first, len(keys))))

    return answer


def least_in_range(pieces: int) -> Answer:
    """The least number that a block of the same range has sent with the key."""

    def answer(keys: np.ndarray, blocks: np.ndarray, counts: np.ndarray) -> np.ndarray:
        ranges = blocks // pieces
        first = np.concatenate(([True], (keys[1:] != keys[:-1]) | (ranges[1:] != ranges[:-1])))
        return np.minimum.reduceat(counts, np.flatnonzero(first))[np.cumsum(first) - 1]

    return answer


def in_all_blocks(keys: np.ndarray, blocks: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of the blocks' counts."""
    first = runs(keys)[0]
    return np.add.reduceat(counts.astype(np.int64), np.flatnonzero(first))[np.cumsum(first) - 1]
