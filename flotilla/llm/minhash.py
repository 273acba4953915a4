"""MinHash near-duplicates: universal hash minima, banding, signature check, full check, alternating stars.

Texts with equal shingle sets are one class from the start, so copies cost nothing after that, whatever ids they have. Classes meet in band
buckets. First every class of a bucket is compared with the one that meets most others; what links is joined into
components. Buckets whose classes are then in one component are done. In the others each pair from different
components is compared too, so no pair of a bucket goes unseen, and a group of n alike texts costs about n comparisons.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .stars import components
from .tables import landed, release, wrapped

SHINGLE = 5
PERCENT = 75
#: A pair at the threshold shares no band once in 2000 times.
BANDS, ROWS = 28, 5
#: Share of equal signature bytes below which a pair isn't compared in full: five standard deviations under the threshold.
SIGNATURE_SHARE = 0.56
#: Members of a bucket that are compared with as many others at once.
CHUNK = 512
SEED = 20_240_229
LEAST = -(1 << 63)
_SKETCH = "id bigint, place bigint, high bigint, low bigint, n bigint, bands array<bigint>, signature binary"


def shingle_sets(texts: list[bytes], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, flat, and where each text's begin (one more at the end).

    A-Z are lower-cased. A text of fewer than ``width`` words is one shingle, one without words none.
    """
    words, ends = W.flat_words([text.lower() for text in texts])
    hashes = W.hash_words(words)
    counts = np.diff(ends)
    inside = np.flatnonzero(W.whole_windows(ends, width))
    values = W.window_hashes(hashes, width)[inside]
    owner = np.searchsorted(ends, inside, side="right") - 1
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        values = np.concatenate((values, [W.window_hashes(hashes[ends[i]:ends[i + 1]], counts[i])[0] for i in short])).astype(np.uint64)
        owner = np.concatenate((owner, short))
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    if len(values):
        fresh = np.concatenate(([True], (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])))
        values, owner = values[fresh], owner[fresh]
    return values, np.searchsorted(owner, np.arange(len(texts) + 1))


def _minima(values: np.ndarray, starts: np.ndarray, hashes: int, seed: int) -> np.ndarray:
    """(hashes, texts): least (a x + b mod 2**64) >> 32 over each text's shingles, x of 32 bits, a and b drawn by seed."""
    drawn = np.random.default_rng(seed).integers(0, 1 << 64, (hashes, 2), dtype=np.uint64)
    x = values >> np.uint64(32)
    out = np.empty((hashes, len(starts)), np.uint32)
    for i, (a, b) in enumerate(drawn):
        out[i] = np.minimum.reduceat(x * a + b, starts) >> np.uint64(32)
    return out


def _sketcher(bands: int, rows: int, seed: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            ids, places = batch.column("id"), batch.column("place")
            for at, texts in W.chunks(batch.column("text"), 1 << 20):
                values, ends = shingle_sets(texts)
                n, full = np.diff(ends), np.flatnonzero(np.diff(ends))
                keys = np.zeros((len(texts), 2), np.int64)
                own, small = np.zeros((len(texts), bands), np.int64), [b""] * len(texts)
                if len(full):
                    least = _minima(values, ends[full], bands * rows, seed)
                    tail = (least & 0xFF).astype(np.uint8).T.copy()
                    wide = least.astype(np.uint64).reshape(bands, rows, len(full))
                    for b in range(bands):
                        own[full, b] = reduce(lambda h, x: W.mix(h ^ x), wide[b], np.full(len(full), b + 1, np.uint64) << np.uint64(40)).astype(np.int64)
                    # two sums over the set tell sets apart by 128 bits
                    keys[full, 0] = np.add.reduceat(W.mix(values ^ np.uint64(0x5BD1E995)), ends[full]).astype(np.int64)
                    keys[full, 1] = np.add.reduceat(W.mix(values + np.uint64(0x1B873593)), ends[full]).astype(np.int64)
                    for j, i in enumerate(full):
                        small[i] = tail[j].tobytes()
                yield pa.RecordBatch.from_pydict({
                    "id": ids.slice(at, len(texts)), "place": places.slice(at, len(texts)), "high": keys[:, 0], "low": keys[:, 1], "n": n.astype(np.int64),
                    "bands": pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * bands, pa.int32()), pa.array(own.ravel())),
                    "signature": pa.array(small, pa.binary())})

    return sketch


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        for at, texts in W.chunks(batch.column("text"), 1 << 20):
            values, ends = shingle_sets(texts)
            yield pa.RecordBatch.from_pydict({
                "node": batch.column("node").slice(at, len(texts)),
                "shingles": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.astype(np.int64)))})


@F.pandas_udf(T.DoubleType())
def _agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of equal bytes of two signatures."""
    if not len(a):
        return pd.Series([], dtype=float)
    width = len(a.iloc[0])
    left, right = (np.frombuffer(b"".join(x), np.uint8).reshape(len(x), width) for x in (a, b))
    return pd.Series((left == right).mean(axis=1))


def _long_enough(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _compared(percent: int):
    def compare(group: pa.Table) -> pa.Table:
        """Links between two chunks of a bucket, or within one, of pairs that no other link has joined yet."""
        one, two, bucket = group["one"][0].as_py(), group["two"][0].as_py(), group["bucket"][0].as_py()
        node, component, own = (group[name].to_numpy() for name in ("node", "component", "own"))
        bands = group["bands"].combine_chunks().flatten().to_numpy().reshape(len(group), -1)
        small = np.frombuffer(b"".join(group["signature"].to_pylist()), np.uint8).reshape(len(group), -1)
        sets = group["shingles"].combine_chunks()
        size = np.diff(sets.offsets.to_numpy())
        left, right = np.flatnonzero(own == one), np.flatnonzero(own == two)
        links = []
        for i in left:
            j = right[(right > i) if one == two else slice(None)]
            j = j[(component[j] != component[i]) & (100 * np.minimum(size[j], size[i]) >= percent * np.maximum(size[j], size[i]))]
            j = j[(small[j] == small[i]).mean(axis=1) >= SIGNATURE_SHARE]
            # a pair that meets in several buckets is compared in the first of them
            j = j[bands[i][(bands[j] == bands[i]).argmax(axis=1)] == bucket]
            if len(j):
                mine = sets[int(i)].values.to_numpy()
                for k in j:
                    both = len(np.intersect1d(mine, sets[int(k)].values.to_numpy(), assume_unique=True))
                    if 100 * both >= percent * (size[i] + size[k] - both):
                        links.append((node[i], node[k]))
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return compare


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", percent: int = PERCENT,
                    bands: int = BANDS, rows: int = ROWS, seed: int = SEED) -> DataFrame:
    """One row for each row of ``docs``: ``id``, ``n_shingles``, ``component_id`` (the least id of its component), ``kept`` (is it that id?).

    Two texts are linked if 100 * common shingles >= ``percent`` * shingles of either. Null texts and texts without words
    are linked with nothing. A null id is an id before all others. An id links nothing: rows that repeat one, or have none, are
    together only if their texts are alike. Other columns are not read. An empty table gives none.
    """
    rows = _marked(docs, text, key, percent, bands, rows, seed)
    own = lambda c: F.when(c != LEAST, c)
    return rows.select(own(F.col("id")).alias("id"), F.col("n").alias("n_shingles"), own(F.col("least")).alias("component_id"), (F.col("id") == F.col("least")).alias("kept"))


def _placed(docs: DataFrame, text: str, key: str) -> list[Column]:
    """The id of a row, least for null, and the hash of its text: rows that agree in both hold one text."""
    return [F.coalesce(docs[key].cast("long"), F.lit(LEAST)).alias("id"), F.xxhash64(docs[text]).alias("place")]


def _marked(docs: DataFrame, text: str = "text", key: str = "doc_id", percent: int = PERCENT,
            bands: int = BANDS, rows: int = ROWS, seed: int = SEED) -> DataFrame:
    """(id, place, n, least, first) of each row; ``first`` is true for one row of a component. Nodes are classes, numbered when they are written."""
    source = docs.select(*_placed(docs, text, key), docs[text].alias("text"))
    sketches = landed(source.mapInArrow(_sketcher(bands, rows, seed), _SKETCH).withColumn("row", F.monotonically_increasing_id()), "sketches")
    classes = landed(
        sketches.where("n > 0").groupBy("high", "low")
        .agg(F.min(F.struct("id", "place", "row")).alias("least"), F.first("n").alias("n"),
             F.first("bands").alias("bands"), F.first("signature").alias("signature"))
        .withColumn("node", F.monotonically_increasing_id()), "classes")
    members = classes.select("node", "n", F.explode("bands").alias("bucket"))
    # what is landed here and below can be split or broadcast by the joins that read it
    sizes = landed(members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    shared = landed(members.join(sizes, "bucket"), "shared")
    # a text that many others are variants of meets them in most bands, so the centre is whoever meets most
    weights = landed(shared.groupBy("node").agg(F.sum("size").alias("weight")), "weights")
    weighed = shared.join(weights, "node")
    centres = landed(weighed.groupBy("bucket").agg(F.max(F.struct("weight", "node")).alias("top")).select("bucket", F.col("top.node").alias("centre")), "centres")
    shared = landed(shared.join(centres, "bucket"), "centred")

    # The full set of every class that shares a bucket, once for all that follows. Of the copies under one id a single text leaves its task, so the
    # texts are shuffled once, and no id or text is hot in the join.
    wanted = landed(shared.select("node").distinct().join(classes.select("node", "least.id", "least.place"), "node"), "wanted")
    texts = source.groupBy("id", "place").agg(F.first("text").alias("text")).join(wanted, ["id", "place"]).select("node", "text")
    sets = landed(texts.mapInArrow(_sets, "node bigint, shingles array<bigint>"), "sets")
    signed = classes.select("node", "n", "signature")
    likely = landed(
        shared.where("node <> centre").select(F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b")).distinct()
        .join(signed.toDF("a", "n_a", "signature_a"), "a").join(signed.toDF("b", "n_b", "signature_b"), "b")
        .where(_long_enough(F.col("n_a"), F.col("n_b"), percent))
        .where(_agreement("signature_a", "signature_b") >= SIGNATURE_SHARE).select("a", "b"), "likely")
    common = F.size(F.array_intersect("left", "right"))
    found = landed(
        likely.join(sets.toDF("b", "right"), "b").join(sets.toDF("a", "left"), "a")
        .where(common * 100 >= (F.size("left") + F.size("right") - common) * percent).select("a", "b").distinct(), "links")
    labels = components(found)

    placed = shared.join(labels, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    open_buckets = landed(
        placed.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("size"))
        .where("least <> most").select("bucket", F.ceil(F.col("size") / CHUNK).cast("int").alias("chunks")), "open")
    if not open_buckets.isEmpty():
        labels = components(labels.toDF("b", "a").select("a", "b").union(_links_in(placed, open_buckets, classes, sets, percent)))
    named = landed(classes.select("high", "low", "node", "least").join(labels, "node", "left")
                   .select("high", "low", "least", F.coalesce("component", "node").alias("component")), "named")
    firsts = landed(named.groupBy("component").agg(F.min("least").alias("first")), "firsts")
    named = landed(named.join(firsts, "component").select("high", "low", F.col("first.id").alias("least"), F.col("first.row").alias("first_row")), "named")
    return (
        sketches.select("id", "place", "row", "n", "high", "low").join(named, ["high", "low"], "left")
        .select("id", "place", "n", F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("least"),
                F.when(F.col("n") > 0, F.col("row") == F.col("first_row")).otherwise(F.lit(True)).alias("first")))


def _links_in(placed: DataFrame, open_buckets: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All links between classes of different components that share a bucket."""
    rest = landed(placed.join(open_buckets, "bucket"), "rest")
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    rest = (
        rest.join(classes.select("node", "bands", "signature"), "node").join(sets, "node")
        .withColumn("own", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("bucket", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "own", "node", "component", "bands", "signature", "shingles"))
    return rest.groupBy("bucket", "one", "two").applyInArrow(_compared(percent), "a bigint, b bigint")


def _held(docs: DataFrame, text: str, key: str) -> DataFrame:
    return wrapped(docs, **dict(zip(("id", "place"), _placed(docs, text, key), strict=True)))


def drop_near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` whose id is the least of its component, with all their columns."""
    gone = _marked(docs, text, key, **options).where("id <> least").select("id", "place").distinct()
    return _held(docs, text, key).join(gone, ["id", "place"], "left_anti").select("row.*")


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """One row of each component, of its least id, with all its columns; every row without words stays."""
    marked = landed(_marked(docs, text, key, **options), "marked")
    ids = marked.groupBy("id").agg(F.count("*").alias("times"), F.max("first").alias("first"))
    gone = ids.where("times > 1 or not first").select("id")
    held = _held(docs, text, key)
    alone = held.join(gone, "id", "left_anti").select("row")
    # ids that come again: their rows are told apart by their texts, and of copies of one text one stays
    shared = landed(marked.where("first").join(ids.where("times > 1").select("id"), "id").select("id", "place", "n").distinct(), "shared")
    blank = held.join(shared.where("n = 0").select("id", "place"), ["id", "place"], "left_semi").select("row")
    number = landed(shared.where("n > 0").select("id", "place").withColumn("number", F.monotonically_increasing_id()), "numbers")
    again = (
        held.join(number, ["id", "place"]).groupBy("number")
        .agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row")).select("row"))
    return alone.union(blank).union(again).select("row.*")
