"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is good or bad. Its evidence is a weighted sum of its own features and its neighbours'; two lines in a row
add a weight for their pair of labels. Forward and backward sums give each line's chance of being good, and a
document's score is their mean, weighted by the length of the lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .tables import unwrapped, wrapped

#: Labelled documents that a fit takes at most, the ones of least hash; a fit's size doesn't grow with the table.
SAMPLE_DOCS = 3000
STEPS, RATE, RIDGE = 80, 0.2, 1e-3
THRESHOLD = 0.3
SYMBOLS, CAPITALS, DIGITS, MARKS = b"#*$%&|<>", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!?"
OWN = ("symbols", "capitals", "digits", "marks", "repeated words", "word length", "words", "ends a sentence", "earlier line", "single characters")
#: Of these a line also takes the values of the line before and the line after it.
SHARED = 5
WIDTH = len(OWN) + 2 * SHARED + 2


def _own(line: bytes, seen: set[bytes]) -> tuple:
    words, n = line.split(), len(line)
    share = lambda drop: (n - len(line.translate(None, drop))) / n
    earlier = line in seen
    seen.add(line)
    return (share(SYMBOLS), share(CAPITALS), share(DIGITS), share(MARKS), 1 - len(set(words)) / len(words), min(n / len(words), 20) / 10,
            min(len(words), 200) / 100, line.rstrip()[-1:] in b".!?", earlier, sum(len(w) == 1 for w in words) / len(words))


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines, WIDTH) features, length of each line, and where each text's lines begin. Lines without a word don't count."""
    rows, lengths, ends = [], [], [0]
    for text in texts:
        seen: set[bytes] = set()
        for line in text.split(b"\n"):
            if line.strip():
                rows.append(_own(line, seen))
                lengths.append(len(line))
        ends.append(len(rows))
    out, bounds = np.zeros((len(rows), WIDTH)), np.array(ends)
    if rows:
        own = np.array(rows, float)
        first, last = np.zeros(len(rows) + 1, bool), np.zeros(len(rows) + 1, bool)
        first[bounds[:-1]] = last[bounds[1:] - 1] = True
        first, last = first[:-1], last[:-1]
        before, after = np.roll(own[:, :SHARED], 1, axis=0), np.roll(own[:, :SHARED], -1, axis=0)
        before[first], after[last] = 0, 0
        out[:] = np.hstack((own, before, after, first[:, None], np.ones((len(rows), 1))))
    return out, np.array(lengths, float), bounds


@dataclass
class Model:
    weights: np.ndarray  # of the features, for good against bad
    pairs: np.ndarray  # (2, 2): of a label and the next line's
    prior: float  # share of good documents, for texts without lines
    centre: np.ndarray
    scale: np.ndarray

    def evidence(self, lines: np.ndarray) -> np.ndarray:
        return (lines - self.centre) / self.scale @ self.weights


def chain(evidence: np.ndarray, ends: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chance of good for each line, log of the sum over all labellings for each text, expected label pairs of all.

    All texts go one line further at a time, the ones with most lines first.
    """
    count = np.diff(ends)
    order = np.argsort(-count, kind="stable")
    begin, count = ends[:-1][order], count[order]
    n, longest = int((count > 0).sum()), int(count.max(initial=0))
    alive = np.searchsorted(-count, -np.arange(longest), side="left")  # texts with a line t
    score = np.stack((np.zeros(len(evidence)), evidence), axis=1)
    forward, backward = np.zeros_like(score), np.zeros_like(score)
    step = lambda x, m: np.logaddexp(x[:, :1] + m[0], x[:, 1:] + m[1])
    for t in range(longest):
        at = begin[:alive[t]] + t
        forward[at] = score[at] + (step(forward[at - 1], pairs) if t else 0)
    for t in range(longest - 2, -1, -1):
        at = begin[:alive[t + 1]] + t
        backward[at] = step(backward[at + 1] + score[at + 1], pairs.T)
    total = np.zeros(len(count))
    total[order[:n]] = np.logaddexp(*forward[begin[:n] + count[:n] - 1].T)
    line_total = np.repeat(total, np.diff(ends))
    good = np.exp(forward[:, 1] + backward[:, 1] - line_total)
    expected = np.zeros((2, 2))
    inner = np.ones(len(evidence), bool)
    inner[ends[1:][np.diff(ends) > 0] - 1] = False
    at = np.flatnonzero(inner)
    if len(at):
        joint = np.exp(forward[at][:, :, None] + pairs + (score[at + 1] + backward[at + 1])[:, None, :] - line_total[at][:, None, None])
        expected = joint.sum(axis=0)
    return good, total, expected


def fit(lines: np.ndarray, ends: np.ndarray, labels: np.ndarray, steps: int = STEPS, rate: float = RATE, ridge: float = RIDGE) -> Model:
    """Most likely weights if all lines of a document have its label; Adam over the whole sample."""
    centre, scale = lines.mean(axis=0), lines.std(axis=0) + 1e-6
    centre[-1], scale[-1] = 0, 1
    x, count = (lines - centre) / scale, np.diff(ends)
    truth, docs = np.repeat(labels, count), max(1, len(labels))
    seen = np.zeros((2, 2))
    for label in (0, 1):
        seen[label, label] = (count[labels == label] - 1).clip(0).sum()
    theta, m, v = np.zeros(WIDTH + 4), np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)
    for t in range(1, steps + 1):
        good, _, expected = chain(x @ theta[:WIDTH], ends, theta[WIDTH:].reshape(2, 2))
        gradient = np.concatenate((x.T @ (good - truth), (expected - seen).ravel())) / docs + ridge * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient ** 2
        theta -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return Model(theta[:WIDTH], theta[WIDTH:].reshape(2, 2), float(labels.mean()) if len(labels) else 0.5, centre, scale)


def score(texts: list[bytes], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score of each text, its number of lines, and how many of them are more likely good."""
    lines, lengths, ends = features(texts)
    good, _, _ = chain(model.evidence(lines), ends, model.pairs)
    row = np.repeat(np.arange(len(texts)), np.diff(ends))
    weight = np.bincount(row, lengths, len(texts))
    with np.errstate(all="ignore"):
        mean = np.where(weight > 0, np.bincount(row, lengths * good, len(texts)) / weight, model.prior)
    return mean.clip(0, 1), np.diff(ends), np.bincount(row, good >= 0.5, len(texts)).astype(np.int64)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fit on at most ``sample_docs`` labelled rows, those whose key has the least hash.

    Rows without key or label, and documents without a text, are left out; of a key that is labelled or stored twice,
    each pair counts. Without labelled rows every score is about 0.5.
    """
    chosen = (
        labels.select(F.col(key).cast("long").alias("id"), F.col(label).cast("int").alias("label")).where("id is not null and label in (0, 1)")
        .orderBy(F.xxhash64("id"), "id", "label").limit(sample_docs))
    sample = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where("text is not null").join(F.broadcast(chosen), "id")

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in W.chunks(batch.column("text")):
                lines, _, ends = features(texts)
                yield pa.RecordBatch.from_pydict({
                    "id": batch.column("id").slice(at, len(texts)), "label": batch.column("label").slice(at, len(texts)),
                    "lines": pa.array([lines[a:b].astype(np.float32).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())})

    rows = sorted(tuple(r) for r in sample.mapInArrow(described, "id bigint, label int, lines binary").collect())
    lines = [np.frombuffer(r[2], np.float32).reshape(-1, WIDTH) for r in rows]
    ends = np.concatenate(([0], np.cumsum([len(x) for x in lines]))).astype(np.int64)
    flat = np.concatenate(lines).astype(float) if len(lines) and ends[-1] else np.zeros((1, WIDTH))
    if not ends[-1]:
        return Model(np.zeros(WIDTH), np.zeros((2, 2)), float(np.mean([r[1] for r in rows])) if rows else 0.5, np.zeros(WIDTH), np.ones(WIDTH))
    return fit(flat, ends, np.array([r[1] for r in rows], float))


def scored(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` with ``score`` (0 to 1), ``predicted`` (1 from ``threshold`` on), ``n_lines`` and ``n_good_lines``.

    Only the text counts. Null texts and texts without a word get the share of good documents of the fit. Input columns stay; a
    result replaces one of its name. Nothing is shuffled; equal texts get equal scores. Empty in, empty out.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers
    rows = wrapped(docs, text=F.col(text))
    schema = T.StructType([rows.schema["row"], *T._parse_datatype_string("score double, n_lines bigint, n_good_lines bigint").fields])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in W.chunks(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(at, len(texts)), *map(pa.array, score(texts, held.value))], ["row", "score", "n_lines", "n_good_lines"])

    out = rows.mapInArrow(judge, schema)
    return unwrapped(out, {"score": F.col("score"), "predicted": (F.col("score") >= threshold).cast("int"), "n_lines": F.col("n_lines"), "n_good_lines": F.col("n_good_lines")})


def held_out(key: Column) -> Column:
    """One row in five, by the CRC of its key, is kept out of fits."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))
