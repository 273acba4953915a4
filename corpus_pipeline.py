"""From raw documents to token ids: quality rules, near-duplicates, repeated passages, source mix, SentencePiece.

Every stage takes all rows its predecessor kept. Between stages rows are written to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flotilla.llm import fertility, minhash, mixing, phrase_dedup, pieces
from flotilla.llm.tables import importable, landed, table


def _recounted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the text as it is now, if there is such a column."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule, leave a band of tokeniser fertility or have more symbols than words go."""
    return fertility.kept(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: one of least id."""
    return minhash.one_of_each(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that an earlier document or place holds go; every document stays, if with less text."""
    return _recounted(phrase_dedup.without_repeats(docs))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row, whole, as often as the mix takes it; rows without words go."""
    return _recounted(mixing.repeated(docs))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every row, checked by decoding them again."""
    back = pieces.encoded(docs.select("doc_id", "lang", "source", "text"), decode=True)
    return back.select("doc_id", "lang", "source", "ids", "n_tokens", "n_byte_tokens", "parity",
                       F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


def _ready(stage):
    return lambda spark, docs, sf_dir: stage(importable(spark), docs, sf_dir)


STAGES = [
    ("quality rules", _ready(quality)),
    ("near-duplicates", _ready(near_dedup)),
    ("substring dedup", _ready(passage_dedup)),
    ("source mix", _ready(source_mix)),
    ("token ids", _ready(token_ids)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if not i else landed(docs, "stage"), sf_dir)
    return docs


#: Tokenisers and 64-bit hashes of passages are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None
