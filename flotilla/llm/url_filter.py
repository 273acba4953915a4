"""URL filters: host and path rules, then a list of canonical URLs behind a blocked Bloom filter.

The filter is a table: one row a block of eight 32-bit words, made by one aggregate of the listed URLs and joined to the
pages by block. Rows that it lets through go to an exact join with the list, which removes false positives.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import landed, unwrapped, wrapped

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
WORDS, WORD_BITS = 8, 32
BITS_A_KEY = 16
#: A filter up to this size is broadcast; a larger one is joined by shuffle.
BROADCAST_BYTES = 8 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without ``www.`` and path without closing slashes; scheme, query and fragment don't count."""
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, "/+$", ""))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; null if none does."""
    name = verdict = F.lit(None).cast("string")
    for says, at, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(start)
        name, verdict = F.when(fits, at + start).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def _bits(url: Column) -> list[Column]:
    """The bit that a URL has in each word of its block."""
    spread = F.xxhash64(url, F.lit(1))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(spread, 5 * i).bitwiseAND(WORD_BITS - 1).cast("int")) for i in range(WORDS)]


def bloom_filter(listed: DataFrame, url: str = "url", bits: int = BITS_A_KEY) -> tuple[DataFrame, int]:
    """(block, w0..w7) of a table of distinct URLs, and the number of blocks."""
    blocks = max(1, math.ceil(listed.count() * bits / (WORDS * WORD_BITS)))
    made = listed.groupBy(F.pmod(F.xxhash64(url), F.lit(blocks)).alias("block")).agg(
        *[F.bit_or(bit).alias(f"w{i}") for i, bit in enumerate(_bits(F.col(url)))])
    return made, blocks


def judged(pages: DataFrame, listed: DataFrame, url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES,
           bits: int = BITS_A_KEY) -> DataFrame:
    """Rows of ``pages`` with ``host``, ``path``, ``rule``, ``listed`` and ``verdict``.

    ``listed`` has canonical URLs in its column ``url``; repeats, nulls and the empty URL in it mean nothing. A rule decides if one
    fits, else listed URLs are blocked and all others allowed. Null urls and urls without ``://`` have an empty host and path
    and are allowed. Input columns stay; a result replaces one of its name. Empty in, empty out.
    """
    known = landed(listed.where("url <> ''").select("url").distinct(), "listed")
    made, blocks = bloom_filter(known, "url", bits)
    if blocks * (WORDS + 1) * 8 <= BROADCAST_BYTES:
        made = F.broadcast(made)
    rows = wrapped(pages, host=host(F.col(url)), path=path(F.col(url)))
    rows = rows.withColumn("canonical", canonical(F.col("host"), F.col("path")))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("canonical"), F.lit(blocks))).join(made, "block", "left")
    possible = F.col("w0").isNotNull()
    for i, bit in enumerate(_bits(F.col("canonical"))):
        possible = possible & (F.col(f"w{i}").bitwiseAND(bit) != 0)
    tested = rows.select("row", "host", "path", "canonical", possible.alias("possible"))
    sure = tested.where("not possible").withColumn("listed", F.lit(False))
    hits = tested.where("possible").join(known.select(F.col("url").alias("canonical"), F.lit(True).alias("hit")), "canonical", "left")
    both = sure.select("row", "host", "path", "listed").union(hits.select("row", "host", "path", F.coalesce("hit", F.lit(False))))
    name, says = longest_rule(F.col("host"), F.col("path"), rules)
    return unwrapped(both, {
        "host": F.col("host"), "path": F.col("path"), "rule": name, "listed": F.col("listed"),
        "verdict": F.coalesce(says, F.when(F.col("listed"), "block").otherwise("allow"))})
