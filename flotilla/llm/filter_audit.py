"""How filters of a corpus interact: what each removes in every order of application, and its Shapley share of the removals.

A document is a mask of the filters it fails. From the masks come, for each part of the corpus, the removals of all coalitions: how many
documents fail at least one filter of a set. With five filters these 32 numbers (and 32 each of good and toxic documents) are all
that is needed. A step of an order removes the difference of two coalitions, and the Shapley values are the solution of the
kernel-weighted least squares problem whose values add up to the removals of all filters together: its normal equations are
solved once, in rationals, with the 32 removals as unknown right-hand sides.
"""

from __future__ import annotations

import json
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import landed

#: The filters that look at one text, by letter; each is true for a text that fails. The filter of copies is the letter after.
SPACE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SYMBOLS = 50, 65, 5, r"[#$%&*|]"
FILTERS = "ABCDE"


def text_mask(docs: DataFrame, text: str, into: str = "mask") -> DataFrame:
    """Add the mask of filters A to D that a text fails: bit 0 for A and so on. Null is the empty text."""
    whole = docs.withColumn("__text", F.coalesce(F.col(text), F.lit("")))
    words = whole.withColumn("__words", F.split("__text", SPACE, -1))
    # what splitting leaves at the ends of a text that begins or ends with space
    words = words.withColumn("__words", F.array_remove("__words", ""))
    n = F.size("__words")
    fails = [
        n < LEAST_WORDS,
        100 * F.size(F.array_distinct("__words")) < DISTINCT_PERCENT * n,
        100 * (F.length("__text") - F.length(F.translate("__text", UPPER, ""))) > CAPITAL_PERCENT * F.length("__text"),
        F.col("__text").rlike(SYMBOLS),
    ]
    mask = sum((F.when(failed, 1 << i).otherwise(0) for i, failed in enumerate(fails)), F.lit(0))
    return words.withColumn(into, mask.cast("int")).drop("__text", "__words")


def masked(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """``key, part, mask, n``: how many rows of a key and part fail which of the five filters.

    A text is a copy (filter E) if a smaller key has an equal one, by SHA-256; rows of a null key are no copies, and no row is one
    of its own key. Rows alike in text, key and part are counted before anything is joined, so that a hot text or key is spread.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).alias("text"))
    rows = text_mask(rows, "text").select(
        "key", "part", "mask", F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("content"))
    counted = landed(rows.groupBy("content", "key", "part", "mask").agg(F.count("*").alias("n")), "masks")
    first = counted.where("key is not null").groupBy("content").agg(F.min("key").alias("key")).withColumn("first", F.lit(True))
    copy = 1 << FILTERS.index("E")
    whole = counted.join(first, ["content", "key"], "left").withColumn(
        "mask", F.col("mask") + F.when(F.col("key").isNull() | F.col("first"), 0).otherwise(copy))
    return whole.groupBy("key", "part", "mask").agg(F.sum("n").alias("n"))


def coalition_removals(masks: DataFrame, labels: DataFrame, key: str = "doc_id", quality: str = "quality", toxic: str = "toxic") -> DataFrame:
    """For each part the removals of every coalition, as arrays by the coalition's mask: ``removed, good, toxic``, and all rows, ``n``.

    A key is good, or toxic, if any of its labels says so; without label it is neither.
    """
    known = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(
        F.max(F.col(quality) == 1).alias("is_good"), F.max(F.col(toxic) == 1).alias("is_toxic"))
    parted = masks.join(known, "key", "left").groupBy("part", "mask").agg(
        F.sum("n").alias("n"), *[F.sum(F.when(F.col(flag), F.col("n")).otherwise(0)).alias(flag) for flag in ("is_good", "is_toxic")])

    # at most one row for each mask
    row = F.struct("mask", F.col("n").alias("removed"), F.col("is_good").alias("good"), F.col("is_toxic").alias("toxic"))
    tab = parted.groupBy("part").agg(F.sum("n").alias("n"), F.collect_list(row).alias("tab"))

    def removals(count: str) -> Column:
        failing = lambda s: lambda total, row: total + F.when(row["mask"].bitwiseAND(s) != 0, row[count]).otherwise(0)
        return F.transform(F.sequence(F.lit(0), F.lit((1 << len(FILTERS)) - 1)), lambda s: F.aggregate("tab", F.lit(0).cast("bigint"), failing(s))).alias(count)

    return tab.select("part", "n", *map(removals, ("removed", "good", "toxic")))


def solved(matrix: list[list[Fraction]], right: list[list[Fraction]]) -> list[list[Fraction]]:
    """The solutions of ``matrix x = right`` for every column of ``right``, by exact elimination."""
    n = len(matrix)
    rows = [[Fraction(x) for x in [*a, *b]] for a, b in zip(matrix, right, strict=True)]
    for i in range(n):
        pivot = next(k for k in range(i, n) if rows[k][i])
        rows[i], rows[pivot] = rows[pivot], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for k in range(n):
            if k != i and rows[k][i]:
                rows[k] = [x - rows[k][i] * y for x, y in zip(rows[k], rows[i], strict=True)]
    return [row[n:] for row in rows]


def shapley_weights(players: int) -> list[list[Fraction]]:
    """What each coalition's value counts for in each player's Shapley value, by the coalition's mask.

    Minimise the sum over proper coalitions S of k(S) (v(S) - sum of x_i in S)^2 with k(S) = (m - 1) / (C(m, s) s (m - s)), where all x_i
    add up to the value of the whole. The normal equations with the multiplier of that constraint are linear in v, so they are solved
    with one right-hand side for each coalition.
    """
    m, every = players, range(1 << players)
    held = [[i for i in range(m) if s >> i & 1] for s in every]
    kernel = [Fraction(m - 1, comb(m, len(h)) * len(h) * (m - len(h))) if 0 < len(h) < m else Fraction(0) for h in held]
    matrix = [[sum((kernel[s] for s in every if i in held[s] and j in held[s]), Fraction(0)) for j in range(m)] + [Fraction(1)] for i in range(m)]
    right = [[kernel[s] if i in held[s] else Fraction(0) for s in every] for i in range(m)]
    matrix.append([Fraction(1)] * m + [Fraction(0)])
    right.append([Fraction(int(len(held[s]) == m)) for s in every])
    return solved(matrix, right)[:m]


def steps(filters: str = FILTERS) -> list[tuple]:
    """For every order and step: the order, the step from 1, the filter's number, and the coalitions it is judged by.

    Those are places (from 1) in an array by mask: before the step, after it, the filter alone, all the others.
    """
    m, number = len(filters), {letter: i for i, letter in enumerate(filters)}
    found = []
    for order in permutations(filters):
        before = 0
        for step, letter in enumerate(order, 1):
            own = 1 << number[letter]
            found.append(("".join(order), step, number[letter] + 1, before + 1, (before | own) + 1, own + 1, (1 << m) - own))
            before |= own
    return found


_STEPS = "array<struct<filter_order: string, step: int, filter: int, before: int, after: int, own: int, rest: int>>"


def step_counts(removals: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row for each part, order and step, by differences of the part's coalitions; see ``audit``."""
    m = len(filters)
    weights = [[w * factorial(m) for w in row] for row in shapley_weights(m)]
    if any(w.denominator != 1 for row in weights for w in row):
        raise ArithmeticError("a sum over all orders is a whole number")
    shares = [sum((F.col("removed")[s] * int(w) for s, w in enumerate(row) if w), F.lit(0).cast("bigint")) for row in weights]
    names = ("filter_order", "step", "filter", "before", "after", "own", "rest")
    # one literal; as an expression for each cell this table takes Spark a minute to plan
    table = F.from_json(F.lit(json.dumps([dict(zip(names, row, strict=True)) for row in steps(filters)])), _STEPS)
    rows = removals.withColumn("shares", F.array(*shares)).select("*", F.inline(table))
    at = lambda array, place: F.element_at(array, F.col(place))
    more = lambda array: at(array, "after") - at(array, "before")
    return rows.select(
        "part", "filter_order", "step", (F.col("n") - at("removed", "after")).alias("kept"), more("removed").alias("removed"),
        (at("removed", "own") - more("removed")).alias("redundant"), (F.element_at("removed", 1 << m) - at("removed", "rest")).alias("unique_fails"),
        more("good").alias("good_lost"), more("toxic").alias("toxic_lost"), at("shares", "filter").alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """Document counts within each part, for every order of the five filters and every step of it.

    ``kept`` after the step, ``removed`` by it, ``redundant``: failing its filter but removed before, ``unique_fails``: failing no other,
    ``good_lost`` and ``toxic_lost`` of the removed by label, ``shapley``: the filter's removals summed over all orders. Every row counts,
    repeated ones too; a null part is the empty string; a null text is empty. A part without removals has zeros. An empty table gives
    an empty table. Other columns are ignored. What leaves the tasks before the parts are summed is a hash, a key and a part for each row.
    """
    return step_counts(coalition_removals(masked(docs, key, text, part), labels, key))
