"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import landed, unwrapped, wrapped

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SEED = 17
#: Sources up to which their table is broadcast: one short row a source.
BROADCAST_SOURCES = 50_000
WORD = r"[^\x20\x09-\x0D]+"
RESULTS = ("size", "source_size", "target", "taken", "copies", "part_words")
_LEAST = -(1 << 63)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sizes: Sequence[int], weights: Sequence[int], epochs: int) -> list[Fraction]:
    """Share the sum of ``sizes`` by weight; clamp shares above ``epochs`` times their size and reshare, until none is."""
    targets = [Fraction(0)] * len(sizes)
    open_, left = list(range(len(sizes))), Fraction(sum(sizes))
    while open_:
        whole = sum(weights[i] for i in open_)
        above = [i for i in open_ if left * weights[i] > epochs * sizes[i] * whole]
        if not above:
            for i in open_:
                targets[i] = left * weights[i] / whole
            break
        for i in above:
            targets[i] = Fraction(epochs * sizes[i])
        left -= sum(targets[i] for i in above)
        open_ = [i for i in open_ if i not in set(above)]
    return targets


def _cut(rows: DataFrame, wanted: DataFrame, place: list[str]) -> DataFrame:
    """By source, the first place at which the running sum of sizes passes ``want``, and what is wanted from there."""
    sums = rows.groupBy("sid", *place).agg(F.sum("size").alias("words")).where("words > 0")
    running = F.sum("words").over(Window.partitionBy("sid").orderBy(*place).rowsBetween(Window.unboundedPreceding, 0))
    return (
        sums.withColumn("running", running).join(wanted, "sid").where("running - words <= want and want < running")
        .select("sid", *place, "words", (F.col("want") - F.col("running") + F.col("words")).alias("want")))


def mix(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", weights: Sequence[int] = WEIGHTS,
        epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """Say of each row how many of its words a mix of the size of ``docs`` takes.

    Sources in order of code points, null last, get ``weights`` in turn. A source's ``target`` is its share of all words,
    at most ``epochs`` times its own. It is taken in whole repetitions of every row; the rest in rows ordered by
    a seeded hash of key and text, the last of them in part. Adds ``size``, ``source_size``, ``target``, ``taken``, ``copies`` (whole
    repetitions) and ``part_words`` (words of a partial one). What a source takes is within a word of its target (more
    only if rows alike in key and text are at the cut, which share what is left). Null and empty texts have size 0 and take nothing. Reruns
    agree, whatever the partitioning. Input columns stay; a result replaces one of its name. Empty in, empty out.

    The cut is found by radix: the hash's first ten bits, the next ten, then single rows, so no source is sorted whole.
    """
    spark = docs.sparkSession
    size = word_count(F.col(text))
    own = F.coalesce(F.col(key).cast("long"), F.lit(_LEAST))
    order = F.shiftrightunsigned(F.xxhash64(F.lit(seed), own, F.col(text)), 1)
    narrow = landed(docs.select(F.col(source).cast("string").alias("source"), size.alias("size"), own.alias("id"), order.alias("place")), "sizes")
    # one row a source; sources are the named parts of a mix
    totals = sorted(((r.source, r.size) for r in narrow.groupBy("source").agg(F.sum("size").alias("size")).collect()),
                    key=lambda r: (r[0] is None, r[0] or ""))
    targets = water_fill([n for _, n in totals], [weights[i % len(weights)] for i in range(len(totals))], epochs)
    plan = []
    for sid, ((name, n), target) in enumerate(zip(totals, targets, strict=True)):
        whole, rest = divmod(target, n) if n else (0, 0)
        plan.append((sid, name, n, float(target), int(whole), int(rest)))
    few = (lambda df: F.broadcast(df)) if len(plan) <= BROADCAST_SOURCES else (lambda df: df)
    sources = spark.createDataFrame(plan, "sid int, name string, source_size long, target double, copies int, want long")
    ids = few(sources.select("sid", "name"))
    rows = narrow.join(ids, narrow["source"].eqNullSafe(ids["name"])).select(
        "sid", "size", "id", "place", F.shiftright("place", 53).alias("first"), F.shiftright("place", 43).alias("second"))
    # each step keeps one bucket a source, so the next one groups a thousandth of the rows
    cut = landed(_cut(rows, few(sources.select("sid", "want")), ["first"]), "cut")
    rows = rows.join(few(cut.select("sid", "first")), ["sid", "first"], "left_semi")
    cut = landed(_cut(rows, few(cut.select("sid", "want")), ["second"]), "cut")
    rows = rows.join(few(cut.select("sid", "second")), ["sid", "second"], "left_semi")
    cut = _cut(rows, few(cut.select("sid", "want")), ["place", "id"]).toDF("sid", "cut_place", "cut_id", "cut_words", "cut_want")
    sources = few(landed(sources.join(cut, "sid", "left"), "sources"))

    out = wrapped(docs, source=F.col(source).cast("string"), size=size, id=own, place=order)
    out = out.join(sources, out["source"].eqNullSafe(sources["name"]))
    at = F.struct("place", "id")
    border = F.struct(F.col("cut_place").alias("place"), F.col("cut_id").alias("id"))
    part = F.when(at < border, F.col("size")).when(at == border, F.expr("size * cut_want div cut_words")).otherwise(0)
    # a whole row more is one more copy
    copies = F.col("copies") + F.when((part == F.col("size")) & (part > 0), 1).otherwise(0)
    part_words = F.when(part == F.col("size"), 0).otherwise(part).cast("long")
    found = {"size": F.col("size"), "source_size": F.col("source_size"), "target": F.col("target"),
             "taken": F.col("copies") * F.col("size") + part, "copies": copies, "part_words": part_words}
    return unwrapped(out, found)


def repeated(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of the mix, with the columns of ``docs``: each row, whole, as often as it is taken.

    Of the row at a source's cut, of which ``mix`` takes a part, there is one more if the part is half of it or more, so a source is within
    half a row of its target (half of the rows alike, if several alike in key and text are at the cut). Rows that are not taken are
    not returned, nor are null and empty texts, which have no words. Reruns agree. Empty in, empty out.
    """
    mixed = mix(wrapped(docs, **{name: F.col(name) for name in {text, options.get("key", "doc_id"), options.get("source", "source")}}), text, **options)
    copies = F.col("copies") + F.when((F.col("part_words") > 0) & (2 * F.col("part_words") >= F.col("size")), 1).otherwise(0)
    times = mixed.withColumn("times", copies).where("size > 0 and times > 0").withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return times.select(*[F.col(f"row.`{name}`").alias(name) for name in docs.columns])
