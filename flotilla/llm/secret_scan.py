"""Secrets in every version of every file, each distinct content scanned once for each version of each rule.

The ledger is a table of blobs (contents, named by their SHA-256): what each was scanned for, as pairs of rule kind and rule version, and
what was found. A scan names the blob of every version it is given, reads the texts of those blobs that lack a pair, runs the missing
rules alone over one copy of each, appends what it found to the ledger and joins the ledger's findings back to all versions. A scan
of contents seen before, or by rules run before, reads no text twice; a new version of a rule is run by itself and its old findings
no longer count.

All of it is DataFrame functions. Places of matches come from the lengths of what lies between them: the text split by the
pattern, and the matches, alternate.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .hot_join import salted_join
from .tables import landed


@dataclass(frozen=True)
class Rule:
    """Leftmost matches of ``pattern`` that don't overlap; those whose ``group`` has fewer than ``least`` characters are dropped."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1


#: The kinds that are always reported, in their order.
BASE = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 16),
    # a run of 32 or more is found whole by either pattern, and by this one without a match for each short run
    Rule("hex", 1, r"[0-9a-f]{32,}", 0, 32),
)
#: Public formats of keys and tokens beyond those.
FURTHER = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}"),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("userinfo", 1, r"[a-z][a-z0-9+.-]{1,15}://[^\s/:@]{1,64}:([^\s/:@]{1,128})@", 1, 8),
)
RULES = BASE + FURTHER
#: Up to so many blobs to scan, their names (32 bytes each) are sent to all tasks, so that texts seen before aren't shuffled.
BROADCAST_BLOBS = 100_000

_PAIR = "struct<kind: string, version: int>"
_SPAN = "struct<kind: string, version: int, start: int, end: int>"
LEDGER_SCHEMA = f"blob binary, scanned array<{_PAIR}>, spans array<{_SPAN}>"


def blob_of(text: Column) -> Column:
    """The name of a content: the SHA-256 of its UTF-8 bytes; null is the empty content."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def open_ledger(spark: SparkSession, path: str) -> str:
    """Make an empty ledger at ``path`` if there is none; a path every executor reaches."""
    spark.range(0).select(F.from_json(F.lit(None), LEDGER_SCHEMA).alias("r")).select("r.*").write.mode("ignore").parquet(path)
    return path


def ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER_SCHEMA).parquet(path)


def _pairs(rules: Sequence[Rule]) -> Column:
    return F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])


def unseen(blobs: DataFrame, known: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``blob, todo``: the distinct blobs that the ledger ``known`` lacks a pair of rule and version for, with the pairs."""
    done = known.groupBy("blob").agg(F.flatten(F.collect_list("scanned")).alias("done"))
    todo = F.array_except(_pairs(rules), F.coalesce(F.col("done"), F.array().cast(f"array<{_PAIR}>")))
    return blobs.select("blob").distinct().join(done, "blob", "left").select("blob", todo.alias("todo")).where(F.size("todo") > 0)


def _matches(text: Column, todo: Column, rule: Rule) -> Column:
    """One struct for each match and one for the rest behind the last: characters before it, its own, and whether it counts."""
    # no groups but the one asked for, since a pattern without groups has only the whole match
    whole, part = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    found = F.transform(
        F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), whole.alias("whole"), part.alias("part")),
        lambda m, i: F.struct(
            F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"), i.alias("i"), F.length(m["gap"]).alias("before"),
            F.length(m["whole"]).alias("n"), F.coalesce(F.length(m["part"]) >= rule.least, F.lit(False)).alias("counts")))
    asked = F.exists(todo, lambda pair: (pair["kind"] == rule.kind) & (pair["version"] == rule.version))
    return F.when(asked & text.rlike(rule.pattern), found)


def scanned_texts(texts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rows of the ledger for ``blob, text, todo`` with one row a blob."""
    text, todo = F.col("text"), F.col("todo")
    every = F.flatten(F.array_compact(F.array(*[_matches(text, todo, rule) for rule in rules])))
    rows = texts.select("blob", "todo", F.explode_outer(every).alias("m")).select("blob", "todo", "m.*")
    place = Window.partitionBy("blob", "kind", "version").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("before") + F.coalesce("n", F.lit(0))).over(place).cast("int")
    span = F.struct("kind", "version", (F.col("end") - F.col("n")).alias("start"), "end")
    return rows.withColumn("end", end).groupBy("blob").agg(
        F.first("todo").alias("scanned"), F.collect_list(F.when(F.col("counts"), span)).alias("spans"))


def texts_of(docs: DataFrame, text: str, wanted: DataFrame, few: int = BROADCAST_BLOBS) -> DataFrame:
    """``blob, text, todo`` of each wanted blob, from one of the rows that hold it."""
    rows = docs.select(blob_of(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    one = lambda held: held.groupBy("blob").agg(F.first("text").alias("text"))
    if wanted.limit(few + 1).count() <= few:
        return one(rows.join(F.broadcast(wanted.select("blob")), "blob", "left_semi")).join(F.broadcast(wanted), "blob")
    # copies of a content meet within their tasks before they are shuffled
    return one(rows).join(wanted, "blob")


def scan(versions: DataFrame, path: str, rules: Sequence[Rule] = RULES, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """Every row of ``versions`` with its ``blob`` and ``spans``: what ``rules`` find in its text, by the ledger at ``path``.

    A row is a version of a file; the columns ``keep`` (all but the text, unless given) say which. ``spans`` has ``kind, version, start, end``
    in characters, the end exclusive, in the order of start, then rule. Null and empty texts are the empty blob, without spans. Repeated
    rows stay repeated; equal texts, however many, are scanned once. ``blob`` and ``spans`` replace columns of these names. An empty
    table gives an empty table.

    The ledger gets one append. A scan that dies before it leaves the ledger as it was; two scans at once may both scan a
    new blob, whose spans then count once.
    """
    spark = versions.sparkSession
    own = [c for c in (versions.columns if keep is None else keep) if keep is not None or c != text]
    shown = [c for c in own if c.lower() not in ("blob", "spans")]
    held = F.struct(*[versions[f"`{c}`"] for c in shown]) if shown else F.struct(F.lit(0).alias("__none"))
    named = landed(versions.select(held.alias("row"), blob_of(versions[f"`{text}`"]).alias("blob"), F.monotonically_increasing_id().alias("at")), "versions")
    wanted = landed(unseen(named, ledger(spark, path), rules), "unseen")
    scanned_texts(texts_of(versions, text, wanted), rules).write.mode("append").parquet(path)
    order = F.array(*[F.lit(r.kind) for r in rules])
    current = F.filter(F.flatten(F.collect_list("spans")), lambda s: F.array_contains(_pairs(rules), F.struct(s["kind"].alias("kind"), s["version"].alias("version"))))
    keyed = F.array_sort(F.transform(F.array_distinct(current), lambda s: F.struct(s["start"].alias("a"), F.array_position(order, s["kind"]).alias("b"), s["end"].alias("c"), s.alias("s"))))
    found = ledger(spark, path).where(F.size("spans") > 0).groupBy("blob").agg(F.transform(keyed, lambda k: k["s"]).alias("spans"))
    joined = salted_join(named, found, "blob", "left", ["at"])
    return joined.select(*[F.col(f"row.`{c}`").alias(c) for c in shown], "blob",
                         F.coalesce(F.col("spans"), F.array().cast(f"array<{_SPAN}>")).alias("spans"))


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
