"""Values kept as text: tags, sizes, image references, durations, instants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Size units, largest first, as the power of two of their bytes.
SIZE_UNITS = {"p": 50, "t": 40, "g": 30, "m": 20, "k": 10}

# Tag names below the prefix, and the one system tag without it.
TAG_NAMES = {
    "cluster_id": "cluster_id",
    "name": "cluster_name",
    "cluster_image": "cluster_docker_image",
    "ttl": "cluster_ttl",
    "idle_timeout": "cluster_idle_timeout",
    "container_state": "container_state",
    "image": "docker_image",
    "placement_group": "placement_group",
    "role": "spark_cluster_role",
    "subnet_id": "subnet_id",
    "worker_type": "worker_instance_type",
    "bid_price": "worker_bid_price",
}
NAME_TAG = "Name"

# ISO-8601 duration, instant with offset, termination stamp.
DURATION = r"(?i)^([-+]?)P(?=[-+0-9T])(?:([-+]?[0-9]+)D)?(T(?=[-+0-9])(?:([-+]?[0-9]+)H)?(?:([-+]?[0-9]+)M)?(?:([-+]?[0-9]+)(?:[.,]([0-9]{0,9}))?S)?)?$"
INSTANT = r"^([0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2})(:[0-9]{2}(?:\.[0-9]{1,9})?)?(Z|[-+][0-9]{2}(?::[0-9]{2})?)$"
STAMP_FORMAT = "yyyy-MM-dd HH:mm:ss z"


def is_system_tag(key: Column, tag_prefix: str) -> Column:
    return key.startswith(tag_prefix) | (key == NAME_TAG)


def tag_number(value: Column, unit: str) -> Column:
    """``"10h"`` with unit ``h`` is 10; null when the text before the unit is no whole number."""
    head = F.substring_index(value, unit, 1)
    return F.when(head.rlike(r"^[-+]?[0-9]+$"), head.try_cast("bigint"))


def size_text(size: Column) -> Column:
    """Bytes in the largest binary unit that divides them exactly: 5120 is ``5k``, 0 is ``0b``."""
    whole = size.cast("decimal(38,0)")
    chain = F.when(whole == 0, F.lit("0b"))
    for unit, power in SIZE_UNITS.items():
        per = F.lit(2**power).cast("decimal(38,0)")
        text = F.concat((whole / per).cast("decimal(38,0)").cast("string"), F.lit(unit))
        chain = chain.when(whole % per == 0, text)
    return chain.otherwise(F.concat(whole.cast("string"), F.lit("b")))


def image_repo(ref: Column) -> Column:
    return F.substring_index(ref, ":", 1)


def image_tag(ref: Column) -> Column:
    """Everything after the first colon, empty without one."""
    return F.regexp_extract(ref, r"(?s)^[^:]*:?(.*)$", 1)


def image_ref(repo: Column, tag: Column) -> Column:
    return F.concat(repo, F.lit(":"), tag)


def build_number(tag: Column) -> Column:
    """The whole number that starts the text after the last dash, null when there is none."""
    return F.regexp_extract(tag, r"^(?:.*-)?([0-9]+)[^-]*$", 1).try_cast("bigint")


def duration_millis(text: Column) -> Column:
    """ISO-8601 duration to milliseconds (``PT1H30M`` is 5400000), null when malformed."""
    def part(group: int) -> Column:
        return F.coalesce(F.nullif(F.regexp_extract(text, DURATION, group), F.lit("")).try_cast("bigint"), F.lit(0))

    seconds = F.regexp_extract(text, DURATION, 6)
    fraction = F.rpad(F.substring(F.regexp_extract(text, DURATION, 7), 1, 3), 3, "0").cast("bigint")
    fraction = F.when(seconds.startswith("-"), -fraction).otherwise(fraction)
    total = (part(2) * 86_400 + part(4) * 3_600 + part(5) * 60 + part(6)) * 1_000 + fraction
    sign = F.when(F.regexp_extract(text, DURATION, 1) == "-", F.lit(-1)).otherwise(F.lit(1))
    return F.when(text.rlike(DURATION), (sign * total).cast("bigint"))


def duration_text(millis: Column) -> Column:
    """Milliseconds to the shortest ISO-8601 hours/minutes/seconds form; zero is ``PT0S``."""
    size = F.abs(millis)
    sign = F.when(millis < 0, F.lit("-")).otherwise(F.lit(""))

    def part(amount: Column, unit: str) -> Column:
        return F.when(amount != 0, F.concat(sign, amount.cast("string"), F.lit(unit))).otherwise("")

    hours = F.floor(size / 3_600_000)
    minutes = F.floor(F.pmod(size, F.lit(3_600_000)) / 60_000)
    rest = F.pmod(size, F.lit(60_000))
    fraction = F.regexp_replace(F.lpad(F.pmod(rest, F.lit(1_000)).cast("string"), 3, "0"), "0+$", "")
    seconds = F.when(rest != 0, F.concat(
        sign, F.floor(rest / 1_000).cast("string"),
        F.when(fraction != "", F.concat(F.lit("."), fraction)).otherwise(""), F.lit("S"))).otherwise("")
    body = F.concat(part(hours, "H"), part(minutes, "M"), seconds)
    return F.when(millis.isNotNull(), F.concat(F.lit("PT"), F.when(body == "", "0S").otherwise(body)))


def instant(text: Column) -> Column:
    """ISO date-time with an offset to a timestamp, null when malformed."""
    seconds = F.regexp_extract(text, INSTANT, 2)
    full = F.concat(F.regexp_extract(text, INSTANT, 1),
                    F.when(seconds == "", ":00").otherwise(seconds), F.regexp_extract(text, INSTANT, 3))
    return F.when(text.rlike(INSTANT), F.try_to_timestamp(full))


def instant_text(ts: Column) -> Column:
    """Timestamp in UTC; seconds are left out when zero, the fraction has 0, 3 or 6 digits.

    Needs session time zone UTC.
    """
    micros = F.pmod(F.unix_micros(ts.cast("timestamp")), F.lit(60_000_000))
    fraction = F.pmod(micros, F.lit(1_000_000))
    head = F.date_format(ts, "yyyy-MM-dd'T'HH:mm")
    tail = (
        F.when(micros == 0, "")
        .when(fraction == 0, F.date_format(ts, ":ss"))
        .when(fraction % 1_000 == 0, F.date_format(ts, ":ss.SSS"))
        .otherwise(F.date_format(ts, ":ss.SSSSSS"))
    )
    return F.concat(head, tail, F.lit("Z"))


def stamp_in_reason(reason: Column) -> Column:
    """The moment in a text such as ``User initiated (2024-01-02 03:04:05 GMT)``, null if unreadable."""
    inner = F.regexp_extract(reason, r"^[^(]*\((.*).$", 1)
    return F.try_to_timestamp(inner, F.lit(STAMP_FORMAT))


def whole_bytes(text: Column) -> Column:
    """A byte count given as an integer, null otherwise."""
    return F.when(text.rlike(r"^-?[0-9]+$"), text.try_cast("decimal(38,0)"))


def plus_seconds(ts: Column, seconds: Column) -> Column:
    zero = F.lit(0)
    return ts + F.make_dt_interval(zero, zero, zero, seconds.cast("decimal(18,6)"))
