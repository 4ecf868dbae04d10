"""Short labels and roundings for reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORKLESS = ["sleep", "idle"]


def round2(c: Column) -> Column:
    """Two decimals by adding half and truncating toward zero."""
    return (c * 100 + 0.5).cast("bigint") / F.lit(100.0)


def compact_duration(ms: Column) -> Column:
    """``MM:SS``, with hours in front from one hour up; ``-`` for none."""
    seconds = F.floor(ms / 1000)
    minutes = F.floor(seconds / 60)
    short = F.format_string("%02d:%02d", minutes, seconds % 60)
    long = F.format_string(
        "%02d:%02d:%02d", F.floor(minutes / 60), minutes % 60, seconds % 60
    )
    return F.when(ms <= 0, "-").when(minutes >= 60, long).otherwise(short)


def wait_label(kind: Column, event: Column, empty: str = "-") -> Column:
    """``type/event``, the one that is there, or ``empty``."""
    label = F.concat_ws("/", F.nullif(kind, F.lit("")), F.nullif(event, F.lit("")))
    return F.when(label == "", empty).otherwise(label)


def state_label(state: Column) -> Column:
    """Idle-in-transaction states shortened but kept apart from idle."""
    short = F.replace(state, F.lit("idle in transaction"), F.lit("idle/xact"))
    return F.when(
        state.isin("idle in transaction", "idle in transaction (aborted)"), short
    ).otherwise(state)


def command_label(state: Column) -> Column:
    """The command of a ``command/state`` pair."""
    return F.substring_index(state, "/", 1)


def has_work(state: Column, query: Column, process_list: bool = False) -> Column:
    """Not sleeping or idle, and a state or query text to show for it."""
    text = F.coalesce(state, F.lit(""))
    text = F.lower(F.trim(command_label(text) if process_list else text))
    resting = text.isin(*_WORKLESS)
    if not process_list:
        resting = resting | text.startswith("idle ")
    return ~resting & ((text != "") | (F.trim(F.coalesce(query, F.lit(""))) != ""))


def block_label(blocking: Column, waiting: Column) -> Column:
    """``3 W`` blocks three and waits, ``3`` blocks, ``W`` waits, ``-`` neither."""
    count = blocking.cast("string")
    return (
        F.when((blocking > 0) & waiting, F.concat(count, F.lit(" W")))
        .when(blocking > 0, count)
        .when(waiting, "W")
        .otherwise("-")
    )


#: Sampling intervals after which what is shown counts as old.
STALE_AFTER, VERY_STALE_AFTER = 3, 10


def freshness_tier(age: Column, interval: Column) -> Column:
    """Age against the sampling interval, both in the same unit."""
    return (
        F.when((interval <= 0) | age.isNull(), "fresh")
        .when(age >= interval * VERY_STALE_AFTER, "very stale")
        .when(age >= interval * STALE_AFTER, "stale")
        .otherwise("fresh")
    )


def megabytes(size: Column) -> Column:
    return F.round(size / 1024 / 1024, 2)


def percent_of(part: Column, whole: Column, digits: int = 1) -> Column:
    """Share in percent, null when the whole is zero."""
    return F.round(part / F.nullif(whole, F.lit(0)) * 100, digits)


def percent_label(ratio: Column) -> Column:
    """A ratio as percent text with one decimal."""
    return F.concat((ratio * 100).cast("decimal(18,1)").cast("string"), F.lit("%"))


def size_label(size: Column) -> Column:
    """Bytes as PostgreSQL prints them: the unit grows once five digits show.

    Works in half units, so that adding one before halving rounds to nearest.
    """
    size = size.cast("bigint")
    label = F.when(size < 10 * 1024, F.format_string("%d bytes", size))
    half = F.shiftright(size, 9)
    for unit in ("kB", "MB", "GB", "TB"):
        text = F.format_string("%d " + unit, F.shiftright(half + 1, 1))
        label = label.when(half < 20 * 1024 - 1, text)
        half = F.shiftright(half, 10)
    label = label.otherwise(F.format_string("%d PB", F.shiftright(half + 1, 1)))
    return F.when(size.isNotNull(), label)


def finished_at(completed: Column, cancelled: Column) -> Column:
    return F.coalesce(completed, cancelled)


def elapsed_seconds(start: Column, end: Column) -> Column:
    """Seconds between two timestamps, zero when either is missing."""
    whole = F.timestamp_diff("SECOND", start, end)
    return F.coalesce(whole, F.lit(0)).cast("bigint")


def serving_label(primaries: Column, replicas: Column, completed: Column) -> Column:
    """Which tablets a copy workflow already serves traffic from."""
    return (
        F.when((primaries & replicas) | completed.isNotNull(), "Primary & replicas")
        .when(primaries, "Primary")
        .when(replicas, "Replicas")
        .otherwise("")
    )


def copied_percent(copied: Column, total: Column) -> Column:
    return F.floor(copied * 100 / F.nullif(total, F.lit(0))).cast("bigint")
