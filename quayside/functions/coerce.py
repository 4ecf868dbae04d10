"""Value shapes, casts and type-aware equality for text that holds typed data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quayside.functions.text import strip

# The accepted shapes of a UUID and of a timestamp text.
UUID_PATTERN = "(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"
TIMESTAMP_PATTERN = (
    r"(?i)^\d{4}-\d{2}-\d{2}"
    r"([ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"
)
_HEX_PAIRS = "^([0-9A-Fa-f]{2})*$"


def is_uuid(c: Column) -> Column:
    return strip(c).rlike(UUID_PATTERN)


def is_timestamp(c: Column) -> Column:
    return strip(c).rlike(TIMESTAMP_PATTERN)


def is_json(c: Column) -> Column:
    """An object or array that parses; JSON scalars do not count."""
    return strip(c).rlike(r"^[\[{]") & F.try_parse_json(c).isNotNull()


def is_zero_one(c: Column) -> Column:
    return c.isin("0", "1")


def to_flag(c: Column) -> Column:
    """0 and 1, as number or text, to boolean; anything else to null."""
    text = c.cast("string")
    return F.when(text == "1", True).when(text == "0", False)


def to_instant(c: Column) -> Column:
    """Timestamp text to an instant; text without a zone is UTC."""
    return F.try_to_timestamp(with_zone(c))


def to_variant(c: Column) -> Column:
    return F.try_parse_json(c)


def to_uuid(c: Column) -> Column:
    """Lower-cased UUID text, null when the shape is wrong."""
    return F.when(is_uuid(c), F.lower(strip(c)))


def with_zone(c: Column) -> Column:
    """Timestamp text with ``T`` before the time and a zone after it."""
    t = F.regexp_replace(strip(c), "^([^ ]*) ", "$1T")
    zoned = t.endswith("Z") | t.rlike("^.{11,}[+-]")
    return F.when(~zoned & t.contains("T"), F.concat(t, F.lit("Z"))).otherwise(t)


def canonical_json(c: Column) -> Column:
    """JSON text with sorted keys, no spacing, and ``1.0`` written as ``1``.

    Null when the text does not parse. The pattern walks over whole strings
    first, so digits inside them are left alone.
    """
    text = F.to_json(F.try_parse_json(c))
    return F.regexp_replace(
        text, r'("(?:[^"\\]|\\.)*+")|(-?\d+)\.0(?![0-9])', "$1$2"
    )


def json_equal(a: Column, b: Column) -> Column:
    """Equal as JSON documents; equal as text when neither is JSON.

    A document with a repeated key equals only its own text. What looks like
    JSON and is none equals nothing.
    """
    left, right = canonical_json(a), canonical_json(b)
    neither = left.isNull() & right.isNull()
    looks = strip(a).rlike(r"^[\[{]") | strip(b).rlike(r"^[\[{]")
    return (
        F.when(a.isNull() | b.isNull(), a.eqNullSafe(b))
        .when(a == b, ~looks | left.isNotNull() | F.get_json_object(a, "$").isNotNull())
        .when(left.isNotNull() & right.isNotNull(), left == right)
        .when(neither & ~looks, a == b)
        .otherwise(False)
    )


def _unhexed(c: Column) -> Column:
    bare = F.regexp_replace(c, r"^\\x", "")
    return F.when(bare.rlike(_HEX_PAIRS), F.unhex(bare))


def binary_equal(source: Column, target: Column) -> Column:
    """Same text, same hex digits, or ``target`` is the hex form of ``source``."""
    prefixed = target.startswith("\\x")
    return (
        F.when(source.isNull() | target.isNull(), source.eqNullSafe(target))
        .when(F.lower(source) == F.lower(target), True)
        .when(F.coalesce(_unhexed(source) == _unhexed(target), F.lit(False)), True)
        .otherwise(
            prefixed
            & F.coalesce(F.encode(source, "UTF-8") == _unhexed(target), F.lit(False))
        )
    )


def timestamp_equal(a: Column, b: Column) -> Column:
    """Same instant text once ``T`` and the zone are filled in."""
    return (
        F.when(a.isNull() | b.isNull(), a.eqNullSafe(b))
        .when(a == b, True)
        .when((a == "") | (b == ""), False)
        .otherwise(with_zone(a) == with_zone(b))
    )


def canonical_text(c: Column, kind: str) -> Column:
    """The text a value is compared by; null stays null.

    ``kind`` is one of flag, json, binary, timestamp, text.
    """
    if kind == "flag":
        return to_flag(c).cast("int").cast("string")
    if kind == "json":
        text = c.cast("string")
        return F.coalesce(canonical_json(text), text)
    if kind == "binary":
        return F.lower(F.hex(c))
    if kind == "timestamp":
        text = c.cast("string")
        instant = F.date_format(to_instant(text), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
        return F.coalesce(instant, text)
    return c.cast("string")


def values_equal(source: Column, target: Column, kind: str) -> Column:
    """Null-safe, type-aware equality of two column values."""
    if kind == "json":
        return json_equal(source, target)
    if kind == "binary":
        return binary_equal(source, target)
    if kind == "timestamp":
        return timestamp_equal(source, target)
    if kind == "flag":
        return to_flag(source).eqNullSafe(to_flag(target))
    return source.eqNullSafe(target)
