"""Column functions on text: quoting, escaping, cleaning, shortening.

All of them stay on the JVM side as built-in expressions, so they fuse into
whole-stage code with the scan they follow.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = " \t\n\r\x0b\x0c"

# The escape letters a MySQL string literal knows. The backslash
# comes first, so that no escape written later is escaped again.
MYSQL_ESCAPES = [
    ("\\", "\\\\"),
    ("\0", "\\0"),
    ("'", "\\'"),
    ('"', '\\"'),
    ("\b", "\\b"),
    ("\n", "\\n"),
    ("\r", "\\r"),
    ("\t", "\\t"),
    ("\x1a", "\\Z"),
]


def strip(c: Column) -> Column:
    """Remove whitespace of every kind from both ends."""
    return F.btrim(c, F.lit(WHITESPACE))


def escape_literal(c: Column) -> Column:
    """The body of a MySQL string literal for this text."""
    for raw, escaped in MYSQL_ESCAPES:
        c = F.replace(c, F.lit(raw), F.lit(escaped))
    return c


def unescape_literal(c: Column) -> Column:
    """Undo :func:`escape_literal`.

    Escaped backslashes split the text first; within the parts, a backslash
    can then only start an escape.
    """

    def unescape(part: Column) -> Column:
        for raw, escaped in MYSQL_ESCAPES[1:]:
            part = F.replace(part, F.lit(escaped), F.lit(raw))
        return part

    return F.array_join(F.transform(F.split(c, r"\\\\"), unescape), "\\")


def quote_identifier(name: str) -> str:
    """A name in backticks, inner backticks doubled."""
    return "`" + name.replace("`", "``") + "`"


def quoted_identifier(c: Column) -> Column:
    """Column form of :func:`quote_identifier`."""
    return F.concat(F.lit("`"), F.replace(c, F.lit("`"), F.lit("``")), F.lit("`"))


def quoted_literal(c: Column) -> Column:
    """Text in single quotes, inner single quotes doubled."""
    return F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))


def strip_controls(c: Column, keep_newlines: bool = False) -> Column:
    """Drop C0 controls, DEL and C1 controls, so no terminal escape survives."""
    if keep_newlines:
        return F.regexp_replace(c, r"[\x00-\x09\x0b-\x1f\x7f-\x9f]", "")
    return F.regexp_replace(c, r"[\x00-\x1f\x7f-\x9f]", "")


def collapse_whitespace(c: Column) -> Column:
    """Every run of whitespace becomes one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def preview(c: Column, limit: int = 160) -> Column:
    """One-line preview of a query text."""
    return F.left(collapse_whitespace(strip_controls(c)), F.lit(limit))


def ellipsize(c: Column, limit: int) -> Column:
    """Shorten to ``limit`` characters, the last one an ellipsis.

    Counts characters, so a multi-byte character is never cut in half.
    """
    return F.when(
        F.length(c) > limit, F.concat(F.left(c, F.lit(limit - 1)), F.lit("…"))
    ).otherwise(c)


def report_value(c: Column, is_blob: bool = False, limit: int = 64) -> Column:
    """Shorten a value for a mismatch report; blobs in hex tell their size."""
    short = F.concat(F.left(c, F.lit(limit)), F.lit("..."))
    if is_blob:
        sized = F.concat(
            short, F.format_string(" (%d bytes)", F.floor(F.length(c) / 2))
        )
        short = F.when(c.rlike("^([0-9A-Fa-f]{2})*$"), sized).otherwise(short)
    return F.when(F.length(c) > limit, short).otherwise(c)


def identifier_too_long(c: Column) -> Column:
    """Longer than the 63 bytes PostgreSQL keeps of a name."""
    return F.octet_length(c) > 63


def identifier_mixed_case(c: Column) -> Column:
    """Holds upper-case and lower-case letters."""
    return c.rlike(r"\p{Lu}") & c.rlike(r"\p{Ll}")
