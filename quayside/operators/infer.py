"""Types, findings and rules for tables loaded as plain text."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.functions import coerce
from quayside.functions.text import identifier_mixed_case, identifier_too_long
from quayside.sources.tables import BOOKKEEPING, bookkeeping_code

# Names that suggest a flag.
FLAG_NAMES = ["active", "enabled", "published", "archived", "disabled"]
SEVERITIES = ["error", "warning", "info"]

#: What an unsized number is loaded as where there is no value to go by.
UNSIZED = "decimal(38,18)"
#: Digits before and after the point that a decimal holds.
MOST_DIGITS = 38

TESTS = {
    "uuid": coerce.is_uuid,
    "flag": coerce.is_zero_one,
    "json": coerce.is_json,
    "timestamp": coerce.is_timestamp,
}


@dataclass(frozen=True)
class TextColumn:
    """A column as a dump declares it."""

    name: str
    declared: str = "TEXT"
    primary_key: bool = False
    foreign_key: bool = False
    autoincrement: bool = False

    def candidates(self) -> list[str]:
        """What the name and declared type allow the values to be."""
        name, kind = self.name.lower(), self.declared.upper()
        found = []
        texty = kind == "" or any(t in kind for t in ("CHAR", "CLOB", "TEXT"))
        if texty and ((self.primary_key and name in ("id", "uuid")) or name.endswith("_uuid")):
            found.append("uuid")
        if kind in ("INTEGER", "INT") and not self.foreign_key:
            found.append("flag")
        if self.declared == "TEXT":
            if any(t in name for t in ("json", "metadata", "payload")):
                found.append("json")
            dated = name == "date" or name.endswith("_date") or name.startswith("date_")
            if "_at" in name or "timestamp" in name or dated:
                found.append("timestamp")
        return found

    def flag_name(self) -> bool:
        name = self.name.lower()
        hinted = name.startswith("is_") or name.endswith("_flag") or name in FLAG_NAMES
        return hinted and self.declared.upper() in ("INTEGER", "INT")

    def unsized(self) -> bool:
        """Whether it is a number of any size, which only its values can tell."""
        return self.plain_type() == UNSIZED

    def plain_type(self) -> str:
        """The Spark type by declaration alone; parts of words count, in order."""
        kind = self.declared.upper()
        if self.autoincrement or "INT" in kind:
            return "bigint"
        if any(t in kind for t in ("CHAR", "CLOB", "TEXT")):
            return "string"
        if "BLOB" in kind:
            return "binary"
        if any(t in kind for t in ("REAL", "FLOA", "DOUB")):
            return "double"
        if "BOOL" in kind:
            return "boolean"
        if "NUMERIC" in kind or "DECIMAL" in kind:
            size = re.search(r"\((\d+)\s*(?:,\s*(\d+))?\s*\)", kind)
            if not size:
                return UNSIZED
            # More digits than a decimal holds stay text rather than lose some.
            return f"decimal({size[1]},{size[2] or 0})" if int(size[1]) <= 38 else "string"
        return "string"


# What each kind of value becomes.
KIND_TYPES = {"uuid": "uuid", "flag": "boolean", "json": "variant", "timestamp": "timestamp"}


def profile(df: DataFrame, table: str, columns: Sequence[TextColumn]) -> DataFrame:
    """Per column how many values there are and how many fail each test.

    One aggregation over the table for all columns; a test runs only where the
    declaration admits it. All values count, not a sample. Columns of unsized
    numbers also tell their most digits before and after the point, leading and
    trailing zeros apart, and how many values are no plain numbers.
    """
    aggs, rows = [], []
    for i, col in enumerate(columns):
        c = F.col(f"`{col.name}`")
        aggs.append(F.count(c).alias(f"n{i}"))
        fails = []
        for kind, test in TESTS.items():
            if kind in col.candidates():
                bad = F.count_if((c != "") & ~F.coalesce(test(c), F.lit(False)))
                aggs.append(bad.alias(f"{kind}{i}"))
                fails.append(F.col(f"{kind}{i}").alias(f"not_{kind}"))
            else:
                fails.append(F.lit(None).cast("bigint").alias(f"not_{kind}"))
        if col.unsized():
            number, whole, places = _digits(c)
            wrong = F.count_if((c != "") & ~F.coalesce(number, F.lit(False)))
            aggs += [wrong.alias(f"wrong{i}"), F.max(whole).alias(f"whole{i}"), F.max(places).alias(f"places{i}")]
        for name, count in (("not_number", "wrong"), ("digits", "whole"), ("places", "places")):
            fails.append((F.col(f"{count}{i}") if col.unsized() else F.lit(None)).cast("bigint").alias(name))
        rows.append(
            F.struct(
                F.lit(col.name).alias("column_name"),
                F.lit(col.declared).alias("declared"),
                F.lit(col.plain_type()).alias("plain_type"),
                F.lit(col.autoincrement).alias("autoincrement"),
                F.lit(col.flag_name()).alias("flag_name"),
                F.col(f"n{i}").alias("present"),
                *fails,
            )
        )
    counted = df.agg(*aggs)
    return counted.select(F.lit(table).alias("table_name"), F.inline(F.array(*rows)))


def _digits(c: Column) -> tuple[Column, Column, Column]:
    """Whether a text is a plain number, its digits before the point and after it."""
    number = c.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)\s*$")
    whole = F.length(F.regexp_extract(c, r"^\s*[+-]?0*(\d*)", 1))
    places = F.length(F.regexp_extract(c, r"\.(\d*?)0*\s*$", 1))
    return number, F.when(number, whole), F.when(number, places)


def _holds(kind: str) -> Column:
    """The column may be of this kind, has values, and none of them objects."""
    return F.coalesce((F.col(f"not_{kind}") == 0) & (F.col("present") > 0), F.lit(False))


def infer_types(profiled: DataFrame) -> DataFrame:
    """The type each column of a profile is loaded as.

    An unsized number becomes a decimal of the digits that its values have. It
    stays text if they have more than a decimal holds, or one is no plain
    number, so that none is rounded or lost.
    """
    kind = F.when(_holds("uuid"), KIND_TYPES["uuid"]).when(
        F.col("autoincrement"), F.col("plain_type")
    )
    for name in ("flag", "json", "timestamp"):
        kind = kind.when(_holds(name), KIND_TYPES[name])
    size = F.greatest(F.col("digits") + F.col("places"), F.lit(1))
    fits = (F.col("not_number") == 0) & (size <= MOST_DIGITS)
    exact = F.format_string("decimal(%d,%d)", size, F.col("places"))
    # Without values the declaration decides.
    kind = kind.when(F.col("digits").isNotNull() | (F.col("not_number") > 0), F.when(fits, exact).otherwise("string"))
    return profiled.select(
        "table_name", "column_name", "declared", kind.otherwise(F.col("plain_type")).alias("type")
    )


def type_map(types: DataFrame) -> dict[str, str]:
    """Column types by name; one row per column of one table is collected."""
    return {r["column_name"]: r["type"] for r in types.collect()}


def _cast(name: str, kind: str) -> Column:
    c = F.col(f"`{name}`")
    if kind == "boolean":
        return coerce.to_flag(c)
    if kind == "timestamp":
        return coerce.to_instant(c)
    if kind == "variant":
        return coerce.to_variant(c)
    if kind == "uuid":
        return coerce.to_uuid(c)
    if kind == "binary":
        hexed = F.regexp_extract(c, "^[xX]'([0-9A-Fa-f]*)'$", 1)
        return F.when(c.rlike("^[xX]'"), F.unhex(hexed)).otherwise(F.encode(c, "UTF-8"))
    if kind.startswith("decimal"):
        # A value the type would round does not fit it.
        scale = int(kind.rstrip(")").rpartition(",")[2])
        places = F.length(F.regexp_extract(c, r"\.(\d*?)0*\s*$", 1))
        small = F.when(c.rlike("[eE]"), c.try_cast(kind).cast("double") == c.try_cast("double")).otherwise(places <= scale)
        return F.when(small, c.try_cast(kind))
    return c if kind == "string" else c.try_cast(kind)


def typed_load(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Text columns cast by the rule of their type; what does not fit is null."""
    return df.select(*[_cast(n, k).alias(n) for n, k in types.items()])


def rejected_values(df: DataFrame, table: str, types: Mapping[str, str]) -> DataFrame:
    """Values per column that the typed load turns into null, in one pass."""
    names = list(types)
    lost = [
        F.count_if(
            F.col(f"`{n}`").isNotNull() & (F.col(f"`{n}`") != "") & _cast(n, types[n]).isNull()
        ).alias(f"r{i}")
        for i, n in enumerate(names)
    ]
    rows = [
        F.struct(F.lit(n).alias("column_name"), F.lit(types[n]).alias("type"), F.col(f"r{i}").alias("rejected"))
        for i, n in enumerate(names)
    ]
    return df.agg(*lost).select(F.lit(table).alias("table_name"), F.inline(F.array(*rows)))


def _finding(when: Column, code: str, severity: Column | str, text: Column | str) -> Column:
    level = F.lit(severity) if isinstance(severity, str) else severity
    words = F.lit(text) if isinstance(text, str) else text
    return F.when(
        when,
        F.struct(F.lit(code).alias("code"), level.alias("severity"), words.alias("remediation")),
    )


def _chosen(kind: str, yes: str, no: str) -> Column:
    return F.when(_holds(kind), yes).otherwise(no)


def column_findings(profiled: DataFrame) -> DataFrame:
    """What to know about the columns of a profiled table before loading it."""
    flagged = _holds("flag")
    found = [
        _finding(F.col("autoincrement"), "AUTOINCREMENT", "warning", "becomes an identity column"),
        _finding(flagged, "BOOLEAN_AS_INTEGER", "warning", "0 and 1 load as booleans"),
        _finding(
            ~flagged & F.col("flag_name"), "BOOLEAN_NAME_MISMATCH", "info",
            "named like a flag but holds other values; stays an integer",
        ),
        _finding(
            F.col("not_timestamp").isNotNull(), "TEXT_TIMESTAMP",
            _chosen("timestamp", "warning", "info"),
            _chosen("timestamp", "loads as a timestamp", "named like a time but holds other values; stays text"),
        ),
        _finding(
            F.col("not_json").isNotNull(), "JSON_IN_TEXT", "info",
            _chosen("json", "loads as a JSON document", "named like JSON but holds other values; stays text"),
        ),
        _finding(
            F.col("not_uuid").isNotNull(), "TEXT_UUID", "info",
            _chosen("uuid", "loads as a UUID", "named like a UUID but holds other values; stays text"),
        ),
        *_name_findings(F.col("column_name")),
    ]
    return _spread(profiled, found, "column_name")


def _name_findings(name: Column) -> list[Column]:
    return [
        _finding(identifier_too_long(name), "IDENTIFIER_TOO_LONG", "error", "use a name of at most 63 bytes"),
        _finding(identifier_mixed_case(name), "MIXED_CASE_IDENTIFIER", "warning", "unquoted names fold to lower case"),
    ]


def table_findings(listing: DataFrame) -> DataFrame:
    """Findings on table names: bookkeeping of migration tools, bad names."""
    name = F.col("table_name")
    code = bookkeeping_code(name)
    tool = F.when(code == BOOKKEEPING[0][0], BOOKKEEPING[0][1])
    for rule, label, _ in BOOKKEEPING[1:]:
        tool = tool.when(code == rule, label)
    kept = F.when(
        code.isNotNull(),
        F.struct(
            code.alias("code"),
            F.lit("info").alias("severity"),
            F.concat(F.lit("skipped; set a new baseline for "), tool).alias("remediation"),
        ),
    )
    empty = F.lit(None).cast("string").alias("column_name")
    return _spread(listing.select("table_name", empty), [kept, *_name_findings(name)], "column_name")


def _spread(rows: DataFrame, found: list[Column], column: str) -> DataFrame:
    present = F.filter(F.array(*found), lambda f: f.isNotNull())
    return rows.select("table_name", F.col(column).alias("column_name"), F.inline(present))


def severity_rank(severity: Column) -> Column:
    rank = F.lit(len(SEVERITIES))
    for i, name in enumerate(SEVERITIES):
        rank = F.when(severity == name, i).otherwise(rank)
    return rank


def group_findings(findings: DataFrame) -> DataFrame:
    """Findings of the same code and text together, errors first.

    One row per place with the size of its group, not a list per group: a
    finding may hit every column of a fleet, and no task should hold them all.
    """
    key = ["severity", "code", "remediation"]
    sizes = findings.groupBy(*key).agg(F.count("*").alias("locations"))
    place = F.concat_ws(".", "table_name", "column_name")
    joined = findings.select(*key, place.alias("location")).join(sizes, key)
    ranked = joined.withColumn("rank", severity_rank(F.col("severity")))
    return ranked.orderBy("rank", "code", "remediation", "location")


def severity_totals(findings: DataFrame) -> DataFrame:
    """One row with the number of findings of each severity."""
    return findings.agg(
        *[F.count_if(F.col("severity") == s).alias(f"{s}s") for s in SEVERITIES]
    )


def column_samples(df: DataFrame, columns: Sequence[str], keep: int = 32) -> DataFrame:
    """The ``keep`` least distinct values of every column, for a person to look at.

    Each task holds no more than ``keep`` values of a column and passes those
    on, however many distinct ones there are. Nulls do not count; a column
    without values has no row.
    """
    text = [F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(columns)]

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [pa.array([], pa.binary()) for _ in columns]
        for batch in batches:
            for i, values in enumerate(batch.columns):
                some = pc.unique(pa.concat_arrays([held[i], values.cast(pa.binary())])).drop_null()
                held[i] = some.take(pc.array_sort_indices(some)[:keep])
        whole = pa.concat_arrays(held)
        names = [name for name, own in zip(columns, held, strict=True) for _ in range(len(own))]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), whole.cast(pa.string())], ["column_name", "value"])

    distinct = df.select(*text).mapInArrow(least, "column_name string, value string").distinct()
    first = Window.partitionBy("column_name").orderBy("value")
    kept = distinct.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= keep)
    return kept.groupBy("column_name").agg(
        F.sort_array(F.collect_list("value")).alias("samples")
    )


def expectations(
    df: DataFrame, table: str, rules: Mapping[str, str], flags: Sequence[str] = ()
) -> DataFrame:
    """Rows that break each rule, an SQL condition; unknown passes, as in SQL.

    Rules written for 0/1 columns also hold for ``flags`` loaded as booleans.
    """
    if flags:
        df = df.withColumns({c: F.col(c).cast("int") for c in flags})
    names = list(rules)
    broken = [F.count_if(~F.expr(rules[n])).alias(f"b{i}") for i, n in enumerate(names)]
    rows = [
        F.struct(
            F.lit(n).alias("rule"), F.col("_rows").alias("rows"), F.col(f"b{i}").alias("violations"),
            (F.col(f"b{i}") == 0).alias("passed"),
        )
        for i, n in enumerate(names)
    ]
    counted = df.agg(F.count("*").alias("_rows"), *broken)
    return counted.select(F.lit(table).alias("table_name"), F.inline(F.array(*rows)))
