"""Quoted CSV files, split between tasks at any size.

A line break ends a row only outside of quotes. Since a quote inside a value is
doubled, that is so after an even number of quotes, wherever a split begins.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.functions.text import quote_identifier
from quayside.sources.crossing import OUTSIDE, read_records

_QUOTED = '"'


def _quotes(state: str, texts: pa.Array) -> np.ndarray:
    """The state after each line, by counting its quotes."""
    seen = np.cumsum(pc.count_substring(texts, _QUOTED).to_numpy(zero_copy_only=False))
    return np.where((seen + (state == _QUOTED)) % 2 == 1, _QUOTED, OUTSIDE)


def _line(record: str) -> str:
    return record.removesuffix("\r")


def read_quoted(
    spark: SparkSession, paths: str | Sequence[str], schema: str | T.StructType, **options: str
) -> DataFrame:
    """Rows of CSV files with a header each, line breaks inside quotes kept.

    Equal to a CSV scan with ``multiLine``, which gives a file to one task, for
    files in which quotes enclose whole values and are doubled inside of them.
    Rows end with a line feed, before which one carriage return is taken off; empty lines
    are no rows, and an empty file or one with a header alone has none. A quote
    left open at the end of a file fails the job. A row may repeat and there is
    no order. For what is read while this is built see :func:`read_records`.
    """
    found = read_records(spark, paths, "\n", (OUTSIDE, _QUOTED), _quotes, _line).where("NOT first")
    torn = F.concat(F.lit("a quote is left open at the end of "), F.col("file"))
    record = F.when(F.col("ended"), F.col("record")).otherwise(F.raise_error(torn).cast("string"))
    parsed = F.from_csv("record", _ddl(schema), {"quote": _QUOTED, "escape": _QUOTED, "multiLine": "true", **options})
    rows = found.select(record.alias("record")).where("record <> ''").select(parsed.alias("row"))
    return rows.select("row.*")


def _ddl(schema: str | T.StructType) -> str:
    if isinstance(schema, str):
        return schema
    return ", ".join(f"{quote_identifier(f.name)} {f.dataType.simpleString()}" for f in schema.fields)
