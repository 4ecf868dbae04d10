"""Results of queries and checks as files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.functions.text import collapse_whitespace


def write_result(df: DataFrame, path: str, form: str = "json") -> None:
    """A result as JSON lines or as CSV with a header."""
    if form == "json":
        df.write.json(path, ignoreNullFields=False)
    elif form == "csv":
        df.write.csv(path, header=True, quote='"', escape='"')
    else:
        raise ValueError("form must be json or csv")


def one_line_values(df: DataFrame) -> DataFrame:
    """Values as a table prints them: text on one line, null as nothing."""
    shown = []
    for name, kind in df.dtypes:
        text = F.col(f"`{name}`").cast("string")
        if kind == "string":
            text = collapse_whitespace(text)
        shown.append(F.coalesce(text, F.lit("")).alias(name))
    return df.select(*shown)
