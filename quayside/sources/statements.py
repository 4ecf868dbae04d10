"""SQL files cut into statements, at the semicolons that end one.

Files of any size split between tasks, line ends do not matter, and a statement
or literal may lie across any number of splits.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.functions.text import WHITESPACE
from quayside.sources.crossing import OUTSIDE, Step, read_records

CODE, LINE, BLOCK = OUTSIDE, "-", "*"
_STATES = (CODE, "'", '"', "`", LINE, BLOCK)

_OPENS = {
    "mysql": re.compile(r"['\"`]|--(?=\s|\Z)|#|/\*"),
    "sqlite": re.compile(r"['\"`]|--|/\*"),
}
_CLOSES = {
    LINE: re.compile(r"[^\n]*+\n"),
    BLOCK: re.compile(r"(?s)(?:[^*]++|\*(?!/))*+\*/"),
    "`": re.compile(r"(?:[^`]++|``)*+`"),
}
_QUOTED = {
    "mysql": {q: re.compile(rf"(?s)(?:[^{q}\\]++|\\.|{q}{q})*+{q}") for q in "'\""},
    "sqlite": {q: re.compile(rf"(?:[^{q}]++|{q}{q})*+{q}") for q in "'\""},
}

# Comments before a statement; those the server runs (/*! */) are part of it.
_BEFORE = re.compile(r"(?:\s*+(?:--[^\n]*+(?:\n|\Z)|/\*(?!!)(?:[^*]++|\*(?!/))*+\*/)?)*+", re.ASCII)


def advance(state: str, text: str, dialect: str) -> str:
    """The lexer's state after ``text``."""
    opens, closes = _OPENS[dialect], _CLOSES | _QUOTED[dialect]
    at = 0
    while True:
        if state == CODE:
            found = opens.search(text, at)
            if not found:
                return CODE
            token = found[0]
            state = {"--": LINE, "#": LINE, "/*": BLOCK}.get(token, token)
        else:
            found = closes[state].match(text, at)
            if not found:
                return state
            state = CODE
        at = found.end()


def _bare(statement: str) -> str:
    """Without the comments before it and white space around it."""
    return statement[_BEFORE.match(statement).end():].rstrip(WHITESPACE)


def _stepper(dialect: str) -> Step:
    def step(state: str, texts: pa.Array) -> list[str]:
        out = []
        for piece in texts.to_pylist():
            state = advance(state, piece, dialect)
            out.append(state)
        return out

    return step


def read_statements(
    spark: SparkSession, paths: str | Sequence[str], dialect: str = "mysql"
) -> DataFrame:
    """Columns file, statement and ended: every statement of SQL files.

    Comments before a statement are removed. ``ended`` is false for text
    that a literal or comment left open runs through to the end of its file.
    Files of several splits are read once while this is built, see
    :func:`read_records`.
    """
    found = read_records(spark, paths, ";", _STATES, _stepper(dialect), _bare)
    return found.select("file", F.col("record").alias("statement"), "ended").where("statement <> ''")
