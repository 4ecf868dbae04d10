"""What a logged SQL text would do, told from its words.

Works on the column with regular expressions: literals and comments become
blanks, then the leading words decide. It is a guard for logs, not a grammar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The words that lead a read, and those that lead a removal.
READ_WORDS = ["SELECT", "SHOW", "DESCRIBE", "DESC", "EXPLAIN", "TABLE"]
REMOVAL_WORDS = ["DELETE", "DROP", "TRUNCATE"]

# Literals, comments and the marks around live MySQL comments. Possessive
# loops keep long literals off the matcher's stack; an open one runs to the end.
_BLANKED = "|".join(
    [
        r"'[^'\\]*+(?:(?:\\.|\\\z|'')[^'\\]*+)*+(?:'|\z)",
        r'"[^"]*+(?:""[^"]*+)*+(?:"|\z)',
        r"`[^`]*+(?:``[^`]*+)*+(?:`|\z)",
        r"--[^\n]*+",
        r"#[^\n]*+",
        r"/\*!\d*+",
        r"/\*.*?(?:\*/|\z)",
        r"\*/",
    ]
)
_GROUP = "\u0001"  # stands for a whole parenthesised group
_CTE = r"(?>.*?(?<!\w)AS(?!\w))\s*+(?:(?:NOT\s++)?MATERIALIZED(?!\w))?\s*+\x01\s*+"
_CTE_LIST = rf"(?is)^WITH(?!\w)\s*+(?:RECURSIVE(?!\w))?(?:{_CTE},)*+{_CTE}(?!,)"


def _words(words: list[str]) -> str:
    return "(?:" + "|".join(words) + r")(?!\w)"


def visible_sql(c: Column) -> Column:
    """The text with literals and comments blanked out."""
    return F.regexp_replace(c, f"(?s){_BLANKED}", " ")


def _starts_with_cte(c: Column) -> Column:
    return c.rlike(r"(?i)^WITH(?!\w)")


def _depth(c: Column) -> Column:
    """How deep the parentheses of a text nest."""

    def step(state: Column, sign: Column) -> Column:
        moved = F.when(sign == "(", state["now"] + 1).otherwise(state["now"] - 1)
        now = F.greatest(moved, F.lit(0))
        return F.struct(now.alias("now"), F.greatest(state["top"], now).alias("top"))

    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("top"))
    signs = F.split(F.regexp_replace(c, r"[^()]++", ""), "")
    return F.aggregate(signs, start, step, lambda state: state["top"])


def _without_groups(c: Column) -> Column:
    """Every outermost parenthesised group as one mark.

    Each pass closes the innermost groups, so as many passes as the nesting is
    deep are enough, however many groups stand side by side.
    """
    return F.aggregate(
        F.sequence(F.lit(0), _depth(c)),
        c,
        lambda text, _: F.regexp_replace(text, r"\([^()]*+\)", _GROUP),
    )


def _main_clause(c: Column) -> Column:
    """What follows the CTE list, null where the list has an unknown form."""
    flat = _without_groups(c)
    rest = F.regexp_replace(flat, _CTE_LIST, "")
    return F.when(rest != flat, F.trim(F.regexp_replace(rest, r"\s", " ")))


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s++|\s++$", "")


def _reads(text: Column) -> Column:
    """A query that only reads, also when led by CTEs."""
    text = _trimmed(text)
    reads = rf"(?i)^{_words(READ_WORDS)}"
    after = F.when(_starts_with_cte(text), _main_clause(text))
    return F.when(
        _starts_with_cte(text), F.coalesce(after.rlike(reads), F.lit(True))
    ).otherwise(text.rlike(reads))


def _returns_rows(text: Column) -> Column:
    """A write that hands rows back."""
    return text.rlike(r"(?i)(^|[ \n\r\t])RETURNING([ \n\r\t]|$)")


def _removes(statement: Column) -> Column:
    """One statement, CTE list already gone, removes data or objects."""
    spaced = F.concat(
        F.lit(" "), F.upper(F.regexp_replace(statement, r"[\n\r\t]", " ")), F.lit(" ")
    )
    lead = F.regexp_extract(spaced, r"^[^\w]*+(\w++)", 1)
    return (
        F.when(lead.isin(REMOVAL_WORDS), True)
        .when(lead == "ALTER", spaced.contains(" DROP "))
        .when(lead == "MERGE", spaced.contains(" THEN DELETE "))
        .otherwise(False)
    )


def _destructive(text: Column) -> Column:
    """Any statement in the text deletes, drops or truncates."""
    led_line = text.rlike(rf"(?i)\n[ \t\r]*+{_words(REMOVAL_WORDS)}")

    def statement_removes(part: Column) -> Column:
        part = _trimmed(part)
        main = F.when(
            _starts_with_cte(part), F.coalesce(_main_clause(part), F.lit(""))
        ).otherwise(part)
        return _removes(main)

    return led_line | F.exists(F.split(text, ";"), statement_removes)


def _statement_count(text: Column) -> Column:
    """Statements in the text, empty ones not counted."""
    return F.size(F.filter(F.split(text, ";"), lambda part: _trimmed(part) != ""))


def classify(df: DataFrame, column: str) -> DataFrame:
    """Adds what the SQL text in ``column`` would do.

    The cleaned text is a projection of its own, so it is made once per row
    and not once per flag.
    """
    cleaned = df.withColumn("_visible", visible_sql(F.col(column)))
    text = F.col("_visible")
    flags = {
        "reads": _reads(text),
        "destructive": _destructive(text),
        "returns_rows": _returns_rows(text),
        "statements": _statement_count(text),
    }
    return cleaned.withColumns(flags).drop("_visible")
