"""Reading SQL, CSV and JSON dumps back into rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.functions.text import strip, unescape_literal
from quayside.sources.quoted import read_quoted
from quayside.sources.statements import read_statements

# A literal and a balanced group inside a value list. MySQL literals know
# backslash escapes, SQLite ones only doubled quotes. Possessive loops keep
# megabyte-long statements off the matcher's stack.
_LITERALS = {
    "mysql": r"'(?:[^'\\]++|\\.|'')*+'" + r'|"(?:[^"\\]++|\\.|"")*+"',
    "sqlite": r"'(?:[^']++|'')*+'" + r'|"(?:[^"]++|"")*+"',
}
_NAME = r"`([^`]+)`" + r'|"([^"]+)"' + r"|'([^']+)'|([a-zA-Z_]\w*)"
_HEAD = rf"(?is)^INSERT\s+INTO\s+(?:{_NAME})\s*+(?:\(([^()]*+)\)\s*+)?VALUES\s*+"

# The file-name endings of a dump folder.
SUFFIXES = {
    "database": "-schema-create.sql",
    "schema": "-schema.sql",
    "view": "-schema-view.sql",
    "data": ".sql",
}


def _tuple_patterns(dialect: str) -> tuple[str, str]:
    literal = _LITERALS[dialect]
    inner = rf"(?:[^()'\"]++|{literal}|\((?:[^()'\"]++|{literal}|\([^()]*+\))*+\))*+"
    value = rf"(?:[^,()'\"]++|{literal}|\((?:[^()'\"]++|{literal}|\([^()]*+\))*+\))*+"
    return rf"(?s)\(({inner})\)", rf"(?s)(?:^|,)({value})"


def _unquoted(c: Column) -> Column:
    """A trimmed token without its quotes; NULL and nothing become null."""
    inner = F.substring(c, F.lit(2), F.length(c) - 2)
    return (
        F.when(c.startswith("'"), F.replace(inner, F.lit("''"), F.lit("'")))
        .when(c.startswith('"'), F.replace(inner, F.lit('""'), F.lit('"')))
        .when(~F.upper(c).isin("NULL", ""), c)
    )


def _unescaped(c: Column, dialect: str) -> Column:
    if dialect != "mysql":
        return c
    return F.when(c.contains("\\"), unescape_literal(c)).otherwise(c)


def decode_tokens(df: DataFrame, columns: Sequence[str], dialect: str) -> DataFrame:
    """Written tokens as the text they stand for.

    One projection per step: each step uses its input several times, and as a
    column of its own it is computed once.
    """

    def step(df: DataFrame, fn: Callable[[Column], Column]) -> DataFrame:
        return df.select(*[fn(F.col(f"`{c}`")).alias(c) for c in columns])

    return step(step(step(df, strip), _unquoted), lambda c: _unescaped(c, dialect))


def read_inserts(
    spark: SparkSession, paths: str | Sequence[str], dialect: str = "mysql"
) -> DataFrame:
    """INSERT statements with their value lists, still one row per statement.

    ``broken`` marks those whose value list does not come apart cleanly, and
    text that an open literal runs through to the end of its file. They go to
    :func:`quarantined`; reading them into a table is an error.
    """
    tuples, _ = _tuple_patterns(dialect)
    inserts = read_statements(spark, paths, dialect).where(
        F.col("statement").rlike(r"(?is)^INSERT\s") | ~F.col("ended")
    )
    table = F.coalesce(
        *[
            F.nullif(F.regexp_extract("statement", _HEAD, n), F.lit(""))
            for n in range(1, 5)
        ]
    )
    names = F.transform(
        F.split(F.regexp_extract("statement", _HEAD, 5), ","),
        lambda c: F.regexp_replace(strip(c), "[`\"']", ""),
    )
    body = F.regexp_replace("statement", _HEAD, "")
    split = inserts.select(
        "file",
        F.when(F.col("statement").rlike(_HEAD), table).alias("table_name"),
        F.when(names[0] != "", names).alias("columns"),
        "statement",
        "ended",
        body.alias("body"),
    )
    rest = F.regexp_replace("body", tuples, "")
    return split.select(
        "file",
        "table_name",
        "columns",
        "statement",
        F.regexp_extract_all("body", F.lit(tuples), 1).alias("tuples"),
        (F.col("table_name").isNull() | ~F.col("ended") | ~rest.rlike(r"^[\s,]*$")).alias("broken"),
    )


def whole_statements(inserts: DataFrame, limit: int | None = None) -> DataFrame:
    """The statements as they are; the job fails at one that is broken.

    With ``limit`` it also fails at one of more bytes.
    """
    bytes_ = F.octet_length("statement")
    said = F.concat(F.lit("a statement does not come apart into rows: "), F.col("file"), F.lit(": "), F.left("statement", F.lit(200)))
    checked = F.when(F.col("broken"), F.raise_error(said).cast("boolean"))
    if limit is not None:
        large = F.format_string(f"a statement of %d bytes is larger than {limit} bytes", bytes_)
        checked = checked.when(bytes_ > limit, F.raise_error(large).cast("boolean"))
    return inserts.where(checked.otherwise(True))


def read_sql_dump(
    spark: SparkSession, paths: str | Sequence[str], dialect: str = "mysql", skip_broken: bool = False
) -> DataFrame:
    """Rows of a dump: table, place in the statement, column list and tokens.

    ``tokens`` are the values as they are written; :func:`dump_table` decodes
    those that are wanted. A statement that does not come apart fails the job,
    unless they are to be skipped because :func:`quarantined` takes them.
    """
    inserts = read_inserts(spark, paths, dialect)
    return insert_rows(inserts.where("NOT broken") if skip_broken else whole_statements(inserts), dialect)


def insert_rows(inserts: DataFrame, dialect: str = "mysql") -> DataFrame:
    """The rows of statements that come apart."""
    _, value = _tuple_patterns(dialect)
    rows = (
        inserts
        .select("file", "table_name", "columns", F.posexplode("tuples").alias("row_ordinal", "row"))
    )
    return rows.select(
        "file", "table_name", "row_ordinal", "columns",
        F.regexp_extract_all("row", F.lit(value), 1).alias("tokens"),
    )


def quarantined(inserts: DataFrame) -> DataFrame:
    """Statements that could not be taken apart, with their size."""
    return inserts.where("broken").select(
        "file", "table_name", F.octet_length("statement").alias("bytes"), "statement"
    )


def statement_rows(inserts: DataFrame) -> DataFrame:
    """Rows per table; a statement that cannot be taken apart counts as one."""
    rows = F.when(F.col("broken"), 1).otherwise(F.greatest(F.size("tuples"), F.lit(1)))
    return inserts.groupBy("table_name").agg(F.sum(rows).alias("rows"))


def dump_table(
    rows: DataFrame, table: str, columns: Sequence[str], dialect: str = "mysql"
) -> DataFrame:
    """The text columns of one table, by name where the dump lists names."""
    found = []
    for i, name in enumerate(columns):
        at = F.when(F.col("columns").isNull(), F.lit(i)).otherwise(
            F.array_position("columns", name).cast("int") - 1
        )
        found.append(F.when(at >= 0, F.get("tokens", at)).alias(name))
    tokens = rows.where(F.col("table_name") == table).select(*found)
    return decode_tokens(tokens, columns, dialect)


def _named_parts(path: Column) -> dict[str, Column]:
    """Kind, database, table and part from the path of a dump file.

    Data of a table is either one file per part, ``db.table.00001.sql``, or a
    folder ``db.table.sql`` of part files.
    """
    kind = F.when(path.contains(SUFFIXES["database"]), "database")
    for name in ("schema", "view", "data"):
        kind = kind.when(path.contains(SUFFIXES[name]), name)
    file = r"/([^/.]+)\.([^/.]+?)(?:-schema|-schema-view)?(?:\.(\d+))?\.sql(?:/part-(\d+)[^/]*)?$"
    part = F.concat(F.regexp_extract(path, file, 3), F.regexp_extract(path, file, 4))
    created = F.regexp_extract(path, r"/([^/.]+)-schema-create\.sql", 1)
    return {
        "kind": kind,
        "database": F.when(created != "", created).otherwise(F.regexp_extract(path, file, 1)),
        "table_name": F.regexp_extract(path, file, 2),
        "part": F.nullif(part, F.lit("")).cast("int"),
    }


def list_dump(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a dump folder, told apart by name; nothing is read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(folder)
        .select("path", F.col("length").alias("bytes"))
    )
    named = files.withColumns(_named_parts(F.col("path")))
    return named.where("kind IS NOT NULL")


def read_dump_dir(
    spark: SparkSession,
    folder: str,
    start: str | None = None,
    end: str | None = None,
    dialect: str = "mysql",
) -> DataFrame:
    """Rows of all data files of a folder, from table ``start`` to ``end``."""
    from quayside.sources.tables import table_range

    rows = read_sql_dump(spark, f"{folder}/*.sql", dialect)
    names = _named_parts(F.col("file"))
    named = rows.withColumn("kind", names["kind"]).where("kind = 'data'")
    named = named.select(
        names["database"].alias("database"), "table_name", names["part"].alias("part"),
        "row_ordinal", "columns", "tokens",
    )
    return table_range(named, start, end)


def read_csv_dump(spark: SparkSession, path: str, schema: str, null_token: str = "") -> DataFrame:
    """A CSV dump with header; without a null token, empty means null.

    Files of any size split between tasks, see :func:`read_quoted`.
    """
    options = {"emptyValue": ""} if null_token else {}
    return read_quoted(spark, path, schema, nullValue=null_token, **options)


def read_json_dump(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A JSON-lines dump as text columns."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.json(path, schema=schema)
