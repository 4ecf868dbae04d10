"""Writing tables as SQL, CSV and JSON dumps."""

from __future__ import annotations

import csv
import io
import json
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.functions.text import escape_literal, quote_identifier
from quayside.session import bounded_batches

STATEMENT_BYTES = 1_000_000
CHUNK_MB = 128


def sql_value(name: str, kind: T.DataType) -> Column:
    """A value as it stands in an INSERT: numbers bare, bytes in hex, the rest quoted."""
    value = F.col(f"`{name}`")
    if isinstance(kind, T.BooleanType):
        text = value.cast("int").cast("string")
    elif isinstance(kind, T.BinaryType):
        text = F.concat(F.lit("X'"), F.hex(value), F.lit("'"))
    elif isinstance(kind, T.NumericType):
        text = value.cast("string")
    elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        # Nothing in it needs an escape.
        text = F.concat(F.lit('"'), value.cast("string"), F.lit('"'))
    else:
        text = F.concat(F.lit('"'), escape_literal(value.cast("string")), F.lit('"'))
    return F.coalesce(text, F.lit("NULL"))


def row_text(df: DataFrame) -> DataFrame:
    """Every row as the text of one value tuple."""
    values = [sql_value(f.name, f.dataType) for f in df.schema.fields]
    return df.select(F.concat(F.lit("("), F.concat_ws(",", *values), F.lit(")")).alias("row"))


def packer(
    limit: int, between: str, head: str = "", tail: str = "", file_head: str = "", per_file: int = 1
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The packing of :func:`pack_rows`, as it goes on inside a task."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        size = made = 0

        def record() -> str:
            nonlocal held, size, made
            begin = file_head if made % per_file == 0 else ""
            text = begin + head + between.join(held) + tail
            held, size, made = [], 0, made + 1
            return text

        for batch in batches:
            texts = batch.column(0)
            upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
            cuts, before = [0], -size
            while (end := int(np.searchsorted(upto, limit + before)) + 1) <= len(texts):
                cuts.append(end)
                before = int(upto[end - 1])
            closed = len(cuts) - 1
            if cuts[-1] < len(texts):
                cuts.append(len(texts))
            pieces = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), texts), between).to_pylist()
            done = []
            for piece in pieces[:closed]:
                held.append(piece)
                done.append(record())
            if len(pieces) > closed:
                held.append(pieces[closed])
                size = int(upto[-1]) - before
            if done:
                yield pa.RecordBatch.from_pydict({"value": done})
        if held or (file_head and not made):
            yield pa.RecordBatch.from_pydict({"value": [record()]})

    return pack


def pack_rows(
    rows: DataFrame,
    limit: int,
    between: str,
    head: str = "",
    tail: str = "",
    file_head: str = "",
    per_file: int = 1,
) -> DataFrame:
    """Row texts packed into records, in each task on its own.

    A record is closed once its rows reach ``limit`` bytes. There is no order
    between tasks, hence no shuffle; what is left at the end of a task becomes a
    last, smaller record. Rows are cut and joined as Arrow arrays, not one by
    one. With ``file_head``, every ``per_file``-th record of a task begins with
    it, as does the only one of a task without rows.
    """
    bounded_batches(rows.sparkSession)
    pack = packer(limit, between, head, tail, file_head, per_file)
    return rows.mapInArrow(pack, "value string")


def pack_statements(
    rows: DataFrame, columns: list[str], table: str, statement_bytes: int = STATEMENT_BYTES
) -> DataFrame:
    """Row texts packed into INSERT statements of about ``statement_bytes``."""
    names = ",".join(quote_identifier(c) for c in columns)
    head = f"INSERT INTO {quote_identifier(table)}({names}) VALUES\n"
    return pack_rows(rows, statement_bytes, ",\n", head, ";")


def records_per_file(chunk_mb: int, record_bytes: int = STATEMENT_BYTES) -> int:
    return max(1, -(-chunk_mb * 1024 * 1024 // record_bytes))


def data_path(folder: str, database: str, table: str, form: str) -> str:
    return f"{folder}/{database}.{table}.{form}"


def write_sql(
    df: DataFrame,
    folder: str,
    database: str,
    table: str,
    statement_bytes: int = STATEMENT_BYTES,
    chunk_mb: int = CHUNK_MB,
) -> dict:
    """An SQL dump of one table: a folder of part files of bounded size.

    Returns its totals: rows, bytes of row text, the seconds it took and the rate.
    """
    started = time.time()
    seen = Observation(f"dump {table}")
    rows = row_text(df).observe(
        seen, F.count("*").alias("rows"), F.sum(F.octet_length("row")).alias("bytes")
    )
    statements = pack_statements(rows, df.columns, table, statement_bytes)
    statements.write.option("maxRecordsPerFile", records_per_file(chunk_mb, statement_bytes)).text(
        data_path(folder, database, table, "sql")
    )
    # The write is one stage without a shuffle, so no row is observed twice.
    totals = {"table": table, **seen.get, "seconds": time.time() - started}
    totals["mb_per_second"] = (totals["bytes"] or 0) / 1024 / 1024 / totals["seconds"]
    return totals


def csv_text(df: DataFrame) -> DataFrame:
    """Columns as the text a CSV dump holds."""
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])


def csv_lines(df: DataFrame, null_token: str = "") -> DataFrame:
    """One CSV line per row, which has line breaks where a value does."""
    options = {
        "quote": '"',
        "escape": '"',
        "nullValue": null_token,
        "emptyValue": '""' if null_token else "",
        "ignoreLeadingWhiteSpace": "false",
        "ignoreTrailingWhiteSpace": "false",
    }
    return csv_text(df).select(F.to_csv(F.struct("*"), options).alias("value"))


def csv_header(columns: list[str]) -> str:
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerow(columns)
    return out.getvalue()


def write_csv(
    df: DataFrame,
    folder: str,
    database: str,
    table: str,
    null_token: str = "",
    chunk_mb: int = CHUNK_MB,
    record_bytes: int = STATEMENT_BYTES,
) -> None:
    """A CSV dump in part files of about ``chunk_mb``, each with a header.

    Null and the empty string both become empty, unless ``null_token`` gives
    null a text of its own. Lines are made in the JVM and written in records of
    ``record_bytes``, which is how the size of a file is known without another
    pass over the table. A table whose plan is known to be empty runs no task
    and leaves a folder without a header.
    """
    lines = csv_lines(df, null_token)
    per_file = records_per_file(chunk_mb, record_bytes)
    packed = pack_rows(lines, record_bytes, "\n", file_head=csv_header(df.columns), per_file=per_file)
    packed.write.option("maxRecordsPerFile", per_file).text(data_path(folder, database, table, "csv"))


def json_lines(df: DataFrame, typed: bool = False) -> DataFrame:
    """One JSON object per row, nulls kept; values as text unless ``typed``."""
    source = df if typed else csv_text(df)
    return source.select(
        F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")
    )


def write_json(
    df: DataFrame,
    folder: str,
    database: str,
    table: str,
    typed: bool = False,
    chunk_mb: int = CHUNK_MB,
    record_bytes: int = STATEMENT_BYTES,
) -> None:
    """A JSON-lines dump in part files of about ``chunk_mb``."""
    packed = pack_rows(json_lines(df, typed), record_bytes, "\n")
    per_file = records_per_file(chunk_mb, record_bytes)
    packed.write.option("maxRecordsPerFile", per_file).text(data_path(folder, database, table, "json"))


def create_statement(table: str, schema: T.StructType) -> str:
    """The table's columns as a statement, and the exact schema as a comment."""
    columns = ",\n".join(
        f"  {quote_identifier(f.name)} {f.dataType.simpleString().upper()}"
        + ("" if f.nullable else " NOT NULL")
        for f in schema.fields
    )
    exact = json.dumps(schema.jsonValue(), separators=(",", ":"))
    return f"-- schema: {exact}\nCREATE TABLE {quote_identifier(table)} (\n{columns}\n);"


def write_schema(df: DataFrame, folder: str, database: str, table: str, view: bool = False) -> None:
    """The schema beside the data, as one small file."""
    ending = "-schema-view.sql" if view else "-schema.sql"
    _write_text(df.sparkSession, create_statement(table, df.schema), f"{folder}/{database}.{table}{ending}")


def _write_text(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)


def write_database(spark: SparkSession, folder: str, database: str) -> None:
    """The statement that creates a dumped database, beside its tables."""
    text = f"CREATE DATABASE IF NOT EXISTS {quote_identifier(database)};"
    _write_text(spark, text, f"{folder}/{database}-schema-create.sql")


def write_marker(spark: SparkSession, folder: str) -> None:
    """The empty ``metadata`` entry that tells a dump folder from others."""
    _write_text(spark, "", f"{folder}/metadata")


def dump_totals(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and bytes each table takes in an SQL dump, as one job."""
    from quayside.operators.diff import union_all

    return union_all(
        [
            row_text(df)
            .agg(F.count("*").alias("rows"), F.sum(F.octet_length("row")).alias("bytes"))
            .select(F.lit(name).alias("table_name"), "rows", F.coalesce("bytes", F.lit(0)).cast("bigint").alias("bytes"))
            for name, df in tables.items()
        ]
    )
