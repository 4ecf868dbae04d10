"""Loading a dump folder back into tables."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.plans.copyjobs import expect_rows, per_table
from quayside.sources import dumps

MAX_STATEMENT_BYTES = 16 * 1024 * 1024

Save = Callable[[DataFrame, str, str], None]


def save_to_folder(folder: str, mode: str = "errorifexists") -> Save:
    """Tables as Parquet folders ``folder/database/table``."""

    def save(df: DataFrame, database: str, table: str) -> None:
        df.write.mode(mode).parquet(f"{folder}/{database}/{table}")

    return save


def save_to_catalog(mode: str = "errorifexists") -> Save:
    """Tables of the session catalog."""

    def save(df: DataFrame, database: str, table: str) -> None:
        df.write.mode(mode).saveAsTable(f"`{database}`.`{table}`")

    return save


def typed_column(name: str, kind: T.DataType) -> Column:
    """Dump text to the column's type; booleans are 0/1 and bytes hex there."""
    text = F.col(f"`{name}`")
    if isinstance(kind, T.BooleanType):
        value = F.when(text.isin("1", "true"), True).when(text.isin("0", "false"), False)
    elif isinstance(kind, T.BinaryType):
        value = F.unhex(F.regexp_extract(text, "^X'([0-9A-Fa-f]*)'$", 1))
    else:
        value = text.cast(kind)
    return value.alias(name)


def typed_rows(rows: DataFrame, schema: T.StructType) -> DataFrame:
    return rows.select(*[typed_column(f.name, f.dataType) for f in schema.fields])


def read_schemas(spark: SparkSession, folder: str) -> dict[str, T.StructType]:
    """Schemas of a dump folder by ``database.table``.

    Read on the driver: one line per table, whatever the tables hold.
    """
    lines = (
        spark.read.option("recursiveFileLookup", "true")
        .text(f"{folder}/*{dumps.SUFFIXES['schema']}")
        .where("value LIKE '-- schema: %'")
        .select(F.col("_metadata.file_path").alias("file"), F.substring("value", 12, 2**31 - 1).alias("schema"))
    )
    names = lines.select(F.regexp_extract("file", r"/([^/]+\.[^/]+)-schema\.sql", 1).alias("name"), "schema")
    return {r["name"]: T.StructType.fromJson(json.loads(r["schema"])) for r in names.collect()}


def check_statements(
    spark: SparkSession, folder: str, limit: int = MAX_STATEMENT_BYTES
) -> dict[str, int]:
    """Rows per ``database.table`` of an SQL dump, in one pass over its statements.

    Raises when a statement is larger than the target would take, or does not
    come apart into rows.
    """
    inserts = dumps.read_inserts(spark, f"{folder}/*.sql")
    names = dumps._named_parts(F.col("file"))
    named = inserts.withColumn("name", F.concat_ws(".", names["database"], names["table_name"]))
    sizes = named.groupBy("name").agg(
        F.sum(F.size("tuples")).alias("rows"),
        F.max(F.octet_length("statement")).alias("bytes"),
        F.count_if("broken").alias("broken"),
    )
    found = sizes.collect()
    biggest = max((r["bytes"] for r in found), default=0)
    if biggest > limit:
        raise ValueError(f"a statement of {biggest} bytes is larger than {limit} bytes")
    broken = sum(r["broken"] for r in found)
    if broken:
        raise ValueError(f"{broken} statements do not come apart into rows")
    return {r["name"]: r["rows"] for r in found}


def restore(
    spark: SparkSession,
    folder: str,
    save: Save,
    form: str = "sql",
    target_database: str | None = None,
    start: str | None = None,
    end: str | None = None,
    schema_only: bool = False,
    data_only: bool = False,
    max_statement_bytes: int = MAX_STATEMENT_BYTES,
    read_back: Callable[[str, str], DataFrame] | None = None,
    schemas: Mapping[str, T.StructType] | None = None,
    threads: int = 4,
) -> dict[str, int]:
    """Load every table of a dump in SQL, CSV or JSON form.

    Schemas are read from the files beside the data unless given, by
    ``database.table``, as a dump from elsewhere needs them.
    ``schema_only`` makes empty tables. ``data_only`` adds rows to tables that
    must be there, with a ``save`` that appends. With ``read_back`` the rows each
    table gained are counted and must equal the rows of the dump. Returns the
    rows loaded per table.
    """
    if schema_only and data_only:
        raise ValueError("schema only and data only exclude each other")
    if data_only and read_back is None:
        raise ValueError("data only needs a way to read the tables that are there")
    if start and end and end < start:
        raise ValueError(f"ending table {end!r} comes before starting table {start!r}")
    known = read_schemas(spark, folder) if schemas is None else schemas
    wanted = {
        name: schema
        for name, schema in sorted(known.items())
        if (not start or name.split(".", 1)[1] >= start)
        and (not end or name.split(".", 1)[1] <= end)
    }

    twice = {t for n in wanted if sum(m.split(".", 1)[1] == (t := n.split(".", 1)[1]) for m in wanted) > 1}
    if target_database and twice:
        raise ValueError(f"several databases hold {', '.join(sorted(twice))}; one target cannot take them")

    def load(name: str) -> int:
        database, table = name.split(".", 1)
        schema = wanted[name]
        target = target_database or database
        if schema_only:
            save(spark.createDataFrame([], schema), target, table)
            return 0
        # The load counts what it reads, so the dump is parsed once.
        seen = Observation()
        text = _text_rows(spark, folder, name, form, schema, max_statement_bytes)
        rows = typed_rows(text.observe(seen, F.count(F.lit(1)).alias("rows")), schema)
        before = read_back(target, table).count() if data_only else 0
        save(rows, target, table)
        if read_back is None:
            return 0
        return expect_rows(name, read_back(target, table).count() - before, seen.get["rows"])

    return per_table(spark, list(wanted), load, threads)


def _text_rows(
    spark: SparkSession, folder: str, name: str, form: str, schema: T.StructType, limit: int
) -> DataFrame:
    path = f"{folder}/{name}.{form}"
    columns = schema.names
    if form == "sql":
        # One folder of part files, or numbered files beside each other.
        inserts = dumps.read_inserts(spark, f"{folder}/{name}{{,.[0-9]*}}.sql")
        rows = dumps.insert_rows(dumps.whole_statements(inserts, limit))
        return dumps.dump_table(rows, name.split(".", 1)[1], columns)
    if form == "csv":
        text = ", ".join(f"`{c}` string" for c in columns)
        return dumps.read_csv_dump(spark, path, text)
    if form == "json":
        return dumps.read_json_dump(spark, path, columns)
    raise ValueError("form must be sql, csv or json")


def restored(spark: SparkSession, folder: str) -> Callable[[str, str], DataFrame]:
    """Reader for tables written by :func:`save_to_folder`."""
    return lambda database, table: spark.read.parquet(f"{folder}/{database}/{table}")
