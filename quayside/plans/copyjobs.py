"""Copying many tables: materialized queries, moves, lookups, resumable loads."""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable, Collection, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.sources.tables import bookkeeping_code, user_tables

THREADS = 16
STATUS_SCHEMA = "table_name string, phase string, rows bigint, finished_at timestamp"


class CopyError(RuntimeError):
    """A copy that did not do what it should have."""


def per_table(
    spark: SparkSession, names: Sequence[str], job: Callable[[str], int], threads: int = THREADS
) -> dict[str, int]:
    """Run one job per table, a few at a time, and fail if any fails.

    Each job splits its own table between executors; the threads only overlap
    the small ones.
    """
    with ThreadPoolExecutor(max_workers=max(1, min(threads, len(names) or 1))) as pool:
        # Job groups and scheduler pools set by the caller reach the threads.
        futures = {n: pool.submit(inheritable_thread_target(spark)(job), n) for n in names}
        return {n: f.result() for n, f in futures.items()}


def expect_rows(table: str, copied: int, expected: int) -> int:
    """The gate after a copy: as many rows as there were, or an error."""
    if copied != expected:
        raise CopyError(f"copied {copied} rows of {table}, expected {expected}")
    return copied


def materialize_queries(
    spark: SparkSession, settings: Mapping[str, str], save: Callable[[DataFrame, str], None], threads: int = THREADS
) -> None:
    """Each target table from its source expression, an SQL query."""

    def job(target: str) -> int:
        save(spark.sql(settings[target]), target)
        return 0

    per_table(spark, list(settings), job, threads)


def tables_to_move(
    listing: DataFrame,
    include: Collection[str] = (),
    exclude: Collection[str] = (),
    all_tables: bool = False,
) -> DataFrame:
    """The tables a move covers: a list, or all of them but some."""
    if bool(include) == all_tables:
        raise ValueError("give a list of tables or ask for all of them")
    if include:
        return listing.where(F.col("table_name").isin(*include))
    if exclude:
        return listing.where(~F.col("table_name").isin(*exclude))
    return listing


def tenant_rows(df: DataFrame, column: str | None = None, tenant: object = None) -> DataFrame:
    """Only one tenant's rows, or all of them."""
    return df if column is None else df.where(F.col(column) == F.lit(tenant))


def build_lookup(
    df: DataFrame,
    columns: Sequence[str],
    row_key: Sequence[str],
    ignore_nulls: bool = False,
    unique: bool = False,
) -> DataFrame:
    """The table from owner column values to the row key.

    A ``unique`` lookup is refused when a value has more than one row key.
    """
    rows = df.select(*columns, *[k for k in row_key if k not in columns])
    if ignore_nulls:
        rows = rows.dropna(how="any", subset=list(columns))
    lookup = rows.distinct()
    if unique:
        twice = ambiguous_lookups(lookup, columns).first()
        if twice:
            values = ", ".join(str(twice[c]) for c in columns)
            raise CopyError(f"{twice['row_keys']} row keys for {values} in a unique lookup")
    return lookup


def ambiguous_lookups(lookup: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values that a unique lookup must not have: more than one row key."""
    return lookup.groupBy(*columns).agg(F.count("*").alias("row_keys")).where("row_keys > 1")


def conflicting_tables(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """Tables a fresh load would write over."""
    return wanted.join(existing.select("table_name").distinct(), "table_name", "left_semi")


def tables_to_load(listing: DataFrame, status: DataFrame | None = None) -> DataFrame:
    """Tables still to load: no bookkeeping, and none loaded that has rows."""
    wanted = listing.where(bookkeeping_code(F.col("table_name")).isNull())
    if status is None:
        return wanted
    done = status.where("loaded AND dest_rows > 0").select("table_name").distinct()
    return wanted.join(done, "table_name", "left_anti")


class LoadStatus:
    """Which tables a load has finished, kept in a folder of status rows.

    Every row is a folder of its own, so tables that finish at the same time do
    not meet in one commit; the newest row of a table counts.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def record(self, table: str, phase: str, rows: int) -> None:
        now = datetime.datetime.now(datetime.timezone.utc)
        row = [(table, phase, rows, now)]
        self.spark.createDataFrame(row, STATUS_SCHEMA).coalesce(1).write.parquet(
            f"{self.folder}/{uuid.uuid4().hex}"
        )

    def read(self) -> DataFrame:
        empty = self.spark.createDataFrame([], STATUS_SCHEMA)
        try:
            rows = (
                self.spark.read.schema(STATUS_SCHEMA)
                .option("recursiveFileLookup", "true")
                .parquet(self.folder)
            )
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return empty
        newest = F.max_by(F.struct("phase", "rows", "finished_at"), "finished_at").alias("n")
        return rows.groupBy("table_name").agg(newest).select("table_name", "n.*")

    def finished(self) -> dict[str, int]:
        return {r["table_name"]: r["rows"] for r in self.read().where("phase = 'loaded'").collect()}


def resumable_load(
    sources: Mapping[str, DataFrame],
    status: LoadStatus,
    save: Callable[[DataFrame, str], None],
    read_back: Callable[[str], DataFrame | None],
    resume: bool = False,
    threads: int = 4,
) -> dict[str, int]:
    """Load many tables so that a stopped run can go on where it was.

    A fresh run refuses to write over tables that are there. A resumed one
    skips tables recorded as loaded that do hold rows. ``save`` must replace
    what a failed attempt left behind; every table passes the row gate before
    it is recorded.
    """
    listing = status.spark.createDataFrame([(n,) for n in sources], "table_name string")
    names = [r["table_name"] for r in user_tables(listing).collect()]

    def holds_rows(name: str) -> bool:
        there = read_back(name)
        return there is not None and bool(there.head(1))

    if resume:
        recorded = status.finished()
        names = [n for n in names if not (n in recorded and holds_rows(n))]
    else:
        present = [n for n in names if read_back(n) is not None]
        if present:
            raise CopyError(f"tables already there: {', '.join(sorted(present))}")

    def load(name: str) -> int:
        expected = sources[name].count()
        save(sources[name], name)
        rows = expect_rows(name, read_back(name).count(), expected)
        status.record(name, "loaded", rows)
        return rows

    return per_table(status.spark, names, load, threads)

