"""Table scans and table listings."""

from __future__ import annotations

from collections.abc import Collection, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: names of tables an online schema change leaves behind. The range
# 0-f also admits the characters between the digits and the lower-case letters.
GHOST_TABLE = "_vt_([a-zA-Z0-9]{3})_([0-f]{32})_([0-9]{14})_"

# Schemas that hold no user tables.
MYSQL_SYSTEM = ["information_schema", "performance_schema", "mysql", "sys", "_vt"]
POSTGRES_SYSTEM = ["pg_catalog", "information_schema"]

# Migration tools and the tables they keep their history in.
BOOKKEEPING = [
    ("DRIZZLE_MIGRATIONS", "Drizzle", []),
    ("PRISMA_MIGRATIONS", "Prisma", ["_prisma_migrations"]),
    ("KNEX_MIGRATIONS", "Knex", ["knex_migrations", "knex_migrations_lock"]),
    ("SEQUELIZE_META", "Sequelize", ["sequelizemeta"]),
    ("RAILS_MIGRATIONS", "Rails ActiveRecord", ["schema_migrations", "ar_internal_metadata"]),
    ("FLYWAY_MIGRATIONS", "Flyway", ["flyway_schema_history"]),
    ("LIQUIBASE_MIGRATIONS", "Liquibase", ["databasechangelog", "databasechangeloglock"]),
    ("DJANGO_MIGRATIONS", "Django", ["django_migrations"]),
    ("ALEMBIC_VERSION", "Alembic", ["alembic_version"]),
    ("TYPEORM_METADATA", "TypeORM", ["typeorm_metadata"]),
    ("GOOSE_MIGRATIONS", "Goose", ["goose_db_version"]),
]
DRIZZLE_PREFIX = "__drizzle"


def scan(
    df: DataFrame,
    columns: Collection[str] = (),
    exclude: Collection[str] = (),
    replace: Mapping[str, str] | None = None,
    where: str | None = None,
) -> DataFrame:
    """A table cut to the wanted columns and rows.

    Generated columns are left out. ``replace`` puts an SQL expression under
    the name of a column. The filter sees the columns as they are stored, so it
    reaches the file scan together with the pruned column list.
    """
    replace = replace or {}
    names = [f.name for f in df.schema.fields if not f.metadata.get("generated")]
    kept = [c for c in names if (not columns or c in columns) and c not in exclude]
    if columns and not kept:
        raise ValueError(f"no valid columns among {sorted(columns)}; there are {names}")
    if where:
        df = df.where(where)
    return df.select(
        *[F.expr(replace[c]).alias(c) if c in replace else F.col(c) for c in kept]
    )


def parse_column_lists(spec: str) -> dict[str, list[str]]:
    """``table:a,b;other:c`` as column lists by table."""
    lists: dict[str, list[str]] = {}
    for part in filter(None, (p.strip() for p in spec.split(";"))):
        table, colon, names = part.partition(":")
        columns = [c.strip() for c in names.split(",") if c.strip()]
        if not colon or not table.strip() or not columns:
            raise ValueError(f"expected table:column,column but got {part!r}")
        lists.setdefault(table.strip(), []).extend(columns)
    return lists


def read_database(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 16,
    **options: str,
) -> DataFrame:
    """A table of a live database, read in ranges of a key by many tasks."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if partition_column and bounds:
        reader = reader.options(
            partitionColumn=partition_column,
            lowerBound=bounds[0],
            upperBound=bounds[1],
            numPartitions=partitions,
        )
    return reader.load()


def catalog_tables(spark: SparkSession, database: str) -> DataFrame:
    """The tables and views of a catalog database as a listing."""
    listed = spark.sql(f"SHOW TABLES IN {database}")
    views = spark.sql(f"SHOW VIEWS IN {database}").select(
        F.col("viewName").alias("tableName"), F.lit("VIEW").alias("table_type")
    )
    return listed.join(views, "tableName", "left").select(
        F.col("tableName").alias("table_name"),
        F.coalesce("table_type", F.lit("BASE TABLE")).alias("table_type"),
    )


def select_databases(
    listing: DataFrame,
    names: Collection[str] = (),
    pattern: str | None = None,
    invert: bool = False,
) -> DataFrame:
    """Rows of the wanted databases: a list of names, a pattern, its inverse, or all."""
    if names and pattern is not None:
        raise ValueError("give a list of databases or a pattern")
    if names:
        return listing.where(F.col("database").isin(*names))
    if pattern is None:
        return listing
    hit = F.col("database").rlike(pattern)
    return listing.where(~hit if invert else hit)


def select_tables(
    listing: DataFrame,
    names: Collection[str] = (),
    pattern: str | None = None,
    invert: bool = False,
) -> DataFrame:
    """Tables by name list or pattern; views are marked, ghost tables dropped."""
    kept = listing.where(~F.col("table_name").rlike(GHOST_TABLE))
    if names:
        kept = kept.where(F.col("table_name").isin(*names))
    if pattern is not None:
        hit = F.col("table_name").rlike(pattern)
        kept = kept.where(~hit if invert else hit)
    return kept.withColumn("is_view", F.col("table_type") == "VIEW")


def table_range(listing: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Tables from ``start`` to ``end``, both included."""
    if start and end and end < start:
        raise ValueError(f"ending table {end!r} comes before starting table {start!r}")
    if start:
        listing = listing.where(F.col("table_name") >= start)
    if end:
        listing = listing.where(F.col("table_name") <= end)
    return listing


def bookkeeping_code(name: Column) -> Column:
    """The code of the migration tool a table belongs to, null for user tables."""
    lowered = F.lower(name)
    code = F.when(lowered.startswith(DRIZZLE_PREFIX), BOOKKEEPING[0][0])
    for rule, _, tables in BOOKKEEPING[1:]:
        code = code.when(lowered.isin(*tables), rule)
    return code


def user_tables(listing: DataFrame) -> DataFrame:
    """The listing without migration bookkeeping."""
    return listing.where(bookkeeping_code(F.col("table_name")).isNull())


def user_schemas(df: DataFrame, column: str = "schema_name", postgres: bool = True) -> DataFrame:
    """Rows outside the system schemas."""
    name = F.col(column)
    if postgres:
        return df.where(~name.isin(*POSTGRES_SYSTEM) & ~name.rlike("^pg_toast"))
    return df.where(~name.isin(*MYSQL_SYSTEM))
