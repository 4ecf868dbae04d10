"""Queries on untyped tables: inferred types, findings, rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from quayside.functions import text
from quayside.operators import infer
from quayside.operators.infer import TextColumn
from quayside.plans.registry import query

_CUSTOMER = [
    TextColumn("id", "INTEGER", primary_key=True, autoincrement=True),
    TextColumn("name", "VARCHAR(40)"),
    TextColumn("active", "INTEGER"),
    TextColumn("nation_id", "INTEGER", foreign_key=True),
    TextColumn("is_vip", "INT"),
    TextColumn("archived", "INTEGER"),
    TextColumn("created_at"),
    TextColumn("due_date"),
    TextColumn("metadata"),
    TextColumn("payload"),
    TextColumn("ref_uuid"),
    TextColumn("odd_uuid", "CHAR(36)"),
    TextColumn("MktSegment"),
    TextColumn("empty_at"),
]
_TYPES = """
SELECT * FROM (VALUES ('raw_customer', 'id', 'INTEGER', 'bigint'), ('raw_customer', 'name', 'VARCHAR(40)', 'string'),
 ('raw_customer', 'active', 'INTEGER', 'boolean'), ('raw_customer', 'nation_id', 'INTEGER', 'bigint'),
 ('raw_customer', 'is_vip', 'INT', 'boolean'),
 ('raw_customer', 'archived', 'INTEGER', (SELECT CASE WHEN count(*) FILTER (archived NOT IN ('0', '1')) > 0 THEN 'bigint' ELSE 'boolean' END FROM raw_customer)),
 ('raw_customer', 'created_at', 'TEXT', (SELECT CASE WHEN count(*) FILTER (NOT regexp_matches(created_at, '^\\d{4}-\\d\\d-\\d\\d[ T]\\d\\d:\\d\\d:\\d\\dZ?$')) = 0 THEN 'timestamp' ELSE 'string' END FROM raw_customer)),
 ('raw_customer', 'due_date', 'TEXT', (SELECT CASE WHEN count(*) FILTER (due_date = 'soon') = 0 THEN 'timestamp' ELSE 'string' END FROM raw_customer)),
 ('raw_customer', 'metadata', 'TEXT', (SELECT CASE WHEN count(*) FILTER (metadata <> '' AND NOT json_valid(metadata)) = 0 THEN 'variant' ELSE 'string' END FROM raw_customer)),
 ('raw_customer', 'payload', 'TEXT', (SELECT CASE WHEN count(*) FILTER (NOT json_valid(payload)) = 0 THEN 'variant' ELSE 'string' END FROM raw_customer)),
 ('raw_customer', 'ref_uuid', 'TEXT', 'uuid'), ('raw_customer', 'odd_uuid', 'CHAR(36)', 'string'),
 ('raw_customer', 'MktSegment', 'TEXT', 'string'), ('raw_customer', 'empty_at', 'TEXT', 'string')) t(table_name, column_name, declared, type)
"""


def _profile(raw):
    return infer.profile(raw, "raw_customer", _CUSTOMER)


@query("y1_infer_types", ["raw_customer"], _TYPES)
def _(raw):
    return infer.infer_types(_profile(raw))


_NUMBERS = [TextColumn("id", "INTEGER")] + [TextColumn(c, "NUMERIC") for c in ("wide", "fine", "beyond", "price", "mixed")]


@query(
    "y1_unsized_numerics",
    ["raw_numbers"],
    """
WITH p AS (
  SELECT column_name, max(strlen(regexp_extract(v, '^[+-]?0*([0-9]*)', 1))) AS digits, max(strlen(regexp_extract(v, '[.]([0-9]*?)0*$', 1))) AS places,
         bool_and(regexp_full_match(v, '[+-]?[0-9]+([.][0-9]*)?')) AS plain
  FROM (UNPIVOT (SELECT wide, fine, beyond, price, mixed FROM raw_numbers) ON wide, fine, beyond, price, mixed INTO NAME column_name VALUE v)
  GROUP BY 1)
SELECT column_name, CASE WHEN plain AND digits + places <= 38 THEN 'decimal(' || (digits + places) || ',' || places || ')' ELSE 'string' END AS type FROM p
""",
)
def _(raw):
    types = infer.infer_types(infer.profile(raw, "raw_numbers", _NUMBERS))
    return types.where("declared = 'NUMERIC'").select("column_name", "type")


@query(
    "y5_unsized_numerics",
    ["raw_numbers"],
    """
SELECT CAST(id AS BIGINT) AS id, CAST(CAST(wide AS DECIMAL(30,0)) AS STRING) AS wide, fine,
       beyond, CAST(CAST(price AS DECIMAL(5,2)) AS STRING) AS price, mixed FROM raw_numbers
""",
)
def _(raw):
    """Every digit arrives: the types come from the values, as a load would take them."""
    types = infer.type_map(infer.infer_types(infer.profile(raw, "raw_numbers", _NUMBERS)))
    typed = infer.typed_load(raw, types)
    return typed.select(*[F.col(c).cast("bigint" if c == "id" else "string").alias(c) for c in types])


@query(
    "y1_profile",
    ["raw_customer"],
    """
SELECT 'archived' AS column_name, count(archived) AS present, CAST(NULL AS BIGINT) AS not_uuid, count(*) FILTER (archived = '2') AS not_flag,
       CAST(NULL AS BIGINT) AS not_json, CAST(NULL AS BIGINT) AS not_timestamp FROM raw_customer
UNION ALL SELECT 'payload', count(payload), NULL, NULL, count(*) FILTER (payload = 'oops'), NULL FROM raw_customer
UNION ALL SELECT 'due_date', count(due_date), NULL, NULL, NULL, count(*) FILTER (due_date = 'soon') FROM raw_customer
UNION ALL SELECT 'odd_uuid', count(odd_uuid), count(*), NULL, NULL, NULL FROM raw_customer
UNION ALL SELECT 'empty_at', 0, NULL, NULL, NULL, 0
""",
)
def _(raw):
    shown = ["archived", "payload", "due_date", "odd_uuid", "empty_at"]
    return _profile(raw).where(F.col("column_name").isin(shown)).select(
        "column_name", "present", *[f"not_{k}" for k in infer.TESTS]
    )


_FOUND = """
WITH found AS (SELECT * FROM (VALUES
 ('id', 'AUTOINCREMENT', 'warning'), ('id', 'BOOLEAN_AS_INTEGER', 'x'), ('active', 'BOOLEAN_AS_INTEGER', 'warning'),
 ('is_vip', 'BOOLEAN_AS_INTEGER', 'warning'), ('archived', 'BOOLEAN_NAME_MISMATCH', 'info'),
 ('created_at', 'TEXT_TIMESTAMP', 'warning'), ('due_date', 'TEXT_TIMESTAMP', 'info'), ('empty_at', 'TEXT_TIMESTAMP', 'info'),
 ('metadata', 'JSON_IN_TEXT', 'info'), ('payload', 'JSON_IN_TEXT', 'info'), ('ref_uuid', 'TEXT_UUID', 'info'),
 ('odd_uuid', 'TEXT_UUID', 'info'), ('MktSegment', 'MIXED_CASE_IDENTIFIER', 'warning')) t(column_name, code, severity)
 WHERE severity <> 'x' AND (SELECT count(*) FROM raw_customer WHERE archived = '2' AND payload <> 'x') > 0)
"""


@query(
    "y3_column_findings",
    ["raw_customer"],
    _FOUND + "SELECT 'raw_customer' AS table_name, column_name, code, severity FROM found",
)
def _(raw):
    return infer.column_findings(_profile(raw)).select("table_name", "column_name", "code", "severity")


@query(
    "y3_table_findings",
    ["table_names"],
    """
WITH b AS (SELECT table_name, lower(table_name) AS n FROM table_names)
SELECT table_name, 'IDENTIFIER_TOO_LONG' AS code, 'error' AS severity FROM b WHERE strlen(table_name) > 63
UNION ALL SELECT table_name, 'MIXED_CASE_IDENTIFIER', 'warning' FROM b WHERE table_name <> n AND table_name <> upper(table_name)
UNION ALL SELECT table_name, CASE n WHEN '__drizzle_migrations' THEN 'DRIZZLE_MIGRATIONS' WHEN '_prisma_migrations' THEN 'PRISMA_MIGRATIONS'
  WHEN 'knex_migrations_lock' THEN 'KNEX_MIGRATIONS' WHEN 'sequelizemeta' THEN 'SEQUELIZE_META' WHEN 'schema_migrations' THEN 'RAILS_MIGRATIONS'
  WHEN 'flyway_schema_history' THEN 'FLYWAY_MIGRATIONS' WHEN 'databasechangelog' THEN 'LIQUIBASE_MIGRATIONS'
  WHEN 'django_migrations' THEN 'DJANGO_MIGRATIONS' WHEN 'alembic_version' THEN 'ALEMBIC_VERSION'
  WHEN 'typeorm_metadata' THEN 'TYPEORM_METADATA' ELSE 'GOOSE_MIGRATIONS' END, 'info'
FROM b WHERE n IN ('__drizzle_migrations', '_prisma_migrations', 'knex_migrations_lock', 'sequelizemeta', 'schema_migrations',
  'flyway_schema_history', 'databasechangelog', 'django_migrations', 'alembic_version', 'typeorm_metadata', 'goose_db_version')
""",
)
def _(names):
    return infer.table_findings(names).select("table_name", "code", "severity")


_NAMED = """
WITH f AS (SELECT table_name, 'IDENTIFIER_TOO_LONG' AS code, 'error' AS severity, 0 AS rank FROM table_names WHERE strlen(table_name) > 63
UNION ALL SELECT table_name, 'MIXED_CASE_IDENTIFIER', 'warning', 1 FROM table_names WHERE table_name <> lower(table_name))
"""


@query(
    "a12_group_findings",
    ["table_names"],
    _NAMED
    + "SELECT severity, code, table_name AS location, count(*) OVER (PARTITION BY code) AS locations, rank FROM f",
)
def _(names):
    found = infer.table_findings(names).where("severity <> 'info'")
    return infer.group_findings(found).drop("remediation")


@query(
    "a13_severity_totals",
    ["table_names"],
    _NAMED
    + """SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings,
  (SELECT count(*) FROM table_names WHERE lower(table_name) IN ('__drizzle_migrations', '_prisma_migrations', 'knex_migrations_lock', 'sequelizemeta',
  'schema_migrations', 'flyway_schema_history', 'databasechangelog', 'django_migrations', 'alembic_version', 'typeorm_metadata', 'goose_db_version')) AS infos FROM f""",
)
def _(names):
    return infer.severity_totals(infer.table_findings(names))


@query(
    "a11_column_samples",
    ["raw_events"],
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, string_agg(v, '|' ORDER BY v) AS samples
FROM (SELECT DISTINCT {c} AS v FROM raw_events WHERE {c} IS NOT NULL ORDER BY 1 LIMIT 32)"""
        for c in ("id", "enabled", "kind", "user_id", "payload")
    ),
)
def _(raw):
    samples = infer.column_samples(raw, raw.columns)
    return samples.select("column_name", F.array_join("samples", "|").alias("samples"))


@query(
    "y4_expectations",
    ["raw_customer", "lineitem"],
    """
SELECT 'raw_customer' AS table_name, 'flag_known' AS rule, count(*) AS rows, CAST(0 AS BIGINT) AS violations, true AS passed FROM raw_customer
UNION ALL SELECT 'raw_customer', 'vip_is_active', count(*), count(*) FILTER (is_vip = '1' AND active = '0'), count(*) FILTER (is_vip = '1' AND active = '0') = 0 FROM raw_customer
UNION ALL SELECT 'lineitem', 'small_discount', count(*), count(*) FILTER (l_discount > 0.08), count(*) FILTER (l_discount > 0.08) = 0 FROM lineitem
UNION ALL SELECT 'lineitem', 'known_status', count(*), CAST(0 AS BIGINT), true FROM lineitem
""",
)
def _(raw, lineitem):
    typed = infer.typed_load(raw, {"active": "boolean", "is_vip": "boolean"})
    rules = {"flag_known": "active IN (0, 1)", "vip_is_active": "NOT (is_vip = 1 AND active = 0)"}
    first = infer.expectations(typed, "raw_customer", rules, flags=["active", "is_vip"])
    rules = {"small_discount": "l_discount <= 0.08D", "known_status": "l_linestatus IN ('F', 'O')"}
    return first.unionByName(infer.expectations(lineitem, "lineitem", rules))


_LOADED = {"id": "bigint", "active": "boolean", "is_vip": "boolean", "created_at": "timestamp", "due_date": "timestamp", "ref_uuid": "uuid", "payload": "variant"}


@query(
    "y5_typed_load",
    ["raw_customer"],
    """
SELECT CAST(id AS BIGINT) AS id, active = '1' AS active, is_vip = '1' AS is_vip,
       CAST(replace(replace(created_at, 'T', ' '), 'Z', '') AS TIMESTAMP) AS created_at, ref_uuid, name AS segment_of
FROM raw_customer
""",
)
def _(raw):
    # Types come from the inference itself, as a load would take them.
    types = infer.type_map(infer.infer_types(_profile(raw)))
    typed = infer.typed_load(raw, types)
    return typed.select(
        "id", "active", "is_vip", F.col("created_at").cast("timestamp_ntz").alias("created_at"),
        "ref_uuid", F.col("name").alias("segment_of"),
    )


@query(
    "y5_rejected_values",
    ["raw_customer"],
    """
SELECT 'raw_customer' AS table_name, * FROM (VALUES ('id', 'bigint', CAST(0 AS BIGINT)), ('active', 'boolean', 0), ('is_vip', 'boolean', 0), ('created_at', 'timestamp', 0),
 ('due_date', 'timestamp', (SELECT count(*) FROM raw_customer WHERE due_date = 'soon')), ('ref_uuid', 'uuid', 0),
 ('payload', 'variant', (SELECT count(*) FROM raw_customer WHERE payload = 'oops'))) t(column_name, type, rejected)
""",
)
def _(raw):
    return infer.rejected_values(raw, "raw_customer", _LOADED)


@query(
    "f26_identifiers",
    ["table_names"],
    """
SELECT server, strlen(table_name) > 63 AS too_long, regexp_matches(table_name, '[A-Z]') AND regexp_matches(table_name, '[a-z]') AS mixed FROM table_names
""",
)
def _(names):
    name = F.col("table_name")
    return names.select(
        "server", text.identifier_too_long(name).alias("too_long"), text.identifier_mixed_case(name).alias("mixed")
    )
