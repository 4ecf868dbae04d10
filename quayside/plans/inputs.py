"""Input frames of the named queries, derived from the given tables.

Each text is SQL that Spark and DuckDB both run, so a query and its check start
from the same rows. Names in braces are other inputs or given tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

GIVEN = [
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
]

DERIVED: dict[str, str] = {}

# A second copy of orders: some rows lost, some changed, some added.
DERIVED["orders_copy"] = """
SELECT o_orderkey, o_custkey, o_orderstatus,
       CASE WHEN o_orderkey % 89 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
       o_orderdate,
       CASE WHEN o_orderkey % 83 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority
FROM {orders} WHERE o_orderkey % 97 <> 0
UNION ALL
SELECT -o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
FROM {orders} WHERE o_orderkey % 101 = 0 AND o_orderkey > 0
"""

# A second copy of lineitem: now and then a changed row, a lost one, a doubled one, and keys only the copy has.
DERIVED["lineitem_copy"] = """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
       CASE WHEN l_orderkey % 499 = 17 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity,
       l_extendedprice, l_discount, l_tax, CASE WHEN l_orderkey % 887 = 3 THEN NULL ELSE l_returnflag END AS l_returnflag,
       l_linestatus, l_shipdate
FROM {lineitem} WHERE NOT (l_orderkey % 613 = 5 AND l_linenumber = 1)
UNION ALL
SELECT CASE WHEN l_orderkey % 709 = 8 THEN -l_orderkey ELSE l_orderkey END, l_partkey, l_suppkey, l_linenumber,
       l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate
FROM {lineitem} WHERE l_orderkey % 709 = 8 OR l_orderkey % 1201 = 2
"""

# One logged execution per event.
DERIVED["query_log"] = """
SELECT event_id, ts,
       event_type || '-' || CAST(user_id % 20 AS STRING) AS fingerprint,
       'ks' || CAST(user_id % 3 AS STRING) AS keyspace,
       'SELECT * FROM t' || CAST(user_id % 20 AS STRING) || ' /* ' || event_type || ' */' AS normalized_sql,
       't' || CAST(user_id % 20 AS STRING) || CASE WHEN event_id % 5 = 0 THEN 'b' ELSE 'a' END AS table_name,
       'ix' || CAST(event_id % 4 AS STRING) AS index_name,
       CAST(value AS DECIMAL(12,2)) AS latency_ms,
       event_type = 'error' AS is_error,
       CASE WHEN event_type = 'error' THEN 'E' || CAST(user_id % 7 AS STRING) END AS error_fingerprint,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS rows_read,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 7 AS rows_returned,
       CAST(event_id % 3 AS INT) AS rows_affected,
       CAST(value AS DECIMAL(12,2)) / 4 AS cpu_ms,
       CAST(value AS DECIMAL(12,2)) / 8 AS io_ms,
       CAST(event_id % 10 AS INT) AS cache_hits,
       CAST(event_id % 3 AS INT) AS cache_misses,
       CAST(1 + event_id % 2 AS INT) AS shards
FROM {events}
"""

# Sessions: 200 to a snapshot, on three instances.
DERIVED["sessions"] = """
SELECT 'fleet-' || CAST(CAST(floor(event_id / 200) AS BIGINT) % 3 AS STRING) AS source,
       CAST(floor(event_id / 200) AS BIGINT) AS snapshot,
       CAST(1000 + event_id % 200 AS INT) AS pid,
       'i' || CAST(event_id % 3 AS STRING) AS instance,
       'user' || CAST(user_id AS STRING) AS username,
       CASE event_type WHEN 'click' THEN 'active' WHEN 'view' THEN 'idle'
            WHEN 'purchase' THEN 'idle in transaction' WHEN 'signup' THEN 'Query/executing'
            ELSE '' END AS state,
       CASE WHEN event_id % 4 = 0 THEN 'Lock' WHEN event_id % 4 = 1 THEN 'IO' ELSE '' END AS wait_event_type,
       CASE WHEN event_id % 3 = 0 THEN 'transactionid' ELSE '' END AS wait_event,
       CASE WHEN event_type = 'view' THEN NULL ELSE ts END AS xact_start,
       CASE WHEN event_id % 6 = 5 THEN NULL ELSE ts END AS query_start,
       CAST(floor(value * 1000) AS BIGINT) AS duration_ms,
       CASE WHEN event_id % 5 = 0 THEN 'walsender' ELSE 'client backend' END AS backend_type,
       'SELECT ' || props || ' FROM t' || CAST(user_id AS STRING) AS query_text
FROM {events}
"""

# Who waits for whom: short trees, some diamonds, one cycle per snapshot.
DERIVED["session_edges"] = """
SELECT snapshot, pid, pid - 1 AS blocker_pid, 0 AS ord FROM {sessions} WHERE pid % 5 <> 0
UNION ALL
SELECT snapshot, pid, pid - 7 AS blocker_pid, 1 AS ord FROM {sessions} WHERE pid % 35 = 3 AND pid - 7 >= 1000
UNION ALL
SELECT snapshot, pid, 1009 AS blocker_pid, 0 AS ord FROM {sessions} WHERE pid = 1005
UNION ALL
SELECT snapshot, pid, 5000 + pid AS blocker_pid, 2 AS ord FROM {sessions} WHERE pid % 50 = 11
"""

# Instances of each snapshot; every seventh snapshot misses one of them.
DERIVED["instances"] = """
SELECT DISTINCT source, snapshot, instance,
       CASE instance WHEN 'i0' THEN 'primary' WHEN 'i1' THEN 'replica' ELSE '' END AS role,
       CASE WHEN instance = 'i2' AND snapshot % 7 = 0 THEN 'unreachable' ELSE '' END AS error
FROM {sessions}
"""

# Customers as an untyped dump would hold them.
DERIVED["raw_customer"] = """
SELECT CAST(c_custkey AS STRING) AS id,
       c_name AS name,
       CAST(c_custkey % 2 AS STRING) AS active,
       CAST(c_nationkey AS STRING) AS nation_id,
       CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST(c_custkey % 2 AS STRING) END AS is_vip,
       CASE WHEN c_custkey % 13 = 0 THEN '2' ELSE CAST(c_custkey % 2 AS STRING) END AS archived,
       '2024-0' || CAST(1 + c_custkey % 9 AS STRING) || '-1' || CAST(c_custkey % 10 AS STRING)
           || CASE WHEN c_custkey % 2 = 0 THEN ' 10:00:00' ELSE 'T11:30:00Z' END AS created_at,
       CASE WHEN c_custkey % 17 = 0 THEN 'soon' ELSE '2024-01-01' END AS due_date,
       CASE WHEN c_custkey % 5 = 0 THEN '' ELSE '[1, ' || CAST(c_custkey AS STRING) || ']' END AS metadata,
       CASE WHEN c_custkey % 19 = 0 THEN 'oops' ELSE '[' || CAST(c_custkey AS STRING) || ']' END AS payload,
       '550e8400-e29b-41d4-a716-4466' || CAST(10000000 + c_custkey AS STRING) AS ref_uuid,
       CAST(c_custkey AS STRING) AS odd_uuid,
       c_mktsegment AS "MktSegment",
       CAST(NULL AS STRING) AS empty_at
FROM {customer}
"""

# Numbers declared without a size: long integers, many places, both, prices, not all numbers.
DERIVED["raw_numbers"] = """
SELECT CAST(o_orderkey AS STRING) AS id,
       CASE WHEN o_orderkey % 7 = 0 THEN '-' ELSE '' END || '9' || lpad(CAST(o_orderkey AS STRING), 29, '0') AS wide,
       '0.' || lpad(CAST(o_orderkey AS STRING), 21, '0') || '5' AS fine,
       '8' || lpad(CAST(o_orderkey AS STRING), 19, '0') || '.' || lpad(CAST(o_orderkey AS STRING), 21, '0') || '5' AS beyond,
       '00' || CAST(o_orderkey % 1000 AS STRING) || '.' || lpad(CAST(o_custkey % 100 AS STRING), 2, '0') || '00' AS price,
       CASE WHEN o_orderkey % 101 = 0 THEN 'n/a' ELSE CAST(o_custkey AS STRING) END AS mixed
FROM {orders}
"""

DERIVED["raw_events"] = """
SELECT CAST(event_id AS STRING) AS id,
       CAST(event_id % 2 AS STRING) AS enabled,
       props AS payload,
       event_type AS kind,
       CAST(user_id AS STRING) AS user_id
FROM {events}
"""

# A logged text per document: the document in a literal or a comment.
DERIVED["statements"] = """
SELECT doc_id,
       CASE doc_id % 12
         WHEN 0 THEN 'SELECT ''' || body || ''' AS sample'
         WHEN 1 THEN 'DELETE FROM docs WHERE txt = ''' || body || ''''
         WHEN 2 THEN 'SELECT 1 -- DROP TABLE ' || body
         WHEN 3 THEN 'SELECT 1 /* ; TRUNCATE ' || body || ' */; SELECT 2'
         WHEN 4 THEN 'WITH c AS (SELECT (''' || body || ''')) DELETE FROM docs'
         WHEN 5 THEN 'WITH RECURSIVE c (x) AS MATERIALIZED (SELECT 1), d AS (SELECT '')'' ) SELECT * FROM d # ' || body
         WHEN 6 THEN '/*!50000 DROP TABLE docs */ -- ' || body
         WHEN 7 THEN 'ALTER TABLE docs DROP COLUMN txt -- ' || body
         WHEN 8 THEN 'MERGE INTO d USING s ON d.id = s.id WHEN MATCHED THEN DELETE'
         WHEN 9 THEN 'INSERT INTO docs VALUES (''' || body || ''') RETURNING id'
         WHEN 10 THEN 'UPDATE docs SET txt = ''' || body || ''''
         ELSE '-- ' || body || chr(10) || 'SHOW TABLES; SELECT delete_me FROM docs' END AS query
FROM (SELECT doc_id, replace(replace(replace(replace(replace(text, chr(92), ' '), '''', ''''''),
                     '*/', '* /'), chr(10), ' '), chr(13), ' ') AS body
      FROM {documents}) AS docs
"""

# Relations of a fleet of databases, one per part; groups of four share a root and lie in one database.
DERIVED["relations"] = """
SELECT 'db' || CAST(CAST(floor(p_partkey / 4) AS BIGINT) % 25 + 1 AS STRING) AS db,
       CAST(floor(p_partkey / 4) AS BIGINT) % 25 + 1 AS dbid, p_partkey AS relid,
       CASE WHEN p_type = 'PROMO' THEN p_partkey - p_partkey % 4 END AS root_id,
       CASE p_size % 6 WHEN 0 THEN 'pg_catalog' WHEN 1 THEN 'pg_toast_x' WHEN 2 THEN 'sales' ELSE 'public' END AS schema_name,
       't' || CAST(p_partkey AS STRING) AS rel_name,
       CASE WHEN p_type = 'PROMO' AND p_partkey % 4 = 0 THEN 'p' WHEN p_size % 7 = 0 THEN 'm' ELSE 'r' END AS kind,
       CAST(floor(p_retailprice * 1000) AS BIGINT) * p_size AS table_bytes,
       CAST(floor(p_retailprice * 10) AS BIGINT) * p_size AS data_free,
       CAST(p_size * 3 AS BIGINT) AS rel_pages,
       CAST(p_partkey * p_size - 1 AS BIGINT) AS rel_tuples,
       CAST(p_partkey % 977 AS BIGINT) AS seq_scans,
       CAST((p_partkey * 7) % 5003 AS BIGINT) AS dead_rows,
       CAST((p_partkey * 11) % 7001 AS BIGINT) AS mods_since_analyze,
       CASE p_size % 5 WHEN 0 THEN 'autovacuum_enabled=false'
            WHEN 1 THEN 'autovacuum_vacuum_threshold=10,autovacuum_vacuum_scale_factor=0.01'
            WHEN 2 THEN 'fillfactor=70,autovacuum_analyze_scale_factor=0.5' ELSE '' END AS options
FROM {part}
"""

# Indexes of those relations, from the line items of each part.
DERIVED["indexes"] = """
SELECT r.db, r.relid, r.schema_name, r.rel_name, r.kind AS table_kind,
       'ix_' || CAST(l.l_orderkey AS STRING) || '_' || CAST(l.l_linenumber AS STRING) || '_' || CAST(l.l_suppkey AS STRING)
           || '_' || CAST(CAST(floor(l.l_extendedprice) AS BIGINT) AS STRING) AS index_name,
       CASE l.l_linenumber WHEN 1 THEN 'a' WHEN 2 THEN 'a,b' WHEN 3 THEN 'a,b,c' WHEN 4 THEN 'b' WHEN 5 THEN 'b,c' ELSE 'd' END AS columns,
       CAST(floor(l.l_extendedprice) AS BIGINT) * 100 AS index_bytes,
       CAST(floor(l.l_quantity) AS BIGINT) * 8 AS index_pages,
       CAST(floor(l.l_quantity) AS BIGINT) * 500 AS index_tuples,
       CAST(l.l_orderkey % 200 AS BIGINT) AS scans,
       l.l_returnflag = 'R' AS is_unique,
       l.l_linenumber = 7 AS is_primary,
       l.l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AS is_valid,
       l.l_linestatus = 'O' AS is_ready
FROM {lineitem} l JOIN {relations} r ON r.relid = l.l_partkey
"""

# What MySQL servers say of their tables, and of their indexes.
DERIVED["mysql_tables"] = """
SELECT db, CASE schema_name WHEN 'pg_catalog' THEN 'mysql' WHEN 'pg_toast_x' THEN 'sys' ELSE schema_name END AS schema_name,
       rel_name AS table_name, CASE kind WHEN 'm' THEN 'VIEW' ELSE 'BASE TABLE' END AS table_type,
       table_bytes AS data_bytes, data_free AS index_bytes, rel_tuples AS table_rows,
       seq_scans * rel_pages AS rows_full_scanned, dead_rows AS latency_ms
FROM {relations}
"""
DERIVED["mysql_indexes"] = """
SELECT db, CASE schema_name WHEN 'pg_catalog' THEN 'mysql' WHEN 'pg_toast_x' THEN '_vt' ELSE schema_name END AS schema_name,
       rel_name AS table_name, CASE WHEN is_primary THEN 'PRIMARY' ELSE index_name END AS index_name,
       CASE WHEN is_ready THEN 'size' ELSE 'n_leaf_pages' END AS stat_name,
       index_bytes * 10 + index_pages AS stat_value, scans AS uses
FROM {indexes}
"""

# Column statistics: four columns to a relation.
DERIVED["column_stats"] = " UNION ALL ".join(
    f"""
SELECT db, relid, schema_name, rel_name, {n} AS col_no,
       CAST((relid + {n}) % 4 AS DOUBLE) / 4 AS null_frac,
       CAST(4 + (relid * {n}) % 60 AS BIGINT) AS avg_width
FROM {{relations}}"""
    for n in (1, 2, 3, 4)
)

# Replication slots and walsenders from suppliers.
DERIVED["slots"] = """
SELECT 'db' || CAST(s_nationkey AS STRING) AS db,
       'slot_' || CAST(s_suppkey AS STRING) AS slot_name,
       CASE WHEN s_suppkey % 2 = 0 THEN 'logical' ELSE 'physical' END AS slot_type,
       s_suppkey % 3 <> 0 AS active,
       CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey END AS active_pid,
       s_suppkey * 4096 + 100000000 AS current_lsn,
       CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_suppkey * 1024 END AS restart_lsn,
       s_suppkey * 2048 AS confirmed_lsn,
       CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE CAST(floor(s_acctbal) AS BIGINT) * 1000000 END AS safe_bytes
FROM {supplier}
"""

DERIVED["walsenders"] = """
SELECT 'db' || CAST(s_nationkey AS STRING) AS db, s_suppkey AS pid, 'streaming' AS state,
       s_suppkey % 60 AS replay_lag_s
FROM {supplier} WHERE s_suppkey % 2 = 1
"""

DERIVED["subscriptions"] = """
SELECT 'db' || CAST(s_nationkey AS STRING) AS db, 'sub_' || CAST(s_suppkey % 10 AS STRING) AS subscription,
       s_name AS table_name,
       CASE s_suppkey % 6 WHEN 0 THEN 'i' WHEN 1 THEN 'd' WHEN 2 THEN 'f' WHEN 3 THEN 's' WHEN 4 THEN 'r' ELSE 'x' END AS sub_state,
       s_suppkey * 512 AS lsn
FROM {supplier}
"""

# Per-minute load of each kind of event.
DERIVED["minute_metrics"] = """
SELECT event_type AS metric, CAST(date_trunc('hour', ts) AS DATETIME) AS minute,
       CAST(sum(CAST(value AS DECIMAL(12,2))) AS DECIMAL(18,2)) AS load
FROM {events} GROUP BY event_type, CAST(date_trunc('hour', ts) AS DATETIME)
"""

# Locks: every session holds two, and each wait asks for one its blocker holds.
DERIVED["locks"] = """
SELECT snapshot, pid, true AS granted, 'transactionid' AS locktype, 'ExclusiveLock' AS mode, 1 AS dbid,
       CAST(NULL AS INT) AS relation, CAST(NULL AS INT) AS page, CAST(NULL AS INT) AS tup, CAST(NULL AS STRING) AS virtualxid,
       pid AS transactionid, CAST(NULL AS INT) AS classid, CAST(NULL AS INT) AS objid, CAST(NULL AS INT) AS objsubid
FROM {sessions}
UNION ALL
SELECT snapshot, pid, true, 'relation', 'RowExclusiveLock', 1, pid % 7, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM {sessions}
UNION ALL
SELECT snapshot, pid, false, 'transactionid', 'ShareLock', 1, NULL, NULL, NULL, NULL, blocker_pid, NULL, NULL, NULL
FROM {session_edges} WHERE pid % 2 = 0
UNION ALL
SELECT snapshot, pid, false, 'relation', 'AccessExclusiveLock', 1, blocker_pid % 7, NULL, NULL, NULL, NULL, NULL, NULL, NULL
FROM {session_edges} WHERE pid % 2 = 1
"""

# Direct waits plus a second edge that makes one chain the tail of another.
DERIVED["tail_edges"] = """
SELECT snapshot, pid, blocker_pid, ord FROM {session_edges}
UNION ALL
SELECT snapshot, pid, pid - 2 AS blocker_pid, 5 AS ord FROM {sessions} WHERE pid % 5 = 3
"""

DERIVED["audit_events"] = """
SELECT event_id AS id, event_type AS action, ts AS created_at,
       'user' || CAST(user_id AS STRING) AS actor, props AS metadata
FROM {events}
"""

# Copy runs, one per order.
DERIVED["workflow_runs"] = """
SELECT o_orderkey AS number, o_orderdate AS created_at,
       CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate + INTERVAL '1' HOUR END AS started_at,
       CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 THEN o_orderdate + INTERVAL '30' HOUR END AS copied_at,
       CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL '48' HOUR END AS completed_at,
       CASE WHEN o_orderkey % 3 = 1 THEN o_orderdate + INTERVAL '2' HOUR END AS cancelled_at,
       o_orderkey % 4 = 0 AS primaries_switched,
       o_orderkey % 2 = 0 AS replicas_switched,
       o_orderkey % 1000 AS rows_copied,
       CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE 1000 END AS rows_total
FROM {orders}
"""

# Table names as a listing of many servers would give them.
DERIVED["table_names"] = """
SELECT event_id AS server,
       CASE event_type
         WHEN 'click' THEN 'orders_' || CAST(user_id AS STRING)
         WHEN 'view' THEN CASE event_id % 12
              WHEN 0 THEN '__drizzle_migrations' WHEN 1 THEN '_prisma_migrations' WHEN 2 THEN 'knex_migrations_lock'
              WHEN 3 THEN 'SequelizeMeta' WHEN 4 THEN 'schema_migrations' WHEN 5 THEN 'flyway_schema_history'
              WHEN 6 THEN 'databasechangelog' WHEN 7 THEN 'Django_Migrations' WHEN 8 THEN 'alembic_version'
              WHEN 9 THEN 'typeorm_metadata' WHEN 10 THEN 'goose_db_version' ELSE 'knex_data' END
         WHEN 'error' THEN '_vt_hld_6ace8bcef73211ea87e9f875a4d24e90_2020091512' || CAST(1000 + event_id % 9000 AS STRING) || '_'
         WHEN 'signup' THEN 'MixedCase' || CAST(user_id AS STRING)
         ELSE 'customers_' || CAST(user_id AS STRING) || '_with_a_name_that_is_far_too_long_for_the_sixty_three_byte_limit' END AS table_name,
       CASE WHEN event_id % 9 = 0 THEN 'VIEW' ELSE 'BASE TABLE' END AS table_type
FROM {events}
"""

# Load status per table and where it stands.
DERIVED["load_status"] = """
SELECT 'orders_' || CAST(o_orderkey AS STRING) AS table_name,
       o_orderstatus <> 'P' AS loaded,
       CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE o_custkey END AS dest_rows,
       o_orderkey % 10 <> 0 AS in_source
FROM {orders}
"""

# What the two engines spell differently: the plain SQL form and Spark's.
_SPELLINGS = {'"MktSegment"': "`MktSegment`", "AS DATETIME)": "AS TIMESTAMP_NTZ)"}

_NAMES = re.compile(r"\{(\w+)\}")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or a derived input built on given tables."""
    if name in GIVEN:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    parts = {n: load(spark, sf_dir, n) for n in set(_NAMES.findall(DERIVED[name]))}
    return derive(spark, name, **parts)


def derive(spark: SparkSession, name: str, **parts: DataFrame) -> DataFrame:
    """A derived input from the frames it names, which may be streams."""
    text = DERIVED[name]
    for theirs, ours in _SPELLINGS.items():
        text = text.replace(theirs, ours)
    return spark.sql(text, **parts)


def with_clause(names: list[str]) -> str:
    """The ``WITH`` list that defines these inputs in plain SQL."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in GIVEN or name in ordered:
            return
        for needed in _NAMES.findall(DERIVED[name]):
            visit(needed)
        ordered.append(name)

    for name in names:
        visit(name)
    body = ", ".join(
        f"{n} AS ({_NAMES.sub(lambda m: m.group(1), DERIVED[n])})" for n in ordered
    )
    return f"WITH RECURSIVE {body} " if body else ""
