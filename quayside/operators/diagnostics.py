"""Checks over statistics snapshots gathered from a fleet of databases.

Inputs are tables with a ``db`` column, one row per relation, index, column,
slot and so on. Every check is a report of the worst rows, so it ends in an
ordered limit, which Spark runs as a top-k inside each task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Mapping, Sequence
from functools import partial

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.functions.labels import megabytes, percent_of, size_label
from quayside.operators import blocking
from quayside.operators.querylog import share_of_total
from quayside.operators.sessions import long_running
from quayside.session import materialize
from quayside.sources.tables import user_schemas

# Page layout of a heap the bloat estimate assumes.
BLOCK_SIZE, PAGE_HEADER, ROW_HEADER, ALIGNMENT = 8192, 20, 23, 8

# What a server does when a table sets no options of its own.
VACUUM_DEFAULTS = {
    "autovacuum_vacuum_threshold": "50",
    "autovacuum_vacuum_scale_factor": "0.2",
    "autovacuum_analyze_threshold": "50",
    "autovacuum_analyze_scale_factor": "0.1",
    "autovacuum_enabled": "true",
}

# States of a table under logical replication.
SUBSCRIPTION_STATES = {
    "i": "initialize",
    "d": "data being copied",
    "f": "finished table copy",
    "s": "synchronized",
    "r": "ready",
}
TABLE_KINDS = ["r", "m", "p"]


def _top(df: DataFrame, order: Sequence[Column], limit: int | None) -> DataFrame:
    """The first rows in order, or all of them, sorted, without a limit."""
    ordered = df.orderBy(*order)
    return ordered if limit is None else ordered.limit(limit)


def partition_rollup(relations: DataFrame) -> DataFrame:
    """Per database and root, the relations that belong to it and their bytes.

    A root with very many partitions sends one partial sum per task.
    """
    root = F.coalesce("root_id", "relid").alias("relid")
    return relations.groupBy("db", root).agg(F.count("*").alias("parts"), F.sum("table_bytes").alias("table_bytes"))


def table_sizes(relations: DataFrame, limit: int | None = 25) -> DataFrame:
    """Largest tables, partitions counted with their root."""
    sizes = partition_rollup(relations.where(F.col("kind").isin(*TABLE_KINDS))).drop("parts")
    names = user_schemas(relations).select("db", "relid", "schema_name", "rel_name", "kind")
    kind = F.when(F.col("kind") == "m", "matview").when(F.col("kind") == "p", "partitioned table")
    rolled = sizes.join(names, ["db", "relid"]).select(
        "db",
        "schema_name",
        "rel_name",
        kind.otherwise("table").alias("type"),
        "table_bytes",
        size_label(F.col("table_bytes")).alias("size"),
        megabytes(F.col("table_bytes")).alias("size_mb"),
    )
    return _top(rolled, [F.desc("table_bytes"), F.col("db"), F.col("rel_name")], limit)


def mysql_table_sizes(tables: DataFrame, limit: int | None = 25) -> DataFrame:
    """Largest base tables of MySQL servers, indexes included, with their rough row counts."""
    sized = user_schemas(tables, postgres=False).where("table_type = 'BASE TABLE'").select(
        "db",
        "schema_name",
        "table_name",
        (F.col("data_bytes") + F.col("index_bytes")).alias("bytes"),
        megabytes(F.col("data_bytes") + F.col("index_bytes")).alias("size_mb"),
        F.col("table_rows").alias("approx_rows"),
    )
    return _top(sized, [F.desc("bytes"), F.col("db"), F.col("schema_name"), F.col("table_name")], limit).drop("bytes")


# Databases the index statistics of a MySQL server also list.
STATISTICS_SYSTEM = ["mysql", "sys", "_vt"]


def mysql_index_sizes(statistics: DataFrame, page_bytes: int = 16384, limit: int | None = 25) -> DataFrame:
    """Largest indexes of MySQL servers, from their number of pages."""
    sized = statistics.where((F.col("stat_name") == "size") & ~F.col("schema_name").isin(*STATISTICS_SYSTEM)).select(
        "db",
        "schema_name",
        "table_name",
        "index_name",
        "stat_value",
        megabytes(F.col("stat_value") * page_bytes).alias("size_mb"),
    )
    order = [F.desc("stat_value"), *[F.col(c) for c in ("db", "schema_name", "table_name", "index_name")]]
    return _top(sized, order, limit).drop("stat_value")


def mysql_unused_indexes(usage: DataFrame, limit: int | None = 50) -> DataFrame:
    """Indexes of MySQL servers that nothing has used; a primary key is not one to drop."""
    idle = user_schemas(usage, postgres=False).where(
        F.col("index_name").isNotNull() & (F.col("index_name") != "PRIMARY") & (F.col("uses") == 0)
    )
    names = ["schema_name", "table_name", "db", "index_name"]
    return _top(idle.select("db", "schema_name", "table_name", "index_name"), [F.col(c) for c in names], limit)


def mysql_full_scans(usage: DataFrame, limit: int | None = 25) -> DataFrame:
    """Tables of MySQL servers by the rows that scans without an index read."""
    scanned = user_schemas(usage, postgres=False).where("rows_full_scanned > 0").select(
        "db", "schema_name", F.col("table_name").alias("name"), "rows_full_scanned", "latency_ms"
    )
    return _top(scanned, [F.desc("rows_full_scanned"), F.col("db"), F.col("schema_name"), F.col("name")], limit)


def index_sizes(indexes: DataFrame, limit: int | None = 25) -> DataFrame:
    """Largest indexes."""
    sized = user_schemas(indexes).select(
        "db",
        "schema_name",
        F.concat_ws(".", "rel_name", "index_name").alias("name"),
        "index_bytes",
        size_label(F.col("index_bytes")).alias("size"),
    )
    return _top(sized, [F.desc("index_bytes"), F.col("db"), F.col("name")], limit)


def unused_indexes(indexes: DataFrame, max_scans: int = 50, limit: int | None = 50) -> DataFrame:
    """Indexes that enforce nothing and are hardly read."""
    idle = indexes.where(
        ~F.col("is_unique") & ~F.col("is_primary") & (F.col("scans") < max_scans)
    ).select(
        "db",
        F.concat_ws(".", "schema_name", "rel_name").alias("table_name"),
        "index_name",
        "index_bytes",
        size_label(F.col("index_bytes")).alias("size"),
        "scans",
    )
    return _top(idle, [F.desc("index_bytes"), F.asc("scans"), F.col("db"), F.col("index_name")], limit)


def redundant_indexes(indexes: DataFrame, limit: int | None = None) -> DataFrame:
    """Indexes another index of the table makes needless, with that index.

    An index is redundant when another has the same columns and wins by being
    unique or by name, when it is not unique and its columns lead those of
    another, or when a unique index already covers its leading columns.
    Candidates are found by grouping column prefixes, never by pairing the
    indexes of a table, so a table with very many indexes costs one row per
    index and leading column. The distinct column lists are written while this
    is built; ``indexes`` is read for them and once more for the result.
    """
    key = ["db", "relid"]
    name = F.col("index_name")
    indexes = user_schemas(indexes, postgres=False)
    # One row per distinct column list of a table; all below works on these.
    lists = indexes.groupBy(*key, F.col("columns").alias("cols")).agg(
        F.min(F.when(F.col("is_unique"), name)).alias("unique"), F.min(name).alias("any")
    )
    lists = materialize(lists, "column-lists")
    parts = F.split("cols", ",")
    prefixes = lists.select(
        *key,
        "cols",
        "any",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.size(parts) - 1),
                lambda n: F.array_join(F.slice(parts, F.lit(1), n), ","),
            )
        ).alias("prefix"),
    ).where("prefix <> ''")

    def first(column: str) -> Column:
        return F.min(F.struct(F.col(column).alias("index_name"), "cols"))

    wider = (
        prefixes.groupBy(*key, "prefix").agg(first("any").alias("wider"))
        .withColumnRenamed("prefix", "cols")
    )
    unique = lists.where("unique IS NOT NULL").select(*key, F.col("cols").alias("prefix"), "unique")
    covering = F.min(F.struct(F.col("unique").alias("index_name"), F.col("prefix").alias("cols")))
    covered = (
        prefixes.select(*key, "cols", "prefix")
        .join(unique, [*key, "prefix"])
        .groupBy(*key, "cols")
        .agg(covering.alias("covering"))
    )
    best = F.struct(F.coalesce("unique", "any").alias("index_name"), "cols")
    judged = (
        lists.select(*key, "cols", best.alias("best"))
        .join(wider, [*key, "cols"], "left")
        .join(covered, [*key, "cols"], "left")
    )
    same = F.when(F.col("best.index_name") != name, F.col("best"))
    broader = F.when(~F.col("is_unique"), F.col("wider"))
    found = (
        indexes.withColumnRenamed("columns", "cols")
        .join(judged, [*key, "cols"])
        .withColumn("d", F.coalesce(same, broader, F.col("covering")))
        .where("d IS NOT NULL")
        .select(
            "db",
            "schema_name",
            "rel_name",
            F.col("index_name").alias("redundant_index_name"),
            F.col("cols").alias("redundant_index_columns"),
            F.col("d.index_name").alias("dominant_index_name"),
            F.col("d.cols").alias("dominant_index_columns"),
        )
    )
    return found if limit is None else _top(found, [F.col(c) for c in found.columns[:4]], limit)


def invalid_indexes(indexes: DataFrame, limit: int | None = 50) -> DataFrame:
    """Indexes a failed build left behind."""
    broken = user_schemas(indexes).where(~F.col("is_valid")).select(
        "db",
        "schema_name",
        F.concat_ws(".", "rel_name", "index_name").alias("name"),
        "index_bytes",
        size_label(F.col("index_bytes")).alias("size"),
        F.col("is_ready").alias("ready"),
    )
    return _top(broken, [F.desc("index_bytes"), F.col("db"), F.col("name")], limit)


def sequential_scans(relations: DataFrame, limit: int | None = 25) -> DataFrame:
    """Tables read from end to end most often."""
    scanned = relations.where("seq_scans > 0").select(
        "db", "schema_name", F.col("rel_name").alias("name"), F.col("seq_scans").alias("scans")
    )
    return _top(scanned, [F.desc("scans"), F.col("db"), F.col("name")], limit)


# Text that marks a query as one that watches the others.
MONITORING = "pg_stat_activity"


def long_running_queries(sessions: DataFrame, at: Column, limit: int | None = 100) -> DataFrame:
    """Longest running queries of all snapshots, those that monitor left out."""
    watched = sessions.where(~F.lower("query_text").contains(MONITORING))
    slow = long_running(watched, at).select(
        "source", "snapshot", "pid", "state", "elapsed_s", F.left("query_text", F.lit(200)).alias("query")
    )
    return _top(slow, [F.desc("elapsed_s"), F.col("snapshot"), F.col("pid")], limit)


# Commands and users of a process list that always run long.
RESTING_COMMANDS = ["Sleep", "Binlog Dump", "Binlog Dump GTID", "Daemon"]
SERVER_USERS = ["vt_repl", "event_scheduler"]


def long_running_processes(processes: DataFrame, seconds: int = 300, limit: int | None = 100) -> DataFrame:
    """Longest running statements of a process list."""
    slow = processes.where(
        ~F.col("command").isin(*RESTING_COMMANDS)
        & ~F.col("user").isin(*SERVER_USERS)
        & F.col("info").isNotNull()
        & (F.col("time") > seconds)
    ).select("id", "user", "db", F.col("time").alias("seconds"), "state", F.left("info", F.lit(120)).alias("query"))
    return _top(slow, [F.desc("seconds"), F.col("id")], limit)


# What tells one lock from another beside its type.
LOCK_KEY = ["dbid", "relation", "page", "tup", "virtualxid", "transactionid", "classid", "objid", "objsubid"]


def matched_locks(waits: DataFrame, held: DataFrame, by: Sequence[str]) -> DataFrame:
    """Awaited locks with the held lock they wait for, if it is among ``held``.

    Two locks are the same when all parts of their key are, missing parts
    included; null-safe equality keeps this a hash join.
    """
    w, h = waits.alias("w"), held.alias("h")
    same = [F.col(f"w.{c}") == F.col(f"h.{c}") for c in [*by, "locktype"]]
    same += [F.col(f"w.{c}").eqNullSafe(F.col(f"h.{c}")) for c in LOCK_KEY]
    return w.join(h, same, "left").select(
        "w.*", F.col("h.mode").alias("lock_mode"), F.col("h.locktype").alias("lock_type")
    )


def root_blockers(
    sessions: DataFrame,
    edges: DataFrame,
    locks: DataFrame,
    relations: DataFrame,
    at: Column,
    scope: Sequence[str] = ("snapshot",),
    limit: int | None = 100,
) -> DataFrame:
    """Sessions that block others and wait for none, with what they hold.

    Only sessions in a lock wait count as blocked. Relations are named within
    their database, as their ids repeat between databases.
    Counts come from the chains alone; the lists are built from pairs made
    distinct first, so neither grows with the product of waiters and locks.
    """
    scope = list(scope)
    root = [*scope, "root"]
    stuck = sessions.where("wait_event_type = 'Lock'").select(*scope, "pid")
    edges = edges.join(stuck, [*scope, "pid"], "left_semi")
    chains = materialize(blocking.root_chains(edges, scope), "chains")
    counts = chains.groupBy(*root).agg(F.count("*").alias("blocked_count"))

    wanted = locks.where("NOT granted").withColumnRenamed("pid", "node").drop("granted", "mode")
    waits = chains.join(wanted, [*scope, "node"])
    held = locks.where("granted").withColumnRenamed("pid", "root").drop("granted")
    details = matched_locks(waits, held, root).select(
        *root, F.col("dbid").cast("bigint").alias("dbid"), F.col("relation").cast("bigint").alias("relid"), "lock_mode", "lock_type"
    )
    names = relations.select(F.col("dbid").cast("bigint").alias("dbid"), F.col("relid").cast("bigint").alias("relid"), "rel_name")
    named = details.distinct().join(names, ["dbid", "relid"], "left")

    def listed(column: str) -> Column:
        return F.array_join(F.array_sort(F.collect_set(column)), ", ")

    lists = named.groupBy(*root).agg(
        listed("rel_name").alias("relation"), listed("lock_mode").alias("lock_mode"), listed("lock_type").alias("lock_type")
    )
    who = sessions.select(*scope, F.col("pid").alias("root"), "state", "query_start", "query_text")
    rows = counts.join(who, root).join(lists, root, "left").select(
        *scope,
        F.col("root").alias("pid"),
        "state",
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("relation", "lock_mode", "lock_type")],
        F.timestamp_diff("SECOND", F.col("query_start"), at).alias("age_s"),
        "blocked_count",
        F.left("query_text", F.lit(200)).alias("query"),
        "query_start",
    )
    order = [F.desc("blocked_count"), F.asc_nulls_last("query_start"), *[F.col(c) for c in scope], F.col("pid")]
    return _top(rows, order, limit).drop("query_start")


def lock_waits(sessions: DataFrame, edges: DataFrame, scope: Sequence[str] = ("snapshot",)) -> DataFrame:
    """Every direct wait with the query of both sides."""
    scope = list(scope)
    text = F.left(F.coalesce("query_text", F.lit("")), F.lit(80))
    waiting = sessions.select(*scope, "pid", text.alias("waiting_query"))
    blocking_side = sessions.select(*scope, F.col("pid").alias("blocker_pid"), text.alias("blocking_query"))
    return (
        edges.join(waiting, [*scope, "pid"])
        .join(blocking_side, [*scope, "blocker_pid"], "left")
        .select(
            *scope, F.col("pid").alias("waiting_pid"), "waiting_query",
            F.col("blocker_pid").alias("blocking_pid"), F.coalesce("blocking_query", F.lit("")).alias("blocking_query"),
        )
    )


def outliers(statements: DataFrame, limit: int | None = 25) -> DataFrame:
    """Statements by their share of all execution time."""
    shared = share_of_total(statements, "total_exec_ms", "prop_exec_time")
    rows = shared.select(F.col("total_exec_ms").cast("double").alias("total_exec_ms"), "prop_exec_time", "ncalls", "query")
    return _top(rows, [F.desc("total_exec_ms"), F.col("query")], limit)


def calls(statements: DataFrame, limit: int | None = 25) -> DataFrame:
    """Statements by their share of all calls."""
    shared = share_of_total(statements, "ncalls", "prop_calls")
    rows = shared.select("ncalls", F.col("total_exec_ms").cast("double").alias("total_exec_ms"), "prop_calls", "query")
    return _top(rows, [F.desc("ncalls"), F.col("query")], limit)


def _aligned(width: Column) -> Column:
    """The padding that brings a width to the next multiple of the alignment."""
    over = width % ALIGNMENT
    return F.lit(ALIGNMENT) - F.when(over == 0, F.lit(ALIGNMENT)).otherwise(over)


def _bloat_row(kind: str, name: Column, pages: Column, expected: Column) -> list[Column]:
    wasted = pages - expected
    enough = pages < expected
    pct = (wasted * 100 / pages).cast("decimal(18,6)")
    return [
        F.lit(kind).alias("type"),
        F.col("db"),
        F.col("schema_name"),
        name.alias("object_name"),
        (pages * BLOCK_SIZE).cast("bigint").alias("bytes"),
        F.when((pages == 0) | enough, F.lit(0.0))
        .otherwise(F.round(pct, 1).cast("double"))
        .alias("bloat_pct"),
        F.when(enough, F.lit(0))
        .otherwise(wasted * BLOCK_SIZE)
        .cast("bigint")
        .alias("waste_bytes"),
    ]


def bloat(
    column_stats: DataFrame, relations: DataFrame, indexes: DataFrame, limit: int | None = 25
) -> DataFrame:
    """Estimated wasted space of tables and indexes.

    The expected number of pages follows from row width, null share, header and
    alignment; an index is taken to hold all columns, as a rough estimate.
    """
    key = ["db", "schema_name", "rel_name"]
    widths = column_stats.groupBy(*key).agg(
        F.sum((1 - F.col("null_frac")) * F.col("avg_width")).alias("width"),
        F.max("null_frac").alias("null_share"),
        F.count_if(F.col("null_frac") != 0).alias("nullable"),
    )
    bitmap = F.lit(ROW_HEADER + 1) + F.expr("nullable div 8")
    # The fixed part of a row header, padded like any other width.
    header = ROW_HEADER + ALIGNMENT - (ROW_HEADER % ALIGNMENT or ALIGNMENT)
    info = widths.select(
        *key,
        (F.col("width") + header).alias("row_width"),
        (F.col("null_share") * (bitmap + _aligned(bitmap))).alias("null_width"),
    )
    usable = float(BLOCK_SIZE - PAGE_HEADER)
    tables = user_schemas(relations).where("kind = 'r'")
    row = F.col("row_width") + _aligned(F.col("row_width")) + F.col("null_width") + 4
    table_pages = F.ceil(F.col("rel_tuples") * row / usable)
    index_pages = F.coalesce(
        F.ceil(F.col("index_tuples") * (F.col("row_width") - 12) / usable), F.lit(0)
    )
    table_rows = tables.join(info, key).select(
        *_bloat_row("table", F.col("rel_name"), F.col("rel_pages"), table_pages)
    )
    own = user_schemas(indexes).where("table_kind = 'r'")
    index_rows = own.join(info, key).select(
        *_bloat_row("index", F.concat_ws("::", "rel_name", "index_name"), F.col("index_pages"), index_pages)
    )
    both = table_rows.unionByName(index_rows).withColumns(
        {"size": size_label(F.col("bytes")), "waste": size_label(F.col("waste_bytes"))}
    )
    return _top(both, [F.desc("waste_bytes"), F.desc("bloat_pct"), F.col("db"), F.col("object_name")], limit)


def fragmentation(relations: DataFrame, limit: int | None = 25) -> DataFrame:
    """Free space inside the files of tables."""
    total = F.col("table_bytes") + F.col("data_free")
    free = user_schemas(relations, postgres=False).where("data_free > 0").select(
        "db",
        "schema_name",
        "rel_name",
        "data_free",
        megabytes(F.col("data_free")).alias("free_mb"),
        megabytes(F.col("table_bytes")).alias("size_mb"),
        percent_of(F.col("data_free"), total).alias("free_pct"),
    )
    return _top(free, [F.desc("data_free"), F.col("db"), F.col("rel_name")], limit)


def _option(name: str, defaults: Mapping[str, str]) -> Column:
    """A table's own setting, else the server's."""
    own = F.str_to_map("options", F.lit(","), F.lit("="))
    return F.coalesce(F.try_element_at(own, F.lit(name)), F.lit(defaults[name]))


def vacuum_stats(
    relations: DataFrame, defaults: Mapping[str, str] | None = None, limit: int | None = 25
) -> DataFrame:
    """Whether maintenance is due by each table's own or the server's settings."""
    settings = {**VACUUM_DEFAULTS, **(defaults or {})}
    rows = F.greatest("rel_tuples", F.lit(0))
    off = _option("autovacuum_enabled", settings) == "false"

    def due(what: str, changed: str) -> Column:
        threshold = _option(f"autovacuum_{what}_threshold", settings).cast("bigint")
        scale = _option(f"autovacuum_{what}_scale_factor", settings).cast("double")
        return (
            F.when(off, "disabled")
            .when(threshold + scale * rows < F.col(changed), "yes")
            .otherwise("no")
        )

    stats = relations.select(
        "db",
        "schema_name",
        "rel_name",
        "rel_tuples",
        "dead_rows",
        "mods_since_analyze",
        due("vacuum", "dead_rows").alias("expect_vacuum"),
        due("analyze", "mods_since_analyze").alias("expect_analyze"),
    )
    return _top(stats, [F.desc("dead_rows"), F.col("db"), F.col("rel_name")], limit)


def replication_slots(slots: DataFrame, walsenders: DataFrame, limit: int | None = 100) -> DataFrame:
    """Slots by the log they keep from being removed."""
    senders = walsenders.select(
        "db", F.col("pid").alias("active_pid"), F.col("state").alias("sender_state"), "replay_lag_s"
    )
    retained = F.col("current_lsn") - F.col("restart_lsn")
    unconfirmed = F.when(
        F.col("slot_type") == "logical", F.col("current_lsn") - F.col("confirmed_lsn")
    )
    status = F.coalesce(
        "sender_state",
        F.when(F.col("active"), "active (no walsender)").otherwise("inactive"),
    )
    rows = slots.join(senders, ["db", "active_pid"], "left").select(
        "db",
        "slot_name",
        "slot_type",
        status.alias("status"),
        retained.alias("retained_bytes"),
        size_label(F.col("safe_bytes")).alias("safe_size"),
        size_label(retained).alias("retained_size"),
        size_label(unconfirmed).alias("unconfirmed_size"),
        "replay_lag_s",
    )
    return _top(rows, [F.desc_nulls_last("retained_bytes"), F.col("db"), F.col("slot_name")], limit)


def subscriptions(relations: DataFrame, limit: int | None = 100) -> DataFrame:
    """Progress of tables under logical replication."""
    label = F.create_map(*[F.lit(x) for kv in SUBSCRIPTION_STATES.items() for x in kv])
    rows = relations.select(
        "db",
        "subscription",
        "table_name",
        F.coalesce(F.try_element_at(label, F.col("sub_state")), F.col("sub_state")).alias("status"),
        "lsn",
    )
    return _top(rows, [F.col("subscription"), F.col("table_name"), F.col("db")], limit)


Check = Callable[..., DataFrame]

# Each check with the inputs it needs, in the order of the report.
CHECKS: dict[str, tuple[Check, list[str]]] = {
    "table-sizes": (table_sizes, ["relations"]),
    "index-sizes": (index_sizes, ["indexes"]),
    "unused-indexes": (unused_indexes, ["indexes"]),
    "redundant-indexes": (partial(redundant_indexes, limit=50), ["indexes"]),
    "invalid-indexes": (invalid_indexes, ["indexes"]),
    "seq-scans": (sequential_scans, ["relations"]),
    "long-running-queries": (long_running_queries, ["sessions", "at"]),
    "locks": (root_blockers, ["sessions", "edges", "locks", "relations", "at"]),
    "outliers": (outliers, ["statements"]),
    "calls": (calls, ["statements"]),
    "bloat": (bloat, ["column_stats", "relations", "indexes"]),
    "vacuum-stats": (vacuum_stats, ["relations"]),
    "replication-slots": (replication_slots, ["slots", "walsenders"]),
    "subscriptions": (subscriptions, ["subscriptions"]),
}


#: An input that so many checks read is made once, whatever joins lie behind it.
SHARED = 3


def _written(df: DataFrame) -> DataFrame:
    """The frame as a written table; one that can't be written stays as it is, for the checks that do without its faults."""
    try:
        return materialize(df, "input")
    except (PySparkException, Py4JJavaError):
        return df


def report(inputs: Mapping[str, DataFrame | Column], names: Sequence[str] = ()) -> DataFrame:
    """All checks as one frame of rows in JSON.

    A check without its inputs, or one that fails, becomes a row that says why
    it was skipped; the others still run. Each check is written out on its own,
    so a failure while running stays with the check that failed. An input that
    at least ``SHARED`` of the checks read is written once, unless that fails.
    """
    frames = []
    uses = Counter(n for name in names or CHECKS for n in CHECKS[name][1])
    inputs = dict(inputs)
    spark = next(v for v in inputs.values() if isinstance(v, DataFrame)).sparkSession
    for name in names or CHECKS:
        fn, needs = CHECKS[name]
        missing = [n for n in needs if n not in inputs]
        reason = f"unavailable: {', '.join(missing)}" if missing else None
        if not missing:
            try:
                for n in needs:
                    if uses.pop(n, 0) >= SHARED and isinstance(inputs[n], DataFrame):
                        inputs[n] = _written(inputs[n])
                rows = fn(*[inputs[n] for n in needs])
                db = F.col("db") if "db" in rows.columns else F.lit(None).cast("string")
                done = rows.select(
                    F.lit(name).alias("check"),
                    db.alias("db"),
                    F.to_json(F.struct("*")).alias("row"),
                    F.lit(None).cast("string").alias("skipped"),
                )
                frames.append(materialize(done, "check"))
            except (PySparkException, Py4JJavaError) as e:  # the report goes on without this check
                reason = str(e).splitlines()[0]
        if reason:
            frames.append(
                spark.createDataFrame([(name, None, None, reason)], "check string, db string, row string, skipped string")
            )
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


# Schema listing


def table_patterns(spec: str) -> Callable[[Column, Column], Column]:
    """``*``, ``schema.*``, ``schema.table`` and bare names as a condition."""
    wanted = [p.strip() for p in spec.split(",") if p.strip()]

    def matches(schema: Column, table: Column) -> Column:
        if spec.strip() == "*":
            return ~schema.isin("pg_catalog", "information_schema")
        hit = F.lit(False)
        for pattern in wanted:
            first, dot, second = pattern.partition(".")
            if pattern.endswith(".*"):
                hit = hit | (schema == pattern[:-2])
            elif dot and "." not in second:
                hit = hit | ((schema == first) & (table == second))
            elif not dot:
                hit = hit | ((schema == "public") & (table == pattern))
        return hit

    return matches


def constraint_columns(constraints: DataFrame, key_usage: DataFrame) -> DataFrame:
    """Constraints with the list of their columns, bounded by a key's width."""
    key = ["db", "table_schema", "table_name", "constraint_name"]
    joined = constraints.join(key_usage, key, "left")
    return joined.groupBy(*key, "constraint_type").agg(
        F.array_join(F.sort_array(F.collect_list("column_name")), ", ").alias("details"),
    )


def schema_listing(
    columns: DataFrame, constraints: DataFrame, key_usage: DataFrame, indexes: DataFrame, tables: str = "*"
) -> DataFrame:
    """Columns, constraints and indexes of the wanted tables in one listing."""
    matches = table_patterns(tables)
    wanted = matches(F.col("table_schema"), F.col("table_name"))
    table_key = F.concat_ws(".", "table_schema", "table_name").alias("table_key")
    none = F.lit(None)

    def part(df: DataFrame, kind: str, name: str, data_type: Column, length: Column, nullable: Column, details: str) -> DataFrame:
        return df.select(
            "db", table_key, F.lit(kind).alias("type"), F.col(name).alias("name"), data_type.alias("data_type"),
            length.cast("int").alias("character_maximum_length"), nullable.cast("string").alias("is_nullable"),
            F.col(details).alias("details"),
        )

    listed = constraint_columns(constraints.where(wanted), key_usage)
    own = indexes.where(matches(F.col("table_schema"), F.col("table_name")))
    parts = [
        part(columns.where(wanted), "COLUMN", "column_name", F.col("data_type"), F.col("character_maximum_length"), F.col("is_nullable"), "column_default"),
        part(listed, "CONSTRAINT", "constraint_name", F.col("constraint_type"), none, none, "details"),
        part(own, "INDEX", "index_name", F.lit("btree"), none, none, "index_def"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).orderBy("db", "table_key", "type", "name")
