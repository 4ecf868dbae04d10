"""Queries on session snapshots and blocking chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from quayside.functions import labels, text
from quayside.operators import blocking, sessions as ops
from quayside.plans.registry import query

_SCOPE = ["snapshot"]
_KEYS = "source, snapshot, instance"


@query(
    "j1_session_roles",
    ["sessions", "instances"],
    f"""
SELECT s.source, s.snapshot, s.pid, s.instance, coalesce(i.role, '') AS instance_role
FROM sessions s LEFT JOIN (SELECT * FROM instances WHERE instance <> 'i1') i USING ({_KEYS})
""",
)
def _(sessions, instances):
    known = instances.where("instance <> 'i1'")
    return ops.with_roles(sessions, known).select(
        "source", "snapshot", "pid", "instance", "instance_role"
    )


@query(
    "p8_filter_by_role",
    ["sessions", "instances"],
    f"""
SELECT 'session' AS kind, source, snapshot, CAST(pid AS STRING) AS id FROM sessions JOIN instances USING ({_KEYS}) WHERE role = 'replica'
UNION ALL SELECT 'instance', source, snapshot, instance FROM instances WHERE role = 'replica'
""",
)
def _(sessions, instances):
    kept, metas = ops.filter_snapshot(ops.with_roles(sessions, instances), instances, role="replica")
    return kept.select(F.lit("session").alias("kind"), "source", "snapshot", F.col("pid").cast("string").alias("id")).unionByName(
        metas.select(F.lit("instance").alias("kind"), "source", "snapshot", F.col("instance").alias("id"))
    )


@query(
    "p8_unknown_instance",
    ["instances"],
    "SELECT 'i9' AS instance, string_agg(DISTINCT instance, ', ' ORDER BY instance) AS valid FROM instances HAVING count(*) FILTER (instance = 'i9') = 0",
)
def _(instances):
    return ops.unknown_instance(instances, "i9")


_WORK = """CASE WHEN lower(trim(state)) IN ('sleep', 'idle') OR lower(trim(state)) LIKE 'idle %' THEN false
     ELSE trim(state) <> '' OR trim(query_text) <> '' END"""


@query(
    "t1_by_transaction",
    ["sessions"],
    """
SELECT source, snapshot, pid, CAST(row_number() OVER (PARTITION BY source, snapshot
   ORDER BY xact_start NULLS LAST, query_start NULLS LAST, pid) AS INT) AS position FROM sessions
""",
)
def _(sessions):
    return ops.with_position(sessions, "transaction").select("source", "snapshot", "pid", "position")


@query(
    "t2_by_duration",
    ["sessions"],
    f"""
SELECT source, snapshot, pid, CAST(row_number() OVER (PARTITION BY source, snapshot
   ORDER BY duration_ms DESC, {_WORK} DESC, pid) AS INT) AS position FROM sessions
""",
)
def _(sessions):
    return ops.with_position(sessions, "duration").select("source", "snapshot", "pid", "position")


_CLOSURE = """
WITH RECURSIVE c(snapshot, root, node) AS (
  SELECT snapshot, blocker_pid, pid FROM session_edges
  UNION
  SELECT c.snapshot, c.root, e.pid FROM c JOIN session_edges e ON e.snapshot = c.snapshot AND e.blocker_pid = c.node),
n AS (SELECT snapshot, root AS pid, count(*) FILTER (root <> node) AS blocking_count FROM c GROUP BY 1, 2)
"""


def _counted(sessions, edges):
    waiting = edges.select("snapshot", "pid", F.lit(True).alias("waiting")).distinct()
    counted = blocking.blocking_counts(sessions, edges, _SCOPE)
    return counted.join(waiting, ["snapshot", "pid"], "left").withColumn(
        "waiting", F.coalesce("waiting", F.lit(False))
    )


@query(
    "a7_blocking_counts",
    ["sessions", "session_edges"],
    _CLOSURE
    + """
SELECT s.snapshot, s.pid, coalesce(blocking_count, 0) AS blocking_count,
       CASE WHEN blocking_count > 0 AND w THEN blocking_count || ' W' WHEN blocking_count > 0 THEN CAST(blocking_count AS STRING)
            WHEN w THEN 'W' ELSE '-' END AS block_text
FROM (SELECT snapshot, pid, (snapshot, pid) IN (SELECT (snapshot, pid) FROM session_edges) AS w FROM sessions) s
LEFT JOIN n USING (snapshot, pid)
""",
)
def _(sessions, edges):
    counted = _counted(sessions, edges)
    return counted.select(
        "snapshot",
        "pid",
        "blocking_count",
        labels.block_label(F.col("blocking_count"), F.col("waiting")).alias("block_text"),
    )


@query(
    "t3_by_blocked",
    ["sessions", "session_edges"],
    _CLOSURE
    + """
SELECT source, snapshot, pid, CAST(row_number() OVER (PARTITION BY source, snapshot ORDER BY coalesce(blocking_count, 0) DESC,
   (state = 'active' AND w) DESC, w DESC, xact_start NULLS LAST, query_start NULLS LAST, pid) AS INT) AS position
FROM (SELECT *, (snapshot, pid) IN (SELECT (snapshot, pid) FROM session_edges) AS w FROM sessions) s LEFT JOIN n USING (snapshot, pid)
""",
)
def _(sessions, edges):
    placed = ops.with_position(_counted(sessions, edges), "blocked")
    return placed.select("source", "snapshot", "pid", "position")


@query(
    "j5_wait_edges",
    ["session_edges"],
    "SELECT snapshot, pid, CAST(row_number() OVER (PARTITION BY snapshot, pid ORDER BY ord) - 1 AS INT) AS ord, blocker_pid FROM session_edges",
)
def _(edges):
    nested = edges.groupBy("snapshot", "pid").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("ord", "blocker_pid"))), lambda e: e["blocker_pid"]).alias("blocked_by")
    )
    return blocking.wait_edges(nested, _SCOPE)


@query(
    "u1_reachable_pairs",
    ["session_edges"],
    _CLOSURE + "SELECT snapshot, root, node FROM c WHERE root <> node",
)
def _(edges):
    return blocking.downstream(edges, _SCOPE).select("snapshot", "root", "node")


_ROOTS = """
WITH RECURSIVE c(snapshot, root, node) AS (
  SELECT snapshot, blocker_pid, pid FROM session_edges e
  WHERE NOT EXISTS (SELECT 1 FROM session_edges x WHERE x.snapshot = e.snapshot AND x.pid = e.blocker_pid)
  UNION
  SELECT c.snapshot, c.root, e.pid FROM c JOIN session_edges e ON e.snapshot = c.snapshot AND e.blocker_pid = c.node)
"""


@query(
    "j9_root_blockers",
    ["session_edges"],
    _ROOTS + "SELECT snapshot, root, count(DISTINCT node) AS blocked_count FROM c GROUP BY 1, 2",
)
def _(edges):
    return blocking.root_counts(edges, _SCOPE)


def _walk_sql(at: str, to: str, order: str, waiter: str) -> str:
    return f"""
WITH RECURSIVE w AS (
 SELECT snapshot, {at} AS root, [{at}] AS path, [{order}] AS place, {to} AS pid, {waiter} AS waiter FROM session_edges
 UNION ALL
 SELECT w.snapshot, w.root, list_append(w.path, w.pid), list_append(w.place, e.{order}), e.{to}, e.{waiter}
 FROM w JOIN session_edges e ON e.snapshot = w.snapshot AND e.{at} = w.pid
 WHERE NOT list_contains(w.path, w.pid) AND w.pid < 5000),
r AS (SELECT w.snapshot, w.root, w.pid, path,
        CAST(row_number() OVER (PARTITION BY w.snapshot, w.root ORDER BY place) AS INT) AS row_no,
        CAST(len(path) - 1 AS INT) AS depth, p.pid IS NOT NULL AS present, list_contains(path, w.pid) AS cycle,
        CASE WHEN p.pid IS NULL THEN NULL WHEN s.wait_event_type <> '' AND s.wait_event <> '' THEN s.wait_event_type || '/' || s.wait_event
             WHEN s.wait_event <> '' THEN s.wait_event WHEN s.wait_event_type <> '' THEN s.wait_event_type
             WHEN s.pid IS NOT NULL THEN '-' END AS wait_on
      FROM w LEFT JOIN sessions s ON s.snapshot = w.snapshot AND s.pid = w.waiter
             LEFT JOIN sessions p ON p.snapshot = w.snapshot AND p.pid = w.pid)
"""


_UP = _walk_sql("pid", "blocker_pid", "ord", "pid")
_DOWN = _walk_sql("blocker_pid", "pid", "pid", "pid")
_LISTED = """SELECT snapshot, root, row_no, depth, pid, present, cycle, wait_on, false AS truncated, CAST(0 AS BIGINT) AS remaining FROM r"""


@query("j6_upstream_chain", ["sessions", "session_edges"], _UP + _LISTED)
def _(sessions, edges):
    return blocking.walk(sessions, edges, _SCOPE)


@query(
    "j6_upstream_chain_cut",
    ["sessions", "session_edges"],
    _UP
    + _LISTED
    + """ WHERE row_no <= 2 UNION ALL
SELECT snapshot, root, 3, max(depth) FILTER (row_no = 3), NULL, false, false, NULL, true,
       count(DISTINCT pid) FILTER (pid <> root) - count(DISTINCT pid) FILTER (pid <> root AND row_no <= 2)
FROM r GROUP BY snapshot, root HAVING count(*) > 2""",
)
def _(sessions, edges):
    return blocking.walk(sessions, edges, _SCOPE, max_rows=2)


@query("j7_downstream_chain", ["sessions", "session_edges"], _DOWN + _LISTED)
def _(sessions, edges):
    return blocking.walk(sessions, edges, _SCOPE, upstream=False)


@query(
    "j8_collapse_suffixes",
    ["sessions", "tail_edges"],
    _UP.replace("session_edges", "tail_edges")
    + """, b AS (SELECT *, sum(CASE WHEN depth = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY snapshot, root ORDER BY row_no) AS branch FROM r),
g AS (SELECT snapshot, root, branch, list(CASE WHEN cycle THEN -pid ELSE pid END ORDER BY row_no) AS chain FROM b GROUP BY 1, 2, 3)
SELECT b.snapshot, b.root, b.row_no, b.depth, b.pid FROM b JOIN g ON g.snapshot = b.snapshot AND g.root = b.root AND g.branch = b.branch
WHERE NOT EXISTS (SELECT 1 FROM g o WHERE o.snapshot = g.snapshot AND o.root = g.root AND len(o.chain) > len(g.chain)
                  AND o.chain[len(o.chain) - len(g.chain) + 1 :] = g.chain)
""",
)
def _(sessions, edges):
    up = blocking.walk(sessions, edges, _SCOPE)
    return blocking.collapse_suffixes(up, _SCOPE).select("snapshot", "root", "row_no", "depth", "pid")


@query(
    "a16_partial_snapshots",
    ["instances"],
    """
SELECT source, snapshot, count(*) AS instances, count(*) FILTER (error <> '') AS unreachable,
       coalesce(string_agg(instance, ', ' ORDER BY instance) FILTER (error <> ''), '') AS unreachable_ids
FROM instances GROUP BY 1, 2
""",
)
def _(instances):
    return ops.partial_snapshots(instances)


_WINDOW = """
WITH ix AS (SELECT source, snapshot, count(*) AS sessions FROM sessions GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY snapshot) - 1 AS cursor, count(*) OVER (PARTITION BY source) AS c FROM ix),
k AS (SELECT source, snapshot, sessions, cursor, cursor - greatest(c - 10, 0) + 1 AS position, least(c, 10) AS total FROM n WHERE cursor >= c - 10)
"""


@query("w2_retained_window", ["sessions"], _WINDOW + "SELECT * FROM k")
def _(sessions):
    return ops.retained_window(ops.snapshot_index(sessions), keep=10)


@query(
    "w3_neighbours",
    ["sessions"],
    _WINDOW
    + """, e AS (SELECT *, min(cursor) OVER (PARTITION BY source) AS lo, max(cursor) OVER (PARTITION BY source) AS hi FROM k)
SELECT source, snapshot, position, total, lag(snapshot) OVER (PARTITION BY source ORDER BY snapshot) AS older,
       lead(snapshot) OVER (PARTITION BY source ORDER BY snapshot) AS newer, greatest(lo, least(hi, cursor - 4)) AS four_back,
       CASE WHEN cursor + 20 > hi THEN hi ELSE cursor + 20 END AS from_outside
FROM e
""",
)
def _(sessions):
    kept = ops.with_neighbours(ops.retained_window(ops.snapshot_index(sessions), keep=10))
    edges = kept.groupBy("source").agg(F.min("cursor").alias("lo"), F.max("cursor").alias("hi"))
    lo, hi, cursor = F.col("lo"), F.col("hi"), F.col("cursor")
    beyond = ops.step_cursor(cursor + 20, F.lit(-30), lo, hi)
    return kept.join(edges, "source").select(
        "source", "snapshot", "position", "total", "older", "newer",
        ops.step_cursor(cursor, F.lit(-4), lo, hi).alias("four_back"),
        F.when(cursor + 20 > hi, beyond).otherwise(cursor + 20).alias("from_outside"),
    )


@query(
    "g2_last_good_snapshot",
    ["instances"],
    """
WITH p AS (SELECT source, snapshot, count(*) FILTER (error <> '') AS unreachable FROM instances GROUP BY 1, 2)
SELECT source, snapshot, unreachable,
       coalesce((SELECT max(g.snapshot) FROM p g WHERE g.source = p.source AND g.snapshot <= p.snapshot AND g.unreachable = 0),
                (SELECT min(g.snapshot) FROM p g WHERE g.source = p.source)) AS shown_snapshot
FROM p
""",
)
def _(instances):
    return ops.last_good_snapshot(ops.partial_snapshots(instances))


@query(
    "p11_long_running",
    ["sessions"],
    """
SELECT source, snapshot, pid, date_diff('microsecond', query_start, TIMESTAMP '2024-01-15 00:00:00') // 1000000 AS elapsed_s
FROM sessions WHERE state <> 'idle' AND backend_type <> 'walsender' AND trim(query_text) <> ''
  AND TIMESTAMP '2024-01-15 00:00:00' - query_start > INTERVAL 5 MINUTE
""",
)
def _(sessions):
    at = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    return ops.long_running(sessions, at).select("source", "snapshot", "pid", "elapsed_s")


@query(
    "f17_to_f20_display",
    ["sessions"],
    f"""
WITH s AS (SELECT *, duration_ms // 1000 AS sec FROM sessions)
SELECT source, snapshot, pid, replace(state, 'idle in transaction', 'idle/xact') AS state_text,
       split_part(state, '/', 1) AS command_text,
       CASE WHEN wait_event_type <> '' AND wait_event <> '' THEN wait_event_type || '/' || wait_event
            WHEN wait_event_type || wait_event <> '' THEN wait_event_type || wait_event ELSE '-' END AS wait_text,
       CASE WHEN duration_ms <= 0 THEN '-' WHEN sec >= 3600 THEN printf('%02d:%02d:%02d', sec // 3600, (sec // 60) % 60, sec % 60)
            ELSE printf('%02d:%02d', sec // 60, sec % 60) END AS duration_text,
       left(regexp_replace(query_text, '\\s+', ' ', 'g'), 160) AS query_text_preview,
       {_WORK} AS working,
       lower(split_part(state, '/', 1)) NOT IN ('sleep', 'idle') AND (state <> '' OR query_text <> '') AS process_working
FROM s
""",
)
def _(sessions):
    shown = ops.display_columns(sessions)
    names = ["state_text", "command_text", "wait_text", "duration_text", "query_text_preview", "working", "process_working"]
    return shown.select("source", "snapshot", "pid", *names)


@query(
    "f17_long_durations",
    ["orders"],
    """
WITH s AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * 100 AS ms, CAST(floor(o_totalprice) AS BIGINT) // 10 AS sec FROM orders)
SELECT o_orderkey, CASE WHEN ms <= 0 THEN '-' WHEN sec >= 3600 THEN printf('%02d:%02d:%02d', sec // 3600, (sec // 60) % 60, sec % 60)
       ELSE printf('%02d:%02d', sec // 60, sec % 60) END AS duration_text FROM s
""",
)
def _(orders):
    return orders.select(
        "o_orderkey", labels.compact_duration(F.floor("o_totalprice") * 100).alias("duration_text")
    )


@query(
    "f22_freshness",
    ["sessions"],
    """
SELECT source, snapshot, pid, CASE WHEN snapshot % 5 = 0 THEN 'fresh' WHEN duration_ms >= 10000 * (snapshot % 5) THEN 'very stale'
   WHEN duration_ms >= 3000 * (snapshot % 5) THEN 'stale' ELSE 'fresh' END AS tier FROM sessions
""",
)
def _(sessions):
    interval = F.col("snapshot") % 5 * 1000
    tier = labels.freshness_tier(F.col("duration_ms"), interval)
    return sessions.select("source", "snapshot", "pid", tier.alias("tier"))


@query(
    "s9_process_list",
    ["sessions"],
    """
SELECT source, snapshot, CAST(pid AS BIGINT) + 3000000000 AS pid, username, instance AS client_addr, 'shop' AS "database",
       CASE WHEN state = '' THEN wait_event_type WHEN wait_event_type = '' THEN state ELSE state || '/' || wait_event_type END AS state,
       duration_ms // 1000 * 1000 AS duration_ms, query_text FROM sessions
""",
)
def _(sessions):
    listed = sessions.select(
        "source", "snapshot", (F.col("pid") + F.lit(3_000_000_000)).alias("id"), F.col("username").alias("user"), F.col("instance").alias("host"),
        F.lit("shop").alias("db"), F.col("state").alias("command"), F.col("wait_event_type").alias("state"),
        F.floor(F.col("duration_ms") / 1000).alias("time"), F.col("query_text").alias("info"),
    )
    return ops.from_process_list(listed)


@query(
    "f13_f14_f15_clean_text",
    ["documents"],
    r"""
SELECT doc_id, regexp_replace(body, '[\x00-\x1f\x7f-\x9f]', '', 'g') AS one_line,
       regexp_replace(body, '[\x00-\x09\x0b-\x1f\x7f-\x9f]', '', 'g') AS many_lines,
       left(trim(regexp_replace(regexp_replace(body, '[\x00-\x1f\x7f-\x9f]', '', 'g'), ' +', ' ', 'g')), 160) AS preview,
       CASE WHEN length(body) > 80 THEN left(body, 79) || '…' ELSE body END AS short
FROM (SELECT doc_id, text || chr(27) || '[31m' || chr(10) || chr(9) || '  end' || chr(127) AS body FROM documents) d
""",
)
def _(documents):
    body = F.concat("text", F.lit("\x1b[31m\n\t  end\x7f"))
    return documents.select("doc_id", body.alias("body")).select(
        "doc_id",
        text.strip_controls(F.col("body")).alias("one_line"),
        text.strip_controls(F.col("body"), keep_newlines=True).alias("many_lines"),
        text.preview(F.col("body")).alias("preview"),
        text.ellipsize(F.col("body"), 80).alias("short"),
    )
