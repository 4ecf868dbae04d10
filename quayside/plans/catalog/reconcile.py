"""Queries on two copies of a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from quayside.functions import coerce, text
from quayside.operators import diff, keytree
from quayside.plans.registry import query
from quayside.session import new_path

_DIFF = """
WITH j AS (
  SELECT coalesce(s.o_orderkey, t.o_orderkey) AS k,
         CASE WHEN t.o_orderkey IS NULL THEN 'extra_source'
              WHEN s.o_orderkey IS NULL THEN 'extra_target'
              WHEN s.o_custkey IS DISTINCT FROM t.o_custkey OR s.o_orderstatus IS DISTINCT FROM t.o_orderstatus
                OR s.o_totalprice IS DISTINCT FROM t.o_totalprice OR s.o_orderdate IS DISTINCT FROM t.o_orderdate
                OR s.o_orderpriority IS DISTINCT FROM t.o_orderpriority THEN 'mismatched'
              ELSE 'matched' END AS class
  FROM {s} s FULL JOIN {t} t ON s.o_orderkey = t.o_orderkey),
r AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY k) AS rn FROM j)
"""
_REPORT = """
SELECT 'orders' AS table_name, '-' AS shard,
       count(*) FILTER (class = 'matched') AS matched_rows_count,
       count(*) FILTER (class = 'mismatched') AS mismatched_rows_count,
       count(*) FILTER (class = 'extra_source') AS extra_source_rows_count,
       count(*) FILTER (class = 'extra_target') AS extra_target_rows_count,
       string_agg(CAST(k AS STRING), ',' ORDER BY rn) FILTER (class = 'mismatched' AND rn <= 10) AS mismatched_rows,
       string_agg(CAST(k AS STRING), ',' ORDER BY rn) FILTER (class = 'extra_source' AND rn <= 10) AS extra_source_rows,
       string_agg(CAST(k AS STRING), ',' ORDER BY rn) FILTER (class = 'extra_target' AND rn <= 10) AS extra_target_rows,
       count(*) FILTER (class <> 'matched') > 0 AS has_mismatch
FROM r
"""
_ALL = _DIFF.format(s="orders", t="orders_copy")


@query("j2_table_diff", ["orders", "orders_copy"], _ALL + _REPORT)
def _(orders, copy):
    return diff.table_diff(orders, copy, ["o_orderkey"], "orders")


@query(
    "j2_table_diff_reversed",
    ["orders", "orders_copy"],
    _DIFF.format(s="orders_copy", t="orders") + _REPORT,
)
def _(orders, copy):
    return diff.table_diff(copy, orders, ["o_orderkey"], "orders")


@query("j2_table_diff_digest", ["orders", "orders_copy"], _ALL + _REPORT)
def _(orders, copy):
    return diff.table_diff(orders, copy, ["o_orderkey"], "orders", digest=True)


@query("j2_table_diff_content", ["orders", "orders_copy"], _ALL + _REPORT)
def _(orders, copy):
    return diff.table_diff(orders, copy, ["o_orderkey"], "orders", digest=False)


@query(
    "j2_table_diff_first_keys",
    ["orders", "orders_copy"],
    "WITH edge AS (SELECT max(o_orderkey) AS e FROM (SELECT o_orderkey FROM orders ORDER BY 1 LIMIT 5000)),"
    + _DIFF.format(
        s="(SELECT orders.* FROM orders JOIN edge ON o_orderkey <= e)",
        t="(SELECT orders_copy.* FROM orders_copy JOIN edge ON o_orderkey <= e)",
    ).strip()[5:]
    + _REPORT,
)
def _(orders, copy):
    return diff.table_diff(orders, copy, ["o_orderkey"], "orders", limit=5000)


@query(
    "j2_diff_only_keys",
    ["orders", "orders_copy"],
    """
WITH j AS (SELECT s.o_orderkey AS s, t.o_orderkey AS t
           FROM orders s FULL JOIN orders_copy t ON s.o_orderkey = t.o_orderkey)
SELECT 'orders' AS table_name, count(*) FILTER (s = t) AS matched_rows_count,
       0 AS mismatched_rows_count, count(*) FILTER (t IS NULL) AS extra_source_rows_count,
       count(*) FILTER (s IS NULL) AS extra_target_rows_count FROM j
""".replace("0 AS mis", "CAST(0 AS BIGINT) AS mis"),
)
def _(orders, copy):
    report = diff.table_diff(orders, copy, ["o_orderkey"], "orders", only_pks=True)
    return report.select("table_name", *[c for c in report.columns if c.endswith("_count")])


@query(
    "j2_diff_repeated_keys",
    ["lineitem"],
    """
WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate, count(*) AS n FROM lineitem GROUP BY ALL),
t AS (SELECT l_orderkey, l_linenumber,
             CASE WHEN l_suppkey % 50 = 0 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity,
             l_shipdate, count(*) AS n
      FROM lineitem WHERE l_partkey % 40 <> 0 GROUP BY ALL),
j AS (SELECT coalesce(s.l_orderkey, t.l_orderkey) AS k1, coalesce(s.l_linenumber, t.l_linenumber) AS k2,
             greatest(coalesce(s.n, 0) - coalesce(t.n, 0), 0) AS ls,
             greatest(coalesce(t.n, 0) - coalesce(s.n, 0), 0) AS lt
      FROM s FULL JOIN t ON s.l_orderkey = t.l_orderkey AND s.l_linenumber = t.l_linenumber
        AND s.l_quantity = t.l_quantity AND s.l_shipdate = t.l_shipdate),
p AS (SELECT k1, k2, CAST(sum(ls) AS BIGINT) AS ls, CAST(sum(lt) AS BIGINT) AS lt FROM j GROUP BY k1, k2)
SELECT k1 AS l_orderkey, k2 AS l_linenumber, least(ls, lt) AS mismatched,
       ls - least(ls, lt) AS extra_source, lt - least(ls, lt) AS extra_target
FROM p WHERE ls + lt > 0
""",
)
def _(lineitem):
    cols = ["l_orderkey", "l_linenumber", "l_quantity", "l_shipdate"]
    changed = (
        lineitem.where("l_partkey % 40 <> 0")
        .withColumn("l_quantity", F.expr("if(l_suppkey % 50 = 0, l_quantity + 1, l_quantity)"))
        .select(*cols)
    )
    pk = cols[:2]
    return diff.classify_keys(diff.leftover_rows(lineitem.select(*cols), changed, pk), pk)


@query(
    "w6_diff_samples",
    ["orders", "orders_copy"],
    _ALL
    + """
SELECT r.k AS o_orderkey, r.class, CAST(r.rn AS INT) AS rank, x.side, x.o_custkey, x.o_orderpriority
FROM r JOIN (
  SELECT 'source' AS side, o_orderkey, left(CAST(o_custkey AS STRING), 8) AS o_custkey, left(o_orderpriority, 8) AS o_orderpriority FROM orders
  UNION ALL
  SELECT 'target', o_orderkey, left(CAST(o_custkey AS STRING), 8), left(o_orderpriority, 8) FROM orders_copy) x
  ON x.o_orderkey = r.k
WHERE r.class <> 'matched' AND r.rn <= 25
""",
)
def _(orders, copy):
    pk = ["o_orderkey"]
    left = diff.leftover_rows(orders, copy, pk)
    rows = diff.sample_rows(left, diff.classify_keys(left, pk), pk, 25, truncate_at=8)
    return rows.select("o_orderkey", "class", "rank", "side", "o_custkey", "o_orderpriority")


_SIZES = ["orders", "lineitem", "customer", "nation"]


@query(
    "a1_row_counts",
    _SIZES,
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS rows FROM {t}" for t in _SIZES
    ),
)
def _(*frames):
    return diff.row_counts(dict(zip(_SIZES, frames)))


@query(
    "j3_compare_counts",
    ["orders", "orders_copy", "customer", "nation"],
    """
SELECT 'orders' AS table_name, (SELECT count(*) FROM orders) AS source_rows,
       (SELECT count(*) FROM orders_copy) AS dest_rows,
       (SELECT count(*) FROM orders) = (SELECT count(*) FROM orders_copy) AS matched
UNION ALL SELECT 'customer', count(*), CAST(0 AS BIGINT), count(*) = 0 FROM customer
UNION ALL SELECT 'nation', CAST(0 AS BIGINT), count(*), count(*) = 0 FROM nation
""",
)
def _(orders, copy, customer, nation):
    source = diff.row_counts({"orders": orders, "customer": customer})
    return diff.compare_counts(
        source, diff.row_counts({"orders": copy, "nation": nation})
    )


@query(
    "j4_departed_tables",
    ["load_status"],
    """
SELECT table_name, false AS departed FROM load_status WHERE in_source
UNION ALL SELECT table_name, true FROM load_status WHERE loaded AND NOT in_source
""",
)
def _(status):
    names = status.where("in_source").select("table_name")
    return diff.with_departed_tables(names, status.where("loaded"))


@query(
    "a2_fingerprint",
    ["orders", "orders_copy", "part"],
    """
SELECT 'orders' AS table_name, count(*) AS rows, CAST(sum(o_orderkey) AS STRING) AS id_sum FROM orders
UNION ALL SELECT 'orders_copy', count(*), CAST(sum(o_orderkey) AS STRING) FROM orders_copy
UNION ALL SELECT 'part_by_name', count(*), '0' FROM part
UNION ALL SELECT 'none', CAST(0 AS BIGINT), '0'
""",
)
def _(orders, copy, part):
    named = {
        "orders": diff.fingerprint(orders, "o_orderkey"),
        "orders_copy": diff.fingerprint(copy, "o_orderkey"),
        "part_by_name": diff.fingerprint(part, "p_name"),
        "none": diff.fingerprint(part.where("p_partkey < 0"), "p_partkey"),
    }
    return diff.union_all(
        [f.select(F.lit(n).alias("table_name"), "*") for n, f in named.items()]
    )


@query(
    "a2_content_fingerprint",
    ["orders", "orders_copy"],
    "SELECT true AS same_when_reordered, false AS same_when_changed, count(*) AS rows FROM orders",
)
def _(orders, copy):
    frames = {
        "a": diff.content_fingerprint(orders),
        "b": diff.content_fingerprint(orders.repartition("o_custkey")),
        "c": diff.content_fingerprint(copy),
    }
    named = [f.select(F.struct("*").alias(n)) for n, f in frames.items()]
    return diff.side_by_side(named).select(
        (F.col("a") == F.col("b")).alias("same_when_reordered"),
        (F.col("a") == F.col("c")).alias("same_when_changed"),
        "a.rows",
    )


@query(
    "a3_flag_distribution",
    ["raw_customer"],
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER ({c} = '1') AS true_count, "
        f"count(*) FILTER ({c} = '0') AS false_count, count(*) FILTER ({c} IS NULL) AS null_count FROM raw_customer"
        for c in ("active", "is_vip", "archived")
    ),
)
def _(raw):
    return diff.flag_distribution(raw, ["active", "is_vip", "archived"])


@query(
    "a4_identity",
    ["orders", "orders_copy"],
    """
SELECT 'sequences' AS "check", 'orders' AS table_name, 'o_orderkey' AS column_name, max(o_orderkey) < 10 AS matched,
       'max=' || max(o_orderkey) AS source, 'next=10' AS dest, 'next value collides with present rows' AS message FROM orders
UNION ALL SELECT 'sequences', 'orders_copy', 'o_orderkey', max(o_orderkey) < 900000000,
       'max=' || max(o_orderkey), 'next=900000000', 'ready for new rows' FROM orders_copy
UNION ALL SELECT 'sequences', 'none', 'o_orderkey', true, NULL, 'next=5', 'empty table'
UNION ALL SELECT 'sequences', 'plain', 'o_orderkey', true, 'max=' || max(o_orderkey), NULL, 'no sequence attached' FROM orders
""",
)
def _(orders, copy):
    key = "o_orderkey"
    return diff.union_all(
        [
            diff.identity_check("orders", orders, key, 10),
            diff.identity_check("orders_copy", copy, key, 900_000_000),
            diff.identity_check("none", orders.where("o_orderkey < 0"), key, 5),
            diff.identity_check("plain", orders, key, None),
        ]
    )


@query(
    "a4_next_identity",
    ["orders"],
    "SELECT greatest(coalesce(max(o_orderkey), 1), 1) AS last_value FROM orders",
)
def _(orders):
    return diff.next_identity(orders, "o_orderkey")


_SAMPLED = """
SELECT 'sample_rows' AS "check", 'orders' AS table_name, 'o_orderkey' AS column_name,
       t.o_orderkey IS NOT NULL AND s.o_orderpriority IS NOT DISTINCT FROM t.o_orderpriority
         AND s.o_totalprice = t.o_totalprice AS matched,
       CASE WHEN t.o_orderkey IS NULL THEN 'row missing for ' || s.o_orderkey
            WHEN s.o_totalprice <> t.o_totalprice AND t.o_orderpriority IS NULL THEN s.o_orderkey || ' differs in o_totalprice,o_orderpriority'
            WHEN s.o_totalprice <> t.o_totalprice THEN s.o_orderkey || ' differs in o_totalprice'
            WHEN t.o_orderpriority IS NULL THEN s.o_orderkey || ' differs in o_orderpriority'
            ELSE 'row match for ' || s.o_orderkey END AS message
FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT {n}) s LEFT JOIN orders_copy t ON s.o_orderkey = t.o_orderkey
"""


@query("w4_sampled_rows", ["orders", "orders_copy"], _SAMPLED.format(n=200))
def _(orders, copy):
    sampled = diff.sampled_comparison("orders", orders, copy, ["o_orderkey"], samples=200)
    return sampled.select("check", "table_name", "column_name", "matched", "message")


@query(
    "c6_verify",
    ["orders", "orders_copy"],
    """
SELECT 'row_counts' AS "check", 'orders' AS table_name, CAST(NULL AS STRING) AS column_name,
       (SELECT count(*) FROM orders) = count(*) AS matched FROM orders_copy
UNION ALL SELECT 'table_fingerprint', 'orders', 'o_orderkey', (SELECT sum(o_orderkey) FROM orders) = sum(o_orderkey) FROM orders_copy
UNION ALL SELECT 'table_content', 'orders', NULL, NOT EXISTS (FROM orders EXCEPT ALL FROM orders_copy) AND NOT EXISTS (FROM orders_copy EXCEPT ALL FROM orders)
UNION ALL SELECT 'sequences', 'orders', 'o_orderkey', max(o_orderkey) < 900000000 FROM orders_copy
UNION ALL SELECT "check", table_name, column_name, matched FROM ("""
    + _SAMPLED.format(n=3)
    + ")",
)
def _(orders, copy):
    pairs = {"orders": (orders, copy, ["o_orderkey"])}
    checks = diff.verify_tables(pairs, next_values={"orders": 900_000_000})
    return checks.select("check", "table_name", "column_name", "matched")


@query(
    "c6_verify_changed_content",
    ["customer"],
    """
WITH other AS (SELECT * REPLACE (CASE WHEN c_custkey % 17 = 9 THEN c_name || '!' ELSE c_name END AS c_name) FROM customer),
pairs AS (SELECT 'changed' AS table_name, NOT EXISTS (FROM customer EXCEPT ALL FROM other) AS content UNION ALL SELECT 'same', true),
checks AS (SELECT unnest(['row_counts', 'table_fingerprint', 'table_content', 'sample_rows']) AS "check")
SELECT table_name, "check", CASE WHEN "check" = 'table_content' THEN content ELSE true END AS matched, (SELECT count(*) FROM customer) AS rows
FROM pairs, checks
""",
)
def _(customer):
    """Rows beyond the sampled one differ; counts, keys and samples do not."""
    renamed = F.when(F.col("c_custkey") % 17 == 9, F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name"))
    pairs = {"changed": (customer, customer.withColumn("c_name", renamed), ["c_custkey"]), "same": (customer, customer, ["c_custkey"])}
    checks = diff.verify_tables(pairs, samples=1).select("table_name", "check", "matched")
    return checks.withColumn("rows", customer.agg(F.count("*")).scalar())


_RANGES = keytree.KeyRanges("l_orderkey", width=64, fanout=8, levels=2)

# Contents with their copies on either side; a range is floor(key / 64).
_RANGED = """
WITH stacked AS (SELECT true AS here, * FROM lineitem UNION ALL SELECT false, * FROM lineitem_copy),
held AS (SELECT * EXCLUDE (here), CAST(floor(l_orderkey / 64) AS BIGINT) AS node,
                count(*) FILTER (here) AS s, count(*) FILTER (NOT here) AS t FROM stacked GROUP BY ALL),
changed AS (SELECT node, node * 64 AS key_from, node * 64 + 63 AS key_to,
                   CAST(sum(s) AS BIGINT) AS source_rows, CAST(sum(t) AS BIGINT) AS target_rows
            FROM held GROUP BY node HAVING bool_or(s <> t))
"""


def _trees(lineitem, copy):
    spark = lineitem.sparkSession
    return [keytree.write_tree(df, _RANGES, new_path(spark, "tree")) for df in (lineitem, copy)]


def _repaired(lineitem, copy):
    """The copy with its ranges of even number taken from the source again."""
    even = F.pmod(_RANGES.leaf(), F.lit(2)) == 0
    return lineitem.where(even).unionByName(copy.where(~even))


@query("c6_tree_ranges", ["lineitem", "lineitem_copy"], _RANGED + "SELECT * FROM changed")
def _(lineitem, copy):
    return keytree.changed_ranges(*_trees(lineitem, copy), _RANGES)


@query(
    "c6_tree_keys",
    ["lineitem", "lineitem_copy"],
    _RANGED
    + """, spare AS (SELECT l_orderkey, l_linenumber, CAST(sum(greatest(s - t, 0)) AS BIGINT) AS s, CAST(sum(greatest(t - s, 0)) AS BIGINT) AS t
            FROM held WHERE s <> t GROUP BY ALL)
SELECT l_orderkey, l_linenumber, least(s, t) AS mismatched, s - least(s, t) AS extra_source, t - least(s, t) AS extra_target FROM spare
""",
)
def _(lineitem, copy):
    changed = keytree.changed_ranges(*_trees(lineitem, copy), _RANGES)
    return keytree.changed_keys(lineitem, copy, ["l_orderkey", "l_linenumber"], changed, _RANGES)


@query(
    "c6_tree_verify_again",
    ["lineitem", "lineitem_copy"],
    _RANGED + "SELECT node, key_from, key_to, node % 2 = 0 AS matched FROM changed",
)
def _(lineitem, copy):
    changed = keytree.changed_ranges(*_trees(lineitem, copy), _RANGES)
    return keytree.verify_again(lineitem, _repaired(lineitem, copy), changed, _RANGES)


@query("c6_tree_refresh", ["lineitem", "lineitem_copy"], _RANGED + "SELECT * FROM changed WHERE node % 2 <> 0")
def _(lineitem, copy):
    """The copy's tree follows a repair by reading the repaired ranges alone."""
    source, before = _trees(lineitem, copy)
    changed = keytree.changed_ranges(source, before, _RANGES)
    path = new_path(lineitem.sparkSession, "tree")
    after = keytree.refresh_tree(before, _repaired(lineitem, copy), changed, _RANGES, path)
    return keytree.changed_ranges(source, after, _RANGES)


@query(
    "f7_json_equal",
    ["raw_customer"],
    """
SELECT id, metadata <> '' AND CAST(id AS BIGINT) % 3 <> 0 OR metadata = '' AS equal_documents, true AS equal_reordered
FROM raw_customer
""",
)
def _(raw):
    other = F.expr(
        "if(metadata = '', '', if(cast(id as bigint) % 3 = 0, '[1]', concat(' [1.0 , ', id, ']')))"
    )
    one = F.concat(F.lit('{"a":'), "id", F.lit(',"b":{"c":true,"d":null}}'))
    two = F.concat(F.lit('{"b": {"d":null, "c":true}, "a": '), "id", F.lit(".0}"))
    return raw.select(
        "id",
        coerce.json_equal(F.col("metadata"), other).alias("equal_documents"),
        coerce.json_equal(one, two).alias("equal_reordered"),
    )


@query(
    "f8_binary_equal",
    ["customer"],
    "SELECT c_custkey, true AS hex_form, true AS hex_case, c_custkey % 2 = 0 AS changed_sometimes FROM customer",
)
def _(customer):
    name, digits = F.col("c_name"), F.hex("c_name")
    hex_text = F.concat(F.lit("\\x"), F.lower(digits))
    changed = F.when(F.col("c_custkey") % 2 == 0, hex_text).otherwise(F.lit("\\x00"))
    return customer.select(
        "c_custkey",
        coerce.binary_equal(name, hex_text).alias("hex_form"),
        coerce.binary_equal(digits, hex_text).alias("hex_case"),
        coerce.binary_equal(name, changed).alias("changed_sometimes"),
    )


@query(
    "f9_timestamp_equal",
    ["raw_customer"],
    """
SELECT id, created_at LIKE '% %' AS with_t_and_zone,
       replace(created_at, ' ', 'T') || CASE WHEN created_at LIKE '%Z' THEN '' ELSE 'Z' END AS normalized
FROM raw_customer
""",
)
def _(raw):
    t = F.col("created_at")
    swapped = F.concat(F.replace(t, F.lit(" "), F.lit("T")), F.lit("Z"))
    return raw.select(
        "id",
        coerce.timestamp_equal(t, swapped).alias("with_t_and_zone"),
        coerce.with_zone(t).alias("normalized"),
    )


@query(
    "f10_canonical_text",
    ["raw_customer"],
    """
SELECT id, CASE WHEN is_vip IN ('0', '1') THEN is_vip END AS flag,
       CASE WHEN metadata = '' THEN '' ELSE '[1,' || id || ']' END AS json,
       lower(hex(CAST(name AS BLOB))) AS bin,
       substr(created_at, 1, 10) || CASE WHEN created_at LIKE '%Z' THEN 'T11:30:00.000000Z' ELSE 'T10:00:00.000000Z' END AS instant,
       empty_at AS plain
FROM raw_customer
""",
)
def _(raw):
    kinds = {"flag": "is_vip", "json": "metadata", "bin": "name", "instant": "created_at", "plain": "empty_at"}
    names = {"bin": "binary", "instant": "timestamp", "plain": "text"}
    return raw.select(
        "id",
        *[coerce.canonical_text(F.col(c), names.get(k, k)).alias(k) for k, c in kinds.items()],
    )


@query(
    "f11_typed_row_diff",
    ["raw_customer"],
    """
SELECT id, CAST(1 AS BIGINT) AS mismatched, CAST(0 AS BIGINT) AS extra_source, CAST(0 AS BIGINT) AS extra_target
FROM raw_customer WHERE CAST(id AS BIGINT) % 23 = 0
""",
)
def _(raw):
    kinds = {"metadata": "json", "created_at": "timestamp", "is_vip": "flag"}
    source = raw.select("id", *kinds)
    # The same rows, each value spelled another way; every 23rd row changed.
    target = raw.select(
        "id",
        F.replace("metadata", F.lit(", "), F.lit(" ,  ")).alias("metadata"),
        F.when(F.expr("cast(id as bigint) % 23 = 0"), "2020-01-01")
        .otherwise(F.replace("created_at", F.lit(" "), F.lit("T")))
        .alias("created_at"),
        "is_vip",
    )
    left = diff.leftover_rows(source, target, ["id"], kinds=kinds)
    return diff.classify_keys(left, ["id"])


@query(
    "f12_report_value",
    ["documents"],
    """
SELECT doc_id, CASE WHEN length(text) > 64 THEN left(text, 64) || '...' ELSE text END AS short,
       left(lower(hex(encode(text))), 64)
         || CASE WHEN 2 * strlen(text) > 64 THEN '... (' || strlen(text) || ' bytes)' ELSE '' END AS blob
FROM documents
""",
)
def _(documents):
    return documents.select(
        "doc_id",
        text.report_value(F.col("text")).alias("short"),
        text.report_value(F.lower(F.hex("text")), is_blob=True).alias("blob"),
    )
