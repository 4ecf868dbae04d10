"""Column functions on small cases."""

import pytest
from pyspark.sql import functions as F

from quayside.functions import coerce, labels, statements, text


def column(spark, values, fn, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.select(fn(F.col("v")).alias("r"), "i").orderBy("i").select("r").collect()]


def pairs(spark, values, fn):
    rows = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "i int, a string, b string")
    out = rows.select(fn(F.col("a"), F.col("b")).alias("r"), "i").orderBy("i")
    return [r["r"] for r in out.collect()]


CASES = [
    # text, reads, destructive, returns rows
    ("select a from t", True, False, False),
    ("  -- why\n# how\n/* when */ SHOW TABLES", True, False, False),
    ("desc t", True, False, False),
    ("describes t", False, False, False),
    ("delete from t", False, True, False),
    ("/* keep */ Drop Table t", False, True, False),
    ("truncate t; select 1", False, True, False),
    ("select 1; truncate t", True, True, False),
    ("select 1\n  drop table t", True, True, False),
    ("select drop_me, dropped from t", True, False, False),
    ("select 'x; drop table t' as a, \"delete\" as b, `truncate` from t", True, False, False),
    ("select 'it''s; delete', 'back\\'; drop'", True, False, False),
    ("select 1 -- ; delete from t", True, False, False),
    ("select 1 /* ; delete from t", True, False, False),
    ("/*!50001 drop view v */", False, True, False),
    ("/*! select 1 */", True, False, False),
    ("alter table t add column dropped int", False, False, False),
    ("alter table t\ndrop column c", False, True, False),
    ("merge into t using s on t.i = s.i when matched\tthen delete", False, True, False),
    ("merge into t using s on t.i = s.i when matched then update set a = 1", False, False, False),
    ("with a as (select (1)), b as (select ')') select * from b", True, False, False),
    ("with recursive a (x) as not materialized (select 1) delete from t", False, True, False),
    ("with a as (select 1) insert into t select * from a returning i", False, False, True),
    ("update t set a = 'returning'", False, False, False),
    ("with broken as select 1", True, False, False),
    ("", False, False, False),
]


def test_statement_classes(spark):
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, q string")
    got = statements.classify(rows, "q").orderBy("i").collect()
    for row, (sql, reads, destructive, returns) in zip(got, CASES):
        assert (row.reads, row.destructive, row.returns_rows) == (reads, destructive, returns), sql


def test_long_literals_and_deep_nesting(spark):
    deep = "with a as (" + "(" * 300 + "select 1" + ")" * 300 + ") delete from t"
    many = "with a as (select 1) insert into t values " + ",".join(["(1, (2))"] * 20_000)
    long = "select '" + "''x\\'" * 200_000 + "; drop table t'"
    rows = spark.createDataFrame([(deep,), (long,), (many,)], "q string")
    got = statements.classify(rows, "q").collect()
    assert [r.destructive for r in got] == [True, False, False]
    assert [r.reads for r in got] == [False, True, False]


def test_escape_round_trip(spark):
    values = ["plain", "", "\\", "\\n", "\n", "a\\\nb\t\r\b\0\x1a'\"", "\\\\'", "ends with \\"]
    escaped = column(spark, values, text.escape_literal)
    assert not any(c in e for e in escaped for c in "\n\r\t\b\0\x1a")
    assert column(spark, escaped, text.unescape_literal) == values


def test_quoting(spark):
    assert text.quote_identifier("a`b") == "`a``b`"
    assert column(spark, ["a`b"], text.quoted_identifier) == ["`a``b`"]
    assert column(spark, ["it's"], text.quoted_literal) == ["'it''s'"]


def test_controls_are_stripped(spark):
    values = ["ok", "a\x1b[1mb", "x\u009by", "l1\nl2\x7f", ""]
    assert column(spark, values, text.strip_controls) == ["ok", "a[1mb", "xy", "l1l2", ""]
    kept = column(spark, values, lambda c: text.strip_controls(c, keep_newlines=True))
    assert kept[3] == "l1\nl2"


def test_shortening_counts_characters(spark):
    assert column(spark, ["äöü" * 4], lambda c: text.ellipsize(c, 5)) == ["äöüä…"]
    assert column(spark, ["abc"], lambda c: text.ellipsize(c, 3)) == ["abc"]
    assert column(spark, ["ab" * 40], lambda c: text.report_value(c, is_blob=True)) == ["ab" * 32 + "... (40 bytes)"]


def test_shapes(spark):
    uuid = "123E4567-e89b-12d3-a456-426614174000"
    assert column(spark, [uuid, f" {uuid} ", uuid[:-1], ""], coerce.is_uuid) == [True, True, False, False]
    times = ["2024-01-01", "2024-01-01 10:00", "2024-01-01t10:00:00.5+0130", "2024-01-01T", "1704067200", ""]
    assert column(spark, times, coerce.is_timestamp) == [True, True, True, False, False, False]
    documents = ['{"a": 1}', " [1, 2]", "7", '"x"', "{", ""]
    assert column(spark, documents, coerce.is_json) == [True, True, False, False, False, False]


def test_json_equality(spark):
    values = [
        ('{"a":1,"b":[1.0]}', '{ "b": [1], "a": 1e0 }'),
        ('{"a":"1.0"}', '{"a":"1"}'),
        ("plain", "plain"),
        ("{", "{"),
        (None, None),
        (None, ""),
    ]
    assert pairs(spark, values, coerce.json_equal) == [True, False, True, False, True, False]


def test_binary_equality(spark):
    values = [("hi", "\\x6869"), ("DEAD", "dead"), ("\\xDEAD", "dead"), ("hi", "\\x00"), ("hi", "ho"), (None, "a")]
    assert pairs(spark, values, coerce.binary_equal) == [True, True, True, False, False, False]


def test_timestamp_equality(spark):
    values = [
        ("2024-01-01 00:00:00", "2024-01-01T00:00:00Z"),
        ("2024-01-01T00:00:00+02:00", "2024-01-01 00:00:00+02:00"),
        ("2024-01-01", "2024-01-02"),
        ("", "2024-01-01"),
        ("", ""),
    ]
    assert pairs(spark, values, coerce.timestamp_equal) == [True, True, False, False, True]


def test_casts(spark):
    assert column(spark, ["0", "1", "2", None], coerce.to_flag) == [False, True, None, None]
    assert column(spark, [0, 1, 2], coerce.to_flag, "int") == [False, True, None]


def test_labels(spark):
    assert column(spark, [0, 59_999, 3_599_000, 3_600_000, 360_000_000], labels.compact_duration, "bigint") == [
        "-", "00:59", "59:59", "01:00:00", "100:00:00",
    ]
    assert column(spark, [1.005, 2.0, -1.234], labels.round2, "double") == [1.0, 2.0, -1.22]
    assert column(spark, [0, 10_239, 10_240, 10 * 1024**2, None], labels.size_label, "bigint") == [
        "0 bytes", "10239 bytes", "10 kB", "10 MB", None,
    ]
    states = ["idle in transaction (aborted)", "idle", "active"]
    assert column(spark, states, labels.state_label) == ["idle/xact (aborted)", "idle", "active"]
    working = column(spark, ["Sleep", "idle in transaction", "active", "", None], lambda c: labels.has_work(c, F.lit(" ")))
    assert working == [False, False, True, False, False]


@pytest.mark.parametrize("age,tier", [(2_999, "fresh"), (3_000, "stale"), (9_999, "stale"), (10_000, "very stale")])
def test_freshness(spark, age, tier):
    assert column(spark, [age], lambda c: labels.freshness_tier(c, F.lit(1000)), "bigint") == [tier]
