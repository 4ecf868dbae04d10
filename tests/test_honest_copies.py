"""Changes that a lenient comparison would let pass."""

import pytest
from pyspark.sql import functions as F

from quayside.functions import coerce
from quayside.operators import diff, infer
from quayside.sinks import dump, restore
from quayside.sources import records


def test_changes_below_a_second_are_seen(spark):
    kinds = {"ts": "timestamp"}
    one = spark.createDataFrame([(1, "2024-01-01 00:00:00.100")], "id int, ts string")
    two = spark.createDataFrame([(1, "2024-01-01 00:00:00.900")], "id int, ts string")
    same = spark.createDataFrame([(1, "2024-01-01T00:00:00.1Z")], "id int, ts string")
    assert diff.leftover_rows(one, two, ["id"], kinds=kinds).count() > 0
    assert diff.leftover_rows(one, same, ["id"], kinds=kinds).count() == 0


def test_equal_text_is_equal_json(spark):
    rows = spark.createDataFrame([('{"a":1,"a":1}', '{"a":1,"a":1}'), ('{"a":1,"a":1}', '{"a":2}')], "a string, b string")
    assert [r[0] for r in rows.select(coerce.json_equal(F.col("a"), F.col("b"))).collect()] == [True, False]


def test_verify_fails_on_one_changed_row(spark):
    one = spark.range(10).select("id", F.lit("v").alias("v"))
    two = one.withColumn("v", F.when(F.col("id") == 7, "w").otherwise(F.col("v")))
    by_check = lambda t: {r.check: r.matched for r in diff.verify_tables({"t": (one, t, ["id"])}).collect()}
    assert by_check(two)["table_content"] is False and by_check(one)["table_content"] is True


def test_samples_take_null_and_repeated_keys(spark):
    rows = [(None, "a"), (1, "b"), (1, "b"), (1, "b"), (2, "c")]
    one = spark.createDataFrame(rows, "k int, v string")
    same = diff.sampled_comparison("t", one, one, ["k"]).collect()
    assert len(same) == 3 and all(r.matched for r in same)
    fewer = spark.createDataFrame(rows[:2] + rows[4:], "k int, v string")
    said = {r.message: r.matched for r in diff.sampled_comparison("t", one, fewer, ["k"]).collect()}
    assert said["1 differs in copies"] is False and sum(said.values()) == 2


def test_numbers_that_do_not_fit_are_counted(spark):
    df = spark.createDataFrame([("0.1234567890123456789012",), ("1.50",), ("1e2",), ("123456789012345678901234567890",), ("1e-30",)], "v string")
    types = {"v": "decimal(38,18)"}
    assert infer.rejected_values(df, "t", types).first().rejected == 3
    kept = [r.v for r in infer.typed_load(df, types).collect()]
    assert [str(v) if v is not None else None for v in kept] == [None, "1.500000000000000000", "100.000000000000000000", None, None]
    assert infer.TextColumn("v", "DECIMAL(40,2)").plain_type() == "string"


def test_large_ids_of_sessions_stay(spark, folder):
    path = folder("wire")
    line = '{"captured_at":"2024-01-01T00:00:00Z","data":[{"pid":3000000000,"blocked_by":[4000000000]}]}'
    spark.createDataFrame([(line,)], "value string").write.text(path)
    row = records.snapshot_sessions(records.read_snapshots(spark, path)).select("pid", "blocked_by").first()
    assert tuple(row) == (3_000_000_000, [4_000_000_000])


def test_two_databases_with_one_table_name(spark, folder):
    out, target = folder("dump"), folder("back")
    for db, n in (("a", 3), ("b", 5)):
        dump.write_schema(spark.range(n), out, db, "t")
        dump.write_sql(spark.range(n), out, db, "t")
    assert restore.check_statements(spark, out) == {"a.t": 3, "b.t": 5}
    loaded = restore.restore(spark, out, restore.save_to_folder(target), read_back=restore.restored(spark, target))
    assert loaded == {"a.t": 3, "b.t": 5}
    with pytest.raises(ValueError, match="several databases hold t"):
        restore.restore(spark, out, restore.save_to_folder(folder("x")), target_database="c")
