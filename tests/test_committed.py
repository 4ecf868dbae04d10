"""Dumps that are whole or not there."""

import os

import pytest
from pyspark.sql import functions as F

from quayside.sinks import committed, restore
from quayside.sources import dumps


def names(path):
    return sorted(f for f in os.listdir(path) if not f.startswith("."))


def test_numbered_files_and_totals(spark, folder):
    df = spark.range(0, 20_000, 1, 3).select("id", F.repeat(F.lit("é;\n'"), 20).alias("t"), F.lit(None).cast("string").alias("n"))
    for form in ("sql", "csv", "json"):
        out = folder("dump")
        totals = committed.write_committed(df, out, "shop", "t", form, chunk_mb=0.25, record_bytes=20_000, null_token="\\N")
        files = [f for f in names(out) if not f.endswith(committed.TOTALS)]
        assert files == [f"shop.t.{n:05d}.{form}" for n in range(totals["files"])] and len(files) > 6
        sizes = [os.path.getsize(f"{out}/{f}") for f in files]
        assert sum(sizes) == totals["bytes"] and max(sizes) < 300_000 and totals["rows"] == 20_000
        if form == "sql":
            back = restore.typed_rows(dumps.dump_table(dumps.read_dump_dir(spark, out), "t", df.columns), df.schema)
        elif form == "csv":
            back = dumps.read_csv_dump(spark, f"{out}/*.csv", "id bigint, t string, n string", "\\N")
        else:
            back = dumps.read_json_dump(spark, f"{out}/*.json", df.columns).withColumn("id", F.col("id").cast("bigint"))
        assert back.count() == 20_000 and back.exceptAll(df).isEmpty()
        with pytest.raises(FileExistsError):
            committed.write_committed(df, out, "shop", "t", form)


def test_a_failed_job_leaves_nothing(spark, folder):
    out = folder("dump")
    bad = spark.range(0, 4_000, 1, 4).select(
        F.when(F.col("id") == 3_999, F.raise_error(F.lit("lost")).cast("bigint")).otherwise(F.col("id")).alias("id")
    )
    with pytest.raises(Exception, match="lost"):
        committed.write_committed(bad, out, "shop", "t", chunk_mb=0.001, record_bytes=100)
    assert names(out) == []
    assert committed.write_committed(spark.range(3_000), out, "shop", "t")["rows"] == 3_000


def test_tables_share_a_folder_and_may_be_empty(spark, folder):
    out = folder("dump")
    assert committed.write_committed(spark.range(0), out, "shop", "none")["files"] == 0
    assert committed.write_committed(spark.range(0, 5, 1, 1), out, "shop", "some", "json")["rows"] == 5
    assert names(out) == ["shop.none-totals", "shop.some-totals", "shop.some.00000.json"]
    with pytest.raises(ValueError):
        committed.write_committed(spark.range(5), out, "shop", "x", "xml")


def test_a_task_gets_bounded_batches(spark, folder, monkeypatch):
    base = committed._Writer

    class Writer(base):
        def write(self, iterator):
            def seen():
                for batch in iterator:
                    assert batch.nbytes < 8 << 20
                    yield batch

            return super().write(seen())

    class Sink(committed.DumpSink):
        def writer(self, schema, overwrite):
            return Writer(self.options)

    monkeypatch.setattr(committed, "DumpSink", Sink)
    rows = spark.range(0, 24, 1, 1).select("id", F.repeat(F.lit("é"), 500_000).alias("t"))
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    totals = committed.write_committed(rows, folder("dump"), "shop", "t", "csv")
    assert totals["rows"] == 24
