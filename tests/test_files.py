"""Dumps, restores, traces and streams on files."""

import pathlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.plans.copyjobs import CopyError
from quayside.sinks import dump, restore, results, trace
from quayside.sources import crossing, dumps, quoted, records, statements
from quayside.streaming import captures

WIDE = "id int, name string, empty string, nothing string, amount decimal(10,2), at timestamp_ntz, flag boolean, raw binary, ratio double"


def wide(spark):
    rows = [
        (1, 'say "hi"', "", None, "210.01", "2024-01-01 10:00:00", "true", "deadbeef", "0.1"),
        (2, "a;\nb\\n'c'\t(1,2)", "", None, "-0.50", None, None, "", "1.0E30"),
        (3, "), (NULL, 'x'", " pad ", None, None, "1999-12-31 23:59:59.5", "false", None, None),
    ]
    text = spark.createDataFrame(rows, "id int, name string, empty string, nothing string, amount string, at string, flag string, raw string, ratio string")
    casts = {"amount": "decimal(10,2)", "at": "timestamp_ntz", "flag": "boolean", "ratio": "double"}
    return text.withColumns({c: F.col(c).cast(t) for c, t in casts.items()}).withColumn("raw", F.unhex("raw"))


def by_id(df):
    return sorted(map(tuple, df.collect()))


def test_sql_dump_restores_every_value(spark, folder):
    out, target = folder("dump"), folder("restored")
    df = wide(spark)
    totals = dump.write_sql(df, out, "shop", "wide", statement_bytes=10)
    assert totals["rows"] == 3 and totals["bytes"] > 100 and totals["mb_per_second"] > 0
    dump.write_schema(df, out, "shop", "wide")
    loaded = restore.restore(
        spark, out, restore.save_to_folder(target), read_back=restore.restored(spark, target)
    )
    assert loaded == {"shop.wide": 3}
    back = spark.read.parquet(f"{target}/shop/wide")
    assert by_id(back) == by_id(df)
    assert back.dtypes == df.dtypes


def test_statements_close_at_their_size(spark, folder):
    df = spark.range(0, 1000, 1, 1).select(F.col("id"), F.lit("x" * 40).alias("v"))
    out = folder("dump")
    dump.write_sql(df, out, "shop", "t", statement_bytes=5_000)
    sizes = [r[0] for r in dumps.read_inserts(spark, f"{out}/*.sql").select(F.size("tuples")).collect()]
    assert sum(sizes) == 1000
    row = len('(0,"' + "x" * 40 + '")')
    assert all((n - 1) * row < 5_000 for n in sizes)


def test_restore_options(spark, folder):
    out, df = folder("dump"), wide(spark).select("id", "name")
    for name in ("a", "b", "c"):
        dump.write_schema(df, out, "shop", name)
        dump.write_json(df, out, "shop", name)
    only = folder("only")
    restore.restore(spark, out, restore.save_to_folder(only), "json", "copy", start="b", end="b", schema_only=True)
    assert spark.read.parquet(f"{only}/copy/b").count() == 0
    assert not pathlib.Path(only, "copy", "a").exists()
    back = restore.restored(spark, only)
    append = restore.save_to_folder(only, "append")
    for _ in range(2):
        added = restore.restore(spark, out, append, "json", "copy", "b", "b", data_only=True, read_back=back)
        assert added == {"shop.b": 3}
    assert back("copy", "b").count() == 6
    with pytest.raises(ValueError, match="exclude each other"):
        restore.restore(spark, out, restore.save_to_folder(only), schema_only=True, data_only=True)
    with pytest.raises(CopyError, match="expected 3"):
        restore.restore(
            spark, out, restore.save_to_folder(folder("x")), "json", read_back=lambda d, t: spark.range(2)
        )


def test_large_statements_are_refused(spark, folder):
    out = folder("dump")
    dump.write_sql(spark.range(100), out, "shop", "t")
    with pytest.raises(ValueError, match="larger than 50 bytes"):
        restore.check_statements(spark, out, 50)


def write(path, name, text):
    pathlib.Path(path).mkdir(parents=True, exist_ok=True)
    pathlib.Path(path, name).write_text(text)


def local(path):
    return path.removeprefix("file:")


SQLITE = """-- an export
PRAGMA foreign_keys=OFF;

CREATE TABLE notes (id INTEGER PRIMARY KEY, body TEXT);

INSERT INTO notes (id, body) VALUES
  (1, 'it''s (one), two'),
  (2, NULL);
INSERT INTO "other one" VALUES (7,'C:\\',x'00',-1.5e3,("a" || 'b'));
insert into notes (id, body) values (3, '');
INSERT INTO notes (id, body) VALUES (4, 'cut;
here');
"""


@pytest.mark.parametrize("ends", ["\n", "\r\n"])
def test_sqlite_dump(spark, folder, ends):
    path = local(folder("sqlite"))
    write(path, "export.sql", SQLITE.replace(";\nINSERT", f"; {ends}INSERT").replace(");\n", f");{ends}"))
    inserts = dumps.read_inserts(spark, path, "sqlite")
    assert dumps.quarantined(inserts).count() == 0
    rows = dumps.read_sql_dump(spark, path, "sqlite")
    notes = dumps.dump_table(rows, "notes", ["id", "body"], "sqlite")
    assert sorted(map(tuple, notes.collect()), key=str) == [
        ("1", "it's (one), two"), ("2", None), ("3", ""), ("4", "cut;\nhere"),
    ]
    other = dumps.dump_table(rows, "other one", list("abcde"), "sqlite").first()
    assert tuple(other) == ("7", "C:\\", "x'00'", "-1.5e3", "(\"a\" || 'b')")
    counts = {r.table_name: r.rows for r in dumps.statement_rows(inserts).collect()}
    assert counts == {"notes": 4, "other one": 1}


def test_statements_lie_across_splits(spark, folder):
    path = local(folder("splits"))
    body = "".join(f"/* it's; {i} */ INSERT INTO t VALUES ({i}, 'a;b\\';{i}', \"x;\"); -- don't; stop\n" for i in range(400))
    write(path, "a.sql", body + "INSERT INTO t VALUES (400, '" + ";long" * 3000 + "');\n")
    write(path, "b.sql", "INSERT INTO t VALUES (401, 'x', 'y');INSERT INTO t VALUES (402, 'never; closed")
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "777")
    try:
        inserts = dumps.read_inserts(spark, path)
        lost = dumps.quarantined(inserts).collect()
        assert [r.statement for r in lost] == ["INSERT INTO t VALUES (402, 'never; closed"]
        with pytest.raises(Exception, match="does not come apart"):
            dumps.dump_table(dumps.read_sql_dump(spark, path), "t", ["a"]).collect()
        rows = dumps.dump_table(dumps.read_sql_dump(spark, path, skip_broken=True), "t", ["a", "b"]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    found = {int(r.a): r.b for r in rows}
    assert sorted(found) == list(range(402)) and len(rows) == 402
    assert found[7] == "a;b';7" and found[400] == ";long" * 3000


def test_flat_dump_files_are_told_apart(spark, folder):
    path = local(folder("flat"))
    for name in ("shop-schema-create.sql", "shop.t-schema.sql", "shop.v-schema-view.sql", "shop.t.00001.sql", "shop.t.00012.sql", "metadata"):
        write(path, name, 'INSERT INTO `t`(`id`) VALUES\n(1),\n("2");\n')
    found = {(r.kind, r.table_name, r.part) for r in dumps.list_dump(spark, path).collect()}
    assert ("data", "t", 12) in found and ("data", "t", 1) in found
    assert {k for k, _, _ in found} == {"database", "schema", "view", "data"}
    rows = dumps.read_dump_dir(spark, path)
    assert sorted(r.id for r in dumps.dump_table(rows, "t", ["id"]).collect()) == ["1", "1", "2", "2"]


def test_numbered_files_restore_with_a_given_schema(spark, folder):
    path, target = local(folder("flat")), folder("restored")
    write(path, "shop.t.00001.sql", 'INSERT INTO `t`(`id`,`v`) VALUES\n(1,"a"),\n(2,NULL);\n')
    write(path, "shop.t.00002.sql", 'INSERT INTO `t`(`id`,`v`) VALUES\n(3,"c\\n");\n')
    schema = T.StructType().add("id", T.IntegerType()).add("v", T.StringType())
    loaded = restore.restore(
        spark, path, restore.save_to_folder(target), read_back=restore.restored(spark, target), schemas={"shop.t": schema}
    )
    assert loaded == {"shop.t": 3}
    assert by_id(spark.read.parquet(f"{target}/shop/t")) == [(1, "a"), (2, None), (3, "c\n")]


def test_csv_keeps_null_apart_with_a_token(spark, folder):
    df = spark.createDataFrame([("a", None), ("b", ""), ('c,"d"\n', " x ")], "k string, v string")
    for token, want in (("", [None, None, " x "]), ("\\N", [None, "", " x "])):
        out = folder("csv")
        dump.write_csv(df, out, "shop", "t", null_token=token)
        back = dumps.read_csv_dump(spark, dump.data_path(out, "shop", "t", "csv"), "k string, v string", token)
        rows = sorted(back.collect())
        assert [r.v for r in rows] == want
        assert rows[2].k == 'c,"d"\n'


def test_json_values_are_text_unless_typed(spark):
    df = spark.createDataFrame([(42, None)], "id int, v string")
    assert dump.json_lines(df).first().value == '{"id":"42","v":null}'
    assert dump.json_lines(df, typed=True).first().value == '{"id":42,"v":null}'


def test_schema_survives(spark, folder):
    schema = T.StructType([T.StructField("a`b", T.DecimalType(9, 3), False), T.StructField("c", T.ArrayType(T.IntegerType()))])
    out = folder("schema")
    dump.write_schema(spark.createDataFrame([], schema), out, "shop", "t")
    assert restore.read_schemas(spark, out) == {"shop.t": schema}


# Traces

RECORD = '{"at":"2024-01-01T00:00:00Z","capture":{"captured_at":"2024-01-01T00:00:00Z","connections":[{"pid":1,"duration":5000000000}],"sort":"xact_start"}}'


def kinds(spark, *lines):
    df = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "i int, value string")
    return [r.kind for r in records.classify_trace(df).orderBy("i").collect()]


def test_trace_lines_are_told_apart(spark):
    assert kinds(
        spark,
        trace.header_line("o", "d", "b", "2024-01-01T00:00:00Z", instance="i1"),
        RECORD,
        RECORD[:-30],
        "not json",
        '{"type":"capture_start","schema_version":2}',
        '{"type":"note"}',
        RECORD.replace('"pid"', '"pids"'),
        RECORD.replace('"sort"', '"order"'),
        RECORD.replace('{"at"', '{"by":1,"at"'),
    ) == ["header", "record", "torn", "malformed", "wrong version", "wrong type", *["unknown field"] * 3]


def test_one_torn_line_is_passed_over(spark, folder):
    path = local(folder("trace"))
    write(path, "a.txt", f"{RECORD}\n\n{RECORD[:40]}")
    records.check_trace(records.read_trace(spark, path))
    durations = records.trace_sessions(records.read_trace(spark, path)).collect()
    assert [r.duration_ms for r in durations] == [5000]
    write(path, "b.txt", f"{RECORD[:40]}\n{RECORD[:50]}\n{RECORD}")
    with pytest.raises(ValueError, match="torn"):
        records.check_trace(records.read_trace(spark, path))


def test_a_torn_line_in_the_middle_is_an_error(spark, folder):
    path = local(folder("trace"))
    write(path, "a.txt", f"{RECORD}\n{RECORD[:40]}\n{RECORD}\n")
    with pytest.raises(ValueError, match="torn"):
        records.check_trace(records.read_trace(spark, path))


def test_chunks_stay_below_their_bound(spark, folder):
    out = folder("dump")
    df = spark.range(0, 40_000, 1, 2).select("id", F.repeat(F.lit("é,\n"), 40).alias("t"), F.lit(None).cast("string").alias("n"))
    dump.write_csv(df, out, "shop", "t", null_token="\\N", chunk_mb=1, record_bytes=50_000)
    dump.write_json(df, out, "shop", "t", chunk_mb=1, record_bytes=50_000)
    for form in ("csv", "json"):
        sizes = [r.length for r in spark.read.format("binaryFile").load(dump.data_path(out, "shop", "t", form)).collect()]
        assert len(sizes) >= 6 and max(sizes) < 1_200_000
    back = dumps.read_csv_dump(spark, dump.data_path(out, "shop", "t", "csv"), "id bigint, t string, n string", "\\N")
    assert back.exceptAll(df).isEmpty() and back.count() == 40_000
    dump.write_csv(df.where("id < 0"), out, "shop", "none")
    lines = spark.read.text(dump.data_path(out, "shop", "none", "csv"))
    assert {r.value for r in lines.collect()} == {"id,t,n", ""}
    dump.write_csv(df.limit(0), out, "shop", "planned")
    for name in ("none", "planned"):
        path = dump.data_path(out, "shop", name, "csv")
        assert dumps.read_csv_dump(spark, path, "id bigint, t string, n string").isEmpty()


def test_packed_rows_are_closed_by_their_bytes(spark):
    rows = spark.createDataFrame([("é" * n,) for n in (1, 2, 3, 4, 1, 1, 9)], "row string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        packed = [r.value for r in dump.pack_rows(rows, 8, "|", "<", ">").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert packed == ["<é|éé|ééé>", "<éééé>", "<é|é|ééééééééé>"]


def test_header_only_trace_is_an_error(spark, folder):
    path = local(folder("trace"))
    write(path, "a.txt", trace.header_line("o", "d", "b", "2024-01-01T00:00:00Z") + "\n")
    with pytest.raises(ValueError, match="no records"):
        records.check_trace(records.read_trace(spark, path))


# Streams


def test_held_snapshot_lives_across_batches(spark, folder):
    source, out, checkpoint = local(folder("index")), folder("shown"), folder("checkpoint")
    schema = "source string, snapshot bigint, unreachable bigint"

    def land(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        held = captures.hold_last_good(spark.readStream.schema(schema).parquet(source))
        writer = held.writeStream.format("parquet").option("path", out).outputMode("append")
        captures.start(writer, checkpoint).awaitTermination()

    land([("a", 1, 1), ("a", 2, 2), ("b", 1, 0)])
    run()
    land([("a", 3, 0), ("a", 4, 1), ("b", 2, 1)])
    run()
    shown = {(r.source, r.snapshot): r.shown_snapshot for r in spark.read.parquet(out).collect()}
    assert shown == {("a", 1): 1, ("a", 2): 1, ("a", 3): 3, ("a", 4): 3, ("b", 1): 1, ("b", 2): 1}


def test_capture_stream_repeats_nothing_on_restart(spark, folder):
    landed, out, checkpoint = local(folder("landed")), folder("trace"), folder("checkpoint")
    document = '{"captured_at":"2024-01-01T00:00:0%dZ","instances":[{"id":"i","role":"primary"}],"data":[{"pid":%d,"instance":"i","duration_ms":7}]}'
    header = trace.header_line("o", "d", "b", "2024-01-01T00:00:00Z")
    write(landed, "1.json", document % (1, 11))
    captures.capture(spark, landed, out, checkpoint, header).awaitTermination()
    write(landed, "2.json", document % (2, 12))
    captures.capture(spark, landed, out, checkpoint, header).awaitTermination()
    lines = captures.read_capture(spark, out)
    records.check_trace(lines)
    rows = records.trace_sessions(lines).orderBy("pid").collect()
    assert [(r.pid, r.instance_role, r.duration_ms) for r in rows] == [(11, "primary", 7), (12, "primary", 7)]
    assert lines.where("kind = 'header'").count() == 1


def test_python_workers_get_bounded_batches(spark, folder, monkeypatch):
    """Long rows and records are not gathered by the thousand."""
    rows = spark.range(0, 24, 1, 1).select("id", F.repeat(F.lit("é"), 500_000).alias("t"))
    kept = dump.packer

    def watched(*args, **named):
        pack = kept(*args, **named)

        def run(batches):
            def seen():
                for batch in batches:
                    assert batch.nbytes < 8 << 20
                    yield batch

            return pack(seen())

        return run

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    monkeypatch.setattr(dump, "packer", watched)
    out = folder("dump")
    dump.write_csv(rows, out, "shop", "t")

    def step(state, texts):
        assert texts.nbytes < 8 << 20
        return [state] * len(texts)

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    lines = crossing.read_records(spark, dump.data_path(out, "shop", "t", "csv"), "\n", (crossing.OUTSIDE,), step)
    assert lines.where("NOT first AND record <> ''").count() == 24


@pytest.mark.parametrize("form", ["sql", "csv"])
def test_dumps_and_results_are_lexed_in_bounded_batches(spark, folder, monkeypatch, request, form):
    """The steps of k1_sql_dump_text and of k7_results."""
    rows = spark.range(0, 12, 1, 1).select("id", F.repeat(F.lit("é"), 500_000).alias("t"))

    def watched(step):
        def run(state, texts):
            assert texts.nbytes < 8 << 20
            return step(state, texts)

        return run

    kept = statements._stepper
    monkeypatch.setattr(statements, "_stepper", lambda dialect: watched(kept(dialect)))
    monkeypatch.setattr(quoted, "_quotes", watched(quoted._quotes))
    out = folder("out")
    # All of it is one split.
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.files.minPartitionNum"))
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    if form == "sql":
        dump.write_sql(rows, out, "shop", "t", statement_bytes=200_000)
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        back = dumps.dump_table(dumps.read_sql_dump(spark, f"{out}/*.sql"), "t", rows.columns)
    else:
        results.write_result(results.one_line_values(rows), out, "csv")
        back = dumps.read_csv_dump(spark, out, "id string, t string")
    assert back.agg(F.count("*"), F.sum(F.length("t"))).first()[:] == (12, 6_000_000)
