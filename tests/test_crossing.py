"""Files cut into records where a split begins anywhere in them."""

import csv
import io
import os
import random

import pytest
from pyspark.sql import functions as F

from quayside.sources import dumps, quoted, records, statements

SPLIT = "spark.sql.files.maxPartitionBytes"
OPEN = "spark.sql.files.openCostInBytes"


@pytest.fixture
def splits(spark):
    """Cuts files into splits of some bytes, several to a task."""
    kept = {k: spark.conf.get(k) for k in (SPLIT, OPEN)}

    def cut(size):
        spark.conf.set(SPLIT, str(size))
        spark.conf.set(OPEN, "1")

    yield cut
    for k, v in kept.items():
        spark.conf.set(k, v)


def write(folder, name, texts):
    path = folder(name)
    os.makedirs(path)
    for i, text in enumerate(texts):
        with open(f"{path}/{i}.{name}", "w", newline="", encoding="utf-8") as f:
            f.write(text)
    return path


def csv_file(rows, end="\n"):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=end)
    writer.writerow(["id", "a", "b"])
    writer.writerows(rows)
    return out.getvalue()


def some_rows(rng, n):
    words = ['"', "\n", ",", "é", "x", "\r\n", "\n\n", 'say "hi"', "", " "]
    return [(str(i), "".join(rng.choices(words, k=rng.randint(0, 9))), "v" * rng.randint(0, 30) + "\n" * rng.randint(0, 60)) for i in range(n)]


@pytest.mark.parametrize("size", [30, 333, 1 << 20])
def test_quoted_rows_at_any_split(spark, folder, splits, size):
    rng = random.Random(size)
    parts = [some_rows(rng, 60), some_rows(rng, 1), [], some_rows(rng, 25)]
    path = write(folder, "csv", [csv_file(rows) for rows in parts] + [""])
    splits(size)
    got = quoted.read_quoted(spark, path, "id string, a string, b string", nullValue="\\N", emptyValue="")
    # Without a token of its own for null, a bare empty value is null.
    found = sorted((r.id, r.a or "", r.b or "") for r in got.collect())
    assert found == sorted(r for rows in parts for r in rows)


def test_quoted_rows_equal_a_scan_of_whole_files(spark, folder, splits):
    rows = some_rows(random.Random(1), 300)
    path = write(folder, "csv", [csv_file(rows)])
    schema = "id bigint, a string, b string"
    whole = spark.read.csv(path, schema=schema, header=True, quote='"', escape='"', multiLine=True).collect()
    splits(1_500)
    got = records.read_query_patterns(spark, path, schema)
    assert got.rdd.getNumPartitions() > 8
    assert sorted(map(str, got.collect())) == sorted(map(str, whole))
    assert records.read_query_patterns(spark, path).columns == ["id", "a", "b"]


def test_quoted_rows_of_other_systems(spark, folder, splits):
    path = write(folder, "csv", [csv_file([("1", "x\r\ny", "z"), ("2", "", "w")], "\r\n") + "\r\n"])
    for size in (5, 1000):
        splits(size)
        got = quoted.read_quoted(spark, path, "id int, a string, b string").collect()
        assert sorted(map(tuple, got)) == [(1, "x\r\ny", "z"), (2, None, "w")]


@pytest.mark.parametrize("size", [9, 1000])
def test_an_open_quote_fails(spark, folder, splits, size):
    path = write(folder, "csv", ['id,a,b\n1,x,y\n2,"x\ny,z\n' + "3,\n" * 9])
    splits(size)
    with pytest.raises(Exception, match="a quote is left open"):
        quoted.read_quoted(spark, path, "id int, a string, b string").collect()


def plain_statements(text, dialect):
    """Statement by statement, in one go over the text."""
    out, held, state = [], [], statements.CODE
    for piece in text.split(";") if not text.endswith(";") else text[:-1].split(";"):
        held.append(piece)
        state = statements.advance(state, piece, dialect)
        if state == statements.CODE:
            out.append((";".join(held), True))
            held = []
    if held:
        out.append((";".join(held), False))
    return out


def bare(text):
    """Without the comments before it."""
    text = text.strip()
    while text.startswith(("--", "/*")):
        _, _, text = text.partition("\n" if text.startswith("--") else "*/")
        text = text.strip()
    return text


@pytest.mark.parametrize("dialect", ["mysql", "sqlite"])
@pytest.mark.parametrize("size", [48, 1 << 20])
def test_statements_at_any_split(spark, folder, splits, dialect, size):
    rng = random.Random(size)
    tokens = ["INSERT", "';'", '"a;b"', "'it''s;'", "`c;`", ";", ";\n", ";", "-- x;'\n", "/* ;' */", " ", "1", "'" + "p;" * 40 + "'"]
    texts = ["".join(rng.choices(tokens, k=150)) + end for end in (";", "", "'open;" + "q;" * 50)]
    path = write(folder, "sql", texts)
    splits(size)
    got = statements.read_statements(spark, path, dialect).select(
        F.regexp_extract("file", r"/(\d+)\.sql$", 1).cast("int").alias("i"), "statement", "ended"
    )
    told = sorted(map(tuple, got.collect()))
    plain = [(i, bare(s), ended) for i, text in enumerate(texts) for s, ended in plain_statements(text, dialect)]
    assert told == sorted(r for r in plain if r[1])


def test_a_literal_over_many_splits(spark, folder, splits):
    text = "".join(f"INSERT INTO `t` VALUES ({i},'{'a;b\n' * (5_000 if i == 7 else 3)}');\n" for i in range(20))
    path = write(folder, "sql", [text])
    splits(2_000)
    rows = dumps.dump_table(dumps.read_sql_dump(spark, path), "t", ["id", "v"]).collect()
    assert sorted((int(r.id), len(r.v)) for r in rows) == [(i, 4 * (5_000 if i == 7 else 3)) for i in range(20)]
