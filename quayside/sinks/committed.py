"""A dump sink that commits: numbered files and their totals, or nothing.

Tasks write files of bounded size into a staging folder and report their rows
and bytes. The commit on the driver numbers the files of all tasks, moves them
to their place and writes the totals last; a failed job leaves no file of its
own behind. Files of lost or repeated attempts stay in the staging folder, which
goes with the commit.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from quayside.functions.text import quote_identifier
from quayside.session import bounded_batches
from quayside.sinks.dump import CHUNK_MB, STATEMENT_BYTES, csv_header, csv_lines, json_lines, packer, row_text

#: The file of the totals; it ends like no dump file, so globs for those pass it by.
TOTALS = "-totals"


@dataclass
class Written(WriterCommitMessage):
    """What one task wrote: its rows, and path and bytes of its files."""

    rows: int
    files: list[tuple[str, int]]


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.options = dict(options)

    def _staging(self) -> str:
        return f"{self.options['folder']}/_staging-{self.options['job']}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        o = self.options
        limit, task = int(o["file_bytes"]), TaskContext.get()
        system, staging = _place(self._staging())
        head = o.get("file_head", "").encode()
        rows, files, out, size = 0, [], None, 0

        def counted() -> Iterator[pa.RecordBatch]:
            nonlocal rows
            for batch in iterator:
                rows += batch.num_rows
                yield batch

        pack = packer(int(o["record_bytes"]), o["between"], o.get("head", ""), o.get("tail", ""))
        try:
            for batch in pack(counted()):
                for record in batch.column("value").to_pylist():
                    if out is None:
                        # A second attempt of the task has another attempt id.
                        path = f"{staging}/{task.partitionId():07d}-{task.taskAttemptId()}-{len(files):05d}"
                        out, size = system.open_output_stream(path), len(head)
                        out.write(head)
                        files.append((path, 0))
                    line = record.encode() + b"\n"
                    out.write(line)
                    size += len(line)
                    files[-1] = files[-1][0], size
                    if size >= limit:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return Written(rows, files)

    def commit(self, messages: list[Written | None]) -> None:
        o = self.options
        system, folder = _place(o["folder"])
        files = sorted(f for m in messages if m for f in m.files)
        for n, (path, _) in enumerate(files):
            system.move(path, f"{folder}/{o['stem']}.{n:05d}.{o['form']}")
        totals = {
            "rows": sum(m.rows for m in messages if m), "bytes": sum(size for _, size in files), "files": len(files),
        }
        with system.open_output_stream(f"{folder}/{o['stem']}{TOTALS}") as out:
            out.write(json.dumps(totals).encode())
        self._drop_staging(system, folder)

    def abort(self, messages: list[Written | None]) -> None:
        self._drop_staging(*_place(self.options["folder"]))

    def _drop_staging(self, system: fs.FileSystem, folder: str) -> None:
        staging = f"{folder}/_staging-{self.options['job']}"
        if system.get_file_info(staging).type == fs.FileType.Directory:
            system.delete_dir(staging)


class DumpSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quayside_dump"

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options)


def _uri(spark: SparkSession, path: str) -> str:
    """The path with the scheme that Spark itself would take for it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(at).toUri()
    return f"{whole.getScheme()}://{whole.getAuthority() or ''}{whole.getPath()}"


def write_committed(
    df: DataFrame,
    folder: str,
    database: str,
    table: str,
    form: str = "sql",
    chunk_mb: float = CHUNK_MB,
    record_bytes: int = STATEMENT_BYTES,
    null_token: str = "",
) -> dict:
    """A table as ``database.table.NNNNN.form`` files beside each other, or an error.

    Rows become text in the JVM and go to the sink alone, in one stage without a
    shuffle. Returns rows, bytes, files, seconds and the rate, as added up from
    the tasks that were committed; they are also kept in ``database.table-totals``,
    which is written last and so tells a whole dump. A file ends with the record
    that reaches ``chunk_mb``. An empty table makes no file but its totals. A
    table of that name and form that the folder already has is an error, and so is
    a file system that pyarrow does not know. Repeated rows are
    kept, rows have no order.
    """
    spark, started = df.sparkSession, time.time()
    options = {"folder": _uri(spark, folder), "stem": f"{database}.{table}", "form": form, "job": uuid.uuid4().hex,
               "file_bytes": str(int(chunk_mb * 1024 * 1024)), "record_bytes": str(record_bytes), "between": "\n"}
    if form == "sql":
        lines = row_text(df)
        names = ",".join(quote_identifier(c) for c in df.columns)
        options |= {"between": ",\n", "head": f"INSERT INTO {quote_identifier(table)}({names}) VALUES\n", "tail": ";"}
    elif form == "csv":
        lines = csv_lines(df, null_token)
        options["file_head"] = csv_header(df.columns)
    elif form == "json":
        lines = json_lines(df)
    else:
        raise ValueError("form must be sql, csv or json")
    system, place = _place(options["folder"])
    totals = f"{place}/{options['stem']}{TOTALS}"
    if system.get_file_info(totals).type != fs.FileType.NotFound:
        raise FileExistsError(f"{folder} already holds {options['stem']}")
    # Made here and not by the tasks: one that still runs when the job has failed would make it anew.
    system.create_dir(f"{place}/_staging-{options['job']}", recursive=True)
    spark.dataSource.register(DumpSink)
    bounded_batches(spark)
    lines.toDF("value").write.format(DumpSink.name()).options(**options).mode("append").save()
    found = json.loads(system.open_input_stream(totals).read())
    seconds = time.time() - started
    return {"table": table, **found, "seconds": seconds, "mb_per_second": found["bytes"] / 1024 / 1024 / seconds}
