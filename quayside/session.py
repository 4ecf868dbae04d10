"""Session settings and the shared work folder.

Iterative operators and file sinks need a folder every executor can reach. It
is the one the cluster names in ``spark.checkpoint.dir``; only a local master
with no such setting gets a folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Bytes of rows that a Python worker gets at a time.
BATCH_BYTES = 4 << 20
_local_work_dir: str | None = None


def build_session(
    app: str = "quayside", master: str | None = None, **conf: str
) -> SparkSession:
    """A session with the settings the operators are written for.

    AQE picks the partition counts and splits skewed joins, so the shuffle
    partition number is only an upper bound and is left to the caller.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def bounded_batches(spark: SparkSession) -> None:
    """Bound what one Python worker gets at a time, however long the rows.

    A batch otherwise grows with the split, as thousands of long records fit
    into one. The setting is the session's, since frames run after this returns.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def work_dir(spark: SparkSession) -> str:
    """The folder for written intermediate tables, shared by all executors."""
    global _local_work_dir
    named = spark.conf.get(_CHECKPOINT_KEY, None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError(
            f"{_CHECKPOINT_KEY} must name a folder shared by the executors"
        )
    if _local_work_dir is None:
        _local_work_dir = tempfile.mkdtemp(prefix="quayside-")
    return _local_work_dir


def new_path(spark: SparkSession, label: str) -> str:
    """A path below the work folder that nothing has written yet.

    Everything of one application lies in one folder, to be dropped as a whole
    once the application has ended.
    """
    app = spark.sparkContext.applicationId
    return f"{work_dir(spark)}/quayside-{app}/{label}-{uuid.uuid4().hex}"


def drop_work_files(spark: SparkSession) -> None:
    """Delete what this application wrote below the work folder.

    To be called when its last result has been consumed: frames that operators
    returned, and dumps or streams written to :func:`new_path`, read from there.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{work_dir(spark)}/quayside-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the work folder and read it back.

    Cuts the lineage: a lost executor rereads files instead of replaying the
    rounds before. Being columnar files, they also keep column pruning and
    give the optimizer true sizes for its broadcast decisions.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
