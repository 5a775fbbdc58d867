"""Where intermediate tables go: the folder the session names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CONF = "spark.checkpoint.dir"
#: Spark's setting that drops a query's shuffle files as soon as it has ended, not when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of a batch that goes to a Python worker and back. Spark's 10,000 of whole texts or token sets are tens of MB, held
#: several times over: in the executor outside its heap and in the worker.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; only a session in one process (a local test) gets one of its own."""
    given = spark.conf.get(CONF, None)
    if given is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"{CONF} must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = f"file://{tempfile.mkdtemp(prefix='loomdex-')}"
        given = _own[app]
    return given.rstrip("/")


def materialize(df: DataFrame, **options: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts lineage, survives lost executors. options: of the Parquet writer.

    What the write shuffled goes with it, as nothing reads it again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    before = {CLEANUP: spark.conf.get(CLEANUP, "false"), BATCH: spark.conf.get(BATCH)}
    spark.conf.set(CLEANUP, "true")
    # 0 or less stands for no limit.
    spark.conf.set(BATCH, str(min(int(before[BATCH]), BATCH_ROWS) if int(before[BATCH]) > 0 else BATCH_ROWS))
    try:
        df.write.options(**options).parquet(path)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    out = spark.read.schema(df.schema).parquet(path)
    out._loomdex_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of materialize that nothing will read again, through Hadoop's file systems."""
    for df in tables:
        spark, path = df.sparkSession, df._loomdex_path
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
