"""The folder for intermediate tables: what the cluster names in spark.checkpoint.dir; in one process a local one."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = f"file://{tempfile.mkdtemp(prefix='loomdex-')}"
        given = _own[app]
    return given.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """The table as it is written to the shared folder and read back: made once, with a plan that starts there."""
    path = f"{shared_dir(df.sparkSession)}/scratch-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
