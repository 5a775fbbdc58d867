"""Session settings that the engine relies on, and a local session for tests."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def local_session(cpus: str = "*", partitions: int = 8, memory: str = "8g", **more: str) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("loomdex")
    settings = SETTINGS | {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.driver.host": "127.0.0.1",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in (settings | more).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
