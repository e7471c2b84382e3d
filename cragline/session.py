"""Session settings that all queries assume."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
}


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine, for the command line, tests and the benchmark."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("cragline").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    for k, v in SETTINGS.items():
        builder = builder.config(k, v)
    spark = builder.config("spark.sql.shuffle.partitions", str(partitions)).config("spark.driver.memory", memory).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
