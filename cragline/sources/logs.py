"""Text inputs: cover profiles, timing logs, status text."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import cover_blocks
from ..operators.profiling import timing_entries


def lines(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    reader = spark.read if pattern is None else spark.read.option("pathGlobFilter", pattern)
    return reader.text(path).withColumnRenamed("value", "line")


def read_cover_profile(spark: SparkSession, path: str) -> DataFrame:
    return cover_blocks(lines(spark, path))


def read_timings(spark: SparkSession, folder: str) -> DataFrame:
    """key, micros of all ``*.jsonl`` logs of a folder; none if there is no such folder."""
    if "://" not in folder and not os.path.isdir(folder):
        return spark.createDataFrame([], "key string, micros long")
    return timing_entries(lines(spark, folder, "*.jsonl"))


def source_lines(spark: SparkSession, text: str) -> DataFrame:
    """A small text held by the driver, line by line."""
    return spark.createDataFrame([(x,) for x in text.splitlines()], "line string").select(F.col("line"))
