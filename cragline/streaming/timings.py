"""Timing logs as they are written: the batch fold, kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.profiling import timing_entries, timing_stats


def stream_timings(spark: SparkSession, folder: str) -> DataFrame:
    """A streaming frame of timing statistics by key over a folder that gains ``*.jsonl`` logs.

    All of its aggregates merge, so the state is one row a key. Write it in update or complete mode.
    """
    lines = spark.readStream.option("pathGlobFilter", "*.jsonl").text(folder).withColumnRenamed("value", "line")
    return timing_stats(timing_entries(lines))
