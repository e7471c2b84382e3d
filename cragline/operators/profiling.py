"""Timing logs: folding, attribution to functions, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOISE_US = 30.0
TOP = 20


def timing_entries(lines: DataFrame, column: str = "line") -> DataFrame:
    """key, micros of well-formed lines (key, tab, whole number); all others are dropped."""
    parts = F.split(F.col(column), "\t", 2)
    key, rest = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    rows = lines.where(F.col(column).contains("\t")).select(key.alias("key"), rest.alias("rest"))
    # a cast alone would trim blanks
    return rows.where((F.col("key") != "") & F.col("rest").rlike(r"\A[+-]?[0-9]+\z")).select("key", F.col("rest").try_cast("long").alias("micros")).where("micros IS NOT NULL")


def timing_stats(entries: DataFrame) -> DataFrame:
    """Calls, total, least and largest micros of each key, summed map-side first; the largest is 0 at least."""
    return entries.groupBy("key").agg(F.count("*").alias("calls"), F.sum("micros").alias("total_us"), F.min("micros").alias("min_us"), F.greatest(F.max("micros"), F.lit(0)).alias("max_us"))


def mean_us(calls: Column, total: Column) -> Column:
    return F.when(calls == 0, F.lit(0.0)).otherwise(total.cast("double") / calls.cast("double"))


def attributed(funcs: DataFrame, stats: DataFrame) -> DataFrame:
    """Functions with bodies joined to their timings by path and display name; functions of one name each get the whole."""
    own = funcs.where("has_body").select("path", "ordinal", "display_name", "start_line", F.concat_ws("|", "path", "display_name").alias("key"))
    return own.join(stats, "key").select("path", "ordinal", "display_name", "start_line", "calls", "total_us", "min_us", "max_us")


def ranked(profiles: DataFrame, top: int = 0) -> DataFrame:
    """By falling total, with mean and share of all rows' total; top > 0 keeps the first rows, the share stays one of all.

    The total is a table of one row, so that no window gathers all functions.
    """
    total = profiles.agg(F.sum("total_us").cast("double").alias("_all"))
    share = F.when(F.col("_all") <= 0, F.lit(0.0)).otherwise(F.col("total_us").cast("double") / F.col("_all") * 100)
    rows = profiles.join(F.broadcast(total)).select(*profiles.columns, mean_us(F.col("calls"), F.col("total_us")).alias("mean_us"), share.alias("share"))
    rows = rows.orderBy(F.desc("total_us"), "path", "ordinal")
    return rows.limit(top) if top > 0 else rows


def over_threshold(profiles: DataFrame, threshold_ms: float) -> DataFrame:
    """How many functions took more, and the first of them by total, with that."""
    over = profiles.where(F.col("total_us") / F.lit(1000.0) > threshold_ms)
    first = F.min_by("display_name", F.struct((-F.col("total_us")).alias("t"), "path", "ordinal"))
    return over.agg(F.count("*").alias("exceeding"), first.alias("first_offender"), F.max("total_us").alias("first_us"))
