"""Go files, cover profiles and logs written from table rows, for queries that run the real operators on real tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a table that share a file.
PER_FILE = 50


def text(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def times(part: str, n: Column) -> Column:
    return F.repeat(F.lit(part), n.cast("int"))


def files(rows: DataFrame, path: Column, body: Column, order: str, header: str = "package p\n") -> DataFrame:
    """path, content: the bodies of the rows of each path, in order. A path takes a bounded number of rows.

    Files are small but slow to parse, so they are dealt over all of a shuffle's tasks, which adaptive execution would join to few.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = rows.select(path.alias("path"), F.struct(F.col(order).alias("o"), body.alias("b")).alias("x")).repartition(n, "path")
    return parts.groupBy("path").agg(F.array_sort(F.collect_list("x")).alias("xs")).select("path", F.concat(F.lit(header), F.array_join(F.col("xs.b"), "")).alias("content"))
