"""Mixing sources to target weights.

Words are summed by source; each source's target divided by its words is its repetition rate; every
document comes out floor(rate) times, and once more with the fraction as probability, by a hash of
seed, id and text. Only the totals by source are joined back: they have a row a source, whatever
the skew, and their sums are made before the shuffle.

Cases: a null or empty text has size 0 and its copies take no words; a null source is a source of
its own, last in order; sources without words get target 0 and rate 0; rows that are equal in id and
text draw alike, others apart; a null id draws as an empty one; an empty table gives an empty one;
columns of the input named like the ones added are replaced by ``rates``, while ``mix`` hands all columns on, whatever they are
called; very long texts count whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights that sources get by their order, repeating; the mix's size against the input's; the most a source may be repeated.
WEIGHTS, SHARE, MOST = (3.0, 1.0, 2.0), 1.5, 2.0
SEED = "mix-1"
ADDED = ("size", "source_size", "target", "rate", "copies", "taken")


def word_count(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target of a table of sources and sizes.

    Filling by weight with a cap a source is a water level: sources in order of cap per weight are
    capped as long as the level that the rest would have lies above them. Running sums give it.
    The windows have no partition: they run over one row a source, already summed.
    """
    # a copy of source's order: null last, then by bytes, which is by code point in UTF-8
    place = Window.orderBy(F.col("source").asc_nulls_last())
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weighed = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(F.row_number().over(place) - 1, F.lit(len(weights))) + 1).cast("int")))
    weighed = weighed.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    everything, by_cap = Window.partitionBy(), Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    capped = weighed.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share))).withColumn("level", level).withColumn("capped", F.col("cap") <= F.col("weight") * F.col("level"))
    free = lambda what, when: F.coalesce(F.sum(F.when(when, F.col(what))).over(everything), F.lit(0.0))
    last = (F.col("budget") - free("cap", F.col("capped"))) / free("weight", ~F.col("capped"))
    return capped.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * F.when(free("weight", ~F.col("capped")) > 0, last))).alias("target"))


def draw(seed: str) -> Column:
    """A number in [0, 1) from seed, id and text: 52 bits of an MD5."""
    key = F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """docs with size, source_size, target, rate, copies and taken (copies * size)."""
    sized = docs.drop(*ADDED).withColumn("size", word_count(F.col("text"))).withColumn("_draw", draw(seed))  # before the join, which then needs no text
    totals = source_targets(sized.select("source", "size"), weights, share, most)
    totals = totals.withColumnRenamed("source", "_source").withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    joined = sized.join(totals, sized["source"].eqNullSafe(totals["_source"]), "left").drop("_source")
    copies = F.floor("rate") + F.when(F.col("_draw") < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return joined.withColumn("copies", copies.cast("long")).drop("_draw").withColumn("taken", F.col("copies") * F.col("size"))


def mix(docs: DataFrame, **options: object) -> DataFrame:
    """The documents of the mix, each as often as it is taken."""
    packed = docs.select("doc_id", "text", "source", F.struct("*").alias("row"))
    return rates(packed, **options).where(F.col("copies") > 0).select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def mixing_table(docs: DataFrame) -> DataFrame:
    return rates(docs.select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


#: The same mix in DuckDB. The level is found by trying each number of capped sources.
ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1] AS DOUBLE) AS w
  FROM sized GROUP BY source),
placed AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS budget,
         row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST) AS k FROM totals),
levels AS (
  SELECT p.*, (budget - coalesce((SELECT sum(cap) FROM placed q WHERE q.k < p.k), 0))
              / (SELECT sum(w) FROM placed q WHERE q.k >= p.k) AS level FROM placed p),
full_ones AS (SELECT *, cap <= w * level AS capped FROM levels),
targets AS (
  SELECT source, source_size,
         CASE WHEN capped THEN cap ELSE least(cap, w * (budget - coalesce(sum(cap) FILTER (WHERE capped) OVER (), 0))
              / sum(w) FILTER (WHERE NOT capped) OVER ()) END AS target
  FROM full_ones),
drawn AS (
  SELECT doc_id, size, source_size, target,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         CAST('0x' || substr(md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(t)), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST((floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM drawn
"""
