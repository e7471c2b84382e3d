"""Joins of line ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines in a bin; bins from which on a range is wide.
BIN, WIDE = 128, 64


def overlap_join(left: DataFrame, right: DataFrame, key: str, left_range: tuple[str, str], right_range: tuple[str, str], width: int = BIN, how: str = "inner") -> DataFrame:
    """Pairs of rows with equal key whose closed ranges overlap.

    Both sides are cut into bins of lines and joined on key and bin, so a single huge file is spread over
    tasks instead of being compared range by range in one. A pair is taken in the first bin that both have,
    hence once. A range of the right side that is wide, whatever its width, takes one row in bin -1, where all left rows of its key
    are too. Ranges of the left side are those of functions: they have no more bins than their file's text has lines.
    The sides are merged, never broadcast: a plan's estimate knows nothing of the rows that bins add to a small file.

    With how="left", each left row also comes at least once without a right one, as a row for each bin without a pair: for sums over
    the left rows, which then need no second look at them.
    """
    place = lambda c: F.floor(F.col(c) / width).cast("long")
    fine, one = lambda r: F.sequence(place(r[0]), place(r[1])), F.array(F.lit(-1).cast("long"))
    wide = place(right_range[1]) - place(right_range[0]) >= WIDE
    whole = F.coalesce(F.col(left_range[0]) <= F.col(left_range[1]), F.lit(False))
    kept = left.where(whole) if how == "inner" else left
    a = kept.withColumns({"_left": place(left_range[0]), "_bin": F.explode(F.when(whole, F.concat(one, fine(left_range))).otherwise(one))})
    b = right.where(F.col(right_range[0]) <= F.col(right_range[1])).withColumn("_right", place(right_range[0])).withColumn("_bin", F.explode(F.when(wide, one).otherwise(fine(right_range))))
    b = b.withColumnsRenamed({key: "_key", "_bin": "_place"})
    overlap = (F.col(right_range[0]) <= F.col(left_range[1])) & (F.col(right_range[1]) >= F.col(left_range[0])) & (F.col(left_range[0]) <= F.col(left_range[1]))
    first = (F.col("_bin") < 0) | (F.col("_bin") == F.greatest("_left", "_right"))
    return a.hint("merge").join(b, (F.col(key) == F.col("_key")) & (F.col("_bin") == F.col("_place")) & overlap & first, how).drop("_bin", "_left", "_right", "_key", "_place")
