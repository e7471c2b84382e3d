"""What the operators share: tables, shared scratch space, bounded samples, slices of text."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..scratch import discard, materialise, shared_folder  # noqa: F401: the operators take them from here

#: Python processes the texts of an Arrow batch in slices of about this many characters.
SLICE_CHARS = 4_000_000
#: Rows up to which a side is broadcast; its callers' rows take under 100 bytes each.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_out(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys over as many tasks as a shuffle has, for rows that are few but take long."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n; null where the id is null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def drawn(seed: int, *keys: str) -> Column:
    """A hash of keys as a whole number of 40 bits."""
    return F.xxhash64(F.lit(seed), *keys).bitwiseAND(F.lit((1 << 40) - 1))


def bounded_sample(df: DataFrame, bound: int, seed: int, *keys: str) -> DataFrame:
    """About ``bound`` rows of df, chosen by a hash of ``keys``, or all of them if there are fewer.

    The share comes from a count over all rows, so the choice needs no shuffle of them; twice
    the bound, in the hash's order, is the hard limit, which only very many equal keys can reach.
    """
    n = df.count()
    if n <= bound:
        return df
    h = drawn(seed, *keys)
    return df.where(h < int(bound / n * (1 << 40))).orderBy(h, *keys).limit(2 * bound)


def bounded_texts(rows: DataFrame, bound: int, chars: int, seed: int, *keys: str) -> list[Row]:
    """At most ``bound`` of rows, which are a sample, with at most ``chars`` characters of text together: the first by a hash of keys.

    Lengths are gathered first, so that no more text than that comes to the driver.
    """
    order = [drawn(seed, *keys), F.length("text")]
    sizes = [r.n or 0 for r in rows.select(order[0].alias("h"), order[1].alias("n")).orderBy("h", "n").limit(bound).collect()]
    kept = sum(total <= chars for total in accumulate(sizes))
    return rows.orderBy(*order).limit(kept).collect() if kept else []


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once however often body reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def checked(side: DataFrame, rows: int) -> DataFrame:
    """side, to be broadcast if it has few rows of bounded width, else left to a shuffle join."""
    return F.broadcast(side) if rows <= BROADCAST_ROWS else side


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Parts of a batch whose texts together hold about ``limit`` characters, with these texts."""
    texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > limit:
            yield batch.slice(start, i - start), texts[start:i]
            start, size = i, 0
        size += len(t or "") + 1
    if start < len(texts):
        yield batch.slice(start), texts[start:]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def batch_of(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
