"""Source text with a statement put in at the start of functions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .walk import file_facts


def instrument(source: str, key: str, statement: str = 'defer profRecord("{key}|{name}")()') -> str:
    """source with a statement after the opening brace of every function that has a body; unchanged if it is not Go."""
    out, at = [], 0
    for f in file_facts(source)["funcs"]:
        if f["has_body"]:
            out += [source[at : f["brace"] + 1], statement.format(key=key, name=f["display_name"]) + ";"]
            at = f["brace"] + 1
    return "".join([*out, source[at:]])


def instrument_files(files: DataFrame) -> DataFrame:
    """files (path, content), instrumented with their paths as keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([instrument(t, p) if t is not None else None for p, t in zip(paths, texts, strict=True)], pa.string())], ["path", "content"])

    return files.select("path", "content").mapInArrow(run, "path string, content string")
