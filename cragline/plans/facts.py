"""Go files to fact tables: one parse a file, all families in one nested row."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.paths import base_name, dir_name, stem
from ..golang.walk import FAMILIES, file_facts

FACTS = """
    path string, parse_ok boolean, parse_error string, package string,
    funcs array<struct<ordinal: int, name: string, recv: string, has_recv: boolean, exported: boolean, display_name: string, start_line: int, end_line: int,
        has_body: boolean, brace: int, decisions: array<struct<kind: string, line: int>>, nesting: array<int>,
        binds: array<struct<name: string, preorder: int>>, calls: array<struct<on: string, callee: string, preorder: int>>>>,
    decls array<struct<name: string, line: int, kind: string, exported: boolean>>,
    imports array<struct<import_path: string, line: int>>,
    structs array<struct<name: string, line: int, exported: boolean, fields: array<struct<name: string, embedded: boolean, exported: boolean>>>>,
    literals array<struct<preorder: int, line: int, kind: string, lexeme: string, value: string, n_bytes: int>>,
    const_lines array<int>,
    marks array<struct<line: int, preorder: int>>,
    names array<struct<name: string, n: long>>"""


#: Characters of text whose facts a task holds at once.
TEXT = 1 << 18


def _kept(kind: T.DataType, names: Sequence[str]) -> T.DataType:
    """A family's type with the named fields, a dot before those of fields; without names it stays whole."""
    if not names or isinstance(kind, T.ArrayType):
        return T.ArrayType(_kept(kind.elementType, names), kind.containsNull) if names else kind
    heads = [n.split(".")[0] for n in names]
    if missing := set(heads) - set(kind.names):
        raise ValueError(f"no such facts: {', '.join(sorted(missing))}")
    return T.StructType([T.StructField(f.name, _kept(f.dataType, [n.split(".", 1)[1] for n in names if n.startswith(f.name + ".")]), f.nullable) for f in kind if f.name in heads])


def fact_batches(batches: Iterator[pa.RecordBatch], want: frozenset[str], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Facts of batches of files (path, content), in batches of about ``TEXT`` characters of text or one file."""
    rows, held = [], 0
    for batch in batches:
        paths, texts = batch.column(0), batch.column(1)
        for i in range(batch.num_rows):
            text = texts[i].as_py()
            rows.append({"path": paths[i].as_py()} | file_facts(text, want))
            held += len(text or "") + 100
            if held >= TEXT:
                yield pa.RecordBatch.from_pylist(rows, arrow)
                rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, arrow)


def parse_files(files: DataFrame, *families: str) -> DataFrame:
    """files (path, content) with a row of facts each; of the families all, or the named ones, as "decls", or of one the fields named, as "funcs.name".

    A file costs one call of the parser whatever asks for its facts; rows are independent, so nothing is
    shuffled. Filter files before parsing: no filter moves through Python, and no choice of columns either, so a query that needs few
    families names them. Facts are made and handed on for a bounded amount of text at a time, whatever the size of a batch.
    """
    every = T.StructType.fromDDL(FACTS)
    want = frozenset(f.split(".")[0] for f in families or FAMILIES)
    schema = _kept(every, [*(f.name for f in every if f.name not in FAMILIES), *(families or sorted(FAMILIES))])
    arrow = to_arrow_schema(schema)

    facts = files.select("path", "content").mapInArrow(lambda batches: fact_batches(batches, want, arrow), schema)
    return facts.withColumns({"pkg_dir": dir_name(F.col("path")), "base": base_name(F.col("path")), "stem": stem(F.col("path"))})


def family(facts: DataFrame, name: str, *more: str) -> DataFrame:
    """One row for each entry of a family, with path, pkg_dir and its place ``at`` in the file."""
    return facts.where("parse_ok").select("path", "pkg_dir", *more, F.posexplode(name).alias("at", "x")).select("path", "pkg_dir", *more, "at", "x.*")


def functions(facts: DataFrame) -> DataFrame:
    """Function declarations with their complexity and nesting, if their facts are there; these need no join: the nodes lie in the row."""
    f = family(facts, "funcs")
    added = {"decisions": ("cc", F.when(F.col("has_body"), 1 + F.size("decisions")).otherwise(0)), "nesting": ("nesting", F.coalesce(F.array_max("nesting"), F.lit(0)))}
    return f.withColumns(dict(made for fact, made in added.items() if fact in f.columns))
