"""Trees of Go files: selection on the driver, contents read by tasks.

``GoTree`` is a Python data source (``spark.read.format("gotree")``) with columns path, content: Spark's own
file readers leave out names that begin with a dot or underscore, which a source tree may well have.
"""

from __future__ import annotations

import os
import posixpath
import subprocess
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Files that a task reads.
CHUNK = 200


def walk_go(root: str, tests: bool = False) -> list[str]:
    """Go files under root, or its test files, sorted; directories named vendor are left out, root included."""
    if os.path.basename(os.path.normpath(root)) == "vendor":
        return []

    def stop(e: OSError) -> None:
        raise e

    out = []
    for top, dirs, names in os.walk(root, onerror=stop):
        dirs[:] = [d for d in dirs if d != "vendor"]
        out += [posixpath.join(top, n) for n in names if n.endswith(".go") and n.endswith("_test.go") == tests]
    return sorted(out, key=os.fsencode)


def expand_paths(args: Sequence[str], root: str, tests: bool = False) -> list[str]:
    """Files of path arguments: directories walked, files as they are (of test files only tests), without repeats, sorted."""
    out: set[str] = set()
    for a in args:
        p = os.path.normpath(a if os.path.isabs(a) else os.path.join(root, a))
        os.stat(p)
        if os.path.isdir(p):
            out.update(walk_go(p, tests))
        elif not tests or p.endswith("_test.go"):
            out.add(p)
    return sorted(out, key=os.fsencode)


def changed_paths(lines: Sequence[str]) -> list[str]:
    """Go files, tests excepted, of short status lines, sorted, without repeats."""
    out = set()
    for line in lines:
        if len(line) >= 4:
            p = line[3:].strip()
            p = p.split(" -> ", 1)[1].strip() if " -> " in p else p
            if p.endswith(".go") and not p.endswith("_test.go"):
                out.add(p)
    return sorted(out, key=os.fsencode)


def changed_files(root: str) -> list[str]:
    """Changed Go files that exist, by ``git status``."""
    got = subprocess.run(["git", "-C", root, "status", "--porcelain"], capture_output=True, text=True, check=True)
    return [p for x in changed_paths(got.stdout.splitlines()) if os.path.exists(p := os.path.join(root, x))]


def module_path(root: str) -> str:
    """The module's name by its manifest; empty without one."""
    try:
        with open(os.path.join(root, "go.mod"), encoding="utf-8") as f:
            return next((x.strip()[len("module ") :].strip() for x in f if x.strip().startswith("module ")), "")
    except FileNotFoundError:
        return ""


def relative(root: str, path: str) -> str:
    try:
        return os.path.relpath(path, root).replace(os.sep, "/")
    except ValueError:
        return path


class Chunk(InputPartition):
    def __init__(self, paths: list[tuple[str, str]]):
        self.paths = paths


class GoTreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        root = options.get("path") or options.get("root") or "."
        listed = options.get("files")
        found = listed.split("\n") if listed else walk_go(root, options.get("tests", "false").lower() == "true")
        self.files = [(relative(root, p), p) for p in found if p]

    def partitions(self) -> list[InputPartition]:
        return [Chunk(self.files[i : i + CHUNK]) for i in range(0, len(self.files), CHUNK)] or [Chunk([])]

    def read(self, partition: Chunk) -> Iterator[tuple[str, str]]:
        for name, path in partition.paths:
            with open(path, encoding="utf-8", errors="replace") as f:
                yield name, f.read()


class GoTree(DataSource):
    """Options: path (root of the tree), tests (test files instead of sources), files (a list, one a line)."""

    @classmethod
    def name(cls) -> str:
        return "gotree"

    def schema(self) -> str:
        return "path string, content string"

    def reader(self, schema: object) -> GoTreeReader:
        return GoTreeReader(dict(self.options))


def go_files(spark: SparkSession, root: str, files: Sequence[str] | None = None, tests: bool = False) -> DataFrame:
    """path (relative to root) and content of a tree's files, or of the listed ones."""
    spark.dataSource.register(GoTree)
    reader = spark.read.format("gotree").option("path", root).option("tests", str(tests).lower())
    return (reader if files is None else reader.option("files", "\n".join(files))).load()
