"""Columns of path strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dir_name(path: Column) -> Column:
    """The part before the last slash; ``.`` if there is none."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*\z", "")).otherwise(F.lit("."))


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.go\z", "")


def import_dir(import_path: Column, module: str) -> Column:
    """The directory of an import inside the module; empty for any other."""
    if not module:
        return F.lit("")
    inside = F.substring(import_path, len(module) + 2, 1 << 20)
    return F.when(import_path == module, F.lit(".")).when(import_path.startswith(module + "/"), inside).otherwise(F.lit(""))


def porcelain_path(line: Column) -> Column:
    """The path of a short status line, of a rename its target; null for lines too short to have one."""
    rest = F.trim(F.substring(line, 4, 1 << 20))
    arrow = F.instr(rest, " -> ")
    return F.when(F.length(line) < 4, None).when(arrow > 0, F.trim(F.substr(rest, arrow + 4))).otherwise(rest)
