"""The command line: ``python -m cragline.cli [command] [flags] [paths]``.

Exit codes: 0 in order, 1 usage or input errors, 2 a threshold exceeded or violations found.
"""

from __future__ import annotations

import argparse
import os
import subprocess
import sys
from collections.abc import Callable, Iterable, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import render
from .operators import gates, metrics, profiling
from .plans.facts import functions, parse_files
from .sources import logs, tree

GUIDE = "Run without a command to score functions; run a gate by its name to check a tree. Each exits with 2 on findings.\n"


class Problem(Exception):
    """Wrong use or input; ends with exit code 1."""


class Arguments(argparse.ArgumentParser):
    def error(self, message: str) -> None:
        raise Problem(message)


def arguments(prog: str) -> Arguments:
    a = Arguments(prog=prog, allow_abbrev=False)
    a.add_argument("paths", nargs="*")
    return a


def selected(root: str, paths: Sequence[str], changed: bool = False, tests: bool = False) -> list[str]:
    if changed:
        return tree.changed_files(root)
    return tree.expand_paths(paths, root, tests) if paths else tree.walk_go(root, tests)


def names(spark: SparkSession, root: str, found: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(tree.relative(root, p),) for p in found], "path string")


def analyze(spark: SparkSession, root: str, argv: Sequence[str], out: Callable[[str], None]) -> int:
    a = arguments("analyze")
    a.add_argument("--changed", action="store_true")
    a.add_argument("--coverage", default="coverage.out")
    a.add_argument("--threshold", type=float, default=metrics.THRESHOLD)
    a.add_argument("--run-tests", action="store_true")
    o = a.parse_args(argv)
    if not o.threshold >= 0:
        raise Problem("--threshold must be a number, 0 or more")
    found = selected(root, o.paths, o.changed)
    if not found:
        out("No Go files to analyze.")
        return 0
    if o.run_tests and subprocess.run(["go", "test", "-coverprofile=coverage.out", "./..."], cwd=root).returncode:
        raise Problem("the tests failed")
    profile = os.path.join(root, o.coverage)
    blocks = logs.read_cover_profile(spark, profile) if os.path.exists(profile) else None
    if blocks is None:
        print(f"warning: no coverage profile at {profile}", file=sys.stderr)
    facts = parse_files(tree.go_files(spark, root, found)).persist()
    try:
        bad = facts.where("NOT parse_ok").select("path", "parse_error").orderBy("path").first()
        if bad:
            raise Problem(f"{bad.path}: {bad.parse_error}")
        scored = metrics.analyze(functions(facts), blocks).persist()
        most = metrics.summary(scored, o.threshold).first().max_crap
        for line in render.metric_report(metrics.sorted_metrics(scored).toLocalIterator(), most, o.threshold):
            out(line)
        scored.unpersist()
    finally:
        facts.unpersist()
    if most > o.threshold:
        print(f"CRAP threshold exceeded: {most:.1f} > {o.threshold:.1f}", file=sys.stderr)
        return 2
    return 0


def report(gate: gates.Gate, out: Callable[[str], None], rules: int = 0) -> int:
    n = 0
    for line in render.gate_lines(gate.violations.orderBy("path", "ord", "by", "line").toLocalIterator()):
        out(line)
        n += 1
    out(render.gate_summary(gate.name, n, gate.checked.first().checked, rules))
    return 2 if n else 0


def run_gate(name: str, spark: SparkSession, root: str, argv: Sequence[str], out: Callable[[str], None]) -> int:
    a = arguments(name)
    if name == "banned-imports":
        for flag in ("--from", "--forbid", "--message"):
            a.add_argument(flag, action="append", default=[])
    o = a.parse_args(argv)
    if name in ("unused-code", "unused-files") and o.paths:
        out(f"{name} needs the whole tree; skipped for a selection of paths.")
        return 0
    if name == "folder-structure":
        dirs = [os.path.normpath(os.path.join(root, p)) for p in o.paths or ["."]]
        for d in dirs:
            if not os.path.isdir(d):
                raise Problem(f"not a directory: {d}")
        rel = [tree.relative(root, d) for d in dirs]
        inside = [(n if r == "." else f"{r}/{n}",) for d, r in dict(zip(dirs, rel, strict=True)).items() for n in os.listdir(d) if os.path.isfile(os.path.join(d, n))]
        return report(gates.folder_structure(spark.createDataFrame(list(zip(rel, range(len(rel)), strict=True)), "dir string, ord int"), spark.createDataFrame(inside, "path string")), out)
    rules = []
    if name == "banned-imports":
        try:
            rules = gates.rules_from(getattr(o, "from"), o.forbid, o.message)
        except ValueError as e:
            raise Problem(str(e)) from e
        if not rules:
            out("No rules given.")
            return 0
    found = selected(root, o.paths, tests=name == "test-assertions")
    if not found:
        out("No Go files to check.")
        return 0
    if name == "file-naming":
        return report(gates.file_naming(names(spark, root, found)), out)
    files = tree.go_files(spark, root, found)
    facts = parse_files(files).persist()
    try:
        module = tree.module_path(root)
        make = {
            "nesting": gates.nesting, "class-size": gates.class_size, "weight-of-class": gates.weight_of_class, "unused-code": gates.unused_code, "magic-constants": gates.magic_constants,
            "test-assertions": gates.test_assertions, "unused-files": lambda f: gates.unused_files(f, module), "banned-imports": lambda f: gates.banned_imports(f, rules, module),
        }[name]
        return report(make(facts), out, len(rules))
    finally:
        facts.unpersist()


def go_test_arguments(root: str, name: str, paths: Sequence[str]) -> list[str]:
    """What ``go`` is called with to run the tests: those matching name, in paths or everywhere. Paths below root become relative to it."""
    inside = lambda p: os.path.isabs(p) and not os.path.relpath(p, root).startswith("..")
    where = ["./" + os.path.relpath(p, root).replace(os.sep, "/") if inside(p) else p for p in paths]
    return ["test", "-count=1", *(["-run", name] if name else []), *(where or ["./..."])]


def profile(spark: SparkSession, root: str, argv: Sequence[str], out: Callable[[str], None]) -> int:
    """Reports on the logs in --logs that an instrumented test run has left, or leaves with --run-tests.

    --name selects the tests that are run, --threshold is in ms and off at 0.
    """
    a = arguments("profile")
    a.add_argument("--logs", default="profile-logs")
    a.add_argument("--name", default="")
    a.add_argument("--threshold", type=float, default=0.0)
    a.add_argument("--top", type=int, default=profiling.TOP)
    a.add_argument("--run-tests", action="store_true")
    o = a.parse_args(argv)
    if o.top <= 0:
        raise Problem("top must be positive")
    if not o.threshold >= 0:
        raise Problem("threshold must not be negative")
    folder = os.path.join(root, o.logs)
    if o.run_tests and subprocess.run(["go", *go_test_arguments(root, o.name, o.paths)], cwd=root, env=os.environ | {"CRAP_PROFILE_DIR": folder}).returncode:
        raise Problem("the tests failed")
    facts = parse_files(tree.go_files(spark, root, selected(root, o.paths)))
    owned = profiling.attributed(functions(facts), profiling.timing_stats(logs.read_timings(spark, folder))).persist()
    try:
        all_of = owned.agg(F.count("*").alias("n"), F.sum("total_us").alias("total")).first()
        if not all_of.n:
            raise Problem("no timings belong to any function")
        over = profiling.over_threshold(owned, o.threshold).first() if o.threshold > 0 else None
        exceeding = over.exceeding if over else 0
        report = lambda rows: render.profile_report(rows, all_of.n, all_of.total, exceeding, o.threshold)
        for line in report(profiling.ranked(owned, o.top).collect()):
            out(line)
        write_reports(root, profiling.ranked(owned), report)
    finally:
        owned.unpersist()
    if not exceeding:
        return 0
    print(f"Profile threshold exceeded: {over.first_offender} total {over.first_us / 1000.0:.2f}ms > {o.threshold:.2f}ms", file=sys.stderr)
    return 2


def write_reports(root: str, ranked: DataFrame, report: Callable[[Iterable], Iterable[str]]) -> None:
    """The whole table as text and as JSON under profile-reports; what goes wrong is a warning."""
    folder = os.path.join(root, "profile-reports")
    names = [os.path.join(folder, f"profile-{datetime.now():%Y%m%d-%H%M%S}.{suffix}") for suffix in ("txt", "json")]
    try:
        os.makedirs(folder, exist_ok=True)
        for name, lines in zip(names, ((x + "\n" for x in report(ranked.toLocalIterator())), render.profile_json(ranked.toLocalIterator())), strict=True):
            with open(name, "w", encoding="utf-8") as f:
                f.writelines(lines)
        print(f"Profile report written to {names[0]} and {names[1]}", file=sys.stderr)
    except OSError as e:
        print(f"warning: {e}", file=sys.stderr)


def main(argv: Sequence[str], root: str | None = None, spark: SparkSession | None = None, out: Callable[[str], None] = print) -> int:
    root, argv = root or os.getcwd(), list(argv)
    if argv[:1] in (["-h"], ["--help"], ["help"]):
        out(f"{__doc__.strip()}\nCommands: {', '.join([*render.SUMMARIES, 'profile', 'skill'])}")
        return 0
    if argv[:1] == ["skill"]:
        out(GUIDE.rstrip())
        return 0
    if spark is None:
        from .session import local_session

        spark = local_session()
    try:
        if argv and argv[0] in render.SUMMARIES:
            return run_gate(argv[0], spark, root, argv[1:], out)
        if argv[:1] == ["profile"]:
            return profile(spark, root, argv[1:], out)
        return analyze(spark, root, argv, out)
    except (Problem, OSError, subprocess.CalledProcessError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
