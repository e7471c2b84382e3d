"""Reports as text and JSON. Numbers are formatted in Python, which rounds the exact binary value."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime

from pyspark.sql import Row

METHOD_WIDTHS = "{:<30} {:<35} {:>4} {:>7} {:>8}"
NOISE_US = 30.0


#: What stands for a share or a score that isn't known.
NO_COVERAGE, NO_SCORE = "  N/A ", "     N/A"


def metric_row(r: Row) -> str:
    cov = NO_COVERAGE if r.coverage is None else f"{r.coverage * 100:5.1f}%"
    return METHOD_WIDTHS.format(r.display_name, r.path, r.cc, cov, NO_SCORE if r.crap is None else f"{r.crap:8.1f}")


def metric_report(rows: Iterable[Row], most: float, threshold: float) -> Iterator[str]:
    """The report line by line, so that its rows need not be in memory together."""
    head = METHOD_WIDTHS.format("Method", "File", "CC", "Cov%", "CRAP")
    yield from ("CRAP Report", "=" * len("CRAP Report"), head, "-" * len(head))
    yield from map(metric_row, rows)
    yield from ("", f"Max CRAP: {most:.1f} (threshold {threshold:.1f}) — {'passed' if most <= threshold else 'FAILED'}")


def gate_lines(rows: Iterable[Row]) -> Iterator[str]:
    return (f"{r.path}: {r.message}" if r.line is None else f"{r.path}:{r.line}: {r.message}" for r in rows)


#: Summary with violations, and without; n violations among m things.
SUMMARIES = {
    "file-naming": ("{n}/{m} files with mechanical names", "{m} files have domain-meaningful names"),
    "nesting": ("{n}/{m} functions nested deeper than 5", "{m} functions within nesting 5"),
    "class-size": ("{n} violations in {m} types over 25 methods/WMC 80", "{m} types within 25 methods/WMC 80"),
    "weight-of-class": ("{n}/{m} types over weight 0.33", "{m} types within weight 0.33"),
    "unused-code": ("{n}/{m} unexported declarations unused", "{m} unexported declarations used"),
    "unused-files": ("{n}/{m} packages are never imported", "{m} packages are imported by analyzed code"),
    "banned-imports": ("{n} banned import(s) in {m} files", "{m} files comply with {r} rule(s)"),
    "magic-constants": ("{n} magic constant(s) in {m} files", "{m} files free of magic constants"),
    "test-assertions": ("{n}/{m} tests without assertions", "{m} tests assert their expectations"),
    "folder-structure": ("{n} directory(ies) with loose-file sprawl", "{m} directories organized into packages"),
}


def gate_summary(gate: str, violations: int, checked: int, rules: int = 0) -> str:
    return SUMMARIES[gate][violations == 0].format(n=violations, m=checked, r=rules)


def mean_label(mean_us: float) -> str:
    return f"{'~' if mean_us < NOISE_US else ''}{mean_us:.1f}"


#: The heading of the profile table and the rule under it.
PROFILE_HEAD = "TOTAL(ms)     %  CALLS  MEAN(µs)  MAX(µs)  @60fps(ms)  METHOD                     FILE:LINE"
PROFILE_RULE = "------------------------------------------------------------------------------------------"


def profile_row(r: Row) -> str:
    return f"{r.total_us / 1000.0:9.2f} {r.share:5.1f}% {r.calls:6d} {mean_label(r.mean_us):>9} {r.max_us:8d} {r.mean_us * 60 / 1000:10.2f}  {r.display_name:<25} {r.path}:{r.start_line}"


def profile_verdict(exceeding: int, threshold_ms: float) -> list[str]:
    """The line about the threshold; none if that is off, 0."""
    if threshold_ms <= 0:
        return []
    what = "all methods OK" if not exceeding else "1 method exceeds" if exceeding == 1 else f"{exceeding} methods exceed"
    return [f"Threshold: {threshold_ms:.2f}ms — {what}"]


def profile_report(rows: Iterable[Row], methods: int, total_us: int, exceeding: int = 0, threshold_ms: float = 0.0) -> Iterator[str]:
    """The table line by line, a blank line and the verdict."""
    yield from (f"Profile Report ({methods} methods, total {total_us / 1000.0:.2f}ms)", PROFILE_HEAD, PROFILE_RULE)
    yield from map(profile_row, rows)
    yield from ("", *profile_verdict(exceeding, threshold_ms))


def profile_json(rows: Iterable[Row], at: datetime | None = None) -> Iterator[str]:
    """The report as JSON, a method at a time."""
    yield '{\n  "generatedAt": ' + json.dumps((at or datetime.now(UTC)).isoformat(timespec="seconds")) + ',\n  "methods": ['
    sep = "\n    "
    for r in rows:
        yield sep + json.dumps({"method": r.display_name, "file": r.path, "line": r.start_line, "calls": r.calls, "totalMicros": r.total_us, "minMicros": r.min_us, "maxMicros": r.max_us, "meanMicros": r.mean_us}, ensure_ascii=False)
        sep = ",\n    "
    yield "\n  ]\n}\n"
