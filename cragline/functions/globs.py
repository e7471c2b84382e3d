"""Path patterns as regular expressions.

``*`` and ``?`` stay inside a path segment, ``**`` crosses segments. A leading ``**/`` may be absent from the name, and a trailing ``/**`` covers the directory itself and all below. Other
signs stand for themselves, non-ASCII ones included.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column


@lru_cache(maxsize=4096)
def to_regex(pattern: str) -> str:
    head = tail = ""
    while pattern.endswith("/**"):
        pattern, tail = pattern[:-3], "(?:/.*)?" + tail
    while pattern.startswith("**/"):
        pattern, head = pattern[3:], head + "(?:.*/)?"
    body = re.sub(r"\*\*|\*|\?|[^*?]+", lambda m: {"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(m.group()) or re.escape(m.group()), pattern)
    return rf"\A(?s:{head}{body}{tail})\z"


def matches(name: Column, pattern: str) -> Column:
    return name.rlike(to_regex(pattern))
