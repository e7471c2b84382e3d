"""Facts of a file from its declarations' shapes.

A declaration's shape is its text with every name replaced by a mark that tells only whether the name is exported. Parser and
walk look at no more of a name than that, a few fixed words excepted, so declarations of one shape have the same facts but for
names and places. A shape is parsed once and remembered; later declarations of it are filled in.
"""

from __future__ import annotations

import re
from typing import Any

from .lexer import KEYWORDS, SyntaxProblem
from .parser import Node, Parser
from .walk import Walk

#: Words that a shape keeps, since parser or walk compare them.
FIXED = KEYWORDS | {"_", "testing", "T"}
#: Where a top-level declaration may begin. A place that is none gives parts that are no declarations, and the file is parsed whole.
PLACES = re.compile(r"^(?=func |(?:type|var|const)[ \t(])", re.M)
#: Texts that may go on over the beginning of such a line, or that hold the marks.
REFUSED = re.compile(r"`|/\*|[\x01\x02]")
SLOTS = re.compile(
    r"([A-Za-z_]\w*|\"(?:[^\"\\\n]|\\[^\n])*\"|'(?:[^'\\\n]|\\[^\n][^'\n]*)'|//[^\n]*"
    r"|(?:0[xX](?:[0-9a-fA-F_]*\.?[0-9a-fA-F_]*)(?:[pP][+-]?[0-9_]+)?|0[bB][01_]+|0[oO][0-7_]+|[0-9][0-9_]*(?:\.[0-9_]*)?(?:[eE][+-]?[0-9_]+)?|\.[0-9][0-9_]*(?:[eE][+-]?[0-9_]+)?)i?)"
)
#: Stand-ins for names, exported or not, with a number behind: letters that no text which comes here has.
UPPER, LOWER = "Ω", "α"
#: Remembered shapes and their characters; beyond these all are forgotten.
MOST, MOST_CHARS, LONGEST = 4_000, 1_000_000, 20_000
STARTS = frozenset("abcdefghijklmnopqrstuvwxyz_ABCDEFGHIJKLMNOPQRSTUVWXYZ")

_known: dict[str, Shape | None] = {}
_heads: dict[str, Walk] = {}
_chars = [0]


class Shape:
    """Facts of a shape: names as places in the list of a text's names and the shape's own words, lines and numbers from 0."""

    def __init__(self, parts: list[str], names: list[str]):
        text = "".join(parts)
        parser, decls = Parser(text), []
        while parser.tok.kind != "end":
            decls.append(parser.declaration(True))
            parser.end_of_declaration()
        w = Walk(Node("File", 1, [Node("Ident", 1, None, "p"), *decls]))
        w.names.pop("p")
        self.nodes, self.lines, self.words, self.at = w.n - 2, text.count("\n"), [], len(names)
        ref = self.ref
        self.funcs = []
        for f in w.funcs:
            before = [n for n in names if text.find(n) < f["brace"]] if f["brace"] >= 0 else []
            self.funcs.append((
                {**f, "decisions": [], "binds": [], "calls": []}, ref(f["name"]), ref(f["recv"]), f["start_line"] - 1, f["end_line"] - 1, f["brace"] - sum(map(len, before)), len(before),
                [(d["kind"], d["line"] - 1) for d in f["decisions"]], [(ref(b["name"]), b["preorder"] - 2) for b in f["binds"]], [(None if c["on"] is None else ref(c["on"]), ref(c["callee"]), c["preorder"] - 2) for c in f["calls"]],
            ))
        self.decls = [(d, ref(d["name"]), d["line"] - 1) for d in w.decls]
        self.structs = [(s, ref(s["name"]), s["line"] - 1, [(f, ref(f["name"])) for f in s["fields"]]) for s in w.structs]
        self.literals = [(x, x["line"] - 1, x["preorder"] - 2) for x in w.literals]
        self.const_lines = [x - 1 for x in w.const_lines]
        self.marks = [(k - 1, v - 2) for k, v in w.marks.items()]
        self.names = [(ref(k), n) for k, n in w.names.items()]

    def ref(self, word: str) -> int:
        if word[:1] in (UPPER, LOWER):
            return int(word[1:-1])
        self.words.append(word)
        return self.at + len(self.words) - 1


def _shape(key: str, parts: list[str], slots: list[int]) -> Shape | None:
    """The shape of a key; None if it is no row of declarations."""
    text, names = parts[:], []
    for n, i in enumerate(slots):
        names.append(f"{UPPER if parts[i][0].isupper() else LOWER}{n}_")
        text[i] = names[-1]
    try:
        made = Shape(text, names)
    except (SyntaxProblem, RecursionError):
        made = None
    if len(key) <= LONGEST:
        if len(_known) >= MOST or _chars[0] >= MOST_CHARS:
            _known.clear()
            _chars[0] = 0
        _known[key] = made
        _chars[0] += len(key)
    return made


def _head(text: str) -> Walk | None:
    """Package and imports."""
    got = _heads.get(text)
    if got is None:
        try:
            got = Walk(Parser(text).file())
        except (SyntaxProblem, RecursionError):
            return None
        if got.funcs or got.decls or got.const_lines:
            return None
        if len(text) <= 200:
            if len(_heads) >= MOST:
                _heads.clear()
            _heads[text] = got
    return got


def facts_by_shape(source: str, want: frozenset[str]) -> dict[str, Any] | None:
    """The wanted families of a file's facts; None if the file must be parsed whole."""
    if not source.isascii() or REFUSED.search(source):
        return None
    head, *chunks = PLACES.split(source)
    if (top := _head(head)) is None:
        return None
    n, line, at = top.n, 1 + head.count("\n"), len(head)
    funcs, decls, structs, literals, const_lines, marks, names = [], [], [], list(top.literals), [], [{"line": k, "preorder": v} for k, v in top.marks.items()], dict(top.names)
    each_func, each_decl, each_struct, each_literal, each_name = "funcs" in want, "decls" in want, "structs" in want, "literals" in want, "names" in want
    for chunk in chunks:
        parts = SLOTS.split(chunk)
        slots, values, marked = [], [], parts[:]
        for i in range(1, len(parts), 2):
            word = parts[i]
            if word[0] in STARTS and word not in FIXED:
                slots.append(i)
                values.append(word)
                marked[i] = "\x02" if word[0].isupper() else "\x01"
        key = "".join(marked)
        shape = _known.get(key, False)
        if shape is False:
            shape = _shape(key, parts, slots)
        if shape is None:
            return None
        if each_func:
            for const, name, recv, start, end, brace, before, decisions, binds, calls in shape.funcs:
                row = const.copy()
                own, theirs = (values[name] if name < shape.at else shape.words[name - shape.at]), (values[recv] if recv < shape.at else shape.words[recv - shape.at])
                row["ordinal"], row["name"], row["recv"], row["display_name"] = len(funcs), own, theirs, f"({theirs}){own}" if theirs else own
                row["start_line"], row["end_line"] = line + start, line + end
                if row["has_body"]:
                    row["brace"] = at + brace + sum(map(len, values[:before]))
                if decisions:
                    row["decisions"] = [{"kind": k, "line": line + x} for k, x in decisions]
                if binds or calls:
                    words = values + shape.words
                    row["binds"] = [{"name": words[b], "preorder": n + p} for b, p in binds]
                    row["calls"] = [{"on": None if o is None else words[o], "callee": words[c], "preorder": n + p} for o, c, p in calls]
                funcs.append(row)
        if each_decl or each_struct or each_name:
            words = values + shape.words
            if each_decl:
                decls += [{**d, "name": words[r], "line": line + x} for d, r, x in shape.decls]
            if each_struct:
                structs += [{**s, "name": words[r], "line": line + x, "fields": [{**f, "name": words[k]} for f, k in fields]} for s, r, x, fields in shape.structs]
            if each_name:
                for r, k in shape.names:
                    names[words[r]] = names.get(words[r], 0) + k
        if each_literal:
            literals += [{**x, "line": line + k, "preorder": n + p} for x, k, p in shape.literals]
        if shape.const_lines:
            const_lines += [line + x for x in shape.const_lines]
        if shape.marks:
            marks += [{"line": line + k, "preorder": n + p} for k, p in shape.marks]
        n += shape.nodes
        line += shape.lines
        at += len(chunk)
    every = {
        "funcs": funcs, "decls": decls, "imports": top.imports, "structs": structs, "literals": literals, "const_lines": sorted(const_lines), "marks": marks,
        "names": [{"name": k, "n": v} for k, v in names.items()] if each_name else [],
    }
    return {"parse_ok": True, "parse_error": None, "package": top.package, **{k: v for k, v in every.items() if k in want}}
