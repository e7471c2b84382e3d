"""Facts of one Go file, as plain rows."""

from __future__ import annotations

import sys
from typing import Any

from .lexer import SyntaxProblem, unquoted
from .parser import Node, parse

DECISIONS = {"If": "if", "For": "for", "Range": "range", "Case": "case", "Comm": "comm"}
sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))


def is_exported(name: str) -> bool:
    """Whether a name begins with an upper-case letter."""
    c = name[:1]
    return c.isupper() and c.isalpha()


def receiver(recv: Node | None) -> str:
    """The type name of a receiver T or *T; empty for anything else."""
    if recv is None or not recv.kids:
        return ""
    t = recv.kids[0].more[1]
    if t.kind == "Star":
        t = t.kids[0]
    return t.text if t.kind == "Ident" else ""


def is_testing_t(t: Node) -> bool:
    if t.kind != "Star" or t.kids[0].kind != "Selector":
        return False
    pkg, name = t.kids[0].kids
    return pkg.kind == "Ident" and pkg.text == "testing" and name.text == "T"


def testing_names(kind: Node) -> list[str]:
    return [n.text for f in kind.more.kids if is_testing_t(f.more[1]) for n in f.more[0] if n.text != "_"]


def last_name(t: Node) -> str:
    """The name that an embedded field T, *T or pkg.T is judged by."""
    if t.kind == "Star":
        return last_name(t.kids[0])
    return t.text if t.kind == "Ident" else t.kids[1].text if t.kind == "Selector" else ""


class Walk:
    """Numbers the nodes of a file in preorder and collects its facts."""

    def __init__(self, file: Node):
        self.n = 0
        self.funcs: list[dict] = []
        self.decls: list[dict] = []
        self.imports: list[dict] = []
        self.structs: list[dict] = []
        self.literals: list[dict] = []
        self.const_lines: set[int] = set()
        self.marks: dict[int, int] = {}  # line -> first preorder number at which it is an identifier's place
        self.names: dict[str, int] = {}
        self.package = file.kids[0].text
        self.func: dict | None = None
        self.visit(file)

    def visit(self, node: Node) -> None:
        """Iterative, so that long chains of operators cost no stack."""
        stack: list[Any] = [node]
        while stack:
            x = stack.pop()
            if x is None:  # the end of a function declaration
                self.func = None
                continue
            self.n += 1
            handler = HANDLERS.get(x.kind)
            if handler is not None:
                handler(self, x)
            if x.kind == "FuncDecl":
                stack.append(None)
            stack.extend(reversed(x.kids))

    def ident(self, x: Node) -> None:
        self.names[x.text] = self.names.get(x.text, 0) + 1

    def gen_decl(self, x: Node) -> None:
        if x.text == "const":
            for spec in x.kids:
                stack = list(spec.more[1])
                while stack:
                    v = stack.pop()
                    if v.kind == "BasicLit":
                        self.const_lines.add(v.line)
                    stack.extend(v.kids)
        if self.func is None:
            for spec in x.kids:
                if spec.kind == "TypeSpec":
                    self.decl(spec.kids[0], "type")
                    if spec.more.kind == "StructType":
                        self.struct(spec)
                elif spec.kind == "ValueSpec":
                    for n in spec.more[0]:
                        self.decl(n, x.text)

    def decl(self, name: Node, kind: str) -> None:
        self.decls.append({"name": name.text, "line": name.line, "kind": kind, "exported": is_exported(name.text)})

    def struct(self, spec: Node) -> None:
        fields = []
        for f in spec.more.more:
            names, kind = f.more
            fields += [{"name": n.text, "embedded": False, "exported": is_exported(n.text)} for n in names]
            if not names:
                name = last_name(kind)
                fields.append({"name": name, "embedded": True, "exported": is_exported(name)})
        self.structs.append({"name": spec.text, "line": spec.line, "exported": is_exported(spec.text), "fields": fields})

    def import_spec(self, x: Node) -> None:
        path = unquoted(x.text)
        self.imports.append({"import_path": (path or b"").decode("utf-8", "replace"), "line": x.line})

    def literal(self, x: Node) -> None:
        if x.more in ("INT", "FLOAT", "STRING"):
            raw = unquoted(x.text) if x.more == "STRING" else x.text.encode()
            raw = x.text.encode() if raw is None else raw
            self.literals.append({"preorder": self.n, "line": x.line, "kind": x.more, "lexeme": x.text, "value": raw.decode("utf-8", "replace"), "n_bytes": len(raw)})

    def mark(self, x: Node) -> None:
        if x.kind == "BasicLit" and x.more == "STRING":
            self.marks.setdefault(x.line, self.n)

    def key_value(self, x: Node) -> None:
        self.mark(x.kids[0])

    def index(self, x: Node) -> None:
        self.mark(x.kids[1])

    def case(self, x: Node) -> None:
        for e in x.more[0]:
            self.mark(e)
        self.decision(x)

    def decision(self, x: Node) -> None:
        if self.func is not None:
            self.func["decisions"].append({"kind": DECISIONS[x.kind], "line": x.line})

    def binary(self, x: Node) -> None:
        if self.func is not None and x.text in ("&&", "||"):
            self.func["decisions"].append({"kind": x.text, "line": x.line})

    def func_decl(self, x: Node) -> None:
        more, recv = x.more, receiver(x.more["recv"])
        body = more["body"]
        row = {
            "ordinal": len(self.funcs), "name": x.text, "recv": recv, "has_recv": more["recv"] is not None, "exported": is_exported(x.text),
            "display_name": f"({recv}){x.text}" if recv else x.text, "start_line": x.line, "end_line": more["end"], "has_body": body is not None,
            "brace": more["brace"], "decisions": [], "nesting": levels(body), "binds": [], "calls": [],
        }
        self.funcs.append(row)
        if more["recv"] is None:
            self.decl(x.kids[0], "func")
        if body is not None:
            self.func = row
            row["binds"] = [{"name": n, "preorder": self.n} for n in testing_names(more["type"])]

    def func_lit(self, x: Node) -> None:
        if self.func is not None:
            self.func["binds"] += [{"name": n, "preorder": self.n} for n in testing_names(x.more)]

    def call(self, x: Node) -> None:
        if self.func is None:
            return
        fn = x.kids[0]
        if fn.kind == "Selector" and fn.kids[0].kind == "Ident":
            self.func["calls"].append({"on": fn.kids[0].text, "callee": fn.kids[1].text, "preorder": self.n})
        elif fn.kind == "Ident":
            self.func["calls"].append({"on": None, "callee": fn.text, "preorder": self.n})


HANDLERS = {
    "Ident": Walk.ident, "GenDecl": Walk.gen_decl, "ImportSpec": Walk.import_spec, "BasicLit": Walk.literal, "KeyValue": Walk.key_value, "Index": Walk.index,
    "Case": Walk.case, "If": Walk.decision, "For": Walk.decision, "Range": Walk.decision, "Comm": Walk.decision, "Binary": Walk.binary, "FuncDecl": Walk.func_decl,
    "FuncLit": Walk.func_lit, "Call": Walk.call,
}


def levels(body: Node | None) -> list[int]:
    """The nesting level of a body and of each block and control statement in it."""
    out: list[int] = []
    stack = [(body, 1)] if body is not None else []
    while stack:
        s, level = stack.pop()
        inside: list[Node]
        if s.kind == "Block":
            inside = s.kids
        elif s.kind == "If":
            body, other = s.more
            inside = [*body.kids, *([] if other is None else other.kids if other.kind == "Block" else [other])]
        elif s.kind in ("For", "Range"):
            inside = s.more.kids
        elif s.kind in ("Switch", "TypeSwitch", "Select"):
            inside = [x for clause in s.more for x in clause.more[1]]
        else:
            continue
        out.append(level)
        stack.extend((x, level + 1) for x in inside)
    return out


FAMILIES = frozenset(("funcs", "decls", "imports", "structs", "literals", "const_lines", "marks", "names"))


def file_facts(source: str | None, want: frozenset[str] = FAMILIES) -> dict[str, Any]:
    """A row of facts, of the wanted families; with parse_ok false and no facts if the text is not Go.

    Declarations whose shape is known are filled in; a file that has other than plain declarations is parsed whole.
    """
    from .shapes import facts_by_shape

    return (None if source is None else facts_by_shape(source, want)) or whole_facts(source, want)


def whole_facts(source: str | None, want: frozenset[str] = FAMILIES) -> dict[str, Any]:
    """As ``file_facts``, by one parse of the whole text."""
    empty = {"parse_ok": False, "parse_error": None, "package": None, **{k: [] for k in want}}
    if source is None:
        return empty | {"parse_error": "no text"}
    try:
        w = Walk(parse(source))
    except SyntaxProblem as e:
        return empty | {"parse_error": str(e)}
    every = {
        "funcs": w.funcs, "decls": w.decls, "imports": w.imports, "structs": w.structs, "literals": w.literals,
        "const_lines": sorted(w.const_lines), "marks": [{"line": k, "preorder": v} for k, v in w.marks.items()], "names": [{"name": k, "n": v} for k, v in w.names.items()],
    }
    return {"parse_ok": True, "parse_error": None, "package": w.package, **{k: v for k, v in every.items() if k in want}}
