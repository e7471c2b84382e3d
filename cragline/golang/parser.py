"""A recursive-descent parser for Go. It accepts what a compiler's syntax phase accepts, without types.

Nodes hold their children in source order of the language's own tree (receiver before name, alias
before path, key before value and so on), so that a walk numbers them the way Go tools do.
"""

from __future__ import annotations

from .lexer import SyntaxProblem, Token, tokens

PRECEDENCE = {"||": 1, "&&": 2, "==": 3, "!=": 3, "<": 3, "<=": 3, ">": 3, ">=": 3, "+": 4, "-": 4, "|": 4, "^": 4, "*": 5, "/": 5, "%": 5, "<<": 5, ">>": 5, "&": 5, "&^": 5}
ASSIGNS = frozenset("= := += -= *= /= %= &= |= ^= <<= >>= &^=".split())
LITERALS = frozenset(["INT", "FLOAT", "IMAG", "CHAR", "STRING"])
TYPE_STARTS = frozenset(["name", "*", "(", "[", "func", "map", "chan", "struct", "interface", "<-"])


class Node:
    """kind, first line, children, text (name, operator or lexeme), and what else a kind needs in ``more``."""

    __slots__ = ("kind", "line", "kids", "text", "more")

    def __init__(self, kind: str, line: int, kids: list[Node | None] | None = None, text: str = "", more=None):
        self.kind, self.line, self.text, self.more = kind, line, text, more
        self.kids = [k for k in kids if k is not None] if kids else []


class Parser:
    def __init__(self, source: str):
        self.toks = tokens(source)
        self.i = 0
        self.tok: Token = self.toks[0]
        self.level = 0  # below 0 in the header of a control statement, where a brace opens its body

    # -------------------------------------------------------------- tokens
    def next(self) -> Token:
        t = self.tok
        self.i += 1
        self.tok = self.toks[self.i] if self.i < len(self.toks) else t
        return t

    def peek(self, n: int = 1) -> str:
        return self.toks[min(self.i + n, len(self.toks) - 1)].kind

    def fail(self, wanted: str) -> SyntaxProblem:
        return SyntaxProblem(f"line {self.tok.line}: expected {wanted}, found {self.tok.text or self.tok.kind!r}")

    def want(self, kind: str) -> Token:
        if self.tok.kind != kind:
            raise self.fail(kind)
        return self.next()

    def got(self, kind: str) -> bool:
        if self.tok.kind == kind:
            self.next()
            return True
        return False

    def end_of_statement(self) -> None:
        if self.tok.kind not in (")", "}"):
            if self.tok.kind == "end":
                return
            self.want(";")

    def name(self) -> Node:
        t = self.want("name")
        return Node("Ident", t.line, None, t.text)

    # -------------------------------------------------------------- files
    def file(self) -> Node:
        line = self.want("package").line
        kids = [self.name()]
        self.want(";")
        while self.tok.kind == "import":
            kids.append(self.group("import", self.import_spec))
            self.end_of_declaration()
        while self.tok.kind != "end":
            kids.append(self.declaration(True))
            self.end_of_declaration()
        return Node("File", line, kids)

    def end_of_declaration(self) -> None:
        if self.tok.kind != "end":
            self.want(";")

    def declaration(self, top: bool) -> Node:
        k = self.tok.kind
        if k == "func" and top:
            return self.func_decl()
        if k == "import":
            raise self.fail("a declaration other than import")
        if k in ("const", "var"):
            return self.group(k, self.value_spec)
        if k == "type":
            return self.group(k, self.type_spec)
        raise self.fail("a declaration")

    def group(self, word: str, spec) -> Node:
        line, specs = self.want(word).line, []
        if self.got("("):
            while self.tok.kind != ")":
                specs.append(spec(word, len(specs)))
                self.end_of_statement()
            self.want(")")
        else:
            specs.append(spec(word, 0))
        return Node("GenDecl", line, specs, word)

    def import_spec(self, word: str, n: int) -> Node:
        line, alias = self.tok.line, None
        if self.tok.kind == "name":
            alias = self.name()
        elif self.tok.kind == ".":
            alias = Node("Ident", self.next().line, None, ".")
        t = self.want("STRING")
        return Node("ImportSpec", line, [alias, Node("BasicLit", t.line, None, t.text, "STRING")], t.text)

    def value_spec(self, word: str, n: int) -> Node:
        line, names = self.tok.line, [self.name()]
        while self.got(","):
            names.append(self.name())
        kind = self.type() if self.tok.kind in TYPE_STARTS else None
        values = self.expressions() if self.got("=") else []
        if word == "var" and kind is None and not values or word == "const" and n == 0 and not values:
            raise self.fail("a type or value")
        return Node("ValueSpec", line, [*names, kind, *values], word, (names, values))

    def type_spec(self, word: str, n: int) -> Node:
        name, params = self.name(), None
        if self.tok.kind == "[" and self.is_type_params():
            params = self.type_params()
        self.got("=")
        kind = self.type()
        return Node("TypeSpec", name.line, [name, params, kind], name.text, kind)

    def is_type_params(self) -> bool:
        """Whether the bracket after a declared type's name opens type parameters rather than a length."""
        if self.peek() != "name":
            return False
        after = self.peek(2)
        if after == ",":
            return True
        if after == "*":  # [P *T,] and [P *T | U]; alone it is a product
            depth, j = 0, self.i
            while j < len(self.toks):
                k = self.toks[j].kind
                depth += (k in "([{") - (k in ")]}") if len(k) == 1 else 0
                if depth == 1 and k in (",", "|"):
                    return True
                if depth == 0:
                    return False
                j += 1
        return after in ("name", "interface", "func", "map", "chan", "[", "~", "struct", "<-") or after == "(" and False

    def type_params(self) -> Node:
        line, fields = self.want("[").line, []
        while self.tok.kind != "]":
            names = [self.name()]
            while self.got(","):
                names.append(self.name())
            kind = self.constraint()
            fields.append(Node("Field", names[0].line, [*names, kind], "", (names, kind)))
            if not self.got(","):
                break
        self.want("]")
        return Node("FieldList", line, fields)

    def constraint(self) -> Node:
        x = self.term()
        while self.tok.kind == "|":
            line = self.next().line
            x = Node("Binary", line, [x, self.term()], "|")
        return x

    def term(self) -> Node:
        if self.tok.kind == "~":
            line = self.next().line
            return Node("Unary", line, [self.type()], "~")
        return self.type()

    def func_decl(self) -> Node:
        line = self.want("func").line
        recv = self.parameters() if self.tok.kind == "(" else None
        name = self.name()
        params = self.type_params() if self.tok.kind == "[" else None
        kind = self.signature(line, params)
        body, brace, end = None, -1, self.toks[self.i - 1].line
        if self.tok.kind == "{":
            brace = self.tok.at
            level, self.level = self.level, 0
            body = self.block()
            self.level = level
            end = self.toks[self.i - 1].line
        return Node("FuncDecl", line, [recv, name, kind, body], name.text, {"recv": recv, "type": kind, "body": body, "brace": brace, "end": end})

    def signature(self, line: int, params: Node | None = None) -> Node:
        args = self.parameters()
        results = None
        if self.tok.kind == "(":
            results = self.parameters()
        elif self.tok.kind in TYPE_STARTS:
            t = self.type()
            results = Node("FieldList", t.line, [Node("Field", t.line, [t], "", ([], t))])
        return Node("FuncType", line, [params, args, results], "", args)

    def parameters(self) -> Node:
        """A list in parentheses: of types, or of names with types."""
        line = self.want("(").line
        entries: list[tuple[Node | None, Node | None]] = []
        while self.tok.kind != ")":
            if self.tok.kind == "name" and self.names_parameter():
                entries.append((self.name(), self.parameter_type()))
            elif self.tok.kind == "name" and self.peek() in (",", ")"):
                entries.append((self.name(), None))
            else:
                entries.append((None, self.parameter_type()))
            if not self.got(","):
                break
        self.want(")")
        fields, waiting = [], []
        if any(n is not None and t is not None for n, t in entries):
            for n, t in entries:
                if n is None:
                    raise self.fail("names for all parameters")
                waiting.append(n)
                if t is not None:
                    fields.append(Node("Field", waiting[0].line, [*waiting, t], "", (waiting, t)))
                    waiting = []
            if waiting:
                raise self.fail("a type for the last parameter")
        else:
            fields = [Node("Field", (t or n).line, [t or n], "", ([], t or n)) for n, t in entries]
        return Node("FieldList", line, fields)

    def names_parameter(self) -> bool:
        """Whether the name at hand is followed by a type."""
        k = self.peek()
        if k == "[":  # a []T, a [n]T; but T[int]
            if self.peek(2) == "]":
                return True
            depth, j = 0, self.i + 1
            while j < len(self.toks):
                depth += (self.toks[j].kind == "[") - (self.toks[j].kind == "]")
                j += 1
                if depth == 0:
                    break
            return j < len(self.toks) and self.toks[j].kind in TYPE_STARTS
        return k in TYPE_STARTS or k == "..."

    def parameter_type(self) -> Node:
        if self.tok.kind == "...":
            line = self.next().line
            return Node("Ellipsis", line, [self.type()])
        return self.type()

    # -------------------------------------------------------------- types
    def type(self) -> Node:
        k, line = self.tok.kind, self.tok.line
        if k == "name":
            return self.type_name()
        if k == "*":
            self.next()
            return Node("Star", line, [self.type()])
        if k == "(":
            self.next()
            t = self.type()
            self.want(")")
            return Node("Paren", line, [t])
        if k == "[":
            return self.array_type()
        if k == "func":
            self.next()
            return self.signature(line)
        if k == "map":
            self.next()
            self.want("[")
            key = self.type()
            self.want("]")
            return Node("MapType", line, [key, self.type()])
        if k in ("chan", "<-"):
            if self.next().kind == "<-":
                self.want("chan")
            else:
                self.got("<-")
            return Node("ChanType", line, [self.type()])
        if k == "struct":
            return self.struct_type()
        if k == "interface":
            return self.interface_type()
        raise self.fail("a type")

    def type_name(self) -> Node:
        x: Node = self.name()
        if self.tok.kind == ".":
            self.next()
            x = Node("Selector", x.line, [x, self.name()])
        if self.tok.kind == "[" and self.peek() != "]":
            self.next()
            args = [self.type()]
            while self.got(",") and self.tok.kind != "]":
                args.append(self.type())
            self.want("]")
            x = Node("Index" if len(args) == 1 else "IndexList", x.line, [x, *args])
        return x

    def array_type(self) -> Node:
        line, size = self.want("[").line, None
        if self.tok.kind == "...":
            size = Node("Ellipsis", self.next().line)
        elif self.tok.kind != "]":
            level, self.level = self.level, self.level + 1 if self.level >= 0 else 1
            size = self.expression()
            self.level = level
        self.want("]")
        return Node("ArrayType", line, [size, self.type()])

    def struct_type(self) -> Node:
        line, fields = self.want("struct").line, []
        self.want("{")
        while self.tok.kind != "}":
            first, names = self.tok.line, []
            if self.tok.kind == "name" and self.peek() not in (".", ";", "}", "STRING") and not (self.peek() == "[" and self.embeds_generic()):
                names = [self.name()]
                while self.got(","):
                    names.append(self.name())
                kind = self.type()
            elif self.tok.kind in ("name", "*", "("):
                kind = self.type()
            else:
                raise self.fail("a field")
            tag = None
            if self.tok.kind == "STRING":
                t = self.next()
                tag = Node("BasicLit", t.line, None, t.text, "STRING")
            fields.append(Node("Field", first, [*names, kind, tag], "", (names, kind)))
            self.end_of_statement()
        self.want("}")
        return Node("StructType", line, [Node("FieldList", line, fields)], "", fields)

    def embeds_generic(self) -> bool:
        """Whether name[...] stands alone as an embedded type."""
        depth, j = 0, self.i + 1
        while j < len(self.toks):
            depth += (self.toks[j].kind == "[") - (self.toks[j].kind == "]")
            j += 1
            if depth == 0:
                break
        return self.peek(2) != "]" and j < len(self.toks) and self.toks[j].kind in (";", "}", "STRING")

    def interface_type(self) -> Node:
        line, fields = self.want("interface").line, []
        self.want("{")
        while self.tok.kind != "}":
            first = self.tok.line
            if self.tok.kind == "name" and self.peek() == "(":
                name = self.name()
                kind = self.signature(first)
                fields.append(Node("Field", first, [name, kind], "", ([name], kind)))
            else:
                kind = self.constraint()
                fields.append(Node("Field", first, [kind], "", ([], kind)))
            self.end_of_statement()
        self.want("}")
        return Node("InterfaceType", line, [Node("FieldList", line, fields)])

    # -------------------------------------------------------------- expressions
    def expressions(self) -> list[Node]:
        out = [self.expression()]
        while self.got(","):
            out.append(self.expression())
        return out

    def expression(self, least: int = 1) -> Node:
        x = self.unary()
        while (p := PRECEDENCE.get(self.tok.kind, 0)) >= least:
            op = self.next().kind
            x = Node("Binary", x.line, [x, self.expression(p + 1)], op)
        return x

    def unary(self) -> Node:
        k, line = self.tok.kind, self.tok.line
        if k in ("+", "-", "!", "^", "&", "~"):
            self.next()
            return Node("Unary", line, [self.unary()], k)
        if k == "<-":
            if self.peek() == "chan":
                return self.primary(self.type())
            self.next()
            return Node("Unary", line, [self.unary()], k)
        if k == "*":
            self.next()
            return Node("Star", line, [self.unary()])
        return self.primary(self.operand())

    def operand(self) -> Node:
        k, line = self.tok.kind, self.tok.line
        if k == "name":
            return self.name()
        if k in LITERALS:
            t = self.next()
            return Node("BasicLit", line, None, t.text, t.kind)
        if k == "(":
            self.next()
            level, self.level = self.level, self.level + 1 if self.level >= 0 else 1
            x = self.expression_or_type()
            self.level = level
            self.want(")")
            return Node("Paren", line, [x])
        if k == "func":
            self.next()
            kind = self.signature(line)
            if self.tok.kind != "{":
                return kind
            level, self.level = self.level, 0
            body = self.block()
            self.level = level
            return Node("FuncLit", line, [kind, body], "", kind)
        if k in ("[", "struct", "map", "chan", "interface"):
            return self.type()
        raise self.fail("an expression")

    def expression_or_type(self) -> Node:
        return self.type() if self.tok.kind == "<-" and self.peek() == "chan" else self.expression()

    def primary(self, x: Node) -> Node:
        while True:
            k = self.tok.kind
            if k == ".":
                self.next()
                if self.got("("):
                    kind = None if self.got("type") else self.type()
                    self.want(")")
                    x = Node("TypeAssert", x.line, [x, kind], "type" if kind is None else "")
                else:
                    x = Node("Selector", x.line, [x, self.name()])
            elif k == "[":
                x = self.index(x)
            elif k == "(":
                x = self.call(x)
            elif k == "{" and self.opens_literal(x):
                x = self.composite(x)
            else:
                return x

    def opens_literal(self, x: Node) -> bool:
        if x.kind in ("ArrayType", "MapType", "StructType"):
            return True
        if self.level < 0:
            return False
        base = x.kids[0] if x.kind in ("Index", "IndexList") else x
        return base.kind == "Ident" or base.kind == "Selector" and base.kids[0].kind == "Ident"

    def index(self, x: Node) -> Node:
        self.want("[")
        level, self.level = self.level, self.level + 1 if self.level >= 0 else 1
        parts: list[Node | None] = [None]
        if self.tok.kind != ":":
            parts = [self.expression_or_type()]
        if self.tok.kind == ":":
            while self.got(":"):
                parts.append(self.expression() if self.tok.kind not in (":", "]") else None)
            if len(parts) > 3:
                raise self.fail("]")
            out = Node("Slice", x.line, [x, *parts])
        else:
            while self.got(",") and self.tok.kind != "]":
                parts.append(self.type())
            out = Node("Index" if len(parts) == 1 else "IndexList", x.line, [x, *parts])
        self.level = level
        self.want("]")
        return out

    def call(self, x: Node) -> Node:
        self.want("(")
        level, self.level = self.level, self.level + 1 if self.level >= 0 else 1
        args = []
        while self.tok.kind != ")":
            args.append(self.expression_or_type())
            self.got("...")
            if not self.got(","):
                break
        self.level = level
        self.want(")")
        return Node("Call", x.line, [x, *args])

    def composite(self, kind: Node | None) -> Node:
        line = self.want("{").line
        level, self.level = self.level, 0
        elements = []
        while self.tok.kind != "}":
            x = self.element()
            if self.got(":"):
                x = Node("KeyValue", x.line, [x, self.element()])
            elements.append(x)
            if not self.got(","):
                break
        self.level = level
        self.want("}")
        return Node("CompositeLit", kind.line if kind else line, [kind, *elements])

    def element(self) -> Node:
        return self.composite(None) if self.tok.kind == "{" else self.expression()

    # -------------------------------------------------------------- statements
    def block(self) -> Node:
        line = self.want("{").line
        body = self.statements()
        self.want("}")
        return Node("Block", line, body)

    def statements(self) -> list[Node]:
        out = []
        while self.tok.kind not in ("}", "case", "default", "end"):
            s = self.statement()
            if s is not None:
                out.append(s)
            if self.tok.kind in ("}", "case", "default"):
                break
            self.want(";")
        return out

    def statement(self) -> Node | None:
        k, line = self.tok.kind, self.tok.line
        if k == ";":
            return Node("Empty", line)
        if k in ("const", "var", "type"):
            return Node("DeclStmt", line, [self.declaration(False)])
        if k == "{":
            return self.block()
        if k == "if":
            return self.if_statement()
        if k == "for":
            return self.for_statement()
        if k == "switch":
            return self.switch_statement()
        if k == "select":
            return self.select_statement()
        if k in ("go", "defer"):
            self.next()
            x = self.expression()
            if x.kind != "Call":
                raise self.fail("a call")
            return Node(k.title(), line, [x])
        if k == "return":
            self.next()
            return Node("Return", line, self.expressions() if self.tok.kind not in (";", "}") else [])
        if k in ("break", "continue", "goto", "fallthrough"):
            self.next()
            return Node("Branch", line, [self.name() if self.tok.kind == "name" and k != "fallthrough" else None], k)
        if k == "name" and self.peek() == ":":
            label = self.name()
            self.next()
            if self.tok.kind in ("}", "case", "default"):
                return Node("Labeled", line, [label, Node("Empty", self.tok.line)])
            return Node("Labeled", line, [label, self.statement()])
        return self.simple()

    def simple(self, ranged: bool = False) -> Node:
        """An expression, send, increment or assignment; with ranged, also the head of a range loop."""
        line = self.tok.line
        if ranged and self.tok.kind == "range":
            self.next()
            return Node("RangeHead", line, [self.expression()])
        left = self.expressions()
        k = self.tok.kind
        if k in ASSIGNS:
            self.next()
            if ranged and self.tok.kind == "range" and k in ("=", ":="):
                self.next()
                return Node("RangeHead", line, [*left, self.expression()])
            right = self.expressions()
            if k == ":=" and any(x.kind != "Ident" for x in left):
                raise self.fail("names left of :=")
            return Node("Assign", line, [*left, *right], k)
        if len(left) > 1:
            raise self.fail("an assignment")
        if k in ("++", "--"):
            self.next()
            return Node("IncDec", line, left, k)
        if k == "<-":
            self.next()
            return Node("Send", line, [left[0], self.expression()])
        return Node("ExprStmt", line, left)

    def if_statement(self) -> Node:
        line = self.want("if").line
        level, self.level = self.level, -1
        start = cond = None
        if self.tok.kind == "{":
            raise self.fail("a condition")
        if self.tok.kind != ";":
            cond = self.simple()
        if self.tok.kind == ";":
            self.next()
            start, cond = cond, self.simple()
        if cond is None or cond.kind != "ExprStmt":
            raise self.fail("a condition")
        self.level = level
        body, other = self.block(), None
        if self.got("else"):
            if self.tok.kind not in ("if", "{"):
                raise self.fail("if or a block")
            other = self.if_statement() if self.tok.kind == "if" else self.block()
        return Node("If", line, [start, cond.kids[0], body, other], "", (body, other))

    def for_statement(self) -> Node:
        line = self.want("for").line
        level, self.level = self.level, -1
        head: list[Node | None] = []
        if self.tok.kind != "{":
            first = self.simple(True) if self.tok.kind != ";" else None
            if first is not None and first.kind == "RangeHead":
                self.level = level
                body = self.block()
                return Node("Range", line, [*first.kids, body], "", body)
            if self.tok.kind == ";":
                self.next()
                cond = self.simple() if self.tok.kind not in (";", "{") else None
                if self.tok.kind != "{" or cond is not None:
                    self.want(";")
                post = self.simple() if self.tok.kind != "{" else None
                head = [first, cond.kids[0] if cond is not None and cond.kind == "ExprStmt" else cond, post]
            else:
                if first is None or first.kind != "ExprStmt":
                    raise self.fail("a condition")
                head = [first.kids[0]]
        self.level = level
        body = self.block()
        return Node("For", line, [*head, body], "", body)

    def switch_statement(self) -> Node:
        line = self.want("switch").line
        level, self.level = self.level, -1
        start = tag = None
        if self.tok.kind != "{":
            if self.tok.kind != ";":
                tag = self.simple()
            if self.tok.kind == ";":
                self.next()
                start, tag = tag, self.simple() if self.tok.kind != "{" else None
        self.level = level
        guard = tag is not None and (tag.kind == "Assign" and tag.text == ":=" and tag.kids[-1].text == "type" or tag.kind == "ExprStmt" and tag.kids[0].kind == "TypeAssert" and tag.kids[0].text == "type")
        first, clauses = self.want("{").line, []
        while self.tok.kind in ("case", "default"):
            at = self.next()
            exprs: list[Node] = []
            if at.kind == "case":
                exprs = [self.type_case() if guard else self.expression()]
                while self.got(","):
                    exprs.append(self.type_case() if guard else self.expression())
            self.want(":")
            body = self.statements()
            clauses.append(Node("Case", at.line, [*exprs, *body], "", (exprs, body)))
        self.want("}")
        block = Node("Block", first, clauses)
        if not guard and tag is not None and tag.kind == "ExprStmt":
            tag = tag.kids[0]
        return Node("TypeSwitch" if guard else "Switch", line, [start, tag, block], "", clauses)

    def type_case(self) -> Node:
        return self.type()

    def select_statement(self) -> Node:
        line = self.want("select").line
        first, clauses = self.want("{").line, []
        while self.tok.kind in ("case", "default"):
            at = self.next()
            comm = self.simple() if at.kind == "case" else None
            self.want(":")
            body = self.statements()
            clauses.append(Node("Comm", at.line, [comm, *body], "", (None, body)))
        self.want("}")
        return Node("Select", line, [Node("Block", first, clauses)], "", clauses)


def parse(source: str) -> Node:
    """The tree of a file; raises ``SyntaxProblem`` for text that is not Go."""
    try:
        return Parser(source).file()
    except RecursionError as e:
        raise SyntaxProblem("nested too deeply") from e
