import pytest

from cragline.golang import shapes, walk
from cragline.golang.lexer import SyntaxProblem, tokens, unquoted
from cragline.golang.splice import instrument
from cragline.golang.walk import file_facts


def func(body, sig="func f(x int)"):
    got = file_facts(f"package p\n{sig} {{\n{body}\n}}\n")
    assert got["parse_ok"], got["parse_error"]
    return got["funcs"][0]


@pytest.mark.parametrize(
    "body,cc",
    [
        ("x++", 1),
        ("if x > 0 {\n}\nfor {\n}", 3),
        ("for range xs {\n}\nswitch x {\ncase 1:\ncase 2:\ndefault:\n}", 5),
        ("select {\ncase <-c:\ndefault:\n}", 3),
        ("_ = a && b || c", 3),
        ("g := func() {\nif x > 0 {\n}\n}\ng()", 2),
        ("if a {\n}\nfor {\n}\nif a && b {\n}\nfor range x {\n}\nswitch {\ncase a, b:\ndefault:\n}", 8),
    ],
)
def test_decisions(body, cc):
    assert 1 + len(func(body)["decisions"]) == cc


@pytest.mark.parametrize(
    "body,depth",
    [
        ("x++", 1),
        ("if x > 0 {\n}", 2),
        ("if a {\n} else if b {\n} else {\n}", 3),
        ("switch x {\ncase 1:\nif a {\n}\n}", 3),
        ("{\n{\n}\n}", 3),
        ("if a {\nfor {\nif b {\nfor {\nif c {\n}\n}\n}\n}\n}", 6),
        ("L:\nfor {\nif a {\n}\n}", 1),
        ("go func() {\nfor {\n}\n}()", 1),
        ("if a {\n} else {\nx++\n}", 2),
    ],
)
def test_nesting(body, depth):
    assert max(func(body)["nesting"]) == depth


def test_names_ranges_and_receivers():
    got = file_facts("package p\n\nfunc A() {}\n\nfunc (t T) B() {\n\tx()\n}\nfunc (t *T) c() {}\nfunc (g G[int]) D() {}\nfunc ext()\ntype I interface{ M() }\n")
    rows = [(f["display_name"], f["start_line"], f["end_line"], f["has_body"]) for f in got["funcs"]]
    assert rows == [("A", 3, 3, True), ("(T)B", 5, 7, True), ("(T)c", 8, 8, True), ("D", 9, 9, True), ("ext", 10, 10, False)]


@pytest.mark.parametrize(
    "text",
    [
        "type A [N]int", "type A[P any] struct{ x P }", "type A[P *T,] int", "type A [N * 2]int", "type C interface{ ~int | ~string; M() }", "var f func(int, ...string) (a, b error)",
        "func g() { if v, ok := m[k]; ok { } ; switch x := y.(type) { case nil: } ; for i := range 10 { } ; for ; ; { break } }", "func h() { if (T{1}) == x { } ; for _, v := range []int{1, 2} { _ = v } }",
        "func k() { x := map[string][]int{\"a\": {1}}; y := [...]struct{ a int }{{1}}; z := &T{a: 1, b: func() int { return 1 }}; _ = x[1:2:3] }", "func l() { ch <- <-in; go f(); defer g(); goto L\nL:\n}",
        "func m[K comparable, V any](a map[K]V) (r []V) { return n[K, V](a) }", "const (\n A = iota\n B\n)", "var x = 0x1p-2 + 1_000i + 'a' + '\\x41'", "type T struct { *A; b.C `tag`; G[int]; d, e []int; f [3]int }",
        "func o(a []int, b [2]T, c p.Q, d chan<- int, e <-chan int) {}", "func p(T, *U, []V) {}", "func q() { var r = struct{}{}; type local = int; select { case v, ok := <-c: _ = v; case c <- 1: } }", "func r() { for x := range f(T2) { } ; if f(func() bool { return T{} == t }) { } }",
    ],
)
def test_accepts_go(text):
    got = file_facts(f"package p\n{text}\n")
    assert got["parse_ok"], got["parse_error"]


@pytest.mark.parametrize("text", ["package p\nfunc {{{", "package p\nvar x", "func f() {}", "package p\nfunc f() { if x { }", 'package p\nvar x = "abc', "package p\nfunc f() { x := }", "package p\n@"])
def test_rejects_what_is_not_go(text):
    assert not file_facts(text)["parse_ok"]


def test_deep_operator_chains_end():
    assert file_facts("package p\nvar x = " + " + ".join(["1"] * 3000))["parse_ok"]
    assert not file_facts("package p\nvar x = " + "(" * 100_000)["parse_ok"]


def test_semicolons_and_literals():
    assert [t.kind for t in tokens("x\n/* a\nb */ y) // c\n")] == ["name", ";", "name", ")", ";", "end"]
    assert unquoted(r'"a\n\x41\u00e9"') == b"a\nA\xc3\xa9" and unquoted("`a\\n`") == b"a\\n" and unquoted(r'"\q"') is None
    with pytest.raises(SyntaxProblem):
        tokens("'")


def test_identifier_marks_depend_on_order():
    got = file_facts('package p\nvar a = map[string]string{"key1": "val1"}\nvar b = f("early", m["late"])\n')
    marks = {m["line"]: m["preorder"] for m in got["marks"]}
    exempt = {x["value"]: marks.get(x["line"], 1 << 30) < x["preorder"] for x in got["literals"]}
    assert exempt == {"key1": True, "val1": True, "early": False, "late": True}


def test_instrumentation_inserts_after_braces():
    assert instrument("package p\nfunc (t T) A() { x() }\nfunc b()\n", "a.go", "S({key},{name})") == "package p\nfunc (t T) A() {S(a.go,(T)A); x() }\nfunc b()\n"


HEAD = 'package p\nimport "testing"\n'
PIECES = [
    'func TestX(q *testing.T) { q.Fatal(1); f(func(u *testing.T) { u.Error("x") }); panic(1) }\n', "func (s *S) Do(x int) (r int) {\n\tif x > 0 && x < 3 || x == 1.e5 {\n\t\tfor i := range x { m[\"key1\"] = \"val1\" }\n\t}\n\treturn\n}\n",
    "type S struct { A, b int; pkg.Writer; *T }\ntype G[K any] struct{ m []K }\n", 'const (\n\tc = 0xFF00FF\n\td = "abc" // no "name\n)\n', "var a, B = 1, 'x'\nfunc ext()\n", "func h() {\n\tswitch y := x.(type) { case int: return }\n\ttype l struct{ a int }\n}\n",
]


@pytest.mark.parametrize("change", [("S", "Zed"), ("Do", "do"), ("q", "T"), ("x", "_"), ("x", "y1"), ("a", "`"), ("}", "/*"), ("{", "{\nfunc "), ("1", "1."), ("x", "é"), ("\n", "\nvar z = 1\n")])
def test_shapes_give_the_facts_of_a_whole_parse(change):
    for k in range(len(PIECES) ** 2):
        text = HEAD + PIECES[k % len(PIECES)] + PIECES[k // len(PIECES)]
        at = text.find(change[0], len(HEAD) + k)
        for t in (text, text.replace(*change), text[:at] + change[1] + text[at + 1 :]):
            assert walk.file_facts(t) == walk.whole_facts(t)


def test_a_shape_is_parsed_once(monkeypatch):
    made = []
    monkeypatch.setattr(shapes, "Parser", lambda text, parser=shapes.Parser: made.append(text) or parser(text))
    got = file_facts("package once\n" + "".join(f"func (r *Once{i}) Fn{i}(arg{i} int) {{\n\tif arg{i} > 0 {{\n\t}}\n}}\n" for i in range(300)))
    assert len(made) <= 2 and [f["display_name"] for f in got["funcs"]] == [f"(Once{i})Fn{i}" for i in range(300)]
    assert got["funcs"][299]["start_line"] == 2 + 4 * 299 and all(len(f["decisions"]) == 1 for f in got["funcs"])


def test_remembered_shapes_are_bounded():
    for i in range(shapes.MOST + 50):
        assert file_facts(f"package p\nvar a = {i}\n")["literals"][0]["lexeme"] == str(i)
    assert len(shapes._known) <= shapes.MOST
