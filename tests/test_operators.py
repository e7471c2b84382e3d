import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cragline.functions.globs import to_regex
from cragline.functions.paths import import_dir, porcelain_path
from cragline.operators import gates, metrics, profiling
from cragline.operators.intervals import overlap_join
from cragline.plans.facts import TEXT, fact_batches, functions, parse_files


def facts(spark, **files):
    rows = [(k.replace("__", "/") + ".go", v) for k, v in files.items()]
    return parse_files(spark.createDataFrame(rows, "path string, content string"))


def found(gate):
    rows = [(r.path, r.line, r.message) for r in gate.violations.orderBy("path", "ord", "by", "line").collect()]
    return rows, gate.checked.first().checked


@pytest.mark.parametrize("cc,cov,want", [(5, 1.0, 5.0), (5, 0.0, 30.0), (8, 0.45, 18.648), (3, None, None)])
def test_score(spark, cc, cov, want):
    got = spark.createDataFrame([(cc, cov)], "cc int, cov double").select(metrics.crap(F.col("cc"), F.col("cov")).alias("s")).first().s
    assert got == want if want is None else abs(got - want) < 1e-9


def blocks(spark, *rows, path="m/a.go"):
    return spark.createDataFrame([(path, *r) for r in rows], "profile_path string, b_start int, b_end int, num_stmt long, cnt long")


def test_coverage_by_overlap(spark):
    b = blocks(spark, (5, 5, 1, 3), (10, 10, 1, 0), (12, 14, 2, 2), (30, 38, 5, 5))
    f = spark.createDataFrame([("m/a.go", 1, 9, 14), ("m/a.go", 2, 100, 110), ("x.go", 3, 9, 14), ("m/a.go", 4, 1, 500)], "profile_path string, func_id int, start_line int, end_line int")
    got = {r.func_id: r.coverage for r in metrics.method_coverage(f, b).collect()}
    assert got == {1: 2 / 3, 2: None, 3: None, 4: 8 / 9}


def test_overlap_join_takes_each_pair_once(spark):
    a = spark.createDataFrame([("k", i, i * 7 % 50, i * 7 % 50 + i) for i in range(40)], "k string, i int, a int, b int")
    b = spark.createDataFrame([("k", j, j * 11 % 60, j * 11 % 60 + j % 13) for j in range(40)], "k string, j int, c int, d int")
    got = sorted((r.i, r.j) for r in overlap_join(a, b, "k", ("a", "b"), ("c", "d"), 8).collect())
    assert got == sorted((r.i, r.j) for r in a.crossJoin(b.drop("k")).where("c <= b AND d >= a").collect())


def test_cover_lines(spark):
    lines = lambda *x: spark.createDataFrame([(v,) for v in x], "line string")
    rows = metrics.cover_blocks(lines("mode: set", "# x", "", "m/a.go:3.15,5.2 1 1")).collect()
    assert [tuple(r) for r in rows] == [("m/a.go", 3, 15, 5, 2, 1, 1)]
    with pytest.raises(Exception, match="malformed"):
        metrics.cover_blocks(lines("not a block")).collect()


def test_path_fallback_takes_the_smallest_of_equal_names(spark):
    f = spark.createDataFrame([("a/x.go",), ("b/y.go",), ("z.go",)], "path string")
    b = spark.createDataFrame([("a/x.go",), ("m/2/y.go",), ("m/1/y.go",)], "profile_path string")
    got = {r.path: (r.profile_path, r.cov_ambiguous) for r in metrics.resolve_coverage(f, b).collect()}
    assert got == {"a/x.go": ("a/x.go", False), "b/y.go": ("m/1/y.go", True), "z.go": (None, False)}


def test_analyze_orders_and_scores(spark):
    fs = facts(spark, a="package p\n\nfunc A() {\n\tx()\n}\n\nfunc B() {\n\tif x {\n\t\ty()\n\t}\n\tz()\n}\n")
    b = blocks(spark, (3, 5, 1, 3), (7, 7, 1, 1), (8, 9, 1, 0), (10, 11, 1, 1))
    rows = metrics.sorted_metrics(metrics.analyze(functions(fs), b)).collect()
    assert [(r.display_name, r.cc, r.coverage) for r in rows] == [("B", 2, 2 / 3), ("A", 1, 1.0)]
    assert abs(rows[0].crap - (4 / 27 + 2)) < 1e-12
    none = metrics.analyze(functions(fs), None)
    assert metrics.summary(none).first().max_crap == 0.0
    with pytest.raises(ValueError):
        metrics.summary(none, float("nan"))


@pytest.mark.parametrize(
    "pattern,name,match",
    [("ui/**", "ui/nested/panel.go", True), ("ui/*", "ui/nested/panel.go", False), ("**/db/**", "db", True), ("**/db/**", "example.com/demo/db", True), ("**/db/**", "example.com/other/dbx", False), ("**", "anything/at/all", True),
     ("encoding/*", "encoding/json/sub", False), ("a?c", "ac", False), ("*.go", "ui/panel.go", False), ("é*", "éa", True), ("a+b", "a+b", True), ("a", "a\n", False)],
)
def test_globs(spark, pattern, name, match):
    assert spark.createDataFrame([(name,)], "n string").select(F.col("n").rlike(to_regex(pattern)).alias("m")).first().m == match


def test_import_dirs_and_status_lines(spark):
    paths = ["example.com/demo", "example.com/demo/nested/pkg", "example.com/demoevil", "x"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r.d for r in df.select(import_dir(F.col("p"), "example.com/demo").alias("d")).collect()] == [".", "nested/pkg", "", ""]
    assert {r.d for r in df.select(import_dir(F.col("p"), "").alias("d")).collect()} == {""}
    lines = [" M a.go", "R  old.go -> new.go", "??", "?? dir/"]
    got = spark.createDataFrame([(x,) for x in lines], "l string").select(porcelain_path(F.col("l")).alias("p")).collect()
    assert [r.p for r in got] == ["a.go", "new.go", None, "dir/"]


def test_class_size(spark):
    many = "package p\n" + "".join(f"func (t *T) M{i}() {{}}\n" for i in range(26))
    deep = "package q\n" + "".join(f"func (u U) M{i}() {{\n" + "if a {\n}\n" * 20 + "}\n" for i in range(4))
    rows, checked = found(gates.class_size(facts(spark, p__a=many, q__a=deep)))
    assert rows == [("p/a.go", 2, "T has 26 methods > max 25"), ("q/a.go", 2, "U WMC=84 > max 80")] and checked == 2
    halves = ["package p\n" + "".join(f"func (t T) {x}{i}() {{}}\n" for i in range(15)) for x in "AB"]
    assert found(gates.class_size(facts(spark, p__a=halves[0], p__b=halves[1])))[0] == [("p/a.go", 2, "T has 30 methods > max 25")]


def test_weight(spark):
    text = "package p\ntype Data struct { A, B int; pkg.Writer }\ntype Ok struct { A int }\nfunc (o Ok) X() {}\nfunc (o *Ok) Y() {}\nfunc (o Ok) Z() {}\ntype hidden struct { A int }\ntype None struct { a int; *buf }\ntype F int\n"
    rows, checked = found(gates.weight_of_class(facts(spark, a=text)))
    assert rows == [("a.go", 2, "Data exposes 3 public fields of 3 public members (weight=1.00)")] and checked == 3


def test_unused_code(spark):
    a = "package p\nfunc used() {}\nfunc lonely() {}\ntype t int\nvar v, _ = 1, 2\nconst c = 3\nfunc init() {}\nfunc Exported() {}\n"
    rows, checked = found(gates.unused_code(facts(spark, p__a=a, p__b="package p\nvar X = used\n", q__a="package q\nvar Y = lonely\n")))
    assert [m for _, _, m in rows] == [f"{n} is never referenced" for n in ("lonely", "t", "v", "c", "init")] and checked == 6


def test_unused_files(spark):
    fs = facts(spark, cmd__m='package main\nimport "e.com/m/a"\n', a__a="package a\n", b__b="package b\n", bad="package {")
    assert found(gates.unused_files(fs, "e.com/m")) == ([("b", None, "package b is never imported by any analyzed package")], 2)
    assert found(gates.unused_files(fs, ""))[1] == 2


def test_banned_imports(spark):
    fs = facts(spark, ui__v='package ui\nimport (\n\t"e.com/m/db"\n\t"fmt"\n)\n', core__c='package core\nimport "e.com/m/db"\n')
    rows, checked = found(gates.banned_imports(fs, [gates.Rule("ui/**", "db", "no")], "e.com/m"))
    assert rows == [("ui/v.go", 3, 'import "e.com/m/db" is banned for ui/v.go — no')] and checked == 1
    assert found(gates.banned_imports(fs, [], "m")) == ([], 0)
    with pytest.raises(ValueError):
        gates.rules_from(["a"], [], [])


@pytest.mark.parametrize(
    "body,n",
    [
        ("func f() { g(0xFF00FF) }", 1), ("const c = 0xFF00FF", 0), ("const (\n c = f(\n0xFF00FF,\n)\n)", 0), ("func f() { g(0x1234567) }", 1), ("func f() { g(0xFFF) }", 0),
        ('func f() {\ng("abcd")\ng("abcd")\ng("abcd")\n}', 3), ("func f() { g(1000, 1000, 1000) }", 3), ('func f() {\ng("abc")\ng("abc")\ng("abc")\n}', 0),
        ('var m = map[string]int{\n"abcd": 1}\nvar n = m["abcd"]\nvar o = m["abcd"]', 0), ('func f() { switch x {\ncase "abcd":\ncase "abcd", "b":\ncase "abcd":\n} }', 0),
        ('const c = "abcd"\nfunc f() {\ng("abcd")\ng("abcd")\n}', 0), ('const c = "abcd"\nfunc f() {\ng("abcd")\ng("abcd")\ng("abcd")\n}', 3), ('func f() {\ng("1000")\ng(1000)\ng(`1000`)\n}', 3),
    ],
)
def test_magic_constants(spark, body, n):
    assert len(found(gates.magic_constants(facts(spark, a=f"package p\n{body}\n")))[0]) == n


def test_assertions(spark):
    body = """package p
func TestNone(t *testing.T) { t.Log(1) }
func TestGood(q *testing.T) { q.Errorf("x") }
func TestSub(t *testing.T) { t.Run("a", func(u *testing.T) { u.Fatal(1) }) }
func TestPanic(t *testing.T) { panic(1) }
func TestLate(t *testing.T) { u.Error(1); f(func(u *testing.T) {}) }
func TestMain(m *testing.M) {}
func Testing(t *testing.T) {}
func BenchmarkX(b *testing.B) {}
func (s S) TestMethod(t *testing.T) {}
"""
    rows, checked = found(gates.test_assertions(facts(spark, a_test=body)))
    assert [m.split()[0] for _, _, m in rows] == ["TestNone", "TestLate", "TestMethod"] and checked == 6


def test_naming_and_folders(spark):
    names = ["util", "UTILS", "batch1", "Report2", "day_1", "configv3", "base64", "sha256", "parser", "123"]
    files = spark.createDataFrame([(f"d/{n}.go",) for n in names], "path string")
    rows, checked = found(gates.file_naming(files))
    assert sorted(p[2:-3] for p, _, _ in rows) == sorted(names[:6]) and checked == 10
    dirs = spark.createDataFrame([(".", 0), ("d", 1), ("e", 2)], "dir string, ord int")
    loose = spark.createDataFrame([("a.go",), ("b.go",), ("c_test.go",), ("d/x/a.go",)], "path string")
    rows, checked = found(gates.folder_structure(dirs, loose))
    assert rows == [(".", None, "2 loose .go files directly in . — group them into feature packages (max 0)")] and checked == 3


def test_timings(spark):
    lines = ["a\t10", "a\t20", "b\t5", "no tab", "\t5", "c\tx", "d\t 5", "e\t-3", "f\t99999999999999999999"]
    stats = profiling.timing_stats(profiling.timing_entries(spark.createDataFrame([(x,) for x in lines], "line string")))
    got = {r.key: (r.calls, r.total_us, r.min_us, r.max_us) for r in stats.collect()}
    assert got == {"a": (2, 30, 10, 20), "b": (1, 5, 5, 5), "e": (1, -3, -3, 0)}


def test_ranking(spark):
    p = spark.createDataFrame([("x.go", 0, "A", 1, 3, 3000, 900, 1200), ("x.go", 1, "B", 5, 1, 1000, 1000, 1000)], "path string, ordinal int, display_name string, start_line int, calls long, total_us long, min_us long, max_us long")
    top = profiling.ranked(p, 1).collect()
    assert [(r.display_name, r.share, r.mean_us) for r in top] == [("A", 75.0, 1000.0)]
    assert tuple(profiling.over_threshold(p, 2.0).first()) == (1, "A", 3000) and tuple(profiling.over_threshold(p, 5.0).first()) == (0, None, None)
    assert "Window" not in plan(profiling.ranked(p))


def test_attribution_gives_equal_names_the_whole(spark):
    fs = functions(facts(spark, a="package p\nfunc init() {}\nfunc init() {}\nfunc g()\n"))
    stats = spark.createDataFrame([("a.go|init", 2, 30, 10, 20), ("zz|q", 1, 1, 1, 1)], "key string, calls long, total_us long, min_us long, max_us long")
    assert [(r.ordinal, r.total_us) for r in profiling.attributed(fs, stats).orderBy("ordinal").collect()] == [(0, 30), (1, 30)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_files_are_parsed_once(spark):
    fs = facts(spark, util="package p\nfunc lonely() {}\n")
    for gate in (gates.nesting(fs), gates.class_size(fs), gates.weight_of_class(fs), gates.unused_code(fs), gates.unused_files(fs, "m"), gates.magic_constants(fs), gates.test_assertions(fs), gates.banned_imports(fs, [gates.Rule("**", "x")], "m")):
        assert plan(gate.violations).count("MapInArrow") == 1, gate.name
    every = gates.all_gates(fs, "m")
    assert "MapInArrow" not in plan(every) and {r.gate for r in every.collect()} == {"file-naming", "unused-code", "unused-files"}


def test_findings_come_in_order(spark):
    many = lambda t, n: "".join(f"func (x {t}) {t}{i}() {{\n" + "if a {\n}\n" * 5 + "}\n" for i in range(n))
    rows, _ = found(gates.class_size(facts(spark, a="package p\n" + many("B", 26) + many("A", 26))))
    assert [m for _, _, m in rows] == ["B has 26 methods > max 25", "B WMC=156 > max 80", "A has 26 methods > max 25", "A WMC=156 > max 80"]
    body = "package p\n" + "".join(f'var a{i} = f("{v}")\n' for i, v in enumerate(["zeta", "beta"] * 3)) + "var c = 0xFF00FF\n"
    rows, _ = found(gates.magic_constants(facts(spark, a=body)))
    assert [(line, m.split()[1]) for _, line, m in rows] == [(8, "color"), (3, "beta"), (5, "beta"), (7, "beta"), (2, "zeta"), (4, "zeta"), (6, "zeta")]


def test_large_numbers_and_wide_ranges(spark):
    rows = metrics.cover_blocks(spark.createDataFrame([("m/a:b.go:99999999999.1,99999999999.2 1 3",)], "line string")).collect()
    assert [tuple(r) for r in rows] == [("m/a:b.go", 99999999999, 1, 99999999999, 2, 1, 3)]
    with pytest.raises(Exception, match="malformed cover line: x:1.1,2.2 1 9{20}"):
        metrics.cover_blocks(spark.createDataFrame([("x:1.1,2.2 1 " + "9" * 20,)], "line string")).collect()
    f = spark.createDataFrame([("k", i, 100 * i + 1, 100 * i + 90 if i % 50 else 100 * i + 40_000) for i in range(300)], "key string, i int, a long, b long")
    b = spark.createDataFrame([("k", 0, 1, 2_000_000_000), ("k", 1, 5_000, 20_000), *(("k", j, j * 53, j * 53 + j % 200) for j in range(2, 300))], "key string, j int, c long, d long")
    began = time.perf_counter()
    got = sorted((r.i, r.j) for r in overlap_join(f, b, "key", ("a", "b"), ("c", "d")).collect())
    assert time.perf_counter() - began < 10
    assert got == sorted((r.i, r.j) for r in f.crossJoin(b.drop("key")).where("c <= b AND d >= a").collect())


def test_coverage_broadcasts_nothing_and_keeps_all_functions(spark):
    b = blocks(spark, (5, 5, 1, 3), (10, 10, 1, 0))
    f = spark.createDataFrame([("m/a.go", 1, 1, 20), ("m/a.go", 1, 9, 400), (None, 2, 1, 20), (None, 3, 1, 20), ("m/a.go", 4, 7, 6), ("m/a.go", 5, None, None)], "profile_path string, func_id int, start_line int, end_line int")
    got = metrics.method_coverage(f, b)
    assert "Broadcast" not in plan(got)
    assert sorted((r.func_id, r.start_line or 0, r.coverage) for r in got.collect() if r.coverage is not None) == [(1, 1, 0.5), (1, 9, 0.0)]
    assert sorted(r.func_id for r in got.collect()) == [1, 1, 2, 3, 4, 5]


def test_analysis_reads_its_inputs_once(spark):
    fs = facts(spark, p__a="package p\nfunc A() {\n}\n", q__b="package q\nfunc B() {\n}\n")
    lines = spark.createDataFrame([("m/p/a.go:1.1,3.2 1 1",), ("q/b.go:2.1,3.2 1 0",)], "line string").repartition(2)
    got = metrics.analyze(functions(fs), metrics.cover_blocks(lines))
    assert sorted((r.path, r.coverage) for r in got.collect()) == [("p/a.go", 1.0), ("q/b.go", 0.0)]
    assert plan(got).split("Initial Plan")[0].count("MapInArrow") == 1


def test_facts_can_be_chosen(spark):
    rows = spark.createDataFrame([("a.go", "package p\nfunc (t T) A() {\n\tif x {\n\t}\n}\n")], "path string, content string")
    got = parse_files(rows, "funcs.recv", "funcs.has_body", "funcs.decisions.line", "names")
    assert [tuple(r) for r in functions(got).select("recv", "cc").collect()] == [("T", 2)] and "literals" not in got.columns and "nesting" not in functions(got).columns
    with pytest.raises(ValueError):
        parse_files(rows, "funcs.nothing")
    with pytest.raises(ValueError):
        parse_files(rows, "nothing")


def test_facts_are_made_for_a_bounded_amount_of_text():
    texts = ["package p\n" + f"func Name{i}() {{}}\n" * 400 for i in range(300)]
    batch = pa.RecordBatch.from_pylist([{"path": str(i), "content": t} for i, t in enumerate(texts)])
    schema = pa.schema([("path", pa.string()), ("funcs", pa.list_(pa.struct([("name", pa.string())])))])
    got = list(fact_batches(iter([batch]), frozenset(["funcs"]), schema))
    assert sum(b.num_rows for b in got) == 300 and [p for b in got for p in b.column(0).to_pylist()] == [str(i) for i in range(300)]
    assert max(sum(len(texts[int(p)]) for p in b.column(0).to_pylist()) for b in got) <= TEXT + len(texts[-1])


def test_scores_deal_the_profile_out_twice(spark):
    f = spark.createDataFrame([("a.go", i, f"F{i}", 1 + 10 * i, 5 + 10 * i, 2, True) for i in range(3)], "path string, ordinal int, display_name string, start_line int, end_line int, cc int, has_body boolean")
    got = metrics.analyze(f, blocks(spark, (1, 5, 1, 1), (11, 12, 2, 0), path="m/a.go"))
    assert sorted((r.ordinal, r.coverage) for r in got.collect()) == [(0, 1.0), (1, 0.0), (2, None)]
    final = plan(got).split("Initial Plan")[0]
    assert final.count("ReusedExchange") >= 1
