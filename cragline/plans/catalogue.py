"""Queries over the supplied tables, each with the SQL that gives the same rows without parsing.

Those of the first kind write Go text, cover profiles, status lines or timing logs from table rows and put them
through the real operators. Analogues, at the end, have an operator's relational shape over plain business rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import render
from ..functions.paths import porcelain_path
from ..operators import gates, metrics, profiling
from ..scratch import materialise
from .corpus import PER_FILE, files, text, times
from .facts import functions, parse_files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


#: The facts that a function's complexity is counted from.
COUNTED = ("funcs.has_body", "funcs.decisions.line")


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slot(column: str, n: int) -> Column:
    return F.pmod(F.col(column), F.lit(n)).cast("int")


# ---------------------------------------------------------------- coverage and scores


def cover_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile line for each line item; every hundredth order adds lines that are skipped."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("int").alias("q"))
    start = F.col("l_linenumber") * 3 + slot("l_orderkey", 40)
    line = text("m/pkg", slot("l_partkey", 97), "/f", F.col("l_partkey"), ".go:", start, ".2,", start + slot("q", 9), ".3 ", 1 + slot("q", 5), " ", slot("l_orderkey", 3))
    extra = F.when(F.col("l_orderkey") % 100 == 0, F.array(line, F.lit("mode: set"), F.lit("# note"), F.lit(""))).otherwise(F.array(line))
    return li.select(F.explode(extra).alias("line"))


BLOCKS_SQL = """
SELECT 'm/pkg' || (l_partkey % 97) || '/f' || l_partkey || '.go' AS profile_path,
       CAST(l_linenumber * 3 + l_orderkey % 40 AS BIGINT) AS b_start, CAST(2 AS BIGINT) AS b_start_col,
       CAST(l_linenumber * 3 + l_orderkey % 40 + CAST(floor(l_quantity) AS INT) % 9 AS BIGINT) AS b_end, CAST(3 AS BIGINT) AS b_end_col,
       CAST(1 + CAST(floor(l_quantity) AS INT) % 5 AS BIGINT) AS num_stmt, CAST(l_orderkey % 3 AS BIGINT) AS cnt
FROM lineitem"""


@query(BLOCKS_SQL)
def cover_profile_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.cover_blocks(cover_lines(spark, sf_dir))


def part_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four methods a part, as rows."""
    p = read(spark, sf_dir, "part").select("p_partkey", "p_size", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    path = text("m/pkg", slot("p_partkey", 97), "/f", F.col("p_partkey"), ".go")
    start = (1 + F.col("k") * 14).cast("int")
    return p.select(path.alias("path"), F.col("k").alias("ordinal"), text("F", F.col("k")).alias("display_name"), start.alias("start_line"), (start + 5 + slot("p_size", 8)).cast("int").alias("end_line"), (1 + slot("p_size", 9) + F.col("k")).cast("int").alias("cc"), F.lit(True).alias("has_body"))


METHODS_SQL = """
SELECT 'm/pkg' || (p_partkey % 97) || '/f' || p_partkey || '.go' AS path, CAST(k AS INT) AS ordinal, 'F' || k AS display_name,
       CAST(1 + k * 14 AS INT) AS start_line, CAST(1 + k * 14 + 5 + p_size % 8 AS INT) AS end_line, CAST(1 + p_size % 9 + k AS INT) AS cc
FROM part, (SELECT unnest([0, 1, 2, 3]) AS k)"""
SCORES_SQL = f"""
WITH blocks AS ({BLOCKS_SQL}), methods AS ({METHODS_SQL}),
sums AS (
  SELECT path, ordinal, sum(CASE WHEN cnt > 0 THEN num_stmt ELSE 0 END) AS covered, sum(num_stmt) AS total
  FROM methods JOIN blocks ON profile_path = path AND b_start <= end_line AND b_end >= start_line GROUP BY 1, 2),
covered AS (
  SELECT m.path, m.ordinal, display_name, start_line, cc, CASE WHEN total > 0 THEN CAST(covered AS DOUBLE) / CAST(total AS DOUBLE) END AS coverage
  FROM methods m LEFT JOIN sums s ON m.path = s.path AND m.ordinal = s.ordinal),
scores AS (
  SELECT *, CAST(cc AS DOUBLE) * cc * (1.0::DOUBLE - coverage) * (1.0::DOUBLE - coverage) * (1.0::DOUBLE - coverage) + cc AS crap FROM covered)
"""


@query(SCORES_SQL + "SELECT path, ordinal, coverage FROM covered")
def method_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = part_methods(spark, sf_dir).withColumn("func_id", F.concat_ws("#", "path", "ordinal")).withColumn("profile_path", F.col("path"))
    return metrics.method_coverage(m, metrics.cover_blocks(cover_lines(spark, sf_dir))).select("path", "ordinal", "coverage")


@query(SCORES_SQL + "SELECT path, ordinal, display_name, start_line, cc, coverage, crap FROM scores")
def crap_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.sorted_metrics(metrics.analyze(part_methods(spark, sf_dir), metrics.cover_blocks(cover_lines(spark, sf_dir))))


@query(SCORES_SQL + "SELECT count(*) AS methods, greatest(coalesce(max(crap), 0.0::DOUBLE), 0.0::DOUBLE) AS max_crap, greatest(coalesce(max(crap), 0.0::DOUBLE), 0.0::DOUBLE) <= 8.0 AS passed FROM scores")
def crap_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.summary(metrics.analyze(part_methods(spark, sf_dir), metrics.cover_blocks(cover_lines(spark, sf_dir))))


@query("""
WITH files AS (SELECT 'repo/d' || (p_partkey % 11) || '/f' || p_partkey || '.go' AS path FROM part),
known AS (SELECT DISTINCT CASE WHEN s_suppkey % 3 = 0 THEN 'repo/d' || (s_suppkey % 11) ELSE 'mod/d' || (s_suppkey % 7) END || '/f' || (s_suppkey % 500) || '.go' AS profile_path FROM supplier),
by_base AS (SELECT split_part(profile_path, '/', 3) AS base, min(profile_path) AS p, count(*) > 1 AS several FROM known GROUP BY 1)
SELECT f.path, coalesce(k.profile_path, b.p) AS profile_path, coalesce(k.profile_path IS NULL AND b.several, false) AS cov_ambiguous
FROM files f LEFT JOIN known k ON f.path = k.profile_path LEFT JOIN by_base b ON split_part(f.path, '/', 3) = b.base""")
def coverage_path_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "part").select(text("repo/d", slot("p_partkey", 11), "/f", F.col("p_partkey"), ".go").alias("path"))
    root = F.when(F.col("s_suppkey") % 3 == 0, text("repo/d", slot("s_suppkey", 11))).otherwise(text("mod/d", slot("s_suppkey", 7)))
    known = read(spark, sf_dir, "supplier").select(text(root, "/f", slot("s_suppkey", 500), ".go").alias("profile_path"))
    return metrics.resolve_coverage(own, known)


# ---------------------------------------------------------------- functions from Go text


def part_path() -> Column:
    return text("p", F.floor(F.col("p_partkey") / PER_FILE).cast("long"), "/part.go")


@query("""
SELECT 'p' || CAST(floor(p_partkey / 50) AS BIGINT) || '/part.go' AS path, 'F' || p_partkey AS display_name,
       CAST(1 + p_size % 4 + p_size % 3 + 2 * (p_size % 2) + (p_size % 5) + CASE WHEN p_size % 7 = 0 THEN 3 ELSE 0 END AS INT) AS cc FROM part""")
def cyclomatic_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda k: slot("p_size", k)
    body = text(
        "func F", F.col("p_partkey"), "(x int) int {\n", times("\tif x > 0 {\n\t\tx--\n\t}\n", n(4)), times("\tfor i := range x {\n\t\tx += i\n\t}\n", n(3)),
        times("\tswitch x {\n\tcase 1, 2:\n\t\tx++\n\tdefault:\n\t}\n", n(2)), "\t_ = x == 1", times(" && x == 2 || x == 3", F.floor(n(5) / 2)), times(" || x == 4", n(5) % 2), "\n",
        times("\tgo func() {\n\t\tif x > 1 {\n\t\t\tfor {\n\t\t\t}\n\t\t}\n\t\tselect {\n\t\tdefault:\n\t\t}\n\t}()\n", (n(7) == 0).cast("int")), "\treturn x\n}\n",
    )
    return functions(parse_files(files(read(spark, sf_dir, "part"), part_path(), body, "p_partkey"), "funcs.display_name", *COUNTED)).select("path", "display_name", "cc")


@query("""
WITH deep AS (SELECT p_partkey, p_size % 8 AS d, p_size % 3 AS v FROM part)
SELECT 'nesting' AS gate, '(T)F' || p_partkey || ' nesting=' || (1 + d + CASE WHEN v = 0 AND d > 0 THEN 1 ELSE 0 END) || ' > max 5' AS message
FROM deep WHERE 1 + d + CASE WHEN v = 0 AND d > 0 THEN 1 ELSE 0 END > 5""")
def nesting_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    # else-if chains add one level; labels, function literals and plain else branches none
    d, v = slot("p_size", 8), slot("p_size", 3)
    chain = F.when((v == 0) & (d > 0), F.lit(" else if x > 9 {\n\tx++\n}")).otherwise(F.when(d > 0, F.lit(" else {\n\tx++\n}")).otherwise(F.lit("")))
    inner = F.when(d > 0, text(times("for {\n", d - 1), "if x > 0 {\nx--\n}", chain, "\n", times("}\n", d - 1))).otherwise(F.lit(""))
    body = text("func (t *T) F", F.col("p_partkey"), "(x int) {\n", inner, "L:\nfor {\nbreak L\n}\nfunc() {\nfor {\nfor {\nfor {\nfor {\nfor {\nfor {\n}\n}\n}\n}\n}\n}\n}()\n}\n")
    return gates.nesting(parse_files(files(read(spark, sf_dir, "part"), part_path(), body, "p_partkey"), *(f"funcs.{x}" for x in ("ordinal", "display_name", "start_line", "has_body", "nesting")))).violations.select("gate", "message")


@query("""
WITH m AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_orderkey % 5 AS k FROM lineitem),
t AS (SELECT l_suppkey, count(*) AS n, CAST(sum(1 + k) AS BIGINT) AS wmc FROM m GROUP BY 1)
SELECT 'S' || l_suppkey || ' has ' || n || ' methods > max 25' AS message, CAST(0 AS BIGINT) AS ord FROM t WHERE n > 25
UNION ALL SELECT 'S' || l_suppkey || ' WMC=' || wmc || ' > max 80', 1 FROM t WHERE wmc > 80""")
def class_size_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.class_size(parse_files(method_files(spark, sf_dir), *(f"funcs.{x}" for x in ("ordinal", "recv", "has_recv", "start_line")), *COUNTED)).violations.select("message", (F.col("ord") % 2).alias("ord"))


def method_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Go files with a method for each line item."""
    li = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber")
    path = text("s/f", F.floor(F.col("l_orderkey") / PER_FILE).cast("long"), ".go")
    body = text("func (s *S", F.col("l_suppkey"), ") M", F.col("l_orderkey"), "x", F.col("l_linenumber"), "() {\n", times("if a {\n}\n", slot("l_orderkey", 5)), "}\n")
    return files(li, path, body, "l_orderkey")


@query("""
WITH c AS (SELECT c_custkey, c_custkey % 4 AS f, c_nationkey % 6 AS m FROM customer)
SELECT 'C' || c_custkey AS name, CAST(f + 1 AS BIGINT) AS fields, CAST(m AS BIGINT) AS methods, CAST(f + 1 AS DOUBLE) / CAST(f + 1 + m AS DOUBLE) AS weight
FROM c WHERE CAST(f + 1 AS DOUBLE) / CAST(f + 1 + m AS DOUBLE) > 0.33""")
def weight_of_class_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    path = text("c", F.floor(F.col("c_custkey") / PER_FILE).cast("long"), "/c.go")
    # one embedded exported field, hidden ones, and methods of which hidden ones don't count
    body = text(
        "type C", F.col("c_custkey"), " struct {\n\tio.Reader\n\tx, y int\n", times("\tA", (slot("c_custkey", 4) > 0).cast("int")), times(", B", F.greatest(slot("c_custkey", 4) - 1, F.lit(0))), times(" int\n", (slot("c_custkey", 4) > 0).cast("int")),
        "}\nfunc (c C", F.col("c_custkey"), ") hidden() {}\n", F.array_join(F.transform(F.filter(F.sequence(F.lit(0), F.lit(5)), lambda i: i < slot("c_nationkey", 6)), lambda i: text("func (c *C", F.col("c_custkey"), ") M", i, "() {}\n")), ""),
    )
    s = gates.struct_weights(parse_files(files(c, path, body, "c_custkey"), "structs", "funcs.recv", "funcs.has_recv", "funcs.exported"))
    return s.where("fields > 0").select("name", "fields", "methods", (F.col("fields").cast("double") / (F.col("fields") + F.col("methods")).cast("double")).alias("weight")).where(F.col("weight") > gates.MAX_WEIGHT)


@query("""
WITH d AS (SELECT p_partkey, p_partkey % 20 AS dir, p_partkey % 3 AS kind FROM part),
used AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_linenumber = 1)
SELECT CASE kind WHEN 0 THEN 'f' WHEN 1 THEN 't' ELSE 'v' END || p_partkey || ' is never referenced' AS message, 'u' || dir AS pkg
FROM d WHERE p_partkey NOT IN (SELECT l_partkey FROM used)""")
def unused_code_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    key = F.col("p_partkey")
    decl = F.when(key % 3 == 0, text("func f", key, "() {}\n")).when(key % 3 == 1, text("type t", key, " int\n")).otherwise(text("var v", key, " = 1\n"))
    place = lambda c, name: text("u", slot(c, 20), "/", name, F.floor(F.col(c) / (20 * PER_FILE)).cast("long"), ".go")
    declared = files(p, place("p_partkey", "d"), decl, "p_partkey")
    uses = read(spark, sf_dir, "lineitem").where("l_linenumber = 1").select("l_partkey", "l_orderkey")
    use = text("var _ = ", F.when(F.col("l_partkey") % 3 == 0, "f").when(F.col("l_partkey") % 3 == 1, "t").otherwise("v"), F.col("l_partkey"), "\n")
    users = files(uses, text("u", slot("l_partkey", 20), "/use", F.floor(F.col("l_orderkey") / PER_FILE).cast("long"), ".go"), use, "l_orderkey")
    v = gates.unused_code(parse_files(declared.union(users), "decls", "names")).violations
    return v.select("message", F.substring_index("path", "/", 1).alias("pkg"))


@query("""
WITH pk AS (SELECT s_suppkey, 's' || s_suppkey AS dir, CASE WHEN s_suppkey % 10 = 0 THEN 'main' ELSE 'q' END AS package FROM supplier),
im AS (SELECT DISTINCT 's' || (c_custkey % 37 * 3) AS dir FROM customer)
SELECT dir AS path, 'package ' || package || ' is never imported by any analyzed package' AS message FROM pk WHERE package <> 'main' AND dir NOT IN (SELECT dir FROM im)""")
def unused_packages_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier").select(text("s", F.col("s_suppkey"), "/a.go").alias("path"), text("package ", F.when(F.col("s_suppkey") % 10 == 0, "main").otherwise("q"), "\n").alias("content"))
    line = text('import "example.com/m/s', slot("c_custkey", 37) * 3, '"\nimport "example.com/mx/s1"\n')
    users = files(read(spark, sf_dir, "customer").select("c_custkey"), text("cmd/u", F.floor(F.col("c_custkey") / PER_FILE).cast("long"), ".go"), line, "c_custkey", "package main\n")
    return gates.unused_files(parse_files(s.union(users)), "example.com/m").violations.select("path", "message")


RULES = [gates.Rule("ui/**", "**/db/**", "no storage in views"), gates.Rule("**", "http?/*", ""), gates.Rule("core/*.go", "example.com/m/ui", "")]


@query("""
WITH p AS (
  SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'ui/v' WHEN 1 THEN 'core/c' ELSE 'ui/deep/w' END || page_id || '.go' AS path,
         CASE page_id % 4 WHEN 0 THEN 'example.com/m/db/' || page_id WHEN 1 THEN 'https/' || page_id WHEN 2 THEN 'example.com/m/ui' ELSE 'net/http' END AS imp FROM pages),
hits AS (
  SELECT *, 'no storage in views' AS why FROM p WHERE regexp_full_match(path, 'ui(/.*)?') AND regexp_full_match(imp, '(.*/)?db(/.*)?')
  UNION ALL SELECT *, '' FROM p WHERE regexp_full_match(imp, 'http[^/]/[^/]*')
  UNION ALL SELECT *, '' FROM p WHERE regexp_full_match(path, 'core/[^/]*\\.go') AND imp = 'example.com/m/ui')
SELECT path, CAST(2 AS INT) AS line, 'import "' || imp || '" is banned for ' || path || CASE WHEN why = '' THEN '' ELSE ' — ' || why END AS message FROM hits""".replace("\\\\", "\\"))
def banned_imports_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    path = text(F.when(k % 3 == 0, "ui/v").when(k % 3 == 1, "core/c").otherwise("ui/deep/w"), k, ".go")
    imp = F.when(k % 4 == 0, text("example.com/m/db/", k)).when(k % 4 == 1, text("https/", k)).when(k % 4 == 2, F.lit("example.com/m/ui")).otherwise(F.lit("net/http"))
    one = read(spark, sf_dir, "pages").select(path.alias("path"), text('package p\nimport x "', imp, '"\n').alias("content"))
    return gates.banned_imports(parse_files(one), RULES, "example.com/m").violations.select("path", "line", "message")


@query("""
WITH o AS (SELECT o_orderkey, CAST(floor(o_orderkey / 50) AS BIGINT) AS f, o_orderpriority AS v, o_orderkey % 6 AS k FROM orders),
lits AS (SELECT f, o_orderkey, v FROM o WHERE k IN (0, 1, 2)),
reps AS (SELECT *, count(*) OVER (PARTITION BY f, v) AS n FROM lits)
SELECT 'o/f' || f || '.go' AS path, 'literal ' || v || ' repeats ' || n || ' times — extract a named constant' AS message FROM reps WHERE n >= 3
UNION ALL SELECT 'o/f' || f || '.go', 'hex color outside a constant declaration' FROM o WHERE k = 3""")
def magic_constants_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    # strings in plain places, in a constant, as keys, and numbers that are colours or short
    k, v, key = slot("o_orderkey", 6), text('"', F.col("o_orderpriority"), '"'), F.col("o_orderkey")
    hexa = F.concat(F.lit("0x"), F.lpad(F.hex(key), 6, "0"))
    body = F.when(k < 3, text("var a", key, " = ", v, "\n")).when(k == 3, text("var a", key, " = ", hexa, "\n")).when(k == 4, text("const a", key, " = f(", v, ") + ", hexa, "\n")).otherwise(text("var a", key, " = map[string]int{", v, ": 1}\n"))
    path = text("o/f", F.floor(key / PER_FILE).cast("long"), ".go")
    return gates.magic_constants(parse_files(files(read(spark, sf_dir, "orders"), path, body, "o_orderkey"), "literals", "const_lines", "marks")).violations.select("path", "message")


@query("""
WITH e AS (SELECT event_id, event_id % 6 AS k FROM events)
SELECT 'TestE' || event_id || ' has 0 assertion(s) — a test without assertions verifies nothing' AS message FROM e WHERE k IN (0, 4)""")
def test_assertions_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    # none; direct; renamed; in a subtest; bound to another name; bare panic
    k, e = slot("event_id", 6), F.col("event_id")
    name = F.when(k == 2, "q").otherwise("t")
    inner = F.when(k == 0, "t.Log(1)").when(k == 1, 't.Errorf("x")').when(k == 2, "q.Fatal(1)").when(k == 3, 't.Run("s", func(tt *testing.T) { tt.Fail() })').when(k == 4, "u.Error(1)").otherwise('panic("x")')
    body = text("func TestE", e, "(", name, " *testing.T) {\n\t", inner, "\n}\nfunc Testing", e, "(t *testing.T) {}\n")
    path = text("t/f", F.floor(e / PER_FILE).cast("long"), "_test.go")
    return gates.test_assertions(parse_files(files(read(spark, sf_dir, "events").select("event_id"), path, body, "event_id"), *(f"funcs.{x}" for x in ("ordinal", "name", "start_line", "has_body", "binds", "calls")))).violations.select("message")


# ---------------------------------------------------------------- from Go text and a profile to the report

#: The functions of a file: a part each, with as many branches as its size tells.
FUNCS_SQL = """
WITH sized AS (SELECT p_partkey, CAST(floor(p_partkey / 50) AS BIGINT) AS f, p_size % 4 AS branches FROM part),
funcs AS (
  SELECT 'p' || f || '/f' || f || '.go' AS path, CAST(row_number() OVER (PARTITION BY f ORDER BY p_partkey) - 1 AS INT) AS ordinal, 'F' || p_partkey AS display_name, branches,
         CAST(2 + coalesce(sum(3 + 3 * branches) OVER (PARTITION BY f ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS start_line, CAST(1 + branches AS INT) AS cc
  FROM sized),
blocks AS (
  SELECT CAST(floor(l_partkey / 50) AS BIGINT) AS f, l_linenumber * 40 + l_orderkey % 60 AS b_start, l_linenumber * 40 + l_orderkey % 60 + CAST(floor(l_quantity) AS INT) % 4 AS b_end,
         1 + CAST(floor(l_quantity) AS INT) % 5 AS num_stmt, CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE 1 END AS cnt FROM lineitem WHERE l_linenumber < 6),
sums AS (
  SELECT path, ordinal, sum(num_stmt * cnt) AS covered, sum(num_stmt) AS total
  FROM funcs JOIN blocks ON path = 'p' || f || '/f' || f || '.go' AND b_start <= start_line + 2 + 3 * branches AND b_end >= start_line GROUP BY 1, 2),
covered AS (
  SELECT m.path, m.ordinal, display_name, start_line, cc, CASE WHEN total > 0 THEN CAST(covered AS DOUBLE) / CAST(total AS DOUBLE) END AS coverage
  FROM funcs m LEFT JOIN sums s ON m.path = s.path AND m.ordinal = s.ordinal),
scores AS (SELECT *, CAST(cc AS DOUBLE) * cc * (1.0::DOUBLE - coverage) * (1.0::DOUBLE - coverage) * (1.0::DOUBLE - coverage) + cc AS crap FROM covered),
ranked AS (SELECT *, CAST(row_number() OVER (ORDER BY crap DESC NULLS LAST, path, start_line, ordinal) AS INT) AS place FROM scores)
"""


def go_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = text("func F", F.col("p_partkey"), "(x int) int {\n", times("\tif x > 0 {\n\t\tx--\n\t}\n", slot("p_size", 4)), "\treturn x\n}\n")
    n = F.floor(F.col("p_partkey") / PER_FILE).cast("long")
    return functions(parse_files(files(read(spark, sf_dir, "part"), text("p", n, "/f", n, ".go"), body, "p_partkey"), *(f"funcs.{x}" for x in ("ordinal", "display_name", "start_line", "end_line")), *COUNTED))


def go_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second file stands under another root in the profile, so that it is found by its base name."""
    li = read(spark, sf_dir, "lineitem").where("l_linenumber < 6").select("l_orderkey", "l_linenumber", F.floor(F.col("l_partkey") / PER_FILE).cast("long").alias("n"), F.col("l_quantity").cast("int").alias("q"))
    start = F.col("l_linenumber") * 40 + slot("l_orderkey", 60)
    root = F.when(F.col("n") % 2 == 0, F.lit("")).otherwise(F.lit("example.com/m/"))
    line = text(root, "p", F.col("n"), "/f", F.col("n"), ".go:", start, ".1,", start + slot("q", 4), ".2 ", 1 + slot("q", 5), " ", F.when(F.col("l_orderkey") % 3 == 0, F.lit("0")).otherwise(F.lit("1")))
    # exploded, as a line's text would else be put together anew wherever a filter or column looks at it
    return metrics.cover_blocks(li.select(F.explode(F.array(line)).alias("line")))


@query(FUNCS_SQL + "SELECT path, ordinal, display_name, start_line, cc, coverage, crap FROM scores")
def analyze_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.analyze(go_functions(spark, sf_dir), go_profile(spark, sf_dir))


def worst_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of the report in their order, with their places: the window numbers those rows only."""
    top = metrics.sorted_metrics(analyze_end_to_end(spark, sf_dir)).limit(50)
    order = Window.orderBy(F.col("crap").desc_nulls_last(), "path", "start_line", "ordinal")
    return top.withColumn("place", F.row_number().over(order).cast("int"))


@query(FUNCS_SQL + "SELECT place, path, display_name, start_line, crap FROM ranked WHERE place <= 50")
def analyze_report_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worst_functions(spark, sf_dir).select("place", "path", "display_name", "start_line", "crap")


@query(FUNCS_SQL + """
SELECT place, printf('%-30s %-35s %4d %7s %8s', display_name, path, cc, CASE WHEN coverage IS NULL THEN '  N/A ' ELSE printf('%5.1f%%', coverage * 100) END,
  CASE WHEN crap IS NULL THEN '     N/A' ELSE printf('%8.1f', crap) END) AS line FROM ranked WHERE place <= 50""")
def analyze_report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = worst_functions(spark, sf_dir).orderBy("place").collect()  # a report of 50 rows
    return spark.createDataFrame([(r.place, render.metric_row(r)) for r in rows], "place int, line string")


@query(FUNCS_SQL + "SELECT place, path, display_name FROM (SELECT path, display_name, crap, CAST(row_number() OVER (ORDER BY crap DESC NULLS LAST, path, start_line, ordinal) AS INT) AS place FROM scores WHERE coverage IS NULL) WHERE place <= 20")
def analyze_without_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = metrics.sorted_metrics(analyze_end_to_end(spark, sf_dir).where("coverage IS NULL")).limit(20)
    return none.withColumn("place", F.row_number().over(Window.orderBy("path", "start_line", "ordinal")).cast("int")).select("place", "path", "display_name")


@query("SELECT 'b' || page_id || '.go' AS path, page_id % 5 <> 0 AS parse_ok, CAST(CASE WHEN page_id % 5 = 0 THEN 0 ELSE page_id % 4 END AS INT) AS functions FROM pages")
def files_that_do_not_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.when(F.col("page_id") % 5 == 0, F.lit("func (\n")).otherwise(times("func f() {}\n", slot("page_id", 4)))
    bad = read(spark, sf_dir, "pages").select(text("b", F.col("page_id"), ".go").alias("path"), text("package p\n", body).alias("content"))
    return parse_files(bad).select("path", "parse_ok", F.size("funcs").alias("functions"))


@query("""
WITH c AS (SELECT c_custkey, CAST(floor(c_custkey / 50) AS BIGINT) AS f FROM customer),
n AS (SELECT count(*) AS k, count(DISTINCT f) AS files, count(DISTINCT CASE WHEN f % 4 <> 0 THEN f END) AS plain FROM c)
SELECT unnest(['nesting', 'class-size', 'weight-of-class', 'unused-code', 'unused-files', 'magic-constants', 'test-assertions', 'file-naming']) AS gate,
       unnest([2 * k, k, k, k, plain, files, 0, files]) AS checked FROM n""")
def gate_checked_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    c = read(spark, sf_dir, "customer").select("c_custkey", F.floor(k / PER_FILE).cast("long").alias("f"))
    body = text("type C", k, " struct {\n\tA int\n}\nfunc (c C", k, ") M() {}\nfunc f", k, "() {}\n")
    written = files(c, text("c", F.col("f"), "/c.go"), body, "c_custkey", "")
    named = written.select("path", F.concat(F.when(F.regexp_extract("path", "[0-9]+", 0).cast("long") % 4 == 0, F.lit("package main\n")).otherwise(F.lit("package q\n")), F.col("content")).alias("content"))
    facts = materialise(parse_files(named), "facts")
    each = [gates.nesting(facts), gates.class_size(facts), gates.weight_of_class(facts), gates.unused_code(facts), gates.unused_files(facts, "m"), gates.magic_constants(facts), gates.test_assertions(facts), gates.file_naming(facts)]
    return reduce(DataFrame.union, (g.checked.select(F.lit(g.name).alias("gate"), "checked") for g in each))


@query("""
SELECT 'd' || s_suppkey || '/a.go' AS path, 'S' || s_suppkey AS name, CAST(1 + s_suppkey % 3 AS BIGINT) AS fields, CAST(s_suppkey % 2 AS BIGINT) AS methods FROM supplier""")
def first_struct_of_a_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the same name again, with more fields, in a later file and later in the first one
    k = F.col("s_suppkey")
    struct = lambda n: text("type S", k, " struct {\n", times("\tA int\n", n), "}\n")
    first = text("package p\n", struct(1 + slot("s_suppkey", 3)), struct(F.lit(7)))
    method = F.when(k % 2 == 1, text("func (s *S", k, ") M() {}\n")).otherwise(F.lit(""))
    both = F.array(F.struct(text("d", k, "/b.go").alias("path"), text("package p\n", struct(F.lit(9)), method).alias("content")), F.struct(text("d", k, "/a.go").alias("path"), first.alias("content")))
    return gates.struct_weights(parse_files(read(spark, sf_dir, "supplier").select(F.explode(both).alias("x")).select("x.*"))).select("path", "name", "fields", "methods")


# ---------------------------------------------------------------- names, folders, logs

STEMS = ["util", "parser", "Batch1", "base64", "day_1", "HELPERS", "123", "configv3", "sha256", "report"]


@query("""
WITH f AS (SELECT doc_id, [ 'util', 'parser', 'Batch1', 'base64', 'day_1', 'HELPERS', '123', 'configv3', 'sha256', 'report' ][doc_id % 10 + 1] AS stem, coalesce(source, 'none') AS source FROM documents),
all_files AS (SELECT 'd' || doc_id || '/' || stem || '.go' AS path, stem FROM f UNION ALL SELECT 'x' || doc_id || '/' || source || '.go', source FROM f)
SELECT path, CASE WHEN lower(stem) IN ('util', 'helpers') THEN 'generic name "' || stem || '.go" — split by domain instead of accumulating unrelated declarations'
  ELSE 'numeric suffix in "' || stem || '.go" — split by domain instead of numbered parts (batch1, part2, v2 ...)' END AS message
FROM all_files WHERE lower(stem) IN ('util', 'helpers') OR (regexp_matches(lower(stem), '[a-z_][0-9]+$') AND lower(stem) NOT IN ('base64', 'sha256'))""")
def file_naming_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "source")
    own = F.element_at(F.array(*map(F.lit, STEMS)), slot("doc_id", 10) + 1)
    both = F.array(text("d", F.col("doc_id"), "/", own, ".go"), text("x", F.col("doc_id"), "/", F.coalesce("source", F.lit("none")), ".go"))
    return gates.file_naming(d.select(F.explode(both).alias("path"))).violations.select("path", "message")


@query("""
WITH dirs AS (SELECT page_id AS i, 'd' || page_id AS dir FROM pages),
files AS (SELECT 'd' || (c_custkey % 997) AS dir, c_custkey % 3 AS k FROM customer),
n AS (SELECT dir, count(*) AS loose FROM files WHERE k = 0 GROUP BY 1)
SELECT d.dir AS path, n.loose || ' loose .go files directly in ' || d.dir || ' — group them into feature packages (max 0)' AS message FROM dirs d JOIN n ON d.dir = n.dir""")
def folder_structure_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirs = read(spark, sf_dir, "pages").select(text("d", F.col("page_id")).alias("dir"), F.col("page_id").alias("ord"))
    k = slot("c_custkey", 3)
    name = F.when(k == 0, "/a").when(k == 1, "/sub/a").otherwise("/t")
    path = text("d", slot("c_custkey", 997), name, F.col("c_custkey"), F.when(k == 2, "_test.go").otherwise(".go"))
    return gates.folder_structure(dirs, read(spark, sf_dir, "customer").select(path.alias("path"))).violations.select("path", "message")


@query("""
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'pkg/f' || o_orderkey || '.go' WHEN 1 THEN 'new/f' || o_orderkey || '.go' WHEN 2 THEN 'gone.go' WHEN 3 THEN 'dir/' ELSE NULL END AS path FROM orders""")
def porcelain_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, o = slot("o_orderkey", 5), F.col("o_orderkey")
    line = F.when(k == 0, text(" M pkg/f", o, ".go")).when(k == 1, text("R  old/f", o, ".go -> new/f", o, ".go")).when(k == 2, F.lit(" D gone.go")).when(k == 3, F.lit("?? dir/")).otherwise(F.lit("M"))
    return read(spark, sf_dir, "orders").select("o_orderkey", porcelain_path(line).alias("path"))


def event_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log line for each event; some lines are malformed."""
    e, micros = read(spark, sf_dir, "events"), F.floor(F.col("value") * 100).cast("long")
    good = text("u", slot("user_id", 50), ".go|", F.col("event_type"), "\t", micros)
    bad = F.when(F.col("event_id") % 10 == 0, text(F.col("event_type"), " ", micros)).when(F.col("event_id") % 10 == 1, text("\t", micros)).when(F.col("event_id") % 10 == 2, text("k\t ", micros)).otherwise(good)
    return e.select(bad.alias("line"))


TIMES_SQL = """
WITH e AS (SELECT 'u' || (user_id % 50) || '.go|' || event_type AS key, CAST(floor(value * 100) AS BIGINT) AS micros FROM events WHERE event_id % 10 > 2),
stats AS (SELECT key, count(*) AS calls, CAST(sum(micros) AS BIGINT) AS total_us, min(micros) AS min_us, greatest(max(micros), 0) AS max_us FROM e GROUP BY 1),
funcs AS (SELECT DISTINCT 'u' || (user_id % 50) || '.go' AS path, event_type AS display_name FROM events WHERE user_id % 50 < 40),
prof AS (SELECT f.path, f.display_name, s.* EXCLUDE (key) FROM funcs f JOIN stats s ON s.key = f.path || '|' || f.display_name),
ranked AS (
  SELECT *, CASE WHEN calls = 0 THEN 0.0::DOUBLE ELSE CAST(total_us AS DOUBLE) / CAST(calls AS DOUBLE) END AS mean_us,
         CASE WHEN sum(total_us) OVER () <= 0 THEN 0.0::DOUBLE ELSE CAST(total_us AS DOUBLE) / CAST(sum(total_us) OVER () AS DOUBLE) * 100 END AS share,
         row_number() OVER (ORDER BY total_us DESC, path, display_name) AS r FROM prof)
"""


@query(TIMES_SQL + "SELECT key, calls, total_us, min_us, max_us FROM stats")
def timing_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.timing_stats(profiling.timing_entries(event_logs(spark, sf_dir)))


def event_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = read(spark, sf_dir, "events").where("user_id % 50 < 40").select(text("u", slot("user_id", 50), ".go").alias("path"), F.col("event_type").alias("display_name")).distinct()
    f = f.withColumn("ordinal", F.row_number().over(Window.partitionBy("path").orderBy("display_name"))).withColumns({"start_line": F.lit(1), "has_body": F.lit(True)})
    return profiling.attributed(f, profiling.timing_stats(profiling.timing_entries(event_logs(spark, sf_dir))))


@query(TIMES_SQL + "SELECT path, display_name, calls, total_us, min_us, max_us, mean_us, share FROM ranked WHERE r <= 20")
def timing_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.ranked(event_profiles(spark, sf_dir), profiling.TOP).drop("ordinal", "start_line")


@query(TIMES_SQL + "SELECT count(*) AS exceeding, min_by(display_name, r) AS first_offender, max(total_us) AS first_us FROM ranked WHERE total_us / 1000.0::DOUBLE > 20.0")
def timing_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.over_threshold(event_profiles(spark, sf_dir), 20.0)


# ---------------------------------------------------------------- analogues


@query("SELECT l_suppkey, count(*) AS late, CAST(sum(CAST(floor(l_quantity) AS BIGINT)) AS BIGINT) AS units FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1 HAVING count(*) > 25")
def late_shipments_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    return li.groupBy("l_suppkey").agg(F.count("*").alias("late"), F.sum(F.floor("l_quantity")).alias("units")).where(F.col("late") > gates.MAX_METHODS)


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 8 = 0)")
def customers_without_eighth_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").where("o_orderkey % 8 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, sf_dir, "customer").select("c_custkey", "c_name").join(o, "c_custkey", "left_anti")


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)
SELECT doc_id, line, count(*) AS n FROM l WHERE octet_length(encode(line)) >= 4 GROUP BY 1, 2 HAVING count(*) >= 3""")
def repeated_document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.where(F.octet_length("line") >= gates.MIN_BYTES).groupBy("doc_id", "line").agg(F.count("*").alias("n")).where(F.col("n") >= gates.MIN_REPEATS)


@query("""
WITH c AS (SELECT o_custkey, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS revenue FROM orders GROUP BY 1),
r AS (SELECT *, CAST(revenue AS DOUBLE) / CAST(sum(revenue) OVER () AS DOUBLE) * 100 AS share, row_number() OVER (ORDER BY revenue DESC, o_custkey) AS k FROM c)
SELECT o_custkey, revenue, share FROM r WHERE k <= 20""")
def revenue_share_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum(F.floor("o_totalprice")).alias("revenue"))
    # the total is one row, so no window gathers all customers
    total = c.agg(F.sum("revenue").alias("_all"))
    shared = c.join(F.broadcast(total)).select("o_custkey", "revenue", (F.col("revenue").cast("double") / F.col("_all").cast("double") * 100).alias("share"))
    return shared.orderBy(F.desc("revenue"), "o_custkey").limit(profiling.TOP)
