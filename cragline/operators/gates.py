"""Threshold gates over fact tables. Each gives its violations and the number of things it checked."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.globs import matches
from ..functions.paths import import_dir, stem
from ..plans.facts import family, functions
from ..scratch import materialise

MAX_NESTING, MAX_METHODS, MAX_WMC, MAX_WEIGHT, MIN_REPEATS, MIN_BYTES, MIN_ASSERTIONS, MAX_LOOSE = 5, 25, 80, 0.33, 3, 4, 1, 0

#: Stems that say nothing, and stems that may end in digits.
GENERIC = "common core general helper helpers misc shared stuff temp tmp types util utils utilities utility various".split()
NUMERIC = """aes128 aes192 aes256 arm32 arm64 base32 base64 crc8 crc16 crc32 f16 f32 f64 h264 h265 http2 http3 i18n i2c
int8 int16 int32 int64 ipv4 ipv6 l10n a11y md5 oauth1 oauth2 sha1 sha256 sha384 sha512 uint8 uint16 uint32
uint64 utf8 utf16 utf32 w3c webgl2 x509 x86 x64""".split()
#: Methods that can fail a test.
FAILING = ["Error", "Errorf", "Fatal", "Fatalf", "Fail", "FailNow"]


@dataclass
class Gate:
    """violations: path, line (null for gates without lines), ord, by, message, reported by path, ord, by, line. checked: one row, column checked."""

    name: str
    violations: DataFrame
    checked: DataFrame


def _gate(name: str, rows: DataFrame, path: str | Column, line: Column | None, message: Column, checked: DataFrame, ord_: Column | None = None, by: Column | None = None) -> Gate:
    at = F.lit(None).cast("int") if line is None else line.cast("int")
    order = F.lit(0) if ord_ is None else ord_
    out = rows.select(F.lit(name).alias("gate"), (F.col(path) if isinstance(path, str) else path).alias("path"), at.alias("line"), order.cast("long").alias("ord"), (F.lit("") if by is None else by).alias("by"), message.alias("message"))
    return Gate(name, out, checked)


def _count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("checked"))


def _text(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def file_naming(files: DataFrame) -> Gate:
    """Files (path) by name alone; nothing is parsed."""
    name = stem(F.col("path"))
    low = F.lower(name)
    generic = low.isin(GENERIC)
    numbered = low.rlike(r"[a-z_][0-9]+\z") & ~low.isin(NUMERIC)
    shown = F.concat(F.lit('"'), name, F.lit('.go"'))
    message = F.when(generic, _text("generic name ", shown, " — split by domain instead of accumulating unrelated declarations")).otherwise(_text("numeric suffix in ", shown, " — split by domain instead of numbered parts (batch1, part2, v2 ...)"))
    return _gate("file-naming", files.where(generic | numbered), "path", None, message, _count(files))


def nesting(facts: DataFrame, most: int = MAX_NESTING) -> Gate:
    f = functions(facts).where("has_body")
    return _gate("nesting", f.where(F.col("nesting") > most), "path", F.col("start_line"), _text(F.col("display_name"), " nesting=", F.col("nesting"), f" > max {most}"), _count(f), F.col("ordinal"))


def class_size(facts: DataFrame, methods: int = MAX_METHODS, wmc: int = MAX_WMC) -> Gate:
    """Types by directory and receiver name, in the order of their first methods; only methods with a body count. The two limits come from one aggregation."""
    place = F.struct("path", "ordinal", "start_line")
    f = functions(facts).where("has_recv AND has_body")
    types = f.groupBy("pkg_dir", "recv").agg(F.count("*").alias("n"), F.sum("cc").cast("long").alias("wmc"), F.min(place).alias("first"))
    limits = F.array(F.struct(F.lit(0).alias("o"), (F.col("n") > methods).alias("over"), _text(F.col("recv"), " has ", F.col("n"), f" methods > max {methods}").alias("m")), F.struct(F.lit(1).alias("o"), (F.col("wmc") > wmc).alias("over"), _text(F.col("recv"), " WMC=", F.col("wmc"), f" > max {wmc}").alias("m")))
    rows = types.select("first", F.explode(limits).alias("x")).where("x.over")
    return _gate("class-size", rows, F.col("first.path"), F.col("first.start_line"), F.col("x.m"), _count(types), F.col("first.ordinal") * 2 + F.col("x.o"))


def struct_weights(facts: DataFrame) -> DataFrame:
    """Exported structs, of one name in a directory the first, with their exported fields and methods.

    Structs and methods are taken from a file's row together and meet in one aggregation, so files are parsed once.
    """
    place = lambda s, i: F.struct("path", i.alias("at"), s["line"].alias("line"), F.size(F.filter(s["fields"], lambda f: f["exported"])).alias("fields"))
    structs = F.filter(F.transform("structs", lambda s, i: F.struct(s["name"].alias("name"), F.when(s["exported"], place(s, i)).alias("struct"), F.lit(0).alias("method"))), lambda x: x["struct"].isNotNull())
    nothing = F.lit(None).cast("struct<path: string, at: int, line: int, fields: int>")
    methods = F.transform(F.filter("funcs", lambda f: f["has_recv"] & f["exported"]), lambda f: F.struct(f["recv"].alias("name"), nothing.alias("struct"), F.lit(1).alias("method")))
    members = facts.where("parse_ok").select("pkg_dir", F.explode(F.concat(structs, methods)).alias("x"))
    types = members.groupBy("pkg_dir", F.col("x.name").alias("name")).agg(F.min("x.struct").alias("first"), F.sum("x.method").alias("methods"))
    return types.where("first IS NOT NULL").select("pkg_dir", "name", "first.path", "first.at", "first.line", F.col("first.fields").cast("long").alias("fields"), "methods")


def weight_of_class(facts: DataFrame, most: float = MAX_WEIGHT) -> Gate:
    s = struct_weights(facts)
    weighed = s.where("fields > 0").withColumn("weight", F.col("fields").cast("double") / (F.col("fields") + F.col("methods")).cast("double")).where(F.col("weight") > most)
    message = _text(F.col("name"), " exposes ", F.col("fields"), " public fields of ", F.col("fields") + F.col("methods"), " public members (weight=", F.format_number(F.bround("weight", 2), 2), ")")
    return _gate("weight-of-class", weighed, "path", F.col("line"), message, _count(s), F.col("at"))


def declaration_uses(facts: DataFrame) -> DataFrame:
    """Unexported package-level names: how many declare them, the first that does, and how often the name stands in the package.

    Declarations and a file's counts of names are taken from its row together and meet in one aggregation.
    """
    decls = F.filter(F.transform("decls", lambda d, i: F.struct(d["name"].alias("name"), F.when(~d["exported"] & (d["name"] != "_"), F.struct("path", i.alias("at"), d["line"].alias("line"))).alias("decl"), F.lit(0).cast("long").alias("n"))), lambda x: x["decl"].isNotNull())
    nothing = F.lit(None).cast("struct<path: string, at: int, line: int>")
    uses = F.transform("names", lambda x: F.struct(x["name"].alias("name"), nothing.alias("decl"), x["n"].alias("n")))
    rows = facts.where("parse_ok").select("pkg_dir", F.explode(F.concat(decls, uses)).alias("x"))
    names = rows.groupBy("pkg_dir", F.col("x.name").alias("name")).agg(F.min("x.decl").alias("decl"), F.count("x.decl").alias("declared"), F.sum("x.n").alias("uses"))
    return names.where("decl IS NOT NULL").select("pkg_dir", "name", "decl.path", "decl.at", "decl.line", "declared", "uses")


def unused_code(facts: DataFrame) -> Gate:
    """Names that stand nowhere but in their declaration; that is one place, so such a name has one declaration."""
    d = declaration_uses(facts)
    checked = d.agg(F.coalesce(F.sum("declared"), F.lit(0)).alias("checked"))
    return _gate("unused-code", d.where("uses <= 1"), "path", F.col("line"), _text(F.col("name"), " is never referenced"), checked, F.col("at"))


def unused_files(facts: DataFrame, module: str) -> Gate:
    """Packages other than main that no file imports. A directory's package is that of its last file.

    Packages and imports meet in one aggregation by directory.
    """
    own = F.array(F.struct(F.col("pkg_dir").alias("dir"), F.struct("path", "package").alias("file"), F.lit(False).alias("imported")))
    nothing = F.lit(None).cast("struct<path: string, package: string>")
    others = F.transform("imports", lambda i: F.struct(import_dir(i["import_path"], module).alias("dir"), nothing.alias("file"), F.lit(True).alias("imported")))
    rows = facts.where("parse_ok").select(F.explode(F.concat(own, others)).alias("x")).where("x.dir <> ''")
    dirs = rows.groupBy(F.col("x.dir").alias("pkg_dir")).agg(F.max("x.file").alias("last"), F.max("x.imported").alias("imported"))
    packages = dirs.where("last IS NOT NULL AND last.package <> 'main'").select("pkg_dir", "last.package", "imported")
    return _gate("unused-files", packages.where("NOT imported"), "pkg_dir", None, _text("package ", F.col("package"), " is never imported by any analyzed package"), _count(packages))


@dataclass(frozen=True)
class Rule:
    source: str
    forbid: str
    message: str = ""


def rules_from(sources: Sequence[str], forbids: Sequence[str], messages: Sequence[str]) -> list[Rule]:
    """Rules by position; the last ones may lack a message."""
    if len(sources) != len(forbids) or len(messages) > len(sources):
        raise ValueError("--from and --forbid come in pairs, with at most one --message each")
    return [Rule(a, b, m) for a, b, m in zip(sources, forbids, [*messages, *[""] * (len(sources) - len(messages))], strict=True)]


def banned_imports(facts: DataFrame, rules: Sequence[Rule], module: str) -> Gate:
    """A row for each import and rule that forbids it in its file. Rules become fixed predicates of one scan: no join."""
    applies = [matches(F.col("path"), r.source) for r in rules]
    here = facts.where(F.lit(False) if not rules else F.greatest(*applies, F.lit(False)))
    rows = family(here, "imports").withColumn("dir", import_dir(F.col("import_path"), module))
    tests = [F.struct(F.lit(i).alias("rule"), F.lit(r.message).alias("why"), (matches(F.col("path"), r.source) & (matches(F.col("import_path"), r.forbid) | ((F.col("dir") != "") & matches(F.col("dir"), r.forbid)))).alias("hit")) for i, r in enumerate(rules)]
    found = rows.withColumn("t", F.explode(F.array(*tests) if tests else F.expr("CAST(array() AS array<struct<rule: int, why: string, hit: boolean>>)"))).where("t.hit")
    message = F.concat(_text('import "', F.col("import_path"), '" is banned for ', F.col("path")), F.when(F.col("t.why") == "", F.lit("")).otherwise(_text(" — ", F.col("t.why"))))
    return _gate("banned-imports", found, "path", F.col("line"), message, _count(here), F.col("at") * max(1, len(rules)) + F.col("t.rule"))


def magic_literals(facts: DataFrame) -> DataFrame:
    """Literals outside constant lines, with ``hex`` and how often their value counts in the file (0: it doesn't).

    Everything a literal is tested against lies in its file's row, so these tests need no join; the number of
    repeats is counted over file and value, so that a file with very many literals is spread by value.
    """
    lits = facts.where("parse_ok").select("path", "pkg_dir", "const_lines", F.map_from_entries("marks").alias("mark"), F.explode("literals").alias("l"))
    lits = lits.where(~F.array_contains("const_lines", F.col("l.line"))).select("path", "l.*", F.coalesce(F.element_at("mark", F.col("l.line")) < F.col("l.preorder"), F.lit(False)).alias("marked"))
    lits = lits.withColumn("hex", (F.col("kind") == "INT") & F.col("lexeme").rlike(r"\A0[xX][0-9a-fA-F]{6,8}\z"))
    counts = (F.col("n_bytes") >= MIN_BYTES) & ~((F.col("kind") == "STRING") & F.col("marked"))
    repeats = F.sum(counts.cast("long")).over(Window.partitionBy("path", "value"))
    return lits.withColumn("counts", counts).withColumn("repeats", repeats)


def magic_constants(facts: DataFrame, least: int = MIN_REPEATS) -> Gate:
    """Colours of a file by place, then repeated literals by value and place."""
    lits = magic_literals(facts)
    kinds = F.array(
        F.struct(F.col("hex").alias("hit"), F.lit("hex color outside a constant declaration").alias("m"), F.lit(0).alias("section")),
        F.struct((F.col("counts") & (F.col("repeats") >= least)).alias("hit"), _text("literal ", F.col("value"), " repeats ", F.col("repeats"), " times — extract a named constant").alias("m"), F.lit(1).alias("section")),
    )
    rows = lits.withColumn("v", F.explode(kinds)).where("v.hit")
    return _gate("magic-constants", rows, "path", F.col("line"), F.col("v.m"), _count(facts), F.col("v.section"), F.when(F.col("v.section") == 1, F.col("value")).otherwise(F.lit("")))


def test_functions(facts: DataFrame) -> DataFrame:
    """Test functions with the number of their calls that can fail; names bound before a call count, all within the row."""
    tests = functions(facts).where(F.col("has_body") & F.col("name").rlike(r"\ATest(?!\p{Ll})") & (F.col("name") != "TestMain"))
    bound = lambda c: F.exists("binds", lambda b: (b["name"] == c["on"]) & (b["preorder"] < c["preorder"]))
    fails = F.filter("calls", lambda c: F.when(c["on"].isNull(), c["callee"] == "panic").otherwise(c["callee"].isin(FAILING) & bound(c)))
    return tests.withColumn("assertions", F.size(fails))


def test_assertions(facts: DataFrame, least: int = MIN_ASSERTIONS) -> Gate:
    t = test_functions(facts)
    message = _text(F.col("name"), " has ", F.col("assertions"), " assertion(s) — a test without assertions verifies nothing")
    return _gate("test-assertions", t.where(F.col("assertions") < least), "path", F.col("start_line"), message, _count(t), F.col("ordinal"))


def folder_structure(dirs: DataFrame, files: DataFrame, most: int = MAX_LOOSE) -> Gate:
    """dirs (dir, ord) against the Go files, tests excepted, directly in them; directories without files count 0."""
    loose = files.where(F.col("path").endswith(".go") & ~F.col("path").endswith("_test.go"))
    name = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", r"/[^/]*\z", "")).otherwise(F.lit("."))
    counts = loose.groupBy(name.alias("dir")).agg(F.count("*").alias("loose"))
    joined = dirs.join(counts, "dir", "left").withColumn("loose", F.coalesce("loose", F.lit(0)))
    message = _text(F.col("loose"), " loose .go files directly in ", F.col("dir"), f" — group them into feature packages (max {most})")
    return _gate("folder-structure", joined.where(F.col("loose") > most), "dir", None, message, _count(dirs), F.col("ord"))


def all_gates(facts: DataFrame, module: str) -> DataFrame:
    """Violations of all gates that need no more than facts. These are written once, so every file is parsed once; each gate then reads its own columns."""
    once = materialise(facts, "facts")
    gates = [nesting(once), class_size(once), weight_of_class(once), unused_code(once), unused_files(once, module), magic_constants(once), test_assertions(once), file_naming(once)]
    return reduce(DataFrame.unionByName, (g.violations for g in gates))
