import json
import time

import pytest
from pyspark.sql import Row

from cragline import render
from cragline.cli import main, go_test_arguments
from cragline.sources import logs, tree
from cragline.streaming.timings import stream_timings


def write(root, **files):
    for name, text in files.items():
        p = root / name.replace("__", "/").replace("DOT", ".")
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)


def run(spark, root, *argv):
    out = []
    return main(argv, str(root), spark, out.append), "\n".join(out)


@pytest.fixture
def repo(tmp_path):
    write(tmp_path, goDOTmod="module e.com/m\n", aDOTgo="package p\n\nfunc Simple() {\n\tx()\n}\n", _genDOTgo="package p\nfunc lonely() {}\n", vendor__vDOTgo="package {", a_testDOTgo="package p\nfunc TestX(t *testing.T) {}\n")
    return tmp_path


def test_selection(repo):
    assert [p.rsplit("/", 1)[1] for p in tree.walk_go(str(repo))] == ["_gen.go", "a.go"]
    assert [p.rsplit("/", 1)[1] for p in tree.expand_paths([".", "a.go", "a_test.go"], str(repo))] == ["_gen.go", "a.go", "a_test.go"]
    assert tree.walk_go(str(repo / "vendor")) == [] and tree.module_path(str(repo)) == "e.com/m"
    assert tree.changed_paths([" M a.go", "R  o.go -> n.go", "?? x_test.go", "?? d/", "M"]) == ["a.go", "n.go"]
    with pytest.raises(OSError):
        tree.expand_paths(["missing"], str(repo))


def test_analyze_codes(spark, repo):
    code, text = run(spark, repo)
    assert code == 0 and "N/A" in text and "Max CRAP: 0.0 (threshold 8.0) — passed" in text
    (repo / "coverage.out").write_text("mode: set\ne.com/m/a.go:3.15,5.2 1 0\n")
    code, text = run(spark, repo, "--threshold", "1", "a.go")
    assert code == 2 and "Max CRAP: 2.0 (threshold 1.0) — FAILED" in text
    assert run(spark, repo, "--threshold", "nan")[0] == 1 and run(spark, repo, "missing.go")[0] == 1
    (repo / "bad.go").write_text("package {")
    assert run(spark, repo)[0] == 1


def test_gates_codes(spark, repo):
    assert run(spark, repo, "nesting") == (0, "2 functions within nesting 5")
    code, text = run(spark, repo, "unused-code")
    assert code == 2 and "_gen.go:2: lonely is never referenced" in text and "1/1 unexported declarations unused" in text
    assert run(spark, repo, "unused-code", "a.go")[0] == 0
    assert run(spark, repo, "test-assertions")[0] == 2 and run(spark, repo, "folder-structure")[0] == 2 and run(spark, repo, "folder-structure", "nope")[0] == 1
    assert run(spark, repo, "file-naming")[0] == 0 and run(spark, repo, "banned-imports")[0] == 0 and run(spark, repo, "banned-imports", "--from", "x")[0] == 1
    assert run(spark, repo, "magic-constants")[0] == 0 and run(spark, repo, "class-size")[0] == 0 and run(spark, repo, "unused-files")[0] == 2 and run(spark, repo, "weight-of-class")[0] == 0


def test_empty_tree(spark, tmp_path):
    assert run(spark, tmp_path) == (0, "No Go files to analyze.") and run(spark, tmp_path, "nesting") == (0, "No Go files to check.")
    assert run(spark, tmp_path, "skill")[0] == 0 and "profile" in run(spark, tmp_path, "--help")[1]


def test_profile(spark, repo, capsys):
    write(repo, **{"logs__aDOTjsonl": "a.go|Simple\t3000\na.go|Simple\t1000\nzz|Q\t5\n", "logs__bDOTtxt": "a.go|Simple\t9\n"})
    code, text = run(spark, repo, "profile", "--logs", "logs", "--threshold", "2", "--name", "x")
    assert code == 2 and text.splitlines() == [
        "Profile Report (1 methods, total 4.00ms)", render.PROFILE_HEAD, render.PROFILE_RULE,
        "     4.00 100.0%      2    2000.0     3000     120.00  Simple                    a.go:3", "", "Threshold: 2.00ms — 1 method exceeds",
    ]
    said = capsys.readouterr().err
    assert "Profile threshold exceeded: Simple total 4.00ms > 2.00ms" in said and "Profile report written to" in said
    js, txt = (next((repo / "profile-reports").glob(f"*.{x}")) for x in ("json", "txt"))
    assert json.loads(js.read_text())["methods"][0]["totalMicros"] == 4000 and txt.read_text() == text + "\n"
    # 0 is off
    code, text = run(spark, repo, "profile", "--logs", "logs", "--threshold", "0")
    assert code == 0 and "Threshold" not in text
    assert run(spark, repo, "profile", "--logs", "none")[0] == 1 and run(spark, repo, "profile", "--top", "0")[0] == 1 and run(spark, repo, "profile", "--threshold", "-1")[0] == 1
    assert logs.read_timings(spark, str(repo / "nothing")).count() == 0


def test_go_arguments():
    assert go_test_arguments("/r", "", []) == ["test", "-count=1", "./..."]
    assert go_test_arguments("/r", "TestX", ["/r/a/b", "./c", "d", "/else", "/rr/x"]) == ["test", "-count=1", "-run", "TestX", "./a/b", "./c", "d", "/else", "/rr/x"]


def test_report_rows():
    head = "Method                         File                                  CC    Cov%     CRAP"
    row = lambda cov, crap: Row(display_name="A", path="a.go", cc=5, coverage=cov, crap=crap)
    got = list(render.metric_report([row(0.5, 8.125), row(None, None)], 8.125, 8.0))
    assert got == ["CRAP Report", "===========", head, "-" * len(head), f"{'A':<30} {'a.go':<35} {5:>4} {' 50.0%':>7} {'8.1':>8}", f"{'A':<30} {'a.go':<35} {5:>4} {'  N/A ':>7} {'     N/A':>8}", "", "Max CRAP: 8.1 (threshold 8.0) — FAILED"]


def test_streamed_timings_equal_the_batch(spark, repo):
    write(repo, logs__aDOTjsonl="k\t10\nk\t20\n")
    q = stream_timings(spark, str(repo / "logs")).writeStream.format("memory").queryName("t").outputMode("complete").start()
    q.processAllAvailable()
    time.sleep(0.1)
    assert [tuple(r) for r in spark.table("t").collect()] == [("k", 2, 30, 10, 20)]
    q.stop()


def test_rounding_is_exact():
    assert render.mean_label(10) == "~10.0" and render.mean_label(100000) == "100000.0" and f"{0.25:.1f}" == "0.2"
