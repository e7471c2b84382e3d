import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from cragline.plans import catalogue

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SMALL}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SMALL).toPandas()
    want = duck.sql(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(map(repr, df[sorted(df.columns)].itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_the_rest_imports_without_the_subpackage(tmp_path):
    top = Path(__file__).resolve().parent.parent
    shutil.copytree(top, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'crap_scores' in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env={**os.environ, "PYTHONPATH": str(tmp_path / "r")})
