"""Every query with SQL against DuckDB, on the smallest tables where these exist."""

import os

import duckdb
import pytest

from quernstone import queries as catalogue
from quernstone.session import TABLES

DATA = "/root/testdata/sf0.001"
SQL = catalogue.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def cells(rows):
    def one(v):
        if isinstance(v, bool) or v is None:
            return str(v)
        if isinstance(v, (int, float)):
            return f"{float(v):.9g}"
        return v.isoformat() if hasattr(v, "isoformat") else str(v)

    return sorted([one(v) for v in r] for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equal_to_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    want = duck.sql(SQL[name])
    assert sorted(want.columns) == columns
    assert cells(df.select(columns).collect()) == cells(duck.sql(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(SQL)))
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, DATA).limit(1).count() == 1


def test_without_the_corpus_operators(tmp_path):
    """The repository as it is without the corpus operators: all else is there and imports."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "quernstone"), tmp_path / "quernstone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    names, sql = out.stdout.splitlines()
    assert names.split() == sorted(catalogue.queries()) and sql.split() == sorted(SQL)


def test_other_missing_modules_are_not_hidden(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "quernstone"), tmp_path / "quernstone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("import a_module_that_is_not_there\n")
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert out.returncode and "a_module_that_is_not_there" in out.stderr
