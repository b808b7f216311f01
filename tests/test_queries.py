"""Every query that has SQL against DuckDB on the smallest tables."""

import decimal
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return f"{float(v):.5g}" if v else "0"
    return str(v)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    want = duck.sql(entry.oracle_sql()[name])
    assert columns == sorted(want.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    at = [want.columns.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_core_stands_without_llm():
    import re
    import pathlib

    root = pathlib.Path(entry.__file__).parent / "kmerframe"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"kmerframe\.llm|from \.+llm", p.read_text()), p


def test_core_stands_without_llm_folders(tmp_path):
    """The library with the subpackage deleted: everything imports, and the entry gives the core's queries and their SQL."""
    import pathlib
    import shutil
    import subprocess
    import sys

    root = pathlib.Path(entry.__file__).parent
    shutil.copytree(root / "kmerframe", tmp_path / "kmerframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = """
import importlib, pkgutil, kmerframe, __spark_entry__ as e
for m in pkgutil.walk_packages(kmerframe.__path__, "kmerframe."):
    importlib.import_module(m.name)
print(len(e.queries()), sum(n.startswith("p") and n[1].isdigit() for n in e.queries()), set(e.oracle_sql()) <= set(e.queries()))
"""
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    here = [n for n in entry.queries() if not (n.startswith("p") and n[1].isdigit())]
    assert said.stdout.split() == [str(len(here)), "0", "True"]
