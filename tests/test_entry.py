"""What the entry module registers runs and, where there is SQL, equals it."""

import math
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = Path("/root/testdata/sf0.001")
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    return f"{v:.5f}" if isinstance(v, float) else str(v)


@pytest.mark.skipif(not SF.exists(), reason="the test tables are not here")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.execute(ORACLE[name])
    columns = [d[0] for d in want.description]
    df = QUERIES[name](spark, str(SF))
    assert sorted(df.columns) == sorted(columns)
    got = sorted(tuple(plain(v) for v in r) for r in df.select(*sorted(columns)).collect())
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    assert got == sorted(tuple(plain(r[i]) for i in order) for r in want.fetchall())


@pytest.mark.skipif(not SF.exists(), reason="the test tables are not here")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - {n for n in QUERIES if n.startswith("op") or n == "pipeline"}))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, str(SF)).count() > 0


def test_library_stands_without_the_optional_part():
    code = "import sys; sys.modules['colloquy.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'agg_speaker_stats' in q and not any(n.startswith('op') for n in q) and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(entry.__file__).parent)


def test_library_stands_where_the_optional_part_is_deleted(tmp_path):
    root = Path(entry.__file__).parent
    shutil.copytree(root, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    code = "import importlib, pkgutil, colloquy; [importlib.import_module(m.name) for m in pkgutil.walk_packages(colloquy.__path__, 'colloquy.')]; import __spark_entry__ as e, bench; assert 'agg_speaker_stats' in e.queries() and not any(n.startswith('op') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path / "repo")
    subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], check=True, cwd=tmp_path / "repo", stdout=subprocess.DEVNULL)


@pytest.mark.skipif(entry.llm_queries is None, reason="the optional part is not here")
def test_other_import_errors_are_not_swallowed():
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__"
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(entry.__file__).parent, capture_output=True, text=True)
    assert done.returncode and "xxhash" in done.stderr
