import subprocess
import sys

import duckdb
import pytest

SF = "/root/testdata/sf0.001"


def cell(v):
    if v is None or (isinstance(v, float) and v != v):
        return None
    return round(float(v), 6) if isinstance(v, float) else int(v) if isinstance(v, bool) else v


def rows(frame):
    return sorted(([cell(v) for v in r] for r in frame), key=repr)


from larkspur import queries as Q  # noqa: E402

NAMES = list(Q.oracle_sql())


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents labels".split():
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, db, name):
    df = Q.queries()[name](spark, SF)
    want = db.sql(Q.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    got = rows(df.select(*sorted(df.columns)).collect())
    assert got == rows(want.select(*[f'"{c}"' for c in sorted(want.columns)]).fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_the_removable_parts(tmp_path):
    """The entry module imports and lists the dialect's queries where the two folders are absent, with and without the pipeline's module."""
    import os
    import shutil

    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(here, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for folder in ("larkspur/llm", "tests/llm"):
        shutil.rmtree(tmp_path / "r" / folder, ignore_errors=True)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"
    env = {**os.environ, "PYTHONPATH": ""}
    for more in ("", "corpus_pipeline.py"):
        (tmp_path / "r" / (more or "none")).unlink(missing_ok=True)
        out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", capture_output=True, text=True, env=env)
        assert out.stdout.split() == [str(len(Q.queries())), str(len(Q.oracle_sql())), "False"], out.stderr
