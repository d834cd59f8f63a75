"""Every query of the pack against its DuckDB SQL, and the driver's entry points."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as driver
from tidelog.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "events documents pages conversations nation region customer".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows, names):
    order = sorted(names)
    cell = lambda v: repr(round(v, 9)) if isinstance(v, float) else repr(v)
    return order, sorted(tuple(cell(r[c]) for c in order) for r in rows)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toArrow()
    want = duck.sql(registry.ORACLES[name]).to_arrow_table()
    assert plain(got.to_pylist(), got.schema.names) == plain(want.to_pylist(), want.schema.names)


def test_entry_points(spark):
    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_the_rest_works_without_the_optional_part(tmp_path):
    """A copy without the two: the rest imports and has its queries. A broken operator is not hidden."""
    root = os.path.dirname(os.path.abspath(driver.__file__))
    for name in ("__spark_entry__.py", "tidelog", "corpus_pipeline.py"):
        at = os.path.join(root, name)
        if os.path.isdir(at):
            shutil.copytree(at, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif os.path.exists(at):
            shutil.copy(at, tmp_path / name)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    run = lambda: subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    if (tmp_path / "tidelog/llm/queries.py").exists():
        whole = (tmp_path / "tidelog/llm/queries.py").read_text()
        (tmp_path / "tidelog/llm/queries.py").write_text(whole + "\nimport no_such_module\n")
        assert "no_such_module" in run().stderr
        shutil.rmtree(tmp_path / "tidelog/llm")
        (tmp_path / "corpus_pipeline.py").unlink()
    assert run().stdout.split() == [str(len(registry.QUERIES)), str(len(registry.ORACLES))]


def test_settled_tables_go_when_they_are_not_needed(spark):
    from tidelog.session import drop, scratch, settle

    kept = settle(spark.range(3).toDF("x"), "kept")
    with scratch(spark):
        inner = settle(spark.range(4).toDF("x"), "inner")
        assert inner.count() == 4
    assert not os.path.exists(inner.settled_at.removeprefix("file://")) and kept.count() == 3
    drop(kept, spark.range(1))
    assert not os.path.exists(kept.settled_at.removeprefix("file://"))
