"""The queries and their SQL: names, and that they run on the smallest tables and on empty ones."""

import glob
import os

import pytest

import __spark_entry__ as entry
from findwell import suite

TABLES = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")


def test_every_sql_belongs_to_a_query():
    assert set(suite.oracle_sql()) <= set(suite.queries())
    assert set(suite.queries()) <= set(entry.queries())


@needs_tables
def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    for path in glob.glob(f"{TABLES}/*.parquet"):
        spark.read.parquet(path).limit(0).write.parquet(f"{d}/{os.path.basename(path)}")
    return d


@needs_tables
@pytest.mark.parametrize("name", sorted(suite.queries()))
def test_query_on_empty_tables(spark, empty, name):
    suite.queries()[name](spark, empty).collect()


def test_entry_needs_no_session():
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=root, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
