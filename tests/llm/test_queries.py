"""All queries of the subpackage on the smallest tables and on empty ones, and its place in the library."""

import glob
import os
import re
from pathlib import Path

import pytest

from findwell.llm import registry

TABLES = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
COLUMNS = {
    "p1_found": ["id", "chunk_index", "first_word", "last_word"], "p2_found": ["id_a", "id_b"], "p3_found": ["search_id", "document_id"], "p4_found": ["id", "term"], "p5_found": ["id", "element", "element_text"],
    "p7_found": ["chunk_id_a", "chunk_id_b"], "p8_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id_a", "doc_id_b"],
}


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    for path in glob.glob(f"{TABLES}/*.parquet"):
        spark.read.parquet(path).limit(0).write.parquet(f"{d}/{os.path.basename(path)}")
    return d


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, empty, name):
    df = registry.queries()[name](spark, TABLES)
    rows = df.collect()
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
        assert len({str(r) for r in rows}) == len(rows)
        if name != "p8_ids" and len(COLUMNS[name]) == 2 and COLUMNS[name][0].endswith("_a"):
            assert all(r[0] < r[1] for r in rows)
    assert registry.queries()[name](spark, empty).count() == 0


def test_nothing_else_imports_the_subpackage():
    for path in [*(ROOT / "findwell").rglob("*.py"), *(ROOT / "tests").glob("*.py"), ROOT / "bench.py"]:
        if "llm" not in path.parts and path.exists():
            assert not re.search(r"^\s*(from|import) findwell\.llm", path.read_text(), re.M), path


def test_workers_need_no_path_to_the_package(tmp_path):
    """As on a cluster whose executors don't have the package: the driver alone can import it."""
    import subprocess
    import sys

    script = f"""
import sys; sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__ as e
for name in ("p7_found", "p8_ids", "p9_found", "p2_found", "p5_found"):
    print(name, e.queries()[name](spark, {TABLES!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and "p5_found" in done.stdout, done.stderr[-2000:]
