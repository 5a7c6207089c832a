"""The registered queries next to their SQL on the smallest tables."""

import glob
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_queries import rows

FOLDER = "/root/testdata/sf0.001"
# Streams run in a session of their own below; the corpus queries have their own tests.
QUICK = [name for name in sorted(entry.oracle_sql()) if not name.startswith("stream_") and not (name.startswith("op") and "_" in name and name[2].isdigit())]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables here")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.columns[0] == "block_id" and frame.count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


PLAIN = """
import json, sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as entry
sys.path.remove(sys.argv[1])
out = {}
for name, query in sorted(entry.queries().items()):
    if name.startswith("stream_"):
        frame = query(spark, sys.argv[2])
        out[name] = [frame.columns, [[x if isinstance(x, (int, float, str, type(None))) else str(x) for x in r] for r in frame.collect()]]
print("RESULT" + json.dumps(out))
"""


def test_streams_run_in_any_session(tables, tmp_path):
    """A session built by somebody else, in another folder, whose workers don't find the package by path."""
    import json

    root = os.path.dirname(os.path.abspath(entry.__file__))
    run = subprocess.run([sys.executable, "-c", PLAIN, root, FOLDER], cwd=tmp_path, capture_output=True, text=True, timeout=900,
                         env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert "RESULT" in run.stdout, run.stderr[-3000:]
    found = json.loads(run.stdout.split("RESULT", 1)[1])
    assert len(found) == 5 and all(rows for _, rows in found.values())
    for name in set(found) & set(entry.oracle_sql()):
        columns, got = found[name]
        result = tables.execute(entry.oracle_sql()[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == sorted(columns) and rows(columns, got) == rows(names, result.fetchall()), name


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, tables, name):
    frame = entry.queries()[name](spark, FOLDER)
    result = tables.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(frame.columns)
    assert rows(frame.columns, frame.collect()) == rows(names, result.fetchall())
