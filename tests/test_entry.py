import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_tables
def test_entry(spark):
    assert entry.entry(spark).columns == ["path", "score"]


def plain(rows):
    return sorted(tuple("" if v is None else round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)


@needs_tables
@pytest.mark.parametrize("name", ["lexical_score", "file_edges", "degrees", "line_windows", "symbol_chunks", "budget_skip", "savings", "task_types", "path_flags"])
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    frame = entry.queries()[name](spark, FOLDER)
    columns = sorted(frame.columns)
    want = con.execute(f"select {', '.join(columns)} from ({entry.oracle_sql()[name]})").fetchall()
    assert plain(map(tuple, frame.select(columns).collect())) == plain(want)
