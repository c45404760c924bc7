"""Every registered query of the incident operators against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tracewright.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path).split('.')[0]} AS SELECT * FROM '{path}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(str(tuple(round(v, 6) if isinstance(v, float) else str(v) for v in r)) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    query, sql = QUERIES[name]
    got, want = query(spark, SF).toPandas(), duck.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize(("name", "descending"), [("ordered_timeline", False), ("latest_events_first", True)])
def test_whole_timeline_in_order(spark, name, descending):
    got = [(r["at"], r["source"], r["action"]) for r in QUERIES[name][0](spark, SF).collect()]
    assert len(got) == spark.read.parquet(f"{SF}/events.parquet").count() > 50
    assert got == sorted(got, reverse=descending)


def test_case_ids_are_whole_texts(spark, tmp_path):
    spark.createDataFrame([(1, "case-2024-0001/x"), (2, "case-2024-0001\\x"), (3, " " * 12 + "case"), (4, "case-2024-0001"), (5, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.ok for r in QUERIES["valid_whole_case_ids"][0](spark, str(tmp_path)).collect()}
    assert got == {1: False, 2: False, 3: True, 4: True, 5: False}


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
