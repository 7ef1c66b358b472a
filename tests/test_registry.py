"""Every registered query against its SQL, and the shape of the plans."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_point
from shoplens.testbed.queries import REGISTRY

SF_DIR = "/root/testdata/sf0.001"
DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
#: The corpus operators have tests of their own.
QUERIES = {name: fn for name, fn in entry_point.queries().items() if name in REGISTRY}
ORACLE = {name: sql for name, sql in entry_point.oracle_sql().items() if name in REGISTRY}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


def test_only_the_file_listing_has_no_sql():
    assert set(QUERIES) - set(ORACLE) == {"list_files"}
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


def test_list_files(spark):
    assert [r.name for r in QUERIES["list_files"](spark, SF_DIR).collect()] == ["labels.parquet", "lineitem.parquet"]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = ordered(tuple(r) for r in df.select(*columns).collect())
    result = duck.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = ordered(tuple(r[names.index(c)] for c in columns) for r in result.fetchall())
    assert len(got) == len(want)
    assert got == want
    assert not any(isinstance(v, float) and math.isnan(v) for r in got for v in r)


BATCH = sorted(n for n in QUERIES if not n.startswith("stream_") and n not in ("list_files", "json_roundtrip"))
PYTHON_ALLOWED = {"summary_text", "ab_evaluation", "experiment_summary"}


@pytest.mark.parametrize("name", BATCH)
def test_plan_stays_distributed(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    bad = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "FlatMapGroupsInPandas", "SinglePartition"]
    assert not [b for b in bad if b in plan]
    assert ("ArrowEvalPython" in plan) == (name in PYTHON_ALLOWED)


def test_window_bounds_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = QUERIES["visits_window"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(ts," in plan and "LessThan(ts," in plan
    assert "props" not in plan and "value" not in plan
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_feed_pages_are_parsed_once(spark):
    plan = QUERIES["order_feed_flatten"](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 2, "one for the orders, one for the checkouts"


def test_day_layout_prunes_folders(spark, table, tmp_path):
    from shoplens.functions.timeutil import ReportWindow
    from shoplens.sources import tables

    rows = [
        {"client_id": "a", "session_id": "s", "event_name": "home", "creation_time": f"2024-01-{d:02d}T12:00:00Z"}
        for d in range(1, 29)
    ]
    tables.append_table(table("visits", rows), str(tmp_path), "visits")
    clients = table("clients", [{"client_id": "a", "client_timezone": "Asia/Kolkata"}])
    window = ReportWindow("2024-01-10T00-00-00", "2024-01-11T00-00-00")
    kept = window.restrict(tables.read_table(spark, str(tmp_path), "visits"), "creation_time", clients)
    assert kept.count() == 1
    assert len(kept.inputFiles()) == 28
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
