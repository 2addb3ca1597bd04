"""Registered queries on tables where one key or one copied row holds a third of all rows,
some references are missing, and arrays must be spread over parts."""

import duckdb
import pytest

import __spark_entry__ as entry
from modelshift.plans import structure_queries, trade
from tests.oracle import TABLES, compare, connect

SKEW = {
    "lineitem": """SELECT CASE WHEN rn % 3 = 0 THEN 7 ELSE l_orderkey END AS l_orderkey,
        CASE WHEN rn % 40 = 1 THEN NULL WHEN rn % 3 = 0 THEN 11 ELSE l_partkey END AS l_partkey,
        CASE WHEN rn % 6 = 0 THEN 3 ELSE l_suppkey END AS l_suppkey,
        CASE WHEN rn % 6 = 0 THEN 1 ELSE l_linenumber END AS l_linenumber,
        CASE WHEN rn % 6 = 0 THEN 5.0 ELSE l_quantity END AS l_quantity,
        CASE WHEN rn % 6 = 0 THEN 9.25 ELSE l_extendedprice END AS l_extendedprice,
        l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate""",
    "orders": """SELECT o_orderkey, CASE WHEN rn % 50 = 1 THEN NULL WHEN rn % 3 = 0 THEN 5
        ELSE o_custkey END AS o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority""",
    "events": """SELECT event_id, ts, CASE WHEN rn % 3 = 0 THEN 3 ELSE user_id END AS user_id,
        CASE WHEN rn % 3 = 0 THEN 'click' ELSE event_type END AS event_type,
        CASE WHEN rn % 3 = 0 THEN 1.5 ELSE value END AS value, props""",
}
NAMES = [
    "nest_to_one", "nest_to_many", "nest_deep", "nest_in_array", "unnest_array",
    "unnest_recursive", "flatten_in_array", "wind_group", "wind_unwind", "merge_one_to_many",
    "check_primary_key", "check_foreign_key", "check_in_array", "nested_paths",
    "clustering_order", "bag_diff", "round_trip", "r2d", "d2r", "g2d",
]


@pytest.fixture(scope="module")
def skewed(sf_dir, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("skewed"))
    con = duckdb.connect()
    for t in TABLES:
        rows = f"(SELECT *, row_number() OVER () AS rn FROM read_parquet('{sf_dir}/{t}.parquet'))"
        pick = SKEW.get(t, "SELECT * EXCLUDE (rn)")
        con.execute(f"COPY ({pick} FROM {rows}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
    return folder


@pytest.fixture(autouse=True)
def small_arrays(monkeypatch):
    for module in (trade, structure_queries):
        monkeypatch.setattr(module, "PER_PART", 100)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, skewed, name):
    got = entry.queries()[name](spark, skewed).toArrow()
    want = connect(skewed).sql(entry.oracle_sql()[name]).to_arrow_table()
    assert compare(got, want) == []
