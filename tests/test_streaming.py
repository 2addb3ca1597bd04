"""Streams over several files: late rows, repeats, quarantine."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from modelshift.functions import checks as C
from modelshift.operators import structural as st
from modelshift.operators.rules import Check
from modelshift.session import new_folder
from modelshift.streaming import stream as sm

SCHEMA = "id int, ts timestamp, k string, v int"


def at(minute):
    return dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(minutes=minute)


@pytest.fixture()
def folder(spark):
    """Four files that a stream reads one by one."""
    path = new_folder(spark, "input")
    batches = [
        [(1, at(1), "a", 5), (2, at(2), "a", 3), (3, at(3), "b", 9)],
        [(4, at(40), "a", 1), (2, at(2), "a", 3)],
        [(7, at(41), "b", 1)],
        [(5, at(4), "a", 7), (6, at(90), "b", 2)],
    ]
    for b in batches:
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, folder):
    schema = spark.createDataFrame([], SCHEMA).schema
    return sm.read_stream(spark, folder, schema, files_per_trigger=1)


def test_reshape(spark, folder):
    out = sm.run_to_table(sm.reshape(
        stream(spark, folder), lambda df: st.unflatten(df, ["k", "v"], "o")))
    assert out.count() == 8 and out.select("o.v").count() == 8
    with pytest.raises(ValueError):
        sm.reshape(spark.range(1), lambda df: df)


def test_wind_drops_late_rows(spark, folder):
    out = sm.run_to_table(sm.wind_windows(
        stream(spark, folder), "ts", ["k"], "v", window="10 minutes", late="15 minutes",
        salt=["id"], n_parts=4))
    got = out.where("window_start = timestamp'2024-01-01 00:00:00'").groupBy("k").agg(
        F.array_sort(F.flatten(F.collect_list("v"))).alias("v"))
    rows = {r.k: r.v for r in got.collect()}
    assert rows["b"] == [9]
    # The row of minute 4 came after the watermark had passed its window.
    assert 7 not in rows["a"] and set(rows["a"]) == {3, 5}


def test_wind_to_table_has_all_windows_in_parts(spark, folder):
    base = new_folder(spark, "out")
    out = sm.wind_to_table(
        stream(spark, folder), f"{base}/lists", f"{base}/state", "ts", ["k"], "v",
        window="10 minutes", late="15 minutes", elements_per_part=1).collect()
    rows = {}
    for r in out:
        assert len(r.v) == 1
        rows.setdefault((str(r.window_start), r.k), []).append(r.v[0])
    sent = sm.run_to_table(sm.reshape(stream(spark, folder), lambda df: df)).collect()
    want = {}
    for r in sent:
        start = r.ts.replace(minute=r.ts.minute // 10 * 10, second=0, microsecond=0)
        if r.v != 7:  # came after its window had been closed
            want.setdefault((str(start), r.k), []).append(r.v)
    assert {k: sorted(v) for k, v in rows.items()} == {k: sorted(v) for k, v in want.items()}


def test_unique(spark, folder):
    out = sm.run_to_table(sm.unique_within(stream(spark, folder), "ts", ["id"], "2 hours"))
    assert out.count() == 7 and out.select("id").distinct().count() == 7


def test_quarantine(spark, folder):
    base = new_folder(spark, "out")
    rules = [Check("e", "v", "small", C.compare("<", 6))]
    sm.quarantine_stream(stream(spark, folder), rules, f"{base}/good", f"{base}/bad", f"{base}/state")
    good, bad = spark.read.parquet(f"{base}/good"), spark.read.parquet(f"{base}/bad")
    assert good.count() == 6 and {r.v for r in bad.collect()} == {7, 9}


def test_nest_static(spark, folder):
    names = spark.createDataFrame([("a", "Anna")], "k string, name string")
    out = sm.run_to_table(sm.nest_static(stream(spark, folder), names, {"k": "k"}, "who", ["name"]))
    assert out.where("who is null").count() == 3


def test_times_do_not_depend_on_the_session_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        df = spark.sql("SELECT timestamp_ntz'2024-03-10 02:30:00.000123' AS t")
        got = df.select(
            F.unix_micros(sm.as_instant(F.col("t"))).alias("us"),
            sm.as_naive(sm.as_instant(F.col("t"))).cast("string").alias("back")).first()
        assert got.us == 1710037800000123 and got.back == "2024-03-10 02:30:00.000123"
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
