"""Stream queries: each runs over the tables as a stream into a sink and reads that back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelshift.functions import checks as C
from modelshift.operators import properties as pr
from modelshift.operators import structural as st
from modelshift.operators.rules import Check
from modelshift.plans.registry import query, read
from modelshift.session import new_folder
from modelshift.streaming import stream as sm


def events(spark: SparkSession, d: str) -> DataFrame:
    """The events table as a stream of the one file it is."""
    return (
        spark.readStream.schema(read(spark, d, "events").schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(d)
    )


@query("stream_reshape", """
    SELECT event_id, user_id, event_type AS kind, value AS amount,
           CAST(json_extract_string(props, '$.k') AS INTEGER) AS props_k, 'live' AS stage
    FROM events
""")
def stream_reshape(spark: SparkSession, d: str) -> DataFrame:
    """Parse the JSON document, flatten it, rename and add columns: no state."""

    def edit(df: DataFrame) -> DataFrame:
        df = df.withColumn("props", F.from_json("props", "k int"))
        df = st.flatten(df, "props")
        df = st.unflatten(df, {"event_type": "kind", "value": "amount"}, "detail")
        df = pr.add_property(df, "detail.stage", "String", "live")
        return df.select("event_id", "user_id", "detail.kind", "detail.amount", "props_k",
                         "detail.stage")

    return sm.run_to_table(sm.reshape(events(spark, d), edit))


@query("stream_nest", """
    SELECT event_id, user_id, c_name AS user_name, c_mktsegment AS segment
    FROM events LEFT JOIN customer ON user_id = c_custkey
""")
def stream_nest(spark: SparkSession, d: str) -> DataFrame:
    nested = sm.nest_static(
        events(spark, d), read(spark, d, "customer"), {"user_id": "c_custkey"}, "user",
        ["c_name", "c_mktsegment", "c_custkey"],
    )
    return sm.run_to_table(nested.select(
        "event_id", F.col("user.c_custkey").alias("user_id"),
        F.col("user.c_name").alias("user_name"), F.col("user.c_mktsegment").alias("segment"),
    ))


@query("stream_quarantine", """
    SELECT 'good' AS side, event_id, '' AS broken FROM events
    WHERE value < 40 AND event_type <> 'error'
    UNION ALL
    SELECT 'bad', event_id, concat_ws(',', CASE WHEN value >= 40 THEN 'check(value low)' END,
                                      CASE WHEN event_type = 'error' THEN 'check(event_type fine)' END)
    FROM events WHERE value >= 40 OR event_type = 'error'
""")
def stream_quarantine(spark: SparkSession, d: str) -> DataFrame:
    folder = new_folder(spark, "stream")
    rules = [
        Check("events", "value", "low", C.compare("<", 40)),
        Check("events", "event_type", "fine", C.compare("!=", "error")),
    ]
    sm.quarantine_stream(
        events(spark, d), rules, f"{folder}/good", f"{folder}/bad", f"{folder}/state")
    good = spark.read.parquet(f"{folder}/good").select(
        F.lit("good").alias("side"), "event_id", F.lit("").alias("broken"))
    bad = spark.read.parquet(f"{folder}/bad").select(
        F.lit("bad").alias("side"), "event_id", F.array_join("_broken", ",").alias("broken"))
    return good.unionByName(bad)


@query("stream_wind", """
    SELECT CAST(time_bucket(INTERVAL 6 HOURS, ts) AS TIMESTAMP) AS window_start, event_type,
           count(*) AS n_values, min(value) AS lowest, max(value) AS highest
    FROM events
    WHERE time_bucket(INTERVAL 6 HOURS, ts) + INTERVAL 6 HOURS
          <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR
    GROUP BY 1, 2
""")
def stream_wind(spark: SparkSession, d: str) -> DataFrame:
    """Values per type and six hours; a window is written once the watermark has passed it."""
    timed = events(spark, d).withColumn("ts", sm.as_instant(F.col("ts")))
    lists = sm.run_to_table(sm.wind_windows(
        timed, "ts", ["event_type"], "value", window="6 hours", late="1 hour", salt=["event_id"]))
    return lists.groupBy("window_start", "event_type").agg(
        F.sum(F.size("value")).cast("bigint").alias("n_values"),
        F.min(F.array_min("value")).alias("lowest"),
        F.max(F.array_max("value")).alias("highest"),
    ).withColumn("window_start", sm.as_naive(F.col("window_start")))


@query("stream_wind_all", """
    SELECT CAST(time_bucket(INTERVAL 6 HOURS, ts) AS TIMESTAMP) AS window_start, event_type,
           count(*) AS n_values, (count(*) + 99) // 100 AS n_parts, max(value) AS highest,
           CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents
    FROM events GROUP BY 1, 2
""")
def stream_wind_all(spark: SparkSession, d: str) -> DataFrame:
    """Values per type and six hours in parts of 100, windows that are still open included."""
    timed = events(spark, d).withColumn("ts", sm.as_instant(F.col("ts")))
    folder = new_folder(spark, "stream")
    lists = sm.wind_to_table(
        timed, f"{folder}/lists", f"{folder}/state", "ts", ["event_type"], "value", window="6 hours",
        late="1 hour", elements_per_part=100)
    cents = F.aggregate("value", F.lit(0).cast("bigint"), lambda a, x: a + F.round(x * 100).cast("bigint"))
    return lists.groupBy("window_start", "event_type").agg(
        F.sum(F.size("value")).cast("bigint").alias("n_values"),
        F.count("*").alias("n_parts"),
        F.max(F.array_max("value")).alias("highest"),
        F.sum(cents).alias("cents"),
    ).withColumn("window_start", sm.as_naive(F.col("window_start")))


@query("stream_unique", "SELECT count(*) AS n_rows, count(DISTINCT event_id) AS n_ids FROM events")
def stream_unique(spark: SparkSession, d: str) -> DataFrame:
    """Every event arrives twice and is kept once."""
    timed = events(spark, d).withColumn("ts", sm.as_instant(F.col("ts")))
    twice = timed.select("event_id", "ts", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    kept = sm.run_to_table(sm.unique_within(twice, "ts", ["event_id"], "1 hour"))
    return kept.agg(
        F.count("*").alias("n_rows"), F.count_distinct("event_id").alias("n_ids"))
