"""The same operators on streams, and the few that need state or a foreach sink."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelshift.functions import paths as P
from modelshift.operators import structural as st
from modelshift.operators.grouping import gather
from modelshift.operators.rules import RowRule, broken_rules
from modelshift.session import new_folder


def as_instant(naive: Column) -> Column:
    """A time without a zone as the instant it names in UTC, whatever the session's zone.

    Watermarks need instants; a plain cast would read the time in the session's zone.
    """
    return F.concat(naive.cast("string"), F.lit("Z")).cast("timestamp")


def as_naive(instant: Column) -> Column:
    """The reverse: the UTC time of an instant, without a zone."""
    seconds = F.unix_micros(instant).cast("decimal(24,0)") / F.lit(1_000_000)
    since = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))
    return F.expr("timestamp_ntz'1970-01-01 00:00:00'") + since


def read_stream(
    spark: SparkSession, path: str, schema: T.StructType, *, files_per_trigger: int | None = None
) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def run_to_table(
    stream: DataFrame, folder: str | None = None, mode: str = "append"
) -> DataFrame:
    """Run a stream over what is there now into a Parquet table and return that table."""
    spark = stream.sparkSession
    folder = folder or new_folder(spark, "stream")
    run = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", f"{folder}/data")
        .option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/data")


def reshape(stream: DataFrame, edit: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Any operator that works row by row, unchanged: property edits, FLATTEN, UNFLATTEN,
    UNWIND, SPLIT."""
    if not stream.isStreaming:
        raise ValueError("not a stream")
    return edit(stream)


def nest_static(
    stream: DataFrame, source: DataFrame, on: dict[str, str], alias: str, fields: list[str]
) -> DataFrame:
    """NEST of a stored source into a stream: a stream-static left join, no state."""
    return st.nest_one(stream, source, on, alias, fields)


def wind_windows(
    stream: DataFrame,
    time: str,
    keys: list[str],
    value: str,
    *,
    window: str,
    late: str,
    salt: list[str],
    n_parts: int = 8,
) -> DataFrame:
    """WIND on a stream: the values of a key within a time window as a sorted array.

    Rows later than ``late`` are dropped. A window's group is known only when it closes, so
    it cannot be counted first; instead values are spread over ``n_parts`` parts by a hash
    of the ``salt`` columns from the start, and the state of one group never sits in one
    task. ``part`` numbers the rows of a key and window.
    """
    part = F.pmod(F.xxhash64(*[P.column(c) for c in salt]), F.lit(n_parts)).cast("int")
    grouped = (
        stream.withWatermark(time, late)
        .groupBy(F.window(P.column(time), window), *[P.column(k) for k in keys], part.alias("part"))
        .agg(F.array_sort(F.collect_list(P.column(value))).alias(value))
    )
    return grouped.select(
        F.col("window.start").alias("window_start"), *[P.column(k) for k in keys], "part",
        P.column(value),
    )


def wind_to_table(
    stream: DataFrame,
    path: str,
    state_path: str,
    time: str,
    keys: list[str],
    value: str,
    *,
    window: str,
    late: str,
    elements_per_part: int,
) -> DataFrame:
    """WIND on a stream into a table, every window of it: ``window_start``, the keys, ``batch``,
    ``part`` and a sorted array of at most ``elements_per_part`` values.

    Each batch writes the values that it brought, so a window is there from its first value on,
    open windows too, and nothing is kept between batches but the latest time seen: the number of
    values of a key or window does not matter. Within a batch, arrays are cut as NEST cuts them.
    A value whose window ended more than ``late`` before the latest time of earlier batches is
    dropped. A batch that is repeated after a failure replaces its own rows.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        before = None
        if number:
            before = spark.read.parquet(f"{path}/seen/batch={number - 1}").first()["seen"]
        rows = batch.withColumn("_window", F.window(P.column(time), window))
        if before is not None:
            rows = rows.where(F.col("_window.end") > F.lit(before) - F.expr(f"INTERVAL {late}"))
        rows = rows.select(
            F.col("_window.start").alias("window_start"), *[P.column(k) for k in keys], P.column(value))
        arrays = gather(
            rows, ["window_start", *keys], P.column(value), value, part_column="part",
            elements_per_part=elements_per_part)
        arrays.rows.write.mode("overwrite").parquet(f"{path}/data/batch={number}")
        newest = F.greatest(F.max(P.column(time)), F.lit(before).cast("timestamp"))
        batch.agg(newest.alias("seen")).write.mode("overwrite").parquet(f"{path}/seen/batch={number}")

    run = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", state_path)
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return spark.read.option("basePath", f"{path}/data").parquet(f"{path}/data")


def unique_within(stream: DataFrame, time: str, keys: list[str], late: str) -> DataFrame:
    """The first row per key; repeats that arrive within ``late`` are dropped."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def quarantine_stream(
    stream: DataFrame, rules: list[RowRule], good_path: str, bad_path: str, state_path: str
) -> None:
    """Split a stream by its rules into two Parquet tables, exactly once.

    Each batch is marked once and written under its batch number, so a batch that is
    repeated after a failure replaces its own rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        marked = batch.withColumn("_broken", broken_rules(batch, rules)).persist()
        try:
            good = marked.where(F.size("_broken") == 0).drop("_broken")
            bad = marked.where(F.size("_broken") > 0)
            good.write.mode("overwrite").parquet(f"{good_path}/batch={number}")
            bad.write.mode("overwrite").parquet(f"{bad_path}/batch={number}")
        finally:
            marked.unpersist()

    run = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", state_path)
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
