"""Partition and clustering keys: how rows lie on disk, and where each row stands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from modelshift.functions import paths as P
from modelshift.functions.keys import row_hash


#: Rows per written file; bounds a file whatever one task received.
MAX_RECORDS = 5_000_000


def clustering(keys: list[str | tuple[str, str]]) -> list[tuple[str, bool]]:
    """Normalise ``["a", ("b", "desc")]`` to names with an ascending flag."""
    out = []
    for k in keys:
        name, order = (k, "asc") if isinstance(k, str) else k
        if order.lower() not in ("asc", "desc"):
            raise ValueError(f"clustering order {order!r}")
        out.append((name, order.lower() == "asc"))
    return out


def _sort(keys: list[tuple[str, bool]]) -> list[Column]:
    return [P.column(n).asc() if up else P.column(n).desc() for n, up in keys]


def laid_out(
    df: DataFrame, partition: list[str], cluster: list[str | tuple[str, str]] | None = None
) -> DataFrame:
    """Rows range-partitioned and sorted by partition key, then clustering key.

    A range partitioning keeps a partition key together where it fits into a task and
    cuts a hot one along the clustering order, which hashing the partition key cannot. A
    hash of the row cuts rows that tie on all keys.
    """
    order = _sort(clustering([*partition, *(cluster or [])]))
    return df.repartitionByRange(*order, row_hash(df)).sortWithinPartitions(*order)


def layout_writer(
    df: DataFrame,
    partition: list[str],
    cluster: list[str | tuple[str, str]] | None = None,
    folders: list[str] | None = None,
) -> DataFrameWriter:
    """A writer of this layout. ``folders`` names low-cardinality directory columns."""
    writer = (
        laid_out(df, partition, cluster)
        .write.format("parquet")
        .mode("errorifexists")
        .option("maxRecordsPerFile", MAX_RECORDS)
    )
    return writer.partitionBy(*folders) if folders else writer


def write_layout(
    df: DataFrame,
    path: str,
    partition: list[str],
    cluster: list[str | tuple[str, str]] | None = None,
    folders: list[str] | None = None,
) -> None:
    layout_writer(df, partition, cluster, folders).save(path)


def append_layout(
    df: DataFrame, path: str, partition: list[str], cluster: list[str | tuple[str, str]] | None = None
) -> None:
    """Add rows to a written layout, as files of their own that are sorted in the same way."""
    layout_writer(df, partition, cluster).mode("append").save(path)


def partition_sizes(df: DataFrame, partition: list[str]) -> DataFrame:
    """Rows per partition key."""
    return df.groupBy(*[P.column(c) for c in partition]).agg(F.count("*").alias("n_rows"))


def skew_report(df: DataFrame, partition: list[str]) -> DataFrame:
    """Number of partition keys, rows, and the smallest and largest partition."""
    return partition_sizes(df, partition).agg(
        F.count("*").alias("n_partitions"),
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"),
        F.min("n_rows").alias("smallest"),
        F.max("n_rows").alias("largest"),
    )


def hot_keys(df: DataFrame, partition: list[str], share: float) -> DataFrame:
    """The partition keys that hold at least ``share`` of all rows, with their exact counts.

    Sketches of the most frequent hashes are merged over the tasks; they track so many that every
    such key is among their candidates, of which there are at most 2 / ``share``. Then the rows of
    the candidates alone are counted: no other key is shuffled.
    """
    if not 1e-5 <= share <= 1:
        raise ValueError(f"share {share}: a fraction of the rows, at least 0.00001")
    code = F.xxhash64(*[P.column(c) for c in partition])
    tracked = min(1_000_000, int(40 / share) + 100)
    found = df.select(code.alias("h")).agg(
        F.count("*").alias("n"),
        F.expr(f"approx_top_k(h, {min(100_000, int(2 / share) + 1)}, {tracked})").alias("top")).first()
    assert found is not None
    candidates = df.sparkSession.createDataFrame([(r["item"],) for r in found["top"] or []], "_h bigint")
    counted = df.join(F.broadcast(candidates), code == F.col("_h"), "left_semi").groupBy(
        *[P.column(c) for c in partition]).agg(F.count("*").alias("n_rows"))
    return counted.where(F.col("n_rows") >= F.lit(share) * found["n"])


def _file_place() -> Column:
    """A written file's place: its task number, then its number within the task, then its name,
    which tells the files of several appends apart."""
    name = F.element_at(F.split("_metadata.file_path", "/"), -1)
    return F.struct(
        F.regexp_extract(name, r"^part-(\d+)-", 1).cast("int").alias("task"),
        F.regexp_extract(name, r"-c(\d+)\.", 1).try_cast("int").alias("nth"),
        F.col("_metadata.file_path").alias("path"),
    )


def _rows_of(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path).select(
        "*", _file_place().alias("_file"), F.col("_metadata.row_index").alias("_row"))


def _after(one: list[Column], two: list[Column], keys: list[tuple[str, bool]]) -> Column:
    """The first tuple comes after the second in the order of ``keys``; nulls as Spark sorts them."""
    out, equal = F.lit(False), F.lit(True)
    for a, b, (_, up) in zip(one, two, keys):
        null_first = b.isNull() & a.isNotNull() if up else a.isNull() & b.isNotNull()
        worse = F.coalesce(a > b if up else a < b, F.lit(False)) | null_first
        out = out | (equal & worse)
        equal = equal & a.eqNullSafe(b)
    return out


def key_runs(
    spark: SparkSession, path: str, schema: T.StructType, partition: list[str],
    cluster: list[str | tuple[str, str]] | None = None,
) -> DataFrame:
    """Each partition key's rows in each file, summed up: ``_file``, the key, ``_start``, ``_n``,
    ``_first``, ``_last`` (clustering columns), ``_before`` (rows of the key in earlier runs) and
    ``_late`` (the run begins before the one that precedes it has ended).

    The summaries merge, so a key that owns many files is summed up by many tasks. Runs are
    ordered by where they begin, whichever append wrote them. If any two runs of a key overlap,
    some run follows one that it overlaps.
    """
    order = clustering(cluster or [])
    keys = [P.column(c) for c in partition]
    place = F.struct(*[P.column(n).alias(f"c{i}") for i, (n, _) in enumerate(order)]) if order else F.lit(0)
    runs = _rows_of(spark, path, schema).groupBy("_file", *keys).agg(
        F.min("_row").alias("_start"), F.count("*").alias("_n"),
        F.min_by(place, "_row").alias("_first"), F.max_by(place, "_row").alias("_last"))

    def sorted_by(end: str) -> list[Column]:
        cols = [F.col(end)[f"c{i}"] for i in range(len(order))]
        return [c.asc() if up else c.desc() for c, (_, up) in zip(cols, order)]

    by_key = Window.partitionBy(*keys).orderBy(*sorted_by("_first"), *sorted_by("_last"), "_file")
    earlier = F.lag("_last").over(by_key)
    late = _after([earlier[f"c{i}"] for i in range(len(order))],
                  [F.col("_first")[f"c{i}"] for i in range(len(order))], order)
    before = F.sum("_n").over(by_key.rowsBetween(Window.unboundedPreceding, -1))
    return runs.withColumn("_before", F.coalesce(before, F.lit(0))).withColumn(
        "_late", F.when(F.row_number().over(by_key) > 1, late).otherwise(F.lit(False)))


def read_positions(
    spark: SparkSession, path: str, schema: T.StructType, partition: list[str], name: str,
    cluster: list[str | tuple[str, str]] | None = None,
) -> DataFrame:
    """Rows of a written layout with their 1-based place within their partition key.

    The place is the row's offset in its file minus where its partition key starts there,
    plus the rows of that key in earlier runs (see :func:`key_runs`). Groups are one key within
    one file, so a key that owns many files is still handled by many tasks.

    Where appends have left runs of a key that overlap, its places cannot be read off the files;
    the rows of such keys are sorted. Writing them anew with :func:`write_layout` ends that.
    """
    rows, keys = _rows_of(spark, path, schema), [P.column(c) for c in partition]
    runs = key_runs(spark, path, schema, partition, cluster)
    mixed = F.max("_late").over(Window.partitionBy(*keys))
    starts = runs.select(
        F.col("_file").alias("_f"), *[P.column(c).alias(f"_k{i}") for i, c in enumerate(partition)],
        (F.col("_before") - F.col("_start")).alias("_shift"), mixed.alias("_mixed"))
    on = F.col("_file") == F.col("_f")
    for i, c in enumerate(partition):
        on = on & P.column(c).eqNullSafe(F.col(f"_k{i}"))
    known = rows.join(starts, on)
    sorted_ = Window.partitionBy(*keys).orderBy(*_sort(clustering(cluster or [])), "_file", "_row")
    columns = [P.column(n) for n in schema.names]
    calm = known.where("not _mixed").select(
        *columns, (F.col("_row") + F.col("_shift") + 1).cast("bigint").alias(name))
    return calm.unionByName(known.where("_mixed").select(
        *columns, F.row_number().over(sorted_).cast("bigint").alias(name)))


def positions(
    df: DataFrame,
    path: str,
    partition: list[str],
    cluster: list[str | tuple[str, str]],
    name: str = "position",
) -> DataFrame:
    """Write ``df`` in its layout to ``path`` and return its rows with their places.

    ``cluster`` should end in columns that make the order total.
    """
    write_layout(df, path, partition, cluster)
    return read_positions(df.sparkSession, path, df.schema, partition, name, cluster)


def out_of_order(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    partition: list[str],
    cluster: list[str | tuple[str, str]],
) -> DataFrame:
    """Files of a written layout with the number of places where the order breaks.

    Those are neighbouring rows in the wrong order, and partition keys whose rows in this file begin
    before those of another file, or of an earlier append, have ended.
    """
    keys = clustering([*partition, *cluster])
    rows = spark.read.schema(schema).parquet(path).select(
        *[P.column(n) for n, _ in keys],
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.row_index").alias("_row"),
    )
    w = Window.partitionBy("_path").orderBy("_row")
    names = [P.column(n) for n, _ in keys]
    first = F.row_number().over(w) == 1
    wrong = ~first & _after([F.lag(c).over(w) for c in names], names, keys)
    inside = rows.select("_path", wrong.alias("_wrong")).groupBy("_path").agg(
        F.count("*").alias("n_rows"), F.count_if("_wrong").alias("_inside"))
    between = key_runs(spark, path, schema, partition, cluster).groupBy(
        F.col("_file.path").alias("_path")).agg(F.count_if("_late").alias("_between"))
    return inside.join(between, "_path").select(
        F.element_at(F.split("_path", "/"), -1).alias("file"), "n_rows",
        (F.col("_inside") + F.col("_between")).alias("wrong"))
