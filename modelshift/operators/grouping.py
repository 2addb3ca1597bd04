"""Collect rows into arrays, whole or in parts of a stated size."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modelshift.functions.keys import holds_map, stable
from modelshift.functions.paths import column, quoted
from modelshift.session import new_folder


class DuplicateKey(ValueError):
    """A key that must be unique is not."""


def duplicate_groups(df: DataFrame, cols: list[str]) -> DataFrame:
    """Key values held by more than one row; keys with a null part are left out.

    Only the key columns are read, and copies are counted before the shuffle.
    """
    present = df.select(*[column(c) for c in cols]).where(
        " and ".join(f"{quoted(c)} is not null" for c in cols)
    )
    return present.groupBy(*[column(c) for c in cols]).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(df: DataFrame, cols: list[str], what: str) -> None:
    """Raise if a key repeats, so a join on it cannot multiply rows unnoticed."""
    repeated = duplicate_groups(df, cols).count()
    if repeated:
        raise DuplicateKey(f"{what}: {repeated} values of ({', '.join(cols)}) repeat")


@dataclass(frozen=True)
class Gathered:
    """Arrays per key, and per part of it where the caller asked for parts.

    Without parts ``cut`` and ``parts`` are None. With them ``whole`` has the keys that fill one
    part, ``cut`` the others part by part, and ``parts`` lists those with their number of parts.
    """

    whole: DataFrame
    cut: DataFrame | None = None
    parts: DataFrame | None = None

    @property
    def rows(self) -> DataFrame:
        return self.whole if self.cut is None else self.whole.unionByName(self.cut)


def gather(
    rows: DataFrame,
    keys: list[str],
    element: Column,
    alias: str,
    *,
    part_column: str | None = None,
    elements_per_part: int | None = None,
    counted_on: DataFrame | None = None,
    dealt: bool = False,
) -> Gathered:
    """Sorted arrays of ``element`` per key, in ``alias``.

    Without a part column one array holds a whole key; that suits keys whose number of rows
    is known to be small. With one, every key comes out as (key, part), whatever its size:
    each part but the last holds exactly ``elements_per_part`` elements, so that a key that
    owns a third of all rows spreads over many tasks. Which one is the caller's choice alone;
    the data decides neither the columns nor the path. ``counted_on`` is a frame that holds the
    same keys equally often, and is cheaper to count them on than ``rows``. ``dealt`` says that
    ``rows`` were partitioned by the keys before they were widened, and need not be again.
    """
    if (part_column is None) != (elements_per_part is None):
        raise ValueError("part_column and elements_per_part go together")
    carried = rows.select(*[column(k) for k in keys], element.alias(alias))
    kind = carried.schema[alias].dataType
    # Maps have no order, so elements that hold one are sorted and compared by a stable form.
    carried = carried.withColumn("_order", stable(column(alias), kind)) if holds_map(kind) else carried
    if part_column is None:
        whole = carried.groupBy(*[column(k) for k in keys]).agg(
            _sorted_list(carried, alias).alias(alias)
        )
        return Gathered(whole)
    return _gather_in_parts(
        carried, carried if counted_on is None else counted_on, keys, alias, part_column, elements_per_part,
        dealt)


def _packed(rows: DataFrame, alias: str) -> Column:
    """An element as it is collected: with its stable form beside it where it has one."""
    if "_order" not in rows.columns:
        return column(alias)
    return F.struct("_order", column(alias).alias("_value"))


def _sort_packed(rows: DataFrame, array: Column) -> Column:
    if "_order" not in rows.columns:
        return F.array_sort(array)

    def by_order(a: Column, b: Column) -> Column:
        x, y = a.getField("_order"), b.getField("_order")
        return F.when(x < y, -1).when(x > y, 1).otherwise(0)

    return F.transform(F.array_sort(array, by_order), lambda x: x.getField("_value"))


def _sorted_list(rows: DataFrame, alias: str) -> Column:
    listed = F.collect_list(_packed(rows, alias))
    # No element of it is null, so both sorts agree; this one is compiled.
    return F.sort_array(listed) if "_order" not in rows.columns else _sort_packed(rows, listed)


def _gather_in_parts(
    carried: DataFrame, counted_on: DataFrame, keys: list[str], alias: str, part_column: str, per_part: int,
    dealt: bool,
) -> Gathered:
    """Arrays of keys that fill no more than a part, and of the others by number.

    Keys are counted first, on their own columns, and the large ones stored: Spark then knows the
    size of that list, and where it is small picks their rows out below the joins that widen
    them, so that all rows travel once. The rows of a key within one part are grouped
    once. Those of the others (no more keys than rows / ``per_part``) are numbered and the numbers
    cut into parts. Both ways are in every plan, and give the same rows for a key of either size.

    Numbering: equal elements travel as one row with their count. An element's number is the count
    in the key's earlier hash buckets plus its place in its own bucket; a key has about as many
    buckets as parts, so no window holds more than a part's share of a key.
    """
    names = [column(k) for k in keys]
    content = "_order" if "_order" in carried.columns else alias
    first = [F.any_value(column(alias)).alias(alias)] if content == "_order" else []
    large = counted_on.groupBy(*names).agg(F.count("*").alias("_n")).where(F.col("_n") > per_part).select(
        *[column(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.ceil(F.col("_n") / per_part).cast("int").alias("_parts"))
    folder = new_folder(carried.sparkSession, "large-keys")
    large.write.parquet(folder)
    sizes = carried.sparkSession.read.schema(large.schema).parquet(folder)
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & column(k).eqNullSafe(F.col(f"_k{i}"))
    # Rows travel as they are: lists begun before the shuffle would be sorted and longer.
    small = carried.join(sizes, same, "left_anti")
    whole = (small if dealt else small.repartition(*names)).groupBy(*names).agg(
        _sorted_list(carried, alias).alias(alias)).withColumn(part_column, F.lit(0))
    counted = carried.join(sizes, same, "left_semi").groupBy(*names, column(content)).agg(
        F.count("*").alias("_copies"), *first)
    dealt = counted.join(sizes, same).drop(*[f"_k{i}" for i in range(len(keys))]).withColumn(
        "_bucket", F.pmod(F.xxhash64(column(content)), F.col("_parts")))
    before = Window.partitionBy(*names).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy(*names, "_bucket").agg(F.sum("_copies").alias("_n")).select(
        *[column(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*names, "_bucket").orderBy(column(content)).rowsBetween(
        Window.unboundedPreceding, -1)
    placed = (
        dealt.withColumn("_before", F.coalesce(F.sum("_copies").over(inside), F.lit(0)))
        .join(base, same & (F.col("_bucket") == F.col("_b")))
        .withColumn("_from", F.col("_base") + F.col("_before"))
        .withColumn("_to", F.col("_from") + F.col("_copies"))
        .withColumn(part_column, F.explode(F.sequence(
            F.expr(f"_from div {per_part}"), F.expr(f"(_to - 1) div {per_part}"))))
    )
    part = F.col(part_column)
    take = F.least("_to", (part + 1) * per_part) - F.greatest("_from", part * per_part)
    arrays = placed.groupBy(*names, part.cast("int").alias(part_column)).agg(
        _sort_packed(carried, F.flatten(F.collect_list(
            F.array_repeat(_packed(carried, alias), take.cast("int"))))).alias(alias))
    parts = sizes.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], "_parts")
    return Gathered(whole, arrays, parts)


def attach(
    target: DataFrame,
    gathered: Gathered,
    on: dict[str, str],
    alias: str,
    part_column: str | None,
) -> DataFrame:
    """Left-join gathered arrays onto ``target``; ``on`` maps target columns to key columns.

    With parts, a target row comes out once for each part of its key. Keys of one part are joined
    by themselves, where their arrays lie grouped already; the others are joined on key and part,
    so a large key's arrays do not meet in one task. Every target row has exactly
    one row with part 0. The key need not be unique in ``target``: rows that share it each get
    all its arrays.
    """
    if part_column is None:
        return _attach(target, gathered.whole, on, alias)
    assert gathered.parts is not None and gathered.cut is not None
    parts = gathered.parts.select(
        *[column(k).alias(f"_p{i}") for i, k in enumerate(on.values())], "_parts")
    match = F.lit(True)
    for i, t in enumerate(on):
        match = match & (column(t) == F.col(f"_p{i}"))
    one = _attach(target.join(parts, match, "left_anti"), gathered.whole.drop(part_column), on, alias)
    spread = target.join(parts, match).withColumn(
        part_column, F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
    ).drop("_parts", *[f"_p{i}" for i in range(len(on))])
    several = _attach(spread, gathered.cut, {**on, part_column: part_column}, alias)
    return one.withColumn(part_column, F.lit(0)).unionByName(several)


def _attach(target: DataFrame, arrays: DataFrame, on: dict[str, str], alias: str) -> DataFrame:
    keys = {k: f"_key{i}" for i, k in enumerate(on.values())}
    element_type = arrays.schema[alias].dataType
    arrays = arrays.select(
        *[column(k).alias(v) for k, v in keys.items()], column(alias).alias("_array")
    )
    cond = F.lit(True)
    for t, k in on.items():
        cond = cond & (column(t) == F.col(keys[k]))
    empty = F.array().cast(element_type)
    return (
        target.join(arrays, cond, "left")
        .withColumn(alias, F.coalesce("_array", empty))
        .drop("_array", *keys.values())
    )
