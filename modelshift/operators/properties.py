"""ADD, DELETE, RENAME, COPY, MOVE and CAST of properties, at any nesting depth."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelshift.functions import paths as P
from modelshift.functions.types import spark_type
from modelshift.operators.grouping import require_unique


def add_property(
    df: DataFrame, path: str, dtype: str | T.DataType = "string", default: Any = None
) -> DataFrame:
    """A new field holding ``default`` (a value or a Column), null when none is given."""
    parent, name = P.parent_of(path)
    new = default if isinstance(default, Column) else F.lit(default)
    new = new.cast(spark_type(dtype))

    def edit(fs: P.Fields, _: T.StructType) -> P.Fields:
        if name in fs:
            raise KeyError(f"{path!r} exists already")
        fs[name] = new
        return fs

    return P.edit_object(df, parent, edit)


def delete_property(df: DataFrame, path: str) -> DataFrame:
    parent, name = P.parent_of(P.resolve(df.schema, path))

    def edit(fs: P.Fields, _: T.StructType) -> P.Fields:
        fs.pop(name)
        return fs

    return P.edit_object(df, parent, edit)


def rename_property(df: DataFrame, path: str, new: str) -> DataFrame:
    parent, name = P.parent_of(P.resolve(df.schema, path))

    def edit(fs: P.Fields, _: T.StructType) -> P.Fields:
        if new in fs and new != name:
            raise KeyError(f"{new!r} exists already")
        return {(new if n == name else n): c for n, c in fs.items()}

    return P.edit_object(df, parent, edit)


def cast_property(df: DataFrame, path: str, dtype: str | T.DataType) -> DataFrame:
    """Change the type; a value the type cannot hold becomes null (see :func:`cast_losses`)."""
    parent, name = P.parent_of(P.resolve(df.schema, path))
    to = spark_type(dtype)

    def edit(fs: P.Fields, _: T.StructType) -> P.Fields:
        fs[name] = fs[name].try_cast(to)
        return fs

    return P.edit_object(df, parent, edit)


def _uncastable(values: Column, to: T.DataType) -> Column:
    return F.filter(values, lambda x: x.isNotNull() & x.try_cast(to).isNull())


def cast_losses(df: DataFrame, casts: dict[str, str | T.DataType]) -> DataFrame:
    """For each cast: values present, and values the new type cannot hold. One scan."""
    aggs = []
    for i, (path, dtype) in enumerate(casts.items()):
        full = P.resolve(df.schema, path)
        old, to = P.value(df.schema, full), spark_type(dtype)
        if P.arrays_above(df.schema, full):
            here = F.size(F.filter(old, lambda x: x.isNotNull()))
            lost = F.size(_uncastable(old, to))
        else:
            here = old.isNotNull().cast("int")
            lost = (old.isNotNull() & old.try_cast(to).isNull()).cast("int")
        aggs += [F.sum(F.greatest(here, F.lit(0))).alias(f"v{i}"),
                 F.sum(F.greatest(lost, F.lit(0))).alias(f"l{i}")]
    rows = F.array(
        *[
            F.struct(
                F.lit(path).alias("path"),
                F.lit(spark_type(dtype).simpleString()).alias("new_type"),
                F.coalesce(f"v{i}", F.lit(0)).cast("bigint").alias("n_values"),
                F.coalesce(f"l{i}", F.lit(0)).cast("bigint").alias("lost"),
            )
            for i, (path, dtype) in enumerate(casts.items())
        ]
    )
    return df.agg(*aggs).select(F.inline(rows))


def copy_property(
    target: DataFrame,
    source: DataFrame,
    column: str,
    on: dict[str, str],
    new: str | None = None,
    *,
    agg: str | None = None,
    check: bool = True,
) -> DataFrame:
    """Copy a column to another entity along a reference.

    ``on`` maps target columns to source columns. When a target row may match many source
    rows, ``agg`` names the aggregate (``max``, ``min``, ``sum``, ...) that picks one value;
    it runs before the join, so only one row per key is shuffled to it.
    """
    new = new or P.parts_of(column)[-1]
    keys = {k: f"_key{i}" for i, k in enumerate(on.values())}
    val = P.value(source.schema, P.resolve(source.schema, column))
    lookup = source.select(
        *[P.column(k).alias(v) for k, v in keys.items()], val.alias("_copied")
    )
    if agg:
        lookup = lookup.groupBy(*keys.values()).agg(F.expr(f"{agg}(_copied)").alias("_copied"))
    elif check:
        require_unique(source, list(on.values()), f"copy of {column}")
    cond = F.lit(True)
    for t, k in on.items():
        cond = cond & (P.value(target.schema, t) == F.col(keys[k]))
    joined = target.join(lookup, cond, "left")
    return joined.select(*[P.column(n) for n in target.columns], F.col("_copied").alias(new))


def add_embedded(
    df: DataFrame, path: str, structure: str | T.StructType, *, many: bool = False
) -> DataFrame:
    """An absent object (null) or, with ``many``, an empty array of objects."""
    if isinstance(structure, str):
        parsed = T._parse_datatype_string(f"struct<{structure}>")
        assert isinstance(parsed, T.StructType)
        structure = parsed
    parent, name = P.parent_of(path)
    new = F.array().cast(T.ArrayType(structure)) if many else F.lit(None).cast(structure)

    def edit(fs: P.Fields, _: T.StructType) -> P.Fields:
        if name in fs:
            raise KeyError(f"{path!r} exists already")
        fs[name] = new
        return fs

    return P.edit_object(df, parent, edit)


def delete_embedded(df: DataFrame, path: str) -> DataFrame:
    full = P.resolve(df.schema, path)
    P.struct_at(df.schema, full)
    return delete_property(df, full)
