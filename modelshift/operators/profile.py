"""Measure what a dataset looks like: nulls, nesting, sizes. Keys and references: ``discovery``."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelshift.functions import paths as P
from modelshift.operators.rules import Contract, Reference


def nullability(df: DataFrame, entity: str) -> DataFrame:
    """Per path, at every depth: values seen and how many are null. One scan.

    A member of an absent object counts as null; below arrays each element counts.
    """
    paths = P.all_paths(df.schema)
    aggs = []
    for i, (path, _) in enumerate(paths):
        col = P.value(df.schema, path)
        if P.arrays_above(df.schema, path):
            seen = F.greatest(F.size(col), F.lit(0))
            nulls = F.greatest(F.size(F.filter(col, lambda x: x.isNull())), F.lit(0))
            aggs += [F.sum(seen).alias(f"s{i}"), F.sum(nulls).alias(f"n{i}")]
        else:
            aggs += [F.count("*").alias(f"s{i}"), F.count_if(col.isNull()).alias(f"n{i}")]
    rows = F.array(
        *[
            F.struct(
                F.lit(entity).alias("entity"),
                F.lit(path).alias("path"),
                F.coalesce(f"s{i}", F.lit(0)).cast("bigint").alias("n_values"),
                F.coalesce(f"n{i}", F.lit(0)).cast("bigint").alias("nulls"),
            )
            for i, (path, _) in enumerate(paths)
        ]
    )
    return df.agg(*aggs).select(F.inline(rows)).withColumn("optional", F.col("nulls") > 0)


def nested_paths(df: DataFrame, entity: str, key: list[str] | None = None) -> DataFrame:
    """Per array path: how many arrays, their fewest, most and total elements; per object
    path: how often it is present. One scan.

    ``key`` names the columns of a document that may lie in several parts; its arrays are
    then measured together.
    """
    heads, sizes = [], []
    for path, dtype in P.all_paths(df.schema):
        if not isinstance(dtype, (T.ArrayType, T.StructType)):
            continue
        col = P.value(df.schema, path)
        above = P.arrays_above(df.schema, path)
        is_array = isinstance(dtype, T.ArrayType)
        if is_array and not above:
            size = F.when(col.isNotNull(), F.size(col))
        elif above:
            size = F.greatest(F.size(F.filter(col, lambda x: x.isNotNull())), F.lit(0))
        else:
            size = col.isNotNull().cast("int")
        sizes.append(size.cast("bigint").alias(f"s{len(heads)}"))
        heads.append((path, "array" if is_array else "object", is_array and not above))
    schema = "entity string, path string, kind string, n bigint, fewest bigint, most bigint, total bigint"
    if not heads:
        return df.sparkSession.createDataFrame([], schema)
    measured = df.select(*[P.column(k) for k in key or []], *sizes)
    if key:
        measured = measured.groupBy(*[P.column(k) for k in key]).agg(
            *[F.sum(f"s{i}").alias(f"s{i}") for i in range(len(heads))]
        )
    aggs = []
    for i, (_, _, counted) in enumerate(heads):
        s = F.col(f"s{i}")
        aggs += [(F.count(s) if counted else F.sum(s)).alias(f"n{i}"), F.min(s).alias(f"l{i}"),
                 F.max(s).alias(f"h{i}"), F.sum(s).alias(f"t{i}")]
    rows = F.array(
        *[
            F.struct(
                F.lit(entity).alias("entity"),
                F.lit(path).alias("path"),
                F.lit(kind).alias("kind"),
                F.coalesce(f"n{i}", F.lit(0).cast("bigint")).alias("n"),
                F.col(f"l{i}").alias("fewest"),
                F.col(f"h{i}").alias("most"),
                F.coalesce(f"t{i}", F.lit(0).cast("bigint")).alias("total"),
            )
            for i, (path, kind, _) in enumerate(heads)
        ]
    )
    return measured.agg(*aggs).select(F.inline(rows))


def entity_summary(frames: Mapping[str, DataFrame], contract: Contract) -> DataFrame:
    """Per entity: rows, columns, key columns, references, nested paths. Only rows are counted."""
    out: DataFrame | None = None
    for name, df in frames.items():
        nested = [p for p, _ in P.all_paths(df.schema) if "." in p]
        one = df.agg(F.count("*").alias("n_rows")).select(
            F.lit(name).alias("entity"),
            "n_rows",
            F.lit(len(df.columns)).alias("n_columns"),
            F.lit(",".join(contract.key_columns(name))).alias("key"),
            F.lit(len(contract.of(name, Reference))).alias("n_references"),
            F.lit(len(nested)).alias("n_nested"),
        )
        out = one if out is None else out.unionByName(one)
    assert out is not None
    return out


__all__ = ["entity_summary", "nested_paths", "nullability"]
