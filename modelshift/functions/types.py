"""Type names and the conversion of a frame to what a target model can store."""

from __future__ import annotations

from pyspark.errors import ParseException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelshift.functions import paths as P
from modelshift.functions.keys import stable

# The type names scripts may use, and the Spark type each stands for.
# A name that is not listed means string. DECIMAL without parameters is (13,2).
NAMED_TYPES = {
    "STRING": T.StringType(),
    "TEXT": T.StringType(),
    "INT": T.IntegerType(),
    "INTEGER": T.IntegerType(),
    "INT32": T.IntegerType(),
    "LONG": T.LongType(),
    "INT64": T.LongType(),
    "DOUBLE": T.DoubleType(),
    "FLOAT": T.FloatType(),
    "DECIMAL": T.DecimalType(13, 2),
    "DECIMAL128": T.DecimalType(13, 2),
    "BOOLEAN": T.BooleanType(),
    "DATE": T.DateType(),
    "TIMESTAMP": T.TimestampNTZType(),
    "DATETIME": T.TimestampNTZType(),
    "UUID": T.StringType(),
    "OBJECT_ID": T.StringType(),
    "BINARY": T.BinaryType(),
    "NULL": T.StringType(),
}

MODELS = ("relational", "document", "graph", "wide_column")


def spark_type(dtype: str | T.DataType) -> T.DataType:
    """A Spark type from a type, a script name (``Integer``) or Spark DDL (``array<int>``).

    A name that is neither stands for string.
    """
    if isinstance(dtype, T.DataType):
        return dtype
    named = NAMED_TYPES.get(dtype.upper())
    if named is not None:
        return named
    try:
        return T._parse_datatype_string(dtype)
    except ParseException:
        return T.StringType()


def conformed(col: Column, dtype: T.DataType, model: str) -> Column:
    """One value in the form the model stores.

    graph: decimals become doubles, binary becomes text, objects and lists of objects become
    JSON text. document: floats become doubles. relational: lists, maps and objects become
    JSON text. wide_column keeps lists and maps; objects become JSON text.
    """
    if model not in MODELS:
        raise ValueError(f"unknown model {model!r}")
    if isinstance(dtype, T.NullType):
        return col.cast("string")
    if model == "document":
        return _document(col, dtype)
    holds_object = isinstance(P.element_of(dtype), T.StructType)
    if model == "relational" and isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(stable(col, dtype), {"ignoreNullFields": "false"})
    if holds_object or (model == "graph" and isinstance(dtype, T.MapType)):
        return F.to_json(stable(col, dtype), {"ignoreNullFields": "false"})
    if model == "graph" and isinstance(dtype, T.DecimalType):
        return col.cast("double")
    if model == "graph" and isinstance(dtype, T.BinaryType):
        return F.base64(col)
    return col


def _document(col: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.FloatType):
        return col.cast("double")
    if isinstance(dtype, T.ArrayType) and _holds_float(dtype):
        return F.transform(col, lambda x: _document(x, dtype.elementType))
    if isinstance(dtype, T.StructType) and _holds_float(dtype):
        whole = F.struct(
            *[_document(col.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields]
        )
        return F.when(col.isNotNull(), whole)
    return col


def _holds_float(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StructType):
        return any(_holds_float(f.dataType) for f in dtype.fields)
    dtype = P.element_of(dtype)
    return isinstance(dtype, T.FloatType) or (
        isinstance(dtype, T.StructType) and _holds_float(dtype)
    )


def conform(df: DataFrame, model: str) -> DataFrame:
    """The frame with every column in the form the target model stores."""
    return df.select(
        *[conformed(P.column(f.name), f.dataType, model).alias(f.name) for f in df.schema.fields]
    )


def conform_losses(df: DataFrame, model: str, casts: dict[str, str] | None = None) -> DataFrame:
    """Per column whose type changes: old and new type, and rows that do not survive.

    ``casts`` adds explicit target types. A row is lost when casting back does not give
    the old value again. One scan.
    """
    new = conform(df, model)
    casts = casts or {}
    aggs, heads = [], []
    for f in df.schema.fields:
        old = P.column(f.name)
        target = new.schema[f.name].dataType
        got = conformed(old, f.dataType, model)
        if f.name in casts:
            target = spark_type(casts[f.name])
            got = old.try_cast(target)
        if target == f.dataType:
            continue
        if isinstance(f.dataType, T.BinaryType):
            back = F.unbase64(got)
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            if isinstance(target, T.StringType):
                plain = stable(old, f.dataType)
                kind = df.select(plain.alias("x")).schema["x"].dataType
                back, old = F.from_json(got, kind), plain
            else:
                back = got.cast(f.dataType)
        else:
            back = got.try_cast(f.dataType)
        i = len(aggs)
        aggs.append(F.count_if(old.isNotNull() & ~back.eqNullSafe(old)).alias(f"l{i}"))
        heads.append((f.name, f.dataType.simpleString(), target.simpleString(), f"l{i}"))
    if not heads:
        return df.sparkSession.createDataFrame(
            [], "column_name string, old_type string, new_type string, lost bigint"
        )
    rows = F.array(
        *[
            F.struct(
                F.lit(n).alias("column_name"),
                F.lit(a).alias("old_type"),
                F.lit(b).alias("new_type"),
                F.col(c).alias("lost"),
            )
            for n, a, b, c in heads
        ]
    )
    return df.agg(*aggs).select(F.inline(rows))
