"""Surrogate keys and row texts that stay the same on every run and every engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelshift.functions.paths import column


def natural_key(*cols: Column) -> Column:
    """md5 over the natural columns.

    Each value is written with its length in front and nulls have their own mark, so two
    different rows never share the text that is hashed.
    """
    coded = []
    for c in cols:
        text = c.cast("string")
        size = F.length(text).cast("string")
        coded.append(F.coalesce(F.concat(size, F.lit(":"), text), F.lit("N")))
    return F.md5(F.concat_ws("|", *coded))


def stable(col: Column, dtype: T.DataType) -> Column:
    """The value in a form that groups, sorts and hashes: maps become sorted entries."""
    if isinstance(dtype, T.MapType):
        entries = F.map_entries(col)
        inner = T.StructType(
            [T.StructField("key", dtype.keyType), T.StructField("value", dtype.valueType)]
        )
        return F.array_sort(F.transform(entries, lambda e: stable(e, inner)))
    if isinstance(dtype, T.ArrayType) and holds_map(dtype):
        return F.transform(col, lambda x: stable(x, dtype.elementType))
    if isinstance(dtype, T.StructType) and holds_map(dtype):
        whole = F.struct(
            *[stable(col.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields]
        )
        return F.when(col.isNotNull(), whole)
    return col


def holds_map(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.MapType):
        return True
    if isinstance(dtype, T.ArrayType):
        return holds_map(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return any(holds_map(f.dataType) for f in dtype.fields)
    return False


def wide(dtype: T.DataType) -> T.DataType:
    """The type a value is compared in: whole numbers as bigint, other numbers as double.

    Decimals of more than 15 digits stay as they are, since a double cannot hold them.
    """
    if isinstance(dtype, T.IntegralType):
        return T.LongType()
    if isinstance(dtype, T.FractionalType):
        exact = isinstance(dtype, T.DecimalType) and dtype.precision > 15
        return dtype if exact else T.DoubleType()
    if isinstance(dtype, (T.CharType, T.VarcharType)):
        return T.StringType()
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(wide(dtype.elementType))
    if isinstance(dtype, T.MapType):
        return T.MapType(wide(dtype.keyType), wide(dtype.valueType))
    if isinstance(dtype, T.StructType):
        return T.StructType([T.StructField(f.name, wide(f.dataType)) for f in dtype.fields])
    return dtype


def _as_decimal(dtype: T.DataType) -> T.DecimalType:
    return dtype if isinstance(dtype, T.DecimalType) else T.DecimalType(19, 0)


def comparable(col: Column, dtype: T.DataType, other: T.DataType | None = None) -> Column:
    """The value in its wide type, or in one it shares with a column of type ``other``.

    Whole numbers and decimals meet in a decimal that holds both, or as plain text where none
    does; a float or double meets other numbers as a double, everything else of different types
    meets as text.
    """
    mine = wide(dtype)
    if other is not None and wide(other) != mine:
        if not (isinstance(dtype, T.NumericType) and isinstance(other, T.NumericType)):
            return col.cast("string")
        if any(isinstance(t, (T.FloatType, T.DoubleType)) for t in (dtype, other)):
            return col.cast("double")
        one, two = _as_decimal(dtype), _as_decimal(other)
        scale = max(one.scale, two.scale)
        precision = max(one.precision - one.scale, two.precision - two.scale) + scale
        if precision <= 38:
            return col.cast(T.DecimalType(precision, scale))
        text = col.cast(one).cast("string")
        return F.when(F.instr(text, ".") > 0, F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)
    return stable(col if mine == dtype else col.cast(mine), mine)


#: Null flags per bigint mask.
MASK_BITS = 62


def row_hash(df: DataFrame, other: T.StructType | None = None) -> Column:
    """xxhash64 over all columns in name order, so column order does not matter.

    Numbers are hashed in their wide type, so that an int and a bigint of one value agree.
    ``other`` is the schema of the rows that these will be compared with.

    A null mask goes in as well: xxhash64 alone passes over nulls, which would let a value
    move to a neighbouring null column unseen.
    """
    fields = sorted(df.schema.fields, key=lambda f: f.name)
    masks = []
    for start in range(0, len(fields), MASK_BITS):
        mask = F.lit(0).cast("bigint")
        for i, f in enumerate(fields[start : start + MASK_BITS]):
            bit = F.when(column(f.name).isNull(), F.lit(1 << i)).otherwise(F.lit(0))
            mask = mask.bitwiseOR(bit.cast("bigint"))
        masks.append(mask)
    theirs = {f.name: f.dataType for f in other.fields} if other else {}
    return F.xxhash64(
        *masks, *[comparable(column(f.name), f.dataType, theirs.get(f.name)) for f in fields])
