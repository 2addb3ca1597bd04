"""NEST, UNNEST, FLATTEN, UNFLATTEN, WIND, UNWIND, MERGE and SPLIT on frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelshift.functions import paths as P
from modelshift.functions.keys import natural_key, stable
from modelshift.operators.grouping import (
    DuplicateKey,
    attach,
    gather,
    require_unique,
)


# --- NEST ---------------------------------------------------------------------------

def _embedded(source: DataFrame, fields: list[str] | None, leave_out: set[str]) -> Column:
    wanted = fields or [n for n in source.columns if n not in leave_out]
    return F.struct(
        *[c.alias(n) for n, c in P.members(source.schema, wanted, P.column).items()]
    )


def nest_one(
    target: DataFrame,
    source: DataFrame,
    on: dict[str, str],
    alias: str,
    fields: list[str] | None = None,
    *,
    drop_keys: bool = True,
    check: bool = True,
) -> DataFrame:
    """Embed the one matching source row as an object; no match gives a null object.

    ``on`` maps target paths to source columns. ``alias`` and the target paths may lie
    inside objects (``employee.company``). The source key must be unique; ``check=False``
    skips that look at the source's key columns.
    """
    if check:
        require_unique(source, list(on.values()), f"nest into {alias}")
    keys = {k: f"_key{i}" for i, k in enumerate(on.values())}
    lookup = source.select(
        *[P.column(k).alias(v) for k, v in keys.items()],
        _embedded(source, fields, set()).alias("_object"),
    )
    cond = F.lit(True)
    for path, key in on.items():
        cond = cond & (P.value(target.schema, path) == F.col(keys[key]))
    joined = target.join(lookup, cond, "left")
    parent, name = P.parent_of(alias)
    gone = {P.parent_of(p)[1] for p in on if P.parent_of(p)[0] == parent} if drop_keys else set()
    gone.discard(name)

    def put(fs: P.Fields, _: T.StructType) -> P.Fields:
        kept = {n: c for n, c in fs.items() if n not in gone and n != name}
        kept[name] = F.col("_object")
        return kept

    out = P.edit_object(joined, parent, put).drop("_object", *keys.values())
    if drop_keys:
        for path in on:
            if P.parent_of(path)[0] != parent:
                out = _drop(out, path)
    return out


def nest_many(
    target: DataFrame,
    source: DataFrame,
    on: dict[str, str],
    alias: str,
    fields: list[str] | None = None,
    *,
    part_column: str | None = None,
    elements_per_part: int | None = None,
    counted_on: DataFrame | None = None,
    dealt: bool = False,
) -> DataFrame:
    """Embed all matching source rows as a sorted array; no match gives an empty array.

    ``on`` maps target columns to source columns. See :func:`gather` for arrays in parts and
    for ``counted_on`` and ``dealt``.
    """
    keys = list(on.values())
    has_key = " and ".join(f"{P.quoted(k)} is not null" for k in keys)
    element = _embedded(source, fields, set(keys))
    got = gather(
        source.where(has_key), keys, element, "_nested", part_column=part_column,
        elements_per_part=elements_per_part,
        counted_on=None if counted_on is None else counted_on.where(has_key),
        dealt=dealt,
    )
    out = attach(target, got, on, "_nested", part_column)
    keep = [n for n in target.columns if n != alias]
    extra = [part_column] if part_column else []
    return out.select(
        *[P.column(n) for n in keep + extra], F.col("_nested").alias(alias)
    )


def nest_in_array(
    target: DataFrame,
    source: DataFrame,
    array: str,
    on: dict[str, str],
    alias: str,
    fields: list[str] | None = None,
    *,
    key: list[str],
    drop_keys: bool = True,
) -> DataFrame:
    """Embed a source row into every element of a top-level array of objects.

    ``on`` maps element fields to source columns, ``key`` identifies a target row. The
    elements leave the row with their position, meet the source and come back in order.
    """
    require_unique(source, list(on.values()), f"nest into {array}.{alias}")
    require_unique(target, key, f"nest into {array}.{alias}")
    items = target.select(
        *[P.column(k) for k in key], F.posexplode(P.column(array)).alias("_pos", "_item")
    )
    inner = {f"_item.{f}": k for f, k in on.items()}
    linked = nest_one(
        items, source, inner, f"_item.{alias}", fields, drop_keys=drop_keys, check=False
    )
    # Arrays of existing rows are as large as they already were, so no size count is needed.
    ordered = linked.groupBy(*[P.column(k) for k in key]).agg(
        F.sort_array(F.collect_list(F.struct("_pos", "_item"))).alias("_items")
    )
    renamed = ordered.select(
        *[P.column(k).alias(f"_key{i}") for i, k in enumerate(key)],
        F.transform("_items", lambda x: x.getField("_item")).alias("_items"),
    )
    cond = F.lit(True)
    for i, k in enumerate(key):
        cond = cond & (P.column(k) == F.col(f"_key{i}"))
    empty = F.array().cast(renamed.schema["_items"].dataType)
    new = F.when(
        P.column(array).isNotNull(), F.coalesce("_items", empty)
    )
    return target.join(renamed, cond, "left").select(
        *[new.alias(n) if n == array else P.column(n) for n in target.columns]
    )


# --- UNNEST -------------------------------------------------------------------------

def unnest(
    df: DataFrame,
    path: str,
    fields: list[str] | None = None,
    carry: dict[str, str] | None = None,
    *,
    key: str | None = None,
    key_from: list[str] | None = None,
    link: str | None = None,
    distinct: bool = False,
    part_column: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Move an embedded object or array of objects to an entity of its own.

    Returns the new entity and the parent without it. ``carry`` maps parent paths (also
    inside arrays on the way) to column names of the new entity. Listed fields that do not
    exist become null strings. ``key`` adds a surrogate key over ``key_from`` (paths inside
    the object, by default all picked fields), ``link`` leaves the same key behind in the
    parent, and ``distinct`` keeps one row per content. ``part_column`` is the column that
    numbers the parts of a spread-out document: an object outside arrays is then taken from
    part 0 only.
    """
    carry = carry or {}
    cur, read = _explode_along(df, path, list(carry))
    struct = P.struct_at(df.schema, path)
    here, _ = read(path)
    wanted = fields or struct.names
    known = [f for f in wanted if P.has(struct, f)]

    def pick(obj: Column) -> P.Fields:
        picked = P.members(struct, known, lambda n: obj.getField(n))
        heads = dict.fromkeys(f.split(".")[0] for f in wanted)
        return {h: picked.get(h, F.lit(None).cast("string")) for h in heads}

    def surrogate(obj: Column) -> Column:
        return _object_key(obj, struct, key_from or known)

    present = cur.where(here.isNotNull())
    in_array = bool(P.arrays_above(df.schema, path)) or isinstance(
        P.type_at(df.schema, path), T.ArrayType
    )
    if part_column and not in_array:
        present = present.where(P.column(part_column) == 0)
    values = [*[_read_value(read, df, p).alias(n) for p, n in carry.items()],
              *[c.alias(n) for n, c in pick(here).items()]]
    if key and distinct and _told_by(struct, key_from or known, known):
        # Rows travel without their key, which follows from the values. Grouping takes -0.0 for 0.0, a key does not.
        signed = F.when(_negative_zero(here, struct, key_from or known), surrogate(here))
        once = present.select(signed.alias("_signed"), *values).distinct()
        obj = F.struct(*[F.col(f"`{n}`") for n in pick(here)])
        out = once.select(F.coalesce("_signed", surrogate(obj)).alias(key),
                          *[F.col(f"`{n}`") for n in once.columns if n != "_signed"])
    else:
        out = present.select(*([surrogate(here).alias(key)] if key else []), *values)
        out = out.distinct() if distinct else out
    if not link:
        return out, _drop(df, path)
    return out, link_object(df, path, link, key_from or known)


def link_object(
    df: DataFrame, path: str, link: str, key_from: list[str] | None = None
) -> DataFrame:
    """Replace an embedded object by its surrogate key, as :func:`unnest` gives it."""
    if isinstance(P.type_at(df.schema, path), T.ArrayType):
        raise KeyError(f"{path!r} is an array; its parent cannot hold one link")
    struct = P.struct_at(df.schema, path)
    parent, name = P.parent_of(path)

    def leave(fs: P.Fields, _: T.StructType) -> P.Fields:
        obj = fs.pop(name)
        fs[link] = F.when(obj.isNotNull(), _object_key(obj, struct, key_from or struct.names))
        return fs

    return P.edit_object(df, parent, leave)


def _object_key(obj: Column, struct: T.StructType, key_from: list[str]) -> Column:
    cols = []
    for f in key_from:
        cols.append(_text(_through(obj, f), P.type_at(struct, f)))
    return natural_key(*cols)


def _told_by(struct: T.StructType, key_from: list[str], known: list[str]) -> bool:
    """Whether the picked fields hold all single values that a key is made from."""
    return all(
        any(f == k or f.startswith(f"{k}.") for k in known)
        and not isinstance(P.type_at(struct, f), (T.StructType, T.ArrayType, T.MapType)) for f in key_from)


def _negative_zero(obj: Column, struct: T.StructType, key_from: list[str]) -> Column:
    found = F.lit(False)
    for f in key_from:
        if isinstance(P.type_at(struct, f), (T.FloatType, T.DoubleType)):
            value = _through(obj, f)
            found = found | F.when(value == 0, value.cast("string") == "-0.0").otherwise(F.lit(False))
    return found


def _text(col: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(stable(col, dtype), {"ignoreNullFields": "false"})
    return col


def _explode_along(df: DataFrame, path: str, also: list[str]):
    """Explode every array on the way to ``path``; returns the frame and a path reader.

    Of the arrays passed on the way only what ``path`` and ``also`` need is exploded, zipped
    together, so that a scan reads those nested columns and no others.
    """
    cur, spots = df, {}
    parts = P.parts_of(path)
    targets = [path, *[P.resolve(df.schema, p) for p in also]]

    def read(p: str) -> tuple[Column, T.DataType]:
        for spot in sorted(spots, key=len, reverse=True):
            if p == spot:
                return spots[spot]
            if p.startswith(spot + "."):
                col, dtype = spots[spot]
                for name in P.parts_of(p[len(spot) + 1 :]):
                    col, dtype = col.getField(name), dtype[name].dataType
                return col, dtype
        return P.value(df.schema, p), P.type_at(df.schema, p)

    for depth in range(1, len(parts) + 1):
        prefix = ".".join(parts[:depth])
        col, dtype = read(prefix)
        while isinstance(dtype, T.ArrayType):
            name = f"_at{len(spots)}_{depth}"
            heads = _heads(dtype.elementType, prefix, targets)
            if heads:
                cur = cur.select("*", F.explode(F.arrays_zip(
                    *[_through(col, head[len(prefix) + 1 :]) for head in heads])).alias(name))
                for head, field in zip(heads, cur.schema[name].dataType.names):
                    spots[head] = (F.col(name).getField(field), P.type_at(df.schema, head))
                break
            cur = cur.select("*", F.explode(col).alias(name))
            col, dtype = F.col(name), dtype.elementType
            spots[prefix] = (col, dtype)
    return cur, read


def _heads(element: T.DataType, array: str, targets: list[str]) -> list[str]:
    """The paths just below an array that the targets need, each up to the next array.

    Empty when an element is needed whole or the names would clash.
    """
    if not isinstance(element, T.StructType) or array in targets:
        return []
    heads: list[str] = []
    for target in targets:
        if not target.startswith(array + "."):
            continue
        dtype: T.DataType = element
        head = array
        for name in P.parts_of(target[len(array) + 1 :]):
            head, dtype = f"{head}.{name}", dtype[name].dataType
            if isinstance(dtype, T.ArrayType):
                break
        heads.append(head)
    heads = [h for h in dict.fromkeys(heads) if not any(h.startswith(o + ".") for o in heads)]
    names = [h.split(".")[-1] for h in heads]
    return heads if len(set(names)) == len(names) else []


def _through(col: Column, path: str) -> Column:
    for name in P.parts_of(path):
        col = col.getField(name)
    return col


def _read_value(read, df: DataFrame, path: str) -> Column:
    return read(P.resolve(df.schema, path))[0]


def _drop(df: DataFrame, path: str) -> DataFrame:
    parent, name = P.parent_of(path)

    def edit(fs: P.Fields, _: T.StructType) -> P.Fields:
        fs.pop(name)
        return fs

    return P.edit_object(df, parent, edit)


# --- FLATTEN / UNFLATTEN ------------------------------------------------------------

def flatten(df: DataFrame, path: str) -> DataFrame:
    """Lift an object's fields into its parent as ``<object>_<field>``.

    Inside arrays this happens per element. Objects within the object are lifted whole; a
    parent field that already has the name is kept.
    """
    if isinstance(P.type_at(df.schema, path), T.ArrayType):
        raise KeyError(f"{path!r} is an array; unnest or unwind it first")
    struct = P.struct_at(df.schema, path)
    parent, name = P.parent_of(path)

    def edit(fs: P.Fields, _: T.StructType) -> P.Fields:
        inner = fs.pop(name)
        for field in struct.names:
            fs.setdefault(f"{name}_{field}", inner.getField(field))
        return fs

    return P.edit_object(df, parent, edit)


def unflatten(
    df: DataFrame,
    fields: list[str] | dict[str, str],
    name: str,
    *,
    parent: str = "",
    null_if_empty: bool = False,
) -> DataFrame:
    """Move flat fields into an object; absent names are passed over.

    ``fields`` may map existing names to the names they get inside the object.
    """
    wanted = fields if isinstance(fields, dict) else {f: f for f in fields}

    def edit(fs: P.Fields, _: T.StructType) -> P.Fields:
        moved = {new: fs.pop(old) for old, new in wanted.items() if old in fs}
        if not moved:
            raise KeyError(f"none of {list(wanted)} exists")
        whole = F.struct(*[c.alias(n) for n, c in moved.items()])
        if null_if_empty:
            whole = F.when(_any_present(list(moved.values())), whole)
        fs[name] = whole
        return fs

    return P.edit_object(df, parent, edit)


def _any_present(cols: list[Column]) -> Column:
    out = cols[0].isNotNull()
    for c in cols[1:]:
        out = out | c.isNotNull()
    return out


# --- WIND / UNWIND ------------------------------------------------------------------

def unwind(df: DataFrame, path: str, *, keep_empty: bool = False) -> DataFrame:
    """Replace a list by its elements, one row each; a value that is no list is left alone."""
    dtype = P.type_at(df.schema, path)
    if not isinstance(dtype, T.ArrayType):
        return df
    if P.arrays_above(df.schema, path):
        raise KeyError(f"{path!r} lies inside an array; unnest that first")
    explode = F.explode_outer if keep_empty else F.explode
    parent, name = P.parent_of(path)
    opened = df.select("*", explode(P.value(df.schema, path)).alias("_element"))

    def edit(fs: P.Fields, _: T.StructType) -> P.Fields:
        fs[name] = F.col("_element")
        return fs

    return P.edit_object(opened, parent, edit).drop("_element")


def unwind_into(
    df: DataFrame,
    path: str,
    carry: dict[str, str] | None = None,
    *,
    position: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Move a list to an entity with one ``value`` per row; also returns the parent without it."""
    carry = carry or {}
    items = df.select(
        *[P.value(df.schema, p).alias(n) for p, n in carry.items()],
        F.posexplode(P.value(df.schema, path)).alias("_position", "value"),
    )
    out = items.withColumnRenamed("_position", position) if position else items.drop("_position")
    return out, _drop(df, path)


def wind(df: DataFrame, path: str) -> DataFrame:
    """Wrap a value as a list of one; a list stays as it is, null becomes an empty list."""
    dtype = P.type_at(df.schema, path)
    if isinstance(dtype, T.ArrayType):
        return df
    parent, name = P.parent_of(path)

    def edit(fs: P.Fields, _: T.StructType) -> P.Fields:
        old = fs[name]
        empty = F.array().cast(T.ArrayType(dtype))
        fs[name] = F.when(old.isNull(), empty).otherwise(F.array(old))
        return fs

    return P.edit_object(df, parent, edit)


def wind_group(
    df: DataFrame,
    col: str,
    *,
    part_column: str | None = None,
    elements_per_part: int | None = None,
) -> DataFrame:
    """Collect a column into a sorted list per value of all other columns."""
    rest = [n for n in df.columns if n != col]
    got = gather(
        df, rest, P.column(col), col, part_column=part_column,
        elements_per_part=elements_per_part,
    )
    extra = [part_column] if part_column else []
    return got.rows.select(*[P.column(n) for n in rest + extra + [col]])


# --- MERGE / SPLIT ------------------------------------------------------------------

def merge_join(
    first: DataFrame, second: DataFrame, on: list[str], *, one: str | None = None
) -> DataFrame:
    """One entity out of two that share key columns; no row of either is lost.

    Values of ``first`` win and ``second`` fills the gaps. One side may hold a key many
    times (its rows all survive), but not both. The rows of that side are joined with a
    left join, whose skewed keys Spark can split, and the other side's unmatched rows are
    added, rather than a full outer join, which cannot be split. ``one`` ("first" or
    "second") names a side known to have unique keys and saves the look at them.
    """
    if one is None:
        try:
            require_unique(first, on, "merge")
            one = "first"
        except DuplicateKey:
            require_unique(second, on, "merge")
            one = "second"
    one, many = (first, second) if one == "first" else (second, first)
    names = first.columns + [n for n in second.columns if n not in first.columns]
    many_wins = many is first
    other = one.select(*[P.column(n).alias(f"_o_{n}") for n in one.columns])
    cond = F.lit(True)
    for k in on:
        cond = cond & (P.column(k) == P.column(f"_o_{k}"))
    joined = many.join(other, cond, "left")

    def pick(n: str) -> Column:
        mine = P.column(n) if n in many.columns else None
        theirs = P.column(f"_o_{n}") if n in one.columns else None
        if n in on or theirs is None:
            return mine
        if mine is None:
            return theirs
        return F.coalesce(mine, theirs) if many_wins else F.coalesce(theirs, mine)

    matched = joined.select(*[pick(n).alias(n) for n in names])
    seen = many.select(*[P.column(k).alias(f"_s_{k}") for k in on]).distinct()
    miss = F.lit(True)
    for k in on:
        miss = miss & (P.column(k) == P.column(f"_s_{k}"))
    alone = one.join(seen, miss, "left_anti")
    return matched.unionByName(alone, allowMissingColumns=True).select(
        *[P.column(n) for n in names]
    )


def merge_union(first: DataFrame, second: DataFrame) -> DataFrame:
    """The rows of both, with the columns of both; absent columns are null."""
    return first.unionByName(second, allowMissingColumns=True)


def split(
    df: DataFrame, parts: dict[str, list[str]], distinct: set[str] | None = None
) -> dict[str, DataFrame]:
    """Vertical parts of a frame; those named in ``distinct`` keep one row per content."""
    out = {}
    for name, fields in parts.items():
        known = [f for f in fields if f in df.columns]
        if not known:
            raise KeyError(f"part {name!r} has no known field")
        piece = df.select(*[P.column(f) for f in known])
        out[name] = piece.distinct() if distinct and name in distinct else piece
    return out
