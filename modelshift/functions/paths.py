"""Edit and read fields by dotted path, through structs and arrays of structs.

All edits of one container are expressed as one ``select``; nothing here runs a job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Fields = dict[str, Column]
Edit = Callable[[Fields, T.StructType], Fields]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    """A top-level column, whatever characters its name holds."""
    return F.col(quoted(name))


def parts_of(path: str) -> list[str]:
    return [p.removesuffix("[]") for p in path.split(".")]


def parent_of(path: str) -> tuple[str, str]:
    """Split ``a.b.c`` into ``("a.b", "c")``."""
    parts = parts_of(path)
    return ".".join(parts[:-1]), parts[-1]


def element_of(dtype: T.DataType) -> T.DataType:
    while isinstance(dtype, T.ArrayType):
        dtype = dtype.elementType
    return dtype


def struct_at(schema: T.StructType, path: str) -> T.StructType:
    """The struct found at a path, looking inside arrays; the root for an empty path."""
    dtype: T.DataType = schema
    for part in parts_of(path) if path else []:
        dtype = element_of(dtype)
        if not isinstance(dtype, T.StructType) or part not in dtype.names:
            raise KeyError(f"no field {path!r}")
        dtype = dtype[part].dataType
    dtype = element_of(dtype)
    if not isinstance(dtype, T.StructType):
        raise KeyError(f"{path!r} is not an object")
    return dtype


def type_at(schema: T.StructType, path: str) -> T.DataType:
    parent, name = parent_of(path)
    holder = struct_at(schema, parent)
    if name not in holder.names:
        raise KeyError(f"no field {path!r}")
    return holder[name].dataType


def has(schema: T.StructType, path: str) -> bool:
    try:
        type_at(schema, path)
    except KeyError:
        return False
    return True


def arrays_above(schema: T.StructType, path: str) -> list[str]:
    """The array-typed ancestors of a path, outermost first."""
    parts = parts_of(path)
    found = []
    for depth in range(1, len(parts)):
        prefix = ".".join(parts[:depth])
        if isinstance(type_at(schema, prefix), T.ArrayType):
            found.append(prefix)
    return found


def all_paths(schema: T.StructType, prefix: str = "") -> list[tuple[str, T.DataType]]:
    """Every field at every depth, parents before children."""
    out: list[tuple[str, T.DataType]] = []
    for field in schema.fields:
        path = f"{prefix}{field.name}"
        out.append((path, field.dataType))
        inner = element_of(field.dataType)
        if isinstance(inner, T.StructType):
            out.extend(all_paths(inner, path + "."))
    return out


def resolve(schema: T.StructType, name: str) -> str:
    """An exact path, else the one path that ends in ``name``; two candidates are an error."""
    if has(schema, name):
        return ".".join(parts_of(name))
    tail = parts_of(name)
    hits = [p for p, _ in all_paths(schema) if p.split(".")[-len(tail):] == tail]
    if len(hits) == 1:
        return hits[0]
    raise KeyError(f"{name!r} is ambiguous: {hits}" if hits else f"no field {name!r}")


def _flat(col: Column, inner: T.ArrayType) -> Column:
    """One array out of an array of arrays; a missing inner array counts as empty, where
    ``flatten`` alone would give null for everything."""
    return F.flatten(F.transform(col, lambda x: F.coalesce(x, F.array().cast(inner))))


def value(schema: T.StructType, path: str) -> Column:
    """The value at a path; below arrays, the flat array of all its values."""
    parts = parts_of(path)
    col, dtype = column(parts[0]), type_at(schema, parts[0])
    for part in parts[1:]:
        if isinstance(dtype, T.ArrayType):
            inner = element_of(dtype)
            assert isinstance(inner, T.StructType)
            # Reads the field out of every element; unlike a lambda, a scan can be pruned by it.
            col = col.getField(part)
            dtype = T.ArrayType(inner[part].dataType)
            while isinstance(dtype.elementType, T.ArrayType):
                col, dtype = _flat(col, dtype.elementType), dtype.elementType
        else:
            col, dtype = col.getField(part), dtype[part].dataType
    return col


def _rebuild(col: Column, struct: T.StructType, edit: Edit, nullable: bool) -> Column:
    before = {f.name: col.getField(f.name) for f in struct.fields}
    after = edit(dict(before), struct)
    dropped = [n for n in before if n not in after]
    kept = [n for n in before if n in after]
    if kept and list(after)[: len(kept)] == kept:
        # Adds, drops and replacements stay visible to Spark's struct simplifier.
        out = col.dropFields(*dropped) if dropped else col
        for name, new in after.items():
            if new is not before.get(name):
                out = out.withField(quoted(name), new)
        return out
    whole = F.struct(*[c.alias(n) for n, c in after.items()])
    return F.when(col.isNotNull(), whole) if nullable else whole


def _edit_inside(
    col: Column, dtype: T.DataType, parts: list[str], edit: Edit, nullable: bool
) -> Column:
    if isinstance(dtype, T.ArrayType):
        return F.transform(
            col,
            lambda x: _edit_inside(x, dtype.elementType, parts, edit, dtype.containsNull),
        )
    if not isinstance(dtype, T.StructType):
        raise KeyError("path leads through a value that is not an object")
    if not parts:
        return _rebuild(col, dtype, edit, nullable)
    field = dtype[parts[0]]
    inner = _edit_inside(
        col.getField(field.name), field.dataType, parts[1:], edit, field.nullable
    )
    return col.withField(quoted(field.name), inner)


def edit_object(df: DataFrame, path: str, edit: Edit) -> DataFrame:
    """Apply ``edit`` to the fields of the object at ``path`` (``""`` is the row itself)."""
    schema = df.schema
    if not path:
        fields = edit({n: column(n) for n in schema.names}, schema)
        return df.select(*[c.alias(n) for n, c in fields.items()])
    struct_at(schema, path)
    first, *rest = parts_of(path)
    field = schema[first]
    new = _edit_inside(column(first), field.dataType, rest, edit, field.nullable)
    return df.select(
        *[new.alias(n) if n == first else column(n) for n in schema.names]
    )


def project(col: Column, dtype: T.DataType, wanted: list[str]) -> Column:
    """Keep the named fields of an object or of each element of an array of objects.

    ``wanted`` holds dotted paths: ``["name", "category.label"]``.
    """
    if isinstance(dtype, T.ArrayType):
        return F.transform(col, lambda x: project(x, dtype.elementType, wanted))
    if not isinstance(dtype, T.StructType):
        raise KeyError(f"cannot pick {wanted} from a value that is not an object")
    inner = members(dtype, wanted, lambda n: col.getField(n))
    return F.when(col.isNotNull(), F.struct(*[c.alias(n) for n, c in inner.items()]))


def members(
    struct: T.StructType, wanted: list[str], read: Callable[[str], Column]
) -> Fields:
    """The columns for a list of dotted field paths, nested ones rebuilt as objects."""
    tree: dict[str, list[str]] = {}
    for path in wanted:
        head, _, tail = path.partition(".")
        if head not in struct.names:
            raise KeyError(f"no field {head!r}")
        tree.setdefault(head, [])
        if tail:
            tree[head].append(tail)
    return {
        head: project(read(head), struct[head].dataType, tails) if tails else read(head)
        for head, tails in tree.items()
    }
