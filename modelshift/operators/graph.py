"""Vertices, edges and labels.

A vertex frame has ``id``, ``_labels`` and properties; an edge frame has ``src``, ``dst``
and properties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelshift.functions import paths as P
from modelshift.functions.keys import natural_key
from modelshift.operators.grouping import require_unique


def _one(cols: list[str]) -> Column:
    """A single key column as it is, several as one text key."""
    return P.column(cols[0]) if len(cols) == 1 else natural_key(*[P.column(c) for c in cols])


def to_vertices(df: DataFrame, key: list[str], label: str) -> DataFrame:
    """Rows as vertices: ``id`` from the key, one label, all columns as properties."""
    return df.select(
        _one(key).alias("id"), F.array(F.lit(label)).alias("_labels"), *[P.column(c) for c in df.columns]
    )


def from_vertices(df: DataFrame) -> DataFrame:
    return df.drop("id", "_labels")


def edges_from_reference(
    child: DataFrame, child_key: list[str], reference: list[str], *, from_parent: bool = False
) -> DataFrame:
    """One edge per row whose reference is set, child to parent or, on request, the reverse."""
    present = child.where(" and ".join(f"{P.quoted(c)} is not null" for c in reference))
    mine, other = _one(child_key), _one(reference)
    src, dst = (other, mine) if from_parent else (mine, other)
    return present.select(src.alias("src"), dst.alias("dst"))


def edges_to_reference(
    vertices: DataFrame,
    edges: DataFrame,
    name: str,
    *,
    from_parent: bool = False,
    check: bool = True,
) -> DataFrame:
    """The reverse: the one edge at each vertex becomes its reference column ``name``."""
    mine, other = ("dst", "src") if from_parent else ("src", "dst")
    if check:
        require_unique(edges, [mine], f"edges into {name}")
    ends = edges.select(P.column(mine).alias("_mine"), P.column(other).alias("_other"))
    joined = vertices.join(ends, vertices["id"] == F.col("_mine"), "left")
    return joined.select(
        *[P.column(n) for n in vertices.columns], F.col("_other").alias(name)
    )


def to_edges(
    df: DataFrame, src: list[str], dst: list[str], drop: list[str] | None = None
) -> DataFrame:
    """TRANSFORM INTO RELATIONSHIP: rows become edges, the other columns their properties."""
    gone = set(src) | set(dst) | set(drop or [])
    both = " and ".join(f"{P.quoted(c)} is not null" for c in [*src, *dst])
    return df.where(both).select(
        _one(src).alias("src"),
        _one(dst).alias("dst"),
        *[P.column(c) for c in df.columns if c not in gone],
    )


def without_ends(df: DataFrame, src: list[str], dst: list[str]) -> DataFrame:
    """The rows that make no edge, because a column of one of their ends is null."""
    return df.where(" or ".join(f"{P.quoted(c)} is null" for c in [*src, *dst]))


def to_entity(edges: DataFrame, key: str = "id", natural: list[str] | None = None) -> DataFrame:
    """TRANSFORM INTO ENTITY: edges become rows with a surrogate key and both ends kept."""
    cols = natural or edges.columns
    return edges.select(
        natural_key(*[P.column(c) for c in cols]).alias(key), *[P.column(c) for c in edges.columns]
    )


def add_label(df: DataFrame, label: str, where: Column | None = None) -> DataFrame:
    """Add a label, once, to all vertices or those that satisfy ``where``."""
    new = F.array_union("_labels", F.array(F.lit(label)))
    return df.withColumn("_labels", _if(where, new))


def delete_label(df: DataFrame, label: str, where: Column | None = None) -> DataFrame:
    return df.withColumn("_labels", _if(where, F.array_remove("_labels", label)))


def _if(where: Column | None, new: Column) -> Column:
    return new if where is None else F.when(where, new).otherwise(F.col("_labels"))


def rename_label(df: DataFrame, old: str, new: str) -> DataFrame:
    """The label of a renamed entity follows it."""
    return df.withColumn(
        "_labels",
        F.array_distinct(
            F.transform("_labels", lambda x: F.when(x == old, F.lit(new)).otherwise(x))
        ),
    )


def without_dangling(
    edges: DataFrame, vertices: DataFrame, end: str, key: list[str] | None = None
) -> DataFrame:
    """Edges whose ``end`` is among the vertices, known by ``id`` or by their key columns."""
    ids = vertices.select(_one(key or ["id"]).alias("_id"))
    return edges.join(ids, edges[end] == F.col("_id"), "left_semi")


def is_edge(schema: T.StructType) -> bool:
    return "src" in schema.names and "dst" in schema.names
