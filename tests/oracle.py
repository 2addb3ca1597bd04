"""Run a registered query and its SQL on the same tables and compare the results."""

from __future__ import annotations

import math
import os

import duckdb
import pyarrow as pa

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


def _rows(table: pa.Table) -> tuple[list[str], list[tuple]]:
    names = sorted(table.column_names)
    cols = [table.column(n).to_pylist() for n in names]
    rows = [tuple(_plain(v) for v in r) for r in zip(*cols)]
    return names, sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


def _kind(t: pa.DataType) -> str:
    if pa.types.is_large_string(t) or pa.types.is_string(t) or pa.types.is_string_view(t):
        return "string"
    if pa.types.is_timestamp(t):
        return "timestamp"
    return str(t)


def compare(spark_table: pa.Table, sql_table: pa.Table) -> list[str]:
    """Differences as text; empty when the results agree."""
    a_names, a = _rows(spark_table)
    b_names, b = _rows(sql_table)
    if a_names != b_names:
        return [f"columns {a_names} != {b_names}"]
    out = []
    for n in a_names:
        ka, kb = _kind(spark_table.schema.field(n).type), _kind(sql_table.schema.field(n).type)
        if ka != kb and "null" not in (ka, kb):
            out.append(f"type of {n}: {ka} != {kb}")
    if len(a) != len(b):
        out.append(f"rows {len(a)} != {len(b)}")
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    if wrong:
        out.append(f"{len(wrong)} rows differ, first {wrong[0]}")
    return out
