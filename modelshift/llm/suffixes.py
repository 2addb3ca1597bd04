"""Repeated passages from a sparse suffix array: suffixes at minimisers, neighbours, windows.

Suffixes are retained where a passage's content says so, so both copies of a passage retain the
same ones. They are sorted by a hash of their first words over the whole cluster, and compared
with their neighbours. Matches are not extended left and right: they fill a table of fixed size
that preselects suffixes, and the 64-bit hashes of all windows around these are grouped instead.
Equal hashes count as equal windows; as the table fills up, more windows are stored, none is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Columns, discard, map_columns, stored
from .decontamination import merged, words_of

MIN_WORDS = 50  # words of a passage
PREFIX = 20  # first words of a suffix that are sorted by
SLOT_BITS = 26  # a bit table of 8 MB preselects the suffixes that may match

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _rolled(values: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` values in a row, doubled up from pairs."""
    out, done, offset = None, 0, 0
    power, block, factor = 1, values, _ODD
    while True:
        if size & power:
            part = block[offset:len(values) - size + 1 + offset]
            out = part if out is None else out * factor + part
            offset += power
            done += power
            if done == size:
                return _mixed(out)
        block = block[:-power] * factor + block[power:] if len(block) > power else block[:0]
        with np.errstate(over="ignore"):
            factor = factor * factor
        power *= 2


class Suffixes:
    """The retained suffixes of one text: for each, the windows of ``min_words`` that retain it.

    Window s retains the suffix at the smallest prefix hash in it (the first of equal ones), which
    depends on the window's words alone. ``lo`` and ``hi`` are the first and last window of a run.
    """

    def __init__(self, text: str, min_words: int, prefix: int):
        words = words_of(text)
        self.n_words = len(words)
        self.at = self.lo = self.hi = self.key = np.empty(0, dtype=np.int64)
        self.windows = np.empty(0, dtype=np.uint64)
        if len(words) < min_words:
            return
        digest = xxhash.xxh3_64_digest
        values = np.frombuffer(b"".join(map(digest, words)), dtype=np.uint64)
        starts = _rolled(values, prefix)
        width = min_words - prefix + 1
        view = np.lib.stride_tricks.sliding_window_view(starts, width)
        at = np.concatenate([  # in slices, so that a very long text needs little memory
            view[i:i + 65536].argmin(axis=1) + np.arange(i, min(i + 65536, len(view)))
            for i in range(0, len(view), 65536)])
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        self.lo, self.hi = first, np.append(first[1:], len(at)) - 1
        self.at = at[first]
        self.key = starts[self.at].view(np.int64)
        self.windows = _mixed(_rolled(values, min_words) ^ starts[at] * _ODD).view(np.int64)


def _sorted_matches(keys: DataFrame, parts: int) -> DataFrame:
    """The keys that occur more than once: sort all, and compare each with its neighbours.

    Equal keys are spread by ``tie``, so that a passage with very many copies is cut into several
    ranges. The first and last key of a range are counted across ranges.
    """
    dealt = keys.repartitionByRange(parts, "key", "tie").sortWithinPartitions("key", "tie").select("key")
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, told, edges = None, None, []
        for batch in batches:
            key = batch.column(0).to_numpy()
            if not len(key):
                continue
            if before is None:
                edges.append(int(key[0]))
            same = key[1:][key[1:] == key[:-1]]
            if before is not None and key[0] == before:
                same = np.insert(same, 0, before)
            same = np.unique(same)
            if len(same) and told == same[0]:
                same = same[1:]
            if len(same):
                told = same[-1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(same), pa.array(np.full(len(same), 2))], schema=schema)
            before = key[-1]
        if before is not None:
            edges.append(int(before))
            yield pa.RecordBatch.from_arrays([pa.array(edges[:1] + edges[1:] * (edges[0] != edges[1])),
                                              pa.array([1] * (1 + (edges[0] != edges[1])))], schema=schema)

    found = dealt.mapInArrow(compare, "key long, n long")
    return found.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key")


def _slots(keys: DataFrame) -> np.ndarray:
    """A bit for each key's slot; at most 2 ** (SLOT_BITS - 6) rows come to the driver."""
    slot = F.col("key").bitwiseAND(F.lit((1 << SLOT_BITS) - 1))
    rows = keys.select(F.shiftright(slot, 6).alias("word"),
                       F.expr(f"shiftleft(1L, cast(key & {63} as int))").alias("bit"))
    found = rows.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    table = np.zeros(1 << (SLOT_BITS - 6), dtype=np.int64)
    table[found["word"].to_numpy(dtype=np.int64)] = found["bits"].to_numpy(dtype=np.int64)
    return table


def _maybe(table: np.ndarray, key: np.ndarray) -> np.ndarray:
    word = table[(key & ((1 << SLOT_BITS) - 1)) >> 6]
    return (word >> (key & 63)) & 1 == 1


def _unit_batches(batches, table, arrow, min_words: int, prefix: int):
    """A head row for each text, and a row for each run of windows whose suffix may match."""
    for batch in batches:
        out: Columns = {f.name: [] for f in arrow}

        def add(doc, text_hash, unit, lo, windows, n_words):
            for name, value in zip(out, (doc, text_hash, unit, lo, windows, n_words)):
                out[name].append(value)

        for doc, text_hash, text in zip(*(c.to_pylist() for c in batch.columns)):
            s = Suffixes(text, min_words, prefix)
            add(doc, text_hash, None, None, None, s.n_words)
            for i in np.flatnonzero(_maybe(table.value, s.key)) if len(s.key) else ():
                lo, hi = int(s.lo[i]), int(s.hi[i]) + 1
                run = s.windows[lo:hi]
                unit = int(xxhash.xxh3_64_intdigest(run.tobytes(), 7)) - (1 << 63)
                add(doc, text_hash, unit, lo, run, None)
        yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)


def repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    min_words: int = MIN_WORDS, prefix: int = PREFIX,
) -> DataFrame:
    """``(id, text_hash, n_words, repeated, extra, first)``, one row for each id and text.

    ``repeated`` are the word ranges, flat (start, end, ..), that lie in passages of ``min_words``
    words or more which occur elsewhere too, in another document or the same one. ``extra`` are
    those to drop so that each passage stays where it comes first: in the document with the
    smallest id, and there at the first place. ``first`` is the smallest id among the documents
    that share a passage with this one, itself included; null if nothing repeats. Words are runs
    of letters and digits, in lower case (A-Z).

    A passage of ``min_words`` words has at least one retained suffix whose first ``prefix`` words
    lie in it, so none is missed. Runs of windows around a matching suffix are compared whole
    first, so a passage copied as a whole counts as one row whatever its number of copies; single
    windows are compared for what is left, where passages begin and end.

    A null or short text has no passages. Rows that repeat an id and a text are occurrences of
    their own but share one row of the result. Null ids come after all others as the first place.
    Texts of any length are read whole. An empty table gives no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"),
                        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    texts = texts.select("id", F.xxhash64("text").alias("text_hash"), "text")
    kind = texts.schema["id"].dataType.simpleString()

    def retained():
        def run(c: Columns) -> Columns:
            found = [Suffixes(t, min_words, prefix) for t in c["text"]]
            keys = np.concatenate([s.key for s in found] or [np.empty(0, np.int64)])
            ties = [s.at + (h & 0xFFFFFFFF) for s, h in zip(found, c["text_hash"])]
            return {"key": keys, "tie": np.concatenate(ties or [np.empty(0, np.int64)])}
        return run

    keys = stored(map_columns(texts, "key long, tie long", retained), "suffixes")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = spark.sparkContext.broadcast(_slots(_sorted_matches(keys, parts)))  # 2 ** SLOT_BITS bits
    discard(keys)

    schema = f"id {kind}, text_hash long, unit long, lo long, windows array<long>, n_words long"
    arrow = to_arrow_schema(spark.createDataFrame([], schema).schema)
    units = stored(texts.mapInArrow(
        partial(_unit_batches, table=table, arrow=arrow, min_words=min_words, prefix=prefix),
        schema), "units")

    runs = units.where("unit is not null")
    once = runs.groupBy("unit").agg(
        F.count("*").alias("n"), F.min("id").alias("first"), F.first("windows").alias("windows"))
    windows = stored(once.select("unit", "n", "first", F.posexplode("windows").alias("nth", "window")), "windows")
    again = windows.groupBy("window").agg(F.sum("n").alias("n"), F.min("first").alias("first")).where("n > 1")
    marks = (
        windows.select("unit", "nth", "window").join(again.drop("n"), "window")
        .groupBy("unit").agg(F.collect_list(F.struct("nth", "window", "first")).alias("marks")))
    marks = stored(marks, "marks")
    discard(windows)
    placed = runs.select("id", "text_hash", "unit", "lo").join(marks, "unit").select(
        "id", "text_hash", "lo", "marks", F.lit(None).cast("long").alias("n_words"))
    heads = units.where("unit is null").select(
        "id", "text_hash", F.lit(None).cast("long").alias("lo"),
        F.lit(None).cast(marks.schema["marks"].dataType).alias("marks"), "n_words")
    # An array for each field, as lists of numbers are far cheaper in Python than structs.
    place = F.struct("lo", *[F.col(f"marks.{c}").alias(c) for c in ("nth", "window", "first")])
    by_text = placed.unionByName(heads).groupBy("id", "text_hash").agg(
        F.max("n_words").alias("n_words"),
        F.collect_list(F.when(F.col("lo").isNotNull(), place)).alias("places"))

    def ranges():
        def run(c: Columns) -> Columns:
            out: Columns = {k: c[k] for k in ("id", "text_hash", "n_words")}
            out |= {"repeated": [], "extra": [], "first": []}
            for doc, places in zip(c["id"], c["places"]):
                found = {p["lo"] + nth: (window, first) for p in places
                         for nth, window, first in zip(p["nth"], p["window"], p["first"])}
                seen: set[int] = set()
                extra = []
                for s in sorted(found):
                    window, first = found[s]
                    if first != doc or window in seen:
                        extra.append((s, s + min_words))
                    seen.add(window)
                out["repeated"].append([x for r in merged([(s, s + min_words) for s in found]) for x in r])
                out["extra"].append([x for r in merged(extra) for x in r])
                out["first"].append(min((f for _, f in found.values() if f is not None), default=None))
            return out
        return run

    return map_columns(by_text, f"id {kind}, text_hash long, n_words long, repeated array<long>, "
                                f"extra array<long>, first {kind}", ranges)
