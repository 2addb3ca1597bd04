"""Benchmark decontamination: a broadcast hash set of test n-grams against all token windows."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Columns, map_columns

MAX_WINDOWS = 500_000  # (window, item) pairs in one broadcast set; more are dealt to several sets

_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32
               for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Words of 0-9, a-z and everything beyond ASCII, with A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "replace").translate(_PLAIN).split()


def item_windows(benchmark: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """Distinct ``(item, words, window)``: every ``n`` words in a row, or a shorter item's words.

    Windows of an item without an id have no item, but they hit.
    """
    def prepare():
        def run(c: Columns) -> Columns:
            out: Columns = {"item": [], "words": [], "window": []}
            for item, text in zip(c["item"], c["text"]):
                words = words_of(text)
                size = min(n, len(words))
                found = {b" ".join(words[i:i + size]) for i in range(len(words) - size + 1)}
                for w in found if words else ():
                    out["item"].append(item)
                    out["words"].append(size)
                    out["window"].append(w)
            return out
        return run

    items = benchmark.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    return map_columns(items, "item string, words int, window binary", prepare).distinct()


class WindowSet:
    """Windows by a polynomial hash of their words' numbers; a hit is verified on the words."""

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, rows: list[tuple[str | None, int, bytes]]):
        self.items: dict[bytes, list[str | None]] = {}
        self.vocabulary: dict[bytes, int] = {}
        sizes: dict[int, set[bytes]] = {}
        for item, size, window in rows:
            self.items.setdefault(window, []).append(item)
            sizes.setdefault(size, set()).add(window)
            for w in window.split():
                self.vocabulary.setdefault(w, len(self.vocabulary))
        rng = np.random.default_rng(1)
        self.values = rng.integers(1, 2**63, len(self.vocabulary) + 1, dtype=np.uint64)
        self.hashes = {
            size: np.unique([self._roll(self._numbers(w.split()), size)[0] for w in windows])
            for size, windows in sizes.items()
        }

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, -1) for w in words], dtype=np.int64)

    def _roll(self, numbers: np.ndarray, size: int) -> np.ndarray:
        values = self.values[numbers]
        count = len(numbers) - size + 1
        out = np.zeros(count, dtype=np.uint64)
        for k in range(size):
            out = out * self.BASE + values[k:k + count]
        return out

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged word ranges that windows cover, and the items whose windows occur."""
        ranges: list[tuple[int, int]] = []
        items: set[str] = set()
        numbers = self._numbers(words)
        unknown = np.concatenate(([0], np.cumsum(numbers < 0)))
        for size, hashes in self.hashes.items():
            if len(words) < size:
                continue
            whole = np.flatnonzero(unknown[size:] == unknown[:-size])
            if not len(whole):
                continue
            rolled = self._roll(numbers, size)[whole]
            at = np.searchsorted(hashes, rolled)
            hit = hashes[np.minimum(at, len(hashes) - 1)] == rolled
            for i in whole[hit].tolist():
                found = self.items.get(b" ".join(words[i:i + size]))
                if found:
                    ranges.append((i, i + size))
                    items.update(found)
        return merged(ranges), items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", n: int = 10,
    max_windows: int = MAX_WINDOWS,
) -> DataFrame:
    """``(id, text_hash, n_words, spans, items)`` for every row of ``docs``.

    ``spans`` are the hit word ranges, flat (start, end, start, end, ..); ``items`` the sorted
    ids, as strings, of the items with windows that occur. Whole texts are scanned.

    The windows are counted first. Up to ``max_windows`` are one broadcast set; more are dealt by
    hash to several sets of that size, each compared with all documents, and the findings of a
    document are merged: the result is the same.

    A null or empty text has no words and no hits. Items with a null text, or without
    words, have no windows; those of an item with a null id hit, but name no item. Repeated rows get a row each. An empty table on either side gives no
    rows or no hits.
    """
    spark = docs.sparkSession
    windows = item_windows(benchmark, item_col, item_text_col, n).withColumn(
        "part", F.xxhash64("item", "window"))
    parts = -(-windows.count() // max_windows) or 1
    texts = with_hash(docs, id_col, text_col)
    kind = texts.schema["id"].dataType.simpleString()
    schema = f"id {kind}, text_hash long, n_words long, spans array<int>, items array<string>"

    def scan(part: int) -> DataFrame:
        rows = windows.where(F.pmod("part", F.lit(parts)) == part).select("item", "words", "window")
        shared = spark.sparkContext.broadcast(
            [(r[0], r[1], bytes(r[2])) for r in rows.collect()])

        def prepare():
            known = WindowSet(shared.value)

            def run(c: Columns) -> Columns:
                out: Columns = {"id": c["id"], "text_hash": c["text_hash"],
                                "n_words": [], "spans": [], "items": []}
                for text in c["text"]:
                    words = words_of(text)
                    ranges, items = known.find(words) if words else ([], set())
                    out["n_words"].append(len(words))
                    out["spans"].append([x for r in ranges for x in r])
                    out["items"].append(sorted(i for i in items if i is not None))
                return out
            return run

        return map_columns(texts, schema, prepare)

    if parts == 1:
        return scan(0)
    found = scan(0)
    for part in range(1, parts):
        found = found.unionByName(scan(part).where(F.size("spans") > 0))
    # Equal rows have equal findings: merge by id and text, then give each row its own copy.
    once = found.groupBy("id", "text_hash").agg(
        F.max("n_words").alias("n_words"),
        F.flatten(F.collect_set("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))

    def prepare():
        def run(c: Columns) -> Columns:
            spans = [merged(list(zip(s[::2], s[1::2]))) for s in c["spans"]]
            return c | {"spans": [[x for r in s for x in r] for s in spans]}
        return run

    once = map_columns(once, schema, prepare).withColumnsRenamed(
        {"id": "_id", "text_hash": "_hash"})
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    return texts.drop("text").join(once, same).drop("_id", "_hash")


def with_hash(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), text.alias("text"),
                       F.xxhash64(text).alias("text_hash"))


def hit_words() -> Column:
    """The number of words in ``spans``."""
    signed = F.transform("spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x).cast("long"))
    return F.aggregate(signed, F.lit(0).cast("long"), lambda a, x: a + x)


def without_hits(
    docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` without the documents that hold a benchmark window, told apart by id and text."""
    return without(docs, found.where(F.size("spans") > 0), id_col, text_col)


def without(
    docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` without the rows whose id and text are those of a row of ``gone`` (id, text_hash)."""
    names = gone.select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    same = docs[id_col].eqNullSafe(names["_id"]) & (F.xxhash64(text) == names["_hash"])
    return docs.join(names, same, "left_anti")


def without_spans(
    docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id, text)`` with the hit words, and what stands between them, cut from the texts."""
    dirty = found.where(F.size("spans") > 0).select(
        F.col("id").alias("_id"), F.col("text_hash").alias("_hash"), "spans").dropDuplicates(
        ["_id", "_hash"])
    texts = with_hash(docs, id_col, text_col)
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))

    def prepare():
        def run(c: Columns) -> Columns:
            out = []
            for text, spans in zip(c["text"], c["spans"]):
                if spans:
                    raw = text.encode("utf-8", "replace")
                    at = [m.span() for m in _WORD.finditer(raw)]
                    for a, b in reversed(list(zip(spans[::2], spans[1::2]))):
                        raw = raw[:at[a][0]] + raw[at[b - 1][1]:]
                    text = raw.decode("utf-8", "replace")
                out.append(text)
            return {"id": c["id"], "text": out}
        return run

    kind = texts.schema["id"].dataType.simpleString()
    return map_columns(texts.join(dirty, same, "left").select("id", "text", "spans"),
                       f"id {kind}, text string", prepare)
