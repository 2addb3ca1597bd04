"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Columns, map_columns, stored

BUCKETS = 1 << 16
_TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^\s0-9A-Za-z\x80-\xff]+")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def grams(text: str) -> np.ndarray:
    """Buckets of the text's lower-cased tokens, token pairs and token shapes.

    Tokens are runs of letters and digits, and runs of other signs. A shape says how long a token
    is and whether it has capitals, digits or signs, and whether it repeats the one before.
    """
    tokens = _TOKEN.findall(text.encode("utf-8", "replace"))
    if not tokens:
        return np.empty(0, dtype=np.int64)
    one = np.array([zlib.crc32(t.lower()) for t in tokens], dtype=np.uint64)
    shape = np.array([min(len(t), 15) + 16 * t.isupper() + 32 * t.isdigit() + 64 * (not t.isalnum() and t[0] < 128)
                      for t in tokens], dtype=np.uint64)
    shape[1:] += np.uint64(128) * (one[1:] == one[:-1])
    two = one[:-1] * np.uint64(0x85EBCA6B) + one[1:]
    pairs = shape[:-1] * np.uint64(256) + shape[1:]
    parts = [one * _STEP, (two + np.uint64(1)) * _STEP, (shape + np.uint64(1 << 40)) * _STEP,
             (pairs + np.uint64(1 << 41)) * _STEP]
    mixed = np.concatenate(parts)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(48)).astype(np.int64)


def gram_counts(texts: DataFrame) -> DataFrame:
    """``(bucket, n)`` over the whole texts, added up in each task before the shuffle."""
    schema = pa.schema([("bucket", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        waiting: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                waiting.append(grams(text))
                size += len(waiting[-1])
                if size > 1 << 20:
                    total += np.bincount(np.concatenate(waiting), minlength=BUCKETS)
                    waiting, size = [], 0
        if waiting:
            total += np.bincount(np.concatenate(waiting), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], schema=schema)

    return texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(
        F.sum("n").alias("n"))


def _distribution(counts: DataFrame) -> np.ndarray:
    """Shares of all buckets, each bucket counted once more; at most BUCKETS rows are read."""
    out = np.ones(BUCKETS)
    for r in counts.collect():
        out[r["bucket"]] += r["n"]
    return out / out.sum()


def log_weights(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``(id, text_hash, n_grams, log_weight)`` for every row of ``docs``.

    ``log_weight`` is the mean, over a text's n-grams, of the logarithm of their share in the
    target texts (rows of ``docs`` whose ids are in ``target``) over their share in all texts.
    The mean keeps long texts from outweighing everything else; a text without tokens has 0.
    """
    texts = docs.select(F.col(id_col).alias("id"),
                        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    raw = _distribution(gram_counts(texts))
    good = _distribution(gram_counts(texts.join(F.broadcast(target), "id", "left_semi")))
    shared = docs.sparkSession.sparkContext.broadcast(np.log(good) - np.log(raw))  # BUCKETS numbers

    def prepare():
        ratio = shared.value

        def run(c: Columns) -> Columns:
            out: Columns = {"id": c["id"], "text_hash": c["text_hash"], "n_grams": [], "log_weight": []}
            for text in c["text"]:
                g = grams(text)
                out["n_grams"].append(len(g))
                out["log_weight"].append(float(ratio[g].mean()) if len(g) else 0.0)
            return out
        return run

    kind = texts.schema["id"].dataType.simpleString()
    return map_columns(texts.withColumn("text_hash", F.xxhash64("text")),
                       f"id {kind}, text_hash long, n_grams long, log_weight double", prepare)


def gumbel(*cols: str, seed: int = 11) -> Column:
    """Gumbel noise from a hash of the columns, so that a second run draws the same."""
    uniform = (F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(uniform))


def top_k(rows: DataFrame, k: int, key: str) -> DataFrame:
    """The ``k`` rows with the largest ``key`` (a long), exactly; rows that tie at the end all stay.

    The k-th largest key is found by counting: 16 bits of it in each pass, from the top, with at
    most 65,536 counts on the driver, so that no task sorts or holds all rows.
    """
    if k <= 0:
        return rows.where(F.lit(False))
    prefix, missing = None, k
    for shift in range(48, -1, -16):
        inside = rows if prefix is None else rows.where(
            F.shiftright(key, shift + 16) == prefix)
        part = F.shiftright(key, shift)
        counts = sorted(((r["part"], r["count"]) for r in
                         inside.groupBy(part.alias("part")).count().collect()), reverse=True)
        if not counts:
            return rows
        for value, n in counts:
            prefix = value
            if n >= missing:
                break
            missing -= n
        else:
            return rows  # fewer than k rows
    return rows.where(F.col(key) >= prefix)


def resample(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality", fraction: float = 0.8, sharpness: float = 25.0,
    max_target_rows: int = 60_000,
) -> DataFrame:
    """``(id, n_grams, log_weight, selected)`` for every row of ``docs``.

    A sample without replacement of ``fraction`` of the rows, in proportion to
    exp(``sharpness`` * log_weight): the rows with the largest sum of that exponent and Gumbel
    noise. The target model is made from at most ``max_target_rows`` rows labelled 1, by hash
    order, whose crc32(id) mod 3 is not 1; the raw model from all rows.

    A null or empty text has weight 1 (log_weight 0). Rows that repeat an id and a text draw the
    same noise and stay or go alike, also where that makes the sample larger. Without target rows
    all weights are 1. Null ids are weighed like others. An empty table gives no rows.
    """
    crc = F.crc32(F.col(id_col).cast("string").cast("binary"))
    target = (
        labels.where((F.col(label_col) == 1) & F.col(id_col).isNotNull() & (crc % 3 != 1))
        .select(F.col(id_col).alias("id")).orderBy(F.xxhash64("id"), "id").limit(max_target_rows).distinct())
    target = stored(target, "target")
    if target.isEmpty():
        weights = log_weights(docs, target, id_col, text_col).withColumn("log_weight", F.lit(0.0))
    else:
        weights = log_weights(docs, target, id_col, text_col)
    # The key's order as a long: scaled, so that sums that differ by a billionth differ.
    drawn = F.col("log_weight") * sharpness + gumbel("id", "text_hash")
    rows = stored(weights.withColumn("key", F.floor(drawn * 1e9).cast("long")), "weights")
    n = rows.count()
    chosen = top_k(rows, int(fraction * n + 0.5), "key").agg(F.min("key")).first()[0]
    selected = F.col("key") >= chosen if chosen is not None else F.lit(False)
    return rows.select("id", "n_grams", "log_weight", selected.alias("selected"))
