"""Document fingerprints: quartile codes of hashed byte triplets, compared by a bounded score."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

BUCKETS = 256
SECOND, THIRD = 5, 11  # the triplet's other bytes; spread out, they say more than a language's letters
LENGTH_WEIGHT = 0.15


def digest(text: str) -> str:
    """Hex digest: the length on a logarithmic scale, then two bits for each of 256 buckets.

    A bucket's code says between which quartiles of all buckets its count lies. Texts of less than
    12 bytes are repeated up to that length; the empty text has code zero everywhere.
    """
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    size = len(raw)
    if not size:
        return "00" * (1 + BUCKETS // 4)
    if size <= THIRD:
        raw = np.resize(raw, THIRD + 1)
    n = len(raw) - THIRD
    wide = raw.astype(np.uint32)
    value = wide[:n] << 16 | wide[SECOND:SECOND + n] << 8 | wide[THIRD:]
    value *= np.uint32(0x9E3779B1)
    value ^= value >> 15
    value *= np.uint32(0x85EBCA77)
    count = np.bincount(value >> 24, minlength=BUCKETS)
    quartiles = np.partition(count, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1])[
        [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    code = (count[:, None] > quartiles).sum(axis=1).astype(np.uint8).reshape(-1, 4)
    packed = code[:, 0] << 6 | code[:, 1] << 4 | code[:, 2] << 2 | code[:, 3]
    length = min(255, 1 + int(8 * math.log2(size)))
    return bytes([length]).hex() + packed.tobytes().hex()


_UNPACK = np.array([[b >> 6, b >> 4 & 3, b >> 2 & 3, b & 3] for b in range(256)])
_GAPS = np.abs(np.subtract.outer(np.arange(4), np.arange(4)))


def likeness(one: str, two: str) -> float:
    """1 for equal digests, 0 for digests as far apart as unrelated ones or farther.

    The mean gap of the codes is set against the gap that independent codes with the same
    frequencies would have; a sixteenfold length counts as the greatest length difference.
    """
    if one == two:
        return 1.0
    a, b = (np.frombuffer(bytes.fromhex(x), dtype=np.uint8) for x in (one, two))
    codes_a, codes_b = _UNPACK[a[1:]].ravel(), _UNPACK[b[1:]].ravel()
    gap = np.abs(codes_a - codes_b).mean()
    share_a, share_b = (np.bincount(c, minlength=4) / BUCKETS for c in (codes_a, codes_b))
    expected = share_a @ _GAPS @ share_b
    codes = min(1.0, gap / expected) if expected > 0 else float(gap > 0)
    length = min(1.0, abs(int(a[0]) - int(b[0])) / 32)
    return float(max(0.0, 1.0 - (1 - LENGTH_WEIGHT) * codes - LENGTH_WEIGHT * length))


def edited_text(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by as many first code points of ``following``."""
    k = len(text) // 4
    return text[:len(text) - k] + following[:k]


def in_order_buckets(docs: DataFrame, parts: int) -> DataFrame:
    """Add ``bucket``, a range of ids, and ``tail``: a copy of the first row of the next range.

    The ranges start at ids that occur, so that the row after a range's last is known to be a
    copy of the next range's first; the last range is followed by the first. Null ids come first.
    """
    spark = docs.sparkSession
    shares = [k / parts for k in range(1, parts)] or [0.5]
    ids = docs.select("id").where("id is not null")
    about = sorted(set(ids.agg(F.percentile_approx(
        "id", F.array(*map(F.lit, shares)), F.lit(20 * parts))).first()[0] or []))

    @F.pandas_udf(LongType())
    def ranges(values):
        import pandas as pd

        return pd.Series(np.searchsorted(np.array(about), values, side="right"))

    # The quantiles go through doubles; the ranges start at the smallest ids beyond them.
    starts = ids.groupBy(ranges("id").alias("range")).agg(F.min("id").alias("least")).collect()
    cuts = sorted(r["least"] for r in starts)
    if not docs.where("id is null").isEmpty():
        cuts = [None, *cuts]
    shared = spark.sparkContext.broadcast(cuts)  # at most as many ids as partitions
    schema = ArrayType(StructType([StructField("bucket", LongType()), StructField("tail", LongType())]))

    @F.pandas_udf(schema)
    def places(ids, nulls):
        import pandas as pd

        cuts = shared.value
        offset = int(bool(cuts) and cuts[0] is None)
        values = np.array(cuts[offset:])
        firsts = set(cuts[offset:])
        out = []
        for x, null in zip(ids, nulls):
            at = 0 if null else offset + int(np.searchsorted(values, x, side="right")) - 1
            row = [{"bucket": at, "tail": 0}]
            if null or x in firsts:
                row.append({"bucket": (at - 1) % len(cuts), "tail": 1})
            out.append(row)
        return pd.Series(out)

    # Null ids travel as 0, so that pandas does not turn the others into floats.
    known = F.coalesce("id", F.lit(0).cast(docs.schema["id"].dataType))
    place = F.explode(places(known, F.col("id").isNull())).alias("place")
    return docs.select("id", "text", place).select("id", "text", "place.*")


def fingerprint_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None
) -> DataFrame:
    """``(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``.

    One row for each row of ``docs``, with the digest of its text, that of its edited text (see
    ``edited_text``; the following document is the next in ascending id order, the first after
    the last), and how like its digest is to both the edited text's and the following document's.

    A null text is empty. Null ids come first; rows with one id are ordered by a hash of their
    text. A single row is followed by itself. Texts of any length are read whole. An empty table
    gives no rows. Ids are numbers. ``parts`` is the number of id ranges, by default that of
    shuffle partitions; the texts are shuffled once.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col(id_col).alias("id"),
                        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    dealt = (
        in_order_buckets(texts, parts).repartition(parts, "bucket")
        .withColumn("text_hash", F.xxhash64("text"))
        .sortWithinPartitions("bucket", "tail", "id", "text_hash")
        .select("id", "text", "bucket", "tail"))
    schema = StructType([
        dealt.schema["id"], StructField("n_chars", LongType()),
        *(StructField(c, StringType()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")),
    ])
    schema = schema.add("near_edited", "double").add("near_next", "double")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # id, text, digest, bucket, tail
        for batch in batches:
            rows = []
            for id_, text, bucket, tail in zip(*(c.to_pylist() for c in batch.columns)):
                mark = digest(text)
                if before and before[3] == bucket and not before[4]:
                    rows.append(compared(before, text, mark))
                before = (id_, text, mark, bucket, tail)
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    def compared(row: tuple, following: str, mark: str) -> dict:
        text = edited_text(row[1], following)
        edited = digest(text)
        return dict(zip(arrow.names, (
            row[0], len(row[1]), hashlib.sha256(text.encode("utf-8", "replace")).hexdigest(),
            row[2], edited, likeness(row[2], edited), likeness(row[2], mark))))

    return dealt.mapInArrow(run, schema)
