"""Token ids of documents in ORC files, in ascending document order, and reading them back.

Each file holds one range of documents, sorted by id. The ids lie in an integer list column, which
ORC run-length encodes; every stripe has a row index, and a Bloom filter on the document id, so a
search for documents opens the stripes and row groups that can hold them only, and a full read
is dealt out by stripes.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .packing import run_encoders

SLICE = 1 << 22  # bytes of text, at least one document, that a task encodes at a time
STRIDE = 1000  # documents of a row group
STRIPE = 16 << 20  # bytes
FALSE_HITS = 0.01  # of the Bloom filters

Encoder = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def text_encoder(tokenizer_json: str, end: int) -> Encoder:
    """Texts to their ids in a row, ``end`` after each text, and the number of ids of each text.

    No token spans a space or line end. The texts are split there, and only the distinct runs of a
    slice are encoded.
    """
    get, as_it_is, special = run_encoders(tokenizer_json)
    start = re.compile("|".join(map(re.escape, special))) if special else re.compile(r"(?!)")

    def mixed(run: str) -> bytes:
        return as_it_is(run) if start.search(run) else get(run.encode().lower().decode())

    def run(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        plain = not pc.any(pc.match_substring_regex(texts, start.pattern)).as_py() if special else True
        one = pc.ascii_lower(texts) if plain else texts
        runs = pc.split_pattern(pc.replace_substring(one, "\n", " "), " ")
        border = runs.offsets.to_numpy().astype(np.int64)
        words = runs.values.slice(border[0], border[-1] - border[0]).dictionary_encode()
        known = list(map(get if plain else mixed, words.dictionary.to_pylist()))
        known.append(np.array([end], dtype="<u4").tobytes())  # one more run after each text
        flat = np.frombuffer(b"".join(known), dtype="<u4").astype(np.int32)
        size = np.array([len(b) // 4 for b in known], dtype=np.int32)
        first = (np.cumsum(size) - size).astype(np.int32)
        border -= border[0]
        at = np.insert(words.indices.to_numpy(), border[1:], len(known) - 1)
        lengths = size[at]
        ends = np.cumsum(lengths)
        ids = flat[np.arange(ends[-1], dtype=np.int32)
                   + np.repeat((first[at] - ends + lengths).astype(np.int32), lengths)]
        return ids, np.diff(ends[border[1:] + np.arange(len(texts))], prepend=0)

    return run


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``SLICE`` bytes."""
    size = np.cumsum(pc.binary_length(batch[column]).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(batch):
        before = size[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(size, before + SLICE, side="right")))
        yield batch.slice(at, upto - at)
        at = upto


def write_tokens(
    docs: DataFrame, tokenizer_json: str, path: str, end: int = 2, id_col: str = "doc_id",
    text_col: str = "text", parts: int | None = None,
) -> None:
    """Write the token ids of all documents below ``path``, in ascending order of id.

    Columns of the files: ``id``, ``part`` (the range), ``before`` (ids of the documents before it
    in that range), ``n_tokens`` (with ``end``), ``ids``. A null text is empty and has ``end`` alone. Null ids come
    first; rows that repeat an id are ordered by a hash of the text, and written each. An empty
    table gives files without rows.

    There are ``parts`` ranges, as many as shuffle partitions unless stated. They are cut by id and
    text hash, so rows that share an id are split too; texts are shuffled once, and encoded in
    slices where they end up.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(tokenizer_json)  # one vocabulary file
    texts = docs.select(F.col(id_col).alias("id"),
                        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    order = ["id", F.xxhash64("text")]
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = texts.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, before = text_encoder(shared.value, end), TaskContext.get().partitionId(), 0
        for batch in batches:
            for some in _slices(batch, "text"):
                ids, counts = encode(some["text"])
                ends = np.cumsum(counts)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [some["id"], pa.array(np.full(len(some), part), pa.int32()),
                     pa.array(before + ends - counts), pa.array(counts), lists],
                    ["id", "part", "before", "n_tokens", "ids"])
                before += int(ends[-1])

    kind = texts.schema["id"].dataType.simpleString()
    tokens = ranges.mapInArrow(
        run, f"id {kind}, part int, before long, n_tokens long, ids array<int>")
    tokens.write.options(**{
        "orc.bloom.filter.columns": "id", "orc.bloom.filter.fpp": str(FALSE_HITS),
        "orc.row.index.stride": str(STRIDE), "orc.stripe.size": str(STRIPE),
    }).orc(path)


def read_tokens(spark: SparkSession, path: str, ids: Iterable | None = None) -> DataFrame:
    """``(id, start, n_tokens, ids)`` from the files below ``path``; of the documents ``ids``, or all.

    ``start`` counts the ids of all documents before it. It comes from the counts in the files,
    without reading any token; the driver holds one number for each range.
    """
    files = spark.read.orc(path)
    count = {r["part"]: r["n"] for r in files.groupBy("part").agg(
        F.sum("n_tokens").alias("n")).toLocalIterator()}
    base, total = [], 0
    for part in sorted(count):
        base.append((part, total))
        total += count[part]
    starts = spark.createDataFrame(base, "part int, base long")
    wanted = files if ids is None else files.where(F.col("id").isin(list(ids)))
    return wanted.join(F.broadcast(starts), "part").select(
        "id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids")


def token_digests(tokens: DataFrame) -> DataFrame:
    """``(id, start, n_tokens, ids_crc32)``, counted from the ids as they were read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            border = batch["ids"].offsets.to_numpy()
            values = batch["ids"].values.to_numpy().astype("<u4", copy=False).view(np.uint8)
            crc = [zlib.crc32(values[4 * a:4 * b]) for a, b in zip(border[:-1], border[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["start"], pa.array(np.diff(border).astype(np.int64)),
                 pa.array(crc, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])

    kind = tokens.schema["id"].dataType.simpleString()
    return tokens.select("id", "start", "ids").mapInArrow(
        run, f"id {kind}, start long, n_tokens long, ids_crc32 long")
