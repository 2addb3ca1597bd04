"""Token files: exact round trip, stripes, and reads that leave out what cannot match."""

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.orc as orc
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from modelshift.llm.common import new_folder
from modelshift.llm.queries import word_tokenizer
from modelshift.llm.tokens import read_tokens, text_encoder, token_digests, write_tokens

from .cases import awkward, awkward_rows, empty, frame, prose, read_texts

MIXED = ["", " ", "\n", "A  b\n\nc", "<|endoftext|> a<|startoftext|>b", "<|ENDOFTEXT|>", "it's  DON'T '.",
         "Ünï çødé 漢字 🙂 é", "\x1c\x85\xa0x \t y", "x" * 5000]


@lru_cache
def tokenizer() -> Tokenizer:
    return Tokenizer.from_str(word_tokenizer())


def reference(text: str | None) -> list[int]:
    return tokenizer().encode(text or "", add_special_tokens=False).ids + [2]


def expected(rows: list[tuple]) -> list[tuple]:
    """(id, start, n_tokens, ids_crc32) of rows in their order."""
    out, start = [], 0
    for i, text in rows:
        ids = np.array(reference(text), dtype="<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@pytest.fixture
def path(spark):
    return new_folder(spark, "token-test")


def test_encoder_equals_the_tokenizer():
    encode = text_encoder(word_tokenizer(), 2)
    texts = MIXED + [prose(k, 3 * k) for k in range(50)]
    ids, counts = encode(pa.array(texts).slice(0))
    assert ids.tolist() == [x for t in texts for x in reference(t)]
    assert counts.tolist() == [len(reference(t)) for t in texts]
    ids, counts = encode(pa.array(["left out", *texts]).slice(4, 3))  # a part of a larger array
    assert ids.tolist() == [x for t in texts[3:6] for x in reference(t)]
    assert encode(pa.array([""]))[0].tolist() == [2]


@pytest.mark.parametrize("parts", [1, 7])
def test_round_trip_of_the_documents(spark, sf_dir, path, parts):
    texts = read_texts(spark, sf_dir)
    write_tokens(frame(spark, dict(reversed(texts.items()))), word_tokenizer(), path, parts=parts)
    got = sorted(map(tuple, token_digests(read_tokens(spark, path)).collect()))
    assert got == expected(sorted(texts.items()))
    whole = {r["id"]: list(r["ids"]) for r in read_tokens(spark, path).collect()}
    assert whole == {i: reference(t) for i, t in texts.items()}


def test_awkward_rows(spark, path):
    write_tokens(awkward(spark), word_tokenizer(), path, parts=3)
    got = token_digests(read_tokens(spark, path)).collect()
    assert len(got) == len(awkward_rows())
    rows = sorted(got, key=lambda r: r["start"])
    assert [r["id"] for r in rows] == sorted((r[0] for r in awkward_rows()), key=lambda i: (i is not None, i))
    assert [r["start"] for r in rows[1:]] == [r["start"] + r["n_tokens"] for r in rows[:-1]]
    want = sorted((i, len(reference(t))) for i, t, *_ in awkward_rows() if i is not None)
    assert sorted((r["id"], r["n_tokens"]) for r in rows if r["id"] is not None) == want
    none = path + "-none"
    write_tokens(empty(spark), word_tokenizer(), none)
    assert token_digests(read_tokens(spark, none)).count() == 0


def test_one_id_with_a_third_of_all_rows_is_split(spark, path):
    rows = [(7 if k % 3 else k, prose(k, 20)) for k in range(900)]
    write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), word_tokenizer(), path, parts=6)
    files = spark.read.orc(path)
    assert files.where("id = 7").select("part").distinct().count() >= 3
    got = sorted(map(tuple, token_digests(read_tokens(spark, path)).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted(r[0] for r in rows)
    assert [r[1] for r in got[1:]] == [r[1] + r[2] for r in got[:-1]]


def test_files_are_pruned_by_their_metadata(spark, path):
    texts = {k: prose(k % 50, 60) for k in range(0, 40_000, 2)}
    write_tokens(frame(spark, texts), word_tokenizer(), path, parts=2)
    some = read_tokens(spark, path, [4, 5, 20_002])
    plan = some._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "In(id, [" in plan.split("PushedFilters: ")[1].split("\n")[0]
    assert sorted(r["id"] for r in some.collect()) == [4, 20_002]
    assert [r["start"] for r in some.orderBy("id").collect()] == [
        e[1] for e in expected(sorted(texts.items())) if e[0] in (4, 20_002)]
    # An id that no document has lies in the range of a row group, but not in its Bloom filter.
    assert spark.read.orc(path).where(F.col("id") == 5).count() == 0
    names = [f.removeprefix("file://") for f in spark.read.orc(path).inputFiles()]
    found = [orc.ORCFile(n) for n in names]
    assert sum(f.nrows for f in found) == len(texts)
    assert all(f.file_version.startswith("0.12") and f.row_index_stride == 1000 for f in found)
    assert all(f.stripe_statistics_length > 0 for f in found)
