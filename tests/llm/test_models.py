"""Personal data, toxicity and quality: brute force for the rules, held-out accuracy for models."""

import random
import re
import zlib

import numpy as np
import pytest

from modelshift.llm.pii import (
    KINDS, base_spans, candidates, features, find_personal_data, learn_judge, luhn, redact)
from modelshift.llm.queries import QUERIES
from modelshift.llm.resampling import resample, top_k
from modelshift.llm.toxicity import FEATURES, features as toxic_features, score_toxicity

from .cases import SCHEMA, awkward, awkward_rows, empty, frame, prose

# Big enough for held-out figures.
LARGER = "/root/testdata/sf0.01"

# ---- personal data ---------------------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text: str) -> list[tuple]:
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m.group().split(".")),
                    "card": lambda: 13 <= len(digits) <= 19 and luhn(digits),
                    "phone": lambda: 9 <= len(digits) <= 15}[kind]()
            if good:
                out.append((kind, *m.span()))
    return out


def test_base_spans_equal_the_patterns():
    rng = random.Random(1)
    for signs in ("a.@-1203456789 +()%é\n", "0123456789 -", "a@.b", "12345.", "+0123456789 ()-."):
        for _ in range(4000):
            text = "".join(rng.choices(signs, k=rng.randint(0, 60)))
            assert base_spans(text) == brute_spans(text), text


def test_base_spans_are_linear():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1 " * 100_000, "a@" * 150_000, "@" * 300_000):
        base_spans(text)
        candidates(text[:50_000])


def test_personal_data_of_the_documents(spark):
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "text").collect()}
    rows = find_personal_data(frame(spark, texts)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = [tuple(s) for s in r["base"]]
        added = [tuple(s) for s in r["added"]]
        assert base == brute_spans(texts[r["id"]])
        assert not any(a[1] < b[2] and b[1] < a[2] for a in added for b in base)
        assert r["redacted"] == redact(texts[r["id"]], base + added)
    assert sum(len(r["added"]) for r in rows) < 0.05 * sum(len(r["base"]) for r in rows)


def test_judge_knows_other_formats(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").selectExpr("doc_id id", "text")
    judge = learn_judge(docs)
    for text, kind in (("call (504) 555-2652 today", "phone"), ("tel 504-555-2652.", "phone")):
        assert [s[0] for s in judge.added(text, [])] == [kind], text
    for text in ("on 2024-05-12 10:30 we", "number 1234567890123456 is", "price 1,234,567.00"):
        assert judge.added(text, base_spans(text)) == [], text


def test_personal_data_awkward_rows(spark):
    rows = find_personal_data(awkward(spark)).collect()
    assert len(rows) == len(awkward_rows()) and all(r["base"] == [] for r in rows)
    assert find_personal_data(empty(spark)).count() == 0
    some = find_personal_data(frame(spark, {1: "mail a.b@c.example now", 2: None})).collect()
    assert {r["id"]: r["redacted"] for r in some} == {1: "mail [email] now", 2: ""}
    assert len(features("x 1.2.3.4", ("ip", 2, 9))) > len(KINDS)


def test_personal_data_query(spark, sf_dir):
    rows = QUERIES["op3_pii"](spark, sf_dir).collect()
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    for r in rows:
        base = brute_spans(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in KINDS] == [sum(s[0] == k for s in base) for k in KINDS]
        told = [s.split(":") for s in r["spans"].split(",") if s]
        assert set(base) <= {(k, int(a), int(b)) for k, a, b in told}
        assert told == sorted(told, key=lambda s: (KINDS.index(s[0]), int(s[1])))


# ---- toxicity --------------------------------------------------------------------------

def auc(scores: list[float], labels: list[int]) -> float:
    rank = np.argsort(np.argsort(scores, kind="stable")) + 1
    labels = np.array(labels)
    good, bad = labels.sum(), (1 - labels).sum()
    return (rank[labels == 1].sum() - good * (good + 1) / 2) / (good * bad)


def test_toxicity_on_held_out_rows(spark):
    rows = QUERIES["op8_toxicity"](spark, LARGER).collect()
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    truth = [labels[r["doc_id"]] for r in held]
    assert auc([r["score"] for r in held], truth) > 0.9
    told = [t for r, t in zip(held, truth) if r["predicted"]]
    assert sum(told) >= 0.7 * sum(truth) and sum(told) >= 0.9 * len(told)


def test_toxicity_awkward_rows(spark):
    labels = spark.createDataFrame([(1, 1), (None, 1), (2, None), (99, 0)], "doc_id long, toxic int")
    rows = score_toxicity(awkward(spark), labels).collect()
    assert len(rows) == len(awkward_rows()) and all(r["score"] is not None for r in rows)
    none = score_toxicity(awkward(spark), labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.0}
    assert score_toxicity(empty(spark), labels).count() == 0
    assert len(toxic_features("", frozenset(), frozenset(), frozenset())) == len(FEATURES)


def test_disguised_words_count():
    x = dict(zip(FEATURES, toxic_features(
        "You 1d10t and i d i o t, IDIOT!!", frozenset([b"idiot"]), frozenset(), frozenset([b"you"]))))
    assert x["disguised_hits"] == 2 and x["lexicon_hits"] == 1 and x["near_second_person"] == 0


# ---- importance resampling -------------------------------------------------------------

def test_quality_on_held_out_rows(spark):
    rows = QUERIES["op9_resampling"](spark, LARGER).collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    held = [r for r in rows if r["doc_id"] in labels and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    truth = [labels[r["doc_id"]] for r in held]
    assert auc([r["log_weight"] for r in held], truth) > 0.97
    assert np.mean([t for r, t in zip(held, truth) if r["selected"]]) > 0.97
    assert abs(sum(r["selected"] for r in rows) - 0.8 * len(rows)) <= 5


@pytest.mark.parametrize("k", [0, 1, 7, 100, 999, 1000, 2000])
def test_top_k_is_exact(spark, k):
    rng = random.Random(k)
    keys = [rng.choice([rng.randint(-2 ** 62, 2 ** 62), rng.randint(-5, 5)]) for _ in range(1000)]
    got = sorted(r["key"] for r in top_k(spark.createDataFrame([(x,) for x in keys], "key long"), k, "key").collect())
    ranked = sorted(keys, reverse=True)
    assert got == sorted(x for x in keys if k and x >= ranked[min(k, 1000) - 1])


def test_resampling_awkward_rows(spark):
    labels = spark.createDataFrame([(1, 1), (None, 1), (2, None), (3, 0)], "doc_id long, quality int")
    rows = resample(awkward(spark), labels).collect()
    assert len(rows) == len(awkward_rows()) and all(r["selected"] is not None for r in rows)
    assert {r["log_weight"] for r in rows if r["id"] in (2, 3)} == {0.0}
    none = resample(awkward(spark), labels.limit(0)).collect()
    assert {r["log_weight"] for r in none} == {0.0} and 9 <= sum(r["selected"] for r in none) <= 11
    assert resample(empty(spark), labels).count() == 0


def test_resampling_repeats_itself(spark):
    docs = spark.createDataFrame([(k, prose(k, 30), None, None, None, *[None] * 9) for k in range(50)], SCHEMA)
    labels = spark.createDataFrame([(k, k % 2) for k in range(50)], "doc_id long, quality int")
    assert sorted(resample(docs, labels).collect()) == sorted(resample(docs, labels).collect())
