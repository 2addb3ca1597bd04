"""Toxicity: boosted trees over dense text features, calibrated by isotonic regression."""

from __future__ import annotations

import math
import re

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import Columns, map_columns, stored

# Abusive words in the four languages of the documents.
LEXICON = (
    "idiot idiots moron morons imbecile stupid dumb fool fools clown loser losers scum trash "
    "garbage pathetic worthless disgusting filthy vermin pig swine bastard bitch retard freak "
    "creep jerk liar coward parasite hate despise kill die ugly useless degenerate "
    "idiota imbecil estupido tonto basura asqueroso perdedor escoria payaso "
    "imbecile debile cretin ordure dechet minable nul degoutant salaud connard "
    "dumm dummkopf trottel abschaum abfall widerlich versager arschloch"
).split()
# Second-person words in the same languages.
SECOND_PERSON = (
    "you your yours yourself u ur tu te ti tus usted ustedes vous votre vos toi ton "
    "du dich dir dein deine ihr euch"
).split()
# Signs that stand for letters in disguised words.
DISGUISE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

NEAR = 5  # words between an abusive word and a second-person word
FEATURES = (
    "log_words", "lexicon_hits", "lexicon_density", "learned_hits", "learned_density",
    "disguised_hits", "disguised_density", "second_person", "near_second_person",
    "capitals", "shouted", "punctuation", "exclamations", "sign_runs", "obfuscation", "digits",
)

_UPPER = bytes(range(65, 91))
_PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_DIGITS = b"0123456789"
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if chr(b).isalnum() or b >= 128 else 32
               for b in range(256))
_MIXED = re.compile(r"(?<!\S)(?=\S*[A-Za-z])(?=\S*[A-Za-z][0-9@$!*._-]+[A-Za-z]|[0-9@$][A-Za-z])"
                    r"[A-Za-z0-9@$!*._-]{3,40}(?!\S)")
_SPACED = re.compile(r"(?<!\S)[A-Za-z](?:[ .*_-][A-Za-z]){3,20}(?![A-Za-z0-9])")
_RUN = re.compile(rb"[!?*#$%&.]{2,}")


def words_of(text: str) -> list[bytes]:
    """Lower-cased words of letters and digits, as UTF-8."""
    return text.encode("utf-8", "replace").translate(_PLAIN).split()


def _undisguise(word: str) -> bytes:
    letters = "".join(DISGUISE.get(c, c) for c in word.lower())
    letters = "".join(c for c in letters if c.isalpha())
    return letters.encode()


def features(text: str, lexicon: frozenset, learned: frozenset, second: frozenset) -> list[float]:
    """The numbers in ``FEATURES`` for one whole text; zeros where there are no words."""
    raw = text.encode("utf-8", "replace")
    words = raw.translate(_PLAIN).split()
    n, size = max(1, len(words)), max(1, len(raw))
    hits = [i for i, w in enumerate(words) if w in lexicon]
    taught = sum(w in learned for w in words)
    persons = [i for i, w in enumerate(words) if w in second]
    near, j = 0, 0
    for i in hits:
        while j < len(persons) and persons[j] < i - NEAR:
            j += 1
        near += j < len(persons) and persons[j] <= i + NEAR
    mixed = _MIXED.findall(text)
    forms = [_undisguise(w) for w in mixed] + [_undisguise(w) for w in _SPACED.findall(text)]
    disguised = sum(f in lexicon or f in learned for f in forms)
    capitals = size - len(raw.translate(None, _UPPER))
    signs = size - len(raw.translate(None, _PUNCTUATION))
    digits = size - len(raw.translate(None, _DIGITS))
    shouted = sum(w.isupper() and len(w) > 2 for w in text.split()) if capitals > 0.1 * size else 0
    return [
        math.log1p(len(words)), float(len(hits)), len(hits) / n, float(taught), taught / n,
        float(disguised), disguised / n, len(persons) / n, near / n, capitals / size,
        shouted / n, signs / size, raw.count(b"!") / size, len(_RUN.findall(raw)) / n,
        len(mixed) / n, digits / size,
    ]


def labelled_sample(labels: DataFrame, id_col: str, label_col: str, max_rows: int) -> DataFrame:
    """At most ``max_rows`` training labels: rows whose crc32(id) mod 3 is not 1, by hash order."""
    return (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label"))
        .where(~held_out("id"))
        .orderBy(F.xxhash64("id"), "id", "label").limit(max_rows)
    )


def held_out(id_col: str):
    crc = F.crc32(F.col(id_col).cast("string").cast("binary"))
    return F.coalesce(crc % 3 == 1, F.lit(False))


def learn_lexicon(texts: DataFrame, min_rows: int = 5, min_z: float = 6.0,
                  max_words: int = 400) -> list[str]:
    """Words that toxic training rows hold far more often than the others (two-share z-score).

    ``texts`` has ``label`` and ``text``. A word counts once in a row. At most ``max_words``.
    """
    def prepare():
        def count(c: Columns) -> Columns:
            seen: dict[bytes, list[int]] = {}
            for label, text in zip(c["label"], c["text"]):
                for w in set(words_of(text)):
                    if len(w) <= 40:
                        seen.setdefault(w, [0, 0])[label > 0.5] += 1
            pairs = [(w.decode("utf-8", "replace"), a, b) for w, (a, b) in seen.items()]
            return dict(zip(("word", "clean", "toxic"), zip(*pairs))) if pairs else {
                "word": [], "clean": [], "toxic": []}
        return count

    totals = texts.agg(F.count("*").alias("n"), F.sum("label").alias("toxic")).first()
    n_toxic = float(totals["toxic"] or 0)
    n_clean = float(totals["n"]) - n_toxic
    if not n_toxic or not n_clean:
        return []
    counts = (
        map_columns(texts, "word string, clean long, toxic long", prepare)
        .groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .where(F.col("toxic") >= min_rows)
    )
    share = (F.col("clean") + F.col("toxic")) / (n_clean + n_toxic)
    z = (F.col("toxic") / n_toxic - F.col("clean") / n_clean) / F.sqrt(
        share * (1 - share) * (1 / n_toxic + 1 / n_clean) + 1e-12)
    lift = (F.col("toxic") / n_toxic) / ((F.col("clean") + 0.5) / n_clean)
    rows = counts.where((z >= min_z) & (lift >= 3)).orderBy(z.desc(), "word").limit(max_words)
    return [r["word"] for r in rows.select("word").collect()]


def score_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "toxic", max_train_rows: int = 60_000, trees: int = 40, depth: int = 4,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """``(id, text_hash, held_out, score)`` for every row of ``docs``; ``score`` is a calibrated
    probability, ``text_hash`` tells rows apart that share an id.

    Columns of ``docs`` named in ``carry`` come along in the struct ``row``, so that a row needs no
    join with its score; they are stored with the features.

    The model reads only features of the whole text. It is fitted on at most ``max_train_rows``
    labels, never on a row whose crc32(id) mod 3 is 1; a quarter of them is kept from the trees
    to fit the isotonic curve. The sample is bounded, so it is broadcast to the documents.

    A null text is empty; an empty text has zero features and is scored like any other. Repeated
    rows get equal scores. A null id is never trained on and not held out. If the rows for the trees
    lack one of the two classes, every score is the share of toxic labels (0 without labels).
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    sample = stored(labelled_sample(labels, id_col, label_col, max_train_rows), "labels")
    learned = learn_lexicon(texts.join(F.broadcast(sample), "id").select("label", "text"))

    def prepare():
        lexicon = frozenset(w.encode() for w in LEXICON)
        second = frozenset(w.encode() for w in SECOND_PERSON)
        taught = frozenset(w.encode() for w in learned)

        def run(c: Columns) -> Columns:
            rows = [features(t or "", lexicon, taught, second) for t in c["text"]]
            return {"id": c["id"], "text_hash": c["text_hash"], **dict(zip(FEATURES, zip(*rows) if rows else [[]] * len(FEATURES)))}
        return run

    kind = texts.schema["id"].dataType.simpleString()
    schema = f"id {kind}, text_hash long, " + ", ".join(f"{f} double" for f in FEATURES)
    # A text that is carried travels once, null or not.
    once = text_col in carry and docs.schema[text_col].dataType == StringType()
    others = [c for c in carry if not (once and c == text_col)]
    hashed = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"),
        (F.col(text_col) if once else text).alias("text"),
        *([F.struct(*others).alias("_row")] if others else []))
    carried = (*(["text"] if once else []), *(["_row"] if others else []))
    rows = stored(map_columns(hashed, schema, prepare, carried), "features")
    row = [F.struct(*[
        (F.col("text") if c not in others else F.col("_row")[c]).alias(c) for c in carry]).alias("row")] if carry else []
    # Stored by itself, since the trees go over it many times and need no task for each part of the texts.
    train = stored(rows.join(F.broadcast(sample), "id").select("id", "label", *FEATURES), "train-features")
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    rows, train = assembler.transform(rows), assembler.transform(train).select("id", "label", "features")
    curve = F.pmod(F.xxhash64(F.lit("curve"), "id"), F.lit(4)) == 0
    counts = {(r["curve"], r["label"]): r["count"] for r in
              train.select(curve.alias("curve"), "label").groupBy("curve", "label").count().collect()}
    if not (counts.get((False, 0.0)) and counts.get((False, 1.0))):
        toxic = sum(n for (_, label), n in counts.items() if label)
        share = toxic / max(1, sum(counts.values()))
        return rows.select("id", "text_hash", held_out("id").alias("held_out"), F.lit(share).alias("score"), *row)
    # With too few rows apart, the curve is fitted on all of them.
    for_curve = train.where(curve) if all(counts.get((True, x)) for x in (0.0, 1.0)) else train
    gbt = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.15, subsamplingRate=0.8, seed=17,
                        minInstancesPerNode=5, checkpointInterval=-1)
    model = gbt.fit(train.where(~curve))
    raw = vector_to_array("rawPrediction")[1]
    isotonic = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="score")
    fitted = isotonic.fit(model.transform(for_curve).select(raw.alias("raw"), "label"))
    scored = model.transform(rows).select("id", "text_hash", raw.alias("raw"), *row)
    # Between equal steps of the curve the trees still order the texts, by a thousandth at most.
    tie = F.lit(0.001) * (F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("raw"))))
    score = F.col("score") * 0.999 + tie
    return fitted.transform(scored).select(
        "id", "text_hash", held_out("id").alias("held_out"), score.alias("score"), *(["row"] if carry else []))
