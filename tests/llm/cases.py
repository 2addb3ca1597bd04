"""Rows that operators must survive: nulls, empty and very long texts, ties, clashing names."""

from __future__ import annotations

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, id string, "
          "text_hash string, row int, bucket int, node int, fp string, label int, a int, b int")
PLAIN = "The quick brown fox jumps over the lazy dog while seven small birds look on from a wire."


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    syllables = "ka lo mi re tu sa ne vi do pa".split()
    return " ".join("".join(rng.choices(syllables, k=rng.randint(2, 4))) for _ in range(words))


def awkward_rows() -> list[tuple]:
    texts = [
        (1, PLAIN), (2, None), (3, ""), (4, PLAIN), (4, PLAIN), (5, prose(5, 60_000)),
        (6, "\n\n \t\n"), (None, "A text without an id, but with enough words to be a line."),
        (7, "x" * 200_000), (8, "Ünï çødé 漢字 🙂 é " * 30), (9, prose(9, 300) + "\n" + PLAIN),
        (None, None),
    ]
    return [(i, t, None, "s", None, "z", "h", 1, 2, 3, "f", 1, 4, 5) for i, t in texts]


def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def frame(spark, texts: dict):
    """Documents from ids and texts."""
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string")


def read_texts(spark, sf_dir: str) -> dict:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    return {r[0]: r[1] for r in rows}


def groups_of(nodes, linked) -> dict:
    """The smallest node of each node's connected group, by brute force."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in linked:
        a, b = find(x), find(y)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
