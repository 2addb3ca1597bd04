"""Spelling variants: words one edit apart, from k-d trees over letter counts.

One edit changes the letter counts of a word by at most two in all: a replaced letter takes one
from a letter and adds one to another, an inserted letter adds one. So, for each length, the
words' count vectors form a k-d tree, and a word is searched in the tree of its own length (one up,
one down) and in that of the next length (one up). Boxes that would need more are pruned. Words of
equal counts are one point; points that match are compared by the order of their letters.

The upper part of each tree deals the words out over the cluster: a word lies in one leaf, and is
sent as a question to the few leaves that its search reaches.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

LETTERS = "A-Za-zÀ-ÿ"
FIRST = 0xC0  # of the letters beyond ASCII
LETTER_COUNT = 26 + 64
SAMPLE = 20_000  # words that the upper trees are cut by
LEAF = 2_000  # words of a leaf that is dealt out, by the sample
FEWEST = 8  # words of the sample in such a leaf
POINTS = 32  # points that are compared one by one
KEPT = 500_000  # different words that a task adds up before it hands them on
WIDE = np.iinfo(np.int32).max

_COLUMN = np.full(256, -1)  # the column of each code point
_COLUMN[ord("a"):ord("z") + 1] = np.arange(26)
_COLUMN[FIRST:] = np.arange(26, LETTER_COUNT)
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def count_words(docs: DataFrame, id_col: str, text_col: str, min_letters: int, typo_every: int) -> DataFrame:
    """``(word, n)`` over all documents, added up within tasks before the shuffle.

    A null id is written as nothing before the colon of the hashed key.
    """
    runs = re.compile(f"[{LETTERS}]{{{min_letters},}}")  # shorter ones never count

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def handed_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for name, text in zip(batch["id"].to_pylist(), batch["text"].to_pylist()):
                key = zlib.crc32(f"{name}:".encode())
                for word, n in Counter(runs.findall(text)).items():
                    word = word.lower() if word.isascii() else word.translate(_LOWER)
                    h = zlib.crc32(word.encode(), key)
                    if h % typo_every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < min_letters:
                            continue
                    total[word] += n
                if len(total) > KEPT:
                    yield handed_on()
        yield handed_on()

    texts = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
                        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def letter_counts(words: list[str]) -> np.ndarray:
    """A row of letter counts for each word."""
    letters = _COLUMN[np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8)]
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    out = np.bincount(row * LETTER_COUNT + letters, minlength=len(words) * LETTER_COUNT)
    return out.reshape(len(words), LETTER_COUNT).astype(np.int32)


def within(points: np.ndarray, low: np.ndarray, high: np.ndarray, down: int) -> np.ndarray:
    """Which points can enter the box with one letter more and ``down`` letters less."""
    more = np.maximum(low - points, 0).sum(axis=1)
    less = np.maximum(points - high, 0).sum(axis=1)
    return (more <= 1) & (less <= down)


def split(points: np.ndarray) -> tuple[int, int] | None:
    """The letter that varies most and the count it is cut after; none for equal points."""
    spread = points.var(axis=0)
    letter = int(spread.argmax())
    return (letter, int(points[:, letter].mean())) if spread[letter] > 0 else None


@dataclass
class Tree:
    """The upper part of a k-d tree: a split for each inner node, a number for each leaf."""

    nodes: list[tuple[int, int, int, int]]  # letter (none: -1), cut, left node, right node

    @classmethod
    def cut(cls, points: np.ndarray, largest: float) -> Tree:
        """Cut until a node holds no more than ``largest`` of the points."""
        tree, todo = cls([(-1, 0, 0, 0)]), [(0, points)]
        while todo:
            node, some = todo.pop()
            at = split(some) if len(some) > max(largest, FEWEST) else None
            if at is not None:
                left = len(tree.nodes)
                tree.nodes[node] = (*at, left, left + 1)
                tree.nodes += [(-1, 0, 0, 0)] * 2
                below = some[:, at[0]] <= at[1]
                todo += [(left, some[below]), (left + 1, some[~below])]
        return tree

    def leaves(self, points: np.ndarray, down: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """Each leaf with the points that lie in it or, given ``down``, whose search reaches it."""
        low, high = np.full(LETTER_COUNT, -1, np.int32), np.full(LETTER_COUNT, WIDE, np.int32)
        todo = [(0, np.arange(len(points)), low, high)]
        while todo:
            node, some, low, high = todo.pop()
            letter, cut, left, right = self.nodes[node]
            if down is not None:
                some = some[within(points[some], low, high, down)]
            if not len(some):
                continue
            if letter < 0:
                yield node, some
                continue
            upto, beyond = high.copy(), low.copy()
            upto[letter], beyond[letter] = cut, cut + 1
            below = points[some, letter] <= cut
            todo.append((left, some[below] if down is None else some, low, upto))
            todo.append((right, some[~below] if down is None else some, beyond, high))


def matches(data: np.ndarray, asked: np.ndarray, down: int) -> Iterator[tuple[int, int]]:
    """``(asked, data)`` points that differ by one letter more and exactly ``down`` less.

    The lower part of the tree, with the tight box of the points at every node.
    """
    todo = [(np.arange(len(data)), np.arange(len(asked)))]
    while todo:
        some, who = todo.pop()
        points = data[some]
        who = who[within(asked[who], points.min(axis=0), points.max(axis=0), down)]
        if not len(who):
            continue
        at = split(points) if len(some) > POINTS else None
        if at is not None:
            below = points[:, at[0]] <= at[1]
            todo += [(some[below], who), (some[~below], who)]
            continue
        for k, point in zip(some.tolist(), points):
            apart = point - asked[who]
            found = (np.maximum(apart, 0).sum(axis=1) == 1) & (np.maximum(-apart, 0).sum(axis=1) == down)
            yield from ((q, k) for q in who[found].tolist())


def edited(asked: list[str], data: list[str], gained: str, lost: str | None) -> set[tuple[str, str]]:
    """The pairs that one edit apart: words of ``data`` have ``gained`` where the others have ``lost``.

    Each word is looked up without that letter, so large groups of equal counts form no pairs.
    """
    without = defaultdict(list)
    for word in asked:
        if lost is None:
            without[word].append(word)
        else:
            for p in (m.start() for m in re.finditer(lost, word)):
                without[word[:p], word[p + 1:]].append(word)
    out = set()
    for word in data:
        for p in (m.start() for m in re.finditer(gained, word)):
            key = word[:p] + word[p + 1:] if lost is None else (word[:p], word[p + 1:])
            out.update((a, word) for a in without.get(key, ()))
    return out


def _letter(column: int) -> str:
    return chr(ord("a") + column if column < 26 else FIRST + column - 26)


def _points(words: list[str]) -> tuple[np.ndarray, list[list[str]]]:
    """The different letter counts, and the words of each."""
    held: dict[bytes, list[str]] = defaultdict(list)
    for word, row in zip(words, letter_counts(words)):
        held[row.tobytes()].append(word)
    return np.frombuffer(b"".join(held), np.int32).reshape(-1, LETTER_COUNT), list(held.values())


LIVES, ASKS, SHORTER = 0, 1, 2  # a word in its leaf (and asking there); in another; in the next length


def near_in_leaf(words: list[str], role: list[int]) -> list[tuple[str, str]]:
    """``(word, near word)`` for what one leaf knows of: its own words against all that ask."""
    data = _points([w for w, r in zip(words, role) if r == LIVES])
    out = []
    for down, who in ((1, (LIVES, ASKS)), (0, (SHORTER,))):
        asked = _points([w for w, r in zip(words, role) if r in who])
        for q, k in matches(data[0], asked[0], down):
            apart = data[0][k] - asked[0][q]
            lost = _letter(int(apart.argmin())) if down else None
            found = edited(asked[1][q], data[1][k], _letter(int(apart.argmax())), lost)
            out += found if down else [p for a, b in found for p in ((a, b), (b, a))]
    return out


def near_words(words: DataFrame) -> DataFrame:
    """``(word, n, near, near_n)``: each word of ``(word, n)`` with each that is one edit away."""
    sized = words.select("word", "n", F.length("word").alias("size"))
    sizes = {r["size"]: r["count"] for r in sized.groupBy("size").count().toLocalIterator()}
    sample = defaultdict(list)
    for r in sized.select("word", "size").orderBy(F.xxhash64("word"), "word").limit(SAMPLE).collect():
        sample[r["size"]].append(r["word"])
    trees = {}
    for size, n in sizes.items():
        some = sample.get(size, [])
        trees[size] = Tree.cut(letter_counts(some), LEAF * len(some) / n)
    shared = words.sparkSession.sparkContext.broadcast(trees)  # at most SAMPLE leaves and the lengths

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for batch in batches:
            all_words, size = batch["word"], batch["size"].to_numpy()
            for length in np.unique(size).tolist():
                at = np.flatnonzero(size == length)
                points = letter_counts(all_words.take(pa.array(at)).to_pylist())
                here = [(length, LIVES, x) for x in trees[length].leaves(points)]
                lives = np.full(len(at), -1)
                for _, _, (leaf, some) in here:
                    lives[some] = leaf
                here += [(length, ASKS, (leaf, some[lives[some] != leaf]))
                         for leaf, some in trees[length].leaves(points, 1)]
                if length + 1 in trees:
                    here += [(length + 1, SHORTER, x) for x in trees[length + 1].leaves(points, 0)]
                for tree, role, (leaf, some) in here:
                    rows = [batch[c].take(pa.array(at[some])) for c in ("word", "n")]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(some), x), pa.int32()) for x in (tree, leaf, role)]
                        + rows, ["tree", "leaf", "role", "word", "n"])

    def search(rows: pa.Table) -> pa.Table:
        words = rows["word"].to_pylist()
        n = dict(zip(words, rows["n"].to_pylist()))
        found = near_in_leaf(words, rows["role"].to_pylist())
        return pa.table({
            "word": pa.array([a for a, _ in found], pa.string()),
            "n": pa.array([n[a] for a, _ in found], pa.int64()),
            "near": pa.array([b for _, b in found], pa.string()),
            "near_n": pa.array([n[b] for _, b in found], pa.int64())})

    dealt = sized.mapInArrow(deal, "tree int, leaf int, role int, word string, n long")
    return dealt.groupBy("tree", "leaf").applyInArrow(
        search, "word string, n long, near string, near_n long")


def spelling_variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_letters: int = 6,
    min_count: int = 5, times: int = 5, typo_every: int = 199,
) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word of the documents.

    Words are the maximal runs of ASCII and Latin-1 letters, A-Z lower-cased. In a document
    where ``typo_every`` divides the CRC-32 of ``<id>:<run>``, the run loses the letter at that number modulo its length.
    Kept are words of at least ``min_letters`` that occur ``min_count`` times. Words are near if
    one inserted, deleted or replaced letter makes them equal. ``form`` is the near word that
    occurs most (ties: the first by code points), if ``times`` as often as the word;
    ``root`` is where the forms lead to, the word itself if nowhere.

    A null text has no words. Rows that repeat count again. An empty table gives no rows. Very
    long words and texts are taken whole. Only a sample's words, the lengths that occur and the
    trees' cuts go through the driver; the sample decides where words are sent to, not what is found.
    """
    words = stored(count_words(docs, id_col, text_col, min_letters, typo_every)
                   .where(F.col("n") >= min_count), "words")
    best = near_words(words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best"))
    often = -F.col("best.n") >= F.col("n") * times
    formed = stored(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(often, F.col("best.near")).alias("form"), F.when(often, -F.col("best.n")).alias("form_n")), "forms")

    # Every step follows twice as many forms; counts grow along them, so they end.
    roots = stored(formed.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = stored(roots.join(further, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(roots)
        roots, done = after.drop("moved"), not after.where("moved").take(1)
        if done:
            break
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
