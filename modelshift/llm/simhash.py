"""SimHash near-duplicates: fingerprints meet at the anchor points of a covering code."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORDS, Columns, connected_groups, in_slots, map_columns, slot_table, stored

SEED = 42
_SLICE = 1 << 15  # shingles whose bits are counted at once


def fingerprint(text: str, shingle: int = 3) -> int:
    """64-bit SimHash of the lower-cased (A-Z) words' shingles, as a signed integer."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    first, last = starts[:n].tolist(), ends[min(shingle, len(words)) - 1:].tolist()
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(first, last)])
    bits = np.frombuffer(hashes, dtype=np.uint8).reshape(n, 8)
    count = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _SLICE):
        count += np.unpackbits(bits[at:at + _SLICE], axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(count * 2 > n).view(">i8")[0])


class PerfectCode:
    """A perfect binary code: every word is within ``radius`` of exactly one code word.

    ``syndromes`` has the syndrome of each single bit. ``patterns(e)`` lists, by syndrome, the
    changes that lead from a word to the code words at a distance of ``radius + e`` (up to
    ``radius`` for ``e = 0``).
    """

    def __init__(self, syndromes: list[int], check_bits: int, radius: int, threshold: int):
        self.bits, self.cosets = len(syndromes), 1 << check_bits
        self._low = self._table(syndromes[:12])
        self._high = self._table(syndromes[12:])
        by: list[list[list[int]]] = [[[] for _ in range(self.cosets)] for _ in range(threshold + 1)]
        for weight in range(radius + threshold + 1):
            for chosen in combinations(range(self.bits), weight):
                s = w = 0
                for i in chosen:
                    s ^= syndromes[i]
                    w |= 1 << i
                by[max(0, weight - radius)][s].append(w)
        self.starts = [np.cumsum([0] + [len(x) for x in e]) for e in by]
        self.patterns = [np.array([w for x in e for w in x], dtype=np.int64) for e in by]

    @staticmethod
    def _table(syndromes: list[int]) -> np.ndarray:
        out = np.zeros(1 << len(syndromes), dtype=np.int64)
        for i, s in enumerate(syndromes):
            out[1 << i:2 << i] = out[:1 << i] ^ s
        return out

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        return self._low[words & 0xFFF] ^ self._high[words >> 12]


def golay(threshold: int) -> PerfectCode:
    """23 bits, radius 3: the cyclic code of x^11 + x^9 + x^7 + x^6 + x^5 + x + 1."""
    syndromes, s = [], 1
    for _ in range(23):
        syndromes.append(s)
        s = s << 1 ^ (0xAE3 if s & 0x400 else 0)
    return PerfectCode(syndromes, 11, 3, threshold)


def hamming(threshold: int) -> PerfectCode:
    """15 bits, radius 1."""
    return PerfectCode(list(range(1, 16)), 4, 1, threshold)


class Anchors:
    """Code words of a product code on 61 of the 64 bits: two Golay blocks and a Hamming block.

    The nearest anchor of a fingerprint is at most 3 + 3 + 1 bits away. A fingerprint within
    ``threshold`` bits of another therefore has that one's nearest anchor among the code words
    whose distance exceeds the blocks' radii by no more than ``threshold`` bits in all.
    """

    def __init__(self, threshold: int):
        self.threshold = threshold
        wide = golay(threshold)
        self.blocks = [(0, wide), (23, wide), (46, hamming(threshold))]

    def around(self, fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row numbers, anchors, and whether the anchor is the nearest one."""
        row = np.arange(len(fingerprints))
        anchor = np.zeros(len(row), dtype=np.int64)
        over = np.zeros(len(row), dtype=np.int64)
        for shift, code in self.blocks:
            word = fingerprints >> shift & ((1 << code.bits) - 1)
            syndrome = code.syndrome(word)
            parts = []
            for extra in range(self.threshold + 1):
                at = np.flatnonzero(over + extra <= self.threshold)
                s = syndrome[row[at]]
                first = code.starts[extra][s]
                count = code.starts[extra][s + 1] - first
                at = np.repeat(at, count)
                nth = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
                pattern = code.patterns[extra][np.repeat(first, count) + nth]
                parts.append((row[at], anchor[at] | (word[row[at]] ^ pattern) << shift,
                              over[at] + extra))
            row, anchor, over = (np.concatenate(x) for x in zip(*parts))
        return row, anchor, over == 0


def _anchor_slots(anchors: np.ndarray) -> np.ndarray:
    x = anchors.view(np.uint64)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return (x >> np.uint64(38)).astype(np.int64) % (64 * WORDS)


def fingerprint_links(prints: DataFrame, threshold: int = 2) -> DataFrame:
    """``(a, b)``: all pairs of distinct fingerprints (column ``fp``) within ``threshold`` bits.

    Every fingerprint goes once to its nearest anchor, and to all anchors that a fingerprint
    within the threshold may have as its nearest. A pair meets at the nearest anchor of the
    smaller one, and only there. Of the about 145 anchors of a fingerprint only those leave its
    task that may be some fingerprint's nearest, by a table of slots; Spark does not see how many
    rows there are, so a hint keeps it from broadcasting a side.
    """
    spark = prints.sparkSession

    def prepare_nearest():
        anchors = Anchors(0)

        def run(c: Columns) -> Columns:
            fp = np.array(c["fp"], dtype=np.int64)
            row, anchor, _ = anchors.around(fp)
            return {"anchor": anchor, "a": fp[row], "slot": _anchor_slots(anchor)}
        return run

    home = stored(map_columns(prints.select("fp").distinct(), "anchor long, a long, slot long", prepare_nearest),
                  "anchors")
    table = spark.sparkContext.broadcast(slot_table(home))  # WORDS numbers

    def prepare():
        anchors = Anchors(threshold)

        def run(c: Columns) -> Columns:
            fp = np.array(c["a"], dtype=np.int64)
            row, anchor, _ = anchors.around(fp)
            some = in_slots(table.value, _anchor_slots(anchor))
            return {"anchor": anchor[some], "b": fp[row[some]]}
        return run

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    other = map_columns(home.select("a").repartition(parts, "a"), "anchor long, b long", prepare)
    near = (F.col("a") < F.col("b")) & (
        F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold)
    return home.select("anchor", "a").hint("merge").join(other.hint("merge"), "anchor").where(near).select("a", "b")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
    threshold: int = 2,
) -> DataFrame:
    """``(id, fp, component)`` for every row; ``component`` is the smallest id of its group.

    Documents with equal fingerprints are one node, so a group of copies, however large, is
    one row in the comparison. A node has a bounded number of others within the threshold.

    A null text is empty; a text without words has fingerprint zero, which links like any other.
    Repeated rows get a row each. Null ids are never a component's smallest id; a group of rows
    with null ids alone has a null component. An empty table gives no rows.
    """
    texts = docs.select(F.col(id_col).alias("id"),
                        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def prepare():
        def run(c: Columns) -> Columns:
            return {"id": c["id"], "fp": [fingerprint(t, shingle) for t in c["text"]]}
        return run

    kind = texts.schema["id"].dataType.simpleString()
    prints = stored(map_columns(texts, f"id {kind}, fp long", prepare), "fingerprints")
    classes = prints.groupBy("fp").agg(F.min("id").alias("first"))
    groups = connected_groups(fingerprint_links(prints, threshold))
    rooted = classes.join(groups, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component"))
    named = stored(rooted.join(least, "root").select("fp", "component"), "components")
    return prints.join(named, "fp").select("id", "fp", "component")
