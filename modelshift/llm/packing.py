"""Packing of documents into token sequences: dominance reduction, then best fit."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Columns, map_columns, stored

END = b"\0\0\0\0"  # id 0 ends every document
CACHED_WORDS = 250_000  # twice as many are kept at most
CACHED_LENGTH = 48
ROWS_PER_BUCKET = 100_000


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level tokenizers write for bytes; printable bytes stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


@lru_cache(maxsize=1)  # a worker's later tasks find the words of the earlier ones
def run_encoders(
    tokenizer_json: str,
) -> tuple[Callable[[str], bytes], Callable[[str], bytes], list[str]]:
    """Runs without spaces to ids as little-endian unsigned 32-bit integers.

    One function for runs whose A-Z are lower-cased, one for runs that hold a special token as it
    is spelt, and those tokens. The tokenizer lower-cases, drops white space, and no token spans it, so each run between
    spaces and line ends is encoded once and remembered. A run of lower-case letters in normal
    form is one word, and goes to the model without the steps before it; so does one that signs
    follow, which are a word of their own. A special token written out in a text gets its own id,
    in exactly its spelling; such runs go to the tokenizer as they are.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(tokenizer_json)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values() if t.special]
    tokenizer.encode_special_tokens = True  # runs come lower-cased here
    model, letters = tokenizer.model, _byte_letters()
    signs_after = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]+)").fullmatch  # but for '
    recent: dict[str, bytes] = {"": b""}
    older: dict[str, bytes] = {}

    def look_up(run: str) -> bytes:
        nonlocal recent, older
        found = older.get(run)
        if found is None:
            if run.isascii() and run.isalpha():
                found = array("I", [t.id for t in model.tokenize(run)]).tobytes()
            elif run.isalpha() and is_normalized("NFC", run):
                low = "".join(map(str.lower, run))
                if low == run:
                    word = run.encode().decode("latin-1").translate(letters)
                    found = array("I", [t.id for t in model.tokenize(word)]).tobytes()
                elif low.isalpha() and is_normalized("NFC", low):
                    found = get(low)
            elif (m := signs_after(run)) and m[1][-1].lower().isalpha():
                found = get(m[1]) + get(m[2])
            if found is None:
                found = array("I", tokenizer.encode(run, add_special_tokens=False).ids).tobytes()
        if len(run) <= CACHED_LENGTH:
            if len(recent) >= CACHED_WORDS:
                older, recent = recent, {"": b""}
            recent[run] = found
        return found

    def get(run: str) -> bytes:
        found = recent.get(run)
        return look_up(run) if found is None else found

    def as_it_is(run: str) -> bytes:
        tokenizer.encode_special_tokens = False
        ids = tokenizer.encode(run, add_special_tokens=False).ids
        tokenizer.encode_special_tokens = True
        return array("I", ids).tobytes()

    return get, as_it_is, special


def word_encoder(tokenizer_json: str) -> Callable[[str], bytes]:
    """Text to ids as little-endian unsigned 32-bit integers."""
    get, as_it_is, special = run_encoders(tokenizer_json)

    def encode(text: str) -> bytes:
        if any(s in text for s in special):
            return b"".join(
                as_it_is(run) if any(s in run for s in special) else encode(run)
                for run in text.replace("\n", " ").split(" "))
        runs = text.encode("utf-8", "replace").lower().decode().replace("\n", " ").split(" ")
        return b"".join(map(get, runs))

    return encode


def token_pieces(
    docs: DataFrame, tokenizer_json: str, id_col: str, text_col: str, capacity: int,
    with_ids: bool = False,
) -> DataFrame:
    """``(id, piece, start, length, ids_crc32[, ids])``: each document's ids and its end mark."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)  # one vocabulary file

    def prepare():
        encode = word_encoder(shared.value)

        def run(c: Columns) -> Columns:
            out: Columns = {k: [] for k in ("id", "piece", "start", "length", "ids_crc32", "ids")}
            for doc, text in zip(c["id"], c["text"]):
                ids = encode(text) + END
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    out["id"].append(doc)
                    out["piece"].append(piece)
                    out["start"].append(at // 4)
                    out["length"].append(len(part) // 4)
                    out["ids_crc32"].append(zlib.crc32(part))
                    if with_ids:
                        out["ids"].append(part)
            return out
        return run

    texts = docs.select(F.col(id_col).alias("id"),
                        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = (f"id {texts.schema['id'].dataType.simpleString()}, piece int, start long, "
              "length long, ids_crc32 long") + (", ids binary" if with_ids else "")
    return map_columns(texts, schema, prepare)


@dataclass
class Plan:
    """Which sequence the n-th piece of each length goes to.

    A run ``(length, first, last, per, sequence, offset)`` puts the pieces of that length with
    ranks ``first`` to ``last - 1``, ``per`` to a sequence, into ``sequence`` and those after it,
    from ``offset`` on. The number of runs depends on the capacity alone: each length splits at
    most three open ranges, and a range's room halves at least whenever a run fills it.
    """

    capacity: int
    left: dict[int, int]
    runs: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    used: dict[int, int] = field(default_factory=dict)
    sequences: int = 0

    def put(self, length: int, n: int, per: int, sequence: int, offset: int) -> None:
        first = self.used.get(length, 0)
        self.runs.append((length, first, first + n, per, sequence, offset))
        self.used[length] = first + n
        self.left[length] -= n

    def fix(self, j: int, i: int | None, n: int) -> None:
        """``n`` sequences for good: a piece of length ``j``, and one of length ``i``."""
        self.put(j, n, 1, self.sequences, 0)
        if i is not None:
            self.put(i, n, 1, self.sequences, j)
        self.sequences += n

    def reduce(self) -> None:
        """Fix sets that dominate every other set with their longest piece (Martello and Toth).

        For a piece j, let i be the longest other piece that fits beside it. {j} dominates if
        nothing fits; {j, i} if they fill the sequence, if no two pieces fit beside j, or if at
        most two fit and no two together are longer than i. Any packing can then be changed to
        hold the set without needing another sequence.
        """
        for j in sorted(self.left, reverse=True):
            while self.left[j]:
                room = self.capacity - j
                self.left[j] -= 1
                small = self._smallest(3)
                i = max((x for x, n in self.left.items() if n and x <= room), default=None)
                pair = 0
                if i is not None and len(small) == 3 and sum(small) > room >= small[0] + small[1]:
                    pair = self._best_pair(room)
                elif i is not None and len(small) == 2 and sum(small) <= room:
                    pair = sum(small)
                two = len(small) > 1 and small[0] + small[1] <= room
                three = len(small) > 2 and sum(small) <= room
                self.left[j] += 1
                if i is None:
                    self.fix(j, None, self.left[j] if 2 * j > self.capacity else 1)
                elif i == room or not two or (not three and i >= pair):
                    n = self.left[j] // 2 if i == j else min(self.left[j], self.left[i])
                    self.fix(j, i, max(1, n))
                else:
                    break

    def _smallest(self, k: int) -> list[int]:
        out: list[int] = []
        for x in sorted(x for x, n in self.left.items() if n):
            out += [x] * min(self.left[x], k - len(out))
            if len(out) == k:
                break
        return out

    def _best_pair(self, room: int) -> int:
        lengths = sorted(x for x, n in self.left.items() if n)
        best, hi = 0, len(lengths) - 1
        for lo, a in enumerate(lengths):
            while hi >= lo and a + lengths[hi] > room:
                hi -= 1
            if hi < lo:
                break
            b = lengths[hi]
            if b == a and self.left[a] < 2:
                continue
            best = max(best, a + b)
        return best

    def best_fit(self) -> None:
        """Longest first, each piece into the fullest sequence that can take it."""
        open_: dict[int, list[tuple[int, int]]] = {}  # room: ranges of sequences
        rooms = 0  # bit r: a range with room r

        def add(room: int, lo: int, hi: int) -> None:
            nonlocal rooms
            if room and hi > lo:
                open_.setdefault(room, []).append((lo, hi))
                rooms |= 1 << room

        for s in sorted(self.left, reverse=True):
            while n := self.left[s]:
                fitting = rooms >> s
                if fitting:
                    room = (fitting & -fitting).bit_length() - 1 + s
                    lo, hi = open_[room].pop()
                    if not open_[room]:
                        rooms &= ~(1 << room)
                else:
                    room, lo = self.capacity, self.sequences
                    hi = lo + -(-n // (room // s))
                    self.sequences = hi
                per = min(room // s, n)
                m = min(hi - lo, n // per)
                self.put(s, per * m, per, lo, self.capacity - room)
                add(room - per * s, lo, lo + m)
                add(room, lo + m, hi)


def make_plan(lengths: Mapping[int, int], capacity: int) -> Plan:
    """The plan for so many pieces of each length; reads no more than ``capacity`` numbers."""
    plan = Plan(capacity, dict(lengths))
    plan.reduce()
    plan.best_fit()
    return plan


def pack(
    docs: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text",
    capacity: int = 2048,
) -> DataFrame:
    """``(id, piece, start, length, ids_crc32, sequence_id, offset)`` of every piece.

    A null text is empty; an empty text is one piece that holds its end mark. Very long texts are
    cut into pieces of ``capacity`` ids and a shorter last one. Repeated rows are packed each for
    itself; pieces that agree in all columns may swap places. A null id is kept. An empty table
    gives no rows.

    Only the number of pieces of each length (at most ``capacity`` rows) goes to the driver, and
    the plan made from it back to the tasks. The n-th piece of a length is found by counting
    pieces by hashed bucket, so that no task sees more than one bucket of a length.
    """
    spark = docs.sparkSession
    pieces = stored(token_pieces(docs, tokenizer_json, id_col, text_col, capacity), "pieces")
    lengths = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = make_plan(lengths, capacity)
    by_length: dict[int, list] = {}
    for run in sorted(plan.runs):
        by_length.setdefault(run[0], []).append(run[1:])
    shared = spark.sparkContext.broadcast(
        {k: np.array(v, dtype=np.int64) for k, v in by_length.items()})

    buckets = -(-sum(lengths.values()) // ROWS_PER_BUCKET) or 1
    hashed = pieces.withColumn(
        "bucket", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    base = hashed.groupBy("length", "bucket").count().select(
        "length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "bucket").orderBy("id", "piece", "ids_crc32")
    ranked = (
        hashed.withColumn("place", F.row_number().over(inside) - 1)
        .join(base, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("place"))
        .select("id", "piece", "start", "length", "ids_crc32", "rank")
    )

    def prepare():
        runs = shared.value

        def place(c: Columns) -> Columns:
            length = np.array(c["length"], dtype=np.int64)
            rank = np.array(c["rank"], dtype=np.int64)
            sequence, offset = np.empty_like(rank), np.empty_like(rank)
            for n in np.unique(length):
                at, table = np.flatnonzero(length == n), runs[int(n)]
                row = table[np.searchsorted(table[:, 0], rank[at], side="right") - 1]
                nth = rank[at] - row[:, 0]
                sequence[at] = row[:, 3] + nth // row[:, 2]
                offset[at] = row[:, 4] + nth % row[:, 2] * n
            return c | {"sequence_id": sequence, "offset": offset}
        return place

    kind = pieces.schema["id"].dataType.simpleString()
    return map_columns(ranked, f"id {kind}, piece int, start long, length long, ids_crc32 long, "
                               "sequence_id long, offset long", prepare)


def sequences(
    docs: DataFrame, placed: DataFrame, tokenizer_json: str, id_col: str = "doc_id",
    text_col: str = "text", capacity: int = 2048,
) -> DataFrame:
    """``(sequence_id, ids)``: the token ids of each sequence, for what ``pack`` placed."""
    tokens = token_pieces(docs, tokenizer_json, id_col, text_col, capacity, with_ids=True)
    tokens = tokens.select("id", "piece", "ids_crc32", "ids").dropDuplicates(
        ["id", "piece", "ids_crc32"])
    held = placed.withColumnRenamed("id", "_id").join(
        tokens.withColumnsRenamed({"piece": "_piece", "ids_crc32": "_crc"}),
        F.col("_id").eqNullSafe(F.col("id")) & (F.col("piece") == F.col("_piece"))
        & (F.col("ids_crc32") == F.col("_crc")))
    joined = held.groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))

    def prepare():
        def run(c: Columns) -> Columns:
            whole = [b"".join(p["ids"] for p in parts) for parts in c["parts"]]
            return {"sequence_id": c["sequence_id"],
                    "ids": [np.frombuffer(b, "<u4").astype(np.int32) for b in whole]}
        return run

    return map_columns(joined, "sequence_id long, ids array<int>", prepare)


def tokenizer_text(path: str) -> str:
    """The tokenizer file's content, checked to be JSON."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    json.loads(text)
    return text
