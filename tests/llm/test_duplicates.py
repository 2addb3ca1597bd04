"""Line dedup, SimHash groups and repeated passages against brute force."""

import re
import unicodedata
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from modelshift.llm.common import connected_groups
from modelshift.llm.lines import ALL_WORDS, STRETCH, _lines, _most_edits, dedup_lines, line_features
from modelshift.llm.simhash import fingerprint_links, near_duplicates
from modelshift.llm.suffixes import Suffixes, _rolled, repeated_passages

from .cases import PLAIN, awkward, awkward_rows, empty, frame, groups_of, prose, read_texts


def hash64(s: str) -> int:
    return xxhash.xxh64_intdigest(s.encode(), 42)


def majority(hashes: list[int]) -> int:
    count = np.zeros(64, dtype=int)
    for at in range(0, len(hashes), 10_000):
        some = np.array(hashes[at:at + 10_000], dtype=np.uint64)
        count += (some[:, None] >> np.arange(64, dtype=np.uint64) & np.uint64(1)).sum(axis=0).astype(int)
    return sum(1 << b for b in range(64) if count[b] * 2 > len(hashes))


def lower(s: str) -> str:
    return re.sub("[A-Z]", lambda m: m.group().lower(), s)


# ---- connected groups ------------------------------------------------------------------

@pytest.mark.parametrize("links", [
    [(i, i + 1) for i in range(40)],
    [(0, i) for i in range(1, 50)],
    [(i, 99) for i in range(50)] + [(200, 201), (201, 202), (7, 7)],
    [],
])
def test_connected_groups(spark, links):
    got = connected_groups(spark.createDataFrame(links, "a long, b long")).collect()
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert len(got) == len(nodes)
    assert {r["node"]: r["root"] for r in got} == groups_of(nodes, [x for x in links if x[0] != x[1]])


# ---- SimHash ---------------------------------------------------------------------------

def brute_fingerprint(text: str) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return 0
    return majority([hash64(" ".join(words[i:i + 3])) for i in range(max(1, len(words) - 2))])


def brute_components(texts: dict) -> dict:
    prints = {i: brute_fingerprint(t or "") for i, t in texts.items()}
    ids = sorted(prints)
    linked = [(x, y) for k, x in enumerate(ids) for y in ids[k + 1:]
              if (prints[x] ^ prints[y]).bit_count() <= 2]
    return {i: (prints[i], g) for i, g in groups_of(ids, linked).items()}


def unsigned(x: int) -> int:
    return x & (1 << 64) - 1


def test_simhash_equals_brute_force(spark, sf_dir):
    texts = read_texts(spark, sf_dir)
    got = {r["id"]: (unsigned(r["fp"]), r["component"])
           for r in near_duplicates(frame(spark, texts)).collect()}
    assert got == brute_components(texts)


def test_links_at_one_and_two_bits_are_all_found(spark):
    rng = np.random.default_rng(3)
    prints = {0}
    for base in rng.integers(0, 1 << 63, 60, dtype=np.uint64).tolist():
        prints.add(base)
        for _ in range(6):
            i, j, k = rng.integers(0, 64, 3).tolist()
            prints |= {base ^ 1 << i, base ^ 1 << i ^ 1 << j, base ^ 1 << i ^ 1 << j ^ 1 << k}
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    expected = {(x, y) for n, x in enumerate(signed) for y in signed[n + 1:]
                if unsigned(x ^ y).bit_count() <= 2}
    got = [tuple(r) for r in fingerprint_links(
        spark.createDataFrame([(p,) for p in signed], "fp long")).collect()]
    assert len(got) == len(set(got)) and set(got) == expected


def test_simhash_awkward_rows(spark):
    rows = near_duplicates(awkward(spark)).collect()
    assert len(rows) == len(awkward_rows())
    by = defaultdict(set)
    for r in rows:
        by[r["id"]].add((r["fp"], r["component"]))
    assert by[2] == by[3] == by[6] == {(0, 2)}  # no words: fingerprint zero
    assert by[1] == by[4] and next(iter(by[1]))[1] == 1
    assert (0, 2) in by[None] and len(by[None]) == 2
    assert next(c for f, c in by[None] if f) is None
    assert near_duplicates(empty(spark)).count() == 0


# ---- lines -----------------------------------------------------------------------------

def normal(line: str) -> list[str]:
    return "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in line.lower()).split()


def edit_distance(s: str, t: str) -> int:
    row = list(range(len(t) + 1))
    for i, c in enumerate(s, 1):
        new = [i]
        for j, d in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return row[-1]


def edit_within(s: str, t: str, k: int) -> bool:
    """The edit distance is at most ``k``: a column of the table at a time, in the bits of a number."""
    if abs(len(s) - len(t)) > k:
        return False
    where: dict[str, int] = defaultdict(int)
    for i, c in enumerate(s):
        where[c] |= 1 << i
    mask, last = (1 << len(s)) - 1, 1 << len(s) >> 1
    up, down, distance = mask, 0, len(s)
    for c in t:
        same = where.get(c, 0)
        level = same | down
        across = (((same & up) + up) ^ up) | same
        more, less = down | ~(across | up) & mask, up & across
        distance += bool(more & last) - bool(less & last)
        more, less = (more << 1 | 1) & mask, less << 1 & mask
        up, down = (less | ~(level | more)) & mask, more & level
    return distance <= k


def test_edit_within_agrees_with_the_table():
    rng = np.random.default_rng(4)
    for _ in range(300):
        s, t = ("".join(rng.choice(list("abc"), rng.integers(1, 12))) for _ in range(2))
        d = edit_distance(s, t)
        assert edit_within(s, t, d) and not edit_within(s, t, d - 1)


def similar_lines(lines: list[str]) -> list[tuple[str, str]]:
    """All pairs of lines with an edit similarity of at least 0.8."""
    letters = {c: k for k, c in enumerate(sorted(set("".join(lines))))}
    counts = np.zeros((len(lines), len(letters)), dtype=np.int32)
    for k, line in enumerate(lines):
        for c in line:
            counts[k, letters[c]] += 1
    length = counts.sum(axis=1)
    out = []
    for k, line in enumerate(lines):
        room = (np.maximum(length[k], length[k + 1:]) * 0.2 + 1e-9).astype(int)
        apart = counts[k + 1:] - counts[k]
        least = np.maximum(np.maximum(apart, 0).sum(axis=1), np.maximum(-apart, 0).sum(axis=1))
        for j in (np.flatnonzero(least <= room) + k + 1).tolist():
            if edit_within(line, lines[j], int(room[j - k - 1])):
                out.append((line, lines[j]))
    return out


def brute_lines(texts: dict) -> dict:
    """Groups of equal and of similar lines; nothing but the edit similarity links lines."""
    places = defaultdict(list)
    for i in sorted(texts):
        for n, line in enumerate((texts[i] or "").split("\n")):
            if normal(line):
                places[" ".join(normal(line))].append((i, n))
    lines = sorted(places)
    linked = similar_lines([x for x in lines if len(x.split()) >= 5])
    dropped = defaultdict(list)
    grouped = defaultdict(list)
    for line, root in groups_of(lines, linked).items():
        grouped[root] += places[line]
    for where in grouped.values():
        for i, n in sorted(where)[1:]:
            dropped[i].append(n)
    out = {}
    for i, t in texts.items():
        gone = sorted(dropped[i])
        kept = [x for n, x in enumerate((t or "").split("\n")) if n not in set(gone)]
        out[i] = (len((t or "").split("\n")), gone, "\n".join(kept))
    return out


def equal_lines(texts: dict) -> set:
    """The places of lines that equal an earlier one."""
    seen, out = set(), set()
    for i in sorted(texts):
        for n, line in enumerate((texts[i] or "").split("\n")):
            words = " ".join(normal(line))
            if words and words in seen:
                out.add((i, n))
            seen.add(words)
    return out


def line_rows(df) -> dict:
    return {r["id"]: (r["n_lines"], list(r["dropped"]), r["text"]) for r in df.collect()}


def test_lines_equal_brute_force(spark):
    texts = {}
    for k in range(30):
        base = prose(100 + k % 9, 40).split()
        other = list(base)
        other[k % 40] = "changed"  # one word of forty
        texts[k] = "\n".join([" ".join(base) if k % 3 else " ".join(other).upper() + "!",
                              "short line", prose(500 + k, 12), "", "Shared, line: of ten words "
                              "that all the documents have."])
    # words that occur often, so that many lines share blocks
    texts |= {100 + k: " ".join(["the of and to in a is it on as"] * 12 + [f"w{k}"]) for k in range(12)}
    assert line_rows(dedup_lines(frame(spark, texts))) == brute_lines(texts)


def test_lines_of_the_documents_against_brute_force(spark, sf_dir):
    """Nothing goes that brute force keeps, every equal line goes, and nearly all similar ones."""
    texts = read_texts(spark, sf_dir)
    got, want = line_rows(dedup_lines(frame(spark, texts))), brute_lines(texts)
    gone = {(i, n) for i, (_, lines, _) in got.items() for n in lines}
    wanted = {(i, n) for i, (_, lines, _) in want.items() for n in lines}
    assert gone <= wanted and equal_lines(texts) <= gone
    assert len(gone) >= 0.97 * len(wanted)
    for i, text in texts.items():
        lines = text.split("\n")
        assert got[i][::2] == (len(lines), "\n".join(x for n, x in enumerate(lines) if (i, n) not in gone))


def spark_hash(value: int, position: int) -> int:
    first = xxhash.xxh64_intdigest(value.to_bytes(8, "little"), 42)
    return xxhash.xxh64_intdigest(position.to_bytes(4, "little"), first)


def brute_simhash(words: list[str]) -> int:
    hashes, shift = [hash64(w) for w in words], STRETCH
    if len(words) >= ALL_WORDS:
        hashes, shift = [h for h in hashes if not h & 3], STRETCH - 2
    return majority([spark_hash(h, i >> shift) for i, h in enumerate(hashes)])


def test_simhash_of_lines_of_any_length(spark):
    texts = {1: prose(1, 200), 2: prose(2, 31), 3: prose(3, 32), 4: prose(4, 70_000), 5: "same " * 66_000,
             6: prose(6, 5), 7: prose(7, 4), 8: prose(8, 400), 9: "again " * 5}
    lines = _lines(spark.createDataFrame([(i, i, t) for i, t in texts.items()], "id long, text_hash long, text string"))
    got = {r["id"]: r for r in line_features(lines, 5).collect()}
    assert {i: unsigned(r["simhash"]) for i, r in got.items() if r["keys"] is not None} == {
        i: brute_simhash(t.split()) for i, t in texts.items() if i != 7}
    assert {i for i, r in got.items() if r["keys"] is None} == {7}
    longer = texts[4]
    pair = line_rows(dedup_lines(frame(spark, {1: longer, 2: longer.replace(" ", ",  ") + "."})))
    assert [pair[i][1] for i in (1, 2)] == [[], [0]]


def test_most_edits_is_never_too_few(spark):
    rng, rows = np.random.default_rng(6), []
    for _ in range(300):
        x = rng.choice(["a", "bb", "ccc", "dddd"], rng.integers(1, 8)).tolist()
        y = list(x)
        for _ in range(rng.integers(0, 3)):
            at = rng.integers(0, len(y) + 1)
            y[at:at + rng.integers(0, 2)] = rng.choice(["bb", "e"], rng.integers(0, 2)).tolist()
        rows.append((x, y or ["e"]))
    got = spark.createDataFrame(rows, "x array<string>, y array<string>").select(
        "x", "y", _most_edits("x", "y").alias("n")).collect()
    least = [edit_distance(" ".join(r["x"]), " ".join(r["y"])) for r in got]
    assert all(r["n"] >= d for r, d in zip(got, least))
    assert sum(r["n"] <= d + 2 for r, d in zip(got, least)) > 150  # and often near


def test_repeated_rows_and_a_pair_of_words_in_all_lines(spark):
    rows = [(None, prose(1, 100))] * 1000 + [(k, f"in the {prose(5000 + k, 9)}") for k in range(300)]
    rows += [(1000 + k, f"in the {prose(5000 + k, 8)} other") for k in range(0, 300, 7)]
    rows += [(2000, prose(1, 100))]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    gone = {r["id"] for r in got if r["dropped"]}
    want = brute_lines({i: t for i, t in rows if i is not None})
    assert gone == {i for i, (_, lines, _) in want.items() if lines} | {2000}
    assert all(r["dropped"] == [] for r in got if r["id"] is None)


def test_lines_awkward_rows(spark):
    rows = dedup_lines(awkward(spark), carry=("id", "row", "lang")).collect()
    assert len(rows) == len(awkward_rows())
    assert all(r["row"]["id"] == "z" and r["row"]["row"] == 1 for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r["id"]].append((r["n_lines"], list(r["dropped"]), r["text"]))
    assert by[1] == [(1, [], PLAIN)]
    assert by[4] == [(1, [0], "")] * 2  # repeated rows go alike
    assert by[2] == by[3] == [(1, [], "")]
    assert by[9][0][1] == [1] and by[6] == [(4, [], "\n\n \t\n")]
    assert dedup_lines(empty(spark)).count() == 0


# ---- passages --------------------------------------------------------------------------

def words_of(text: str) -> list[str]:
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))


def brute_passages(texts: dict, size: int) -> dict:
    places = defaultdict(list)
    for i in sorted(texts):
        w = words_of(texts[i])
        for s in range(len(w) - size + 1):
            places[tuple(w[s:s + size])].append((i, s))
    out = {i: (len(words_of(t)), set(), set(), None) for i, t in texts.items()}
    for where in places.values():
        for k, (i, s) in enumerate(where if len(where) > 1 else ()):
            n, repeated, extra, first = out[i]
            covered = set(range(s, s + size))
            out[i] = (n, repeated | covered, extra | covered if k else extra,
                      min(where[0][0], i if first is None else first))
    return out


def passage_rows(df) -> dict:
    def covered(spans):
        return {w for a, b in zip(spans[::2], spans[1::2]) for w in range(a, b)}

    return {r["id"]: (r["n_words"], covered(r["repeated"]), covered(r["extra"]), r["first"])
            for r in df.collect()}


def test_passages_of_the_documents_equal_brute_force(spark, sf_dir):
    texts = read_texts(spark, sf_dir)
    assert passage_rows(repeated_passages(frame(spark, texts))) == brute_passages(texts, 50)


def test_passages_at_every_border(spark):
    passage, texts = prose(7, 51), {}
    for k in range(60):  # the passage with other words left and right, also twice in a text
        texts[k] = prose(900 + k, k) + " " + passage + " " + prose(1900 + k, 60 - k)
    texts[60] = passage + " and " + passage
    texts[61] = prose(9, 55) + ". " + " ".join(passage.split()[:49])  # one word short
    texts[62] = " ".join(["again"] * 120)  # repeats itself at every place
    texts[63] = prose(10, 20) + " " + " ".join(passage.split()[20:]) + " " + prose(11, 60)
    assert passage_rows(repeated_passages(frame(spark, texts))) == brute_passages(texts, 50)


def test_passages_awkward_rows(spark):
    rows = repeated_passages(awkward(spark), min_words=10, prefix=4).collect()
    assert len(rows) == len(awkward_rows()) - 1  # the repeated row shares one
    by = {r["id"]: r for r in rows if r["id"] is not None}
    assert by[1]["first"] == by[4]["first"] == by[9]["first"] == 1
    assert by[1]["extra"] == [] and by[4]["extra"] == [0, 18] and by[9]["extra"] == [300, 318]
    assert by[2]["n_words"] == 0 and by[5]["repeated"] == [] and by[7]["n_words"] == 1
    assert repeated_passages(empty(spark)).count() == 0


def test_rolled_hash_depends_on_its_window_alone():
    values = np.random.default_rng(1).integers(0, 1 << 63, 120, dtype=np.uint64)
    for size in (1, 2, 3, 20, 31, 50):
        hashes = _rolled(values, size)
        assert len(hashes) == 121 - size
        assert _rolled(values[9:9 + size], size)[0] == hashes[9]


def test_every_window_retains_one_suffix():
    found = Suffixes(prose(3, 500), 50, 20)
    assert found.lo[0] == 0 and found.hi[-1] == 450 and (found.lo[1:] == found.hi[:-1] + 1).all()
    assert ((found.at >= found.lo) & (found.at + 20 <= found.hi + 50)).all()
