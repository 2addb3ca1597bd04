"""Spelling variants against brute force: every pair of words, one edit by its definition."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from modelshift.llm import spelling
from modelshift.llm.spelling import Tree, edited, letter_counts, matches, near_words, spelling_variants

from .cases import awkward, awkward_rows, empty, frame, read_texts


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:p] + b[p + 1:] == a for p in range(len(b)))


def brute_words(rows) -> dict:
    total = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}


def brute(rows) -> dict:
    words = brute_words(rows)
    near, out = defaultdict(list), {}
    sizes = defaultdict(list)
    for w in words:
        sizes[len(w)].append(w)
    for w in words:
        for size in (len(w) - 1, len(w), len(w) + 1):
            near[w] += [v for v in sizes[size] if v != w and one_edit(w, v)]
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words.get(form[w]))
    return out


def rows_of(df) -> dict:
    got = df.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got}
    assert len(out) == len(got)
    return out


def test_documents_equal_brute_force(spark, sf_dir):
    texts = read_texts(spark, sf_dir)
    got = rows_of(spelling_variants(frame(spark, texts)))
    assert got == brute(texts.items()) and any(f for f, *_ in got.values())


def variants(seed: int) -> list[tuple]:
    """Texts with chains of misspellings, anagrams, ties and letters beyond ASCII."""
    rng, rows = random.Random(seed), []
    for k in range(60):
        word = "".join(rng.choices("aeinrstéÉÿ", k=rng.randint(6, 9)))
        chain = [word]
        for _ in range(3):
            w = list(chain[-1])
            p = rng.randrange(len(w))
            w[p:p + rng.randint(0, 1)] = rng.choice(["", "x", "e", "ß"])
            chain.append("".join(w))
        for n, w in zip((700, 130, 24, 5), chain):
            rows.append((1000 * k + n, (w + " ") * n))
        rows.append((1000 * k + 900, " ".join("".join(rng.sample(word, len(word))) for _ in range(20)) * 1))
    return rows


@pytest.mark.parametrize("leaf", [spelling.LEAF, 10])
def test_variants_equal_brute_force(spark, monkeypatch, leaf):
    monkeypatch.setattr(spelling, "LEAF", leaf)
    monkeypatch.setattr(spelling, "SAMPLE", 20_000 if leaf > 10 else 150)  # a tree cut by a part
    rows = variants(leaf)
    got = rows_of(spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")))
    want = brute(rows)
    assert got == want
    assert any(f and want[f][0] for f, *_ in want.values())  # a form with a form of its own


def test_many_words_of_equal_counts(spark):
    rng = random.Random(5)
    words = {"".join(rng.sample("abcdefgh", 8)) for _ in range(3000)}
    words |= {w.replace("a", "i", 1) for w in list(words)[:500]} | {w + "z" for w in list(words)[:200]}
    got = {tuple(r) for r in near_words(spark.createDataFrame(
        [(w, 5) for w in words], "word string, n long")).select("word", "near").collect()}
    want = set()
    for w in words:
        for p in range(len(w)):
            want |= {(w, v) for c in "iaz" if (v := w[:p] + c + w[p + 1:]) in words and v != w}
            if (v := w[:p] + w[p + 1:]) in words:
                want |= {(w, v), (v, w)}
    assert got == want


def test_trees_reach_all_that_match():
    rng = random.Random(9)
    data = sorted({"".join(rng.choices("abcdü", k=7)) for _ in range(600)})
    points = letter_counts(data)
    for down in (0, 1):
        asked = sorted({"".join(rng.choices("abcdü", k=6 + down)) for _ in range(200)})
        rows = letter_counts(asked)
        want = {(q, k) for q in range(len(asked)) for k in range(len(data))
                if (points[k] - rows[q]).clip(0).sum() == 1 and (rows[q] - points[k]).clip(0).sum() == down}
        found = list(matches(points, rows, down))
        assert len(found) == len(set(found)) and set(found) == want
        tree = Tree.cut(points[::3], 9)
        home = {k: leaf for leaf, some in tree.leaves(points) for k in some.tolist()}
        assert len(home) == len(data) and len(set(home.values())) > 10
        reached = {(q, leaf) for leaf, some in tree.leaves(rows, down) for q in some.tolist()}
        assert all((q, home[k]) in reached for q, k in want)
        assert len(reached) < len(asked) * len(set(home.values())) / 2  # boxes are pruned


def test_edited_words():
    assert edited(["abab", "aabb"], ["abcb", "cabb"], "c", "a") == {("abab", "abcb"), ("aabb", "cabb")}
    assert edited(["aab"], ["aaab", "abaa"], "a", None) == {("aab", "aaab")}


def test_awkward_rows(spark):
    rows = [(r[0], r[1]) for r in awkward_rows()]
    assert rows_of(spelling_variants(awkward(spark))) == brute(rows)
    assert spelling_variants(empty(spark)).count() == 0
    assert spelling_variants(frame(spark, {1: None, 2: "too few words here"})).count() == 0
    long_ = "ab" * 40_000
    texts = {k: f"{long_} {long_}c {long_}" for k in range(5)}
    got = rows_of(spelling_variants(frame(spark, texts)))
    assert {n_near for *_, n_near, _ in got.values()} == {1} and len(got) == 2
