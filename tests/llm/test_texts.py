"""Decontamination, packing, digests and HTML extraction against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations_with_replacement

import numpy as np
import pytest

from modelshift.llm.decontamination import find_contamination, without_hits, without_spans
from modelshift.llm.digest import digest, edited_text, fingerprint_documents, likeness
from modelshift.llm.html import extract_text, learn_weights, main_text
from modelshift.llm.packing import make_plan, pack, sequences, word_encoder
from modelshift.llm.queries import word_tokenizer

from .cases import PLAIN, awkward, awkward_rows, empty, frame, prose, read_texts

# ---- decontamination -------------------------------------------------------------------


def lower(s: str) -> str:
    return re.sub("[A-Z]", lambda m: m.group().lower(), s)


def words_of(text: str) -> list[str]:
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))


def brute_hits(texts: dict, items: dict, n: int = 10) -> dict:
    windows = defaultdict(set)
    for item, text in items.items():
        w = words_of(text or "")
        size = min(n, len(w))
        for s in range(len(w) - size + 1) if w else ():
            windows[tuple(w[s:s + size])].add(str(item))
    out = {}
    for i, text in texts.items():
        w, hit, found = words_of(text or ""), set(), set()
        for size in {len(k) for k in windows}:
            for s in range(len(w) - size + 1):
                if tuple(w[s:s + size]) in windows:
                    hit |= set(range(s, s + size))
                    found |= windows[tuple(w[s:s + size])]
        out[i] = (len(w), hit, sorted(found))
    return out


def hit_rows(df) -> dict:
    return {r["id"]: (r["n_words"], {w for a, b in zip(r["spans"][::2], r["spans"][1::2])
                                     for w in range(a, b)}, list(r["items"])) for r in df.collect()}


def items_frame(spark, items: dict):
    return spark.createDataFrame(list(items.items()), "item_id long, text string")


ITEMS = {1: PLAIN, 2: "Short: one", 3: "three words here", 4: None, 5: "", 6: "?!",
         7: PLAIN + " And a good deal more after it.", 10: "ÉTÉ été 漢字"}


@pytest.mark.parametrize("max_windows", [500_000, 4])
def test_contamination_equals_brute_force(spark, max_windows):
    rng, texts = random.Random(4), {}
    pieces = [PLAIN, "short  ONE", "Three words here", "ÉTÉ été 漢字", "a good deal more after it"]
    for k in range(80):
        parts = [prose(k, 30), rng.choice(pieces), prose(k + 500, 5), rng.choice(pieces)]
        texts[k] = " ".join(parts[:rng.randint(1, 4)])
    texts[90] = " ".join(PLAIN.split()[:9])  # one word less than a window
    got = find_contamination(frame(spark, texts), items_frame(spark, ITEMS), max_windows=max_windows)
    assert hit_rows(got) == brute_hits(texts, ITEMS)


def test_windows_of_items_without_an_id(spark):
    texts = {1: PLAIN, 2: prose(1, 30), 3: "three words here"}
    items = items_frame(spark, {None: PLAIN, 3: "three words here"})
    got = hit_rows(find_contamination(frame(spark, texts), items))
    assert got[1] == (18, set(range(18)), []) and not got[2][1] and got[3][2] == ["3"]


def test_contamination_of_the_documents(spark, sf_dir):
    items = {r[0]: r[1] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    texts = read_texts(spark, sf_dir)
    got = hit_rows(find_contamination(frame(spark, texts), items_frame(spark, items)))
    assert got == brute_hits(texts, items) and any(h for _, h, _ in got.values())


@pytest.mark.parametrize("max_windows", [500_000, 4])
def test_contamination_awkward_rows(spark, max_windows):
    found = find_contamination(awkward(spark), items_frame(spark, ITEMS), max_windows=max_windows)
    rows = found.collect()
    assert len(rows) == len(awkward_rows())
    by = {r["id"]: (r["n_words"], list(r["spans"]), list(r["items"])) for r in rows if r["id"]}
    assert by[1] == by[4] == (18, [0, 18], ["1", "7"])
    assert by[2] == by[3] == by[6] == (0, [], [])
    kept = without_hits(awkward(spark), found).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == sorted(["2", "3", "5", "6", "7", "8", "None", "None"])
    cut = {r["id"]: r["text"] for r in without_spans(awkward(spark), found).collect() if r["id"]}
    assert cut[1] == "." and cut[9] == prose(9, 300) + "\n." and cut[8] == awkward_rows()[9][1]
    assert find_contamination(empty(spark), items_frame(spark, ITEMS)).count() == 0
    none = find_contamination(awkward(spark), items_frame(spark, ITEMS).limit(0))
    assert none.where("size(spans) > 0").count() == 0


# ---- packing ---------------------------------------------------------------------------

def reference_ids(texts: dict) -> dict:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(word_tokenizer())
    return {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for i, t in texts.items()}


def check_packing(rows, ids: dict, capacity: int) -> int:
    """Every piece is right and the sequences are gapless; returns how many there are."""
    held, length = defaultdict(list), Counter()
    for r in rows:
        want = ids[r["id"]][r["start"]:r["start"] + r["length"]]
        assert len(want) == r["length"] and r["start"] == r["piece"] * capacity
        assert zlib.crc32(np.array(want, "<u4").tobytes()) == r["ids_crc32"]
        held[r["sequence_id"]].append((r["offset"], r["length"]))
        length[r["id"]] += r["length"]
    assert length == {i: len(x) for i, x in ids.items()}
    for parts in held.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= capacity
    return len(held)


def test_packing_of_the_documents(spark, sf_dir):
    texts = read_texts(spark, sf_dir)
    ids = reference_ids(texts)
    n = check_packing(pack(frame(spark, texts), word_tokenizer()).collect(), ids, 2048)
    assert n <= -(-sum(map(len, ids.values())) // 2048) + 1


def test_packing_rebuilds_the_sequences(spark):
    texts = {k: prose(k, 1 + 7 * k % 90) for k in range(40)}
    placed = pack(frame(spark, texts), word_tokenizer(), capacity=64).cache()
    ids = reference_ids(texts)
    got = {r["sequence_id"]: list(r["ids"]) for r in sequences(
        frame(spark, texts), placed, word_tokenizer(), capacity=64).collect()}
    for r in placed.collect():
        assert got[r["sequence_id"]][r["offset"]:r["offset"] + r["length"]] == (
            ids[r["id"]][r["start"]:r["start"] + r["length"]])
    assert sum(map(len, got.values())) == sum(map(len, ids.values()))


def test_packing_awkward_rows(spark):
    rows = pack(awkward(spark), word_tokenizer()).collect()
    pieces = Counter(r["id"] for r in rows)
    assert pieces[4] == 2 and pieces[2] == pieces[3] == 1 and pieces[5] > 50 and pieces[None] == 2
    assert {r["length"] for r in rows if r["id"] in (2, 3, 6)} == {1}
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    assert pack(empty(spark), word_tokenizer()).count() == 0


def test_encoder_equals_the_tokenizer_on_mixed_signs():
    encode, rng = word_encoder(word_tokenizer()), random.Random(2)
    signs = "abcABC éÉßİΣσς'.,!?<|>s\t\n½²ª٣中́가Å"
    texts = {k: "".join(rng.choices(signs, k=12)) for k in range(3000)}
    texts |= {-1: "it's  don't I'LL '.", -2: "<|endoftext|> a<|startoftext|>", -5: "<|ENDOFTEXT|>b <|endoftext|",
              -6: "Word<|endoftext|>Other\n<|startoftext|><|endoftext|>\tx <|EndOfText|>", -3: "\x1c\x85\xa0x", -4: ""}
    for k, ids in reference_ids(texts).items():
        assert np.frombuffer(encode(texts[k]), "<u4").tolist() + [0] == ids, texts[k]


def fewest(lengths: list[int], capacity: int) -> int:
    """The least number of sequences, by branch and bound; for a handful of pieces."""
    best = len(lengths)
    lengths = sorted(lengths, reverse=True)

    def place(k: int, rooms: list[int]) -> None:
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        for room in set(rooms):
            if room >= lengths[k]:
                i = rooms.index(room)
                place(k + 1, rooms[:i] + [room - lengths[k]] + rooms[i + 1:])
        place(k + 1, rooms + [capacity - lengths[k]])

    place(0, [])
    return best


def test_reduction_never_costs_a_sequence():
    """What it fixes, plus the best packing of the rest, is a best packing of everything."""
    from modelshift.llm.packing import Plan

    rng = random.Random(8)
    cases = [[rng.randint(1, 20) for _ in range(rng.randint(1, 8))] for _ in range(400)]
    cases += [list(c) for c in combinations_with_replacement((3, 7, 9, 10, 11, 13), 5)]
    for lengths in cases:
        plan = Plan(20, dict(Counter(lengths)))
        plan.reduce()
        rest = [x for x, n in plan.left.items() for _ in range(n)]
        assert plan.sequences + fewest(rest, 20) == fewest(lengths, 20), lengths


def test_best_fit_equals_one_piece_at_a_time():
    from modelshift.llm.packing import Plan

    rng = random.Random(9)
    for _ in range(200):
        lengths = [rng.randint(1, 50) for _ in range(rng.randint(1, 200))]
        rooms: list[int] = []
        for x in sorted(lengths, reverse=True):
            fitting = [r for r in rooms if r >= x]
            if fitting:
                rooms[rooms.index(min(fitting))] -= x
            else:
                rooms.append(50 - x)
        plan = Plan(50, dict(Counter(lengths)))
        plan.best_fit()
        assert plan.sequences == len(rooms)


def test_plan_does_not_grow_with_the_pieces():
    rng = random.Random(10)
    shape = {x: rng.randint(1, 50) for x in range(1, 2049)}
    small = make_plan(shape, 2048)
    large = make_plan({x: n * 10_000 for x, n in shape.items()}, 2048)
    assert len(large.runs) < 3 * len(small.runs) < 100_000
    assert large.sequences <= -(-sum(x * n * 10_000 for x, n in shape.items()) // 2048) * 1.01


# ---- digests ---------------------------------------------------------------------------

def brute_digests(texts: list[tuple]) -> list[tuple]:
    rows = sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        edited = edited_text(t, following)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), digest(t), digest(edited),
                    likeness(digest(t), digest(edited)), likeness(digest(t), digest(following))))
    return out


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_digests_equal_brute_force(spark, sf_dir, parts):
    texts = read_texts(spark, sf_dir)
    got = sorted(tuple(r) for r in fingerprint_documents(frame(spark, texts), parts=parts).collect())
    assert got == sorted(brute_digests(list(texts.items())))


def test_digests_tell_edited_from_following(spark, sf_dir):
    rows = fingerprint_documents(frame(spark, read_texts(spark, sf_dir))).collect()
    unlike = sorted(r["near_next"] for r in rows)[int(len(rows) * 0.95)]
    assert np.mean([r["near_edited"] > unlike for r in rows]) > 0.9


def test_digests_awkward_rows(spark):
    rows = fingerprint_documents(awkward(spark)).collect()
    assert len(rows) == len(awkward_rows())
    by = defaultdict(set)
    for r in rows:
        by[r["id"]].add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert by[1] == by[4] and by[2] == by[3] == {"00" * 65}
    big = 2 ** 60 + 1  # ids beyond what a float holds, beside a null
    some = spark.createDataFrame([(None, "a"), (big, "b" * 40), (big + 1, "c" * 40)], "doc_id long, text string")
    assert sorted(str(r["id"]) for r in fingerprint_documents(some).collect()) == sorted(
        ["None", str(big), str(big + 1)])
    one = fingerprint_documents(frame(spark, {7: "alone and single"})).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert fingerprint_documents(empty(spark)).count() == 0


def test_likeness_is_bounded_and_symmetric():
    marks = [digest(t) for t in ("", "a", "ab", PLAIN, PLAIN.upper(), prose(1, 500), prose(2, 500))]
    for x in marks:
        for y in marks:
            assert 0 <= likeness(x, y) <= 1 and likeness(x, y) == likeness(y, x)
        assert likeness(x, x) == 1


# ---- HTML ------------------------------------------------------------------------------

def brute_article(source: str) -> str:
    """The article element's blocks, for pages as the given table has them."""
    from html import unescape

    inner = re.search(r"<article>(.*?)(?:</article>|\Z)", source, re.S).group(1)
    blocks = re.split(r"</?(?:p|h1)>", inner)
    texts = [" ".join(unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in blocks]
    return "\n".join(t for t in texts if t)


def test_articles_of_the_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    want = {r["page_id"]: (r["url"], brute_article(r["html"])) for r in pages.collect()}
    got = {r["id"]: (r["row"]["url"], r["text"]) for r in extract_text(pages).collect()}
    assert got == want


PAGE = """<!DOCTYPE html><html><head><title>x</title><script>if (a < b) { t = "</p>"; }</script></head><body>
<header class="site-header"><h1>Site name</h1></header>
<div id=menu><ul><li><a href=1>Home</a><li><a href=2>News today</a></ul></div>
<div class="content"><h1>Title &amp; more</h1><p>First   paragraph with many words in it, and
some more words here.</p><div class="advert"><p>Buy this thing now please, it is good</p></div>
<p>As.</p><form><p>Sign up for news</p></form><ul><li>one item<li>two item</ul>
<p>Second paragraph<br>goes on for a <b>while</b> &#233;t cetera.</div>
<section id="comments"><p>Great article, thanks for sharing this with all of us here today.</p></section>
<div class="cookie-notice">We use cookies</div><footer>&copy; foot</footer></body></html>"""
MAIN = ("Title & more\nFirst paragraph with many words in it, and some more words here.\nAs.\none item\n"
        "two item\nSecond paragraph goes on for a while ét cetera.")


def test_pages_without_an_article(spark, sf_dir):
    weights = learn_weights(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "html")
    assert main_text(PAGE, weights) == main_text(PAGE, {}) == MAIN


@pytest.mark.parametrize("source,text", [
    ("", ""), ("just text, a < b &lt; c", "just text, a < b < c"), ("<p>cut <b>off", "cut off"),
    ("<!-- never closed", ""), ("<script>never closed", ""), ("<p>a<p>b</p></div></p>c d e", "a\nb\nc d e"),
    ("<nav><a>menu</a></nav>", ""), ("<article><p>x</p><p>" + "y " * 5 + "</article>", "x\ny y y y y"),
    ("<ARTICLE><P>Up</P></ARTICLE>", "Up"), ("<p title='a > b'>quoted</p>", "quoted"),
    ("<article><p>kept</p><aside><p>beside it, with many words in a row</p></aside><p>too</p></article>",
     "kept\ntoo"),
])
def test_broken_and_small_pages(source, text):
    assert main_text(source, {}) == text


def test_pages_awkward_rows(spark):
    schema = "page_id long, url string, html string, id int, row string, text string"
    rows = [(1, "u", None, 1, "r", "t"), (2, None, "", 1, "r", "t"), (None, "u", "<p>no id</p>", 1, "r", "t"),
            (3, "u", PAGE, 1, "r", "t"), (3, "u", PAGE, 1, "r", "t"),
            (4, "u", "<div>" * 30_000 + "deep " * 50_000, 1, "r", "t")]
    got = extract_text(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 6 and all(r["row"]["row"] == "r" and r["row"]["text"] == "t" for r in got)
    texts = {r["id"]: r["text"] for r in got}
    assert texts[1] == texts[2] == "" and texts[None] == "no id" and texts[3] == MAIN
    assert len(texts[4].split()) == 50_000
    assert extract_text(spark.createDataFrame([], schema)).count() == 0
