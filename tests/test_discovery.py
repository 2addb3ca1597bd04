"""Keys and references found by their levels, against every set and every pairing by itself."""

import random
from itertools import combinations, permutations

import pytest

from modelshift.operators import discovery
from modelshift.operators.discovery import (
    discover_composite_references, discover_keys, discover_references, proposed_contract)


def brute_keys(rows: list[tuple], names: list[str]) -> set[str]:
    found: list[tuple[int, ...]] = []
    for k in range(1, len(names) + 1):
        for s in combinations(range(len(names)), k):
            values = [tuple(r[i] for i in s) for r in rows]
            if any(set(f) < set(s) for f in found) or any(None in v for v in values):
                continue
            if rows and len(set(values)) == len(rows):
                found.append(s)
    return {",".join(names[i] for i in s) for s in found}


@pytest.mark.parametrize("rows_for_refusal, agreements", [(1_000_000, 10_000), (20, 0), (20, 2)])
def test_keys_equal_brute_force(spark, monkeypatch, rows_for_refusal, agreements):
    monkeypatch.setattr(discovery, "ROWS_FOR_REFUSAL", rows_for_refusal)
    monkeypatch.setattr(discovery, "AGREEMENTS", agreements)
    monkeypatch.setattr(discovery, "SETS_PER_SCAN", 4)  # several passes
    rng, names = random.Random(3), ["a", "b", "c", "d", "e"]
    for n, spread in ((60, 4), (200, 6), (7, 3)):
        rows = list({tuple(rng.randrange(spread) for _ in names) for _ in range(n)})
        rows += [(0, 0, 0, 0, 9), (0, 0, 0, 0, 8)]
        df = spark.createDataFrame(rows, "a int, b int, c int, d int, e int")
        got = discover_keys(df, "t").collect()
        assert {r["key"] for r in got} == brute_keys(rows, names)
        assert all(r["n_rows"] == len(rows) and r["size"] == len(r["key"].split(",")) for r in got)
    assert discover_keys(df.where("a < 0"), "t").count() == 0
    assert {r["key"] for r in discover_keys(df, "t", max_size=1).collect()} == {
        k for k in brute_keys(rows, names) if "," not in k}


def test_keys_of_every_type(spark):
    rows = [(True, 1.5, bytearray(b"a"), [1], {"k": 1}, (1, "x"), None),
            (True, -0.0, bytearray(b"a"), [1, 2], {"k": 2}, (1, "x"), 2),
            (False, 0.0, bytearray(b"b"), [], {}, (1, "y"), 3)]
    df = spark.createDataFrame(
        rows, "t boolean, d double, b binary, l array<int>, m map<string,int>, s struct<p int, q string>, n int")
    keys = {r["key"] for r in discover_keys(df, "t").collect()}
    assert {"l", "m"} <= keys and "n" not in keys
    assert "d" not in keys  # the two zeros are one value
    assert "t,d" in keys and "t,b" not in keys


def test_a_key_of_the_rare_copies_is_refused(spark):
    """One copy among many rows, most likely outside the values that are looked at first."""
    df = spark.range(3000).selectExpr("id as a", "id % 50 as b", "id div 50 as c")
    again = df.unionByName(df.where("id = 77" if "id" in df.columns else "a = 77").selectExpr("a + 3000 as a", "b", "c"))
    assert {r["key"] for r in discover_keys(df, "t").collect()} == {"a", "b,c"}
    assert {r["key"] for r in discover_keys(again, "t").collect()} == {"a"}


def test_references_of_many_columns(spark):
    """More columns than a mask has bits."""
    n = 150
    df = spark.createDataFrame([tuple(i * n + j for j in range(n)) for i in range(4)],
                               ", ".join(f"c{j} long" for j in range(n)))
    part = df.selectExpr("c149 as x", "c70 as y", "c3 as z", "-1L as w").limit(2)
    got = {(r["child"], r["parent"]) for r in discover_references({"t": df, "p": part}).collect()}
    assert got == {("p.x", "t.c149"), ("p.y", "t.c70"), ("p.z", "t.c3")}


def brute_references(frames: dict) -> set:
    out, parts = set(), set()
    for a, (xs, rows) in frames.items():
        for b, (ys, others) in frames.items():
            for k in range(1, min(len(xs), len(ys)) + 1):
                for s in combinations(range(len(xs)), k):
                    for t in permutations(range(len(ys)), k):
                        if a == b and any(i == j for i, j in zip(s, t)):
                            continue
                        mine = {tuple(r[i] for i in s) for r in rows}
                        mine = {v for v in mine if None not in v}
                        held = all((a, b, s[:i] + s[i + 1:], t[:i] + t[i + 1:]) in parts
                                   for i in range(k if k > 1 else 0))
                        if held and mine and mine <= {tuple(r[j] for j in t) for r in others}:
                            parts.add((a, b, s, t))
                            out.add((f"{a}.{','.join(xs[i] for i in s)}",
                                     f"{b}.{','.join(ys[j] for j in t)}", len(mine)))
    return {x for x in out if "," in x[0]}


def test_composite_references_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(discovery, "SETS_PER_SCAN", 6)
    rng = random.Random(8)
    wide = [tuple(rng.randrange(5) for _ in range(3)) for _ in range(40)]
    some = [(r[1], r[0], r[2]) for r in wide[:15]] + [(None, 1, 2), (3, None, 1)]
    torn = [(wide[0][0], wide[0][1]), (9, None)]  # 9 occurs nowhere, so no part of this one holds
    loose = [(a, b) for a in range(3) for b in range(3)]
    hot = [(1, 1)] * 500 + [(wide[0][0], wide[0][2])]
    frames = {"wide": (["a", "b", "c"], wide), "some": (["x", "y", "z"], some),
              "loose": (["p", "q"], loose), "torn": (["u", "v"], torn), "hot": (["h", "i"], hot)}
    dfs = {n: spark.createDataFrame(rows, ", ".join(f"{c} {'int' if n == 'some' else 'long'}" for c in names))
           for n, (names, rows) in frames.items()}
    got = {tuple(r) for r in discover_composite_references(dfs).collect()}
    want = brute_references(frames)
    assert got == want and any(c.count(",") == 2 for c, _, _ in want)
    two = {tuple(r) for r in discover_composite_references(dfs, max_size=2).collect()}
    assert two == {x for x in want if x[0].count(",") == 1}
    keyed = {tuple(r) for r in discover_composite_references(dfs, keys={"wide": [("c", "a")]}).collect()}
    assert keyed == {x for x in want if x[1] in ("wide.a,c", "wide.c,a")}


def test_contract_with_composite_and_self_references(spark):
    items = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "a"), (2, 2, "a")], "o int, l int, t string")
    notes = spark.createDataFrame([(10, 1, 2), (11, 1, 2), (12, 2, 1)], "n int, l int, o int")
    staff = spark.createDataFrame([(100, None), (101, 100), (102, 100)], "id int, boss int")
    got = {(r.entity, r.name) for r in proposed_contract(
        {"items": items, "notes": notes, "staff": staff}, max_size=None, self_references=True).rules}
    assert {("items", "primary(o,l)"), ("staff", "primary(id)"), ("staff", "reference(boss)->staff(id)"),
            ("notes", "reference(l,o)->items(l,o)")} <= got
    alone = proposed_contract({"items": items, "staff": staff})
    assert {(r.entity, r.name) for r in alone.rules} == {("staff", "primary(id)")}


def test_sets_with_a_column_of_few_rows_take_no_pass(spark, monkeypatch):
    """Five columns, one with three rows to a value: its sets are settled by its pairs alone."""
    from itertools import combinations

    from modelshift.operators import discovery

    rows = [(i // 3, i % 3, (i * 7) % 5, (i * i) % 11, i % 2) for i in range(300)] + [(1, 1, 1, 1, 1)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int, e int")
    looked_at, real = [], discovery._measured

    def measured(frame, sets, one_in=1):
        looked_at.extend(sets)
        return real(frame, sets, one_in)

    monkeypatch.setattr(discovery, "_measured", measured)
    got = {r["key"] for r in discovery.discover_keys(df, "t").collect()}
    want: list[tuple] = []
    for size in range(1, 6):
        for s in combinations(range(5), size):
            if not any(set(k) <= set(s) for k in want):
                if len({tuple(r[i] for i in s) for r in rows}) == len(rows):
                    want.append(s)
    assert got == {",".join("abcde"[i] for i in s) for s in want} != set()
    assert not [s for s in looked_at if len(s) > 1 and "a" in s]


def test_candidates_share_their_sides(spark, monkeypatch):
    """Columns of equal values make many candidates out of few tuples; a pass takes more than eight."""
    from modelshift.operators import discovery

    rows = [(i, (i + 1) % 7, (i + 2) % 7) for i in range(7)]
    frames = {"k": spark.createDataFrame(rows, "a int, b int, c int"),
              "p": spark.createDataFrame(rows, "x int, y int, z int")}
    passes, real = [], discovery._inclusions

    def inclusions(frames, tried):
        passes.append(len(tried))
        return real(frames, tried)

    monkeypatch.setattr(discovery, "_inclusions", inclusions)
    got = {(r["child"], r["parent"]) for r in discovery.discover_composite_references(
        frames, max_size=2).collect()}
    assert max(passes) > 8
    sets = {"k": {c: [r[i] for r in rows] for i, c in enumerate("abc")},
            "p": {c: [r[i] for r in rows] for i, c in enumerate("xyz")}}
    for one, two in (("k", "p"), ("p", "k")):
        for c, d in (("ab", "ac") if one == "k" else ("xy", "xz")):
            for e in sets[two]:
                for f in sets[two]:
                    if e != f:
                        holds = set(zip(sets[one][c], sets[one][d])) <= set(zip(sets[two][e], sets[two][f]))
                        assert holds == ((f"{one}.{c},{d}", f"{two}.{e},{f}") in got)
