"""NEST, UNNEST and their kin: inverse laws, missing matches, oversized groups."""

from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from modelshift.functions import paths as P
from modelshift.operators import compare as cmp
from modelshift.operators import structural as st
from modelshift.operators.grouping import DuplicateKey, gather


@pytest.fixture(scope="module")
def parents(spark):
    return spark.createDataFrame(
        [(1, "a"), (2, "b"), (3, "c"), (4, None)], "id int, name string")


@pytest.fixture(scope="module")
def children(spark):
    return spark.createDataFrame(
        [(10, 1, 5.0), (11, 1, 4.0), (12, 2, 3.0), (13, 9, 1.0), (14, None, 2.0)],
        "cid int, pid int, v double")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_nest_one_no_match_gives_null_object(parents, children):
    out = st.nest_one(children, parents, {"pid": "id"}, "parent", ["name"])
    assert "pid" not in out.columns
    got = {r.cid: r.parent for r in out.collect()}
    assert got[13] is None and got[14] is None
    assert got[10].name == "a" and len(got) == 5


def test_nest_one_refuses_repeated_source_key(parents, children):
    twice = parents.unionByName(parents)
    with pytest.raises(DuplicateKey):
        st.nest_one(children, twice, {"pid": "id"}, "parent")


def test_nest_one_inside_object(spark, parents):
    df = spark.createDataFrame([(1, (2, "x"))], "k int, o struct<ref int, t string>")
    out = st.nest_one(df, parents, {"o.ref": "id"}, "o.parent", ["name"])
    row = out.first()
    assert row.o.parent.name == "b" and "ref" not in row.o.asDict()


def test_nest_many_no_match_gives_empty_array(parents, children):
    out = st.nest_many(parents, children, {"id": "pid"}, "kids", ["cid", "v"])
    got = {r.id: [tuple(k) for k in r.kids] for r in out.collect()}
    assert got == {1: [(10, 5.0), (11, 4.0)], 2: [(12, 3.0)], 3: [], 4: []}


def test_unnest_of_nest_gives_back_rows(parents, children):
    nested = st.nest_many(parents, children, {"id": "pid"}, "kids", ["cid", "v"])
    new, rest = st.unnest(nested, "kids", carry={"id": "pid"})
    matched = children.where("pid in (1, 2)")
    assert rows(new.select("cid", "pid", "v")) == rows(matched)
    assert rows(rest) == rows(parents)


def test_unwind_of_wind_group(children):
    grouped = st.wind_group(children.select("pid", "v"), "v")
    assert rows(st.unwind(grouped, "v")) == rows(children.select("pid", "v"))


def test_flatten_of_unflatten(children):
    packed = st.unflatten(children, ["pid", "v"], "o")
    back = st.flatten(packed, "o").select(
        "cid", F.col("o_pid").alias("pid"), F.col("o_v").alias("v"))
    assert rows(back) == rows(children)


def test_merge_of_split(children):
    parts = st.split(children, {"a": ["cid", "pid"], "b": ["cid", "v"]})
    assert rows(st.merge_join(parts["a"], parts["b"], ["cid"])) == rows(children)


def test_merge_keeps_all_rows_and_first_wins(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k int, t string")
    b = spark.createDataFrame([(2, "y", 7), (2, "z", 8), (3, "w", 9)], "k int, t string, n int")
    assert rows(st.merge_join(a, b, ["k"])) == rows(
        spark.createDataFrame(
            [(1, "x", None), (2, "y", 7), (2, "z", 8), (3, "w", 9)], "k int, t string, n int"))
    assert rows(st.merge_join(b, a, ["k"]).select("k", "t", "n")) == rows(st.merge_join(a, b, ["k"]))


def test_merge_refuses_many_to_many(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y")], "k int, t string")
    with pytest.raises(DuplicateKey):
        st.merge_join(a, a, ["k"])


def test_flatten_keeps_existing_column(spark):
    df = spark.createDataFrame([((1, 2), 9)], "o struct<a int, b int>, o_a int")
    row = st.flatten(df, "o").first()
    assert row.o_a == 9 and row.o_b == 2


def test_flatten_lifts_inner_object_whole(spark):
    df = spark.createDataFrame([((1, (2,)),)], "o struct<a int, i struct<z int>>")
    assert st.flatten(df, "o").first().o_i.z == 2


def test_edits_in_nested_arrays(spark):
    df = spark.createDataFrame(
        [(1, [([(1, "x")],), None])], "k int, a array<struct<b: array<struct<c: int, d: string>>>>")
    from modelshift.operators import properties as pr

    out = pr.rename_property(df, "a.b.c", "e")
    out = pr.add_property(out, "a.b.f", "Integer", 5)
    out = pr.delete_property(out, "a.b.d")
    row = out.first()
    assert row.a[0].b[0].asDict() == {"e": 1, "f": 5} and row.a[1] is None
    assert df.select(P.value(df.schema, "a.b.c").alias("x")).first().x == [1]


def test_resolve_short_name_and_ambiguity(spark):
    df = spark.createDataFrame([((1, 2), (3, 4))], "o struct<a int, b int>, p struct<b int, c int>")
    assert P.resolve(df.schema, "c") == "p.c"
    with pytest.raises(KeyError, match="ambiguous"):
        P.resolve(df.schema, "b")


def test_unnest_carries_fields_from_every_level(spark):
    df = spark.createDataFrame(
        [(1, [("x", [("p", 1), ("q", 2)]), ("y", None)])],
        "k int, a array<struct<n string, b array<struct<m string, v int>>>>")
    new, _ = st.unnest(df, "a.b", ["v", "missing"], {"k": "k", "a.n": "n"})
    assert rows(new) == [(1, "x", 1, None), (1, "x", 2, None)]


def test_unnest_link_matches_key(spark):
    df = spark.createDataFrame(
        [(1, ("a", None)), (2, ("a", None)), (3, None)], "k int, o struct<x string, y string>")
    new, rest = st.unnest(df, "o", key="oid", link="oid", distinct=True)
    assert new.count() == 1
    key = new.first().oid
    assert [r.oid for r in rest.orderBy("k").collect()] == [key, key, None]


def test_unwind_keep_empty(spark):
    df = spark.createDataFrame([(1, [1, 2]), (2, []), (3, None)], "k int, a array<int>")
    assert st.unwind(df, "a").count() == 2
    assert st.unwind(df, "a", keep_empty=True).count() == 4


# --- oversized groups ----------------------------------------------------------------

def hot_children(spark, n=3000):
    """One key holds most rows, and a third of those are copies of one row."""
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.col("id") % 50 + 10).otherwise(1).cast("int").alias("pid"),
        F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).cast("int").alias("v"),
    )


def test_parts_need_a_column_and_a_size(spark, parents):
    for only in ({"part_column": "part"}, {"elements_per_part": 100}):
        with pytest.raises(ValueError):
            st.nest_many(parents, hot_children(spark), {"id": "pid"}, "kids", **only)


def test_a_call_gives_one_schema_on_any_data(spark, parents):
    few = hot_children(spark, 6)
    got = [
        st.nest_many(parents, kids, {"id": "pid"}, "kids", part_column="part", elements_per_part=100)
        for kids in (few.limit(0), few, hot_children(spark))
    ]
    assert got[0].schema == got[1].schema == got[2].schema
    assert [df.where("part = 0").count() for df in got] == [parents.count()] * 3


def test_oversized_group_spreads_and_stays_whole(spark, parents):
    kids = hot_children(spark)
    out = st.nest_many(
        parents, kids, {"id": "pid"}, "kids", ["v"], part_column="part", elements_per_part=100).cache()
    firsts = out.where("part = 0")
    assert rows(firsts.select("id", "name")) == rows(parents)
    hot = out.where("id = 1")
    assert hot.count() > 10
    sizes = sorted(r[0] for r in hot.select(F.size("kids")).collect())
    assert sizes[-1] == sizes[1] == 100  # every part but the last is full
    new, _ = st.unnest(out, "kids", carry={"id": "pid"})
    assert cmp.bag_diff(new, kids.where("pid = 1").select("pid", "v")).count() == 0


def test_oversized_wind_group_with_null_key(spark):
    df = spark.range(1000).select(
        F.when(F.col("id") % 4 == 0, F.col("id") % 8).cast("int").alias("k"), F.lit(1).alias("v"))
    out = st.wind_group(df, "v", part_column="part", elements_per_part=50)
    assert cmp.bag_diff(st.unwind(out, "v").drop("part"), df).count() == 0
    assert out.where("k is null").count() > 1


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(hs.lists(hs.tuples(hs.integers(0, 3), hs.integers(0, 2)), min_size=1, max_size=60),
       hs.integers(1, 12))
def test_gather_against_brute_force(spark, pairs, limit):
    df = spark.createDataFrame(pairs, "k int, v int")
    got = gather(df, ["k"], F.col("v"), "vs", part_column="part", elements_per_part=limit).rows
    seen = defaultdict(list)
    for r in got.collect():
        assert r.vs == sorted(r.vs) and len(r.vs) <= limit
        seen[r.k] += r.vs
    want = defaultdict(list)
    for k, v in pairs:
        want[k].append(v)
    assert {k: sorted(v) for k, v in seen.items()} == {k: sorted(v) for k, v in want.items()}


def test_elements_with_maps_spread_too(spark):
    df = spark.range(90).select(
        (F.col("id") % 2).cast("int").alias("k"),
        F.create_map(F.lit("a"), F.col("id") % 5, F.lit("b"), F.col("id") % 3).alias("m"))
    for limit in (1000, 10):
        out = st.wind_group(df, "m", part_column="part", elements_per_part=limit)
        back = st.unwind(out, "m").select("k", "m.a", "m.b")
        assert cmp.bag_diff(back, df.select("k", "m.a", "m.b")).count() == 0


# --- hot join keys -------------------------------------------------------------------

SPLITTING = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50KB",
}


@pytest.fixture()
def splitting(spark):
    old = {k: spark.conf.get(k, None) for k in SPLITTING}
    for k, v in SPLITTING.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_hot_join_keys_are_split(spark, splitting):
    """The joins keep the shape in which Spark splits a hot key at run time."""
    from modelshift.operators import rules as R

    n = 120_000
    many = spark.range(n).repartition(8).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 5000).alias("k"),
        F.col("id").alias("v"), F.md5(F.col("id").cast("string")).alias("t"))
    one = spark.range(5000).select(F.col("id").alias("k"), F.lit("x").alias("name"))
    frames = {
        "nest": st.nest_one(many, one, {"k": "k"}, "o", ["name"], check=False),
        "merge": st.merge_join(one, many, ["k"], one="first"),
        "orphans": R.orphans(many, ["k"], one.where("k > 10"), ["k"]),
    }
    for name, df in frames.items():
        df.toArrow()
        assert "skew=true" in df._jdf.queryExecution().executedPlan().toString(), name
