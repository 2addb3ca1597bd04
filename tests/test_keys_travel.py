"""Distinct embedded objects travel without the keys that follow from them."""

from pyspark.sql import functions as F

from modelshift.operators import structural as st


def test_keys_of_distinct_objects_are_made_after_the_shuffle(spark):
    docs = spark.range(2000).select("id", F.struct((F.col("id") % 50).alias("n")).alias("o"))
    keyed = st.unnest(docs, "o", key="k", distinct=True)[0]
    plan = keyed._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(" in plan and "md5" not in plan[plan.index("hashpartitioning("):]
    assert len({r["k"] for r in keyed.collect()}) == keyed.count() == 50


def test_keys_of_distinct_objects_are_those_left_behind(spark):
    rows = [(1, (0.0, "a", ("x",))), (2, (-0.0, "a", ("x",))), (3, (float("nan"), None, None)), (4, (None, "b", (None,))),
            (5, None), (6, (0.0, "a", ("x",))), (7, (float("nan"), None, None)), (8, (1.5, "1|1:a", ("x",)))]
    docs = spark.createDataFrame(rows, "id long, o struct<d: double, s: string, t: struct<u: string>>")
    for key_from in (["d", "s", "t.u"], ["s"], None):
        out, left = st.unnest(docs, "o", key="k", key_from=key_from, link="k", distinct=True)
        left = {r["id"]: r["k"] for r in left.collect()}
        out = out.collect()
        assert {r["k"] for r in out} == set(left.values()) - {None}
        assert left[5] is None and left[1] == left[6] and left[3] == left[7]
        if key_from != ["s"]:
            assert left[1] != left[2] and len(out) == 5
