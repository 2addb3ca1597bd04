"""How often wide rows are shuffled."""

from pyspark.sql import functions as F

from modelshift.operators import structural as st


def shuffled(plan) -> int:
    """Bytes of the shuffles in an executed plan."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return shuffled(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return shuffled(plan.plan())
    own = plan.metrics().apply("dataSize").value() if kind == "ShuffleExchangeExec" else 0
    below = plan.children()
    return own + sum(shuffled(below.apply(i)) for i in range(below.size()))


def test_nested_rows_travel_once(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4KB")
    try:
        parents = spark.range(2000).withColumn("a", F.lit("a"))
        kids = spark.range(6000).select(
            (F.col("id") % 2000).alias("pid"), F.repeat(F.col("id").cast("string"), 500).alias("wide"))
        size = kids.agg(F.sum(F.length("wide"))).first()[0]
        out = st.nest_many(
            parents, kids, {"id": "pid"}, "kids", part_column="part", elements_per_part=100)
        assert sum(len(r["kids"]) for r in out.collect()) == 6000
        assert size < shuffled(out._jdf.queryExecution().executedPlan()) < 1.5 * size
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
