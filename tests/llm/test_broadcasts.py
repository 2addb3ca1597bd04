"""What Spark may size too low is not broadcast."""

from pyspark.sql import functions as F

from modelshift.llm.simhash import fingerprint_links


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_fingerprints_around_anchors_are_not_broadcast(spark):
    prints = spark.range(500).select(F.xxhash64("id").alias("fp"))
    links = fingerprint_links(prints)
    assert "SortMergeJoin" in plan_of(links) and "Broadcast" not in plan_of(links)
    links.collect()
    assert "Broadcast" not in plan_of(links)


def test_only_anchors_of_others_leave_their_task(spark):
    """Of the about 145 anchors of a fingerprint few are any fingerprint's nearest."""
    prints = spark.range(2000).select(F.xxhash64("id").alias("fp"))
    links = fingerprint_links(prints)
    links.collect()
    plan, sorts = links._jdf.queryExecution().executedPlan().toString(), []
    assert "MapInArrow" in plan

    def rows(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return rows(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return rows(node.plan())
        if kind == "ShuffleExchangeExec":
            sorts.append(node.metrics().apply("shuffleRecordsWritten").value())
        below = node.children()
        for i in range(below.size()):
            rows(below.apply(i))

    rows(links._jdf.queryExecution().executedPlan())
    assert max(sorts) < 10 * 2000
