"""A key search over more rows has more tasks, not larger ones."""

from modelshift.operators import discovery


def test_tasks_of_a_key_search_do_not_grow_with_the_table(spark, monkeypatch):
    names = ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes")
    seen, measured = [], discovery._measured

    def spy(df, *args):
        seen.append([spark.conf.get(n) for n in names])
        return measured(df, *args)

    monkeypatch.setattr(discovery, "_measured", spy)
    monkeypatch.setattr(discovery, "VALUES_OF_A_TASK", 100, raising=False)
    before = [spark.conf.get(n) for n in names]
    df = spark.range(3000).selectExpr("id % 50 AS a", "id div 50 AS b", "1 AS c")
    assert [r["key"] for r in discovery.discover_keys(df, "t").collect()] == ["a,b"]
    assert seen and all(x == ["90", "16m"] for x in seen)  # 9,000 values
    assert [spark.conf.get(n) for n in names] == before
