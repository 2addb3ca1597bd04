"""What the judge of personal data learns from."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from modelshift.llm.pii import candidates, learn_judge, training_rows


def test_judge_learns_from_all_documents(spark):
    """All phones lie in documents that come late in the hash order of ids."""
    ids = spark.range(3400).withColumn("late", F.row_number().over(
        Window.orderBy(F.xxhash64("id"), "id")) > 3000)
    phone = F.format_string("call +1 %d %d %d today", 200 + F.pmod("id", F.lit(700)),
                            200 + F.pmod(F.col("id") * 7, F.lit(700)), 1000 + F.pmod(F.col("id") * 13, F.lit(9000)))
    texts = ids.select("id", F.when(F.col("late"), phone).otherwise(
        F.format_string("%d apples on 2024-05-%d 10:30", "id", 10 + F.pmod("id", F.lit(19)))).alias("text"))
    judge = learn_judge(texts)
    assert judge is not None
    assert [s[0] for s in judge.added("call (504) 555-2652 today", [])] == ["phone"]
    assert judge.added("7 apples on 2024-05-12 10:30", []) == []


def test_every_span_of_a_text_is_learned_from():
    mails = " ".join(f"a{k}@b{k}.example" for k in range(120))
    assert sum(label for _, label, _ in training_rows(mails, 1)) >= 120
    dates = " ; ".join(f"2024-05-{10 + k % 20} 10:{10 + k}" for k in range(50, 130))
    assert len(candidates(dates)) > 50
    assert len(training_rows(dates, 1)) == len(candidates(dates))
