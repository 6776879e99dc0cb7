from pyspark.sql import functions as F

from tidemark.operators import learning


def test_rows_of_few_tasks_are_dealt_over_more(spark, monkeypatch):
    monkeypatch.setattr(learning, "TASK_ROWS", 100)
    rows = spark.range(1000).withColumn("x", F.col("id") * 0.5)
    got = learning.dealt(rows.coalesce(1))
    assert got.rdd.getNumPartitions() >= 10 and sorted(r["id"] for r in got.collect()) == list(range(1000))
    assert learning.dealt(rows.limit(90).coalesce(1)).rdd.getNumPartitions() == 1


def test_compared_regressors_train_on_dealt_rows(spark, monkeypatch):
    monkeypatch.setattr(learning, "TASK_ROWS", 40)
    seen, fit = [], learning.fit
    monkeypatch.setattr(learning, "fit", lambda df, *a, **kw: (seen.append(df.rdd.getNumPartitions()), fit(df, *a, **kw))[1])
    rows = spark.range(400).withColumn("x", F.col("id") % 7 * 1.0).withColumn("y", F.col("x") * 2 + 1).coalesce(1)
    got = learning.compare_regressors(rows.where("id % 5 > 0"), rows.where("id % 5 = 0"), {"linear": {}}, ["x"], [], "y", ["id"])
    assert min(seen) >= 8 and {r["model"]: r["sample_size"] for r in got.collect()} == {"linear": 80, "ensemble": 80}
