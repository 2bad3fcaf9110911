"""No task that holds all rows of a key with few values."""

from pyspark.sql import functions as F

from riskloom.operators import store


def test_uses_are_not_shuffled_by_model(spark):
    tests = spark.createDataFrame([], store.TABLES["ab_tests"])
    for model in ("elp", "isa"):
        tests = store.start_ab_test(tests, model, "1", "2", 0.5, "2024-01-01 00:00:00")
    uses = spark.range(100).select(F.when(F.col("id") % 2 == 0, "elp").otherwise("isa").alias("model"), "id", F.timestamp_seconds(F.lit(1_800_000_000)).alias("at"))
    out = store.exposures(tests, uses, "id", "at")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # the planner would not by itself
    plan = out._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin [model" in plan
    assert {(r.model, r.n) for r in out.groupBy("model").agg(F.count("*").alias("n")).collect()} == {("elp", 50), ("isa", 50)}
