from pyspark.sql import functions as F

from larkspur.operators.temporal import publish


def test_a_channel_is_matched_once(spark):
    """However many messages a channel has, a glob is held against it once; a subscriber with two fitting patterns gets two."""
    m = spark.range(4000).select(F.concat(F.lit("c"), (F.col("id") % 4).cast("string")).alias("channel"), F.col("id").alias("message"))
    subs = spark.createDataFrame([("a", "c*", True), ("a", "c[13]", True), ("b", "c2", False)], "subscriber string, pattern string, is_glob boolean")
    got = publish(m, subs)
    assert {tuple(r) for r in got.groupBy("subscriber", "channel").count().collect()} == {("a", "c0", 1000), ("a", "c1", 2000), ("a", "c2", 1000), ("a", "c3", 2000), ("b", "c2", 1000)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("RLIKE") :]
    assert "Aggregate [channel" in below[: below.index("Generate") + 400]
