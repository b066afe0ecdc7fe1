from pyspark.sql import functions as F

from larkspur.operators import keyed as K
from larkspur.plans.more import string_incrby_overflow


def test_increments_wider_than_64_bits(spark, tmp_path):
    """An increment beyond 64 bits is no error and counts: values are null from there on, until the sum is back."""
    spark.createDataFrame([(1, 1), (1, 400_000), (1, 400_001), (2, 2)], "user_id long, event_id long").write.parquet(str(tmp_path / "events.parquet"))
    got = {r.event_id: r.value for r in string_incrby_overflow(spark, str(tmp_path)).collect()}
    assert got == {1: 30000000000000, 2: 60000000000000, 400_000: None, 400_001: None}
    log = spark.createDataFrame([(1, "9223372036854775808"), (2, "-9223372036854775807"), (3, None)], "o int, d string")
    wide = log.select(F.lit("k").alias("k"), "o", F.col("d").cast("decimal(20,0)").alias("d"))
    assert [r.value for r in K.running(wide, ["k"], "o", "d").orderBy("o").collect()] == [None, 1, 1]
    text = log.select(F.lit("k").alias("k"), "o", "d")
    assert [r.value for r in K.running(text, ["k"], "o", "d").orderBy("o").collect()] == [0, -9223372036854775807, -9223372036854775807]
