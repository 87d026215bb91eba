import pytest
from pyspark.sql import functions as F

from flowspark.operators.select import population_diversity


def test_masks_computed_in_the_plan(spark, tmp_path):
    """The masks are no stored column but an expression, and the table is read from files."""
    spark.range(6000).select((F.col("id") % 997).alias("k")).write.parquet(str(tmp_path / "t"))
    bits = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.pmod(F.floor(F.col("k") / F.pow(F.lit(2), i)), F.lit(2)).cast("byte"))
    got = population_diversity(spark.read.parquet(str(tmp_path / "t")).select(bits.alias("mask")), "mask")
    ones = [sum((i % 997) >> b & 1 for i in range(6000)) for b in range(8)]
    want = sum(n * (6000 - n) for n in ones) / (6000 * 5999 / 2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert got.collect()[0][0] == pytest.approx(want)
        assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_empty_and_unequal_masks(spark):
    df = spark.createDataFrame([([],), ([],), ([1, 0],), ([0, 0],), ([1],)], "mask array<int>")
    assert population_diversity(df, "mask").first()[0] == 0.5
