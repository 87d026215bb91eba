from pyspark.sql import functions as F

from flowspark.llm import pii


class Stop(Exception):
    pass


def test_trees_see_every_candidate_of_their_half(spark, monkeypatch):
    n = 30_000
    rows = spark.range(n).select(F.col("id").alias("key"), F.lit("ip").alias("kind"), F.lit(0).alias("start"), F.lit(7).alias("end"),
                                 F.lit("1.2.3.4").alias("text"), F.lit("").alias("before"), F.lit("").alias("after"), (F.col("id") % 2).cast("int").alias("weak"))
    seen = []

    class Trees:
        def __init__(self, **kw):
            pass

        def fit(self, train):
            seen.append(train.count())
            raise Stop

    monkeypatch.setattr(pii, "GBTClassifier", Trees)
    try:
        pii.accepted(rows)
    except Stop:
        pass
    assert seen == [rows.where(F.pmod(F.xxhash64("key", F.lit("half")), F.lit(2)) == 0).count()]
