import numpy as np
from pyspark.sql import functions as F

from flowspark.llm import lines


def test_band_sends_links_not_pairs(spark):
    """A band of lines that are all similar, or all just not, gives fewer rows than it has lines."""
    rng = np.random.default_rng(4)
    word = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n))
    for own, want in ((8, 1), (40, 120)):
        stem = word(120)
        docs = spark.createDataFrame([(i, stem + word(own)) for i in range(120)], "doc_id long, text string")
        signed = lines.signatures(docs, "doc_id", "text").cache()
        texts = lines.lines_of(docs, "text").select("id", "line")
        named = signed.select("id", F.lit(1).alias("k"), F.col("id").alias("root"))
        links = lines.band_links(named, texts, signed.select("id", "marks")).collect()
        assert len(links) == 120 - want


def test_marks_tell_equal_minima():
    rng = np.random.default_rng(6)
    xs = ["".join(rng.choice(list("abcdef "), 80)) for _ in range(60)]
    least, _ = lines.minima(xs + [x[:40] + "#" + x[41:] for x in xs])
    marks = lines.planes(least).view(np.uint64)
    unlike = np.bitwise_count(np.bitwise_or.reduce(marks[:60] ^ marks[60:], axis=1))
    equal = (least[:60] == least[60:]).sum(axis=1)
    assert (60 - unlike >= equal).all() and (60 - unlike - equal).max() <= 6
