"""What a task of the toxicity operator holds: a text once, and few words."""

import numpy as np
from pyspark.sql import functions as F

from flowspark.llm import toxicity


def model() -> toxicity.Model:
    width = 2 * toxicity.LEXICONS + 4
    return toxicity.Model({b"wbad": 0}, [0], np.array([3.0] + [0.0] * 2 * width), -2.0, np.zeros(width), np.zeros((width, width)))


def test_a_kept_text_goes_to_the_task_once(spark):
    docs = spark.createDataFrame([(1, "bad words", "x"), (2, None, None), (2, "", "y"), (None, "good", "z")], "doc_id long, text string, source string")
    scored = toxicity.score(docs, model(), keep=True)
    assert scored.columns == ["doc_id", "text", "source", "score"]
    rows = sorted((tuple(r) for r in scored.collect()), key=str)
    assert {r[:3] for r in rows} == {tuple(r) for r in docs.collect()}
    by_text = {r[1]: r[3] for r in rows}
    assert by_text["bad words"] > 0.7 > by_text["good"] == by_text[""] == by_text[None]
    plan = scored._jdf.queryExecution().analyzed().toString()
    assert "_text" not in plan
    swapped = toxicity.score(docs.select("text", "doc_id", F.lit(0.5).alias("score")), model(), keep=True)
    assert swapped.columns == ["text", "doc_id", "score"] and {r["text"]: r["score"] for r in swapped.collect()} == by_text


def test_words_without_terms_share_one_entry():
    watched, known = toxicity.levels({b"wbad": 0}), {}
    toxicity.evidence("some harmless words and one bad", watched, [0], known)
    assert len({id(v) for k, v in known.items() if k != b"bad"}) == 1 and known[b"bad"][0] == (b"wbad",)
