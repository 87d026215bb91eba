"""What a worker of `align` holds: a slice of links at once, and no tokenizers once texts are encoded."""

import sys

import numpy as np
import pyarrow as pa

from flowspark.llm import align, words


def test_links_come_in_slices_and_lose_no_row():
    lengths = [3, 0, 9, 1, 1, 0, 2, 4, 0]
    links = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), pa.array(np.arange(sum(lengths))))
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), links], ["key", "links"])
    parts = list(align.link_slices(iter([batch, batch.slice(4), batch.slice(0, 0)]), 1, 4))
    assert [x for p in parts for x in p.column(0).to_pylist()] == [*range(9), *range(4, 9)]
    assert [x for p in parts for x in p.column(1).to_pylist()] == links.to_pylist() + links.to_pylist()[4:]
    assert all(p.num_rows == 1 or len(p.column(1).flatten()) <= 4 for p in parts) and len(parts) > 4


def test_slices_change_no_count(spark, monkeypatch):
    docs = spark.createDataFrame([(i, None if i == 3 else f"words and more words {i % 4} é " * (i % 5)) for i in range(40)], "doc_id long, text string").coalesce(1)
    rows = lambda: sorted(map(str, align.align_counted(docs).collect()))
    whole = rows()
    monkeypatch.setattr(align, "LINKS", 7)
    monkeypatch.setattr(align, "SLICE", 50)
    assert rows() == whole
    bare = align.align_counted(docs, keep_links=False)
    assert "links" not in bare.columns
    assert sorted(map(str, bare.collect())) == sorted(str(r) for r in align.align_counted(docs).drop("links").collect())


def test_a_worker_forgets_what_later_steps_do_not_use():
    words.kept_by_worker(("align", "x"), lambda: 1)
    words.kept_by_worker(("other", "x"), lambda: 2)
    words.forgotten_by_worker("align")
    kept = sys.modules["pyspark"].__dict__["_kept_by_worker"]
    assert ("align", "x") not in kept and kept.pop(("other", "x")) == 2
