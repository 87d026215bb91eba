import numpy as np

from flowspark.llm import pitman_yor


def test_packed_numbers_come_back():
    for values in ([], [0], [1, 255], [256, 3], [65536, 0, 7]):
        x = np.array(values, np.int64)
        assert pitman_yor.widened(pitman_yor.narrow(x), len(x)).tolist() == values


def test_entries_take_few_bytes():
    """A place among few documents and a small count take a byte each."""
    rng = np.random.default_rng(1)
    words = [rng.integers(0, 1 << 63, 50).astype(np.uint64) for _ in range(200)]
    rows = [r for r in pitman_yor._packed_chunk(list(range(200)), words, np.ones(200, bool), np.zeros(0, np.uint64), 0, np.arange(4)) if not r["docs"]]
    entries = sum(len(r["contexts"]) // 2 for r in rows)
    assert entries == 10_000 and sum(len(r["at"]) + len(r["n"]) for r in rows) == 2 * entries
    found = [pitman_yor.Part.entries(r) for r in rows]
    assert sorted((int(w), int(d)) for words_, _, at, _ in found for w, d in zip(words_, at)) == sorted((int(w), d) for d, ws in enumerate(words) for w in ws)
    assert all((n == 1).all() for *_, n in found)
