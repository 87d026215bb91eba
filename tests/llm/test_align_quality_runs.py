"""Tokenizer alignment, quality ranking and periodic runs against plain loops, and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import SF, empty_docs, odd_docs

from flowspark.llm import align, quality, queries, runs
from flowspark.session import local_session

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "flowspark-llm-tests", "6g")
    yield session
    session.stop()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- 11
def plain_alignment(text, t):
    """Tokens, groups and links of one text by walking both token lists."""
    if not text:
        return [], [], [], []
    a, b = t.a.encode(" " + text, add_special_tokens=False).ids, t.b.encode(text)
    target = (" " + text).encode()
    if b"".join(t.bytes_a[i] for i in a) != target or b"".join(t.bytes_b[i] for i in b) != target:
        return [], [], [], []
    ends = [{sum(len(names[i]) for i in ids[:n + 1]): n for n in range(len(ids))} for ids, names in ((a, t.bytes_a), (b, t.bytes_b))]
    groups, links, x, y = [], [], 0, 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        i, j = ends[0][end] + 1, ends[1][end] + 1
        groups.append((a[x:i], b[y:j]))
        links.append((a[i - 1], b[j - 1]))
        x, y = i, j
    return a, b, groups, links


def check_alignment(rows, docs, t):
    plain = [plain_alignment(d, t) for d in docs]
    counts = Counter(p for x in plain for p in x[3])
    top = Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    want = []
    for a, b, groups, links in plain:
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        want.append((len(a), len(b), len(links), sum(counts[p] == top[p[1]] for p in links), sum(counts[p] for p in links), sha(text) if a else ""))
    got = [(r["n_a"], r["n_b"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in rows]
    assert Counter(got) == Counter(want)


def test_merge_path_pieces():
    rng = random.Random(3)
    for _ in range(300):
        a, b = (np.array(sorted(rng.sample(range(1, 120), rng.randrange(0, 60))), np.int64) for _ in "ab")
        for piece in (1, 2, 3, 7, 1000):
            cross = align.merge_path(a, b, piece)
            assert (np.diff(cross.sum(axis=1))[:-1] == piece).all() and cross[-1].tolist() == [len(a), len(b)]
            i, j = align.common_ends(a, b, piece)
            both = sorted(set(a.tolist()) & set(b.tolist()))
            assert a[i].tolist() == both and b[j].tolist() == both


def test_op11_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = queries.QUERIES["op11_align"](spark, SF).collect()
    assert all(r["n_groups"] == r["n_links"] for r in rows) and sum(r["n_links"] for r in rows) > 10_000
    check_alignment(rows, [d["text"] for d in docs.collect()], align.load(align.MODEL_A, align.MODEL_B))


def test_op11_odd_texts(spark):
    t = align.load(align.MODEL_A, align.MODEL_B)
    texts = [None, "", " ", "  two  blanks  ", "\n\n", "<|endoftext|> is plain", "</s><s><unk> <0x41>", "▁marked", "a\x00b", "é🎉  ü中文",
             "x" * 5000, "word " * 3000, "same text here", "same text here", "﻿bom ﬁ ligature", "tab\tand\r\nline"]
    frame = spark.createDataFrame([(i, x, 5, 6) for i, x in enumerate(texts)], "doc_id long, text string, n_a int, links int")
    found = align.align_counted(frame, digest=True)
    rows = found.orderBy("doc_id").collect()
    check_alignment(rows, texts, t)
    assert [(r["n_a"], r["n_links"], r["groups_sha256"]) for r in rows[:2]] == [(0, 0, "")] * 2
    assert rows[7]["n_a"] == 0  # B reads the mark as a blank
    assert rows[12].asDict() | {"doc_id": 13} == rows[13].asDict()
    assert [r[:3] for r in align.aligned(texts, t, 3)] == [r[:3] for r in align.aligned(texts, t)]
    assert align.align_counted(odd_docs(spark)).count() == odd_docs(spark).count()
    assert align.align_counted(empty_docs(spark)).count() == 0


def test_op11_ranks_are_the_vocabulary():
    t = align.load(align.MODEL_A, align.MODEL_B)
    assert t.ranks is not None
    for c in map(chr, range(0x250)):
        for text in (f"a{c}b", f" {c} ", f"{c}{c}1{c}", f"x {c}\n{c}\t {c}'s", f"  {c}  {c}"):
            assert t.encode_a(text).tolist() == t.a.encode(text, add_special_tokens=False).ids
    for c in "\u0250\u2028\u3000中🎉":
        assert t.encode_a(f"a {c} b").tolist() == t.a.encode(f"a {c} b", add_special_tokens=False).ids


def test_op11_pairs_end_alike(spark):
    """The bound of the broadcast counts: of two linked tokens one's bytes end the other's."""
    t = align.load(align.MODEL_A, align.MODEL_B)
    pairs = align.link_counts(align.align(spark.read.parquet(f"{SF}/documents.parquet"))).collect()
    assert len(pairs) > 1000
    for r in pairs:
        a, b = t.bytes_a[r["pair"] // align.PAIR], t.bytes_b[r["pair"] % align.PAIR]
        assert a.endswith(b) or b.endswith(a)


# ---- 12
def test_op12_held_out_accuracy(spark):
    sf = SF.replace("0.001", "0.01")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.QUERIES["op12_quality"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in held) >= 0.98 * len(held) and len(held) > 100


def test_op12_pairs_and_held_out_labels(spark):
    rated = spark.createDataFrame([(i, int(i % 4 > 0), [float(i)] * 3) for i in range(40)], "id long, quality int, f array<double>")
    pairs = quality.preference_pairs(rated, 5).collect()
    assert len(pairs) == 200 and {p["label"] for p in pairs} == {0.0, 1.0}
    sign = spark.createDataFrame([(i, int(i >= 30), [1.0 * (i >= 30)]) for i in range(40)], "id long, quality int, f array<double>")
    assert {(p["label"], p["d"][0]) for p in quality.preference_pairs(sign, 3).collect()} == {(1.0, 1.0), (0.0, -1.0)}
    docs, labels = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("documents", "labels"))
    found = quality.features(docs)
    clean = labels.select("doc_id", "quality")
    dirty = clean.unionByName(spark.createDataFrame([(None, 0), (1, None), (10**9, 0)], "doc_id long, quality int"))
    one, other = quality.fit(found, clean), quality.fit(found, dirty)
    assert np.allclose([*one.weights, one.cut], [*other.weights, other.cut], rtol=1e-6)


def test_op12_odd_rows(spark):
    docs = odd_docs(spark)
    found = quality.features(docs)
    assert found.count() == docs.count()
    none = quality.fit(found, spark.createDataFrame([], "doc_id long, quality int"))
    one = quality.fit(found, spark.createDataFrame([(4, 1), (7, 1)], "doc_id long, quality int"))
    assert {r["score"] for m in (none, one) for r in quality.score(found, m).collect()} == {0.5}
    both = quality.fit(found, spark.createDataFrame([(4, 1), (8, 1), (3, 1), (5, 0), (1, 0)], "doc_id long, quality int").withColumn("f", F.lit(1)))
    rows = quality.score(found, both).collect()
    assert len(rows) == docs.count() and len({r["score"] for r in rows if r["doc_id"] == 3}) == 1
    assert len({r["score"] for r in rows if r["doc_id"] in (1, 2)}) == 1
    assert quality.score(quality.features(empty_docs(spark)), both).count() == 0
    assert quality.text_features(b"") == quality.text_features(b" \n") == [0.0] * len(quality.FEATURES)


# ---- 13
def plain_runs(w):
    """All runs by comparing the words with themselves at every lag; the smallest period of a stretch stays."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        t = 0
        while t < len(w) - q:
            low = t
            while t < len(w) - q and w[t] == w[t + q]:
                t += 1
            if t - low + q >= max(12, 2 * q):
                found.setdefault((low, t - low + q), q)
            t += t == low
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def drawn_words(rng):
    size = rng.choice([1, 2, 2, 3, 5, 50])
    word = lambda n: [rng.randrange(size) for _ in range(n)]
    kind = rng.randrange(6)
    if kind == 0:
        return word(rng.randrange(200))
    if kind == 1:
        u = word(rng.randrange(1, 120))
        return (u * 4)[:rng.randrange(len(u), 4 * len(u) + 1)] + word(rng.randrange(5))
    if kind == 2:  # periods inside periods
        return word(rng.randrange(9)) + (word(rng.randrange(1, 8)) * rng.randrange(1, 20) + word(rng.randrange(6))) * rng.randrange(2, 5) + word(rng.randrange(9))
    if kind == 3:  # a word with very many runs
        f, g = [0], [0, 1]
        while len(g) < rng.randrange(20, 400):
            f, g = g, g + f
        return g
    if kind == 4:
        return [0] * rng.randrange(300) + [1] + [0] * rng.randrange(300) + [1] + [0] * rng.randrange(200)
    u, v = word(5), word(33)
    return sum((rng.choice([u, v, u * 4]) for _ in range(12)), [])


def test_runs_brute_force():
    rng, total = random.Random(11), 0
    for _ in range(600):
        texts = [drawn_words(rng) for _ in range(rng.randrange(1, 8))]
        x, want = [-1], []
        for i, words in enumerate(texts):
            want += [[s + len(x), n, q] for s, n, q in plain_runs(words)]
            x += words + [-2 - i]
        assert runs.find_runs(np.array(x, np.int32)).tolist() == want
        total += len(want)
    assert total > 5000


def test_op13_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = {}
    for d in docs:
        words, h = WORD.findall(d["text"] or ""), zlib.crc32(str(d["doc_id"]).encode())
        if h % 10 == 0 and words:
            g = h // 10
            a = g % len(words)
            p = 1 + (len(words) - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(len(words))]
        found = plain_runs(words)
        s, n, q = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
        want[d["doc_id"]] = (len(found), s, n, q, 1000 * n // q if found else None,
                             sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(collapsed(words, found)))
    rows = queries.QUERIES["op13_runs"](spark, SF).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in rows} == want and sum(w[0] > 0 for w in want.values()) > 10


def test_op13_odd_rows(spark):
    docs = odd_docs(spark)
    rows = runs.periodic_runs(docs).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(rows) == docs.count()
    for r in rows:
        words = WORD.findall(texts[r["doc_id"]] or "")
        found = plain_runs(words) if len(words) < 1000 else [(0, len(words), 1)]
        assert (r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) == (len(words), found, collapsed(words, found))
    assert runs.periodic_runs(empty_docs(spark)).count() == 0
    tailed = runs.periodic_runs(docs, tail=queries.repeated_tail)
    assert tailed.where(F.col("doc_id").isNull()).first()["n_words"] == 5
