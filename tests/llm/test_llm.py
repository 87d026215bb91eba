"""Every operator against brute force on small frames, and on nulls, empty and repeated rows, empty tables and extra columns."""

import hashlib
import math
import re
import sys
import os
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from flowspark.llm import ann, caps, components, lines, mixing, pieces, pii, pitman_yor, queries, simhash, toxicity, url_rules  # noqa: E402
from flowspark.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "flowspark-llm-tests", "6g")
    yield session
    session.stop()


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def odd_docs(spark):
    """Null and empty texts, null source and key, one very long text, repeated rows, ties, clashing extra columns."""
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, "one two three four five six", None, None), (3, "one two three four five six", None, None),
            (4, "One TWO three\tfour five six", "en", "b"), (None, "no key at all here", "en", "b"), (5, "word " * 30000, "en", "b"), (6, "\n\n", "en", ""),
            (7, "x" * 20000, "en", "b"), (8, "tail of things é\u2581\u00a0ü 🎉", "de", "a")]
    rows = [(*r, len(r[1] or "")) for r in rows]
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(7) for c in ("id", "key", "fp", "score", "ids", "n_lines", "a", "root", "size", "_b")})


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def union_find(ids, pairs):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (7, 7), (3, 1), (10, 9), (9, 8), (8, 4), (None, 3)] + [(100, 100 + i) for i in range(1, 300)] + [(500 + i, 501 + i) for i in range(200)]
    found = {r["id"]: r["component_id"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [e for e in edges if None not in e and e[0] != e[1]]
    assert found == union_find({x for e in real for x in e}, real)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 1
def test_op1_counts_and_quality(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    tokens = {d["doc_id"]: [*WORDS.findall(lower(d["text"])), None] for d in docs}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tokens}
    counts = Counter(t for i, ts in tokens.items() if not held[i] for t in ts)
    n, v = sum(counts.values()), len(counts)
    rows = queries.QUERIES["op1_pitman_yor"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ts = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(ts), sum(counts[t] > 0 for t in ts), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts), rel_tol=1e-9)
    out = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_op1_is_a_probability(spark):
    """Over two-token texts 'word end' and the bare end, all probabilities from the start sum to one."""
    train = [(i, t) for i, t in enumerate(["a b c", "a b", "b c a a", "c", "a b c d"] * 5)]
    asks = [(100 + i, w) for i, w in enumerate(["a", "b", "c", "d", "never"])] + [(200, "")]
    docs = spark.createDataFrame(train + asks, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in pitman_yor.score_texts(docs, F.col("doc_id") >= 100).collect()}
    assert all(s < 0 for s in got.values())
    assert got[100] > got[103] > got[104]  # frequent, rare, unseen
    again = {r["doc_id"]: r["score"] for r in pitman_yor.score_texts(docs, F.col("doc_id") >= 100).collect()}
    assert got == again


def test_op1_seating():
    rng, log_s = np.random.default_rng(1), pitman_yor.stirling(0.5)
    customers = np.array([1, 2, 5, 5000])
    tables = pitman_yor.draw_tables(customers, np.array([3.0] * 4), np.array([0.01] * 4), 0.5, 0.5, log_s, rng)
    assert (tables >= 1).all() and (tables <= customers).all() and tables[0] == 1
    # two customers: exact odds of one table or two
    many = pitman_yor.draw_tables(np.full(200_000, 2), np.full(200_000, 3.0), np.full(200_000, 0.2), 0.5, 0.5, log_s, rng)
    one, two = (1 - 0.5), (0.5 + 0.5 * 4) * 0.2
    assert abs((many == 2).mean() - two / (one + two)) < 0.01


def test_op1_odd_rows(spark):
    got = pitman_yor.score_texts(odd_docs(spark), F.col("doc_id") == 4).collect()
    assert len(got) == 10 and sorted(r["n_tokens"] for r in got)[:2] == [1, 1] and all(r["score"] < 0 for r in got)
    assert pitman_yor.score_texts(empty_docs(spark), F.lit(False)).count() == 0
    assert all(r["n_known"] == 0 for r in pitman_yor.score_texts(odd_docs(spark), F.lit(True)).collect())


# ---- 2
def test_op2_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.QUERIES["op2_toxicity"](spark, sf)
    assert rows.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    seen = rows.where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    caught = [r["predicted"] for r in seen if r["toxic"] == 1]
    false = [r["predicted"] for r in seen if r["toxic"] == 0]
    assert sum(caught) >= 0.8 * len(caught) and sum(false) <= 0.05 * len(false)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in seen)


def test_op2_label_model_discounts_copies():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.2
    votes = np.zeros((4000, 4), np.int8)
    good = np.where(rng.random(4000) < 0.9, truth, ~truth)
    votes[:, 0] = np.where(good, 1, -1)
    noisy = np.where(rng.random(4000) < 0.65, truth, ~truth)
    votes[:, 1] = votes[:, 2] = np.where(noisy, 1, -1)
    votes[:, 3] = np.where(np.where(rng.random(4000) < 0.9, truth, ~truth), 1, -1)
    post, right, corr = toxicity.label_model(votes, 0.2)
    assert corr[1, 2] > 0.5 and ((post > 0.5) == truth).mean() > 0.85 and right[0] > right[1]


def test_op2_odd_rows(spark):
    docs = odd_docs(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, none)
    got = toxicity.score(docs, model, keep=True)
    assert got.columns == [c for c in docs.columns if c != "score"] + ["score"] and all(r["score"] < 0.1 for r in got.collect())
    some = spark.createDataFrame([(3, 1, 0), (4, 1, 1), (None, 0, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, some)).count() == 10
    assert toxicity.score(empty_docs(spark), toxicity.fit(empty_docs(spark), some)).count() == 0


# ---- 3
def vector_rows(n=260, seed=4):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, 16))
    rows = [(i, (base[i] if i % 3 else base[i // 30 * 30] + rng.standard_normal(16) * 0.12).tolist(), i // 130) for i in range(n)]
    rows += [(1000, rows[5][1], 0), (1001, rows[5][1], None), (1002, None, 0), (1003, [0.0] * 16, 0), (1004, [float("nan")] * 16, 0), (1005, [1.0], 0),
             (1006, [None] + [1.0] * 15, 1), (1007, [float("inf")] + [1.0] * 15, 1), (1008, (2 * np.array(rows[5][1])).tolist(), 0)]
    return rows


def test_op3_equals_brute_force(spark):
    rows = vector_rows()
    good = [r for r in rows if r[2] is not None and r[1] and len(r[1]) == 16 and None not in r[1] and np.isfinite(r[1]).all() and np.any(r[1])]
    unit = np.array([np.array(r[1]) / np.linalg.norm(r[1]) for r in good])
    near = (unit @ unit.T >= 0.98) & (np.array([r[2] for r in good])[:, None] == np.array([r[2] for r in good])[None])
    np.fill_diagonal(near, False)
    ids = [r[0] for r in good]
    roots = union_find([r[0] for r in rows], [(ids[i], ids[j]) for i, j in zip(*np.nonzero(near))])
    degree = dict(zip(ids, near.sum(axis=1)))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("id", F.lit(1)).withColumn("n", F.lit(1))
    for block in (1024, 8):  # the small one cuts crowds into pairs of blocks
        got = {r["vec_id"]: r for r in caps.near_vectors(df, block=block).collect()}
        assert len(got) == len(rows)
        for i, r in got.items():
            assert (r["n_links"], r["component_id"], r["kept"]) == (degree.get(i, 0), roots[i], roots[i] == i), (block, i)
    assert caps.near_vectors(df.limit(0)).count() == 0


# ---- 4

def test_op4_keeps_one_line_of_each_component(spark):
    docs = [r for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    every = sorted({l.strip(" ").lower() for d in docs for l in d["text"].split("\n")} - {""})
    got = {r["doc_id"]: r for r in queries.QUERIES["op4_lines"](spark, SF).collect()}
    number = {l: i for i, l in enumerate(every)}
    grams = [{l[i:i + 5] for i in range(len(l) - 4)} for l in every]
    pairs = [(i, j) for i in range(len(every)) for j in range(i + 1, len(every))
             if grams[i] and grams[j] and 0.5 < len(grams[i]) / len(grams[j]) < 2 and len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j])]
    roots, seen, wrong, lines_in = union_find(range(len(every)), pairs), set(), 0, 0
    for d in sorted(docs, key=lambda d: d["doc_id"]):
        keep = []
        for line in d["text"].split("\n"):
            norm = line.strip(" ").lower()
            if norm and roots[number[norm]] in seen:
                continue
            seen.add(roots[number[norm]]) if norm else None
            keep.append(line)
        wrong += "\n".join(keep) != got[d["doc_id"]]["text"]
        lines_in += got[d["doc_id"]]["n_lines"] == len(d["text"].split("\n"))
    assert lines_in == len(docs) and wrong <= 0.02 * len(docs)  # banding may miss a link of barely 0.8


def test_op4_odd_rows(spark):
    got = lines.dedup_lines(odd_docs(spark)).collect()
    assert len(got) == 10
    by = {r["doc_id"]: r for r in got}
    assert by[1]["text"] is None and by[1]["n_lines"] == 0 and by[2]["text"] == "" and by[6]["text"] == "\n\n"
    assert [r["text"] for r in got if r["doc_id"] == 3] == ["one two three four five six"] * 2
    crowd = spark.createDataFrame([(i, f"the very same long line of words with number {i} at its end and then some more of it\n{hashlib.md5(str(i).encode()).hexdigest()}") for i in range(60)], "doc_id long, text string")
    assert lines.dedup_lines(crowd).agg(F.sum("n_dropped")).first()[0] == 59
    assert lines.dedup_lines(empty_docs(spark)).count() == 0


def similarity(a, b):
    a, b = ({x[i:i + 5] for i in range(len(x) - 4)} for x in (a, b))
    return len(a & b) / len(a | b)


def test_op4_lines_without_spaces_short_and_with_one_typo(spark):
    """Pairs of lines that nothing else resembles: the second of each goes if they are similar enough, at a recall of 0.99."""
    rng, pairs = np.random.default_rng(3), [("abcdefgh", "abcdefghi")]
    for alphabet in ("abcdefghijklmnopqrstuvwxyz0123456789/", "\u4e00\u4eba\u5927\u5c0f\u4e2d\u56fd\u6c34\u706b\u5c71\u77f3\u7530\u571f\u65e5\u6708\u91d1\u6728\u624b\u8db3\u53e3\u76ee"):
        for k in range(60):
            line = "".join(rng.choice(list(alphabet), 60))
            pairs.append((line, line[:k % 10] + "#" + line[k % 10 + 1:]))  # in the first ten characters
    for k in range(60):
        line = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz0123456789"), 8 + k % 2))
        pairs.append((line, line + "#"))  # 0.8 and a little more
    for k in range(60):
        line = " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 4)) for _ in range(12))
        pairs.append((line, line[:7 + k % 40] + "#" + line[8 + k % 40:]))
    near = [p for p in pairs if similarity(*p) >= 0.8]
    assert len(near) > 200
    docs = spark.createDataFrame([(2 * i + j, line) for i, p in enumerate(near) for j, line in enumerate(p)], "doc_id long, text string")
    dropped = {r["doc_id"] for r in lines.dedup_lines(docs).where("n_dropped = 1").collect()}
    assert dropped <= {2 * i + 1 for i in range(len(near))} and 1 in dropped and len(dropped) >= 0.99 * len(near)
    apart = spark.createDataFrame([(i, x) for i, x in enumerate(["abcd", "abce", "abcdx", "", "abcd "])], "doc_id long, text string")
    assert {r["doc_id"] for r in lines.dedup_lines(apart).where("n_dropped = 1").collect()} == {4}


def test_op4_crowds_of_families_equal_brute_force(spark, monkeypatch):
    """Two families in one crowd, pairs under common boilerplate, and a chain: no hub resembles them all."""
    rng = np.random.default_rng(8)
    word = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n))
    boiler = " ".join(word(7) for _ in range(12))
    rows = []
    for _ in range(150):  # near copies in twos, about 65 % boilerplate
        own = word(42)
        rows += [boiler + own, boiler + own[:20] + "#" + own[21:]]
    for family in range(2):
        stem = boiler + word(40)
        rows += [stem + word(6) for _ in range(150)]
    chain = list(boiler + word(50))
    for at in range(60):
        rows.append("".join(chain))
        chain[len(boiler) - 20 + at:len(boiler) - 18 + at] = word(2)
    rows = sorted(set(rows))
    order = rng.permutation(len(rows))
    rows = [rows[i] for i in order]
    grams = [{x[i:i + 5] for i in range(len(x) - 4)} for x in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j])]
    roots = union_find(range(len(rows)), pairs)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    # one band for all: what the crowd step makes of it is then exact
    bands = docs.select(F.xxhash64("text").alias("id"), F.lit(1).alias("k"), F.lit(len(rows)).alias("size"))
    number = {r["id"]: r["doc_id"] for r in docs.select("doc_id", F.xxhash64("text").alias("id")).collect()}
    marks = lines.signatures(docs, "doc_id", "text").select("id", "marks").cache()
    for block, by in ((128, None), (32, None), (1024, marks), (128, marks)):
        monkeypatch.setattr(lines, "BLOCK", block)
        found = {number[r["id"]]: number[r["root"]] for r in lines.components_of(bands, docs, "text", by).collect()}
        assert len({roots[i] for i in roots}) > 150 and len(found) == sum(n for n in Counter(roots.values()).values() if n > 1)
        assert {frozenset(i for i in found if found[i] == r) for r in set(found.values())} == {frozenset(i for i in found if roots[i] == r) for r in {roots[i] for i in found}}


# ---- 5
def simhash_plain(text):
    words = [w.encode() for w in WORDS.findall(lower(text))]
    grams = [b" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_op5_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    fps = {d["doc_id"]: simhash_plain(d["text"]) for d in docs}
    ids = sorted(fps)
    roots = union_find(ids, [(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= 4])
    got = queries.QUERIES["op5_simhash"](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r["fingerprint"], r["component_id"]) == (f"{fps[r['doc_id']]:016x}", roots[r["doc_id"]])


def test_op5_covering(spark):
    masks = [m % (1 << 64) for m in simhash.covering_masks(4, 11)]
    rng = np.random.default_rng(2)
    assert len(masks) == 31 and all(any(m & bits == 0 for m in masks) for bits in (sum(1 << int(b) for b in rng.choice(64, 4, replace=False)) for _ in range(3000)))
    values = rng.integers(0, 1 << 62, 40).tolist()
    values += [v ^ sum(1 << int(b) for b in rng.choice(62, k, replace=False)) for v in values[:20] for k in (3, 4, 5)] + [values[0] ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a)]
    values = sorted(set(values))
    truth = union_find(values, [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 4])
    for hot in (256, 4):  # the small one cuts buckets by the second family
        found = {r["fp"]: r["root"] for r in simhash.fingerprint_components(spark.createDataFrame([(v,) for v in values], "fp long"), hot=hot).collect()}
        assert {v: found.get(v, v) for v in values} == truth


def test_op5_odd_rows(spark):
    got = simhash.near_duplicates(odd_docs(spark)).collect()
    assert len(got) == 10
    zero = [r for r in got if r["fingerprint"] == "0" * 16]
    assert {r["doc_id"] for r in zero} == {1, 2, 6} and {r["component_id"] for r in zero} == {1}
    assert simhash.near_duplicates(empty_docs(spark)).count() == 0


# ---- 6
FORMS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for nr, (kind, form) in enumerate(FORMS.items()):
        for m in re.finditer(form, text or ""):
            d = [int(c) for c in m[0] if c.isdigit()]
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0,
                  "card": 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10 == 0, "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), nr, m.end()))
    return sorted(out)


def test_op6_equals_regular_expressions(spark):
    odd = ["a@b.c%x@d.com", "x@y", "1.2.3.4.5.6.7.8 300.1.1.1 0001.002.3.04", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (555) 123-4567 +12 3", "é🎉 me.x@mail.example.org, tél",
           "9 " * 6000, "7" * 30000, "a" * 30000 + "@b.cc", None, "", "@", "1.1.1", "+1" + "(" * 5000 + "2"]
    rows = [(i, t) for i, t in enumerate(odd)] + [(1000 + r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("start", F.lit(2))
    got = {r["doc_id"]: r for r in pii.find_personal_data(df).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        assert [(s["start"], s["nr"], s["end"]) for s in got[i]["base"]] == plain_spans(t), i
        spans = sorted((s["start"], s["end"]) for s in got[i]["added"])
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    assert pii.find_personal_data(df.limit(0)).count() == 0


def test_op6_digest(spark):
    for r in queries.QUERIES["op6_pii"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").collect():
        spans = plain_spans(r["text"])
        text = ",".join(f"{list(FORMS)[k]}:{a}:{b}" for a, k, b in spans)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest() and set(filter(None, text.split(","))) <= set(r["spans"].split(","))
        assert [r[f"n_{k}"] for k in FORMS] == [sum(s[1] == i for s in spans) for i in range(4)]


# ---- 7
def test_op7_targets(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.QUERIES["op7_mix"](spark, SF).collect()
    assert len(got) == len(docs) and sorted(map(tuple, got)) == sorted(map(tuple, queries.QUERIES["op7_mix"](spark, SF).collect()))
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        d = docs[r["doc_id"]]
        assert r["size"] == len(WORDS.findall(d["text"])) and 0 <= r["taken"] <= 2 * r["size"]
        size[d["source"]] += r["size"]
        taken[d["source"]] += r["taken"]
        target[d["source"]] = r["target"]
    want = mixing.shares([size[s] for s in sorted(size)], [(3, 1, 2)[i % 3] for i in range(len(size))], 1.5 * sum(size.values()), 2)
    for s, t in zip(sorted(size), want):
        assert math.isclose(target[s], t) and abs(taken[s] - t) <= 2 * mixing.BLOCK
    assert math.isclose(sum(want), 1.5 * sum(size.values()))


def test_op7_parts(spark):
    assert mixing.shares([10, 100, 0], [3, 1, 2], 100, 2) == [20, 80, 0]
    for n in (1, 2, 7, 100):
        df = spark.range(n).select(mixing._permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3)).alias("to"))
        assert sorted(r["to"] for r in df.collect()) == list(range(n))
    plan = [{"slots": 50}, {"slots": 7}, {"slots": 0}, {"slots": 33}]
    draws = mixing.draw_shards(plan, 10, 1)
    assert draws.groupby("nr")["n"].sum().to_dict() == {0: 50, 1: 7, 3: 33} and (draws.groupby("shard")["n"].sum() == 10).all()
    docs = spark.createDataFrame([(i, f"d{i} " + " ".join(f"w{j}" for j in range(i * 13)), "s%d" % (i % 2)) for i in range(40)], "doc_id long, text string, source string")
    documents, blocks = mixing.mix(docs, block=16)
    assert blocks.groupBy("key" if "key" in blocks.columns else "doc_id").agg(F.sum("words").alias("w")).join(documents, "doc_id").where("w <> taken").count() == 0
    texts = mixing.mixed_texts(docs, block=16)
    assert texts.select(F.sum(mixing.word_count(F.col("text")))).first()[0] == documents.agg(F.sum("taken")).first()[0]


def test_op7_odd_rows(spark):
    documents, blocks = mixing.mix(odd_docs(spark))
    assert documents.count() == 10 and documents.where("size = 0").agg(F.max("taken")).first()[0] == 0
    assert mixing.mixed_texts(odd_docs(spark)).columns == odd_docs(spark).columns
    documents, blocks = mixing.mix(empty_docs(spark))
    assert documents.count() == 0 and blocks.count() == 0


# ---- 8
def test_op8_pieces(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plain = pieces.encode(docs, dropout=0.0, check=True).collect()
    assert all(r["ids"] == model.encode(r["text"]) and r["lossless"] for r in plain)
    varied = pieces.encode(docs, seed=1).collect()
    other = pieces.encode(docs, seed=2).collect()
    assert varied == pieces.encode(docs, seed=1).collect()
    assert sum(a["ids"] != b["ids"] for a, b in zip(varied, other)) > 0.9 * len(varied)
    back = pieces.decode(pieces.encode(docs)).select("doc_id", F.col("text").alias("t")).join(docs, "doc_id")
    assert back.where("t = text").count() == docs.count()


def test_op8_many_equal_one():
    vocabulary = pieces.Pieces.load(pieces.MODEL)
    segments = ["▁the", "▁thentien", "▁▁▁x", "é🎉", "▁", "▁12345", "\n", "▁blebler", "▁mooooon"]
    for rate in (0.0, 0.3, 1.0):
        assert vocabulary.merge_many(segments, rate, 5) == [pieces.packed(vocabulary.merge(s, rate, 5)) for s in segments]


def test_op8_every_occurrence_has_its_own_draw(spark):
    """Occurrences of a word in a document, documents and passes are cut in many ways, each as the agenda alone cuts it."""
    word = "unbelievable"
    docs = spark.createDataFrame([(i, " ".join([word] * 200)) for i in range(6)] + [(0, " ".join([word] * 200))], "doc_id long, text string")
    rows = corpus_pipeline.encoded(spark, docs, SF).collect()
    assert all(len(r["ids"]) == r["n_pieces"] for r in rows) and len({tuple(r["ids"]) for r in rows}) == 7
    vocabulary = pieces.Pieces.load(pieces.MODEL)
    encoder = pieces.Encoder(vocabulary, 0.1)
    texts = [" ".join([word] * 300) + " \u2581 " + "x" * 40, None, "", "one two\tthree \u4eba \U0001f389 " * 20]
    got = encoder.encode(texts, [5, 6, 7, 2 ** 64 - 8])
    assert got[1] is None and got[2] == b""
    assert [vocabulary.decode(np.frombuffer(g, "<i4").tolist()) for g in (got[0], got[3])] == [texts[0], texts[3]]
    base = pieces.occurrence_bases(np.full(300, 5, np.uint64), np.arange(300))
    alone = [pieces.packed(vocabulary.merge("\u2581" + word, 0.1, base=int(b))) for b in base]
    assert got[0].startswith(b"".join(alone)) and len(set(alone)) > 4


def test_op8_odd_rows(spark):
    got = {r["doc_id"]: r for r in pieces.encode(odd_docs(spark), check=True).collect()}
    assert got[1]["ids"] is None and got[2]["ids"] == [] and all(r["lossless"] for r in got.values()) and got[1]["root"] == 7
    assert pieces.encode(empty_docs(spark)).count() == 0
    assert {r["doc_id"]: r["text"] for r in pieces.decode(pieces.encode(odd_docs(spark))).collect()} == {r["doc_id"]: r["text"] for r in odd_docs(spark).collect()}


# ---- 9
def test_op9_equals_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = con.execute(queries.ORACLES["op9_url_rules"])
    names = [d[0] for d in want.description]
    got = sorted(tuple(str(r[c]) for c in names) for r in queries.QUERIES["op9_url_rules"](spark, SF).collect())
    assert got == sorted(tuple(map(str, r)) for r in want.fetchall())


def test_op9_nested_and_odd(spark):
    rules = spark.createDataFrame([("com", "/", "block"), ("X.com", "/a/", "allow"), ("x.com", "/a/b/", "block"), ("x.com", "/c", "block"), ("", "/", "block"), ("x.com", "/a/", "block"), ("y.x.com", "", "allow")],
                                  "host string, path string, verdict string")
    urls = ["http://x.com/a/b/c", "http://q.x.com/a/z", "http://x.com/b", "http://xx.com/a/", "ftp://y.x.com/a/b/", "http://com", None, "", "no scheme", "http://X.COM/A/?q", "http://x.com/cc#f", "a://b://c/d", "http://x.com/a/b/c"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(0, urls[0]), (None, urls[1])], "page_id long, url string").withColumns({"suffix": F.lit(1), "kind": F.lit(1), "rule": F.lit(1)})
    got = {(r["page_id"], r["host"]): (r["path"], r["rule"], r["verdict"]) for r in url_rules.judge_urls(pages, rules, slices=3).collect()}
    assert url_rules.judge_urls(pages, rules).count() == 15
    assert got[0, "x.com"] == ("/a/b/c", "x.com/a/b/", "block") and got[1, "q.x.com"] == ("/a/z", "x.com/a/", "allow") and got[None, "q.x.com"][1] == "x.com/a/"
    assert got[2, "x.com"][1] == "com/" and got[3, "xx.com"][1] == "com/" and got[4, "y.x.com"][1] == "x.com/a/b/" and got[5, "com"] == ("", None, "allow")
    assert got[6, ""] == got[7, ""] == got[8, ""] == ("", None, "allow") and got[9, "x.com"] == ("/A/", "com/", "block") and got[10, "x.com"][1] == "x.com/c" and got[11, "b:"] == ("//c/d", None, "allow")
    assert url_rules.judge_urls(pages.limit(0), rules).count() == 0 and url_rules.judge_urls(pages, rules.limit(0)).where("rule is null").count() == 15


# ---- 10
def test_op10_recall(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in table]), np.array([r["embedding"] for r in table], float)
    got = queries.QUERIES["op10_ann"](spark, SF).collect()
    hit = total = 0
    for q in ids[ids % 20 == 0]:
        own = [r for r in got if r["query_id"] == q]
        score = x @ x[ids == q][0]
        assert [r["rank"] for r in sorted(own, key=lambda r: (-r["score"], r["vec_id"]))] == list(range(1, 21))
        assert all(abs(r["score"] - score[ids == r["vec_id"]][0]) < 1e-12 for r in own)
        best = set(ids[ids != q][np.lexsort((ids[ids != q], -score[ids != q]))[:20]])
        hit, total = hit + len(best & {r["vec_id"] for r in own}), total + 20
    assert hit >= 0.9 * total


def test_op10_odd_rows(spark):
    rows = vector_rows(30) + [(0, vector_rows(30)[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("id", F.lit(1)).withColumn("rank", F.lit(1))
    got = ann.nearest(df, df.where("vec_id in (0, 20, 1002, 1003)"), k=500).collect()
    usable = {r[0] for r in rows} - {1002, 1003, 1004, 1005, 1006, 1007}
    for q in (0, 20):
        assert {r["vec_id"] for r in got if r["query_id"] == q} == usable - {q}
    assert {r["query_id"] for r in got} == {0, 20}
    ties = [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == 20), key=lambda r: r["rank"]) if r["vec_id"] in (5, 1000, 1001)]
    assert ties == [5, 1000, 1001]
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


# ---- pipeline
def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, before, SF).write.parquet(path)
        after = spark.read.parquet(path)
        if name != "pieces":
            assert after.columns == docs.columns
        if name == "toxicity":
            labels = spark.read.parquet(f"{SF}/labels.parquet")
            gone = before.join(after, "doc_id", "left_anti").join(labels, "doc_id")
            assert gone.where("toxic = 0").count() <= 1 and after.count() > 0.7 * before.count()
        if name == "lines":
            assert after.count() == before.count() and after.where("n_chars <> length(text)").count() == 0
        if name == "simhash":
            groups = {r["component_id"] for r in simhash.near_duplicates(before).collect()}
            assert {r["doc_id"] for r in after.collect()} == groups and after.count() == len(groups)
        if name == "mixing":
            words = lambda d: d.select(F.sum(mixing.word_count(F.col("text")))).first()[0]
            assert abs(words(after) - 1.5 * words(before)) < 0.05 * words(before)
        before = after
    assert before.where("ids is null or n_pieces <> size(ids)").count() == 0


def test_pipeline_odd_rows(spark, tmp_path):
    spark.createDataFrame([(3, 1, 0), (4, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for nr, docs in enumerate((odd_docs(spark), empty_docs(spark))):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            out.write.parquet(str(tmp_path / f"{nr}{name}"))
            docs = spark.read.parquet(str(tmp_path / f"{nr}{name}"))


def test_vectors_of_extreme_norms(spark):
    """Components whose squares leave the range of doubles, beside usual ones: nothing hangs, links and neighbours are right."""
    tiny, huge = [1e-200, 2e-200], [1e200, 2e200]
    rows = [(0, [1.0, 2.0], 0), (1, tiny, 0), (2, huge, 0), (3, [2.0, -1.0], 0), (4, [-1e200, 0.0], 1), (20, [1e-300, 0.0], 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    links = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in caps.near_vectors(vectors).collect()}
    assert links == {0: (2, 0), 1: (2, 0), 2: (2, 0), 3: (0, 3), 4: (0, 4), 20: (0, 20)}
    found = ann.nearest(vectors, vectors.where("vec_id % 20 = 0"), 3).collect()
    assert [(r["query_id"], r["vec_id"]) for r in sorted(found, key=lambda r: (r["query_id"], r["rank"]))][:3] == [(0, 2), (0, 1), (0, 20)]


def test_op7_rows_of_one_key_and_of_none(spark):
    rows = [(3, "", "a"), (3, "w1 w2 w3", "a"), (None, "n1 n2 n3 n4", "a"), (5, "x y z", "a"), (5, "x y z", "a"), (None, None, "b"), (7, "k l", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    documents, blocks = mixing.mix(docs, block=1)
    got = documents.collect()
    assert len(got) == 7 and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert sum(r["taken"] for r in got) == blocks.agg(F.sum("words")).first()[0]
    by = {}
    for r in got:
        by.setdefault(r["source"], []).append(r)
    assert all(sum(r["taken"] for r in rs) == round(rs[0]["target"]) for rs in by.values())
    texts = mixing.mixed_texts(docs, block=1).collect()
    words = lambda key, like: sum(len((r["text"] or "").split()) for r in texts if r["doc_id"] == key and (r["text"] or "").startswith(like))
    assert all(r["text"] for r in texts)
    taken = lambda key: sum(r["taken"] for r in got if r["doc_id"] == key)
    assert words(3, "w") == taken(3) and words(None, "n") == taken(None) and words(5, "") == taken(5) > 0


def test_near_copies_keep_texts_of_one_key(spark):
    text = lambda seed: " ".join(f"{seed}{i}" for i in range(60))
    rows = [(None, text("a")), (None, text("b")), (1, text("c")), (1, text("d")), (2, text("c")), (2, text("c")), (9, text("e")), (9, text("e"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(((r["doc_id"] or 0), r["text"][0]) for r in corpus_pipeline.near_copies(spark, docs, SF).collect())
    assert kept == [(0, "a"), (0, "b"), (1, "c"), (1, "d"), (9, "e")]


def test_op2_labels_beyond_the_sample_and_equal_texts(spark):
    docs, labels = (spark.read.parquet(f"{SF.replace('0.001', '0.01')}/{x}.parquet") for x in ("documents", "labels"))
    model = toxicity.fit(docs, labels, fit_rows=250)
    rows = toxicity.score(docs, model).join(labels, "doc_id").select("score", "toxic").collect()
    assert sum((r["score"] >= 0.5) == (r["toxic"] == 1) for r in rows) >= 0.9 * len(rows)
    copies = docs.crossJoin(spark.range(3).withColumnRenamed("id", "_n")).select((F.col("doc_id") + F.col("_n") * 10**6).alias("doc_id"), "text")
    many = labels.crossJoin(spark.range(3).withColumnRenamed("id", "_n")).select((F.col("doc_id") + F.col("_n") * 10**6).alias("doc_id"), "toxic")
    assert toxicity.fit(copies, many).terms == toxicity.fit(docs, labels).terms


def test_op4_rows_of_one_key_and_of_none(spark):
    line, other = "a line that several of the documents here hold", "an entirely unique sentence that nothing else resembles"
    rows = [(1, f"{line}\n{other}"), (1, f"first comes this quite different one\n{line}"), (None, f"{line}\nof a row without any key at all"), (2, line), (None, "only rows without a key hold this sentence"),
            (None, "only rows without a key hold this sentence\nand this")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r["doc_id"] or 99, r["text"]) for r in lines.dedup_lines(docs).collect())
    assert found == [(1, f"{line}\n{other}"), (1, f"first comes this quite different one\n{line}"), (2, ""), (99, "of a row without any key at all"),
                     (99, "only rows without a key hold this sentence"), (99, "only rows without a key hold this sentence\nand this")]


def test_op4_exact_comparison_equals_sets():
    rng = np.random.default_rng(5)
    xs = ["".join(rng.choice(list("abcd \U0001f600é"), n)) for n in rng.choice([0, 1, 4, 5, 6, 8, 30, 200], 900)]
    ys = ["".join(rng.choice(list("abcd")) if rng.random() < 0.02 else c for c in x) for x in xs]
    grams = lambda t: {t[i:i + 5] for i in range(len(t) - 4)}
    want = [bool(grams(x) & grams(y)) and len(grams(x) & grams(y)) >= 0.8 * len(grams(x) | grams(y)) for x, y in zip(xs, ys)]
    assert lines.similar(xs, ys).tolist() == want and 100 < sum(want) < 800


def test_op4_shingles_are_of_whole_characters_and_of_one_line():
    text = "".join(chr(0x1F600 + i) for i in range(7))
    every = [text, "abcd", "ab" + text[:3], "", "abcdefg", "xbcde"]
    hashes, counts = lines.shingle_hashes(every)
    plain = [x[i:i + 5] for x in every for i in range(len(x) - 4)]
    assert counts.tolist() == [3, 0, 1, 0, 3, 1] and len(set(hashes.tolist())) == len(set(plain)) == len(hashes)
    alone = [h for x in every for h in lines.shingle_hashes([x])[0].tolist()]
    assert hashes.tolist() == alone
    bands = lambda xs: lines.band_hashes(*lines.minima(xs))
    assert (bands(every) == np.concatenate([bands([x]) for x in every])).all() and not bands(["abcd", ""]).any()
