"""Language, centroids, collocations: against plain versions, SQL, held-out rows and hard cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.made import docs, empty, hard
from waywright.llm import collocation, kmeans, langid, neardup, queries, toxicity

DATA = "/root/testdata"
VECTOR = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("name", ["op12_centroids", "op13_collocations"])
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/sf0.001/{t}.parquet'")
    rows = queries.QUERIES[name](spark, f"{DATA}/sf0.001")
    found = con.execute(queries.ORACLES[name])
    at = [[d[0] for d in found.description].index(c) for c in rows.columns]
    want = sorted(repr(tuple(r[i] for i in at)) for r in found.fetchall())
    assert sorted(repr(tuple(r)) for r in rows.collect()) == want and len(want) > 100


# Collocations.


def plain_collocations(rows, longest=3, least=10, percent=50, top=2000):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    found = {(lang, w): a for (lang, w), a in f.items() if len(w) > 1 and a >= least}
    inside = {}
    for (lang, w), a in found.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                inside[lang, w[i : i + k]] = max(a, inside.get((lang, w[i : i + k]), 0))
    out = {}
    for (lang, w), a in found.items():
        if 100 * inside.get((lang, w), 0) < percent * a:
            score, k = min((1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return {(lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, own in out.items() for i, (s, a, p, left, right) in enumerate(sorted(own)[:top], 1)}


def made_texts(seed, n):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(25)] + ["The", "the", "É", "é", "x" * 90, "a\x00b", "\xa0", "\x1c"]
    rows = []
    for i in range(n):
        parts = [w + r.choice(["", "", "", "", ".", ", ", "\n", "\x0b", "\t", "  ", "!?"]) for w in r.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=r.randrange(60))]
        rows.append((i, r.choice([" ", "  "]).join(parts), r.choice(["en", "en", "fr", None, "und"])))
    return rows + [(n, None, "en"), (n + 1, "", None), (n + 2, "the the the the the the the the the the the the the", "de"), (n + 2, "the the the the the the the the the the the the the", "de")]


def as_set(df):
    return {(r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect()}


@pytest.mark.parametrize("settings", [{}, {"most_numbered": 6}, {"most_numbered": 0}, {"longest_numbered": 2}, {"longest": 4, "least": 5}, {"longest": 2, "top": 7}])
def test_collocations_equal_plain(spark, settings):
    """Whichever words have numbers, the phrases are those of a plain count."""
    rows = made_texts(3, 250)
    got = as_set(collocation.collocations(docs(spark, [(i, t, lang) for i, t, lang in rows]).repartition(3), **settings))
    plain = {k: v for k, v in settings.items() if "numbered" not in k}
    assert got == plain_collocations([r[1:] for r in rows], **plain) and len(got) > 20


def test_collocations_over_small_blocks_and_many_parts(spark, monkeypatch):
    """Texts split anywhere, frequent pivots dealt over many buckets: the counts are the same."""
    words = [f"w{i}" for i in range(12)]
    r = random.Random(4)
    text = "".join(r.choice(words) + r.choice([" "] * 9 + [". "]) for _ in range(3_000))
    for block in (1, 7, 50):
        monkeypatch.setattr(collocation, "A_BLOCK", block)
        whole = [w for part in collocation.words_in(text) for w in part]
        monkeypatch.setattr(collocation, "A_BLOCK", 1 << 20)
        assert whole == next(collocation.words_in(text))
        monkeypatch.setattr(collocation, "A_BLOCK", block)
        ids = {w.encode(): i for i, w in enumerate(words, 1)}
        rows = [collocation.fragments_of(np.array([ids.get(w, 0) for w in held], np.int32), 3, a, b) for held, a, b in collocation.stretches(text, 2)]
        every = np.array([ids.get(w, 0) for w in whole], np.int32)
        assert (np.concatenate(rows) == collocation.fragments_of(every, 3, 0, len(every))).all()
    counts = np.full(13, 10 * collocation.A_PART)
    some = np.unique(np.concatenate(rows), axis=0)
    assert len(set(collocation._dealt(some[some[:, 2] == 9], counts, 3, 1000).tolist())) > 5


def test_collocations_hard_cases(spark):
    assert collocation.collocations(empty(spark)).count() == 0
    clash = docs(spark, [(i, "Big Cat sat.", "en") for i in range(12)]).withColumns({c: F.lit("x") for c in ("word", "n", "words", "counts", "phrase", "a", "bucket", "numbers", "rank")})
    assert as_set(collocation.collocations(clash)) == plain_collocations([("Big Cat sat.", "en")] * 12)
    long = docs(spark, [(1, "one two three " * 40_000 + "x" * 100_000, None)])
    assert as_set(collocation.collocations(long)) == plain_collocations([("one two three " * 40_000 + "x" * 100_000, None)])
    collocation.collocations(hard(spark)).collect()


# Centroids.


def plain_kmeans(vectors, k=8, rounds=10):
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in vectors if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = [[] for _ in centroids]
        for _, v in kept:
            own[near(v)[1]].append(v)
        centroids = [[sum(c) // len(o) for c in zip(*o, strict=True)] if o else old for o, old in zip(own, centroids, strict=True)]
    found = [(i, near(v)) for i, v in kept]
    inertia = Counter()
    for _, (d, j) in found:
        inertia[j] += d
    return sorted((repr(i), j, d, inertia[j], inertia.total(), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, (d, j) in found)


def test_centroids_equal_plain_with_ties_and_hard_rows(spark):
    r = np.random.default_rng(2)
    made = [(i, (r.normal(size=64) + 3 * (i % 5)).astype("f4").tolist()) for i in range(150)]
    ties = [(200 + i, [float(i % 2)] * 64) for i in range(40)] + [(7, made[7][1])] * 3 + [(None, [0.5] * 64)] * 2
    bad = [(300, None), (301, [1.0] * 63), (302, [float("nan")] * 64), (303, [None] * 64), (304, [float("inf")] + [0.0] * 63), (305, [])]
    rows = made + ties + bad
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTOR).withColumns({c: F.lit("x") for c in ("cluster", "distance", "units", "n", "total", "inertia")}).repartition(3)
    got = sorted((repr(x.vec_id), x.cluster, x.distance, x.cluster_inertia, x.inertia, x.centroid_sha256) for x in kmeans.cluster_vectors(df).collect())
    assert got == plain_kmeans(rows)
    assert kmeans.cluster_vectors(df.limit(0)).count() == 0
    few = spark.createDataFrame([(1, [1.0] * 64, 0), (2, [2.0] * 64, 0)], VECTOR)
    assert sorted(x.cluster for x in kmeans.cluster_vectors(few).collect()) == [0, 1]
    far = kmeans.cluster_vectors(few.union(spark.createDataFrame([(3, [3e30] * 64, 0)], VECTOR))).filter("vec_id = 3").first()
    assert far.cluster is None and far.distance is None and far.inertia is None


def test_screening_never_rules_out_the_nearest():
    """Large whole numbers, near ties: float32 can't tell centroids apart, the intervals know it."""
    r = np.random.default_rng(3)
    for size in (1 << 10, 1 << 20, 1 << 27):
        x = r.integers(-size, size, (400, 64))
        c = np.concatenate([r.integers(-size, size, (4, 64)), x[:2], x[:1] + 1])
        distance = np.array([[sum(int(d) ** 2 for d in (u - v)) for v in c] for u in x], dtype=object)
        own = kmeans.Assigner(c)
        near = own.screen(x)
        assert near[np.arange(len(x)), distance.argmin(axis=1)].all()
        found, far = own(x)
        assert found.tolist() == distance.argmin(axis=1).tolist() and far.tolist() == distance.min(axis=1).tolist()
    close = np.full((50, 64), 1 << 26) + r.integers(-1, 2, (50, 64))
    assert kmeans.Assigner(close[:8]).screen(close).sum(axis=1).min() > 1  # told apart by the exact step alone


# Language.


@pytest.fixture(scope="module")
def model(spark):
    return langid.train(spark.read.parquet(f"{DATA}/sf0.01/documents.parquet"))


def test_language_of_held_out_documents(spark, model):
    d = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    got = langid.predict(d, model, keep=("doc_id", "lang", "n_chars")).withColumn("held", langid.held_out(F.col("doc_id"))).collect()
    out = [r for r in got if r.held]
    assert len(got) == d.count() and all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    assert len(out) > 200 and sum(r.lang == r.lang_pred for r in out) >= 0.98 * len(out)
    for lang in {r.lang for r in out}:
        own = [r for r in out if r.lang == lang]
        assert sum(r.lang_pred == lang for r in own) >= 0.95 * len(own), lang


def test_network_by_plain_loops(model):
    """Windows, filters, pooling and softmax as loops give the same shares; long texts by parts too."""
    r = random.Random(5)
    texts = ["Das ist.", "x", "the cat " * 100, "".join(r.choice("abc déf.ü ") for _ in range(3_000)), "é" * 128, "a" * 252, "a" * 253, "b" * 256, "c" * 257]
    got = langid.Predictor(model).shares([t.encode().lower() for t in texts])
    for t, share in zip(texts, got, strict=True):
        b = t.encode().lower()
        e = np.zeros((len(b) + 600, langid.EMBEDDED), np.float32)
        e[: len(b)] = model.embedding[np.frombuffer(b, np.uint8)]
        e[len(b) :] = model.embedding[0]
        total = np.zeros(len(model.langs))
        for at in range(0, len(b), langid.WINDOW):
            pool = np.max([e[p : p + langid.WIDEST].ravel() @ model.filters for p in range(at, at + langid.WINDOW)], axis=0)
            z = np.maximum(pool + model.bias, 0) @ model.out + model.out_bias
            w = np.exp(z - z.max())
            total += w / w.sum() * min(langid.WINDOW, len(b) - at)
        assert np.allclose(share, total, rtol=1e-4, atol=1e-4), t[:20]
    whole = "".join(r.choice(["the ", "über ", "señor ", "être "]) for _ in range(2_000)).encode()
    parts = langid.Predictor(model)
    one = parts.shares([whole])
    before, langid.GATHERED = langid.GATHERED, 1_024
    try:
        assert np.allclose(parts.shares([whole]), one, rtol=1e-4)
    finally:
        langid.GATHERED = before


def test_language_hard_cases(spark, model):
    rows = {r.doc_id: r for r in langid.predict(hard(spark), model).collect() if r.doc_id is not None}
    assert [rows[i].lang_pred for i in (2, 3, 8)] == ["und"] * 3 and rows[2].score == 0.0
    assert rows[4].lang_pred in model.langs and rows[4].n_windows > 500
    assert langid.predict(hard(spark), model).count() == hard(spark).count() and langid.predict(empty(spark), model).count() == 0
    odd = docs(spark, [(1, "123 456 .,;"), (2, "１２３ ²"), (3, "ß"), (4, "́"), (5, "中")])
    assert {r.doc_id: r.lang_pred == "und" for r in langid.predict(odd, model).collect()} == {1: True, 2: True, 3: False, 4: True, 5: False}
    assert langid.train(empty(spark)).langs == [] and {r.lang_pred for r in langid.predict(hard(spark), langid.train(empty(spark))).collect()} == {"und"}
    alone = langid.train(docs(spark, [(i, "some words", "en") for i in range(9)]))
    assert alone.langs == ["en"] and langid.predict(docs(spark, [(1, "abc")]), alone).first().lang_pred == "en"


def test_language_sample_is_bounded_and_blind(spark):
    """Held-out rows and other columns teach nothing; copies and a frequent language don't swell the sample."""
    from waywright.llm.scratch import Scratch

    rows = [(i, "the same words again", "en") for i in range(3_000)] + [(i, f"text number {i}", "en") for i in range(3_000, 6_000)] + [(i, f"otro texto {i}", "es") for i in range(6_000, 6_050)]
    got = langid._sample(docs(spark, rows), 200, 3, 10, Scratch(spark, "langid-test"))
    held = {f"text number {i}".encode() for i in range(3_000, 6_000) if zlib.crc32(str(i).encode()) % 3 == 1}
    n = Counter(lang for lang, _ in got)
    assert 100 < n["en"] < 300 and n["es"] == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(6_000, 6_050))
    assert not {w for _, w in got} & held


# Rows that repeat.


def test_near_duplicates_of_many_repeated_rows(spark):
    """Three texts alike, two thousand rows each: every row has its answer, and one set a vertex is compared."""
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{words} {x}") for i, x in enumerate("xyz") for _ in range(2_000)]
    got = neardup.near_duplicates(docs(spark, rows)).groupBy("doc_id", "component_id", "kept").count().collect()
    assert {(r.doc_id, r.component_id, r.kept, r["count"]) for r in got} == {(0, 0, True, 2000), (1, 0, False, 2000), (2, 0, False, 2000)}
    many = [(7, f"{words} {k} {k}") for k in range(1_000)] + [(9, f"{words} q")]
    got = neardup.near_duplicates(docs(spark, many)).collect()
    assert len(got) == 1_001 and {r.component_id for r in got} == {7}


def test_toxicity_sample_is_of_rows(spark):
    """One labelled id in a third of the rows, with texts alike and unlike."""
    from waywright.llm.scratch import Scratch

    free = [i for i in range(1, 9_000) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows = [(free[0], "same text") for _ in range(2_000)] + [(free[0], f"text {k}") for k in range(2_000)] + [(i, f"other {i}") for i in free[1:4_000]]
    labels = spark.createDataFrame([(i, 0, i % 2) for i in free], "doc_id long, quality int, toxic int")
    sample = toxicity._sample(docs(spark, rows), labels, 500, Scratch(spark, "toxicity-test"))
    assert 350 < sample.count() < 650
