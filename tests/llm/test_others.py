import itertools
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from waywright.llm import chat, chroma, components, queries, topk
from waywright.llm.scratch import Scratch
from waywright.llm.scratch import Scratch

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    rows = queries.QUERIES[name](spark, DATA)
    names = sorted(rows.columns)
    found = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(repr(tuple(r[c] for c in names)) for r in rows.collect()) == sorted(repr(tuple(r[columns.index(c)] for c in names)) for r in found.fetchall())


VECTORS = "vec_id long, embedding array<float>"


def brute_top(rows, k=5):
    """Sorted (query_id, rank, vec_id, score) by plain means: a query for each distinct id and vector, against all rows of other ids."""
    out = []
    ok = [(i, tuple(int(np.floor(256 * float(x))) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for i, v in {(i, v) for i, v in ok if i % 50 == 0}:
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in ok if j != i and len(w) == len(v))[:k]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


def found_top(rows):
    return sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in rows.collect())


def test_top_products_with_ties_and_bad_vectors(spark):
    r = np.random.default_rng(0)
    rows = [(i, [float(np.float32(x)) for x in r.choice([-0.5, 0.25, 0.1, 0.3], 4)]) for i in range(700)]
    rows += [(1000, None), (1001, [0.1, None, 0.2, 0.3]), (1002, [float("nan"), 0.0, 0.0, 0.0]), (1050, [float("inf"), 0.0, 0.0, 0.0]), (None, [0.1] * 4), (1100, [0.5, 0.5]), (1101, [0.25, 0.5]), (1150, [])]
    d = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit(1) for c in ("v", "dim", "cell", "rank", "side", "block", "group", "sure", "which")})
    assert found_top(topk.top_products(d)) == brute_top(rows)


def test_top_products_of_repeated_rows(spark):
    """Query rows that repeat are one query, those of one id with other vectors are their own; repeated candidates count each time."""
    r = np.random.default_rng(5)
    vector = lambda: [float(np.float32(x)) for x in r.normal(0, 0.3, 6)]
    rows = [(i, vector()) for i in range(200)]
    rows += [rows[50], rows[50], (100, vector()), rows[11], rows[11], (-50, vector()), (0, vector())]
    assert found_top(topk.top_products(spark.createDataFrame(rows, VECTORS).repartition(3))) == brute_top(rows)


def test_top_products_of_one_vector_many_times(spark):
    rows = [(i, [0.5, -0.25, 0.125]) for i in range(300)] + [(300 + i, [0.001 * i, 0.5, -0.5]) for i in range(100)]
    got = topk.top_products(spark.createDataFrame(rows, VECTORS), pivots=4, query_block=3)
    assert found_top(got) == brute_top([(i, [float(np.float32(x)) for x in v]) for i, v in rows])


@pytest.mark.parametrize(("pivots", "most"), [(2, 1.0), (40, 0.35), (512, 0.25)])
def test_top_products_prune_by_cells(spark, pivots, most):
    """Clustered vectors of two lengths over many pivots and query groups: exact, and most pairs are never multiplied."""
    r = np.random.default_rng(6)
    centres = {8: r.normal(0, 1, (40, 8)), 5: r.normal(0, 1, (40, 5))}
    rows = [(i, (centres[8 if i % 5 else 5][r.integers(40)] + r.normal(0, 0.01, 8 if i % 5 else 5)).astype(np.float32).tolist()) for i in range(1, 4000)]
    rows += [(50 * i + 50, (centres[8][r.integers(40)] + r.normal(0, 0.01, 8)).astype(np.float32).tolist()) for i in range(100, 180)]
    d = spark.createDataFrame(rows, VECTORS)
    got = topk.top_products(d, pivots=pivots, counted=True, query_block=16).cache()
    assert found_top(got) == brute_top(rows)
    queries, scored = got.filter("rank = 1").agg(F.count("*"), F.sum("scored")).first()
    assert scored < most * queries * len(rows)


def test_top_products_of_more_lengths_than_pivots(spark):
    r = np.random.default_rng(7)
    rows = [(i, r.normal(0, 1, 1 + i % 40).astype(np.float32).tolist()) for i in range(4100)]
    assert found_top(topk.top_products(spark.createDataFrame(rows, VECTORS), pivots=3, query_block=2)) == brute_top(rows)


def test_top_products_of_nothing(spark):
    assert topk.top_products(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def legal(turns):
    turns = turns[1:] if turns and turns[0] == 1 else turns
    return bool(turns) and len(turns) % 2 == 0 and all(t == (3 if i % 2 else 2) for i, t in enumerate(turns))


def brute_cost(roles):
    """The least cost over all labels, merges and insertions of up to three empty turns at each place."""
    names = {"system": 1, "user": 2, "assistant": 3}
    runs = [()] + [p for n in (1, 2, 3) for p in itertools.product((1, 2, 3), repeat=n)]
    best = {(): 0}
    for role in roles:
        new = {}
        for turns, cost in best.items():
            for label in (1, 2, 3):
                c = cost + 2 * (names.get(role) != label)
                if turns and turns[-1] == label:
                    new[turns] = min(new.get(turns, 999), c + 1)
                for run in runs:
                    t = (*turns, *run, label)
                    if all(a != b for a, b in itertools.pairwise(t)) and 1 not in t[1:]:
                        new[t] = min(new.get(t, 999), c + 3 * len(run))
        best = {t: c for t, c in new.items() if (t[0] != 3 and not (t[0] == 1 and len(t) > 1 and t[1] == 3)) and c <= min(new.values()) + 9}
    return min(c + 3 * len(run) for t, c in best.items() for run in runs if legal((*t, *run)))


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_role_repair_costs_least(spark, n):
    cases = list(itertools.product(("system", "user", "assistant", "tool"), repeat=n))
    cases = cases if n < 4 else random.Random(1).sample(cases, 60)
    rows = [(i, t, role, f"m{t}") for i, case in enumerate(cases) for t, role in enumerate(case)]
    got = chat.repair_roles(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).toPandas().sort_values(["conv_id", "place"])
    for i, case in enumerate(cases):
        own = got[got.conv_id == i]
        assert own.cost.sum() == brute_cost(case), case
        text = "".join(own.piece)
        turns = [chat.ROLES.index(x.split("|>")[0]) + 1 for x in text.split("<|")[1:] if not x.startswith("end")]
        assert legal(tuple(turns)) and text.endswith(chat.CLOSE) and all(f"m{t}" in text for t in range(n))


def test_role_repair_in_parts_equals_whole(spark):
    """A conversation over many parts, one crowded turn included, costs what one fold over it costs."""
    r = random.Random(2)
    role = lambda: r.choice(["system", "user", "assistant", "other", None])
    rows = [(1, t, role(), f"text {t}") for t in range(-40, 1500)] + [(1, 700, r.choice(["user", "assistant"]), f"crowd {i}") for i in range(6000)]
    rows += [(2, 1000 * t, role(), "x") for t in range(400)] + [(2, -(2**63), "user", "least"), (2, 2**63 - 1, "user", "most"), (2, None, "user", "none")]
    rows += [(None, None, "user", f"text {i % 3}") for i in range(9000)] + [(3, None, None, "c")]
    every = chat.repair_roles(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(every) == len(rows)
    for conv in (1, 2, 3, None):
        got = sorted((x for x in every if x.conv_id == conv), key=lambda x: x.place)
        assert [x.place for x in got] == list(range(sum(x[0] == conv for x in rows)))
        turns = [-(2**64) if x.turn is None else x.turn for x in got]
        assert turns == sorted(turns)
        total = None
        for x in got:
            m = chat.matrix((x.role or "").lower())
            total = m if total is None else chat.product(total, m)
        assert sum(x.cost for x in got) == int((total[chat.START] + chat.END).min())
        text = "".join(x.piece for x in got)
        assert legal(tuple(chat.ROLES.index(x.split("|>")[0]) + 1 for x in text.split("<|")[1:] if not x.startswith("end")))


def test_role_repair_hard_cases(spark):
    rows = [(1, 0, " USER ", "a"), (1, 0, " USER ", "a"), (1, 1, "assistant", None), (None, 0, "user", "b"), (2, None, None, "c"), (3, 0, "user", "x" * 200_000)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("conv", "span", "sub", "label", "mix")})
    got = chat.repair_roles(d).collect()
    assert len(got) == 5 and {x.conv_id for x in got} == {1, 2, 3, None} and [x.action for x in got if x.conv_id == 1] == ["keep", "keep"]
    assert chat.repair_roles(d.limit(0)).count() == 0


def packed_by_hand(samples, rate):
    """The same integers by sums over plain loops: no integral image, no grouping of recordings."""
    frames = []
    for at in range(0, len(samples) - chroma.FRAME + 1, chroma.HOP):
        power = np.abs(np.fft.rfft(samples[at : at + chroma.FRAME] * np.hanning(chroma.FRAME))) ** 2
        row = np.zeros(12)
        for i, hz in enumerate(np.fft.rfftfreq(chroma.FRAME, 1 / rate)):
            if chroma.LOWEST <= hz <= chroma.HIGHEST:
                row[round(12 * np.log2(hz / 440.0)) % 12] += power[i]
        frames.append(row / np.sqrt((row**2).sum()) if row.any() else row)
    out, near = [], []
    for at in range(len(frames) - chroma.LOOK + 1):
        value, close = 0, False
        for kind, width, low, height in chroma.FILTERS:
            t = at + (chroma.LOOK - width) // 2
            a = b = 0.0
            for dt in range(width):
                for dc in range(2 * height):
                    first, lower = dt < width // 2, dc < height
                    inner = max(1, width // 4) <= dt < width - max(1, width // 4)
                    x = frames[t + dt][(low + dc) % 12]
                    if {0: first, 1: lower, 2: first == lower, 3: inner}[kind]:
                        a += x
                    else:
                        b += x
            ratio = np.log1p(a) - np.log1p(b)
            value = value << 2 | (0, 1, 3, 2)[sum(ratio > s for s in chroma.STEPS)]
            close |= 0 < min(abs(ratio - s) for s in chroma.STEPS) < 1e-4
        out.append(value)
        near.append(close)
    return np.array(out, np.uint32), np.array(near)


def test_chroma_fingerprints_equal_plain_sums():
    r = np.random.default_rng(8)
    tone = lambda hz, n: 6000 * np.sin(2 * np.pi * hz * np.arange(n) / 4000)
    audio = [np.concatenate([tone(hz, 1500) for hz in r.choice([220, 262, 330, 415, 523, 698], 5)]) + r.normal(0, 30, 7500) for _ in range(3)] + [np.zeros(7500), tone(440, 6000), tone(440, 900)]
    raw = [a.astype("<i2").tobytes() for a in audio] + [None, b"", b"x"]
    together = chroma.prints_of([chroma.pcm(a) for a in raw], 4000)
    assert together == [chroma.prints_of([chroma.pcm(a)], 4000)[0] for a in raw] and together[5:] == [b""] * 4
    for n, (a, got) in enumerate(zip(raw[:5], together, strict=False)):
        want, near = packed_by_hand(np.frombuffer(a, "<i2").astype(float), 4000)
        got = np.frombuffer(got, "<u4")
        assert len(got) == len(want) and (got == want)[~near].all() and (near.mean() < 0.5 or n > 2)


def test_chroma_aligns_late_noisy_takes(spark):
    r = np.random.default_rng(3)
    v = spark.createDataFrame([(i, r.normal(0, 0.12, 64).tolist()) for i in range(300)], "vec_id long, embedding array<double>")
    got = chroma.align(chroma.fingerprints(chroma.melodies(v), chroma.RATE, chroma.play)).collect()
    assert {(x.query_id, x.match_id) for x in got} == {(i, i + 1) for i in range(0, 300, 50)} and all(x.offset_frames == -8 for x in got)


def test_chroma_alignment_equals_brute_force(spark):
    r = np.random.default_rng(4)
    prints = [r.integers(0, 2**32, 80, dtype=np.uint32) for _ in range(30)]
    prints += [np.concatenate([r.integers(0, 2**32, 7, dtype=np.uint32), prints[0]]), prints[0].copy(), prints[0][20:60]]
    ids = [*range(0, 1500, 50), 2001, 2002, 2003]
    rows = [(i, bytearray(p.astype("<u4").tobytes()), int(np.int64(hash(p.tobytes())))) for i, p in zip(ids, prints, strict=True)]
    got = {(x.query_id, x.match_id, x.offset_frames, x.copies) for x in chroma.align(spark.createDataFrame(rows, "rec_id long, print binary, same long")).collect()}
    assert got == {(0, 2001, -7, 1), (0, 0, 0, 2), (0, 2003, 20, 1)}


def test_chroma_matches_takes_of_a_steady_sound(spark):
    steady = {0: [7] * 60, 1: [9] * 3 + [7] * 70, 50: [3] * 30, 51: [3] * 31, 100: [5] * 20 + [6] * 20 + [5] * 20}
    rows = [(i, bytearray(np.array(p, "<u4").tobytes()), i) for i, p in steady.items()]
    got = {(x.query_id, x.match_id, x.offset_frames, x.frames, x.bit_errors) for x in chroma.align(spark.createDataFrame(rows, "rec_id long, print binary, same long"), most_errors=0.01).collect()}
    assert got == {(0, 1, -3, 60, 0), (50, 51, 0, 30, 0)}  # a short steady sound needs as many hits as it can have


def plain_alignment(prints, least_hits=4, every=50):
    """All pairs at all offsets that any run gives, by plain loops."""
    def weigh(v, n):
        return 1 if v == chroma.SILENT else 1 + n // chroma.LOOK

    runs = {}
    for i, p in prints.items():
        starts = [0, *(np.flatnonzero(p[1:] != p[:-1]) + 1).tolist()]
        runs[i] = [(int(p[a]), a, weigh(int(p[a]), b - a)) for a, b in zip(starts, [*starts[1:], len(p)], strict=True)]
    out = set()
    for q in [i for i in prints if i % every == 0]:
        places = {}
        for v, at, n in runs[q]:
            places.setdefault(v, []).append((at, n))
        for d in [i for i in prints if i != q]:
            hits = {}
            for v, other, m in runs[d]:
                for at, n in places.get(v, ()):
                    hits[at - other] = hits.get(at - other, 0) + min(n, m)
            need = min(least_hits, 1 + min(len(prints[q]), len(prints[d])) // chroma.LOOK)
            good = []
            for offset, k in hits.items():
                frames, errors = chroma._bits(prints[q], prints[d], offset)
                if k >= need and frames >= 16 and errors <= 0.2 * 32 * frames:
                    good.append((k, -abs(offset), -offset, frames, errors))
            if good:
                k, _, offset, frames, errors = max(good)
                out.add((q, d, -offset, k, frames, errors))
    return out


def test_chroma_values_that_all_share_lose_no_match(spark):
    """Every recording begins with the same short runs, then repeats few values; leaving out common runs changes nothing."""
    r = np.random.default_rng(9)
    lead = [chroma.SILENT] * 40 + [11] * 8 + [12] * 20
    prints = {}
    for i in range(60):
        base = r.integers(0, 4, 30) if i < 30 else np.roll(prints[(i - 30) * 50][68:98], i % 3)
        prints[i * 50 if i < 30 else i * 50 + 1] = np.array([*lead, *base, *r.integers(0, 2**32, 12)][: 40 + i * 2 if i % 7 == 3 else None], np.uint32)
    rows = [(i, bytearray(p.astype("<u4").tobytes()), i) for i, p in prints.items()]
    table = spark.createDataFrame(rows, "rec_id long, print binary, same long")
    want = plain_alignment(prints)
    assert len(want) > 100
    for shared in (10**9, 40, 3, 0):
        got = {(x.query_id, x.match_id, x.offset_frames, x.hits, x.frames, x.bit_errors) for x in chroma.align(table, shared=shared).collect()}
        assert got == want, shared


def test_chroma_values_that_all_share_are_not_paired(spark, tmp_path):
    """400 recordings that share a short beginning and nothing else: its runs pair none of them."""
    r = np.random.default_rng(10)
    rows = [(i, np.array([chroma.SILENT] * 90 + [5] * 10, "<u4").tobytes() + r.integers(0, 2**32, 60, dtype=np.uint32).tobytes(), 4, int(i % 50 == 0)) for i in range(400)]
    reps = spark.createDataFrame([(i, a, n, bytearray(p)) for i, p, n, a in rows], "same long, asked int, need int, print binary")
    scratch = Scratch(spark, "shared-test")
    assert chroma._candidates(scratch, reps, 4, 100).count() == 0
    assert chroma._candidates(scratch, reps, 4, 10**9).count() == 0  # two hits are too few, but all pairs were made


def test_chroma_hard_cases(spark):
    rows = [(0, None), (50, bytearray(b"")), (100, bytearray(b"\x01\x02\x03")), (None, bytearray(np.zeros(9000, "<i2").tobytes())), (150, bytearray(np.zeros(9000, "<i2").tobytes())), (151, bytearray(np.zeros(9000, "<i2").tobytes()))]
    d = spark.createDataFrame(rows, "rec_id long, audio binary").withColumn("print", F.lit(1))
    got = chroma.align(chroma.fingerprints(d, chroma.RATE)).collect()
    assert [(x.query_id, x.match_id, x.copies) for x in got] == [(150, 150, 2)]
    assert chroma.align(chroma.fingerprints(d.limit(0), chroma.RATE)).count() == 0


def test_components_equal_union_find(spark):
    r = random.Random(7)
    links = [(r.randrange(120), r.randrange(120)) for _ in range(80)] + [(200 + i, 201 + i) for i in range(40)] + [(300, 300)]
    root = {x: x for p in links for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = components.components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t"), "c").collect()
    assert {x.node: x.root for x in got} == {x: find(x) for x in root}
    assert components.components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t"), "e").count() == 0
