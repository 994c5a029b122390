"""Far times, exact decimals, typed numbers, clashing columns."""

import math
import random
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.trips import course, samples, steady, trace
from waywright.functions import text
from waywright.operators import comparing, ghost, matching, occupancy
from waywright.plans.analysis import Analysis
from waywright.sources import traces


def analysed(spark, *runs, c=None):
    s = samples(spark, *runs)
    return Analysis(s, c or course(spark, marks=[("m", 400)]), traces.synthetic_attempts(s))


def test_a_far_time_costs_nothing(spark):
    """One attempt's finish lies fifty thousand years ahead (microseconds for milliseconds); its legs and stalls are found like any other's."""
    slow = [(i, 5.0 * i) for i in range(150)] + [(1_700_000_000_000 + i, 5.0 * i) for i in range(150, 161)]
    an = analysed(spark, trace("a", steady()), trace("b", slow, 5000))
    assert an.legs.filter("attempt_id = 'b'").count() == an.knots.filter("attempt_id = 'b'").count() - 1 > 100
    far = an.legs.filter("attempt_id = 'b' and t1 - t0 > 1e12").collect()
    assert len(far) == 1 and not far[0].good
    assert an.ghosts.filter("attempt_id = 'b'").count() > 100


def test_legs_by_plain_overlap(spark):
    """Random legs and intervals, nested and overlapping ones too, against a loop over all pairs."""
    r = random.Random(5)
    times = sorted(r.choice(range(0, 400, 5)) for _ in range(60))
    knots = [("a", i, "sample", float(t), float(i), float(t)) for i, t in enumerate(times)]
    spans = [("a", r.choice(["waiting", "moving", "unknown", "waiting", "waiting"]), float(s), float(s + r.choice([0, 5, 10, 60]))) for s in (r.randrange(0, 400) for _ in range(25))]
    k = spark.createDataFrame(knots, "attempt_id string, n int, kind string, elapsed_ms double, progress_m double, at_ms double")
    got = {x.n: (x.good, x.stall) for x in ghost.legs(k, spark.createDataFrame(spans, "attempt_id string, label string, start_ms double, end_ms double")).collect()}
    for n, (t0, t1) in enumerate(zip(times, times[1:], strict=False)):
        met = [label for _, label, s, e in spans if e > t0 and s < t1]
        clear = bool(met) and "unknown" not in met
        assert got[n] == (t1 <= t0 or clear, t1 > t0 and clear and set(met) == {"waiting"}), n


def test_knots_in_stalls_by_plain_containment(spark):
    r = random.Random(6)
    bounds = sorted(r.sample(range(0, 500, 5), 40))
    runs = [("a", i, float(a), float(b), float(i), float(i + r.choice([0, 3]))) for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)) if r.random() < 0.7]
    asked = [("a", n, r.uniform(0, 40), float(r.choice(bounds) if n % 2 else r.randrange(500))) for n in range(300)]
    found = ghost._in_stalls(spark.createDataFrame(asked, "attempt_id string, n int, progress_m double, elapsed_ms double"), spark.createDataFrame(runs, "attempt_id string, run int, e0 double, e1 double, lo double, hi double"))
    got = {x.n: x.in_stall for x in found.collect()}
    assert got == {n: any(e0 <= q <= e1 and lo - 0.05 <= p <= hi + 0.05 for _, _, e0, e1, lo, hi in runs) for _, n, p, q in asked} and len(set(got.values())) == 2


@pytest.mark.parametrize("digits", [0, 1, 3, 6])
def test_fixed_rounds_the_exact_value(spark, digits):
    r = random.Random(digits)
    values = [0.0, -0.0, 0.5, 1.5, 2.5, -2.5, 0.25, 1.25, 8.95, 1.15, 1.005, 0.0005, 0.0625, 999.95, 9.5, 1e-9, 5e-7, 2.0**52 + 1, 1e15, -1e-12, 0.1 + 0.2]
    values += [r.uniform(-1e4, 1e4) for _ in range(300)] + [r.randrange(10**6) / 2**r.randrange(12) for _ in range(300)] + [k / 1000 for k in range(1000, 1400)]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", text.fixed(F.col("x"), digits).alias("s")).collect()
    for row in rows:
        want = str(Decimal(abs(row.x)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
        want = f"{Decimal(abs(row.x)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP):f}" if "E" in want else want
        assert row.s == ("-" if row.x < 0 else "") + want, row.x


def test_distances_and_radii_as_typed(spark):
    d = spark.createDataFrame([(1150.0,), (8950.0,), (999.5,), (1050.0,)], "m double").select(text.distance(F.col("m")).alias("s"))
    assert [x.s for x in d.collect()] == ["1.1 km", "8.9 km", "1000 m", "1.1 km"]
    typed = {"30f": None, "30d": None, " 12,5 ": 12.5, "1,2,3": None, "1e2": 100.0, ".5": 0.5, "5.": 5.0, ".": None, "": None, "  ": None, "0x1F": 31.0, "0b101": 5.0, "0o17": 15.0, "-3": -3.0, "+4": 4.0, "Infinity": float("inf"), "inf": None, "NaN": None, "1_0": None, "\t7\n": 7.0, "-0x1": None, "1 2": None}
    rows = spark.createDataFrame([(t,) for t in typed], "t string").select("t", text.radius_input(F.col("t")).alias("r")).collect()
    assert {x.t: x.r for x in rows} == typed


def plain_clusters(at, keys):
    """All pairs, until none may merge."""
    groups = [[i] for i in range(len(at))]
    while True:
        pairs = []
        for a in range(len(groups)):
            for b in range(a + 1, len(groups)):
                union = groups[a] + groups[b]
                low, high = min(at[i] for i in union), max(at[i] for i in union)
                if high - low <= 40.0:
                    gap = abs(sum(at[i] for i in groups[a]) / len(groups[a]) - sum(at[i] for i in groups[b]) / len(groups[b]))
                    pairs.append((gap, low, high, ";".join(sorted(keys[i] for i in union)), a, b))
        if not pairs:
            return groups
        *_, a, b = min(pairs)
        groups = [g for i, g in enumerate(groups) if i not in (a, b)] + [groups[a] + groups[b]]


def test_clusters_equal_all_pairs_and_many_waits_are_quick():
    import time

    r = random.Random(9)
    for _ in range(300):
        n = r.randrange(1, 14)
        at = [float(r.choice([r.randrange(0, 200, 10), r.randrange(0, 200), round(r.uniform(0, 200), 2)])) for _ in range(n)]
        keys = [f"k{i:02d}" for i in range(n)]
        assert sorted(map(sorted, comparing._clusters(at))) == sorted(map(sorted, plain_clusters(at, keys))), at
    began = time.time()
    assert len(comparing._clusters([10.0 * i for i in range(20_000)])) >= 4_000
    assert sum(map(len, comparing._clusters([r.uniform(0, 39) for _ in range(20_000)]))) == 20_000
    assert time.time() - began < 10


def winding(n, seed=1):
    """A path that bends, crosses itself and goes back along what it came."""
    r = random.Random(seed)
    lat, lon, out, turn = 32.08, 34.78, [], 0.0
    for _ in range(n):
        out.append((lat, lon))
        turn += r.uniform(-0.6, 0.6)
        lat, lon = lat + 8e-5 * math.cos(turn), lon + 9e-5 * math.sin(turn)
    return out + out[-n // 4 :: -1][: n // 5]


def test_segment_index_equals_all_segments():
    """Every point against every segment, ties within half a metre and windows included; the index looks at few."""
    for n in (2, 30, 40, 1500, 8400):
        path = winding(n)
        g = matching._Geometry(*map(np.array, zip(*path, strict=True)))
        r = np.random.default_rng(n)
        picked = np.array(path)[r.integers(0, len(path), 120)]
        y, x = (picked + r.normal(0, 2e-4, picked.shape)).T
        progress, snap, lat, lon = g.project(y, x)
        tied = snap <= snap.min(axis=1, keepdims=True) + 0.5
        at = np.arange(len(y)), np.where(tied, progress, np.inf).argmin(axis=1)
        for got, want in zip(g.nearest(y, x), (progress, snap, lat, lon), strict=True):
            assert (got == want[at]).all()
        if n > 8000:
            assert g.looked / len(y) < 200
        centre = r.uniform(-50, float(g.s1[-1]) + 150, len(y))
        ahead, behind = np.full(len(y), 90.0), np.full(len(y), 25.0)
        inside = (g.s1[None] >= centre[:, None] - 25) & (g.s0[None] <= centre[:, None] + 90)
        cost = np.where(inside, snap + 0.3 * np.abs(progress - centre[:, None]) + 8.0 * (progress < centre[:, None]), np.inf)
        best = np.where(cost == cost.min(axis=1, keepdims=True), progress, -np.inf).argmax(axis=1)
        at = np.arange(len(y)), best
        for got, want in zip(g.near(y, x, centre, ahead, behind), (progress, snap), strict=True):
            assert np.array_equal(got, np.where(inside[at], want[at], np.nan), equal_nan=True)


def plain_time(pieces, p, q, in_stall):
    """When a run was at a progress, from all its stretches that reach it."""
    near = [x for x in pieces if x[5] - 0.05 <= p <= x[6] + 0.05]
    holds = []
    for _, e0, e1, *_, good in sorted((x for x in near if x[0] == "hold"), key=lambda x: (x[1], x[2], x[7])):
        if holds and good == holds[-1][2] and e0 <= holds[-1][1] + 0.5:
            holds[-1] = (holds[-1][0], max(e1, holds[-1][1]), good)
        else:
            holds.append((e0, e1, good))
    moments = lambda *kinds: [(abs(q - e), e, good) for k, e0, e1, p0, p1, _, _, good in near if k in kinds for e in (e0 + min(1.0, max(0.0, (p - p0) / (p1 - p0))) * (e1 - e0),)]
    inside = [h for h in holds if h[0] <= q <= h[1]]
    if inside:
        return q, any(h[2] for h in inside)
    clamped, arrivals = [[(abs(q - at(h)), at(h), h[2]) for h in holds] for at in (lambda h: min(h[1], max(h[0], q)), lambda h: h[0])]
    found = (clamped, moments("up", "down")) if in_stall else (moments("up"), arrivals, moments("down"))
    return next((min(x)[1:] for x in found if x), None)


def wander(r, n, still=0.4):
    """A run's stretches one after another: holds (some wide), ways up and down, moments without length, gaps in trust."""
    t, p, out = 0.0, 0.0, []
    for _ in range(n):
        dt = r.choice([0.0, 0.3, 1000.0, 1000.0, 2000.0])
        if r.random() < still:
            step = r.choice([0.0, 0.05, 0.02])
            wide = r.choice([0.0, 0.0, 1.5])
            out.append(("hold", t, t + dt, p, p + step, p - wide, p + step + wide, r.random() < 0.8))
        else:
            step = r.choice([-4.0, -0.1, 0.1, 3.0, 5.0, 5.0])
            out.append(("up" if step > 0 else "down", t, t + dt, p, p + step, min(p, p + step), max(p, p + step), r.random() < 0.8))
        t, p = t + dt, p + step
    return out


def test_times_at_a_progress_equal_all_stretches():
    r = random.Random(17)
    for n in (0, 1, 2, 5, 30, 120):
        for _ in range(30):
            pieces = wander(r, n)
            run = occupancy.Occupancy(sorted(pieces, key=lambda x: (x[1], x[2])))
            times = [0.0, 500.0] + [x[k] for x in pieces for k in (1, 2)]
            spots = [0.0, 3.3] + [x[k] for x in pieces for k in (3, 4)]
            for _ in range(60):
                p, q, still = r.choice(spots) + r.choice([0.0, 0.0, 0.04, -1.3]), r.choice(times) + r.choice([0.0, 0.0, 250.0]), r.random() < 0.5
                assert run.at(p, q, still) == plain_time(pieces, p, q, still), (pieces, p, q, still)


def test_hours_in_one_stretch_are_answered_in_little_more_than_linear_time():
    import time

    r = random.Random(3)
    took = []
    for n in (20_000, 80_000):
        t, p, pieces = 0.0, 10.0, []
        for i in range(n):
            to = min(60.0, max(0.0, p + r.uniform(-2, 2)))
            flat = i % 5 == 0
            to = p if flat else to
            pieces.append(("hold" if flat else "up" if to > p else "down", t, t + 1000, p, to, min(p, to), max(p, to), True))
            t, p = t + 1000, to
        run = occupancy.Occupancy(pieces)
        began = time.time()
        for _ in range(5_000):
            run.at(r.uniform(0, 60), r.uniform(0, t), r.random() < 0.5)
        took.append(time.time() - began)
    assert took[1] < 2.5 * took[0] + 0.5 and took[1] < 10


def test_a_run_of_whom_much_is_asked_answers_in_many_tasks(spark):
    r = random.Random(5)
    pieces = wander(r, 200)
    rows = spark.createDataFrame([("o", *x) for x in pieces], "owner string, kind string, e0 double, e1 double, p0 double, p1 double, lo double, hi double, good boolean")
    asked = [("a", "o", "current", n, r.uniform(0, 100), float(r.randrange(100_000)), n % 2 == 0) for n in range(500)] + [("a", "nobody", "current", 1, 1.0, 1.0, False)]
    got = ghost.paired(spark.createDataFrame(asked, "attempt_id string, owner string, source string, n int, progress_m double, elapsed_ms double, in_stall boolean"), rows, a_task=60).collect()
    assert {(x.owner, x.n): (x.other_ms, x.good) for x in got} == {(o, n): plain_time(pieces if o == "o" else [], p, q, still) or (None, False) for _, o, _, n, p, q, still in asked}


def test_long_traces_in_parts_equal_one_walk(spark):
    """Detours, retraced ways, crossings of the path, poor fixes and jumps: parts of a hundred samples, joined, are the whole walk."""
    r = random.Random(21)
    path = winding(700, 4)
    g = matching._Geometry(*map(np.array, zip(*path, strict=True)))
    length, rows = float(g.s1[-1]), []
    for a, n in (("a", 1500), ("b", 750), ("c", 60), ("lost", 400)):
        p, off = 0.0, 0
        for i in range(n):
            p = min(length, max(0.0, p + r.choice([5.0, 6.0, 4.0, -3.0, 0.0] if i % 400 < 300 else [-5.0, -6.0, 2.0])))
            off = off - 1 if off else (60 if r.random() < 0.004 else 0)
            on = int(min(np.searchsorted(g.s1, p), len(g.s1) - 1))
            lat, lon = g.point(np.array([on]), np.array([(p - g.s0[on]) / g.length[on]]))
            away = 0.05 if a == "lost" else 0.001 * (off > 0)
            rows.append((a, a, "r", f"{i:05d}", 1_700_000_000_000 + 1000 * (i // 2 if i % 50 == 1 else i), float(lat[0]) + r.gauss(0, 5e-5) + away, float(lon[0]) + r.gauss(0, 5e-5), r.choice([5.0, 5.0, None, 60.0]), None))
    from tests.trips import SAMPLE

    s, c = spark.createDataFrame(rows, SAMPLE), course(spark, path=path)
    key = lambda df: sorted(map(tuple, df.collect()))
    whole = key(matching.match_samples(s, c))
    assert key(matching.match_samples(s.repartition(5), c, part=100)) == whole
    assert {x[10] for x in whole} >= {"accepted", "off_course", "poor_accuracy"}
    assert key(matching.match_samples(s, c.limit(0), part=100)) == []


def test_extra_columns_of_any_name_change_nothing(spark):
    """Samples, courses and attempts with columns that carry names used inside: every derived table is as without them."""
    names = "p prev_p prev_t start_p finish_p trigger_p validity lifecycle seq t side lats quality progress_m n part label started_at finished_at official_ms eligible reason least_p rank at best replayed salt path place".split()
    s = samples(spark, trace("a", steady()), trace("b", [(i, 5.0 * min(i, 80 if i < 100 else i - 20)) for i in range(182)], 3000))
    c = course(spark, marks=[("m", 400)])
    extra = lambda df: df.withColumns({x: F.lit("x") for x in names if x not in df.columns})
    plain = Analysis(s, c, traces.synthetic_attempts(s))
    other = Analysis(extra(s), extra(c), extra(traces.synthetic_attempts(s)))
    for table in ("matched", "runs", "crossings", "status", "focus", "segments", "intervals", "waits", "comparison", "legs", "ghosts", "report"):
        a, b = getattr(plain, table), getattr(other, table)
        assert a.columns == b.columns and sorted(map(repr, a.collect())) == sorted(map(repr, b.collect())), table


def test_ids_of_checkpoints_go_by_locale(spark):
    """Checkpoints at one place come in readers' order, whatever their case; layouts and crossings agree on it."""
    from waywright.operators import routes, timing

    c = course(spark, marks=[("Z", 200), ("é", 200), ("a", 200), ("E", 200)])
    found = timing.interior_checkpoints(c).orderBy("cp_order").collect()
    assert [r.checkpoint_id for r in found] == ["a", "E", "é", "Z"]
    identity = routes.layout_identity(c).first().identity
    assert [x.split(":")[0] for x in identity.split("cp=[")[1].split(",")] == ["a", "E", "é", "Z"]
