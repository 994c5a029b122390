import json
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.trips import LAT, LON, T0, course, samples, steady, trace
from waywright.operators import comparing, ghost, matching, movement, prefix, ranking, routes, sessions, timing
from waywright.plans.analysis import Analysis
from waywright.sources import traces as src


def replayed(spark, steps, **kw):
    c = course(spark, **kw)
    m = matching.match_samples(samples(spark, trace("a", steps)), c)
    return timing.replay(m, c).first(), m, c


def test_stationary_never_starts(spark):
    row, _, _ = replayed(spark, [(i, (i % 3) * 1.0) for i in range(60)])
    assert (row.lifecycle, row.validity, row.started_at) == ("armed", "pending", None)


def test_steady_run_completes(spark):
    row, _, _ = replayed(spark, steady())
    assert (row.lifecycle, row.validity) == ("completed", "valid")
    # It leaves the start band between the first two samples and reaches 30 m before the end.
    assert T0 <= row.started_at <= T0 + 1100 and abs(row.finished_at - T0 - 770 / 5 * 1000) < 400


def test_start_line_inside_the_course(spark):
    row, _, _ = replayed(spark, steady(step=4.0), start=40.0)
    assert abs(row.started_at - (T0 + 10_011)) < 15


def test_already_past_the_start_stays_armed(spark):
    row, _, _ = replayed(spark, steady(begin=60.0, step=4.0), start=40.0)
    assert row.lifecycle == "armed"


def test_sustained_deviation_abandons(spark):
    away = [(40 + i, 200.0, 120.0) for i in range(70)]
    row, m, _ = replayed(spark, steady(until=195) + away)
    assert (row.lifecycle, row.validity) == ("abandoned", "unranked")
    assert m.filter("quality = 'off_course'").count() == 70


def test_material_deviation_is_unranked(spark):
    away = [(40 + i, 200.0, 120.0) for i in range(30)]
    back = [(70 + i, 200.0 + 5 * i) for i in range(121)]
    row, _, _ = replayed(spark, steady(until=195) + away + back)
    assert (row.lifecycle, row.validity) == ("completed", "unranked")


def test_out_and_back_keeps_its_branch(spark):
    up = [(LAT + i * 20 / 111320, LON) for i in range(11)]
    c = course(spark, path=up + up[-2::-1])
    steps = [(i, 4.0 * i) for i in range(51)] + [(51 + i, 200 - 4.0 * i) for i in range(51)]
    got = [r.progress_m for r in matching.match_samples(samples(spark, trace("a", steps)), c).orderBy("seq").collect()]
    assert max(abs(b - a) for a, b in zip(got, got[1:], strict=False)) < 30 and got[-1] > 380


def test_poor_accuracy_does_not_move_the_match(spark):
    steps = steady(until=100)
    steps[10] = (10, 700.0, 0.0, 60.0)
    _, m, _ = replayed(spark, steps)
    assert [r.quality for r in m.filter("seq in (10, 11)").orderBy("seq").collect()] == ["poor_accuracy", "accepted"]


def test_crossings_and_segments(spark):
    c = course(spark, marks=[("m2", 500), ("m1", 200)])
    s = samples(spark, trace("a", steady()), trace("b", steady(step=8.0), 5000))
    an = Analysis(s, c, src.synthetic_attempts(s))
    rows = an.segments.orderBy("attempt_id", "seg").collect()
    assert [r.segment_id for r in rows[:3]] == ["start->m1", "m1->m2", "m2->finish"]
    for r in an.ranked.collect():
        assert abs(sum(x.duration_ms for x in rows if x.attempt_id == r.attempt_id) - r.official_ms) < 1e-6
    assert {r.attempt_id: (r.rank, r.is_pb, r.target_id) for r in an.ranked.collect()} == {"b": (1, True, "a"), "a": (2, False, "b")}
    assert all(r.is_new_gold for r in ranking.segment_deltas(an.segments, an.ranked).filter("attempt_id = 'b'").collect())
    summary = ranking.route_summary(an.status, c, an.segments).first()
    assert summary.ranked == 2 and summary.pb_id == "b" and abs(summary.sum_of_best_ms - summary.pb_ms) < 1e-6


def test_tie_goes_to_the_earlier_start(spark):
    c = course(spark)
    s = samples(spark, trace("z", steady()), trace("a", steady(), 5000))
    an = Analysis(s, c, src.synthetic_attempts(s))
    assert [r.attempt_id for r in an.ranked.orderBy("rank").collect()] == ["z", "a"]


def stop(at=400.0, seconds=60):
    before = [(i, 5.0 * i) for i in range(int(at / 5) + 1)]
    t = before[-1][0]
    wait = [(t + 1 + i, at) for i in range(seconds)]
    return before + wait + [(t + seconds + i, at + 5.0 * i) for i in range(1, int((800 - at) / 5) + 1)]


def analysed(spark, *runs):
    c = course(spark)
    s = samples(spark, *(trace(chr(97 + i), steps, 10_000 * i) for i, steps in enumerate(runs)))
    return Analysis(s, c, src.synthetic_attempts(s))


def test_waiting_is_found_where_it_was(spark):
    an = analysed(spark, stop(), steady())
    m = {r.attempt_id: r for r in an.breakdown.collect()}
    assert abs(m["a"].waiting_ms - 60_000) < 4_000 and m["b"].waiting_ms < 4_000
    for r in m.values():
        assert abs(r.moving_ms + r.waiting_ms + r.unknown_ms - r.official_ms) < 1
    w = an.waits.filter("attempt_id = 'a'").collect()
    assert len(w) == 1 and abs(w[0].progress_m - 400) < 3 and abs(w[0].latitude - LAT - 400 / 111320) < 1e-4


@pytest.mark.parametrize(("gap", "label"), [(119, "waiting"), (121, "unknown")])
def test_gap_without_movement(spark, gap, label):
    before = [(i, 5.0 * i) for i in range(81)]
    after = [(80 + gap + i, 400 + 5.0 * i) for i in range(1, 81)]
    an = analysed(spark, before + [(80 + gap, 400.0)] + after)
    longest = an.intervals.orderBy(F.desc(F.col("end_ms") - F.col("start_ms"))).first()
    assert longest.label == label


def test_slow_travel_over_a_gap_is_not_waiting(spark):
    before = [(i, 5.0 * i) for i in range(81)]
    an = analysed(spark, before + [(89, 409.0)] + [(89 + i, 409 + 5.0 * i) for i in range(1, 79)])
    assert an.intervals.orderBy(F.desc(F.col("end_ms") - F.col("start_ms"))).first().label == "unknown"


def test_ghost_shows_the_longer_stop(spark):
    an = analysed(spark, stop(seconds=90), stop(seconds=40))
    d = an.ghosts.filter("attempt_id = 'a' and good and abs(progress_m - 400) < 3").agg(F.max("delta_ms")).first()[0]
    assert 45_000 < d < 53_000
    ends = {r.source: r.delta_ms for r in an.ghosts.filter("attempt_id = 'a'").collect() if r.source in ("start", "finish-trigger")}
    assert ends["start"] == 0 and abs(ends["finish-trigger"] - 50_000) < 1_000


def test_a_run_against_its_like_has_no_deltas(spark):
    an = analysed(spark, stop(), stop())
    got = an.ghosts.filter("attempt_id = 'b' and good").agg(F.max(F.abs("delta_ms")), F.count("*")).first()
    assert got[0] < 1e-6 and got[1] > 100
    c = an.comparison.filter("attempt_id = 'b'").first()
    assert c.reason is None and abs(c.delta_ms) < 1e-6 and c.short_ms == c.reference_short_ms


def test_wait_comparison_adds_up(spark):
    an = analysed(spark, stop(at=300, seconds=50), stop(at=500, seconds=20))
    for r in an.comparison.collect():
        assert abs(r.placed_ms + r.unlocated_ms + r.short_ms - r.waiting_ms) < 1e-6
        assert abs(r.reference_placed_ms + r.reference_unlocated_ms + r.reference_short_ms - r.reference_ms) < 1e-6
        assert abs(r.shown_delta_ms + r.hidden_delta_ms - (r.placed_ms - r.reference_placed_ms)) < 1e-6


def test_clusters_span_at_most_the_radius():
    groups = comparing._clusters([400.0, 440.0, 480.0], ["0|1|a", "0|2|b", "1|3|c"])
    assert sorted(map(sorted, groups)) == [[0, 1], [2]]


def test_hold_merging_is_not_single_valued(spark):
    an = analysed(spark, stop(seconds=90), steady())
    runs = ghost.stalls(an.legs).filter("attempt_id = 'a'").collect()
    assert len(runs) == 1 and runs[0].e1 - runs[0].e0 > 85_000


def test_route_from_a_recording(spark):
    r = routes.derive_routes(samples(spark, trace("a", [(i, 0.0) for i in range(5)] + [(5 + i, 8.0 * i) for i in range(40)]), trace("b", [(i, 0.0) for i in range(9)]))).orderBy("session_id").collect()
    assert r[0].saveable and r[0].reason is None and len(r[0].path) >= 38 and 290 < r[0].distance_m < 320
    assert not r[1].saveable and r[1].reason == "too_little_movement" and r[1].path is None


def test_layout_problems(spark):
    assert routes.layout_problem(course(spark)).first().problem is None
    assert routes.layout_problem(course(spark, radius=5.0)).first().problem == "start_radius"
    assert routes.layout_problem(course(spark, marks=[("a", 3.0)])).first().problem == "markers_too_close"
    assert routes.layout_problem(course(spark, marks=[(" ", 100.0)])).first().problem == "checkpoint_name"


def test_clean_fixes(spark):
    rows = [("a", 1, 91.0, 0.0, 1.0, 1.0, 1.0), ("b", 0, 1.0, 1.0, 1.0, 1.0, 1.0), ("c", 5, 1.0, 1.0, -1.0, float("nan"), 361.0), ("d", 5, None, 1.0, 1.0, 1.0, 1.0), ("e", 5, 1.0, 181.0, 1.0, 1.0, 1.0)]
    got = src.clean_fixes(spark.createDataFrame(rows, "id string, recorded_at_ms long, latitude double, longitude double, accuracy double, speed double, heading double")).collect()
    assert [(r.id, r.accuracy, r.speed, r.heading) for r in got] == [("c", None, None, None)]


def test_upsert_and_cascade(spark):
    old = spark.createDataFrame([("a", 1, 10), ("b", 2, 20)], "id string, armed int, v int")
    new = spark.createDataFrame([("b", 9, 21), ("b", 9, 22), ("c", 3, 30)], "id string, armed int, v int")
    got = sorted(map(tuple, sessions.upsert(old, new, ["id"], ["v"], frozen=("armed",)).collect()))
    assert got == [("a", 1, 10), ("b", 2, 22), ("c", 3, 30)]
    left = sessions.delete_routes(spark.createDataFrame([("r",), ("s",)], "route_id string"), spark.createDataFrame([("r",)], "route_id string"), points=spark.createDataFrame([("r", 1), ("s", 1)], "route_id string, seq int"))
    assert left["routes"].collect()[0][0] == "s" and left["points"].count() == 1


def test_samples_sink_and_lines(spark, tmp_path):
    s = samples(spark, trace("a", steady(until=20)), trace("b", steady(until=20))).withColumn("heading", F.when(F.col("id") > "00000", 90.2)).drop("attempt_id", "route_id")
    store, active = str(tmp_path / "s"), spark.createDataFrame([("a", True), ("b", False)], "id string, is_active boolean")
    first = s.withColumn("speed", F.lit(4.0))
    assert src.append_samples(first, active, store) == 5
    back = src.read_samples(spark, store)
    assert {r.session_id for r in back.collect()} == {"a"}
    lines = [r.line for r in src.sample_line(back).orderBy("id").collect()]
    assert lines[0] == "2023-11-14T22:13:20.000Z  32.080000, 34.780000  ±5.0m  4.0m/s  hdg n/a" and lines[1].endswith("  90°")
    # Sent again, with another speed: it replaces what is there.
    assert src.append_samples(s.filter("id = '00001'").withColumn("speed", F.lit(9.0)), active, store) == 1
    assert {r.id: r.speed for r in src.read_samples(spark, store).collect()} == {"00000": 4.0, "00001": 9.0, "00002": 4.0, "00003": 4.0, "00004": 4.0}
    assert src.append_samples(s, active.withColumn("is_active", F.lit(False)), store) == 0


def test_texts(spark):
    from waywright.functions import text

    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(text.rank_among(F.lit(2), F.lit(9))) == "2nd fastest of 9" and one(text.mode_label(F.lit("skate"))) == "skate" and one(text.mode_icon(F.lit("skate"))) == ""
    assert one(text.fix_age(F.lit(-5))) == "0s ago" and one(text.fix_age(F.lit(61_500))) == "1m 1s ago" and one(text.fix_health(F.lit(None).cast("long"))) == "waiting_for_first_fix"
    assert one(text.attempt_stamp(F.lit(T0))) == "2023-11-14 22:13:20"
    from waywright.functions.geo import plain

    assert [one(plain(F.lit(x))) for x in (100.0, 0.5, 12345678.25, 0.0, 86400000.125)] == ["100", "0.5", "12345678.25", "0", "86400000.125"]
    assert [one(sessions.tracking_status(F.lit(a), F.lit(o))) for a, o in ((True, "active"), (False, "active"), (True, "finished"), (False, "interrupted"))] == ["tracking", "idle", "idle", "interrupted"]


def test_start_zone_of_latest_samples(spark):
    """Off the course is outside, a poor fix and no fix are locating."""
    c = course(spark)
    s = samples(spark, trace("in", [(0, 5.0)]), trace("far", [(0, 5.0), (1, 5.0, 90.0)]), trace("on", [(i, 10.0 * i) for i in range(8)]), trace("poor", [(0, 5.0), (1, 5.0, 0.0, 60.0)]))
    m = matching.match_samples(s, c)
    attempts = s.select("attempt_id", "route_id").distinct().union(spark.createDataFrame([("none", "r")], "attempt_id string, route_id string"))
    got = {r.attempt_id: r.status for r in timing.start_zone_status(attempts, m, c, timing.replay(m, c)).collect()}
    assert got == {"in": "inside", "far": "outside", "on": "outside", "poor": "locating", "none": "locating"}


def test_identity_and_geojson(spark):
    c = course(spark, marks=[("b", 200), ("a", 200)])
    assert routes.layout_identity(c).first().identity.endswith("|cp=[a:200.000,b:200.000]") and routes.layout_identity(c).first().identity.startswith("start=0.000|finish=799.")
    waits = spark.createDataFrame([("r", "w1", LAT, LON), ("r", "w2", None, None)], "route_id string, wait_id string, latitude double, longitude double")
    found = json.loads(src.course_geojson(c, waits, "w1").first().geojson)["features"]
    assert [f["properties"]["kind"] for f in found] == ["path", "start-zone", "start", "finish-zone", "finish", "checkpoint", "checkpoint", "wait"]
    assert found[-1]["properties"]["selected"] == "yes" and found[-1]["geometry"] == {"type": "Point", "coordinates": [LON, LAT]}
    assert found[1]["geometry"]["coordinates"][0][0] == found[1]["geometry"]["coordinates"][0][-1]


def test_saving_and_arming(spark):
    derived = routes.derive_routes(samples(spark, trace("a", [(i, 8.0 * i) for i in range(40)]), trace("b", [(0, 0.0)])))
    rows = [("a", False, "route_creation", "finished", "pending"), ("b", False, "route_creation", "finished", "pending")]
    s = spark.createDataFrame(rows, "id string, is_active boolean, purpose string, capture_outcome string, review_disposition string").withColumn("started_at_ms", F.lit(1))
    names = spark.createDataFrame([("a", "r1", "  Home ", "bike", 5), ("b", "r2", "Work", "bike", 5)], "session_id string, route_id string, name string, transportation_mode string, created_at_ms int")
    saved = sessions.saved_routes(derived, s, names).collect()
    assert [(r.route_id, r.name, r.source_recording_id) for r in saved] == [("r1", "Home", "a")] and saved[0].finish_p > 280
    c, attempts = course(spark), spark.createDataFrame([("x", "completed")], "attempt_id string, lifecycle string")
    why = lambda s, a: sessions.arming_problem(c, routes.layout_problem(c), s, a).first().reason
    assert why(s.limit(0), attempts) is None and why(s, attempts) == "pending_route" and why(s.withColumn("is_active", F.lit(True)), attempts) == "recording"
    assert why(s.limit(0), attempts.withColumn("lifecycle", F.lit("armed"))) == "open_attempt"
    bad = course(spark, radius=5.0)
    assert sessions.arming_problem(bad, routes.layout_problem(bad), s.limit(0), attempts).first().reason == "start_radius"


def test_long_traces_are_matched_as_short_ones(spark, monkeypatch):
    """Over many slices and segments, with a window of segments at a time, as with all of them at once."""
    r = random.Random(1)
    path = [(LAT + i * 12 / 111320, LON + (i % 7) * 3e-5) for i in range(700)]
    steps = [(i, 0.9 * i + r.uniform(-8, 8), r.uniform(-30, 30)) for i in range(9000)]
    c, s = course(spark, path=path), samples(spark, trace("a", steps))
    got = [(x.quality, x.progress_m) for x in matching.match_samples(s, c).orderBy("seq").collect()]
    rows = s.orderBy("recorded_at_ms").collect()
    monkeypatch.setattr(matching, "MOST_CELLS", 10**9)
    whole = matching._Follower(np.array([p[0] for p in path]), np.array([p[1] for p in path]), 0.0)
    want = [x[:2] for x in whole(np.array([x.latitude for x in rows]), np.array([x.longitude for x in rows]), np.zeros(len(rows), bool))]
    assert got == want and {q for q, _ in got} >= {"accepted"}


def test_legs_meet_intervals_in_proportion_to_a_trip(spark):
    """A trip ten times as long has about ten times the pairs, and what isn't in the same half minute never meets."""

    def pairs(n):
        k = spark.range(n + 1).select(F.lit("a").alias("attempt_id"), F.col("id").alias("n"), (F.col("id") * 1000.0).alias("elapsed_ms"), F.col("id").cast("double").alias("progress_m"), (F.col("id") * 1000.0).alias("at_ms"))
        i = spark.range(n).select(F.lit("a").alias("attempt_id"), F.when(F.col("id") % 9 == 4, "unknown").otherwise("moving").alias("label"), (F.col("id") * 1000.0).alias("start_ms"), (F.col("id") * 1000.0 + 1000).alias("end_ms"))
        found = ghost.legs(k, i)
        assert found.filter("not good").count() == n // 9 + (n % 9 > 4)
        plan = found._jdf.queryExecution()
        found.write.format("noop").mode("overwrite").save()
        return plan.toString()

    assert "bucket" in pairs(900) and "bucket" in pairs(9000)


def test_running_values_over_ranges_equal_windows(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 7).cast("string")).alias("k"), (F.col("id") * 7919 % 1009).alias("x"), "id", F.when(F.col("id") % 5 == 0, F.col("id") * 31 % 97).alias("v"))
    order = [F.col("x").asc(), F.col("id").asc()]
    got = prefix.with_earlier(prefix.dealt(rows, ["k"], order, "t"), ["k"], order, {"n": ("count", F.lit(1)), "least": ("min", F.col("v")), "most": ("max", F.col("v")), "was": ("last", F.struct("id"))})
    w = Window.partitionBy("k").orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    want = rows.select("*", F.count("*").over(before).alias("n"), F.min("v").over(before).alias("least"), F.max("v").over(before).alias("most"), F.lag(F.struct("id")).over(w).alias("was"))
    assert sorted(map(repr, got.select(want.columns).collect())) == sorted(map(repr, want.collect()))


def test_empty_inputs(spark):
    s, c = samples(spark, trace("a", steady(until=10))).limit(0), course(spark)
    an = Analysis(s, c, src.synthetic_attempts(s))
    assert an.ranked.count() == an.ghosts.count() == an.waits.count() == an.comparison.count() == 0
    assert movement.breakdown(an.intervals, an.ranked).count() == 0
