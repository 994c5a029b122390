"""Results to the last bit, and what one task holds, of the trip queries."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.trips import course, samples, steady, trace
from waywright.functions import constants as K
from waywright.operators import comparing, matching, movement, streams, timing
from waywright.plans import analysis
from waywright.sources import traces
from waywright.sources.staging import staged


def test_a_wait_s_place_is_the_sum_of_its_places_in_order(spark):
    """Two intervals of one wait, four places: added one after another, not as two sums."""
    p = (0.1, 0.2, 0.3, 0.6)
    rows = [("a", 1, "waiting", 0.0, 4000.0, p[0], p[1]), ("a", 2, "waiting", 4000.0, 8000.0, p[2], p[3])]
    labelled = spark.createDataFrame(rows, "attempt_id string, n int, label string, start_ms double, end_ms double, start_p double, end_p double")
    runs = spark.createDataFrame([("a", "r", 0.0)], "attempt_id string, route_id string, started_at double")
    assert ((p[0] + p[1]) + p[2]) + p[3] != (p[0] + p[1]) + (p[2] + p[3])
    assert movement.wait_events(labelled, runs, course(spark)).first().progress_m == (((p[0] + p[1]) + p[2]) + p[3]) / 4


def test_geometry_has_the_same_bits_on_every_machine():
    """Lengths by the C library's functions, in the order of the formula; a place is its segment's beginning and a share of the way."""
    r = np.random.default_rng(3)
    lat, lon = 32.0 + r.uniform(0, 0.01, 300), 34.0 + r.uniform(0, 0.01, 300)
    g = matching._Geometry(lat, lon)

    def length(a, b, c, d):
        h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) * math.sin(math.radians(d - b) / 2)
        return 2 * K.EARTH_RADIUS_M * math.asin(min(1.0, math.sqrt(h)))

    assert g.length.tolist() == [length(*x) for x in zip(lat[:-1], lon[:-1], lat[1:], lon[1:], strict=True)]
    on, share = np.arange(299), r.uniform(0, 1, 299)
    assert g.point(on, share)[0].tolist() == [lat[i] + (lat[i + 1] - lat[i]) * share[i] for i in range(299)]


def test_a_cluster_s_sum_is_that_of_its_two_parts():
    """Of a cluster that two clusters make, and amounts besides places; equal places go by their keys."""
    at = [0.1, 0.2, 8.3, 8.7]
    (first, last, total, amount), = comparing._linked(at, [1.0, 2.0, 4.0, 8.0])
    assert (first, last, amount) == (0, 3, 15.0) and total == (0.1 + 0.2) + (8.3 + 8.7)
    assert comparing._clusters([5.0, 5.0, 5.0], ["c", "a", "b"]) == [[1, 2, 0]]
    assert comparing._clusters([]) == []


def test_waits_are_clustered_in_no_group_of_their_own(spark):
    """Stretches of a comparison stream past in order along the course; none is handed to Python alone."""
    waits = [(a, f"w{i}", 10_000.0 * i, 5_000.0, 100.0 * i + (7.0 if a == "b" else 0.0), True) for a in "ab" for i in range(1, 6)]
    w = spark.createDataFrame(waits, "attempt_id string, wait_id string, start_ms double, duration_ms double, progress_m double, located boolean")
    focus = spark.createDataFrame([("a", "b", "r", True), ("b", None, "r", True)], "attempt_id string, target_id string, route_id string, eligible boolean")
    found = comparing.wait_clusters(w, focus, course(spark)).orderBy("cluster").collect()
    assert [(c.attempt_id, c.members, c.current_ids, c.reference_ids, c.current_ms, c.reference_ms, c.progress_m, c.span_m) for c in found] == [("a", 2, [f"w{i}"], [f"w{i}"], 5_000.0, 5_000.0, 100.0 * i + 3.5, 7.0) for i in range(1, 6)]
    assert found[0].location_id == "wait-cmp:0|10000|w1;1|10000|w1"


def test_a_task_of_the_replay_sorts_its_rows_once(spark):
    """All that is asked of a run goes by one order; each sort beside another holds its own pages, however few the rows."""
    c = course(spark)
    m = matching.match_samples(samples(spark, trace("a", steady())), c)
    final = timing.replay(m.localCheckpoint(), c)._jdf.queryExecution().executedPlan().toString()
    assert final.count("Sort [attempt_id") == 1 and final.count("hashpartitioning(attempt_id") == 1


def test_runs_without_an_attempt_or_a_course_stay_armed(spark):
    c = course(spark)
    m = matching.match_samples(samples(spark, trace("a", steady())), c)
    odd = m.withColumn("attempt_id", F.lit(None).cast("string")).unionByName(m.withColumns({"attempt_id": F.lit("b"), "route_id": F.lit("none")}))
    assert {(r.attempt_id, r.lifecycle, r.started_at) for r in timing.replay(odd, c).collect()} == {(None, "armed", None), ("b", "armed", None)}


def test_usable_samples_are_matched_once(spark, monkeypatch):
    """The matcher's rows are read by several parts of the intervals' plan, which reads them as a table."""
    kept = []
    monkeypatch.setattr(analysis, "staged", lambda df, name: kept.append(name) or staged(df, name))
    monkeypatch.setattr(movement, "staged", lambda df, name: kept.append(name) or staged(df, name))
    s = samples(spark, trace("a", steady()))
    an = analysis.Analysis(s, course(spark), traces.synthetic_attempts(s))
    assert an.intervals.count() > 100 and kept.index("usable-matched") < kept.index("points") < kept.index("intervals")


def test_small_batches_are_joined():
    """In order, up to a slice each; batches of another schema stay apart."""
    one = [pa.RecordBatch.from_pydict({"x": pa.array([i], pa.int64())}) for i in range(5_000)]
    other = pa.RecordBatch.from_pydict({"y": pa.array(["z"])})
    found = list(streams._joined(iter([*one, other])))
    assert [b.num_rows for b in found] == [streams.SLICE, 5_000 - streams.SLICE, 1]
    assert [x for b in found[:2] for x in b.column("x").to_pylist()] == list(range(5_000)) and list(streams._joined(iter([]))) == []
