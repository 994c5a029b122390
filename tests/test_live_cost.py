"""What a live batch costs: calls to the state, rows that pass to Python, and the choice of a sample's place."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Row

from tests.test_live import armed, fixes, run
from tests.trips import LAT, LON, course, steady, trace
from waywright.functions import constants as K
from waywright.operators import matching
from waywright.streaming import keyed

CLOCK = 1_000_000


class Calls:
    """A store of one key in memory, which counts what is asked of it."""

    def __init__(self):
        self.value, self.calls, self.timers = None, [], set()

    def getValueState(self, name, schema):
        self.calls.append("state")
        return self

    def exists(self):
        self.calls.append("exists")
        return self.value is not None

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def registerTimer(self, at):
        self.calls.append("register")
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls.append("delete")
        self.timers.remove(at)


class Now:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentProcessingTimeInMs(self):
        return self.ms


def processor():
    lats = [LAT + i * 20.0 / 111_320.0 for i in range(41)]
    p = keyed.LiveRuns({"r": keyed.Course(lats, [LON] * 41, 0.0, 800.0, 30.0, 770.0, [("a", "a", 100.0)])}, 10_000, 120_000)
    handle = Calls()
    p.init(handle)
    return p, handle


def fed(p, handle, samples, now=CLOCK):
    handle.calls = []
    pack = Row(attempt_id="a", route_id="r", **{name: [s[i] for s in samples] for i, name in ((3, "id"), (4, "t"), (5, "latitude"), (6, "longitude"), (7, "accuracy"))})
    return [r.x for r in p.handleInputRows(("a",), iter([pack]), Now(now))], handle.calls


def test_a_batch_asks_the_state_a_few_times_whatever_it_holds():
    """Each call is a round trip between Python and the store: there are four at most, while the run waits, moves and ends, and none after."""
    p, handle = processor()
    assert handle.calls == ["state"]
    s = trace("a", steady())
    out, calls = fed(p, handle, s[:60])
    assert calls == ["exists", "register", "update"] and [x["lifecycle"] for x in out] == ["active"]
    out, calls = fed(p, handle, s[60:120], CLOCK + 1000)
    assert calls == ["exists", "get", "update"] and handle.timers == {CLOCK + 120_000}
    out, calls = fed(p, handle, s[120:] + trace("a", [(200, 800.0)]), CLOCK + 2000)
    assert calls == ["exists", "get", "delete", "update"] and not handle.timers
    assert out[-1]["lifecycle"] == "completed" and [c["checkpoint_id"] for c in out[-1]["crossings"]] == ["a"]
    assert fed(p, handle, trace("a", [(300, 800.0)])) == ([], ["exists", "get"])


def test_a_timer_that_samples_overtook_is_set_anew():
    p, handle = processor()
    s = trace("a", steady(until=300))
    fed(p, handle, s[:30])
    fed(p, handle, s[30:40], CLOCK + 50_000)
    handle.timers.clear()
    assert list(p.handleExpiredTimer(("a",), Now(CLOCK + 130_000), None)) == [] and handle.timers == {CLOCK + 170_000}
    assert [r.x["stale"] for r in p.handleExpiredTimer(("a",), Now(CLOCK + 170_000), None)] == [True]
    handle.timers.clear()
    fed(p, handle, s[40:], CLOCK + 180_000)
    assert handle.timers == {CLOCK + 300_000}
    fed(p, handle, trace("a", [(61, 305.0)]), CLOCK + 310_000)  # it ran out, but samples came with the same batch
    assert handle.timers == {CLOCK + 430_000}


def test_samples_pass_to_the_state_as_one_row_an_attempt():
    """No sample is lost or changes its place among its attempt's, nulls and attempts without a route included."""
    r = np.random.default_rng(5)
    rows = [(f"a{r.integers(40)}", [None, "r", "s"][r.integers(3)], f"{i}", i, float(i), -float(i), None if i % 7 == 0 else 1.0 * i) for i in range(3000)]
    names = ["attempt_id", "route_id", *keyed.SAMPLE_NAMES]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)
    packs = [x for out in keyed._packed(iter([batch, batch.slice(0, 0)])) for x in out.to_pylist()]
    assert len(packs) == len({x[:2] for x in rows}) < 150
    for x in packs:
        own = [row[2:] for row in rows if row[:2] == (x["attempt_id"], x["route_id"])]
        assert list(zip(*(x[c] for c in keyed.SAMPLE_NAMES), strict=True)) == own


def test_many_courses_joined(spark, tmp_path):
    """Attempts on two routes whose courses come with their samples, in two batches."""
    c = course(spark, marks=[("a", 100)])
    other = course(spark, points=21).selectExpr("'q' route_id", *[x for x in c.columns if x != "route_id"])
    s = fixes(spark, *(trace(n, steady()) for n in "abcd"))
    s = s.withColumn("route_id", s.attempt_id.isin("a", "b").cast("string")).replace({"true": "r", "false": "q"}, subset="route_id")
    store = keyed.started(spark, str(tmp_path / "store"))
    for n, route in zip("abcd", "rrqq", strict=True):
        armed(spark, store, n, route=route)
    run(spark, tmp_path, c.unionByName(other), store, s.filter("id < '00050'"), s.filter("id >= '00050'"), most_points=0)
    ended = {r.attempt_id: (r.lifecycle, r.finished_at) for r in store.read("attempts").collect()}
    assert {x[0] for x in ended.values()} == {"completed"} and ended["a"] == ended["b"] > ended["c"] == ended["d"]
    assert {r.attempt_id for r in store.read("crossings").collect()} == {"a", "b"}


def test_a_place_is_chosen_as_by_numpy():
    """Among few and many places, with equal costs and equal progress."""
    f, r = matching._Follower(np.array([LAT, LAT + 0.01]), np.array([LON, LON]), 0.0), np.random.default_rng(8)
    for n in (1, 2, 7, 64, 65, 200):
        for _ in range(50):
            p, d, centre = r.integers(0, 12, n) * 10.0, r.integers(0, 4, n) * 3.0, float(r.integers(0, 12) * 10)
            cost = d + K.PROGRESS_COST * np.abs(p - centre) + K.BACKWARD_COST_M * (p < centre)
            w = max(np.flatnonzero(cost == cost.min()).tolist(), key=lambda j: p[j])
            assert f._best(p, d, centre) == (p[w], d[w])
