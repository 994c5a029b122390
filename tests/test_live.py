"""Keyed live state against the batch, timers, late samples, and commits over several tables."""

import pytest
from pyspark.sql import functions as F

from tests.test_streaming import fixes
from tests.trips import course, steady, trace
from waywright.operators import matching, timing
from waywright.sources.store import Conflict, Store, Table
from waywright.streaming import keyed, live

NOW = 1_800_000_000_000


def armed(spark, store, *names, route="r"):
    store.commit({
        "attempts": spark.createDataFrame([(n, route, f"s-{n}", "armed", "pending", 1, None, None, False) for n in names], keyed.TABLES["attempts"].schema),
        "sessions": spark.createDataFrame([(f"s-{n}", 1, None, True, "attempt", "active", "pending") for n in names], keyed.TABLES["sessions"].schema),
    })


def run(spark, tmp_path, c, store, *parts, **more):
    for p in parts:
        p.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = keyed.keep_live(live.read_fixes(spark, str(tmp_path / "in")), c, store, str(tmp_path / "check"), clock=lambda: NOW, **more)
    q.awaitTermination()
    return q


def by_id(df, key="attempt_id"):
    return {r[key]: r for r in df.collect()}


def wandering():
    """Traces with a detour, a late start, steps back, poor fixes, and one that leaves for good."""
    away = [(i, 5.0 * i, 120.0 if 40 <= i < 70 else 0.0) for i in range(161)]
    gone = [(i, 5.0 * i, 120.0 if i >= 40 else 0.0) for i in range(120)]
    late = [(i, max(0.0, 3.0 * (i - 20))) for i in range(270)]
    back = [(i, 6.0 * (i if i < 30 else 60 - i if i < 45 else i - 30)) for i in range(150)]
    poor = [(i, 5.0 * i, 0.0, 60.0 if i % 7 == 0 else 5.0) for i in range(161)]
    return {"away": away, "gone": gone, "late": late, "back": back, "poor": poor, "steady": steady()}


@pytest.mark.parametrize("start", [0.0, 40.0])
def test_keyed_states_equal_the_batch(spark, tmp_path, start):
    """Any cut of the samples into batches ends in what a replay of all of them gives, crossings included."""
    c = course(spark, marks=[("a", 100), ("b", 300), ("c", 600)], start=start)
    s = fixes(spark, *(trace(n, steps) for n, steps in wandering().items()))
    store = keyed.started(spark, str(tmp_path / "store"))
    armed(spark, store, *wandering())
    run(spark, tmp_path, c, store, *(s.filter(f"id >= '{a:05d}' and id < '{b:05d}'") for a, b in ((0, 25), (25, 45), (45, 110), (110, 999))))
    matched = matching.match_samples(s, c)
    runs = timing.replay(matched, c)
    want, got = by_id(runs), by_id(store.read("attempts"))
    assert got.keys() == want.keys()
    for k, r in want.items():
        assert (got[k].lifecycle, got[k].validity, got[k].started_at, got[k].finished_at) == (r.lifecycle, r.validity, r.started_at, r.finished_at), k
    marks = lambda df: {(r.attempt_id, r.checkpoint_id, r.crossed_at) for r in df.collect()}
    assert marks(store.read("crossings")) == marks(timing.crossings(matched, c, runs)) != set()
    assert {r.id for r in store.read("crossings", of=["steady"]).collect()} == {"steady:a", "steady:b", "steady:c"}
    zones = {r.attempt_id: r.status for r in timing.start_zone_status(runs.select("attempt_id", "route_id"), matched, c, runs).collect()}
    assert {r.attempt_id: r.start_zone for r in store.read("live").collect()} == {k: zones[k] if want[k].lifecycle == "armed" else "locating" for k in want}
    sessions = by_id(store.read("sessions"), "id")
    for k, r in want.items():
        own = sessions[f"s-{k}"]
        end = {"completed": (False, "finished", "saved", NOW), "abandoned": (False, "interrupted", "discarded", NOW)}.get(r.lifecycle, (True, "active", "pending", None))
        assert (own.is_active, own.capture_outcome, own.review_disposition, own.stopped_at_ms) == end


def test_work_follows_new_samples(spark, tmp_path):
    """A long attempt in many batches: each goes through its own samples and those of the last moments, not the trace."""
    c = course(spark, points=201)
    s = fixes(spark, trace("a", [(i, 1.0 * i) for i in range(1200)]))
    for k in range(6):
        s.filter(f"id >= '{k * 200:05d}' and id < '{k * 200 + 200:05d}'").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rows = []
    keyed.begun(keyed.live_runs(live.read_fixes(spark, str(tmp_path / "in")), c, late_ms=10_000), lambda b, n: rows.extend(b.collect()), str(tmp_path / "check")).awaitTermination()
    assert len(rows) == 6 and max(r.walked for r in rows) <= 211 and rows[-1].samples == 1200


def test_out_of_order_within_the_bound_and_beyond(spark, tmp_path):
    c = course(spark)
    s = fixes(spark, trace("a", steady()))
    shuffled = [s.filter("id < '00060' and id not in ('00055', '00030')"), s.filter("id in ('00055') or (id >= '00060' and id < '00070')"), s.filter("id = '00030' or id >= '00070'")]
    store = keyed.started(spark, str(tmp_path / "store"))
    armed(spark, store, "a")
    run(spark, tmp_path, c, store, *shuffled)
    want = timing.replay(matching.match_samples(s.filter("id <> '00030'"), c), c).first()
    got = store.read("attempts").first()
    assert (got.lifecycle, got.started_at, got.finished_at) == (want.lifecycle, want.started_at, want.finished_at)
    assert [(r.attempt_id, r.id) for r in store.read("late").collect()] == [("a", "00030")]


def test_silence_makes_an_attempt_stale_without_a_sample(spark, tmp_path):
    fixes(spark, trace("a", steady(until=300))).coalesce(1).write.parquet(str(tmp_path / "in"))
    store = keyed.started(spark, str(tmp_path / "store"))
    armed(spark, store, "a")
    q = keyed.keep_live(live.read_fixes(spark, str(tmp_path / "in")), course(spark), store, str(tmp_path / "check"), every="1 second", stale_ms=3_000)
    try:
        import time

        for _ in range(120):
            time.sleep(1)
            if any(r.stale for r in store.read("live").collect()):
                break
        else:
            raise AssertionError("never stale")
    finally:
        q.stop()
    assert store.read("attempts").first().lifecycle == "active"


def test_an_attempt_without_its_route_is_abandoned(spark, tmp_path):
    store = keyed.started(spark, str(tmp_path / "store"))
    armed(spark, store, "a", route="gone")
    run(spark, tmp_path, course(spark), store, fixes(spark, trace("a", steady())).withColumn("route_id", F.lit("gone")))
    a, s = store.read("attempts").first(), store.read("sessions").first()
    assert (a.lifecycle, a.validity, a.started_at, s.is_active, s.capture_outcome, s.review_disposition) == ("abandoned", "unranked", None, False, "interrupted", "discarded")


def test_attempts_that_are_not_open_stay(spark, tmp_path):
    """A cancelled attempt's samples change nothing; of unknown attempts nothing is kept."""
    store = keyed.started(spark, str(tmp_path / "store"))
    armed(spark, store, "a")
    store.commit({"attempts": store.read("attempts").withColumn("lifecycle", F.lit("cancelled"))})
    run(spark, tmp_path, course(spark), store, fixes(spark, trace("a", steady()), trace("b", steady(), 3000)))
    assert [(r.attempt_id, r.lifecycle, r.finished_at) for r in store.read("attempts").collect()] == [("a", "cancelled", None)]


def test_courses_joined_instead_of_sent(spark, tmp_path):
    c = course(spark, marks=[("a", 100)])
    store = keyed.started(spark, str(tmp_path / "store"))
    armed(spark, store, "a")
    run(spark, tmp_path, c, store, fixes(spark, trace("a", steady())), most_points=0)
    assert store.read("attempts").first().lifecycle == "completed" and store.read("crossings").count() == 1


def test_reconcile_abandons_what_nothing_records(spark, tmp_path):
    store = keyed.started(spark, str(tmp_path / "store"))
    armed(spark, store, "a", "b")
    armed(spark, store, "c", route="gone")
    keyed.reconcile(store, course(spark), spark.createDataFrame([("a",), ("c",)], "attempt_id string"), NOW)
    assert {k: r.lifecycle for k, r in by_id(store.read("attempts")).items()} == {"a": "armed", "b": "abandoned", "c": "abandoned"}
    assert {k: r.is_active for k, r in by_id(store.read("sessions"), "id").items()} == {"s-a": True, "s-b": False, "s-c": False}


SMALL = {"a": Table("id string, v long", ("id",), "id", 4), "b": Table("id string, w long", ("id",), "id", 4)}


def rows(spark, letter, *pairs):
    return spark.createDataFrame(list(pairs), SMALL[letter].schema)


def test_a_failure_between_two_writes_leaves_the_old_state(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"), SMALL)
    store.commit({"a": rows(spark, "a", ("x", 1)), "b": rows(spark, "b", ("x", 1))})
    write = Store._write

    def failing(self, name, df):
        if name == "b":
            raise OSError("disk")
        return write(self, name, df)

    monkeypatch.setattr(Store, "_write", failing)
    with pytest.raises(OSError):
        store.commit({"a": rows(spark, "a", ("x", 2)), "b": rows(spark, "b", ("x", 2))})
    monkeypatch.undo()
    assert store.read("a").first().v == 1 and store.read("b").first().w == 1
    store.commit({"a": rows(spark, "a", ("x", 3)), "b": rows(spark, "b", ("x", 3))})
    assert store.read("a").first().v == 3 and store.read("b").first().w == 3 and store.read("a", at=0).first().v == 1
    assert store.vacuum() >= 1 and store.read("a").first().v == 3


def test_writers_that_meet(spark, tmp_path):
    """The second of two writers starts from what the first has published; both changes stand."""
    store, other = (Store(spark, str(tmp_path / "s"), SMALL) for _ in range(2))
    store.commit({"a": rows(spark, "a", ("x", 1))})
    publish = Store._publish
    met = []

    def meeting(self, manifest):
        if self is store and not met:
            met.append(1)
            other.commit({"b": rows(spark, "b", ("y", 7))})
        publish(self, manifest)

    Store._publish = meeting
    try:
        assert store.commit({"a": rows(spark, "a", ("x", 2))}) == 2
    finally:
        Store._publish = publish
    assert store.read("a").first().v == 2 and store.read("b").first().w == 7
    with pytest.raises(Conflict):
        store._publish(store.manifest())


def test_many_commits_leave_few_files_and_a_key_is_read_from_its_bucket(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), SMALL)
    for i in range(40):
        store.commit({"a": rows(spark, "a", (f"k{i % 7}", i), (f"n{i}", i))}, gone={"a": rows(spark, "a", (f"n{i - 1}", 0)).select("id")} if i % 10 == 9 else None)
    assert len(store.manifest()["tables"]["a"]) <= 2 * 7
    want = {f"k{i % 7}": i for i in range(40)} | {f"n{i}": i for i in range(40) if i % 10 != 8}
    assert {r.id: r.v for r in store.read("a").collect()} == want
    one = store.read("a", of=["k3"])
    assert [r.v for r in one.collect()] == [38]
    files = {f for f in one.inputFiles()}
    assert files and len({f.split("_bucket=")[1].split("/")[0] for f in files}) >= 1
    assert "PartitionFilters: [isnotnull(_bucket" in one._jdf.queryExecution().toString()
    store.vacuum()
    assert {r.id: r.v for r in store.read("a", of=spark.createDataFrame([("k1",), ("n2",)], "id string")).collect()} == {"k1": 36, "n2": 2}


def test_a_batch_counts_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), SMALL)
    assert store.commit({"a": rows(spark, "a", ("x", 1))}, stream="q", batch=0) == 0
    assert store.commit({"a": rows(spark, "a", ("x", 2))}, stream="q", batch=0) == 0
    assert store.read("a").first().v == 1


def test_stored_samples_of_many_calls(spark, tmp_path):
    """Few segments after many calls; a session is read from its bucket; the last call's values count."""
    from waywright.sources import traces

    path, active = str(tmp_path / "s"), spark.createDataFrame([("a", True), ("b", True), ("c", False)], "id string, is_active boolean")
    raw = lambda k: spark.createDataFrame([(s, f"{s}{i}", 1000 * i, 32.0, 34.0, -1.0, float(k), 10.0) for s in "abc" for i in range(k, k + 3)] + [("a", f"bad{k}", 0, 32.0, 34.0, 1.0, 1.0, 1.0)], "session_id string, id string, recorded_at_ms long, latitude double, longitude double, accuracy double, speed double, heading double")
    for k in range(1, 18):
        assert traces.record_fixes(raw(k), active, path) == 6
    store = traces.sample_store(spark, path)
    assert len(store.manifest()["tables"]["samples"]) <= 1 + 7 + 2
    got = traces.read_samples(spark, path, ["a"]).collect()
    assert {r.id: r.speed for r in got} == {f"a{i}": float(min(i, 17)) for i in range(1, 20)} and all(r.accuracy is None for r in got)
    assert traces.read_samples(spark, path).count() == 38 == traces.read_samples(spark, path, spark.createDataFrame([("a",), ("b",), ("c",)], "s string")).count()
    assert all("_bucket=" in f for f in traces.read_samples(spark, path, ["a"]).inputFiles())
