from pyspark.sql import functions as F

from tests.trips import course, samples, steady, trace
from waywright.operators import matching, timing
from waywright.streaming import live


def fixes(spark, *traces):
    return samples(spark, *traces).selectExpr("attempt_id", "route_id", "id", "recorded_at_ms", "latitude", "longitude", "accuracy", "speed", "cast(null as double) heading")


def streamed(spark, tmp_path, c, *parts, **more):
    for p in parts:
        p.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live.live_attempts(live.read_fixes(spark, str(tmp_path / "in")), c, str(tmp_path / "store"), str(tmp_path / "states"), str(tmp_path / "check"), **more).awaitTermination()
    return {r.attempt_id: r for r in live.latest_states(spark, str(tmp_path / "states")).collect()}


def test_stream_ends_like_the_batch(spark, tmp_path):
    """Samples in four files, out of order: the last states equal a replay of everything at once."""
    s = fixes(spark, trace("a", steady()), trace("b", steady(until=300), 3000), trace("c", [(i, 0.0) for i in range(130)], 6000))
    c = course(spark)
    got = streamed(spark, tmp_path, c, *(s.filter(f) for f in ("id < '00050'", "id >= '00070' and id < '00100'", "id >= '00050' and id < '00070'", "id >= '00100'")))
    want = {r.attempt_id: r for r in timing.replay(matching.match_samples(s, c), c).collect()}
    assert got.keys() == want.keys() and {k: r.lifecycle for k, r in want.items()} == {"a": "completed", "b": "active", "c": "armed"}
    for k, r in want.items():
        assert (got[k].lifecycle, got[k].started_at, got[k].finished_at) == (r.lifecycle, r.started_at, r.finished_at)
    assert {k: r.start_zone for k, r in got.items()} == {"a": "locating", "b": "locating", "c": "inside"}


def test_stream_drops_what_comes_after_the_end_and_what_isn_t_active(spark, tmp_path):
    s = fixes(spark, trace("a", steady()), trace("b", steady(until=300), 3000))
    late = fixes(spark, trace("a", [(300 + i, 400.0) for i in range(5)])).withColumn("id", F.concat(F.lit("late"), "id"))
    c = course(spark)
    got = streamed(spark, tmp_path, c, s, late, active=lambda session: session.createDataFrame([("a",)], "attempt_id string"))
    assert set(got) == {"a"} and got["a"].lifecycle == "completed"
    assert [(r.attempt_id, r.batch) for r in spark.read.parquet(str(tmp_path / "states")).collect()] == [("a", 0)]
    assert spark.read.parquet(str(tmp_path / "store")).count() == len(steady())


def test_windowed_activity(spark, tmp_path):
    fixes(spark, trace("a", steady())).write.parquet(str(tmp_path / "in"))
    q = live.windowed_activity(live.read_fixes(spark, str(tmp_path / "in"), 10)).writeStream.outputMode("complete").format("memory").queryName("activity").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(r.samples for r in spark.table("activity").collect()) == len(steady())
