"""Named queries of the library and the SQL that each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import labels, text
from ..functions.geo import milli
from ..operators import comparing, ghost, matching, movement, ranking, routes, sessions, timing
from ..sources import traces
from ..sources.staging import staged, staging_folder
from ..streaming import keyed, live
from . import oracles
from .analysis import Analysis

_kept: dict[tuple[str, str, str], Analysis] = {}


def analysis(spark: SparkSession, sf_dir: str) -> Analysis:
    """The analysis of a folder's tables; its staged tables are shared by the queries of one application, until the events change."""
    key = (spark.sparkContext.applicationId, sf_dir, _state(spark, f"{sf_dir}/events.parquet"))
    if key not in _kept:
        samples = staged(traces.synthetic_samples(spark, sf_dir), "samples")
        _kept[key] = Analysis(samples, traces.synthetic_courses(spark, sf_dir), staged(traces.synthetic_attempts(samples), "attempts"))
    return _kept[key]


def fresh() -> None:
    """Forget what earlier queries staged."""
    _kept.clear()


def _state(spark: SparkSession, path: str) -> str:
    """What tells a table's present content: its files' names, sizes and times of change."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return ";".join(sorted(f"{x.getPath().getName()},{x.getLen()},{x.getModificationTime()}" for x in fs.listStatus(p)))


def _raw_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with the faults that cleaning must find, at some events."""
    s = traces.synthetic_samples(spark, sf_dir)
    n = F.col("id").cast("long")
    return s.withColumns({
        "latitude": F.when(n % 13 == 0, F.lit(91.0)).when(n % 17 == 0, F.lit(float("nan"))).otherwise(F.col("latitude")),
        "accuracy": F.when(n % 7 == 0, -1.0).otherwise(F.col("accuracy")), "heading": F.when(n % 5 == 0, 361.0).otherwise(F.lit(90.0)),
        "recorded_at_ms": F.when(n % 19 == 0, 0).otherwise(F.col("recorded_at_ms")),
    })


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session for each customer; many have no samples."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("long").alias("k"))
    k, start = F.col("k"), F.lit(traces.BASE_MS) + F.col("k") * 1000
    outcomes = F.array(*map(F.lit, ("active", "finished", "cancelled", "interrupted", "unknown")))
    return c.select(
        k.cast("string").alias("id"), start.alias("started_at_ms"), (k % 7 == 0).alias("is_active"), F.when(k % 3 == 0, "attempt").otherwise("route_creation").alias("purpose"), F.element_at(outcomes, (k % 5 + 1).cast("int")).alias("capture_outcome"),
        F.when(k % 11 == 0, "saved").otherwise("pending").alias("review_disposition"), F.when(k % 4 != 0, start + (k % 50 - 10) * 60_000).alias("stopped_at_ms"),
    )


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored attempts, one an order."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("long").alias("k"), F.col("o_custkey").cast("long").alias("c"))
    k = F.col("k")
    lives = F.array(*map(F.lit, ("armed", "active", "completed", "cancelled", "abandoned")))
    return o.select(
        k.cast("string").alias("attempt_id"), (F.col("c") % 25).cast("string").alias("route_id"), F.col("c").cast("string").alias("session_id"), F.element_at(lives, (k % 5 + 1).cast("int")).alias("lifecycle"),
        F.when(k % 5 == 2, F.when(k % 3 == 0, "unranked").otherwise("valid")).otherwise("pending").alias("validity"), (F.lit(traces.BASE_MS) + k * 1000).alias("armed_at_ms"), (k % 4 == 1).alias("result_acknowledged"),
    )


def _crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").cast("long").alias("k"), F.col("l_linenumber").cast("int").alias("n"))
    at = F.lit(float(traces.BASE_MS)) + F.col("k") * 1000 + (F.col("n") % 3) * 100
    return rows.select(F.col("k").cast("string").alias("attempt_id"), F.concat(F.lit("cp"), F.col("n")).alias("checkpoint_id"), F.lit("x").alias("name"), (F.col("n") * 50.0).alias("progress_m"), at.alias("crossed_at"))


def e7(c) -> Column:
    return F.floor((F.col(c) if isinstance(c, str) else c) * 1e7 + 0.5).cast("long")


def q_clean_fixes(spark, d):
    return traces.clean_fixes(_raw_fixes(spark, d)).select("attempt_id", "id", "recorded_at_ms", milli(F.col("accuracy")).alias("accuracy"), milli(F.col("speed")).alias("speed"), milli(F.col("heading")).alias("heading"))


def q_session_last_fix(spark, d):
    return sessions.with_last_sample(_sessions(spark, d), traces.synthetic_samples(spark, d)).select("id", "started_at_ms", "last_sample_at_ms")


def q_active_topk(spark, d):
    s = _sessions(spark, d)
    tops = {"active": sessions.active_session(s), "latest": sessions.latest_session(s), "pending": sessions.pending_route_creation(s), "of_id": sessions.session_of(s, "3")}
    out = None
    for kind, top in tops.items():
        row = top.select(F.lit(kind).alias("kind"), "id", "started_at_ms")
        out = row if out is None else out.union(row)
    return out


def q_session_state(spark, d):
    """What is shown of each session: tracking status, GPS health at a fixed time, times, and how many samples it has."""
    samples = traces.synthetic_samples(spark, d)
    rows = sessions.with_last_sample(_sessions(spark, d), samples).join(samples.groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("points")), "id", "left")
    now = F.lit(traces.BASE_MS + 500_000)
    return rows.select(
        "id", sessions.tracking_status(F.col("is_active"), F.col("capture_outcome")).alias("status"), sessions.review_duration_ms(F.col("started_at_ms"), F.col("stopped_at_ms"), F.col("capture_outcome"), F.col("last_sample_at_ms")).alias("review_ms"),
        F.coalesce("points", F.lit(0)).alias("points"), text.fix_health(now - F.col("last_sample_at_ms")).alias("health"), sessions.recording_elapsed_ms(F.col("started_at_ms"), now).alias("elapsed_ms"),
    )


def q_session_changes(spark, d):
    """Sessions after one that can't start, after some end, after decisions, and after an upgrade."""
    s = _sessions(spark, d)
    k = F.col("id").cast("long")
    wanted = s.limit(1).select(F.lit("0").alias("id"), F.lit(1).cast("long").alias("started_at_ms"), F.lit("attempt").alias("purpose"))
    tables = {
        "refused": sessions.start_session(s, wanted), "started": sessions.start_session(s.withColumn("is_active", F.lit(False)), wanted),
        "ended": sessions.complete_sessions(s, s.filter(k % 14 == 0).select("id", F.lit(5).cast("long").alias("stopped_at_ms"), F.lit("finished").alias("capture_outcome"), F.lit("saved").alias("review_disposition"))),
        "decided": sessions.decide_reviews(s, s.filter(k % 6 == 1).select("id", F.lit("discarded").alias("review_disposition"))), "upgraded": sessions.close_legacy(s, 7),
    }
    out = None
    for kind, rows in tables.items():
        rows = rows.select(F.lit(kind).alias("kind"), "id", "is_active", "purpose", "capture_outcome", "review_disposition", "stopped_at_ms")
        out = rows if out is None else out.union(rows)
    return out


def q_session_samples(spark, d):
    s = traces.synthetic_samples(spark, d)
    return sessions.samples_of(s, "3").select("id", "recorded_at_ms", milli(F.col("latitude")).alias("latitude"))


def q_sample_lines(spark, d):
    return traces.sample_line(traces.synthetic_samples(spark, d))


def q_path_length(spark, d):
    return traces.synthetic_courses(spark, d).select("route_id", milli(F.col("finish_p")).alias("length_mm"))


def _points(spark, d):
    s = traces.synthetic_samples(spark, d)
    return s.select("route_id", F.concat_ws(":", "attempt_id", "id").alias("id"), "latitude", (F.col("longitude") + (F.col("id").cast("long") % 7) * 0.0001).alias("longitude"))


def q_project_nearest(spark, d):
    p = matching.nearest_projection(_points(spark, d), traces.synthetic_courses(spark, d))
    return p.select("id", milli(F.col("progress_m")).alias("progress_mm"), milli(F.col("snap_m")).alias("snap_mm"))


def q_snap_taps(spark, d):
    return matching.snap_taps(_points(spark, d), traces.synthetic_courses(spark, d)).select("id", milli(F.col("progress_m")).alias("progress_mm"))


def q_points_at(spark, d):
    c = traces.synthetic_courses(spark, d)
    marks = c.select("route_id", F.explode(F.sequence(F.lit(-20), F.lit(340), F.lit(15))).alias("id")).withColumn("progress_m", F.col("id").cast("double"))
    return matching.points_at(marks, c).select("route_id", "id", e7("latitude").alias("lat_e7"))


def q_checkpoint_points(spark, d):
    return matching.checkpoint_points(traces.synthetic_courses(spark, d)).select("route_id", "place", "checkpoint_id", "name", e7("latitude").alias("lat_e7"))


def q_bounds(spark, d):
    return matching.bounds(traces.synthetic_courses(spark, d)).select("route_id", *[e7(c).alias(c) for c in ("south", "north", "west", "east")])


def q_preview(spark, d):
    p = matching.preview(traces.synthetic_courses(spark, d))
    return p.select("route_id", "kind", milli(F.col("x")).alias("x_milli"), milli(F.col("y")).alias("y_milli"), milli(F.col("diameter")).alias("diameter_milli"))


def q_winding_project(spark, d):
    """Nearest places on a path that bends, crosses itself and goes back along itself."""
    points = traces.winding_samples(spark, d).select("route_id", F.concat_ws(":", "attempt_id", "id").alias("id"), "latitude", "longitude")
    p = matching.nearest_projection(points, traces.winding_courses(spark, d))
    return p.select("id", milli(F.col("progress_m")).alias("progress_mm"), milli(F.col("snap_m")).alias("snap_mm"), e7("snap_lat").alias("lat_e7"), e7("snap_lon").alias("lon_e7"))


def q_winding_match(spark, d):
    """Samples matched one after another to the winding path; of the course that starts beyond its end, none lies in the window."""
    m = matching.match_samples(traces.winding_samples(spark, d), traces.winding_courses(spark, d))
    return m.select("attempt_id", "seq", "quality", milli(F.col("progress_m")).alias("progress_mm"), milli(F.col("snap_m")).alias("snap_mm"), "advancing")


def q_winding_status(spark, d):
    """Which attempts on the winding path count, and why not; attempts without samples lack telemetry, those on no route are left out."""
    s, c = traces.winding_samples(spark, d), traces.winding_courses(spark, d)
    k = F.col("n_nationkey").cast("long")
    bare = spark.read.parquet(f"{d}/nation.parquet").select(F.concat(F.lit("bare"), k.cast("string")).alias("attempt_id"), (k % 5).cast("string").alias("route_id"), k.alias("armed_at_ms"), F.lit("completed").alias("lifecycle"), F.lit(None).cast("double").alias("recorded_finished_at_ms"))
    attempts = traces.synthetic_attempts(s).unionByName(bare)
    status = ranking.attempt_status(attempts, timing.replay(staged(matching.match_samples(s, c), "winding"), c), c)
    return status.select("attempt_id", "route_id", "eligible", "reason", milli(F.col("started_at")).alias("started_us"), milli(F.col("finished_at")).alias("finished_us"))


def q_match(spark, d):
    return analysis(spark, d).matched.select("attempt_id", "seq", "quality", milli(F.col("progress_m")).alias("progress_mm"), milli(F.col("snap_m")).alias("snap_mm"), "advancing")


def q_attempt_status(spark, d):
    a = analysis(spark, d)
    replayed = a.runs.select("attempt_id", F.col("lifecycle").alias("replayed"), "validity")
    return a.status.join(replayed, "attempt_id").select("attempt_id", "route_id", "replayed", "validity", "eligible", "reason", milli(F.col("started_at")).alias("started_us"), milli(F.col("finished_at")).alias("finished_us"))


def q_replay(spark, d):
    return analysis(spark, d).runs.select("attempt_id", "lifecycle", "validity", milli(F.col("started_at")).alias("started_us"), milli(F.col("finished_at")).alias("finished_us"))


def q_live(spark, d):
    """The same runs as they come in, in three parts with state kept between: attempts, the sessions that their ends stop, and crossings, as committed."""
    s, c = traces.synthetic_samples(spark, d), traces.synthetic_courses(spark, d)
    place = Window.partitionBy("attempt_id").orderBy("recorded_at_ms", "id")
    s = staged(s.withColumn("part", F.least(F.lit(2), F.floor(F.row_number().over(place) / 40))), "live-input")
    of = s.groupBy("attempt_id", "route_id").agg(F.min("recorded_at_ms").alias("armed_at_ms")).withColumn("session_id", F.concat(F.lit("s"), "attempt_id"))
    places = max(4, min(int(spark.conf.get("spark.sql.shuffle.partitions")), of.count() // 1000))  # of a thousand attempts each
    folder = staging_folder(spark, "live")
    for part in range(3):
        s.filter(F.col("part") == part).drop("part", "session_id").repartition(places, "attempt_id").write.mode("append").parquet(f"{folder}/in")
    store = keyed.started(spark, f"{folder}/tables")
    null = F.lit(None)
    attempts = of.withColumns({"lifecycle": F.lit("armed"), "validity": F.lit("pending"), "started_at": null.cast("double"), "finished_at": null.cast("double"), "result_acknowledged": F.lit(False)})
    opened = of.select(F.col("session_id").alias("id"), F.col("armed_at_ms").alias("started_at_ms"), null.cast("long").alias("stopped_at_ms"), F.lit(True).alias("is_active"), F.lit("attempt").alias("purpose"), F.lit("active").alias("capture_outcome"), F.lit("pending").alias("review_disposition"))
    store.commit({"attempts": attempts, "sessions": opened})
    keyed.keep_live(live.read_fixes(spark, f"{folder}/in", places), c, store, f"{folder}/checkpoint", clock=lambda: 1, partitions=places).awaitTermination()
    us = lambda x: milli(F.col(x))
    rows = store.read("attempts").select(F.lit("attempt").alias("kind"), "attempt_id", F.col("lifecycle").alias("a"), F.col("validity").alias("b"), us("started_at").alias("first_us"), us("finished_at").alias("last_us"))
    rows = rows.union(store.read("sessions").select(F.lit("session"), F.col("id").substr(2, 99), "capture_outcome", "review_disposition", F.col("stopped_at_ms"), F.when(F.col("is_active"), 0).cast("long")))
    return rows.union(store.read("crossings").select(F.lit("crossing"), "attempt_id", "checkpoint_id", "id", us("crossed_at"), F.lit(None).cast("long")))


def q_start_zone(spark, d):
    a = analysis(spark, d)
    return timing.start_zone_status(a.attempts, a.matched, a.courses, a.runs)


def q_crossings(spark, d):
    return analysis(spark, d).crossings.select("attempt_id", "checkpoint_id", milli(F.col("crossed_at")).alias("crossed_us"))


def q_rank_pb(spark, d):
    return analysis(spark, d).ranked.select("route_id", "attempt_id", milli(F.col("official_ms")).alias("official_us"), "rank", "is_pb", "target_id", milli(F.col("delta_pb_ms")).alias("delta_pb_us"), milli(F.col("delta_previous_ms")).alias("delta_previous_us"), "pb_before_id")


def q_focus(spark, d):
    us = lambda c: milli(F.col(f"{c}_ms")).alias(f"{c}_us")
    return analysis(spark, d).focus.select("attempt_id", "reason", "rank", "is_pb", "previous_id", us("delta_previous"), us("pb_before"), "target_id", us("delta_pb"))


def q_focus_named(spark, d):
    """Orders as attempts that tie in all but their ids, which differ in case and accents."""
    k = F.col("o_orderkey").cast("long")
    letters = F.array(*[F.lit(c) for c in ("e", "E", "é", "É", "z", "Z", "a", "ä")])
    name = F.concat(F.get(letters, (k % 8).cast("int")), F.lit("-"), F.floor(k / 8).cast("string"))
    own = {"attempt_id": name, "route_id": (F.col("o_custkey") % 5).cast("string"), "armed_at_ms": k % 3 * 1000, "eligible": k % 6 != 5, "reason": F.when(k % 6 == 5, "not_completed")}
    a = spark.read.parquet(f"{d}/orders.parquet").select(*[c.alias(n) for n, c in own.items()], (k % 4 * 1000 + 60_000).cast("double").alias("official"))
    started = (F.col("armed_at_ms") + 500).cast("double")
    times = {"started_at": started, "finished_at": started + F.col("official"), "official_ms": F.col("official")}
    focus = ranking.focused(a.withColumns({n: F.when(F.col("eligible"), c) for n, c in times.items()}).drop("official"))
    return focus.select("route_id", "attempt_id", "rank", "is_pb", "previous_id", "pb_before_id", "target_id")


def q_focus_segments(spark, d):
    return analysis(spark, d).focus_segments.select("attempt_id", "seg", "segment_id", *[milli(F.col(f"{c}_ms")).alias(f"{c}_us") for c in ("duration", "target", "delta", "gold")])


def q_report(spark, d):
    r = analysis(spark, d).report
    n = lambda c: F.greatest(F.lit(0), F.coalesce(F.size(c), F.lit(0)))
    golds = F.size(F.filter("segments", lambda x: x["is_new_gold"]))
    return r.select("attempt_id", "rank", n("segments").alias("segments"), golds.alias("golds"), n("waits").alias("waits"), n("places").alias("places"), text.stop_count(n("waits")).alias("stops"), F.col("waiting.reason").alias("waiting_reason"), F.col("ghost.reason").alias("ghost_reason"), text.delta_tone(F.col("delta_pb_ms")).alias("tone"))


def q_route_summary(spark, d):
    a = analysis(spark, d)
    return ranking.route_summary(a.status, a.courses, a.segments).select("route_id", F.col("ranked").cast("long").alias("ranked"), "pb_id", milli(F.col("pb_ms")).alias("pb_us"), "last_id", milli(F.col("sum_of_best_ms")).alias("sum_of_best_us"))


def q_segments(spark, d):
    return analysis(spark, d).segments.select("attempt_id", "seg", "segment_id", milli(F.col("duration_ms")).alias("duration_us"))


def q_segment_deltas(spark, d):
    a = analysis(spark, d)
    return ranking.segment_deltas(a.segments, a.ranked).select("attempt_id", "seg", milli(F.col("delta_ms")).alias("delta_us"), "is_new_gold")


def q_history(spark, d):
    a = analysis(spark, d)
    meta = text.history_meta(F.col("eligible"), F.col("official_ms"), F.col("is_pb"), F.col("rank"))
    return ranking.history(a.status, a.ranked).select("route_id", "attempt_id", "place", "rank", "is_pb", "eligible", "reason", meta.alias("meta"))


def q_move_intervals(spark, d):
    return analysis(spark, d).intervals.select("attempt_id", "n", "label", milli(F.col("end_ms") - F.col("start_ms")).alias("duration_us"))


def q_move_breakdown(spark, d):
    m = analysis(spark, d).breakdown
    share = text.waiting_share(F.col("waiting_ms"), F.col("official_ms"))
    return m.join(movement.reconciles(m), "attempt_id").select("attempt_id", *[milli(F.col(f"{c}_ms")).alias(f"{c}_us") for c in ("official", "moving", "waiting", "unknown")], "trust", "reconciles", "displayable", share.alias("waiting_share"))


def q_wait_events(spark, d):
    return analysis(spark, d).waits.select("attempt_id", milli(F.col("start_ms")).alias("start_us"), milli(F.col("end_ms")).alias("end_us"), milli(F.col("duration_ms")).alias("duration_us"), milli(F.col("progress_m")).alias("progress_mm"), "located", e7("latitude").alias("lat_e7"))


def _middle(rows: DataFrame) -> DataFrame:
    """A tap between an attempt's places."""
    return rows.filter("latitude is not null").groupBy("attempt_id").agg(F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude")).withColumn("point_id", F.lit("middle"))


def q_nearest_wait(spark, d):
    a = analysis(spark, d)
    near = movement.nearest_wait(a.waits, _middle(a.waits)).join(a.waits.select("attempt_id", "wait_id", "start_ms"), ["attempt_id", "wait_id"])
    return near.select("attempt_id", milli(F.col("start_ms")).alias("start_us"), milli(F.col("meters")).alias("mm"))


def q_wait_clusters(spark, d):
    us = lambda c: milli(F.col(f"{c}_ms")).alias(f"{c}_us")
    return analysis(spark, d).clusters.select("attempt_id", "cluster", milli(F.col("progress_m")).alias("progress_mm"), us("current"), us("reference"), us("delta"), milli(F.col("span_m")).alias("span_mm"), "members", "shown", "match_state", e7("latitude").alias("lat_e7"))


def q_nearest_location(spark, d):
    c = analysis(spark, d).clusters
    return comparing.nearest_location(c, _middle(c)).select("attempt_id", "cluster", milli(F.col("meters")).alias("mm"))


def q_wait_comparison(spark, d):
    c = analysis(spark, d).comparison
    sums = [milli(F.col(f"{x}_ms")).alias(f"{x}_us") for x in ("waiting", "reference", "delta", "placed", "reference_placed", "unlocated", "reference_unlocated", "short", "reference_short", "shown_delta", "hidden_delta")]
    return c.select("attempt_id", "target_id", "reason", text.named(F.col("reason"), labels.UNAVAILABLE_WAITING).alias("says"), *sums)


def q_ghost_knots(spark, d):
    return analysis(spark, d).knots.select("attempt_id", "n", "kind", milli(F.col("elapsed_ms")).alias("elapsed_us"), milli(F.col("progress_m")).alias("progress_mm"))


def q_ghost_legs(spark, d):
    return analysis(spark, d).legs.select("attempt_id", "n", "good", "stall")


def q_stall_runs(spark, d):
    return ghost.stalls(analysis(spark, d).legs).select("attempt_id", milli(F.col("e0")).alias("start_us"), milli(F.col("e1")).alias("end_us"), milli(F.col("lo")).alias("low_mm"), milli(F.col("hi")).alias("high_mm"))


def q_painted_finish(spark, d):
    return analysis(spark, d).painted.select("attempt_id", milli(F.col("painted_ms")).alias("painted_us"))


def _ghost_rows(rows: DataFrame, *more: Column) -> DataFrame:
    return rows.select("attempt_id", "source", milli(F.col("progress_m")).alias("progress_mm"), milli(F.col("current_ms")).alias("current_us"), milli(F.col("reference_ms")).alias("reference_us"), *more).distinct()


def q_ghost_delta(spark, d):
    return _ghost_rows(analysis(spark, d).ghosts, milli(F.col("delta_ms")).alias("delta_us"), F.col("good"))


def q_ghost_near(spark, d):
    return _ghost_rows(ghost.near_progress(analysis(spark, d).ghosts, 150.0))


def q_ghost_reasons(spark, d):
    g = analysis(spark, d).ghost_availability
    us = lambda c: milli(F.col(f"{c}_ms")).alias(f"{c}_us")
    return g.select("attempt_id", "target_id", "reason", text.named(F.col("reason"), labels.UNAVAILABLE_GHOST).alias("says"), us("trigger_delta"), us("painted"), us("reference_painted"))


def q_ghost_order(spark, d):
    a = analysis(spark, d)
    return ghost.ordered(a.ghosts, a.courses, a.ranked).select("attempt_id", "place", "source", milli(F.col("progress_m")).alias("progress_mm"), milli(F.col("current_ms")).alias("current_us"), e7("latitude").alias("lat_e7"))


def q_route_geometry(spark, d):
    r = routes.derive_routes(traces.synthetic_samples(spark, d))
    return r.select("session_id", "saveable", "reason", F.size("path").alias("points"), milli(F.col("distance_m")).alias("distance_mm"), e7("start_zone.latitude").alias("start_e7"), e7("finish_zone.latitude").alias("finish_e7"))


def _layouts(spark: SparkSession, d: str) -> DataFrame:
    """Made-up layouts, a third of them faulty."""
    n = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("long").alias("c"))
    c, k = F.col("c"), F.col("c") % 25
    mark = lambda i, name, p: F.struct(F.lit(i).alias("id"), name.alias("name"), p.cast("double").alias("progress_m"))
    return n.select(
        c.cast("string").alias("route_id"), (5.0 * k + 0.0625).alias("start_p"), (100.0 + 7 * k + (c % 1000) / 1e4).alias("finish_p"), F.when(c % 6 == 0, 5.0).when(c % 6 == 1, float("nan")).otherwise(30.0).alias("start_r"), F.when(c % 7 == 3, 251.0).otherwise(20.0).alias("finish_r"),
        F.array(mark("b", F.when(c % 8 == 2, "  ").otherwise("B"), F.lit(90.0)), mark("a", F.lit("A"), 60.5 + k)).alias("checkpoints"),
    )


def q_layouts(spark, d):
    """Problems and identities of made-up layouts."""
    made = _layouts(spark, d)
    return routes.layout_problem(made).join(routes.layout_identity(made), "route_id")


def q_arming(spark, d):
    """Why runs on made-up layouts can't be armed: while a session records, while one is undecided, while an attempt is open, and with nothing in the way."""
    c = F.col("route_id").cast("long")
    made = _layouts(spark, d)
    courses = made.withColumn("path", F.array_repeat(F.struct(F.lit(1.0).alias("latitude"), F.lit(2.0).alias("longitude")), (c % 4).cast("int")))
    still = _sessions(spark, d).withColumn("is_active", F.lit(False))
    decided = still.withColumn("review_disposition", F.lit("saved"))
    a = _attempts(spark, d)
    ended = a.withColumn("lifecycle", F.lit("completed"))
    times = {"recording": (_sessions(spark, d), a), "undecided": (still, a), "open": (decided, a), "free": (decided, ended)}
    out = None
    for kind, (s, t) in times.items():
        rows = sessions.arming_problem(courses, routes.layout_problem(made), s, t).select(F.lit(kind).alias("kind"), "route_id", "reason")
        out = rows if out is None else out.union(rows)
    return out


def q_saved_routes(spark, d):
    """Undecided recordings saved as routes, under names of which some are blank; one that is stored already isn't stored again."""
    derived = routes.derive_routes(traces.synthetic_samples(spark, d))
    k = F.col("c_custkey").cast("long")
    own = {"session_id": k.cast("string"), "route_id": F.concat(F.lit("n"), k.cast("string")), "name": F.when(k % 5 == 0, "  ").otherwise(F.concat(F.lit("  Way "), k.cast("string"), F.lit(" "))), "transportation_mode": F.lit("bike"), "created_at_ms": k}
    names = spark.read.parquet(f"{d}/customer.parquet").select(*[c.alias(n) for n, c in own.items()])
    s = _sessions(spark, d).withColumns({"purpose": F.lit("route_creation"), "capture_outcome": F.when(F.col("id").cast("long") % 7 == 0, "cancelled").otherwise("finished")})
    saved = sessions.saved_routes(derived, s, names)
    there = saved.filter(F.col("source_recording_id").cast("long") % 3 == 0).withColumns({"route_id": F.concat(F.lit("old"), "route_id"), "name": F.lit("Old")})
    after = sessions.create_routes(there, saved)
    return after.select("route_id", "name", "source_recording_id", F.size("path").alias("points"), milli(F.col("finish_p")).alias("finish_mm"), e7("start_zone.latitude").alias("start_e7"))


def q_route_lookup(spark, d):
    """One route with its suppliers as points."""
    n = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("string").alias("route_id"))
    points = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_nationkey").cast("string").alias("route_id"), F.col("s_suppkey").cast("int").alias("seq"), F.col("s_suppkey").cast("double").alias("latitude"), F.lit(0.0).alias("longitude"))
    none = n.filter("false").select("route_id", F.lit("").alias("id"), F.lit("").alias("name"), F.lit(0.0).alias("progress_m"))
    return sessions.routes_with_children(sessions.route_of(n, "3"), points, none).select("route_id", F.coalesce(F.array_size("path"), F.lit(0)).cast("long").alias("points"), F.size("checkpoints").alias("checkpoints"))


def q_tones(spark, d):
    """What colours and counts say beside a time, for each order."""
    k = F.col("o_orderkey").cast("long")
    delta = F.when(k % 11 != 0, (k % 7 - 3) * 500)
    official = F.when(k % 13 != 0, k % 9000 * 1000)
    meta = text.history_meta(k % 5 != 0, official, k % 4 == 0, F.when(k % 3 != 0, k % 120 + 1))
    return spark.read.parquet(f"{d}/orders.parquet").select(k.alias("k"), text.delta_tone(delta).alias("tone"), text.comparison_tone(delta).alias("waits"), text.stop_count(k % 4).alias("stops"), meta.alias("meta"))


def q_course_geojson(spark, d):
    """The features of each course's GeoJSON, read back: number (0 for waits), kind, type, how many points, the first one's latitude."""
    a = analysis(spark, d)
    waits = a.waits.join(a.ranked.filter("is_pb").select("attempt_id"), "attempt_id").select("route_id", "wait_id", "latitude", "longitude")
    schema = "struct<features:array<struct<properties:struct<kind:string>,geometry:struct<type:string,coordinates:string>>>>"
    rows = traces.course_geojson(a.courses, waits).select("route_id", F.posexplode(F.from_json("geojson", schema)["features"]).alias("n", "f")).select("route_id", "n", "f.properties.kind", "f.geometry.type", "f.geometry.coordinates")
    read = lambda kind: F.from_json("coordinates", kind)
    line = F.when(F.col("type") == "Point", F.array(read("array<double>"))).when(F.col("type") == "LineString", read("array<array<double>>")).otherwise(read("array<array<array<double>>>")[0])
    rows = rows.withColumn("line", line)
    return rows.select("route_id", F.when(F.col("kind") == "wait", 0).otherwise(F.col("n") + 1).alias("n"), "kind", "type", F.size("line").alias("points"), e7(F.col("line")[0][1]).alias("lat_e7"))


def q_format(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("long").alias("k"))
    k = F.col("k")
    of = lambda names: F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))
    mode = of(("scooter", "bike", "run", "walk", "skate"))
    at, shown = F.lit(traces.BASE_MS) + k * 98765, F.when(k % 9 != 0, k % 200 * 1000)
    typed = F.when(k % 6 == 0, " 12,5 ").when(k % 6 == 1, "8").when(k % 6 == 2, k.cast("string")).when(k % 6 == 3, "ten").when(k % 6 == 4, "30f").otherwise("1.6e2")
    return o.select(
        "k", text.elapsed(k * 997 - 5000).alias("elapsed"), text.signed_delta((k % 9000 - 4500) * 1000).alias("delta"), text.ordinal(k).alias("ordinal"), text.rank_among(k, k + 3).alias("among"), text.percent((k % 1500) / 1000.0).alias("share"),
        text.wait_duration(k * 10).alias("wait"), text.wait_delta((k % 5000 - 2500) * 7).alias("wait_delta"), text.time_of_day(at).alias("clock"), text.attempt_stamp(at).alias("stamp"), text.fix_age(k * 1300 - 50_000 - (k * 1300 - 50_000) % 100).alias("age"),
        text.fix_health(shown).alias("health"), text.into_route((k % 9000).cast("double")).alias("into_route"), text.mode_label(mode).alias("mode"), text.mode_icon(mode).alias("icon"),
        text.named(of(("missing_start_coverage", "missing_telemetry", "replay_incomplete", "not_valid", "not_completed", "none")), labels.UNRANKED).alias("says"), text.endpoint_label(of(("start", "finish", "checkpoint")), F.lit("Bridge")).alias("endpoint"),
        text.radius_input(typed).alias("radius"), text.unranked_warning(of(("armed", "active", "completed", "cancelled", "abandoned")), F.when(k % 3 == 0, "unranked").otherwise("valid"), k % 2 == 0).alias("warns"),
    )


def q_attempt_lookups(spark, d):
    a = _attempts(spark, d)
    found = {"open": sessions.open_attempt(a), "result": sessions.unacknowledged_result(a), "of_id": sessions.attempt_of(a, "7"), "of_session": sessions.attempt_of(a, session_id="10"), "of_route": sessions.attempts_of(a, "3")}
    out = None
    for kind, rows in found.items():
        rows = rows.select(F.lit(kind).alias("kind"), "attempt_id", "armed_at_ms")
        out = rows if out is None else out.union(rows)
    return out


def q_attempt_crossings(spark, d):
    rows = sessions.with_crossings(_attempts(spark, d), _crossings(spark, d))
    return rows.select("attempt_id", F.array_join(F.transform("crossings", lambda x: x["checkpoint_id"]), ",").alias("crossings"))


def q_finalize(spark, d):
    """Some attempts end as unranked, each the only one of its session, with one crossing instead of those it had."""
    a, s, c = _attempts(spark, d), _sessions(spark, d), _crossings(spark, d)
    ending = a.filter(F.col("attempt_id").cast("long") % 9 == 0)
    single = ending.groupBy("session_id").count().filter("count = 1").select("session_id")
    ended = ending.join(single, "session_id").withColumns({"validity": F.lit("unranked"), "stopped_at_ms": F.lit(1).cast("long")})
    new = ended.select("attempt_id", F.lit("new").alias("checkpoint_id"), F.lit("x").alias("name"), F.lit(0.0).alias("progress_m"), F.lit(1.0).alias("crossed_at"))
    t = sessions.finalize_attempts(a, s, c, ended, new)
    rows = t["sessions"].select(F.lit("session").alias("kind"), "id", F.col("is_active").alias("flag"), F.col("capture_outcome").alias("state"), F.col("review_disposition").alias("more"))
    rows = rows.union(t["attempts"].select(F.lit("attempt"), "attempt_id", "result_acknowledged", "lifecycle", "validity"))
    return rows.union(t["crossings"].select(F.lit("crossing"), "attempt_id", F.lit(True), "checkpoint_id", F.col("crossed_at").cast("long").cast("string")))


def q_acknowledge(spark, d):
    a = _attempts(spark, d)
    return sessions.acknowledge_results(a, a.filter(F.col("attempt_id").cast("long") % 6 == 0)).select("attempt_id", "result_acknowledged")


def q_routes(spark, d):
    """Nations as routes with suppliers as points and parts as checkpoints, in the order of each."""
    n = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("string").alias("route_id"))
    points = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_nationkey").cast("string").alias("route_id"), F.col("s_suppkey").cast("int").alias("seq"), F.col("s_suppkey").cast("double").alias("latitude"), F.lit(0.0).alias("longitude"))
    parts = spark.read.parquet(f"{d}/part.parquet")
    marks = parts.select((F.col("p_partkey") % 25).cast("string").alias("route_id"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.lit("x").alias("name"), (F.col("p_retailprice") * 1e9 + F.col("p_partkey")).cast("double").alias("progress_m"))
    r = sessions.routes_with_children(n, points, marks)
    return r.select("route_id", F.greatest(F.lit(0), F.coalesce(F.size("path"), F.lit(0))).cast("long").alias("points"), F.array_join(F.transform(F.coalesce("path", F.array().cast("array<struct<latitude:double,longitude:double>>")), lambda p: p["latitude"].cast("long").cast("string")), ",").alias("sequence"), F.array_join(F.transform("checkpoints", lambda x: x["id"]), ",").alias("checkpoints"))


def q_create_routes(spark, d):
    k = F.col("n_nationkey").cast("long")
    n = spark.read.parquet(f"{d}/nation.parquet")
    there = n.filter("n_nationkey < 12").select(k.cast("string").alias("route_id"), F.when(k % 8 != 0, (k % 10).cast("string")).alias("source_recording_id"))
    wanted = n.select(F.concat(F.lit("w"), F.lpad(k.cast("string"), 2, "0")).alias("route_id"), F.when(k % 5 != 0, (k % 20).cast("string")).alias("source_recording_id"))
    return sessions.create_routes(there, wanted).select("route_id", F.col("source_recording_id").alias("rec"))


def q_replace_layouts(spark, d):
    k = F.col("n_nationkey").cast("long")
    names = [k.cast("string").alias("route_id"), *[F.lit(30.0 if c.endswith("_r") else 0.0).alias(c) for c in sessions.LAYOUT]]
    n = spark.read.parquet(f"{d}/nation.parquet")
    r, new = n.select(names), n.filter(k % 3 == 0).select(names).withColumns({"start_r": F.lit(20.0), "start_p": F.lit(7.0)})
    new = new.union(n.filter("n_nationkey = 1").select(names).withColumn("route_id", F.lit("nowhere")))
    mark = lambda rows, i: rows.select("route_id", F.lit(i).alias("id"), F.lit("c").alias("name"), F.lit(1.0).alias("progress_m"))
    after, marks = sessions.replace_layouts(r, mark(r, "old"), new, mark(new, "new"))
    rows = after.select(F.lit("route").alias("kind"), "route_id", F.col("start_r").cast("string").alias("a"), F.col("start_p").cast("string").alias("b"))
    return rows.union(marks.select(F.lit("checkpoint"), "route_id", "id", "name"))


def q_delete_routes(spark, d):
    r = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("string").alias("route_id"))
    points = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_nationkey").cast("string").alias("route_id"), F.col("s_suppkey").cast("string").alias("id"))
    left = sessions.delete_routes(r, r.filter(F.col("route_id").cast("long") % 4 == 1), points=points)
    return left["routes"].select(F.lit("route").alias("kind"), F.col("route_id").alias("id")).union(left["points"].select(F.lit("point"), "id"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: f for n, f in list(globals().items()) if n.startswith("q_")}
ORACLES: dict[str, str] = oracles.ORACLES
