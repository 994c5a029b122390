"""Sessions, attempts and routes as tables: lookups, top rows, upserts and cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, ENDED = ("armed", "active"), ("cancelled", "abandoned")


def with_last_sample(sessions: DataFrame, samples: DataFrame) -> DataFrame:
    """Sessions with the time of their latest sample, null where there is none."""
    last = samples.groupBy(F.col("session_id").alias("id")).agg(F.max("recorded_at_ms").alias("last_sample_at_ms"))
    return sessions.join(last, "id", "left")


def active_session(sessions: DataFrame) -> DataFrame:
    return sessions.filter("is_active").orderBy(F.desc("started_at_ms"), F.desc("id")).limit(1)


def latest_session(sessions: DataFrame) -> DataFrame:
    return sessions.orderBy(F.desc("started_at_ms"), F.desc("id")).limit(1)


def is_pending_route(purpose: Column, outcome: Column, disposition: Column) -> Column:
    """A finished or interrupted recording for a new route that nobody has decided on."""
    return (purpose == "route_creation") & outcome.isin("finished", "interrupted") & (disposition == "pending")


def pending_route_creation(sessions: DataFrame) -> DataFrame:
    pending = is_pending_route(F.col("purpose"), F.col("capture_outcome"), F.col("review_disposition"))
    return sessions.filter(pending).orderBy(F.desc("started_at_ms"), F.desc("id")).limit(1)


def session_of(sessions: DataFrame, session_id: str) -> DataFrame:
    return sessions.filter(F.col("id") == session_id)


def sample_count(samples: DataFrame, session_id: str) -> int:
    return samples.filter(F.col("session_id") == session_id).count()


def samples_of(samples: DataFrame, session_id: str) -> DataFrame:
    """A session's samples in order of time, then id."""
    return samples.filter(F.col("session_id") == session_id).orderBy("recorded_at_ms", "id")


def open_attempt(attempts: DataFrame) -> DataFrame:
    return attempts.filter(F.col("lifecycle").isin(*OPEN)).orderBy(F.desc("armed_at_ms"), F.desc("attempt_id")).limit(1)


def unacknowledged_result(attempts: DataFrame) -> DataFrame:
    return attempts.filter(~F.col("result_acknowledged") & ~F.col("lifecycle").isin(*OPEN)).orderBy(F.desc("armed_at_ms"), F.desc("attempt_id")).limit(1)


def attempts_of(attempts: DataFrame, route_id: str) -> DataFrame:
    return attempts.filter(F.col("route_id") == route_id).orderBy(F.desc("armed_at_ms"), F.desc("attempt_id"))


def updated(table: DataFrame, changes: DataFrame, key: str, columns: dict[str, Column]) -> DataFrame:
    """The table with ``columns``, in terms of the changes' own, set where a change has the row's key; of changes with one key, the first by its columns counts."""
    new = changes.select(key, F.struct(*[c.alias(n) for n, c in columns.items()]).alias("_new")).groupBy(key).agg(F.min("_new").alias("_new"))
    return table.join(new, key, "left").withColumns({n: F.when(F.col("_new").isNotNull(), F.col(f"_new.{n}")).otherwise(F.col(n)) for n in columns}).select(table.columns)


def start_session(sessions: DataFrame, wanted: DataFrame) -> DataFrame:
    """Sessions plus the first wanted one (id, started_at_ms, purpose), if none is active."""
    if sessions.filter("is_active").limit(1).count():
        return sessions
    one = wanted.orderBy("started_at_ms", "id").limit(1)
    new = one.withColumns({"is_active": F.lit(True), "capture_outcome": F.lit("active"), "review_disposition": F.lit("pending")})
    return sessions.unionByName(new.select([c for c in sessions.columns if c in new.columns]), allowMissingColumns=True)


def complete_sessions(sessions: DataFrame, ended: DataFrame) -> DataFrame:
    """Sessions after some ended: (id, stopped_at_ms, capture_outcome, review_disposition)."""
    names = ("stopped_at_ms", "capture_outcome", "review_disposition")
    return updated(sessions, ended, "id", {"is_active": F.lit(False), **{c: F.col(c) for c in names}})


def decide_reviews(sessions: DataFrame, decided: DataFrame) -> DataFrame:
    """Sessions after decisions: (id, review_disposition)."""
    return updated(sessions, decided, "id", {"review_disposition": F.col("review_disposition")})


def close_legacy(sessions: DataFrame, now_ms: int) -> DataFrame:
    """Sessions as an upgrade leaves them: those still active are stopped, of unknown outcome and discarded."""
    was = F.col("is_active")
    new = {"stopped_at_ms": F.coalesce("stopped_at_ms", F.lit(now_ms)), "purpose": F.lit("legacy"), "capture_outcome": F.lit("unknown"), "review_disposition": F.lit("discarded")}
    return sessions.withColumns({c: F.when(was, v).otherwise(F.col(c)) for c, v in new.items()}).withColumn("is_active", F.lit(False))


def with_crossings(attempts: DataFrame, crossings: DataFrame) -> DataFrame:
    """Attempts with their crossings as an array, by time and then progress."""
    x = F.struct("crossed_at", "progress_m", "checkpoint_id", "name")
    own = crossings.groupBy("attempt_id").agg(F.sort_array(F.collect_list(x)).alias("crossings"))
    none = F.array().cast("array<struct<crossed_at:double,progress_m:double,checkpoint_id:string,name:string>>")
    return attempts.join(own, "attempt_id", "left").withColumn("crossings", F.coalesce("crossings", none))


def attempt_of(attempts: DataFrame, attempt_id: str | None = None, session_id: str | None = None) -> DataFrame:
    """The attempt with an id, or that of a session."""
    return attempts.filter(F.col("attempt_id") == attempt_id if attempt_id is not None else F.col("session_id") == session_id)


def has_open_attempt(attempts: DataFrame) -> bool:
    return attempts.filter(F.col("lifecycle").isin(*OPEN)).limit(1).count() > 0


def route_of(routes: DataFrame, route_id: str) -> DataFrame:
    return routes.filter(F.col("route_id") == route_id)


def routes_with_children(routes: DataFrame, points: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Routes with their path and checkpoints as arrays in order, instead of a lookup for each route."""
    path = points.groupBy("route_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "latitude", "longitude"))), lambda x: F.struct(x["latitude"].alias("latitude"), x["longitude"].alias("longitude"))).alias("path"))
    marks = checkpoints.groupBy("route_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("progress_m", "id", "name"))), lambda x: F.struct(x["id"].alias("id"), x["name"].alias("name"), x["progress_m"].alias("progress_m"))).alias("checkpoints"))
    return routes.join(path, "route_id", "left").join(marks, "route_id", "left").withColumn("checkpoints", F.coalesce("checkpoints", F.array().cast("array<struct<id:string,name:string,progress_m:double>>")))


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], order: list[str], frozen: tuple[str, ...] = ()) -> DataFrame:
    """The table after the changes: the last change to a key wins, ``frozen`` columns keep their old values."""
    last = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    new = changes.withColumn("_n", F.row_number().over(last)).filter("_n = 1").select(table.columns)
    kept = table.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in frozen], F.lit(True).alias("_was"))
    new = new.join(kept, keys, "left")
    new = new.withColumns({c: F.when(F.col("_was"), F.col(f"_old_{c}")).otherwise(F.col(c)) for c in frozen}).select(table.columns)
    return table.join(new.select(*keys), keys, "left_anti").select(table.columns).unionByName(new)


def write_attempts(attempts: DataFrame, crossings: DataFrame, changes: DataFrame, new_crossings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables after attempts are saved: where, when and on which route one was armed stays; its crossings are replaced by the new ones, if any."""
    after = upsert(attempts, changes, ["attempt_id"], ["armed_at_ms"], frozen=("route_id", "session_id", "armed_at_ms"))
    keys = changes.select("attempt_id").distinct()
    return after, crossings.join(keys, "attempt_id", "left_anti").select(crossings.columns).unionByName(new_crossings.join(keys, "attempt_id", "left_semi").select(crossings.columns))


def finalize_attempts(attempts: DataFrame, sessions: DataFrame, crossings: DataFrame, ended: DataFrame, new_crossings: DataFrame) -> dict[str, DataFrame]:
    """Attempts, sessions and crossings after attempts end: each is saved, and its session stops.

    ``ended``: attempts with stopped_at_ms besides.  A completed attempt's session counts as
    finished and saved, a cancelled one's as cancelled, any other's as interrupted, both discarded.
    """
    after, marks = write_attempts(attempts, crossings, ended.select(attempts.columns), new_crossings)
    life = F.col("lifecycle")
    outcome = F.when(life == "completed", "finished").when(life == "cancelled", "cancelled").otherwise("interrupted")
    stop = ended.select(F.col("session_id").alias("id"), "stopped_at_ms", outcome.alias("capture_outcome"), F.when(life == "completed", "saved").otherwise("discarded").alias("review_disposition"))
    return {"attempts": after, "sessions": complete_sessions(sessions, stop), "crossings": marks}


def acknowledge_results(attempts: DataFrame, seen: DataFrame) -> DataFrame:
    """Attempts with result_acknowledged set for those in ``seen``."""
    ids = seen.select("attempt_id").distinct().withColumn("_seen", F.lit(True))
    return attempts.join(ids, "attempt_id", "left").withColumn("result_acknowledged", F.col("result_acknowledged") | F.coalesce("_seen", F.lit(False))).select(attempts.columns)


LAYOUT = ("start_lat", "start_lon", "start_r", "finish_lat", "finish_lon", "finish_r", "start_p", "finish_p")


def replace_layouts(routes: DataFrame, checkpoints: DataFrame, layouts: DataFrame, new_checkpoints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Routes and checkpoints after new layouts: zones, start and finish are the layout's, and a route's checkpoints are replaced.

    Layouts of routes that don't exist change nothing.
    """
    known = layouts.join(routes.select("route_id"), "route_id", "left_semi").dropDuplicates(["route_id"])
    change = known.select("route_id", *[F.col(c).alias(f"_{c}") for c in LAYOUT], F.lit(True).alias("_new"))
    r = routes.join(change, "route_id", "left").withColumns({c: F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)) for c in LAYOUT}).select(routes.columns)
    kept = checkpoints.join(known, "route_id", "left_anti").select(checkpoints.columns)
    return r, kept.unionByName(new_checkpoints.join(known, "route_id", "left_semi").select(checkpoints.columns))


def arming_problem(routes: DataFrame, problems: DataFrame, sessions: DataFrame, attempts: DataFrame) -> DataFrame:
    """route_id, reason why a run on it can't be armed, null if it can: the first of a bad layout, a bad course, a recording under way, an undecided recording, an open attempt.

    ``problems``: layout_problem() of the routes.
    """
    taken = F.when(F.lit(sessions.filter("is_active").limit(1).count() > 0), "recording").when(F.lit(pending_route_creation(sessions).count() > 0), "pending_route").when(F.lit(has_open_attempt(attempts)), "open_attempt")
    bad = (F.size("path") < 2) | (F.col("finish_p") <= F.col("start_p"))
    return routes.join(problems, "route_id", "left").select("route_id", F.coalesce(F.col("problem"), F.when(bad, "bad_course"), taken).alias("reason"))


def create_routes(routes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Routes plus the wanted ones whose source recording has none yet, one a recording (the first by id); recordings that are null match each other."""
    key = "source_recording_id"
    first = Window.partitionBy(key).orderBy("route_id")
    one = wanted.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    there = routes.select(F.col(key).alias("_there")).distinct()
    fresh = one.join(there, one[key].eqNullSafe(there["_there"]), "left_anti")
    return routes.unionByName(fresh.select(routes.columns))


def saved_routes(derived: DataFrame, sessions: DataFrame, names: DataFrame) -> DataFrame:
    """Recordings as routes, ready for create_routes(): route_id, name, transportation_mode, created_at_ms, source_recording_id, path, zones, start_p and finish_p.

    ``derived``: derive_routes(); ``names``: session_id, route_id, name, transportation_mode,
    created_at_ms.  Only undecided recordings that can be saved, under a name that isn't blank.
    """
    pending = sessions.filter(is_pending_route(F.col("purpose"), F.col("capture_outcome"), F.col("review_disposition"))).select(F.col("id").alias("session_id"))
    rows = derived.filter("saveable").join(pending, "session_id", "left_semi").join(names.withColumn("name", F.trim("name")).filter("name <> ''"), "session_id")
    return rows.select("route_id", "name", "transportation_mode", "created_at_ms", F.col("session_id").alias("source_recording_id"), "path", "start_zone", "finish_zone", F.lit(0.0).alias("start_p"), F.col("distance_m").alias("finish_p"))


def delete_routes(routes: DataFrame, gone: DataFrame, **children: DataFrame) -> dict[str, DataFrame]:
    """Routes and every child table without the routes that go; samples aren't children and stay."""
    key = gone.select("route_id")
    return {"routes": routes.join(key, "route_id", "left_anti")} | {n: c.join(key, "route_id", "left_anti") for n, c in children.items()}


def recording_elapsed_ms(started: Column, now: Column) -> Column:
    return F.greatest(F.lit(0), now - started)


def review_duration_ms(started: Column, stopped: Column, outcome: Column, last_sample: Column) -> Column:
    """From the start to the stop, or to the last sample of an interrupted recording, at least 0; null while neither is known."""
    until = F.when(outcome == "finished", stopped).when(outcome == "interrupted", last_sample)
    return F.when(until.isNotNull(), F.greatest(F.lit(0), until - started))


def tracking_status(active: Column, outcome: Column) -> Column:
    return F.when(F.coalesce(outcome == "interrupted", F.lit(False)), "interrupted").when(F.coalesce(active & (outcome == "active"), F.lit(False)), "tracking").otherwise("idle")
