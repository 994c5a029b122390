"""Live attempts with keyed state: each attempt's run is carried from batch to batch, not replayed.

What is kept of an attempt is where it stands (lifecycle, times, the last matched progress), the
last five seconds of accepted samples while it waits for its start, and the samples of the
last moments, which may still be overtaken by ones that come out of order.  A batch therefore
costs its new samples and those moments, however long the attempt has lasted.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, fields
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions import constants as K
from ..operators import matching, sessions, timing
from ..sources.staging import staged
from ..sources.store import Store, Table
from ..sources.traces import clean_fixes

#: Points of all courses up to which these are sent to every worker whole; beyond, samples carry their own.  Also how many points of courses a worker remembers.
MOST_POINTS = 1 << 20
#: How long samples may come out of order, in milliseconds of their own time.
LATE_MS = 10_000

SAMPLE = "id string, t long, latitude double, longitude double, accuracy double"
CROSSING = "array<struct<checkpoint_id:string,name:string,progress_m:double,crossed_at:double>>"
LIVE = (
    "attempt_id string, kind string, route_id string, lifecycle string, validity string, started_at double, finished_at double, start_zone string, stale boolean, "
    f"last_t long, samples long, walked long, crossings {CROSSING}, id string, t long, latitude double, longitude double, accuracy double"
)
NAMES = [c.split()[0] for c in LIVE.split(", ")]
#: The same as one column, which is converted at once.
ONE = f"x struct<{','.join(c.replace(' ', ':', 1) for c in LIVE.split(', '))}>"
PACKED = "attempt_id string, route_id string, " + ", ".join(f"{name} array<{kind}>" for name, kind in (c.split() for c in SAMPLE.split(", ")))


@dataclass
class Course:
    """What a run needs of its route."""

    lats: list[float]
    lons: list[float]
    start_p: float
    finish_p: float
    start_r: float
    trigger_p: float
    checkpoints: list[tuple[str, str, float]]  # id, name and progress, in order, between start and finish


@dataclass
class Run:
    """An attempt up to some sample.  Times of None have not come yet."""

    lifecycle: str = "armed"
    validity: str = "pending"
    started_at: float | None = None
    finished_at: float | None = None
    samples: int = 0
    last_t: int | None = None
    matched_p: float | None = None
    was_before: bool = False
    off_since: int | None = None
    off_ms: float = 0.0
    prev_t: int | None = None
    prev_p: float | None = None
    line_at: float | None = None
    trigger_at: float | None = None
    finish_at: float | None = None
    recent: list[tuple[int, float]] = field(default_factory=list)  # accepted in the last five seconds, while armed
    marks: list[tuple[str, str, float, float]] = field(default_factory=list)  # checkpoints crossed; while armed, all that may come to count

    def copy(self) -> Run:
        return Run(**{f.name: list(v) if isinstance(v := getattr(self, f.name), list) else v for f in fields(self)})

    @property
    def open(self) -> bool:
        return self.lifecycle in sessions.OPEN


def _when(line: float, p0: float, t0: float, p1: float, t1: float) -> float:
    """When a line is crossed between two samples."""
    return float(t1) if p1 == p0 else t0 + min(1.0, max(0.0, (line - p0) / (p1 - p0))) * (t1 - t0)


def _marks(run: Run, course: Course, t: int, p: float) -> None:
    """Note the checkpoints that lie between the last accepted sample and this one."""
    have = {m[0] for m in run.marks} if run.started_at is not None else set()
    for key, name, at in course.checkpoints:
        if run.prev_p < at <= p and key not in have:
            crossed = _when(at, run.prev_p, run.prev_t, p, t)
            if run.started_at is None or crossed >= run.started_at:
                run.marks.append((key, name, at, crossed))


def _kept_marks(run: Run, t: int) -> None:
    """Of an armed run's crossings, those that may be the first after its start: the first since the line was last crossed, and the latest ones."""
    seen: set[str] = set()
    kept = []
    for m in run.marks:
        first = run.line_at is not None and m[3] >= run.line_at and m[0] not in seen
        if first:
            seen.add(m[0])
        if first or m[3] >= t - K.DEPARTURE_MS:
            kept.append(m)
    run.marks = kept


def _start(run: Run, course: Course, late: bool) -> float:
    """When a run that departs now has started: at the line, or, where nothing lies before it, when it left its beginning."""
    if late and run.line_at is not None:
        return run.line_at
    behind = [i for i, (_, p) in enumerate(run.recent) if p <= K.START_NOISE_M]
    if behind and behind[-1] + 1 < len(run.recent):
        (t0, p0), (t1, p1) = run.recent[behind[-1] : behind[-1] + 2]
        return _when(min(K.START_NOISE_M, p1), p0, t0, p1, t1)
    return float(run.recent[0][0])


def step(run: Run, course: Course, t: int, quality: str, p: float | None) -> None:
    """Take one matched sample into an open run; an ended one stays as it is."""
    if not run.open:
        return
    before, run.last_t = run.last_t, t
    run.samples += 1
    if quality != "accepted":
        if quality in ("off_course", "out_of_window") and run.lifecycle == "active":
            run.off_since = t if run.off_since is None else run.off_since
            run.off_ms += max(0, t - before) if before is not None else 0
            if t - run.off_since >= K.ABANDON_MS:
                run.lifecycle, run.validity = "abandoned", "unranked"
            elif run.off_ms >= K.DEVIATION_MS:
                run.validity = "unranked"
        return
    run.off_since = None
    late = course.start_p > K.START_NOISE_M
    run.was_before = run.was_before or (late and p < course.start_p - K.PRE_START_M)
    if run.prev_p is not None:
        crosses = lambda line: run.prev_p < line <= p
        at = lambda line: _when(line, run.prev_p, run.prev_t, p, t)
        if run.trigger_at is None and crosses(course.trigger_p):
            run.trigger_at = at(course.trigger_p)
        if crosses(course.finish_p):
            run.finish_at = at(course.finish_p)
        if run.lifecycle == "armed":
            if crosses(course.start_p):
                run.line_at = at(course.start_p)
            if p < course.start_p - K.HYSTERESIS_M:
                run.line_at = None
        _marks(run, course, t, p)
    run.prev_t, run.prev_p = t, p
    if run.lifecycle == "armed":
        run.recent = [x for x in run.recent if x[0] >= t - K.DEPARTURE_MS] + [(t, p)]
        _kept_marks(run, t)
        goes = len(run.recent) >= K.DEPARTURE_SAMPLES and p - run.recent[0][1] >= K.DEPARTURE_M and p >= course.start_p
        zone = course.start_r >= 0 and any(abs(x - course.start_p) <= course.start_r for _, x in run.recent)
        if not (goes and zone and (run.was_before or not late)):
            return
        run.lifecycle, run.started_at = "active", _start(run, course, late)
        first: dict[str, tuple] = {}
        for m in run.marks:
            if m[3] >= run.started_at:
                first.setdefault(m[0], m)
        run.marks, run.recent = list(first.values()), []
    if p >= course.trigger_p:
        end = next((x for x in (run.finish_at, run.trigger_at) if x is not None), float(t))
        if end >= run.started_at:
            run.lifecycle, run.finished_at = "completed", end
            run.validity = "unranked" if run.off_ms >= K.DEVIATION_MS else "valid"


def walk(run: Run, course: Course, samples: list[tuple], follower: matching._Follower) -> None:
    """Match samples (id, t, latitude, longitude, accuracy), in order, and take them in."""
    if not samples or not run.open:
        return
    follower.last = math.nan if run.matched_p is None else run.matched_p
    y, x, accuracy = (np.array([s[i] for s in samples], float) for i in (2, 3, 4))
    for s, (quality, p, _, _) in zip(samples, follower(y, x, np.nan_to_num(accuracy, nan=0.0) > K.MAX_ACCURACY_M), strict=True):
        if not run.open:
            break
        if quality == "accepted":
            run.matched_p = p
        step(run, course, s[1], quality, p)


def zone_status(run: Run, course: Course, last: tuple | None, geometry: matching._Geometry) -> str:
    """Where an armed attempt's latest sample lies to its start zone."""
    if run.lifecycle != "armed" or last is None or (last[4] is not None and last[4] > K.MAX_ACCURACY_M) or not len(geometry.s0):
        return "locating"
    known = run.matched_p is not None
    one = lambda v: np.array([v], float)
    p, far = geometry.near(one(last[2]), one(last[3]), one(run.matched_p if known else course.start_p), one(K.AHEAD_M if known else K.FIRST_AHEAD_M), one(K.BEHIND_M if known else K.FIRST_BEHIND_M))
    inside = far[0] <= K.CORRIDOR_M and course.start_r >= 0 and abs(p[0] - course.start_p) <= course.start_r
    return "inside" if inside else "outside"


RUN_STATE = (
    "lifecycle string, validity string, started_at double, finished_at double, samples long, last_t long, matched_p double, was_before boolean, off_since long, off_ms double, "
    "prev_t long, prev_p double, line_at double, trigger_at double, finish_at double, recent array<struct<t:long,p:double>>, "
    "marks array<struct<checkpoint_id:string,name:string,progress_m:double,crossed_at:double>>, "
    "route_id string, seen_t long, top_t long, heard_at long, timer_at long, held array<struct<id:string,t:long,latitude:double,longitude:double,accuracy:double>>"
)
RUN_FIELDS = [f.name for f in fields(Run)]
SAMPLE_NAMES = [c.split()[0] for c in SAMPLE.split(", ")]


@dataclass
class Kept:
    """All that is kept of an attempt: one value, since each that is asked for or put costs a call between Python and the store."""

    run: Run = field(default_factory=Run)
    route: str | None = None
    seen: int | None = None  # the time that is settled
    top: int | None = None  # the latest time seen
    heard: int | None = None  # when, by the clock, samples last came
    timer: int | None = None  # when the timer that is set runs out
    held: list[tuple] = field(default_factory=list)


class LiveRuns(StatefulProcessor):
    """One attempt's run, its recent samples and crossings, and the samples that others may still overtake.

    Samples are taken in by their own time and id once ``late_ms`` of the attempt's own time has
    passed them; until then they are held, and walked anew each batch on a copy.  A sample older
    than that comes out as a row of kind ``late`` and changes nothing.  Of held samples with one
    id the last counts.  An attempt without new samples for ``stale_ms`` of the clock takes in what
    it holds and comes out once as stale.
    """

    def __init__(self, courses: dict[str, Course] | None, late_ms: int, stale_ms: int):
        self.courses, self.late_ms, self.stale_ms = courses, late_ms, stale_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", RUN_STATE)
        self.row = Row("x")
        self.followers: dict[str | None, tuple[Course, matching._Follower]] = {}
        self.points = 0

    def _loaded(self) -> Kept:
        if not self.state.exists():  # asking for a value that isn't there is logged
            return Kept()
        *values, route, seen, top, heard, timer, held = self.state.get()
        own = dict(zip(RUN_FIELDS, values, strict=True))
        own["recent"], own["marks"] = ([tuple(x) for x in own[n]] for n in ("recent", "marks"))
        return Kept(Run(**own), route, seen, top, heard, timer, [tuple(x) for x in held])

    def _store(self, k: Kept) -> None:
        self.state.update((*(getattr(k.run, n) for n in RUN_FIELDS), k.route, k.seen, k.top, k.heard, k.timer, k.held))

    def _set_timer(self, k: Kept, now: int) -> None:
        """A timer that runs out later is left as it is: when it does, it is told from ``heard`` whether there was silence."""
        k.heard = now
        if k.timer is not None and (k.timer <= now or not k.run.open):
            self.handle.deleteTimer(k.timer)
            k.timer = None
        if k.timer is None and k.run.open:
            k.timer = now + self.stale_ms
            self.handle.registerTimer(k.timer)

    def _row(self, key: str, kind: str, **values) -> Row:
        return self.row({"attempt_id": key, "kind": kind} | values)

    def _state(self, key: str, route: str | None, run: Run, zone: str, stale: bool, walked: int) -> Row:
        marks = [dict(zip(("checkpoint_id", "name", "progress_m", "crossed_at"), m, strict=True)) for m in run.marks] if run.started_at is not None else []
        return self._row(key, "state", route_id=route, lifecycle=run.lifecycle, validity=run.validity, started_at=run.started_at, finished_at=run.finished_at, start_zone=zone, stale=stale, last_t=run.last_t, samples=run.samples, walked=walked, crossings=marks)

    def _course(self, route: str | None, text: str | None = None) -> tuple[Course, matching._Follower] | None:
        """A route's course and what matches to it, made once for all its attempts; ``text``: the course as samples carry it."""
        if route in self.followers:
            return self.followers[route]
        if self.courses is not None:
            course = self.courses.get(route)
        else:
            course = None if text is None else _read_course(json.loads(text))
        if course is None:
            return None
        if self.points > MOST_POINTS:
            self.followers, self.points = {}, 0
        self.points += len(course.lats)
        self.followers[route] = course, matching._Follower(np.array(course.lats, float), np.array(course.lons, float), course.start_p)
        return self.followers[route]

    def _samples(self, rows: list[Row]) -> list[tuple]:
        return [sample for r in rows for sample in zip(*(r[c] for c in SAMPLE_NAMES), strict=True)]

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        attempt = key[0]
        k = self._loaded()
        run = k.run
        if not run.open:
            return  # what comes after the end is dropped
        packs = list(rows)
        k.route = packs[0].route_id if k.route is None else k.route
        now = timerValues.getCurrentProcessingTimeInMs()
        if self.courses is not None:
            found = self._course(k.route)
        else:
            found = next((self._course(r.route_id, r.course) for r in packs if r.course is not None), None)
        if found is None:  # the route is gone
            run.lifecycle, run.validity, k.held = "abandoned", "unranked", []
            self._set_timer(k, now)
            self._store(k)
            yield self._state(attempt, k.route, run, "locating", False, 0)
            return
        course, follower = found
        held = {s[0]: s for s in k.held}
        for sample in self._samples(packs):
            if k.seen is not None and sample[1] <= k.seen:
                yield self._row(attempt, "late", route_id=k.route, **dict(zip(SAMPLE_NAMES, sample, strict=True)))
                continue
            held[sample[0]] = sample
            k.top = sample[1] if k.top is None else max(k.top, sample[1])
        waiting = sorted(held.values(), key=itemgetter(1, 0))
        settled = [s for s in waiting if s[1] <= k.top - self.late_ms] if k.top is not None else []
        waiting = waiting[len(settled) :]
        k.seen = max([x for x in (k.seen, settled[-1][1] if settled else None, k.top - self.late_ms if k.top is not None else None) if x is not None], default=None)
        walk(run, course, settled, follower)
        ahead = run.copy()
        walk(ahead, course, waiting, follower)
        if not ahead.open and not run.open:
            waiting = []
        last = (waiting or settled or [None])[-1]
        k.held = waiting
        self._set_timer(k, now)
        self._store(k)
        yield self._state(attempt, k.route, ahead, zone_status(ahead, course, last, follower), False, len(settled) + len(waiting))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        k = self._loaded()
        k.timer = None
        if k.heard + self.stale_ms > timerValues.getCurrentProcessingTimeInMs():  # samples have come since it was set
            k.timer = k.heard + self.stale_ms
            self.handle.registerTimer(k.timer)
            self._store(k)
            return
        found = self._course(k.route) if self.courses is not None else None
        zone = "locating"
        if found is not None and k.held:
            course, follower = found
            k.held.sort(key=itemgetter(1, 0))
            walk(k.run, course, k.held, follower)
            zone, k.seen, k.held = zone_status(k.run, course, k.held[-1], follower), k.held[-1][1], []
        self._store(k)
        yield self._state(key[0], k.route, k.run, zone, True, 0)


def _course_rows(courses: DataFrame) -> DataFrame:
    """route_id with all that Course holds."""
    marks = timing.interior_checkpoints(courses).groupBy("route_id").agg(F.sort_array(F.collect_list(F.struct("cp_order", "checkpoint_id", "name", "progress_m"))).alias("m"))
    lat, lon = (F.expr(f"transform(path, p -> p.{c})") for c in ("latitude", "longitude"))
    rows = courses.select("route_id", lat.alias("lats"), lon.alias("lons")).join(timing.course_numbers(courses), "route_id").join(marks, "route_id", "left")
    none = F.array().cast("array<struct<checkpoint_id:string,name:string,progress_m:double>>")
    return rows.select("route_id", "lats", "lons", "start_p", "finish_p", "start_r", "trigger_p", F.coalesce(F.transform("m", lambda x: F.struct(x["checkpoint_id"].alias("checkpoint_id"), x["name"].alias("name"), x["progress_m"].alias("progress_m"))), none).alias("checkpoints"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The samples of an attempt and route that lie in one Arrow batch, in their order, as one row."""
    names = [c.split()[0] for c in PACKED.split(", ")]
    for batch in batches:
        if not batch.num_rows:
            continue
        code = np.zeros(batch.num_rows, np.int64)
        for c in names[:2]:
            own = batch.column(c).dictionary_encode(null_encoding="encode")
            code = code * (len(own.dictionary) + 1) + own.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(code[order])) + 1])
        ordered = batch.take(pa.array(order))
        lists = [pa.ListArray.from_arrays(pa.array([*cuts, batch.num_rows], pa.int32()), ordered.column(c)) for c in names[2:]]
        yield pa.RecordBatch.from_arrays([*(ordered.column(c).take(pa.array(cuts)) for c in names[:2]), *lists], names=names)


def _read_course(r: dict) -> Course:
    return Course(r["lats"], r["lons"], r["start_p"], r["finish_p"], r["start_r"], r["trigger_p"], [(c["checkpoint_id"], c["name"], c["progress_m"]) for c in r["checkpoints"]])


def live_runs(fixes: DataFrame, courses: DataFrame, late_ms: int = LATE_MS, stale_ms: int = K.STALE_MS, most_points: int = MOST_POINTS) -> DataFrame:
    """The state of every attempt that a batch touches, and samples that came too late, as rows of a stream; see LIVE and LiveRuns.

    ``fixes``: a stream of attempt_id, route_id and samples.  Courses of up to ``most_points``
    points in all are sent to the workers; with more, they are joined to the samples, and
    then an attempt that turns stale keeps what it holds until its next sample.  Rows of kind
    ``state`` tell in ``walked`` how many samples the batch went through.
    """
    # State of several kinds a key, and timers, need this store.
    fixes.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = _course_rows(courses)
    # A call for each attempt costs by rows and columns, so its samples come together.
    samples = clean_fixes(fixes).select("attempt_id", "route_id", "id", F.col("recorded_at_ms").alias("t"), "latitude", "longitude", "accuracy").mapInArrow(_packed, PACKED)
    held = None
    if (courses.agg(F.sum(F.size("path"))).first()[0] or 0) <= most_points:
        held = {r.route_id: _read_course(r.asDict(True)) for r in rows.collect()}
    else:
        text = F.to_json(F.struct(*[c for c in rows.columns if c != "route_id"]), {"ignoreNullFields": "false"})
        samples = samples.join(rows.select("route_id", F.when(F.col("lats").isNotNull(), text).alias("course")), "route_id", "left")
    # Rows, not pandas: a frame for each attempt costs more than what is done with it.
    return samples.groupBy("attempt_id").transformWithState(LiveRuns(held, late_ms, stale_ms), ONE, "update", "processingTime").select("x.*")


#: The tables of a live deployment.  Crossings and samples lie with their attempt and session.
TABLES = {
    "sessions": Table("id string, started_at_ms long, stopped_at_ms long, is_active boolean, purpose string, capture_outcome string, review_disposition string", ("id",), "id"),
    "attempts": Table("attempt_id string, route_id string, session_id string, lifecycle string, validity string, armed_at_ms long, started_at double, finished_at double, result_acknowledged boolean", ("attempt_id",), "attempt_id"),
    "crossings": Table("id string, attempt_id string, checkpoint_id string, name string, progress_m double, crossed_at double", ("attempt_id", "checkpoint_id"), "attempt_id"),
    "late": Table("attempt_id string, id string, t long, latitude double, longitude double, accuracy double", ("attempt_id", "id"), "attempt_id"),
    "live": Table("attempt_id string, start_zone string, stale boolean, last_t long", ("attempt_id",), "attempt_id"),
}


def crossing_id(attempt_id, checkpoint_id):
    """The id of an attempt's crossing of a checkpoint."""
    return F.concat_ws(":", attempt_id, checkpoint_id)


def settle(store: Store, states: DataFrame, now_ms: int, stream: str | None = None, batch: int | None = None) -> int:
    """Bring states (rows of LIVE) into the tables, in one commit; returns the manifest's number.

    Attempts that are open in the tables take over lifecycle, validity, times and crossings.  Those
    that end stop their session in the same commit: a completed one's counts as finished and
    saved, any other's as interrupted and discarded.  Attempts that are not open, or unknown,
    stay as they are.  Late samples are kept in a table of their own.
    """
    rows = states.filter("kind = 'state'")
    known = store.read("attempts", of=rows.select("attempt_id")).filter(F.col("lifecycle").isin(*sessions.OPEN))
    fresh = ("lifecycle", "validity", "started_at", "finished_at")
    now = rows.select("attempt_id", *[F.col(c).alias(f"_{c}") for c in fresh], "crossings", "start_zone", "stale", "last_t")
    both = staged(known.join(now, "attempt_id"), "live-settled")
    attempts = both.withColumns({c: F.col(f"_{c}") for c in fresh})
    ended = attempts.filter(~F.col("lifecycle").isin(*sessions.OPEN))
    done = F.col("lifecycle") == "completed"
    stop = ended.select(F.col("session_id").alias("id"), F.lit(now_ms).cast("long").alias("stopped_at_ms"), F.when(done, "finished").otherwise("interrupted").alias("capture_outcome"), F.when(done, "saved").otherwise("discarded").alias("review_disposition"))
    stopped = sessions.complete_sessions(store.read("sessions", of=ended.select("session_id")), stop)
    marks = attempts.select("attempt_id", F.explode("crossings").alias("c")).select(crossing_id(F.col("attempt_id"), F.col("c.checkpoint_id")).alias("id"), "attempt_id", "c.*")
    old = store.read("crossings", of=attempts.select("attempt_id")).join(marks.select("attempt_id", "checkpoint_id"), ["attempt_id", "checkpoint_id"], "left_anti")
    late = states.filter("kind = 'late'").dropDuplicates(["attempt_id", "id"])
    changes = {"attempts": attempts, "sessions": stopped, "crossings": marks, "late": late, "live": attempts}
    return store.commit(changes, gone={"crossings": old.select("attempt_id", "checkpoint_id")}, stream=stream, batch=batch)


def keep_live(fixes: DataFrame, courses: DataFrame, store: Store, checkpoint: str, name: str = "live", every: str | None = None, clock=None, partitions: int | None = None, **more) -> StreamingQuery:
    """Run live_runs() and settle() each batch's rows; a batch that runs again changes nothing.

    ``clock`` gives the time in milliseconds at which sessions stop, by default the machine's;
    ``partitions``, over how many places the state is dealt for as long as the checkpoint
    lasts, by default as many as the session's shuffles have.
    """
    import time

    tell = clock or (lambda: int(time.time() * 1000))

    def each(batch: DataFrame, number: int) -> None:
        settle(store, staged(batch, "live-batch"), tell(), name, number)

    return begun(live_runs(fixes, courses, **more), each, checkpoint, every, partitions)


def begun(rows: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None, partitions: int | None = None) -> StreamingQuery:
    """Start a stream of live_runs(): batches come ``every`` so often, so that timers run out, or only as long as there is input."""
    conf, shuffles = rows.sparkSession.conf, "spark.sql.shuffle.partitions"
    # A state with timers asks for batches without end; what is to stop by itself makes none without input.
    conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true" if every else "false")
    trigger = {"processingTime": every} if every else {"availableNow": True}
    usual = conf.get(shuffles)
    try:  # a query keeps the settings that it starts with
        if partitions is not None:
            conf.set(shuffles, str(partitions))
        return rows.writeStream.foreachBatch(each).outputMode("update").option("checkpointLocation", checkpoint).trigger(**trigger).start()
    finally:
        conf.set(shuffles, usual)


def abandon(store: Store, attempt_ids: DataFrame, now_ms: int) -> int:
    """Abandon open attempts, unranked, and interrupt their sessions: what is left of a run that nothing records any more."""
    found = store.read("attempts", of=attempt_ids).filter(F.col("lifecycle").isin(*sessions.OPEN))
    marks = store.read("crossings", of=found.select("attempt_id")).groupBy("attempt_id").agg(F.collect_list(F.struct("checkpoint_id", "name", "progress_m", "crossed_at")).alias("crossings"))
    rows = found.join(marks, "attempt_id", "left").select(
        "attempt_id", F.lit("state").alias("kind"), "route_id", F.lit("abandoned").alias("lifecycle"), F.lit("unranked").alias("validity"), "started_at", "finished_at", F.lit("locating").alias("start_zone"), F.lit(False).alias("stale"),
        F.lit(None).cast("long").alias("last_t"), F.coalesce("crossings", F.array().cast(CROSSING)).alias("crossings"), *[F.lit(None).cast(t).alias(c) for c, t in (("id", "string"), ("t", "long"), ("latitude", "double"), ("longitude", "double"), ("accuracy", "double"))],
    )
    return settle(store, staged(rows, "live-abandoned"), now_ms)


def reconcile(store: Store, routes: DataFrame, recorded: DataFrame, now_ms: int) -> int:
    """After a restart: abandon the open attempts whose route is gone or that nothing records (``recorded``: attempt_ids that are being recorded)."""
    found = store.read("attempts").filter(F.col("lifecycle").isin(*sessions.OPEN)).select("attempt_id", "route_id")
    live = found.join(routes.select("route_id"), "route_id", "left_semi").join(recorded.select("attempt_id"), "attempt_id", "left_semi")
    return abandon(store, staged(found.join(live, "attempt_id", "left_anti").select("attempt_id"), "live-unrecorded"), now_ms)


def started(spark: SparkSession, path: str) -> Store:
    """A live deployment's tables under a folder."""
    return Store(spark, path, TABLES)
