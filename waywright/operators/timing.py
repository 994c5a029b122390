"""Start, checkpoint and finish times from matched samples, as window operations.

Matching doesn't depend on whether an attempt has started, so it runs over the whole trace
first; what follows finds the first row that starts the attempt, the first that ends it,
and reads everything else from the rows between.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import in_locale
from .matching import projection_near


def course_numbers(courses: DataFrame) -> DataFrame:
    """route_id, start_p, finish_p, start_r, trigger_p: the progress that ends an attempt, short of the line by the finish radius."""
    length = F.greatest(F.lit(0.0), F.col("finish_p") - F.col("start_p"))
    tolerance = F.least(F.greatest(F.lit(0.0), F.col("finish_r")), F.greatest(F.lit(0.0), length - K.MARKER_GAP_M))
    return courses.select("route_id", "start_p", "finish_p", "start_r", F.greatest(F.col("start_p"), F.col("finish_p") - tolerance).alias("trigger_p"))


def interior_checkpoints(courses: DataFrame) -> DataFrame:
    """route_id, checkpoint_id, name, progress_m, cp_order (from 1) of checkpoints between start and finish."""
    cps = courses.select("route_id", "start_p", "finish_p", F.explode("checkpoints").alias("c")).select("route_id", "start_p", "finish_p", F.col("c.id").alias("checkpoint_id"), "c.name", "c.progress_m")
    cps = cps.filter((F.col("progress_m") > F.col("start_p")) & (F.col("progress_m") < F.col("finish_p")))
    return cps.select("route_id", "checkpoint_id", "name", "progress_m", F.row_number().over(Window.partitionBy("route_id").orderBy("progress_m", in_locale("checkpoint_id"), "checkpoint_id")).alias("cp_order"))


def crossing_time(line: Column, p0: Column = None, t0: Column = None, p1: Column = None, t1: Column = None) -> Column:
    """When a line is crossed between two samples, by linear interpolation; the later time if they don't differ."""
    p0, t0, p1, t1 = (F.col(n) if c is None else c for c, n in ((p0, "prev_p"), (t0, "prev_t"), (p1, "p"), (t1, "t")))
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (line - p0) / (p1 - p0)))
    return F.when(p1 == p0, t1.cast("double")).otherwise(t0 + share * (t1 - t0))


def replay(matched: DataFrame, courses: DataFrame) -> DataFrame:
    """One row an attempt: lifecycle, validity, started_at, finished_at, end_seq and least_p (of accepted samples up to it).

    Samples with equal times count as one moment in the departure window.  Attempts whose route
    has no course are left out; samples without an attempt are one attempt without an id.  Other
    columns of either table, whatever their names, are ignored.
    """
    numbers = course_numbers(courses)
    rows = matched.select("attempt_id", "route_id", "seq", "t", F.col("progress_m").alias("p"), "quality").join(numbers, "route_id", "left")
    known = F.col("start_p").isNotNull() & F.col("attempt_id").isNotNull()
    rows = rows.withColumns({"ok": known & (F.col("quality") == "accepted"), "off": known & F.col("quality").isin("off_course", "out_of_window")}).drop("quality")
    # Times rise with seq, so that all windows go by one order, and a task sorts its rows once.
    every = Window.partitionBy("attempt_id").orderBy("t", "seq")
    upto, before = (every.rowsBetween(Window.unboundedPreceding, end) for end in (Window.currentRow, -1))
    recent = Window.partitionBy("attempt_id").orderBy("t").rangeBetween(-K.DEPARTURE_MS, 0)
    whole = Window.partitionBy("attempt_id")
    of_ok, of_off = (lambda c: F.when(F.col("ok"), c)), (lambda c: F.when(F.col("off"), c))
    rows = rows.withColumns({"prev": F.last(of_ok(F.struct("seq", "t", "p")), True).over(before), "before_t": F.lag("t").over(every), "was_off": F.last(F.when(F.col("ok"), False).when(F.col("off"), True), True).over(before)})
    rows = rows.withColumns({"prev_seq": F.col("prev.seq"), "prev_t": F.col("prev.t"), "prev_p": F.col("prev.p")}).drop("prev")

    late = F.col("start_p") > K.START_NOISE_M
    crosses = lambda line: F.when(F.col("ok") & (F.col("prev_p") < F.col(line)) & (F.col("p") >= F.col(line)), crossing_time(F.col(line)))
    rows = rows.withColumns({
        "early": F.max(of_ok(F.col("p") < F.col("start_p") - K.PRE_START_M)).over(upto),
        "n_recent": F.count(of_ok(F.lit(1))).over(recent), "first_p": F.first(of_ok(F.col("p")), True).over(recent),
        "in_zone": F.max(of_ok((F.col("start_r") >= 0) & (F.abs(F.col("p") - F.col("start_p")) <= F.col("start_r")))).over(recent),
        "line_t": crosses("start_p"), "finish_t": crosses("finish_p"), "trigger_t": crosses("trigger_p"), "since": F.last(F.when(F.col("off") & ~F.coalesce("was_off", F.lit(False)), F.col("t")), True).over(upto),
    })
    departs = F.col("ok") & (F.col("n_recent") >= K.DEPARTURE_SAMPLES) & (F.col("p") - F.col("first_p") >= K.DEPARTURE_M) & (F.col("p") >= F.col("start_p")) & F.col("in_zone") & (~late | F.col("early"))
    end_t = F.coalesce(F.last("finish_t", True).over(upto), F.first("trigger_t", True).over(upto), F.col("t").cast("double"))
    rows = rows.withColumns({"end_t": end_t, "departs": departs}).drop("early", "n_recent", "first_p", "in_zone", "finish_t", "trigger_t", "was_off")
    leaves = F.when(F.col("departs"), F.col("seq"))
    rows = rows.withColumns({"promote_seq": F.min(leaves).over(whole), "promote_t": F.min_by("t", leaves).over(whole), "promote_p": F.min_by("p", leaves).over(whole)})

    # The start: the last crossing of the line not followed by a return, else the departure itself.
    begun = F.col("ok") & (F.col("seq") <= F.col("promote_seq"))
    inside = lambda t: begun & (t >= F.col("promote_t") - K.DEPARTURE_MS)
    left = F.when(inside(F.col("prev_t")) & (F.col("prev_p") <= K.START_NOISE_M), F.col("prev_seq"))
    anchor = crossing_time(F.least(F.lit(K.START_NOISE_M), F.col("p")))
    on_line = F.when(begun & F.col("line_t").isNotNull(), F.col("seq"))
    rows = rows.withColumns({
        "reset": F.max(F.when(begun & (F.col("p") < F.col("start_p") - K.HYSTERESIS_M), F.col("seq"))).over(whole), "crossed": F.max(on_line).over(whole), "crossed_t": F.max_by("line_t", on_line).over(whole),
        "anchor": F.max_by(anchor, left).over(whole), "first_t": F.min_by("t", F.when(inside(F.col("t")), F.col("seq"))).over(whole),
    })
    anchored = F.coalesce(F.when(F.col("promote_p") > K.START_NOISE_M, F.col("anchor")), F.col("first_t").cast("double"))
    by_line = F.when(late & (F.col("reset").isNull() | (F.col("crossed") > F.col("reset"))), F.col("crossed_t"))
    rows = rows.withColumn("started_at", F.when(F.col("promote_seq").isNotNull(), F.coalesce(by_line, anchored))).drop("promote_t", "promote_p", "prev_seq", "prev_t", "prev_p", "line_t", "reset", "crossed", "crossed_t", "anchor", "first_t", "departs")

    # The end: finished, or too long off the course.
    lost = F.when(F.col("off") & (F.col("seq") > F.col("promote_seq")), F.greatest(F.lit(0), F.col("t") - F.col("before_t")))
    done = F.when(F.col("ok") & (F.col("seq") >= F.col("promote_seq")) & (F.col("p") >= F.col("trigger_p")) & (F.col("end_t") >= F.col("started_at")), F.col("seq"))
    gone = F.when(F.col("off") & (F.col("seq") > F.col("promote_seq")) & (F.col("t") - F.col("since") >= K.ABANDON_MS), F.col("seq"))
    rows = rows.withColumns({"total": F.sum(lost).over(upto), "finish_seq": F.min(done).over(whole), "finish_t": F.min_by("end_t", done).over(whole), "gone_seq": F.min(gone).over(whole)})
    finished = F.col("finish_seq").isNotNull() & (F.col("gone_seq").isNull() | (F.col("finish_seq") < F.col("gone_seq")))
    rows = rows.withColumn("finished", finished).withColumn("end_seq", F.when(F.col("finished"), F.col("finish_seq")).otherwise(F.col("gone_seq")))
    counts = F.col("end_seq").isNull() | (F.col("seq") <= F.col("end_seq"))
    rows = rows.withColumns({"strayed": F.max(F.when(F.col("off") & counts, F.col("total"))).over(whole), "least_p": F.min(F.when(F.col("ok") & counts, F.col("p"))).over(whole)})
    out = rows.groupBy("attempt_id", "route_id").agg(*[F.max(c).alias(c) for c in ("finished", "gone_seq", "promote_seq", "strayed", "started_at", "finish_t", "end_seq", "least_p")])
    bad = F.coalesce(F.col("strayed") >= K.DEVIATION_MS, F.lit(False))
    return out.select(
        "attempt_id", "route_id",
        F.when(F.col("finished"), "completed").when(F.col("gone_seq").isNotNull(), "abandoned").when(F.col("promote_seq").isNotNull(), "active").otherwise("armed").alias("lifecycle"),
        F.when(F.col("finished"), F.when(bad, "unranked").otherwise("valid")).when(F.col("gone_seq").isNotNull() | bad, "unranked").otherwise("pending").alias("validity"),
        "started_at", F.when(F.col("finished"), F.col("finish_t")).alias("finished_at"), "promote_seq", "end_seq", "least_p",
    )


def crossings(matched: DataFrame, courses: DataFrame, runs: DataFrame) -> DataFrame:
    """attempt_id, checkpoint_id, name, progress_m, cp_order, crossed_at: the first crossing of each checkpoint not before the start."""
    order = Window.partitionBy("attempt_id").orderBy("seq")
    acc = matched.filter("quality = 'accepted'").select("attempt_id", "seq", "t", "progress_m").withColumns({"p": F.col("progress_m"), "prev_p": F.lag("progress_m").over(order), "prev_t": F.lag("t").over(order)}).drop("progress_m")
    live = runs.filter("started_at is not null").select("attempt_id", "route_id", "started_at", "end_seq")
    pairs = acc.join(live, "attempt_id").filter(F.col("end_seq").isNull() | (F.col("seq") <= F.col("end_seq")))
    hit = pairs.join(interior_checkpoints(courses), "route_id").filter((F.col("prev_p") < F.col("progress_m")) & (F.col("p") >= F.col("progress_m")))
    hit = hit.withColumn("crossed_at", crossing_time(F.col("progress_m"))).filter(F.col("crossed_at") >= F.col("started_at"))
    return hit.groupBy("attempt_id", "route_id", "checkpoint_id", "name", "progress_m", "cp_order").agg(F.min(F.struct("seq", "crossed_at")).alias("f")).select("attempt_id", "route_id", "checkpoint_id", "name", "progress_m", "cp_order", F.col("f.crossed_at").alias("crossed_at"))


def start_zone_status(attempts: DataFrame, matched: DataFrame, courses: DataFrame, runs: DataFrame) -> DataFrame:
    """attempt_id, status of every attempt, from its latest sample: locating without one or with a poor one, else inside the start zone or outside.

    The sample is matched once more near the last progress accepted while the attempt was open.
    """
    last = matched.groupBy("attempt_id").agg(F.max(F.struct("seq", "quality", "latitude", "longitude")).alias("l"))
    ends = matched.select("attempt_id", "seq", "quality", "progress_m").join(runs.select("attempt_id", "end_seq"), "attempt_id").filter((F.col("quality") == "accepted") & (F.col("end_seq").isNull() | (F.col("seq") <= F.col("end_seq"))))
    centre = ends.groupBy("attempt_id").agg(F.max(F.struct("seq", "progress_m")).alias("c"))
    rows = attempts.select("attempt_id", "route_id").join(last, "attempt_id", "left").join(centre, "attempt_id", "left").join(course_numbers(courses), "route_id")
    known = F.col("c").isNotNull()
    asked = rows.select(
        "route_id", F.struct("attempt_id", F.col("l.quality").alias("quality"), "start_p", "start_r").alias("id"), "l.latitude", "l.longitude", F.coalesce("c.progress_m", "start_p").alias("centre"),
        F.when(known, K.AHEAD_M).otherwise(K.FIRST_AHEAD_M).alias("ahead"), F.when(known, K.BEHIND_M).otherwise(K.FIRST_BEHIND_M).alias("behind"),
    )
    found = projection_near(asked, courses)
    radius = F.col("id.start_r")
    inside = (F.col("snap_m") <= K.CORRIDOR_M) & (radius >= 0) & (F.abs(F.col("progress_m") - F.col("id.start_p")) <= radius)
    usable = F.coalesce(F.col("id.quality") != "poor_accuracy", F.lit(False))
    return found.select("id.attempt_id", F.when(~usable, "locating").when(F.coalesce(inside, F.lit(False)), "inside").otherwise("outside").alias("status"))
