"""Two attempts compared by progress: where each was when, waits included.

A run's knots are its accepted samples between start and finish.  Stretches without
movement hold a progress for a while, so a progress has not one time but several: holds
(intervals) and passages upwards or downwards (instants).  What a run was asked for streams
past its own stretches, which are searched by time and progress.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..sources.staging import staged
from .matching import points_at
from .occupancy import Occupancy
from .streams import in_order
from .timing import course_numbers, crossing_time

#: Questions to one run that a task answers, about.
A_TASK = 100_000


def knots(matched: DataFrame, ranked: DataFrame, courses: DataFrame) -> DataFrame:
    """attempt_id, n (from 0), kind (start, sample, finish-trigger), elapsed_ms, progress_m, at_ms."""
    runs = ranked.select("attempt_id", "route_id", "started_at", "finished_at", "official_ms").join(course_numbers(courses), "route_id")
    acc = matched.filter("quality = 'accepted'").select("attempt_id", "t", "seq", F.col("progress_m").alias("p")).join(runs, "attempt_id")
    place = F.struct("t", "p")
    near = acc.groupBy("attempt_id").agg(F.min(F.when(F.abs(F.col("t") - F.col("started_at")) <= 0.5, place)).alias("e"), F.max(F.when(F.col("t") < F.col("started_at"), place)).alias("l"), F.min(F.when(F.col("t") > F.col("started_at"), place)).alias("r"))
    share = (F.col("started_at") - F.col("l.t")) / (F.col("r.t") - F.col("l.t"))
    start_p = F.coalesce(F.col("e.p"), F.col("l.p") + share * (F.col("r.p") - F.col("l.p")), F.col("r.p"), F.col("l.p"), F.col("start_p"))
    first = runs.join(near, "attempt_id", "left").select("attempt_id", F.lit(0).alias("order"), F.lit(-1).alias("seq"), F.lit("start").alias("kind"), F.lit(0.0).alias("elapsed_ms"), start_p.alias("progress_m"), F.col("started_at").alias("at_ms"))
    inner = acc.filter((F.col("t") > F.col("started_at")) & (F.col("t") < F.col("finished_at"))).select("attempt_id", F.lit(1).alias("order"), "seq", F.lit("sample").alias("kind"), (F.col("t") - F.col("started_at")).alias("elapsed_ms"), F.col("p").alias("progress_m"), F.col("t").cast("double").alias("at_ms"))
    last = runs.select("attempt_id", F.lit(2).alias("order"), F.lit(1 << 30).alias("seq"), F.lit("finish-trigger").alias("kind"), F.col("official_ms").alias("elapsed_ms"), F.col("trigger_p").alias("progress_m"), F.col("finished_at").alias("at_ms"))
    order = Window.partitionBy("attempt_id").orderBy("order", "seq")
    rows = first.unionByName(inner).unionByName(last).withColumns({"e0": F.lag("elapsed_ms").over(order), "p0": F.lag("progress_m").over(order)})
    again = (F.col("kind") == "sample") & (F.col("e0") == F.col("elapsed_ms")) & (F.abs(F.col("p0") - F.col("progress_m")) <= K.GHOST_M)
    rows = rows.filter(~F.coalesce(again, F.lit(False)))
    return rows.select("attempt_id", (F.row_number().over(order) - 1).alias("n"), "kind", "elapsed_ms", "progress_m", "at_ms")


def legs(knots_of: DataFrame, labelled: DataFrame) -> DataFrame:
    """attempt_id, n, elapsed and progress at both ends, good (no unknown time in it) and stall (nothing but waiting)."""
    order = Window.partitionBy("attempt_id").orderBy("n")
    nxt = {f"{c}1": F.lead(c).over(order) for c in ("elapsed_ms", "progress_m", "at_ms")}
    rows = knots_of.withColumns(nxt).filter("at_ms1 is not null").select("attempt_id", "n", F.col("elapsed_ms").alias("e0"), F.col("elapsed_ms1").alias("e1"), F.col("progress_m").alias("p0"), F.col("progress_m1").alias("p1"), F.col("at_ms").alias("t0"), F.col("at_ms1").alias("t1"))
    # Intervals that overlap a leg: those that begin before its end, less those that end by its start.  Both are counts
    # so far in one order of all times, where ends come before the starts of legs, and the ends of legs before starts.
    kinds = {"any": F.lit(1), "unknown": (F.col("label") == "unknown").cast("int"), "other": (F.col("label") != "waiting").cast("int")}
    zero = [F.lit(0).alias(k) for k in kinds]
    found = labelled.select("attempt_id", "start_ms", "end_ms", *[c.alias(k) for k, c in kinds.items()])
    marks = [
        found.select("attempt_id", F.col("end_ms").alias("at"), F.lit(0).alias("turn"), F.lit(None).cast("int").alias("n"), *kinds),
        rows.select("attempt_id", F.col("t0").alias("at"), F.lit(1).alias("turn"), "n", *zero),
        rows.select("attempt_id", F.col("t1").alias("at"), F.lit(2).alias("turn"), "n", *zero),
        found.select("attempt_id", F.col("start_ms").alias("at"), F.lit(3).alias("turn"), F.lit(None).cast("int").alias("n"), *kinds),
    ]
    line = marks[0].unionByName(marks[1]).unionByName(marks[2]).unionByName(marks[3])
    so_far = Window.partitionBy("attempt_id").orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    past = lambda k, turn: F.sum(F.when(F.col("turn") == turn, F.col(k)).otherwise(0)).over(so_far)
    line = line.select("attempt_id", "turn", "n", *[F.when(F.col("turn") == 1, -past(k, 0)).otherwise(past(k, 3)).alias(k) for k in kinds])
    over = line.filter("n is not null").groupBy("attempt_id", "n").agg(*[F.sum(k).alias(k) for k in kinds])
    seen = over.select("attempt_id", "n", (F.col("any") > 0).alias("met"), (F.col("unknown") == 0).alias("clear"), (F.col("other") == 0).alias("waits"))
    moment = F.col("t1") <= F.col("t0")
    rows = rows.join(seen, ["attempt_id", "n"])
    clear = F.col("met") & F.col("clear")
    return rows.withColumns({"good": moment | clear, "stall": ~moment & clear & F.col("waits")}).drop("met", "clear", "waits")


def stalls(legs_of: DataFrame) -> DataFrame:
    """attempt_id, run, e0, e1, lo, hi: stretches of neighbouring stall legs."""
    order = Window.partitionBy("attempt_id").orderBy("n")
    rows = legs_of.withColumn("run", F.sum((~F.col("stall")).cast("int")).over(order)).filter("stall")
    return rows.groupBy("attempt_id", "run").agg(F.min("e0").alias("e0"), F.max("e1").alias("e1"), F.min(F.least("p0", "p1")).alias("lo"), F.max(F.greatest("p0", "p1")).alias("hi"))


def painted_finish(knots_of: DataFrame, legs_of: DataFrame, ranked: DataFrame, courses: DataFrame) -> DataFrame:
    """attempt_id, painted_ms: when the line itself was passed, if it was, rather than the trigger before it."""
    runs = ranked.select("attempt_id", "route_id", "started_at").join(courses.select("route_id", "finish_p"), "route_id")
    hit = legs_of.filter("good and not stall").join(runs, "attempt_id").filter((F.col("p0") < F.col("finish_p")) & (F.col("p1") >= F.col("finish_p")))
    at = crossing_time(F.col("finish_p"), F.col("p0"), F.col("t0"), F.col("p1"), F.col("t1")) - F.col("started_at")
    passed = hit.withColumn("ms", at).groupBy("attempt_id").agg(F.min(F.struct("n", "ms")).alias("x"))
    on = knots_of.join(runs, "attempt_id").filter(F.abs(F.col("progress_m") - F.col("finish_p")) <= K.GHOST_M).groupBy("attempt_id").agg(F.min(F.struct("n", "elapsed_ms")).alias("y"))
    return runs.join(passed, "attempt_id", "left").join(on, "attempt_id", "left").select("attempt_id", F.coalesce("x.ms", "y.elapsed_ms").alias("painted_ms"))


def _pieces(legs_of: DataFrame, stalls_of: DataFrame) -> DataFrame:
    """A run's stretches: owner, kind (hold, up, down), e0, e1, p0, p1, lo, hi, good."""
    flat = F.abs(F.col("p1") - F.col("p0")) <= K.GHOST_M
    kind = F.when(flat, "hold").when(F.col("p1") > F.col("p0"), "up").otherwise("down")
    moving = legs_of.filter("not stall").select("attempt_id", kind.alias("kind"), "e0", "e1", "p0", "p1", F.least("p0", "p1").alias("lo"), F.greatest("p0", "p1").alias("hi"), "good")
    held = stalls_of.select("attempt_id", F.lit("hold").alias("kind"), "e0", "e1", F.col("lo").alias("p0"), F.col("hi").alias("p1"), "lo", "hi", F.lit(True).alias("good"))
    return moving.unionByName(held).withColumnRenamed("attempt_id", "owner")


ASKED = ("attempt_id string", "source string", "n int", "progress_m double", "elapsed_ms double", "in_stall boolean")
PIECE = ("kind string", "e0 double", "e1 double", "p0 double", "p1 double", "lo double", "hi double", "good boolean")


def paired(asked: DataFrame, pieces: DataFrame, a_task: int = A_TASK) -> DataFrame:
    """asked (attempt_id, owner, source, n, progress_m, elapsed_ms, in_stall) with other_ms and good, the owner's time at that progress.

    An owner's stretches are read in order of time and indexed; what is asked of it streams past
    them.  An owner of whom much is asked, as of a route's best, has its stretches in as many
    tasks as ``a_task`` questions each make.
    """
    salts = asked.groupBy("owner").agg((1 + F.floor(F.count("*") / a_task)).cast("int").alias("salts"))
    null = lambda fields: [F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in fields]
    names = lambda fields: [f.split()[0] for f in fields]
    heads = pieces.join(salts, "owner").select("owner", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("side"), *null(ASKED), *names(PIECE))
    rows = asked.join(salts, "owner").select("owner", F.pmod(F.xxhash64("attempt_id", "source", "n"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("side"), *names(ASKED), *null(PIECE))

    def each(key: tuple, slices: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        run = None
        for part in slices:
            heads = sum(x == 0 for x in part.column("side").to_pylist())
            held += zip(*(part.slice(0, heads).column(c).to_pylist() for c in names(PIECE)), strict=True)
            part = part.slice(heads)
            if not part.num_rows:
                continue
            if run is None:
                run, held = Occupancy(held), []
            found = [run.at(p, q, still) or (None, False) for p, q, still in zip(*(part.column(c).to_pylist() for c in ("progress_m", "elapsed_ms", "in_stall")), strict=True)]
            columns = [part.column("owner"), *(part.column(c) for c in names(ASKED)), pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["owner", *names(ASKED), "other_ms", "good"])

    return in_order(heads.unionByName(rows), ["owner", "salt"], ["side", "e0", "e1"], each, ", ".join(["owner string", *ASKED, "other_ms double", "good boolean"]))


def _in_stalls(inner: DataFrame, runs: DataFrame) -> DataFrame:
    """Knots with in_stall: whether their time and progress lie in a stall.

    Stalls take time and follow one another, so a knot's time lies in the last that has begun
    by then, or at the end of the one before it.
    """
    order = Window.partitionBy("attempt_id").orderBy("at", "turn")
    own = F.struct(F.col("e1").alias("e1"), "lo", "hi")
    begun = runs.select("attempt_id", F.col("e0").alias("at"), F.lit(0).alias("turn"), F.struct(own.alias("now"), F.lag(own).over(Window.partitionBy("attempt_id").orderBy("e0")).alias("before")).alias("stall"))
    asked = inner.select("attempt_id", F.col("elapsed_ms").alias("at"), F.lit(1).alias("turn"), "n", "progress_m", "elapsed_ms")
    line = begun.unionByName(asked, allowMissingColumns=True).withColumn("stall", F.last("stall", True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    within = lambda s: (F.col("elapsed_ms") <= F.col(f"{s}.e1")) & (F.col("progress_m") + K.GHOST_M >= F.col(f"{s}.lo")) & (F.col("progress_m") - K.GHOST_M <= F.col(f"{s}.hi"))
    held = F.coalesce(within("stall.now"), F.lit(False)) | F.coalesce(within("stall.before"), F.lit(False))
    return line.filter("turn = 1").select("attempt_id", "n", "progress_m", "elapsed_ms", held.alias("in_stall"))


def compare(knots_of: DataFrame, legs_of: DataFrame, ranked: DataFrame) -> DataFrame:
    """attempt_id, target_id, source, progress_m, current_ms, reference_ms, delta_ms (null unless both times are trustworthy), good.

    Every inner knot of either run, paired with the other run; and one knot each for start
    and finish.  Pairs that come out alike count once.
    """
    runs = stalls(legs_of)
    pieces = _pieces(legs_of, runs)
    inner = _in_stalls(knots_of.filter("kind = 'sample'").select("attempt_id", "n", "progress_m", "elapsed_ms"), runs)
    pairs = ranked.filter("target_id is not null").select("attempt_id", "target_id", "official_ms")
    mine = pairs.join(inner, "attempt_id").select("attempt_id", F.col("target_id").alias("owner"), F.lit("current").alias("source"), "n", "progress_m", "elapsed_ms", "in_stall")
    theirs = pairs.join(inner.withColumnRenamed("attempt_id", "target_id"), "target_id").select("attempt_id", F.col("attempt_id").alias("owner"), F.lit("reference").alias("source"), "n", "progress_m", "elapsed_ms", "in_stall")
    both = paired(mine.unionByName(theirs), pieces)
    of_current = F.col("source") == "current"
    rows = both.join(pairs.select("attempt_id", "target_id"), "attempt_id").select("attempt_id", "target_id", "source", "progress_m", F.when(of_current, F.col("elapsed_ms")).otherwise(F.col("other_ms")).alias("current_ms"), F.when(of_current, F.col("other_ms")).otherwise(F.col("elapsed_ms")).alias("reference_ms"), "good")
    rows = rows.withColumn("good", F.col("good") & F.col("current_ms").isNotNull() & F.col("reference_ms").isNotNull())
    ends = knots_of.filter("kind <> 'sample'").select("attempt_id", "kind", "progress_m", "elapsed_ms")
    other = ends.select(F.col("attempt_id").alias("target_id"), "kind", F.col("elapsed_ms").alias("reference_ms"))
    ends = pairs.select("attempt_id", "target_id").join(ends, "attempt_id").join(other, ["target_id", "kind"]).select("attempt_id", "target_id", F.col("kind").alias("source"), "progress_m", F.col("elapsed_ms").alias("current_ms"), "reference_ms", F.lit(True).alias("good"))
    every = rows.unionByName(ends).withColumn("delta_ms", F.when(F.col("good"), F.col("current_ms") - F.col("reference_ms")))
    # Knots that agree to a millimetre, and in their times, count once: the first of them.
    alike = ["attempt_id", "target_id", "source", "current_ms", "reference_ms", "good", "delta_ms"]
    return every.groupBy(*alike, F.round("progress_m", 3).alias("mm")).agg(F.min("progress_m").alias("progress_m")).drop("mm")


def ordered(compared: DataFrame, courses: DataFrame, ranked: DataFrame) -> DataFrame:
    """compare()'s knots with place (from 1: by current time, unknown last, progress, reference time, source) and where on the course they lie."""
    far = F.lit(float(2**53 - 1))
    order = Window.partitionBy("attempt_id").orderBy(F.coalesce("current_ms", far), "progress_m", F.coalesce("reference_ms", far), "source")
    rows = staged(compared.withColumn("place", F.row_number().over(order)).join(ranked.select("attempt_id", "route_id"), "attempt_id"), "ghost-order")
    at = points_at(rows.select("route_id", F.struct("attempt_id", "place").alias("id"), "progress_m"), courses).select("id.attempt_id", "id.place", "latitude", "longitude")
    return rows.join(at, ["attempt_id", "place"], "left").drop("route_id")


def near_progress(compared: DataFrame, progress_m: float, radius_m: float = K.NEAR_M) -> DataFrame:
    """Comparison knots within a radius of a progress."""
    return compared.filter(F.abs(F.col("progress_m") - progress_m) <= radius_m)


def availability(focus: DataFrame, painted: DataFrame) -> DataFrame:
    """One row an attempt, eligible or not: target_id, reason that no comparison is made (null where one is), deltas at the start and the trigger, and both painted finishes.

    A run's polyline is at hand where it has a start, a finish not before it and an official time.
    """
    line = F.col("started_at").isNotNull() & (F.col("finished_at") >= F.col("started_at")) & (F.col("official_ms") >= 0)
    own = focus.select("attempt_id", "target_id", "eligible", "official_ms", F.coalesce(line, F.lit(False)).alias("line"))
    other = own.select(F.col("attempt_id").alias("target_id"), F.col("eligible").alias("their_eligible"), F.col("official_ms").alias("their_ms"), F.col("line").alias("their_line"))
    j = own.join(other, "target_id", "left").join(painted, "attempt_id", "left").join(painted.select(F.col("attempt_id").alias("target_id"), F.col("painted_ms").alias("their_painted_ms")), "target_id", "left")
    reason = (
        F.when(~F.col("eligible") | F.col("official_ms").isNull(), "current_not_eligible").when(~F.col("line"), "current_polyline_unavailable").when(F.col("target_id").isNull(), "missing_comparison_target")
        .when(~F.coalesce("their_eligible", F.lit(False)) | F.col("their_ms").isNull(), "reference_not_eligible").when(~F.col("their_line"), "reference_polyline_unavailable")
    )
    j = j.withColumn("reason", reason)
    made = F.col("reason").isNull()
    return j.select("attempt_id", "target_id", "reason", F.when(made, 0.0).alias("start_delta_ms"), F.when(made, F.col("official_ms") - F.col("their_ms")).alias("trigger_delta_ms"), "painted_ms", F.when(made, F.col("their_painted_ms")).alias("reference_painted_ms"))
