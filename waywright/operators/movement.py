"""Moving, waiting and unknown time of an attempt, and the waits that it adds up to."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.geo import haversine, plain
from ..sources.staging import staged
from .matching import points_at
from .streams import in_order

FIX = ("latitude", "longitude", "accuracy", "speed", "progress_m", "matched")


def _points(fixes: DataFrame, runs: DataFrame) -> DataFrame:
    """attempt_id, place (0 start, 1 between, 2 finish), t and FIX: the fixes of each run's official time, and those at its start and finish.

    At a bound stands a fix within half a millisecond, else what lies between the two around it,
    if these aren't too far apart.  Bounds are put in line with the fixes, ahead of one of the
    same time, so that each finds its neighbours in the line; times of fixes rise.
    """
    fix = F.struct(F.col("t").cast("double").alias("t"), *FIX)
    ends = runs.select("attempt_id", F.explode(F.array(F.struct(F.lit(0).alias("place"), F.col("started_at").alias("t")), F.struct(F.lit(2).alias("place"), F.col("finished_at").alias("t")))).alias("x"))
    line = fixes.select("attempt_id", F.col("t").cast("double").alias("t"), F.lit(1).alias("turn"), F.lit(1).alias("place"), fix.alias("fix"))
    line = line.unionByName(ends.select("attempt_id", "x.t", F.lit(0).alias("turn"), "x.place"), allowMissingColumns=True)
    order = Window.partitionBy("attempt_id").orderBy("t", "turn", "place")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Between two fixes stand two bounds at most.
    near = {"l": F.coalesce(F.lag("fix", 1).over(order), F.lag("fix", 2).over(order)), "r": F.coalesce(F.lead("fix", 1).over(order), F.lead("fix", 2).over(order))}
    start = F.max(F.when(F.col("place") == 0, F.col("t"))).over(so_far)
    line = line.withColumns({**near, "start": start, "over": F.max((F.col("place") == 2).cast("int")).over(so_far)})
    e = F.when(F.abs(F.col("t") - F.col("l.t")) <= 0.5, F.col("l")).when(F.abs(F.col("r.t") - F.col("t")) <= 0.5, F.col("r"))
    share = (F.col("t") - F.col("l.t")) / (F.col("r.t") - F.col("l.t"))
    between = lambda c: F.col(f"l.{c}") + share * (F.col(f"r.{c}") - F.col(f"l.{c}"))
    both = F.col("l").isNotNull() & F.col("r").isNotNull() & (F.col("r.t") - F.col("l.t") <= K.GAP_MS)
    mixed = {**{c: between(c) for c in ("latitude", "longitude", "speed", "progress_m")}, "accuracy": F.greatest("l.accuracy", "r.accuracy"), "matched": F.col("l.matched") & F.col("r.matched")}
    mixed["matched"] = mixed["matched"] & mixed["progress_m"].isNotNull()
    inner = (F.col("place") == 1) & (F.col("over") == 0) & (F.col("t") > F.col("start"))
    bound = (F.col("place") != 1) & (F.col("e").isNotNull() | both)
    value = lambda c: F.when(F.col("place") == 1, F.col(f"fix.{c}")).when(F.col("e").isNotNull(), F.col(f"e.{c}")).otherwise(mixed[c]).alias(c)
    return line.withColumn("e", e).filter(inner | bound).select("attempt_id", "place", "t", *map(value, FIX))


def intervals(usable: DataFrame, runs: DataFrame) -> DataFrame:
    """attempt_id, n (from 1), label, start_ms, end_ms, and the fixes at both ends, over each run's official time.

    ``usable``: matched samples of usable_samples(); ``runs``: attempt_id, started_at,
    finished_at of runs that took time.  Pairs of fixes are judged alone if they are far
    apart in time or place, else by the last four seconds of close ones.
    """
    fixes = usable.select("attempt_id", "t", "latitude", "longitude", "accuracy", "speed", "progress_m", (F.col("quality") == "accepted").alias("matched"))
    runs = runs.filter("finished_at > started_at").select("attempt_id", "started_at", "finished_at")
    points = staged(_points(fixes, runs), "points")  # read for pairs and for what they cover

    order = Window.partitionBy("attempt_id").orderBy("place", "t")
    ends = [F.lead(c).over(order).alias(f"to_{c}") for c in ("t", *FIX)]
    pairs = points.select("attempt_id", "place", "t", *FIX, *ends).filter("to_t > t")
    both = F.col("progress_m").isNotNull() & F.col("to_progress_m").isNotNull()
    pairs = pairs.withColumns({"ms": F.col("to_t") - F.col("t"), "moved": haversine(F.col("latitude"), F.col("longitude"), F.col("to_latitude"), F.col("to_longitude")), "known": both, "signed": F.when(both, F.col("to_progress_m") - F.col("progress_m")).otherwise(0.0)})
    wild = (F.col("ms") > K.GAP_MS) | (F.col("moved") / (F.col("ms") / 1000) > K.PLAUSIBLE_MPS)
    fine = lambda c: F.col(c).isNull() | (F.col(c) <= K.GAP_ACCURACY_M)
    still = fine("accuracy") & fine("to_accuracy") & (F.col("moved") <= K.GAP_MOVE_M) & F.col("known") & (F.abs("signed") <= K.GAP_PROGRESS_M) & (F.abs("signed") / (F.col("ms") / 1000) < K.WALK_MPS)
    pairs = pairs.withColumns({"wild": wild, "still": still, "dense": ~wild & (F.col("ms") <= K.DENSE_MS)})
    upto = Window.partitionBy("attempt_id").orderBy("place", "t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pairs = pairs.withColumns({"island": F.sum((~F.col("dense")).cast("int")).over(upto), "end_us": F.floor(F.col("to_t") * 1000 + 0.5).cast("long")})

    recent = Window.partitionBy("attempt_id", "island", "dense").orderBy("end_us").rangeBetween(-(K.WINDOW_MS * 1000 - 1), 0)
    first = lambda c: F.first(c).over(recent)
    d = pairs.withColumns({
        "n_in": F.count("*").over(recent), "t_in": first("t"), "lat_in": first("latitude"), "lon_in": first("longitude"), "p_in": first("progress_m"), "all_known": F.min("known").over(recent),
        "sum_signed": F.sum(F.abs("signed")).over(recent), "sum_moved": F.sum("moved").over(recent), "forward": F.sum((F.col("signed") > K.FORWARD_M).cast("int")).over(recent),
    })
    seconds = (F.col("to_t") - F.col("t_in")) / 1000
    d = d.withColumns({"net_p": F.when(F.col("all_known"), F.abs(F.col("to_progress_m") - F.col("p_in"))).otherwise(0.0), "net_m": haversine(F.col("lat_in"), F.col("lon_in"), F.col("to_latitude"), F.col("to_longitude"))})
    steady = F.when(F.col("all_known"), F.when(F.col("sum_signed") < 1e-6, 1.0).otherwise(F.col("net_p") / F.col("sum_signed"))).otherwise(F.when(F.col("sum_moved") < 1e-6, 1.0).otherwise(F.least(F.lit(1.0), F.col("net_m") / F.col("sum_moved"))))
    geometric = F.when(F.col("all_known"), F.col("net_p")).otherwise(F.col("net_m")) / seconds
    usual = lambda c: F.when(~F.isnan(c) & F.col(c).between(0, K.PLAUSIBLE_MPS), F.col(c))
    reported = F.coalesce((usual("speed") + usual("to_speed")) / 2, usual("speed"), usual("to_speed"))
    speed = F.when(~F.col("all_known") & reported.isNotNull() & (geometric > K.WAIT_MPS) & (geometric < K.WALK_MPS), reported).otherwise(geometric)
    single = ((F.abs("signed") >= K.FORWARD_M) & (F.abs("signed") / (F.col("ms") / 1000) >= K.WALK_MPS)) | ((F.col("moved") >= K.SINGLE_MOVE_M) & (F.col("moved") / (F.col("ms") / 1000) >= K.WALK_MPS))
    sustained = F.when(F.col("n_in") == 1, single).otherwise((F.col("forward") >= K.FORWARD_INTERVALS) | (F.col("net_m") >= K.SINGLE_MOVE_M))
    close = F.when(steady < 0.5, "waiting").when(speed <= K.WAIT_MPS, "waiting").when((speed >= K.WALK_MPS) & sustained, "moving").otherwise("waiting")
    label = F.when(F.col("wild"), "unknown").when(F.col("dense"), close).when(F.col("still"), "waiting").otherwise("unknown")
    progress = lambda m, p: F.when(F.col(m), F.col(p))
    seen = d.select("attempt_id", label.alias("label"), F.col("t").alias("start_ms"), F.col("to_t").alias("end_ms"), progress("matched", "progress_m").alias("start_p"), progress("to_matched", "to_progress_m").alias("end_p"))

    # What no pair of fixes covers: all, the time before the first fix, the time after the last.
    cover = points.groupBy("attempt_id").agg(F.min(F.struct("place", "t", F.when(F.col("matched"), F.col("progress_m")).alias("p"))).alias("f"), F.max(F.struct("place", "t", F.when(F.col("matched"), F.col("progress_m")).alias("p"))).alias("l"))
    edge = runs.join(cover, "attempt_id", "left")
    nothing = F.lit(None).cast("double")
    head = edge.filter("f is not null and f.t > started_at").select("attempt_id", F.lit("unknown").alias("label"), F.col("started_at").alias("start_ms"), F.col("f.t").alias("end_ms"), nothing.alias("start_p"), F.col("f.p").alias("end_p"))
    tail = edge.filter("l is not null and l.t < finished_at").select("attempt_id", F.lit("unknown").alias("label"), F.col("l.t").alias("start_ms"), F.col("finished_at").alias("end_ms"), F.col("l.p").alias("start_p"), nothing.alias("end_p"))
    whole = edge.filter("f is null").select("attempt_id", F.lit("unknown").alias("label"), F.col("started_at").alias("start_ms"), F.col("finished_at").alias("end_ms"), nothing.alias("start_p"), nothing.alias("end_p"))
    rows = seen.unionByName(head).unionByName(tail).unionByName(whole)
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("attempt_id").orderBy("start_ms", "end_ms")))


def breakdown(labelled: DataFrame, runs: DataFrame) -> DataFrame:
    """attempt_id, official_ms, moving_ms, waiting_ms, unknown_ms, coverage and trust of every run."""
    ms = F.col("end_ms") - F.col("start_ms")
    sums = labelled.groupBy("attempt_id").agg(*[F.coalesce(F.sum(F.when(F.col("label") == x, ms)), F.lit(0.0)).alias(f"{x}_ms") for x in ("moving", "waiting", "unknown")])
    r = runs.select("attempt_id", F.greatest(F.lit(0.0), F.col("finished_at") - F.col("started_at")).alias("official_ms")).join(sums, "attempt_id", "left").fillna(0.0, ["moving_ms", "waiting_ms", "unknown_ms"])
    r = r.withColumn("coverage", F.when(F.col("official_ms") > 0, (F.col("moving_ms") + F.col("waiting_ms")) / F.col("official_ms")).otherwise(0.0))
    enough = (F.col("official_ms") > 0) & (F.col("coverage") >= K.COVERAGE)
    return r.withColumn("trust", F.when(enough & (F.col("unknown_ms") <= K.TOTAL_TOLERANCE_MS), "complete").when(enough, "partial").otherwise("unavailable"))


def reconciles(movement: DataFrame, tolerance_ms: float = K.TOTAL_TOLERANCE_MS) -> DataFrame:
    """attempt_id, whether its parts add up to its official time, and whether they may be shown."""
    gap = F.col("moving_ms") + F.col("waiting_ms") + F.col("unknown_ms") - F.col("official_ms")
    return movement.select("attempt_id", (F.abs(gap) <= tolerance_ms).alias("reconciles"), F.col("trust").isin("complete", "partial").alias("displayable"))


def wait_events(labelled: DataFrame, runs: DataFrame, courses: DataFrame) -> DataFrame:
    """attempt_id, wait_id, start_ms, end_ms (since the start), duration_ms, progress_m, latitude, longitude of each wait of three seconds or more.

    Waiting intervals join the wait before them if little time lies between and both are
    at about the same place, the mean of all places so far.  An attempt's intervals stream
    past in order; only the open wait is remembered.
    """

    def fold(key: tuple, slices: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None  # start, end, duration, sum and number of known places
        for part in slices:
            done = []
            for s, e, p, q in zip(*(part.column(c).to_pylist() for c in ("start_ms", "end_ms", "start_p", "end_p")), strict=True):
                known = [x for x in (p, q) if x is not None]
                if now is not None and 0 <= s - now[1] <= K.MERGE_GAP_MS and (now[4] == 0 and not known or now[4] > 0 and bool(known) and abs(sum(known) / len(known) - now[3] / now[4]) <= K.MERGE_PROGRESS_M):
                    total = now[3]
                    for x in known:  # one after another, as rounding depends on the order
                        total += x
                    now = [now[0], e, now[2] + (e - s), total, now[4] + len(known)]
                else:
                    done += [now] if now else []
                    now = [s, e, e - s, sum(known, 0.0), len(known)]
            yield out(key[0], done)
        yield out(key[0], [now] if now else [])

    def out(attempt: str, waits: list[list]) -> pa.RecordBatch:
        columns = list(zip(*waits, strict=True)) if waits else [[]] * 5
        place = [p / k if k else None for p, k in zip(columns[3], columns[4], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([attempt] * len(waits), pa.string()), *(pa.array(c, pa.float64()) for c in (*columns[:3], place))], names=["attempt_id", "s", "e", "d", "progress_m"])

    waiting = labelled.filter("label = 'waiting'").select("attempt_id", "n", "start_ms", "end_ms", "start_p", "end_p")
    rows = in_order(waiting, ["attempt_id"], ["n"], fold, "attempt_id string, s double, e double, d double, progress_m double").filter(F.col("d") >= K.VISIBLE_MS)
    rows = rows.join(runs.select("attempt_id", "route_id", "started_at"), "attempt_id")
    start = F.greatest(F.lit(0.0), F.col("s") - F.col("started_at"))
    rows = rows.select("attempt_id", "route_id", start.alias("start_ms"), F.greatest(start, F.col("e") - F.col("started_at")).alias("end_ms"), F.col("d").alias("duration_ms"), "progress_m")
    rows = rows.withColumn("wait_id", F.concat_ws(":", F.lit("wait"), plain(F.col("start_ms")), plain(F.col("end_ms"))))
    rows = staged(rows, "wait-folds")  # read for places and for the join
    marks = rows.filter("progress_m is not null").select("route_id", F.struct("attempt_id", "wait_id").alias("id"), "progress_m")
    at = points_at(marks, courses).select("id.attempt_id", "id.wait_id", "latitude", "longitude")
    return rows.join(at, ["attempt_id", "wait_id"], "left").withColumn("located", F.col("latitude").isNotNull())


def nearest_wait(waits: DataFrame, points: DataFrame, most_m: float = K.TAP_M) -> DataFrame:
    """The nearest located wait of its attempt to each point (attempt_id, point_id, latitude, longitude), if within ``most_m``."""
    p = points.select("attempt_id", "point_id", F.col("latitude").alias("p_lat"), F.col("longitude").alias("p_lon"))
    d = waits.filter("located").join(p, "attempt_id").withColumn("m", haversine(F.col("latitude"), F.col("longitude"), F.col("p_lat"), F.col("p_lon"))).filter(F.col("m") <= most_m)
    return d.groupBy("attempt_id", "point_id").agg(F.min(F.struct("m", "start_ms", "wait_id")).alias("b")).select("attempt_id", "point_id", F.col("b.wait_id").alias("wait_id"), F.col("b.m").alias("meters"))
