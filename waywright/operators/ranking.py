"""Eligibility, segments, ranks, personal bests, best segments and deltas, for all attempts at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import in_locale
from .prefix import dealt, with_earlier
from .timing import interior_checkpoints

SHOWN_REASONS = ("missing_start_coverage", "replay_incomplete", "missing_telemetry", "not_valid")


def _latest() -> list[Column]:
    """What tells attempts of one time apart; ids as readers order them."""
    return [F.col("armed_at_ms"), in_locale("attempt_id").alias("_in_locale"), F.col("attempt_id")]


def _best() -> list[Column]:
    return [F.col("official_ms"), F.col("started_at"), *_latest()]


def attempt_status(attempts: DataFrame, runs: DataFrame, courses: DataFrame) -> DataFrame:
    """Every attempt with eligible, reason (null if eligible), started_at, finished_at, official_ms; recorded times are not trusted.

    Attempts without a replay lack telemetry.  Other columns of the tables, whatever their names, are ignored.
    """
    own = attempts.select("attempt_id", "route_id", "armed_at_ms", "recorded_finished_at_ms", "lifecycle")
    replayed = runs.select("attempt_id", F.col("lifecycle").alias("replayed"), "validity", "started_at", "finished_at", "least_p")
    a = own.join(replayed, "attempt_id", "left").join(courses.select("route_id", "start_p"), "route_id")
    threshold = F.when(F.col("start_p") <= K.START_NOISE_M, K.START_NOISE_M).otherwise(F.col("start_p"))
    reason = (
        F.when(F.col("lifecycle") != "completed", "not_completed").when(F.col("replayed").isNull(), "missing_telemetry").when(F.col("replayed") != "completed", "replay_incomplete")
        .when(F.col("validity") != "valid", "not_valid").when(F.col("least_p").isNull() | (F.col("least_p") > threshold), "missing_start_coverage")
    )
    ok = F.col("reason").isNull()
    a = a.withColumn("reason", reason)
    return a.select("attempt_id", "route_id", "armed_at_ms", "recorded_finished_at_ms", "lifecycle", ok.alias("eligible"), "reason", F.when(ok, F.col("started_at")).alias("started_at"), F.when(ok, F.col("finished_at")).alias("finished_at"), F.when(ok, F.greatest(F.lit(0.0), F.col("finished_at") - F.col("started_at"))).alias("official_ms"))


def focused(status: DataFrame) -> DataFrame:
    """Every attempt with what the route's ranked attempts say of it: rank, is_pb, previous, the best before it, target, deltas.

    Before means an earlier finish (then arming, then id); an attempt that isn't eligible
    stands at its arming.  The comparison target is the route's best, or for the best itself
    the best before it.  Rank and deltas of an attempt that isn't eligible are null.
    """
    e = F.col("eligible")
    rows = status.withColumn("at", F.coalesce("finished_at", F.col("armed_at_ms").cast("double")))
    run = F.when(e, F.struct(*_best()))
    # Eligible ones in their order of rank; then all in order of time, with what lies before each.
    by_rank = [c.asc() for c in _best()]
    places = with_earlier(dealt(rows.filter(e).select("route_id", "official_ms", "started_at", "armed_at_ms", "attempt_id"), ["route_id"], by_rank, "by-rank"), ["route_id"], by_rank, {"before": ("count", F.lit(1))})
    best = rows.filter(e).groupBy("route_id").agg(F.min(F.struct(*_best())).alias("best"))
    by_time = [F.col("at").asc(), *[c.asc() for c in _latest()]]
    latest = F.when(e, F.struct("at", *_latest(), "official_ms"))
    timed = with_earlier(dealt(rows, ["route_id"], by_time, "by-time"), ["route_id"], by_time, {"pb_before": ("min", run), "previous": ("max", latest)})
    f = timed.join(places.select("attempt_id", (F.col("before") + 1).cast("int").alias("rank")), "attempt_id", "left").join(best, "route_id", "left")
    is_pb = F.coalesce(F.col("best.attempt_id") == F.col("attempt_id"), F.lit(False))
    f = f.withColumns({"is_pb": is_pb, "best_id": F.col("best.attempt_id"), "best_ms": F.col("best.official_ms"), "previous_id": F.col("previous.attempt_id"), "previous_ms": F.col("previous.official_ms"), "pb_before_id": F.col("pb_before.attempt_id"), "pb_before_ms": F.col("pb_before.official_ms")})
    versus = F.when(F.col("is_pb"), F.col("pb_before_ms")).otherwise(F.col("best_ms"))
    f = f.withColumns({"target_id": F.when(F.col("is_pb"), F.col("pb_before_id")).otherwise(F.col("best_id")), "delta_pb_ms": F.col("official_ms") - versus, "delta_previous_ms": F.col("official_ms") - F.col("previous_ms")})
    return f.drop("at", "best", "previous", "pb_before")


def ranked(focus: DataFrame) -> DataFrame:
    """The eligible ones of focused()."""
    return focus.filter("eligible").drop("eligible", "reason")


def route_summary(status: DataFrame, courses: DataFrame, segments: DataFrame) -> DataFrame:
    """Each route's number of ranked attempts, best, latest and sum of best segments (null unless every segment has a best)."""
    e = status.filter("eligible")
    latest = F.max(F.struct("finished_at", *_latest(), "official_ms"))
    s = e.groupBy("route_id").agg(F.count("*").alias("ranked"), F.min(F.struct(*_best())).alias("b"), latest.alias("l"))
    s = s.select("route_id", "ranked", F.col("b.attempt_id").alias("pb_id"), F.col("b.official_ms").alias("pb_ms"), F.col("l.attempt_id").alias("last_id"), F.col("l.official_ms").alias("last_ms"))
    total = gold_segments(segments).groupBy("route_id").agg(F.when(F.count("gold_ms") == F.count("*"), F.sum("gold_ms")).alias("sum_of_best_ms"))
    return courses.select("route_id").join(s, "route_id", "left").join(total, "route_id", "left").withColumn("ranked", F.coalesce("ranked", F.lit(0)))


def segment_times(ranked_attempts: DataFrame, crossed: DataFrame, courses: DataFrame) -> DataFrame:
    """attempt_id, route_id, seg (from 1), segment_id, from_ms, to_ms, duration_ms of every course segment of eligible attempts.

    A crossing counts if it lies within the attempt and after all counted ones of earlier
    checkpoints; a segment that lacks an end has no duration.
    """
    runs = ranked_attempts.select("attempt_id", "route_id", "started_at", "finished_at")
    cps = interior_checkpoints(courses)
    inside = crossed.drop("route_id").join(runs, "attempt_id").filter(F.col("crossed_at").between(F.col("started_at"), F.col("finished_at")))
    before = Window.partitionBy("attempt_id").orderBy("cp_order").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("seen", F.coalesce(F.max("crossed_at").over(before), F.col("started_at"))).filter(F.col("crossed_at") > F.greatest("seen", "started_at"))
    marks = runs.join(cps, "route_id").join(inside.select("attempt_id", "checkpoint_id", "crossed_at"), ["attempt_id", "checkpoint_id"], "left").select("attempt_id", "route_id", "cp_order", F.col("checkpoint_id").alias("mark"), F.col("crossed_at").alias("at"))
    ends = runs.select("attempt_id", "route_id", F.lit(0).alias("cp_order"), F.lit("start").alias("mark"), F.col("started_at").alias("at")).unionByName(marks).unionByName(runs.select("attempt_id", "route_id", F.lit(1 << 30).alias("cp_order"), F.lit("finish").alias("mark"), F.col("finished_at").alias("at")))
    order = Window.partitionBy("attempt_id").orderBy("cp_order")
    rows = ends.withColumns({"seg": F.row_number().over(order), "to_mark": F.lead("mark").over(order), "to_ms": F.lead("at").over(order)}).filter("to_mark is not null")
    return rows.select("attempt_id", "route_id", "seg", F.concat("mark", F.lit("->"), "to_mark").alias("segment_id"), F.col("at").alias("from_ms"), "to_ms", F.when(F.col("to_ms") >= F.col("at"), F.col("to_ms") - F.col("at")).alias("duration_ms"))


def gold_segments(segments: DataFrame) -> DataFrame:
    return segments.groupBy("route_id", "seg", "segment_id").agg(F.min("duration_ms").alias("gold_ms"))


def segment_deltas(segments: DataFrame, ranked_attempts: DataFrame) -> DataFrame:
    """Segments with the target's duration, the difference, and whether the duration was the segment's best when it was set."""
    when = ranked_attempts.select("attempt_id", "target_id", "finished_at", "armed_at_ms")
    other = segments.select(F.col("attempt_id").alias("target_id"), "seg", F.col("duration_ms").alias("target_ms"))
    rows = segments.join(when, "attempt_id").join(other, ["target_id", "seg"], "left").join(gold_segments(segments).select("route_id", "seg", "gold_ms"), ["route_id", "seg"])
    order = [F.col("finished_at").asc(), *[c.asc() for c in _latest()]]
    rows = with_earlier(dealt(rows, ["route_id", "seg"], order, "segments-by-time"), ["route_id", "seg"], order, {"gold_before": ("min", F.col("duration_ms"))})
    new = (F.col("duration_ms") == F.col("gold_ms")) & (F.col("gold_before").isNull() | (F.col("duration_ms") < F.col("gold_before")))
    first = F.col("gold_before").isNull() & F.col("duration_ms").isNotNull()
    return rows.select("attempt_id", "route_id", "seg", "segment_id", "duration_ms", "target_ms", (F.col("duration_ms") - F.col("target_ms")).alias("delta_ms"), F.coalesce(new, F.lit(False)).alias("is_new_gold"), first.alias("is_first"))


def focus_segments(focus: DataFrame, segments: DataFrame, courses: DataFrame) -> DataFrame:
    """attempt_id, seg, segment_id, duration_ms, target_ms, delta_ms, gold_ms of every attempt and segment of its course; an attempt that isn't eligible has no durations of its own."""
    ends = interior_checkpoints(courses).select("route_id", "cp_order", F.col("checkpoint_id").alias("mark"))
    marks = courses.select("route_id", F.lit(0).alias("cp_order"), F.lit("start").alias("mark")).unionByName(ends).unionByName(courses.select("route_id", F.lit(1 << 30).alias("cp_order"), F.lit("finish").alias("mark")))
    order = Window.partitionBy("route_id").orderBy("cp_order")
    specs = marks.withColumns({"seg": F.row_number().over(order), "to": F.lead("mark").over(order)}).filter("to is not null").select("route_id", "seg", F.concat("mark", F.lit("->"), "to").alias("segment_id"))
    own = segments.select("attempt_id", "seg", "duration_ms")
    other = segments.select(F.col("attempt_id").alias("target_id"), "seg", F.col("duration_ms").alias("target_ms"))
    rows = focus.select("attempt_id", "route_id", "target_id").join(specs, "route_id").join(own, ["attempt_id", "seg"], "left").join(other, ["target_id", "seg"], "left").join(gold_segments(segments).select("route_id", "seg", "gold_ms"), ["route_id", "seg"], "left")
    return rows.select("attempt_id", "seg", "segment_id", "duration_ms", "target_ms", (F.col("duration_ms") - F.col("target_ms")).alias("delta_ms"), "gold_ms")


def history(status: DataFrame, ranked_attempts: DataFrame) -> DataFrame:
    """Attempts worth showing, latest first by place (from 1), with rank where eligible."""
    shown = status.filter(F.col("eligible") | ((F.col("lifecycle") == "completed") & F.col("reason").isin(*SHOWN_REASONS)))
    rows = shown.join(ranked_attempts.select("attempt_id", "rank", "is_pb"), "attempt_id", "left").withColumn("shown_at", F.coalesce("finished_at", "recorded_finished_at_ms", F.col("armed_at_ms").cast("double")))
    latest = [F.desc("shown_at"), *[c.desc() for c in _latest()]]
    rows = with_earlier(dealt(rows, ["route_id"], latest, "by-latest"), ["route_id"], latest, {"later": ("count", F.lit(1))})
    return rows.select("route_id", "attempt_id", (F.col("later") + 1).cast("int").alias("place"), "rank", F.coalesce("is_pb", F.lit(False)).alias("is_pb"), "eligible", "reason", "official_ms")
