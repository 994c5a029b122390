"""Waiting compared between an attempt and its target: places where either waited, and what is left over."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.geo import haversine, plain
from ..functions.text import in_locale
from ..sources.staging import staged
from .matching import points_at
from .streams import in_order


def _linked(at: list[float], *amounts: list[float]) -> list[tuple]:
    """Complete linkage of places in order along a line: the closest means first, as long as a cluster spans no more than the radius.

    Returns first and last place, the sum of both's and all places between, and the sums of
    ``amounts``.  Equal distances go by the union's ends, then by its first place.  Of clusters
    on a line, the two with the closest means are neighbours, so a heap holds the pairs of
    neighbours only.  A union's sums are those of its two parts added up, as rounding, and with
    it which of two equal distances is less, depends on the order.
    """
    n = len(at)
    first, last = list(range(n)), list(range(n))
    sums = list(zip(at, *amounts, strict=True))
    before, after, gone = list(range(-1, n - 1)), [*range(1, n), -1], [False] * n
    heap: list[tuple] = []

    def offer(a: int, b: int) -> None:
        if a >= 0 and b >= 0 and at[last[b]] - at[first[a]] <= K.CLUSTER_M:
            mean = [sums[x][0] / (last[x] - first[x] + 1) for x in (a, b)]
            heapq.heappush(heap, (abs(mean[0] - mean[1]), at[first[a]], at[last[b]], first[a], a, b))

    for k in range(n - 1):
        offer(k, k + 1)
    while heap:
        *_, a, b = heapq.heappop(heap)
        if gone[a] or gone[b]:
            continue
        own = len(first)
        first.append(first[a])
        last.append(last[b])
        sums.append(tuple(x + y for x, y in zip(sums[a], sums[b], strict=True)))
        before.append(before[a])
        after.append(after[b])
        gone.append(False)
        gone[a] = gone[b] = True
        if before[own] >= 0:
            after[before[own]] = own
        if after[own] >= 0:
            before[after[own]] = own
        offer(before[own], own)
        offer(own, after[own])
    return [(first[k], last[k], *sums[k]) for k in range(len(first)) if not gone[k]]


def _clusters(at: list[float], keys: list[str] | None = None) -> list[list[int]]:
    """_linked() of places in any order, as lists of them; equal places go by their keys, or as they stand."""
    line = sorted(range(len(at)), key=lambda i: (at[i], keys[i] if keys else i))
    return [line[a : b + 1] for a, b, _ in _linked([at[i] for i in line])]


def wait_clusters(waits: DataFrame, focus: DataFrame, courses: DataFrame) -> DataFrame:
    """attempt_id, target_id, location_id, cluster, progress_m, latitude, longitude, current_ms, reference_ms, delta_ms, match_state, span_m, members, the waits' ids on either side, shown.

    Located waits of each eligible attempt and of its target are clustered by place.  They stream
    past in order along the course; waits farther apart than the radius never share a cluster, so
    those between two such gaps are clustered on their own, and only they are remembered.
    """
    pairs = focus.filter("eligible and target_id is not null").select("attempt_id", "target_id", "route_id")
    w = waits.filter("located").select("attempt_id", "wait_id", "start_ms", "duration_ms", "progress_m")
    mine = pairs.join(w, "attempt_id").withColumn("side", F.lit(0))
    theirs = pairs.join(w.withColumnRenamed("attempt_id", "target_id"), "target_id").withColumn("side", F.lit(1))
    members = mine.unionByName(theirs).withColumn("key", F.concat_ws("|", F.col("side").cast("string"), plain(F.col("start_ms")), "wait_id"))
    ids = Window.partitionBy("attempt_id").orderBy("side", "start_ms", in_locale("wait_id"), "wait_id")
    members = members.withColumn("nth", F.row_number().over(ids)).select("attempt_id", "target_id", "route_id", "nth", "side", "progress_m", "duration_ms", "wait_id", "key")
    schema = "attempt_id string, target_id string, route_id string, location_id string, progress_m double, current_ms double, reference_ms double, span_m double, members int, current_ids array<string>, reference_ids array<string>"
    names, texts = [c.split()[0] for c in schema.split(", ")], pa.list_(pa.string())
    types = [pa.string()] * 4 + [pa.float64()] * 4 + [pa.int32(), texts, texts]

    def places(near: list[tuple]) -> Iterator[tuple]:
        nth, side, at, ms, ids, keys = zip(*near, strict=True)
        own = [[m if s == k else 0.0 for m, s in zip(ms, side, strict=True)] for k in (0, 1)]
        for a, b, total, *sums in _linked(at, *own):
            g = sorted(range(a, b + 1), key=lambda i: nth[i])  # members in order of side, start and id
            yield "wait-cmp:" + ";".join(keys[i] for i in g), total / len(g), *sums, at[b] - at[a], len(g), *([ids[i] for i in g if side[i] == k] for k in (0, 1))

    def group(key: tuple, slices: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near: list[tuple] = []  # waits, each no farther from the one before than the radius
        whose = ()

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*((*whose, *r) for r in rows), strict=True), types, strict=True)], names=names)

        for part in slices:
            whose = tuple(part.column(c)[0].as_py() for c in names[:3])
            done: list[tuple] = []
            for row in zip(*(part.column(c).to_pylist() for c in ("nth", "side", "progress_m", "duration_ms", "wait_id", "key")), strict=True):
                if near and row[2] - near[-1][2] > K.CLUSTER_M:
                    done += places(near)
                    near = []
                near.append(row)
            if done:
                yield out(done)
        yield out(list(places(near)))

    c = staged(in_order(members, ["attempt_id"], ["progress_m", "nth"], group, schema), "wait-places").withColumn("delta_ms", F.col("current_ms") - F.col("reference_ms"))
    c = c.withColumn("match_state", F.when((F.col("current_ms") > 0) & (F.col("reference_ms") > 0), "matched").when(F.col("current_ms") > 0, "current-only").otherwise("reference-only"))
    big = F.abs("delta_ms") >= K.SHOWN_MS
    order = Window.partitionBy("attempt_id", big).orderBy(F.desc(F.abs("delta_ms")), "progress_m", in_locale("location_id"), "location_id")
    c = c.withColumns({"shown": big & (F.row_number().over(order) <= K.SHOWN_ROWS), "cluster": F.row_number().over(Window.partitionBy("attempt_id").orderBy("progress_m", in_locale("location_id"), "location_id")) - 1})
    marks = c.select("route_id", F.struct("attempt_id", "location_id").alias("id"), "progress_m")
    at = points_at(marks, courses).select("id.attempt_id", "id.location_id", "latitude", "longitude")
    return c.join(at, ["attempt_id", "location_id"], "left")


def nearest_location(clusters: DataFrame, points: DataFrame, most_m: float = K.TAP_M) -> DataFrame:
    """The nearest place of an attempt's comparison to each point (attempt_id, point_id, latitude, longitude), if within ``most_m``; the first along the course wins ties."""
    p = points.select("attempt_id", "point_id", F.col("latitude").alias("p_lat"), F.col("longitude").alias("p_lon"))
    d = clusters.filter("latitude is not null").join(p, "attempt_id").withColumn("m", haversine(F.col("latitude"), F.col("longitude"), F.col("p_lat"), F.col("p_lon"))).filter(F.col("m") <= most_m)
    return d.groupBy("attempt_id", "point_id").agg(F.min(F.struct("m", "cluster", "location_id")).alias("b")).select("attempt_id", "point_id", "b.location_id", F.col("b.cluster").alias("cluster"), F.col("b.m").alias("meters"))


def wait_comparison(clusters: DataFrame, waits: DataFrame, movement: DataFrame, focus: DataFrame) -> DataFrame:
    """One row an attempt, eligible or not: reason it can't be compared (null if it can), totals, delta, and where the delta lies.

    A comparison that can't be made holds the totals of waiting and nothing else: other figures are 0.
    """
    events = waits.groupBy("attempt_id").agg(F.sum("duration_ms").alias("events"), F.sum(F.when(~F.col("located"), F.col("duration_ms")).otherwise(0.0)).alias("nowhere"))
    facts = movement.select("attempt_id", "waiting_ms", F.col("trust").isin("complete", "partial").alias("good")).join(events, "attempt_id", "left").withColumnRenamed("attempt_id", "member")
    # Both sides of each pair as rows, so that what is known of attempts is joined once.
    sides = focus.select("attempt_id", "target_id", "eligible", F.posexplode(F.array("attempt_id", "target_id")).alias("side", "member"))
    known = sides.join(facts, "member", "left")
    of = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    names = ("waiting_ms", "good", "events", "nowhere")
    r = known.groupBy("attempt_id", "target_id", "eligible").agg(*[of(k, c).alias(f"{c}_{k}") for k in (0, 1) for c in names])
    c = clusters.groupBy("attempt_id").agg(F.sum("current_ms").alias("placed_0"), F.sum("reference_ms").alias("placed_1"), F.sum(F.when(F.col("shown"), F.col("delta_ms")).otherwise(0.0)).alias("shown"), F.sum(F.when(~F.col("shown"), F.col("delta_ms")).otherwise(0.0)).alias("hidden"))
    r = r.join(c, "attempt_id", "left").fillna(0.0, ["waiting_ms_0", "waiting_ms_1", "events_0", "nowhere_0", "events_1", "nowhere_1", "placed_0", "placed_1", "shown", "hidden"])
    here, there = F.col("good_0").isNotNull(), F.col("good_1").isNotNull()
    reason = (
        F.when(~F.col("eligible") | ~here, "current_not_eligible").when(F.col("target_id").isNull(), "missing_comparison_target").when(~there, "reference_not_eligible")
        .when(~F.col("good_0"), "current_movement_not_displayable").when(~F.col("good_1"), "reference_movement_not_displayable")
    )
    r = r.withColumn("reason", reason)
    made = lambda x: F.when(F.col("reason").isNull(), x).otherwise(0.0)
    short = lambda k: F.greatest(F.lit(0.0), F.col(f"waiting_ms_{k}") - F.col(f"events_{k}"))
    theirs = F.when(F.coalesce(F.col("reason") == "missing_comparison_target", F.lit(False)), 0.0).otherwise(F.col("waiting_ms_1"))
    return r.select(
        "attempt_id", "target_id", "reason", F.col("waiting_ms_0").alias("waiting_ms"), theirs.alias("reference_ms"), made(F.col("waiting_ms_0") - F.col("waiting_ms_1")).alias("delta_ms"),
        made(F.col("placed_0")).alias("placed_ms"), made(F.col("placed_1")).alias("reference_placed_ms"), made(F.col("nowhere_0")).alias("unlocated_ms"), made(F.col("nowhere_1")).alias("reference_unlocated_ms"),
        made(short(0)).alias("short_ms"), made(short(1)).alias("reference_short_ms"), made(F.col("shown")).alias("shown_delta_ms"), made(F.col("hidden")).alias("hidden_delta_ms"),
    )
