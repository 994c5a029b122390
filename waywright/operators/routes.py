"""Routes from recordings, and the checks of a course's layout."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.geo import haversine
from ..functions.text import fixed, in_locale
from .matching import _meters
from .streams import in_order


def derive_routes(samples: DataFrame) -> DataFrame:
    """One row a session: saveable, reason, path, distance_m, start and finish zones, from its samples.

    Poor fixes go; the path lies between the first and the last three moving samples in a
    row, thinned to steps of six metres from the last point kept.
    """
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    good = samples.filter(finite("latitude") & finite("longitude") & (F.col("accuracy").isNull() | (F.col("accuracy") <= K.ROUTE_ACCURACY_M)))
    order = Window.partitionBy("session_id").orderBy("recorded_at_ms", "id")
    step = haversine(F.lag("latitude").over(order), F.lag("longitude").over(order), F.col("latitude"), F.col("longitude"))
    rows = good.withColumn("i", F.row_number().over(order)).withColumn("moving", F.when(F.col("speed").isNotNull(), F.col("speed") >= K.MOVING_MPS).otherwise(F.coalesce(step >= K.STEP_M, F.lit(False))))
    run = F.col("moving") & F.lead("moving", 1).over(order) & F.lead("moving", 2).over(order)
    rows = rows.withColumn("run", F.coalesce(run, F.lit(False)))
    ends = rows.groupBy("session_id").agg(F.count("*").alias("n_good"), F.min(F.when(F.col("run"), F.col("i"))).alias("first"), (F.max(F.when(F.col("run"), F.col("i"))) + K.SUSTAINED - 1).alias("last"))
    trimmed = rows.join(ends, "session_id").filter(F.col("i").between(F.col("first"), F.col("last"))).select("session_id", "i", "latitude", "longitude", "speed")

    def thin(key: tuple, slices: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = None  # the last point kept
        for part in slices:
            kept = []
            for n, (lat, lon, speed) in enumerate(zip(*(part.column(c).to_pylist() for c in ("latitude", "longitude", "speed")), strict=True)):
                if back is None or ((speed is None or speed >= K.MOVING_MPS) and float(_meters(*back, lat, lon)) >= K.STEP_M):
                    back = (lat, lon)
                    kept.append(n)
            yield part.select(["session_id", "i", "latitude", "longitude"]).take(pa.array(kept, pa.int64()))

    kept = in_order(trimmed, ["session_id"], ["i"], thin, "session_id string, i int, latitude double, longitude double")
    spot = "array<struct<latitude:double,longitude:double>>"
    paths = kept.groupBy("session_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "latitude", "longitude"))), lambda x: F.struct(x["latitude"].alias("latitude"), x["longitude"].alias("longitude"))).alias("path"))
    corner = F.struct("i", "latitude", "longitude")
    corners = trimmed.groupBy("session_id").agg(F.min(corner).alias("a"), F.max(corner).alias("b"))

    from .matching import with_length

    every = samples.select("session_id").distinct()
    r = every.join(ends, "session_id", "left").join(paths, "session_id", "left").join(corners, "session_id", "left").withColumn("path", F.coalesce("path", F.array().cast(spot)))
    a, b = F.col("a"), F.col("b")
    apart = haversine(a["latitude"], a["longitude"], b["latitude"], b["longitude"])
    enough = (F.coalesce("n_good", F.lit(0)) >= K.LEAST_POINTS) & F.col("first").isNotNull() & (F.col("last") > F.col("first"))
    reason = F.when(~enough, "too_little_movement").when(apart < K.SEPARATION_M, "start_and_finish_too_close").when(F.size("path") < K.LEAST_POINTS, "too_little_movement")
    ok = reason.isNull()
    r = with_length(r.withColumn("reason", reason), "meters")
    zone = lambda p: F.when(ok, F.struct(p["latitude"].alias("latitude"), p["longitude"].alias("longitude"), F.lit(K.ZONE_RADIUS_M).alias("radius_m")))
    r = r.withColumns({"start_zone": zone(a), "finish_zone": zone(b)})
    return r.select("session_id", F.col("reason").isNull().alias("saveable"), "reason", F.when(F.col("reason").isNull(), F.col("path")).alias("path"), F.when(F.col("reason").isNull(), F.col("meters")).alias("distance_m"), "start_zone", "finish_zone")


def layout_problem(courses: DataFrame) -> DataFrame:
    """route_id, problem: the first rule that a course breaks, null if none: radii, names, markers in order and far enough apart."""
    low, high = K.RADIUS_RANGE_M
    marks = F.concat(F.array("start_p"), F.transform(F.sort_array(F.transform("checkpoints", lambda c: F.struct(c["progress_m"].alias("p"), c["id"].alias("id")))), lambda x: x["p"]), F.array("finish_p"))
    gaps = F.transform(F.sequence(F.lit(1), F.size("marks") - 1), lambda i: F.col("marks")[i] - F.col("marks")[i - 1])
    c = courses.withColumn("marks", marks)
    fine = lambda r: F.col(r).between(low, high) & ~F.isnan(r)
    blank = F.exists("checkpoints", lambda x: F.coalesce(F.trim(x["name"]), F.lit("")) == "")
    return c.select("route_id", F.when(~fine("start_r"), "start_radius").when(~fine("finish_r"), "finish_radius").when(blank, "checkpoint_name").when(F.exists(gaps, lambda g: g < K.MARKER_GAP_M), "markers_too_close").alias("problem"))


def layout_identity(courses: DataFrame) -> DataFrame:
    """route_id, identity: the numbers that timing depends on, as text in thousandths."""
    from .timing import course_numbers

    n = lambda c: F.when(c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), "nan").otherwise(fixed(c, 3))
    c = courses.join(course_numbers(courses).select("route_id", "trigger_p"), "route_id")
    cps = F.array_join(F.transform(F.sort_array(F.transform("checkpoints", lambda x: F.struct(x["progress_m"].alias("p"), in_locale(x["id"]).alias("in_locale"), x["id"].alias("id")))), lambda x: F.concat(x["id"], F.lit(":"), n(x["p"]))), ",")
    names = {"start": "start_p", "finish": "finish_p", "startR": "start_r", "finishR": "finish_r", "finishTrigger": "trigger_p"}
    return c.select("route_id", F.concat_ws("|", *[F.concat(F.lit(f"{k}="), n(F.col(v))) for k, v in names.items()], F.concat(F.lit("cp=["), cps, F.lit("]"))).alias("identity"))
