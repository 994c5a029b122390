"""Sources and sinks: location samples, courses and attempts; the bridge from the driver's events.

Real deployments read samples from Parquet (or a stream) with the columns of SAMPLE_SCHEMA.
The driver's tables hold no positions, so ``synthetic_samples`` derives traces from events
by fixed formulas, which the checking SQL repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.geo import ring
from ..functions.text import fixed
from .staging import staged
from .store import Store, Table

SAMPLE_SCHEMA = "id string, session_id string, recorded_at_ms long, latitude double, longitude double, accuracy double, speed double, heading double"
SAMPLE_COLUMNS = [c.split()[0] for c in SAMPLE_SCHEMA.split(", ")]
BASE_MS, BASE_LAT, BASE_LON = 1_700_000_000_000, 32.08, 34.78
POINTS, SPACING_M = 16, 20.0


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def clean_fixes(fixes: DataFrame) -> DataFrame:
    """Raw fixes to samples: impossible times and places go, unusable optional values become null."""
    t, lat, lon = F.col("recorded_at_ms").cast("double"), F.col("latitude"), F.col("longitude")
    kept = fixes.filter(_finite(t) & (t > 0) & _finite(lat) & _finite(lon) & (F.abs(lat) <= 90) & (F.abs(lon) <= 180))
    least_zero = lambda c: F.when(_finite(F.col(c)) & (F.col(c) >= 0), F.col(c))
    heading = F.when(_finite(F.col("heading")) & F.col("heading").between(0, 360), F.col("heading"))
    return kept.withColumns({"accuracy": least_zero("accuracy"), "speed": least_zero("speed"), "heading": heading})


#: Samples lie in buckets by their session, in order of time.
SAMPLES = Table(SAMPLE_SCHEMA, ("id",), "session_id", 64, ("session_id", "recorded_at_ms", "id"))


def sample_store(spark: SparkSession, path: str) -> Store:
    return Store(spark, path, {"samples": SAMPLES})


def append_samples(samples: DataFrame, sessions: DataFrame, path: str, arrival: str = "recorded_at_ms") -> int:
    """Store the samples of active sessions; a sample whose id is stored already replaces it.  Returns how many different ones this call stored.

    Of samples with one id in one call, the last by ``arrival`` stays.  An id belongs to one
    session.  Calls add up to few files, however many there are; see Store.
    """
    active = sessions.filter("is_active").select(F.col("id").alias("session_id"))
    last = Window.partitionBy("id").orderBy(F.desc(arrival), F.desc("session_id"))
    kept = staged(samples.join(active, "session_id", "left_semi").withColumn("_n", F.row_number().over(last)).filter("_n = 1").select(*SAMPLE_COLUMNS), "samples")
    n = kept.count()
    if n:
        sample_store(samples.sparkSession, path).commit({"samples": kept})
    return n


def record_fixes(fixes: DataFrame, sessions: DataFrame, path: str) -> int:
    """Store raw fixes (session_id, id and their values) of active sessions as samples; returns how many of them could be read as such."""
    active = sessions.filter("is_active").select(F.col("id").alias("session_id"))
    parsed = staged(clean_fixes(fixes).join(active, "session_id", "left_semi"), "fixes")
    append_samples(parsed, sessions, path)
    return parsed.count()


def read_samples(spark: SparkSession, path: str, sessions: list[str] | DataFrame | None = None) -> DataFrame:
    """The samples that append_samples() stored, or those of some sessions, of which only their buckets are read."""
    return sample_store(spark, path).read("samples", of=sessions)


def sample_line(samples: DataFrame) -> DataFrame:
    """(id, line): a sample as text: time in UTC, place, accuracy, speed, heading."""
    at = F.date_format(F.to_utc_timestamp(F.timestamp_millis("recorded_at_ms"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    or_none = lambda c, text, none: F.when(F.col(c).isNull(), none).otherwise(text)
    accuracy = or_none("accuracy", F.concat(F.lit("±"), fixed(F.col("accuracy"), 1), F.lit("m")), "acc n/a")
    speed = or_none("speed", F.concat(fixed(F.col("speed"), 1), F.lit("m/s")), "spd n/a")
    heading = or_none("heading", F.concat(fixed(F.col("heading"), 0), F.lit("°")), "hdg n/a")
    return samples.select("id", F.concat_ws("  ", at, F.concat_ws(", ", fixed(F.col("latitude"), 6), fixed(F.col("longitude"), 6)), accuracy, speed, heading).alias("line"))


def course_geojson(courses: DataFrame, waits: DataFrame | None = None, selected: str | None = None) -> DataFrame:
    """(route_id, geojson): a feature collection of each course: path, zones and their centres, checkpoints and, if given, located waits.

    ``waits``: route_id, wait_id, latitude, longitude; the one whose id is ``selected`` says so.
    """
    from ..operators.matching import points_at

    first, last = F.col("path")[0], F.element_at("path", -1)
    point = lambda p: F.array(p["longitude"], p["latitude"])
    spot = lambda p: F.struct(F.lit("Point").alias("type"), point(p).alias("coordinates"))
    line = F.struct(F.lit("LineString").alias("type"), F.transform("path", point).alias("coordinates"))
    zone = lambda p, r: F.struct(F.lit("Polygon").alias("type"), F.array(ring(p["latitude"], p["longitude"], F.col(r))).alias("coordinates"))

    def feature(kind: str, geometry: Column, **more: Column) -> Column:
        return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit(kind).alias("kind"), *[c.alias(n) for n, c in more.items()]).alias("properties"), geometry.alias("geometry")))

    marks = courses.select("route_id", F.explode("checkpoints").alias("c")).select("route_id", F.col("c").alias("id"), F.col("c.progress_m").alias("progress_m"))
    at = points_at(marks, courses).select("route_id", "progress_m", "id", F.struct("latitude", "longitude").alias("p"))
    at = at.select("route_id", F.struct("progress_m", "id.id", feature("checkpoint", spot(F.col("p")), id=F.col("id.id"), name=F.col("id.name")).alias("json")).alias("x"))
    listed = at.groupBy("route_id").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["json"]).alias("marks"))
    rows = courses.join(listed, "route_id", "left")
    if waits is not None:
        w = waits.filter("latitude is not null").select("route_id", F.struct("wait_id", feature("wait", spot(F.struct("latitude", "longitude")), id=F.col("wait_id"), selected=F.when(F.col("wait_id") == F.lit(selected), "yes").otherwise("no")).alias("json")).alias("x"))
        rows = rows.join(w.groupBy("route_id").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["json"]).alias("waits")), "route_id", "left")
    none = F.array().cast("array<string>")
    parts = [F.array(feature("path", line), feature("start-zone", zone(first, "start_r")), feature("start", spot(first)), feature("finish-zone", zone(last, "finish_r")), feature("finish", spot(last))), F.coalesce("marks", none)]
    parts += [F.coalesce("waits", none)] * (waits is not None)
    return rows.select("route_id", F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.concat(*parts), ","), F.lit("]}")).alias("geojson"))


def synthetic_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces from events: attempt_id, session_id, route_id, id, recorded_at_ms, latitude, longitude, accuracy, speed, heading.

    Ordered by time and event id within a user, each event is a step north: none for an
    error, else 4 to 12 m; a second passes, or 6 to 15.9 s at an error.  Some users begin
    further on, some step back at views, and some stay 120 m east of the course for a while.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("int")
    stop, user = F.col("event_type") == "error", F.col("user_id")
    rows = events.filter("user_id is not null").select("event_id", "user_id", "ts", "event_type", F.coalesce(k, F.lit(0)).alias("k"))
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = rows.withColumn("n", F.row_number().over(order))
    away = ((user % 7 == 3) & F.col("n").between(12, 21)) | ((user % 7 == 5) & F.col("n").between(12, 56))
    step = F.when(away | stop, 0.0).when((user % 13 == 4) & (F.col("event_type") == "view"), -5.0).otherwise(4.0 + F.col("k") % 9)
    rows = rows.withColumns({"away": away, "step": step, "dt": F.when(stop, 6000 + 100 * F.col("k")).otherwise(1000).cast("long")})
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begin = F.when(user % 11 == 2, 12.0).when(user % 11 == 6, 45.0).otherwise(0.0)
    rows = rows.withColumns({"at": F.sum("dt").over(run), "along": F.greatest(F.lit(0.0), F.sum("step").over(run) - 4.0 + begin)})
    name = user.cast("string")
    return rows.select(
        name.alias("attempt_id"), name.alias("session_id"), (user % 5).cast("string").alias("route_id"), F.col("event_id").cast("string").alias("id"),
        (F.lit(BASE_MS) + user * 10_000_000 + F.col("at")).cast("long").alias("recorded_at_ms"),
        (F.lit(BASE_LAT) + F.col("along") / K.METERS_PER_DEGREE).alias("latitude"), F.when(F.col("away"), F.lit(BASE_LON + 0.00127)).otherwise(F.lit(BASE_LON)).alias("longitude"),
        F.when(F.col("k") == 99, 60.0).when(F.col("k") != 98, 3.0 + F.col("k") % 30).alias("accuracy"),
        F.when(F.col("event_type") != "signup", F.abs("step") * 1000.0 / F.col("dt")).alias("speed"), F.when(F.col("k") != 97, F.col("k") * 3.5).alias("heading"),
    )


def synthetic_courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A straight northward course of 300 m for each region: route_id, path, radii, checkpoints, start and finish progress; the last one starts at 40 m."""
    from ..operators.matching import with_length

    step = SPACING_M / K.METERS_PER_DEGREE
    point = lambda i: F.struct((F.lit(BASE_LAT) + i * F.lit(step)).alias("latitude"), F.lit(BASE_LON).alias("longitude"))
    marks = F.array(*[F.struct(F.lit(f"cp{i}").alias("id"), F.lit(f"Checkpoint {i}").alias("name"), F.lit(100.0 * i).alias("progress_m")) for i in (1, 2)])
    regions = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_regionkey").cast("string").alias("route_id"))
    plain = regions.select("route_id", F.transform(F.sequence(F.lit(0), F.lit(POINTS - 1)), point).alias("path"), F.lit(K.ZONE_RADIUS_M).alias("start_r"), F.lit(K.ZONE_RADIUS_M).alias("finish_r"), marks.alias("checkpoints"), F.when(F.col("route_id") == "4", 40.0).otherwise(0.0).alias("start_p"))
    return with_length(plain, "finish_p")


WINDING = 39  # the last point's place on the winding path


def _winding(i: Column) -> tuple[Column, Column]:
    """Steps eastwards and northwards of a point of the winding path: it bends, crosses its beginning, and goes back along the way it came."""
    x = F.when(i <= 10, i).when(i <= 15, 10).when(i <= 25, 25 - i).when(i <= 32, i - 25).otherwise(39 - i)
    y = F.when(i <= 10, 0).when(i <= 15, i - 10).when(i <= 25, 5).when(i <= 32, 30 - i).otherwise(i - 34)
    north = F.lit(BASE_LAT) + y * F.lit(SPACING_M / K.METERS_PER_DEGREE)
    return north, F.lit(BASE_LON) + x * F.lit(SPACING_M / (K.METERS_PER_DEGREE * 0.85))


def winding_courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The winding path for each region: one starts at 40 m, one beyond the path's end, so that no sample lies near where it might begin."""
    from ..operators.matching import with_length

    place = lambda i: F.struct(_winding(i)[0].alias("latitude"), _winding(i)[1].alias("longitude"))
    none = F.array().cast("array<struct<id:string,name:string,progress_m:double>>")
    regions = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_regionkey").cast("string").alias("route_id"))
    start = F.when(F.col("route_id") == "3", 40.0).when(F.col("route_id") == "4", 5000.0).otherwise(0.0)
    rows = regions.select("route_id", F.transform(F.sequence(F.lit(0), F.lit(WINDING)), place).alias("path"), F.lit(K.ZONE_RADIUS_M).alias("start_r"), F.lit(K.ZONE_RADIUS_M).alias("finish_r"), none.alias("checkpoints"), start.alias("start_p"))
    return with_length(rows, "finish_p")


def winding_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces from events along the winding path, about six metres an event, beside it by up to some metres.

    Every fourth event has the time of the one before it, some users leave the path for good,
    and some are on a route that doesn't exist.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet").filter("user_id is not null")
    k, user, n, event = F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0)), F.col("user_id"), F.col("n"), F.col("event_id")
    rows = events.select("event_id", "user_id", k.alias("k"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("n"))
    rows = rows.withColumn("f", F.least(F.lit(WINDING - 0.01), (6.0 * (n - 1) + F.col("k") % 4) / 20.0)).withColumn("i", F.floor("f").cast("int"))
    (a, b), (c, d), part = _winding(F.col("i")), _winding(F.col("i") + 1), F.col("f") - F.col("i")
    off = F.when((user % 6 == 5) & (n > 20), 0.002).otherwise(0.0)
    return rows.select(
        user.cast("string").alias("attempt_id"), user.cast("string").alias("session_id"), F.when(user % 11 == 7, "nowhere").otherwise((user % 5).cast("string")).alias("route_id"), event.cast("string").alias("id"),
        (F.lit(BASE_MS) + user * 10_000_000 + 1000 * (n - F.when(n % 4 == 1, 1).otherwise(0))).cast("long").alias("recorded_at_ms"),
        (a + (c - a) * part + off + (event % 7 - 3) * 0.00001).alias("latitude"), (b + (d - b) * part + (event % 5 - 2) * 0.00002).alias("longitude"),
        F.when(F.col("k") == 99, 60.0).when(F.col("k") != 98, 3.0 + F.col("k") % 30).alias("accuracy"), F.lit(None).cast("double").alias("speed"), F.lit(None).cast("double").alias("heading"),
    )


def synthetic_attempts(samples: DataFrame) -> DataFrame:
    """attempt_id, route_id, lifecycle, armed_at_ms and the recorded finish: one completed attempt a trace."""
    return samples.groupBy("attempt_id", "route_id").agg((F.min("recorded_at_ms") - 1000).alias("armed_at_ms")).withColumns({"lifecycle": F.lit("completed"), "recorded_finished_at_ms": F.lit(None).cast("double")})
