"""Hand-made courses and traces for the tests."""

from pyspark.sql import Row

LAT, LON, DEG, T0 = 32.08, 34.78, 111_320.0, 1_700_000_000_000
COURSE = "route_id string, path array<struct<latitude:double,longitude:double>>, start_r double, finish_r double, checkpoints array<struct<id:string,name:string,progress_m:double>>, start_p double"
SAMPLE = "attempt_id string, session_id string, route_id string, id string, recorded_at_ms long, latitude double, longitude double, accuracy double, speed double"


def course(spark, points=41, spacing=20.0, marks=(), start=0.0, radius=30.0, path=None):
    from waywright.operators.matching import with_length

    path = path or [(LAT + i * spacing / DEG, LON) for i in range(points)]
    rows = [Row(route_id="r", path=[Row(latitude=a, longitude=b) for a, b in path], start_r=radius, finish_r=radius, checkpoints=[Row(id=i, name=i, progress_m=float(p)) for i, p in marks], start_p=start)]
    return with_length(spark.createDataFrame(rows, COURSE), "finish_p")


def trace(attempt, steps, offset_s=0):
    """Samples from (second, metres north[, metres east[, accuracy]]) steps."""
    out = []
    for n, (t, north, *more) in enumerate(steps):
        east, acc = (*more, *(0.0, 5.0)[len(more) :])
        out.append((attempt, attempt, "r", f"{n:05d}", int(T0 + 1000 * (offset_s + t)), LAT + north / DEG, LON + east / (DEG * 0.8473), acc, None))
    return out


def samples(spark, *traces):
    return spark.createDataFrame([s for t in traces for s in t], SAMPLE)


def steady(until=800, step=5.0, begin=0.0):
    return [(i, begin + i * step) for i in range(int((until - begin) / step) + 1)]
