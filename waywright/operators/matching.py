"""Course geometry, projections onto it, and the sequential matching of samples."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.geo import extent, haversine
from ..sources.staging import staged
from .streams import in_order

#: Samples times segments that are projected at a time, and samples where a course has many segments.
MOST_CELLS, FEW = 200_000, 32
#: Places of a sample among which plain Python looks for the best.
A_FEW = 64
#: Neighbouring segments, or boxes of them, that one box holds, and what a bound on distances is too large by, at most.
FAN, SLACK_M = 32, 1e-3
#: Samples of a trace up to which one task walks it; longer ones are walked in parts of as many.
A_PART = 100_000
MATCHED = "attempt_id string, route_id string, seq int, t long, latitude double, longitude double, accuracy double, speed double, progress_m double, snap_m double, quality string, advancing boolean"
#: Places in which a course meets its points.
SALTS = 16


def with_length(courses: DataFrame, name: str = "length_m") -> DataFrame:
    """Courses with the length of their path, added up from the first point on."""
    leg = lambda i: haversine(F.col("path")[i]["latitude"], F.col("path")[i]["longitude"], F.col("path")[i + 1]["latitude"], F.col("path")[i + 1]["longitude"])
    steps = F.when(F.size("path") >= 2, F.sequence(F.lit(0), F.size("path") - 2)).otherwise(F.array().cast("array<int>"))
    return courses.withColumn(name, F.aggregate(F.transform(steps, leg), F.lit(0.0), lambda a, x: a + x))


def with_default_progress(courses: DataFrame) -> DataFrame:
    """Courses that start at the beginning of their path and finish at its end."""
    return with_length(courses.withColumn("start_p", F.lit(0.0)), "finish_p")


def _on_course(points: DataFrame, courses: DataFrame, needs: list[str], work: Callable[[_Geometry, dict[str, np.ndarray]], list[np.ndarray]], out: str) -> DataFrame:
    """route_id, id and ``out`` of each point: ``work`` on its course's geometry and the points' ``needs``, by numpy, a bounded number at a time.

    A course and its points meet in SALTS places, whatever the number of points; courses without
    points, and points without a course or whose course has no path, give nothing.
    """
    nothing = lambda c: F.lit(None).cast(points.schema[c].dataType).alias(c)
    lat, lon = (F.expr(f"transform(path, p -> p.{c})") for c in ("latitude", "longitude"))
    there = courses.filter(F.size("path") > 0).join(points.select("route_id").distinct(), "route_id", "left_semi")
    heads = there.select("route_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(0).alias("side"), lat.alias("lats"), lon.alias("lons"), *map(nothing, ["id", *needs]))
    none = F.lit(None).cast("array<double>")
    rows = points.select("route_id", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"), F.lit(1).alias("side"), none.alias("lats"), none.alias("lons"), "id", *needs)
    names = ["route_id", "id", *(c.split()[0] for c in out.split(", "))]

    def each(key: tuple, slices: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        geometry = None
        for part in slices:
            if part.column("side")[0].as_py() == 0:
                geometry = _Geometry(*(np.array(part.column(c)[0].as_py(), float) for c in ("lats", "lons")))
                part = part.slice(1)
            if geometry is None:
                continue
            step = max(1, MOST_CELLS // max(1, min(len(geometry.s0), 4 * FAN)))
            for at in range(0, part.num_rows, step):
                some = part.slice(at, step)
                found = work(geometry, {c: some.column(c).to_numpy(zero_copy_only=False).astype(float) for c in needs})
                yield pa.RecordBatch.from_arrays([some.column("route_id"), some.column("id"), *(pa.array(x, from_pandas=True) for x in found)], names=names)

    return in_order(heads.unionByName(rows), ["route_id", "salt"], ["side"], each, f"route_id string, id {points.schema['id'].dataType.simpleString()}, {out}")


def nearest_projection(points: DataFrame, courses: DataFrame) -> DataFrame:
    """Points (route_id, id, latitude, longitude) on their course: progress_m, snap_m and the snapped place.

    The nearest segment wins; of all within half a metre of it, the earliest along the course.
    """

    def nearest(g: _Geometry, x: dict[str, np.ndarray]) -> list[np.ndarray]:
        return list(g.nearest(x["latitude"], x["longitude"]))

    return _on_course(points, courses, ["latitude", "longitude"], nearest, "progress_m double, snap_m double, snap_lat double, snap_lon double")


def projection_near(points: DataFrame, courses: DataFrame) -> DataFrame:
    """Points (route_id, id, latitude, longitude, centre, ahead, behind) on the course near a progress: progress_m and snap_m, null where no segment lies in the window.

    Nearness counts progress apart from the centre, more so backwards; ties go to the later place.
    """

    def near(g: _Geometry, x: dict[str, np.ndarray]) -> list[np.ndarray]:
        return list(g.near(*(x[c] for c in ("latitude", "longitude", "centre", "ahead", "behind"))))

    return _on_course(points, courses, ["latitude", "longitude", "centre", "ahead", "behind"], near, "progress_m double, snap_m double")


def snap_taps(points: DataFrame, courses: DataFrame) -> DataFrame:
    """Projections of points that lie within the snapping distance of their course."""
    return nearest_projection(points, courses).filter(F.col("snap_m") <= K.SNAP_M)


def points_at(marks: DataFrame, courses: DataFrame) -> DataFrame:
    """Marks (route_id, id, progress_m) as places: progress_m, latitude, longitude.  Before the start is the start, beyond the end the end."""

    def place(g: _Geometry, x: dict[str, np.ndarray]) -> list[np.ndarray]:
        p = x["progress_m"]
        on = np.minimum(np.searchsorted(g.s1, p), len(g.s1) - 1)
        share = np.clip(np.divide(p - g.s0[on], g.length[on], out=np.zeros(len(p)), where=g.length[on] > 0), 0.0, 1.0)
        return [p, *g.point(on, share)]

    return _on_course(marks.filter("progress_m is not null"), courses, ["progress_m"], place, "progress_m double, latitude double, longitude double")


def checkpoint_points(courses: DataFrame) -> DataFrame:
    """route_id, place (from 1, by progress and then id), checkpoint_id, name, latitude, longitude of each checkpoint."""
    marks = courses.select("route_id", F.explode("checkpoints").alias("c"))
    at = points_at(marks.select("route_id", F.col("c").alias("id"), F.col("c.progress_m").alias("progress_m")), courses)
    order = Window.partitionBy("route_id").orderBy("progress_m", "id.id")
    return at.select("route_id", F.row_number().over(order).alias("place"), F.col("id.id").alias("checkpoint_id"), F.col("id.name").alias("name"), "latitude", "longitude")


def framed(courses: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """route_id, kind, latitude, longitude of everything a course shows: path, centres of the zones, their extents, checkpoints, and ``more``."""
    path = courses.select("route_id", F.lit("path").alias("kind"), F.explode("path").alias("p"))
    ends = [(F.col("path")[0], "start"), (F.element_at("path", -1), "finish")]
    zones = F.concat(*[F.array(F.struct(F.lit(k).alias("kind"), p["latitude"].alias("latitude"), p["longitude"].alias("longitude"))) for p, k in ends])
    named = lambda kind: lambda x: F.struct(F.lit(kind).alias("kind"), x["latitude"].alias("latitude"), x["longitude"].alias("longitude"))
    reach = F.concat(*[F.transform(extent(p["latitude"], p["longitude"], F.col(f"{k}_r")), named(f"{k}-extent")) for p, k in ends])
    around = courses.filter(F.size("path") > 0).select("route_id", F.explode(F.concat(zones, reach)).alias("x")).select("route_id", "x.*")
    rows = path.select("route_id", "kind", "p.latitude", "p.longitude").unionByName(around)
    rows = rows.unionByName(checkpoint_points(courses).select("route_id", F.lit("checkpoint").alias("kind"), "latitude", "longitude"))
    return rows if more is None else rows.unionByName(more.select("route_id", "kind", "latitude", "longitude"))


def _box(rows: DataFrame) -> DataFrame:
    return rows.groupBy("route_id").agg(F.min("latitude").alias("south"), F.max("latitude").alias("north"), F.min("longitude").alias("west"), F.max("longitude").alias("east"))


def bounds(courses: DataFrame) -> DataFrame:
    """The box around each course's path, zones and checkpoints, padded by 15 % of its size or a thousandth of a degree; a fixed box for a course with nothing to show."""
    p = courses.select("route_id").join(_box(framed(courses)), "route_id", "left")
    pad = lambda low, high: F.greatest((F.col(high) - F.col(low)) * K.PAD_SHARE, F.lit(K.LEAST_PAD))
    tall, wide = pad("south", "north"), pad("west", "east")
    west, south, east, north = K.DEFAULT_BOX
    return p.select("route_id", F.coalesce(F.col("south") - tall, F.lit(south)).alias("south"), F.coalesce(F.col("north") + tall, F.lit(north)).alias("north"), F.coalesce(F.col("west") - wide, F.lit(west)).alias("west"), F.coalesce(F.col("east") + wide, F.lit(east)).alias("east"))


def preview(courses: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """framed() with x and y in percent of a preview, eastwards and downwards within the box; for the centre of a zone also its diameter in percent."""
    rows = framed(courses, more)
    span = lambda low, high: F.greatest(F.col(high) - F.col(low), F.lit(K.LEAST_SPAN))
    j = rows.join(_box(rows), "route_id").join(courses.select("route_id", "start_r", "finish_r"), "route_id")
    x = (F.col("longitude") - F.col("west")) / span("west", "east") * 100
    y = (1 - (F.col("latitude") - F.col("south")) / span("south", "north")) * 100
    radius = F.when(F.col("kind") == "start", F.col("start_r")).when(F.col("kind") == "finish", F.col("finish_r"))
    low, high = K.DIAMETER_RANGE
    wide = F.when(radius.isNull(), None).when(F.isnan(radius) | (radius <= 0), 0.0).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), radius / K.METERS_PER_DEGREE * 2 / span("south", "north") * 100)))
    return j.select("route_id", "kind", "latitude", "longitude", x.alias("x"), y.alias("y"), wide.alias("diameter"))


def _meters(lat1, lon1, lat2, lon2) -> np.ndarray:
    h = np.sin(np.radians(lat2 - lat1) / 2) ** 2 + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * K.EARTH_RADIUS_M * np.arcsin(np.minimum(1.0, np.sqrt(h)))


def _each(f: Callable[[float], float], x: np.ndarray) -> np.ndarray:
    """A function of the C library: numpy's own differ in the last bit from machine to machine, and with it which of two equal distances is less."""
    return np.array([f(v) if math.isfinite(v) else math.nan for v in x.tolist()], float)


class _Geometry:
    """A path's segments: their ends, lengths, and progress at both ends."""

    def __init__(self, lat: np.ndarray, lon: np.ndarray):
        if len(lat) == 1:  # a point is a segment without length
            lat, lon = np.repeat(lat, 2), np.repeat(lon, 2)
        self.ends = lat[:-1], lon[:-1], lat[1:], lon[1:]
        a_lat, a_lon, b_lat, b_lon = self.ends
        up, over = _each(math.sin, np.radians(b_lat - a_lat) / 2), _each(math.sin, np.radians(b_lon - a_lon) / 2)
        flat = _each(math.cos, np.radians(a_lat))
        self.east = K.METERS_PER_DEGREE * flat
        self.length = 2 * K.EARTH_RADIUS_M * _each(math.asin, np.minimum(1.0, np.sqrt(up * up + flat * _each(math.cos, np.radians(b_lat)) * over * over)))
        self.s1 = np.cumsum(self.length)
        self.s0 = np.concatenate([[0.0], self.s1[:-1]]) if len(self.s1) else self.s1
        self._boxes: list[np.ndarray] | None = None
        self.looked = 0  # at so many segments, for so many points

    def project(self, y: np.ndarray, x: np.ndarray, lo: int = 0, hi: int | None = None) -> tuple[np.ndarray, ...]:
        """Progress, distance, latitude and longitude of points on the segments from ``lo`` to ``hi``; a row a point."""
        a_lat, a_lon, b_lat, b_lon = (e[lo:hi] for e in self.ends)
        east = self.east[lo:hi]
        ex, ey = (b_lon - a_lon) * east, (b_lat - a_lat) * K.METERS_PER_DEGREE
        px, py = (x[:, None] - a_lon) * east, (y[:, None] - a_lat) * K.METERS_PER_DEGREE
        square = ex * ex + ey * ey
        share = np.clip(np.divide(px * ex + py * ey, square, out=np.zeros_like(px), where=square > 0), 0.0, 1.0)
        lat, lon = a_lat + ey * share / K.METERS_PER_DEGREE, a_lon + ex * share / east
        return self.s0[lo:hi] + share * self.length[lo:hi], _meters(lat, lon, y[:, None], x[:, None]), lat, lon

    def pairs(self, on: np.ndarray, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """As project(), of each point on one segment."""
        a_lat, a_lon, b_lat, b_lon = (e[on] for e in self.ends)
        east = self.east[on]
        ex, ey = (b_lon - a_lon) * east, (b_lat - a_lat) * K.METERS_PER_DEGREE
        px, py = (x - a_lon) * east, (y - a_lat) * K.METERS_PER_DEGREE
        square = ex * ex + ey * ey
        share = np.clip(np.divide(px * ex + py * ey, square, out=np.zeros_like(px), where=square > 0), 0.0, 1.0)
        lat, lon = a_lat + ey * share / K.METERS_PER_DEGREE, a_lon + ex * share / east
        return self.s0[on] + share * self.length[on], _meters(lat, lon, y, x), lat, lon

    def boxes(self) -> list[np.ndarray]:
        """Levels of boxes (south, north, west, east): of segments, of FAN of these, and so on up to a level of no more than FAN."""
        if self._boxes is None:
            a_lat, a_lon, b_lat, b_lon = self.ends
            levels = [np.stack([np.minimum(a_lat, b_lat), np.maximum(a_lat, b_lat), np.minimum(a_lon, b_lon), np.maximum(a_lon, b_lon)])]
            while levels[-1].shape[1] > FAN:
                cuts = np.arange(0, levels[-1].shape[1], FAN)
                levels.append(np.stack([f.reduceat(row, cuts) for f, row in zip((np.minimum, np.maximum) * 2, levels[-1], strict=True)]))
            self._boxes = levels
        return self._boxes

    @staticmethod
    def _least(box: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
        """A distance that nothing in a point's box falls short of."""
        south, north, west, east = box
        up = np.maximum(0.0, np.maximum(south - y, y - north))
        over = np.maximum(0.0, np.maximum(west - x, x - east))
        over = np.where(np.maximum(np.abs(x - west), np.abs(x - east)) > 180, 0.0, over)  # the shorter way may lead round the other side
        flat = np.cos(np.radians(np.minimum(90.0, np.maximum(np.abs(south), np.abs(north)))))
        h = np.sin(np.radians(up) / 2) ** 2 + np.cos(np.radians(y)) * flat * np.sin(np.radians(over) / 2) ** 2
        return 2 * K.EARTH_RADIUS_M * np.arcsin(np.minimum(1.0, np.sqrt(np.maximum(0.0, h)))) - SLACK_M

    def _children(self, level: int, box: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The boxes of a level within boxes of the one above, and to which of these each belongs."""
        n = np.minimum(FAN, self.boxes()[level].shape[1] - box * FAN)
        owner = np.repeat(np.arange(len(box)), n)
        return box[owner] * FAN + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n), owner

    def nearest(self, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """Progress, distance, latitude and longitude of each point's place on the path: of all segments within half a metre of the nearest, the earliest along the course.

        The box nearest to a point leads down to one segment, whose distance bounds the nearest;
        then boxes that come within the bound and half a metre are opened, level by level.
        """
        lost = np.isnan(y) | np.isnan(x)
        if lost.any():  # a point without a place has none on the path
            found = self.nearest(np.where(lost, self.ends[0][0], y), np.where(lost, self.ends[1][0], x))
            return tuple(np.where(lost, np.nan, v) for v in found)
        levels, n = self.boxes(), len(y)
        every = np.arange(n)
        box = np.stack([self._least(levels[-1][:, [k]], y, x) for k in range(levels[-1].shape[1])]).argmin(axis=0)
        for level in range(len(levels) - 2, -1, -1):
            below, owner = self._children(level, box)
            order = np.lexsort([self._least(levels[level][:, below], y[owner], x[owner]), owner])
            box = below[order[np.searchsorted(owner, every)]]
        bound = self.pairs(box, y, x)[1] + K.TIE_M
        self.looked += n
        top = levels[-1].shape[1]
        owner, box = np.repeat(every, top), np.tile(np.arange(top), n)
        for level in range(len(levels) - 1, -1, -1):
            near = self._least(levels[level][:, box], y[owner], x[owner]) <= bound[owner]
            owner, box = owner[near], box[near]
            if level:
                box, of = self._children(level - 1, box)
                owner = owner[of]
        self.looked += len(box)
        progress, snap, lat, lon = self.pairs(box, y[owner], x[owner])
        cuts = np.searchsorted(owner, every)
        tied = snap <= np.minimum.reduceat(snap, cuts)[owner] + K.TIE_M
        order = np.lexsort([np.where(tied, progress, np.inf), owner])
        at = order[cuts]
        return progress[at], snap[at], lat[at], lon[at]

    def near(self, y: np.ndarray, x: np.ndarray, centre: np.ndarray, ahead: np.ndarray, behind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Progress and distance on the best segment between ``behind`` and ``ahead`` of a centre, of those alone; not a number where there is none."""
        lo, hi = np.searchsorted(self.s1, centre - behind), np.searchsorted(self.s0, centre + ahead, "right")
        n = np.where(np.isnan(centre), 0, np.maximum(0, hi - lo))
        owner = np.repeat(np.arange(len(y)), n)
        on = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + lo[owner]
        self.looked += len(on)
        progress, snap, _, _ = self.pairs(on, y[owner], x[owner])
        cost = snap + K.PROGRESS_COST * np.abs(progress - centre[owner]) + K.BACKWARD_COST_M * (progress < centre[owner])
        order = np.lexsort([-progress, cost, owner])  # ties to the later place
        some = np.flatnonzero(n)
        at = order[np.searchsorted(owner, some)]
        out = np.full(len(y), np.nan), np.full(len(y), np.nan)
        out[0][some], out[1][some] = progress[at], snap[at]
        return out

    def point(self, on: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Latitude and longitude at shares of segments."""
        a_lat, a_lon, b_lat, b_lon = (e[on] for e in self.ends)
        return a_lat + (b_lat - a_lat) * share, a_lon + (b_lon - a_lon) * share


class _Follower(_Geometry):
    """One trace on its course: remembers the last accepted progress."""

    def __init__(self, lat: np.ndarray, lon: np.ndarray, start: float):
        super().__init__(lat, lon)
        self.start, self.last = start, math.nan
        self.everywhere = len(lat) == 1
        self.most = float(self.length.max()) if len(self.length) else 0.0
        self.plain = bool(np.isfinite(self.s1).all())  # progress at the ends of segments is in order

    def __call__(self, y: np.ndarray, x: np.ndarray, skip: np.ndarray) -> list[tuple[str, float | None, float | None, bool]]:
        out = []
        step = len(y) if len(y) * len(self.s0) <= MOST_CELLS else FEW
        for at in range(0, len(y), max(1, step)):
            part = slice(at, at + step)
            n = len(y[part])
            # Each sample moves the window by no more than it reaches, so only so many segments can matter to the next few.
            centre = self.start if math.isnan(self.last) else self.last
            reach = (K.AHEAD_M + self.most) * (n + 1)
            lo, hi = int(np.searchsorted(self.s1, centre - reach)), int(np.searchsorted(self.s0, centre + reach, "right"))
            out += self._walk(*self.project(y[part], x[part], lo, hi)[:2], self.s0[lo:hi], self.s1[lo:hi], skip[part])
        return out

    def _best(self, p: np.ndarray, d: np.ndarray, centre: float) -> tuple[float, float]:
        """Progress and distance of the cheapest place, of equally cheap ones the last; a few places are gone through faster than numpy is called."""
        if len(p) <= A_FEW:
            best = at = far = None
            for own, off in zip(p.tolist(), d.tolist(), strict=True):
                cost = off + K.PROGRESS_COST * abs(own - centre) + (K.BACKWARD_COST_M if own < centre else 0)
                if math.isfinite(cost) and (best is None or cost < best or (cost == best and own > at)):
                    best, at, far = cost, own, off
            if best is not None:
                return at, far
        cost = d + K.PROGRESS_COST * np.abs(p - centre) + K.BACKWARD_COST_M * (p < centre)
        w = max(np.flatnonzero(cost == cost.min()).tolist(), key=lambda j: p[j])
        return float(p[w]), float(d[w])

    def _walk(self, progress: np.ndarray, snap: np.ndarray, s0: np.ndarray, s1: np.ndarray, skip: np.ndarray) -> Iterator[tuple[str, float | None, float | None, bool]]:
        ends = s0.tolist(), s1.tolist()
        for i in range(len(progress)):
            if skip[i]:
                yield "poor_accuracy", None, None, False
                continue
            first = math.isnan(self.last)
            centre = self.start if first else self.last
            ahead, behind = (K.FIRST_AHEAD_M, K.FIRST_BEHIND_M) if first else (K.AHEAD_M, K.BEHIND_M)
            if self.everywhere:
                near = slice(0, len(s0))
            elif self.plain:
                near = slice(bisect_left(ends[1], centre - behind), bisect_right(ends[0], centre + ahead))
            else:
                near = np.flatnonzero((s1 >= centre - behind) & (s0 <= centre + ahead))
            places = progress[i, near]
            if not len(places):
                yield "out_of_window", None, None, False
                continue
            p, d = self._best(places, snap[i, near], centre)
            if d > K.CORRIDOR_M:
                yield "off_course", p, d, False
            else:
                yield "accepted", p, d, first or p >= self.last - K.BEHIND_M
                self.last = p


def match_samples(samples: DataFrame, courses: DataFrame, attempts: DataFrame | None = None, part: int = A_PART) -> DataFrame:
    """Each attempt's samples, in order of time and id, matched to its course one after another.

    ``attempts`` names the (attempt_id, route_id) of the samples, if a table of them is at hand.

    Where a sample may lie depends on the last one accepted, so a trace is gone through in
    order, by numpy; it streams through its task in slices, after a row that holds its course,
    and only the last accepted progress is remembered.  A trace of more than ``part`` samples
    is walked in parts at the same time, see longtrace.  Returns attempt_id, route_id, seq
    (from 0), t, latitude, longitude, accuracy, speed, progress_m, snap_m, quality, advancing.
    An attempt whose course has no point gets quality out_of_window.
    """
    nothing = lambda t: F.lit(None).cast(t)
    path = courses.select("route_id", F.transform("path", lambda p: p["latitude"]).alias("lats"), F.transform("path", lambda p: p["longitude"]).alias("lons"), "start_p")
    heads = (samples if attempts is None else attempts).select("attempt_id", "route_id").distinct().join(path, "route_id")
    keys = ["attempt_id", "route_id"]
    sizes = samples.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > part).select(*keys)
    long = None
    if sizes.limit(1).count():
        from .longtrace import match_long

        sizes = staged(sizes, "match-long")
        mine = samples.join(sizes, keys, "left_semi").join(heads.select(*keys), keys, "left_semi")
        long = match_long(mine.select(*keys, "id", F.col("recorded_at_ms").alias("t"), "latitude", "longitude", "accuracy", "speed"), path, part)
        samples, heads = (rows.join(sizes, keys, "left_anti") for rows in (samples, heads))
    names = ["attempt_id", "route_id", "side", "t", "id", "latitude", "longitude", "accuracy", "speed", "lats", "lons", "start_p"]
    heads = heads.withColumns({"side": F.lit(0), "t": nothing("long"), "id": nothing("string"), **{c: nothing("double") for c in ("latitude", "longitude", "accuracy", "speed")}}).select(names)
    rows = samples.withColumns({"side": F.lit(1), "t": F.col("recorded_at_ms"), "lats": nothing("array<double>"), "lons": nothing("array<double>"), "start_p": nothing("double")}).select(names)
    out_names = [c.split()[0] for c in MATCHED.split(", ")]

    def follow(key: tuple, slices: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        follower, seq = None, 0
        for part in slices:
            if part.column("side")[0].as_py() == 0:
                follower = _Follower(*(np.array(part.column(c)[0].as_py() or [], float) for c in ("lats", "lons")), part.column("start_p")[0].as_py())
                part = part.slice(1)
            if follower is None or not part.num_rows:
                continue  # no course
            y, x, acc = (part.column(c).to_numpy(zero_copy_only=False) for c in ("latitude", "longitude", "accuracy"))
            quality, progress, far, on = zip(*follower(y, x, np.nan_to_num(acc.astype(float), nan=0.0) > K.MAX_ACCURACY_M), strict=True)
            n = part.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array([key[0]] * n, pa.string()), pa.array([key[1]] * n, pa.string()), pa.array(range(seq, seq + n), pa.int32()), *(part.column(c) for c in ("t", "latitude", "longitude", "accuracy", "speed")), pa.array(progress, pa.float64()), pa.array(far, pa.float64()), pa.array(quality, pa.string()), pa.array(on)], names=out_names
            )
            seq += n

    short = in_order(heads.unionByName(rows), keys, ["side", "t", "id"], follow, MATCHED)
    return short if long is None else short.unionByName(long)


def usable_samples(samples: DataFrame) -> DataFrame:
    """What movement analysis matches: times later than all before, and then an accuracy that is unknown or good enough."""
    before = Window.partitionBy("attempt_id").orderBy("recorded_at_ms", "id").rowsBetween(Window.unboundedPreceding, -1)
    latest = F.max("recorded_at_ms").over(before)
    fresh = samples.withColumn("_latest", latest).filter(F.col("_latest").isNull() | (F.col("recorded_at_ms") > F.col("_latest"))).drop("_latest")
    return fresh.filter(F.col("accuracy").isNull() | (F.col("accuracy") <= K.USABLE_ACCURACY_M))
