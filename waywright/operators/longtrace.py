"""Long traces matched in parts at the same time.

Where a sample may lie depends on the last one accepted, so a trace is walked in order.  But what
is accepted is a place on the course that belongs to the sample and a segment; two walks that
begin differently agree from the first sample on for which both accept the same place.  Each
part is therefore walked from a guess: some samples before it are walked first, from wherever
the first of them lies nearest.  A part whose guess isn't where the part before it ended
is walked again from there, all such parts at once, until every part begins where the one
before it ends: then all equal a walk through the whole trace.  That takes as many rounds as
parts in a row are misjudged, mostly none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..sources.staging import staged
from .matching import MATCHED, _Follower
from .prefix import dealt, with_earlier
from .streams import in_order

#: Samples of the part before that lead up to a guess.
LEAD = 64
KEYS = ["attempt_id", "route_id"]
VALUES = ["latitude", "longitude", "accuracy", "speed"]
NAMES = [c.split()[0] for c in MATCHED.split(", ")]
#: Besides samples, a part yields a row for where it began and one for where it ended.
BEGAN, ENDED = "began", "ended"


def _guess(follower: _Follower, y: np.ndarray, x: np.ndarray, skip: np.ndarray) -> float:
    """The progress of the first usable sample's nearest place on the course; not a number if there is none."""
    for i in np.flatnonzero(~skip):
        if len(follower.s0):
            progress, far, _, _ = follower.nearest(y[i : i + 1], x[i : i + 1])
            if far[0] <= K.CORRIDOR_M:
                return float(progress[0])
    return float("nan")


def _walked(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """MATCHED rows of parts, with part.

    ``heads``: a row a part (side 0) with its course and, if ``told``, the progress it begins
    with; ``rows``: samples that lead up to it (side 1) and its own (side 2).
    """
    schema = f"{MATCHED}, part int"

    def each(key: tuple, slices: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        follower, told, began, first = None, False, False, True

        def mark(kind: str) -> pa.RecordBatch:
            last = None if follower is None or np.isnan(follower.last) else follower.last
            own = {"attempt_id": key[0], "route_id": key[1], "quality": kind, "progress_m": last, "part": key[2]}
            return pa.RecordBatch.from_pylist([own], schema=pa.schema([(n, t) for n, t in zip([*NAMES, "part"], TYPES, strict=True)]))

        for part in slices:
            side = np.array(part.column("side").to_pylist())
            if side[0] == 0:
                lats, lons = (np.array(part.column(c)[0].as_py() or [], float) for c in ("lats", "lons"))
                follower, told = _Follower(lats, lons, part.column("start_p")[0].as_py()), part.column("told")[0].as_py()
                if told and (last := part.column("last")[0].as_py()) is not None:
                    follower.last = last
            for turn in (1, 2):
                some = part.filter(pa.array(side == turn))
                if follower is None or not some.num_rows:
                    continue
                y, x, accuracy = (some.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("latitude", "longitude", "accuracy"))
                skip = np.nan_to_num(accuracy, nan=0.0) > K.MAX_ACCURACY_M
                if turn == 1:
                    if first:
                        follower.last, first = _guess(follower, y, x, skip), False
                    follower(y, x, skip)
                    continue
                if not began:
                    began = True
                    yield mark(BEGAN)
                quality, progress, far, on = zip(*follower(y, x, skip), strict=True)
                n = some.num_rows
                columns = [pa.array([key[0]] * n, pa.string()), pa.array([key[1]] * n, pa.string()), *(some.column(c) for c in ("seq", "t", *VALUES)), pa.array(progress, pa.float64()), pa.array(far, pa.float64()), pa.array(quality, pa.string()), pa.array(on)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([key[2]] * n, pa.int32())], names=[*NAMES, "part"])
        if began:
            yield mark(ENDED)

    return in_order(heads.unionByName(rows, allowMissingColumns=True), [*KEYS, "part"], ["side", "seq"], each, schema)


TYPES = [pa.string(), pa.string(), pa.int32(), pa.int64(), *[pa.float64()] * 6, pa.string(), pa.bool_(), pa.int32()]


def _ends(found: DataFrame, turn: int) -> DataFrame:
    """A row a part: where it began and ended, and in which turn that was found."""
    of = lambda kind: F.max(F.when(F.col("quality") == kind, F.struct("progress_m")))["progress_m"].alias(kind)
    return found.filter(F.col("quality").isin(BEGAN, ENDED)).groupBy(*KEYS, "part").agg(of(BEGAN), of(ENDED)).withColumn("turn", F.lit(turn))


def match_long(samples: DataFrame, paths: DataFrame, part: int) -> DataFrame:
    """MATCHED rows of traces of any length, in tasks of ``part`` samples.

    ``samples``: attempt_id, route_id, id, t and VALUES; ``paths``: route_id, lats, lons, start_p.
    """
    order = [F.col("t").asc(), F.col("id").asc()]
    placed = with_earlier(dealt(samples, KEYS, order, "match-ranges"), KEYS, order, {"seq": ("count", F.lit(1))})
    placed = staged(placed.withColumn("seq", F.col("seq").cast("int")).withColumn("part", F.floor(F.col("seq") / part).cast("int")).select(*KEYS, "part", "seq", "t", *VALUES), "match-parts")
    parts = staged(placed.select(*KEYS, "part").distinct(), "match-part-names")
    head = lambda wanted: wanted.join(paths, "route_id").select(*KEYS, "part", F.lit(0).alias("side"), "lats", "lons", "start_p", "told", "last")
    lead = placed.filter(F.col("seq") % part >= part - LEAD).withColumns({"part": F.col("part") + 1, "side": F.lit(1)}).join(parts, [*KEYS, "part"], "left_semi")
    known = parts.withColumns({"told": F.col("part") == 0, "last": F.lit(None).cast("double")})
    turns = [staged(_walked(placed.withColumn("side", F.lit(2)).unionByName(lead), head(known)), "match-turn")]
    ends = staged(_ends(turns[0], 0), "match-ends")
    while True:
        before = ends.select(*KEYS, (F.col("part") + 1).alias("part"), F.col(ENDED).alias("last"))
        wrong = staged(ends.join(before, [*KEYS, "part"]).filter(~F.col(BEGAN).eqNullSafe(F.col("last"))).select(*KEYS, "part", F.lit(True).alias("told"), "last"), "match-wrong")
        if not wrong.limit(1).count():
            break
        again = placed.join(wrong.select(*KEYS, "part"), [*KEYS, "part"], "left_semi").withColumn("side", F.lit(2))
        turns.append(staged(_walked(again, head(wrong)), "match-turn"))
        new = _ends(turns[-1], len(turns) - 1)
        ends = staged(ends.join(wrong.select(*KEYS, "part"), [*KEYS, "part"], "left_anti").unionByName(new), "match-ends")
    out = None
    for turn, found in enumerate(turns):
        rows = found.filter(~F.col("quality").isin(BEGAN, ENDED))
        if len(turns) > 1:
            rows = rows.join(ends.filter(F.col("turn") == turn).select(*KEYS, "part"), [*KEYS, "part"], "left_semi")
        out = rows if out is None else out.unionByName(rows)
    return out.select(*NAMES)
