"""Chroma audio fingerprints: pitch-class frames, integral-image filters, packed integers, alignment.

Recordings are a media column: 16-bit mono samples, or whatever a decoder reads.  Fingerprints are made where the
recording is read.  Recordings with the same fingerprint form a class and are compared
once; candidates share packed integers, an offset histogram picks how two recordings lie
to each other, and bit errors over their whole overlap decide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

FRAME, HOP = 1024, 256
LOWEST, HIGHEST = 110.0, 1760.0
#: Frames that a packed integer looks at, and the filters' widths, pitch classes and shapes, by rule.
LOOK = 16
FILTERS = tuple((kind, (4, 8, 12, 16)[i % 4], (i * 5) % 12, (1, 2, 3, 4)[i // 4]) for i, kind in enumerate((0, 1, 2, 3) * 4))
STEPS = (-0.4, 0.0, 0.4)
GRAY = np.array([0, 1, 3, 2], np.uint32)
SLICE = 64
#: Samples that are worked on together.
TOGETHER = 500_000


def _by_class(rate: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spectrum's bins in use, ordered by pitch class; where each class that has bins begins; and those classes."""
    hz = np.fft.rfftfreq(FRAME, 1 / rate)
    use = np.flatnonzero((hz >= LOWEST) & (hz <= HIGHEST))
    pitch = np.round(12 * np.log2(hz[use] / 440.0)).astype(int) % 12
    order = np.argsort(pitch, kind="stable")
    classes, starts = np.unique(pitch[order], return_index=True)
    return use[order], starts, classes


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """Frames of energy by pitch class, each of unit length; fewer samples than a frame give none.

    ``samples``: recordings of one length, a row each.  A row's frames don't depend on the rows beside it.
    """
    m, length = samples.shape
    n = max(0, 1 + (length - FRAME) // HOP)
    out = np.zeros((m, n, 12))
    if not n or not m:
        return out
    window = np.hanning(FRAME).astype(np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(samples.astype(np.float32), FRAME, axis=1)[:, ::HOP][:, :n] * window
    squares = np.fft.rfft(frames, axis=2).view(np.float32)
    squares *= squares
    bins, starts, classes = _by_class(rate)
    out[:, :, classes] = np.add.reduceat((squares[:, :, ::2] + squares[:, :, 1::2])[:, :, bins], starts, axis=2)
    size = np.sqrt((out**2).sum(axis=2, keepdims=True))
    return np.divide(out, size, out=np.zeros_like(out), where=size > 1e-9)


def packed(frames: np.ndarray) -> np.ndarray:
    """A 32-bit integer for each run of LOOK frames: two bits a filter, from the log ratio of two areas of the integral image.  A row for each recording, all of one length."""
    m, length, _ = frames.shape
    n = length - LOOK + 1
    if n <= 0 or not m:
        return np.zeros((m, 0), np.uint32)
    twice = np.concatenate([frames, frames], axis=2)  # pitch classes wrap around
    total = np.zeros((25, m, length + 1))
    total[1:, :, 1:] = twice.cumsum(axis=1).cumsum(axis=2).transpose(2, 0, 1)

    def area(t0: int, t1: int, c0: int, c1: int) -> np.ndarray:
        late, early = slice(t1, t1 + n), slice(t0, t0 + n)
        return total[c1, :, late] - total[c1, :, early] - total[c0, :, late] + total[c0, :, early]

    out = np.zeros((m, n), np.uint32)
    for kind, width, low, height in FILTERS:
        t, h = (LOOK - width) // 2, width // 2
        if kind == 0:  # earlier against later
            a, b = area(t, t + h, low, low + 2 * height), area(t + h, t + width, low, low + 2 * height)
        elif kind == 1:  # lower against higher classes
            a, b = area(t, t + width, low, low + height), area(t, t + width, low + height, low + 2 * height)
        elif kind == 2:  # the two diagonals
            a = area(t, t + h, low, low + height) + area(t + h, t + width, low + height, low + 2 * height)
            b = area(t, t + h, low + height, low + 2 * height) + area(t + h, t + width, low, low + height)
        else:  # the middle against what lies around it
            q = max(1, width // 4)
            a = area(t + q, t + width - q, low, low + 2 * height)
            b = area(t, t + q, low, low + 2 * height) + area(t + width - q, t + width, low, low + 2 * height)
        ratio = np.log((1 + a) / (1 + b))
        out = (out << np.uint32(2)) | GRAY[(ratio > STEPS[0]).astype(np.int8) + (ratio > STEPS[1]) + (ratio > STEPS[2])]
    return out


def pcm(audio: bytes | None) -> np.ndarray:
    """Samples of 16-bit mono audio; null is none, and an odd last byte is ignored."""
    return np.frombuffer(audio or b"", "<i2", count=len(audio or b"") // 2)


def prints_of(recordings: list[np.ndarray], rate: int) -> list[bytes]:
    """The fingerprint of each recording; those of one length are worked on together, a bounded number at a time."""
    out = [b""] * len(recordings)
    by_size: dict[int, list[int]] = {}
    for i, x in enumerate(recordings):
        by_size.setdefault(len(x), []).append(i)
    for size, own in by_size.items():
        step = max(1, TOGETHER // max(1, size))
        for at in range(0, len(own), step):
            part = own[at : at + step]
            for i, row in zip(part, packed(chroma(np.stack([recordings[i] for i in part]), rate)).astype("<u4"), strict=True):
                out[i] = row.tobytes()
    return out


def fingerprints(recordings: DataFrame, rate: int, decode: Callable[[Any], np.ndarray] = pcm) -> DataFrame:
    """rec_id, print (little-endian 32-bit integers) and same (a hash of it), from (rec_id, audio).

    ``decode`` turns a value of the audio column, of whatever type, into 16-bit mono samples;
    it runs where the recording is read, so that decoded audio moves nowhere.  A null or too
    short recording has an empty print; repeated rows give repeated rows; other columns,
    whatever their names, are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                prints = prints_of([decode(a) for a in part.column(1).to_pylist()], rate)
                same = [int.from_bytes(hashlib.blake2b(p, digest_size=8).digest(), "little", signed=True) for p in prints]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints, pa.binary()), pa.array(same, pa.int64())], names=["rec_id", "print", "same"])

    return recordings.select(F.col("rec_id").cast("long").alias("rec_id"), "audio").mapInArrow(run, "rec_id long, print binary, same long")


def _bits(print_a: np.ndarray, print_b: np.ndarray, offset: int) -> tuple[int, int]:
    """Frames in common and differing bits when b starts ``offset`` frames after a."""
    a, b = print_a[max(0, offset) :], print_b[max(0, -offset) :]
    n = min(len(a), len(b))
    return n, int(np.bitwise_count(a[:n] ^ b[:n]).sum())


#: What packed silence is, by the filters' rule for equal areas.
SILENT = int("01" * 16, 2)


def _runs(v: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal integers begin in prints laid end to end, and how much each can weigh as a hit: one, and one more for each LOOK frames that sound."""
    new = np.concatenate([np.ones(min(1, len(v)), bool), v[1:] != v[:-1]])
    new[starts] = True  # no print is empty
    at = np.flatnonzero(new)
    return at, np.where(v[at] == SILENT, 1, 1 + np.diff(np.append(at, len(v))) // LOOK)


def _hits(a: np.ndarray, b: np.ndarray, offset: int) -> int:
    """Hits at an offset: the lighter of two equal runs that begin there, summed."""
    (at_a, weight_a), (at_b, weight_b) = (_runs(x, np.zeros(1, int)) for x in (a, b))
    _, i, j = np.intersect1d(at_a - offset, at_b, assume_unique=True, return_indices=True)
    return int(np.minimum(weight_a[i], weight_b[j])[a[at_a[i]] == b[at_b[j]]].sum())


def _candidates(scratch: Scratch, reps: DataFrame, least_hits: int, shared: int) -> DataFrame:
    """q, d and offset of every pair, d being any class and q one that is asked for, that may have the hits it needs.

    A value in more than ``shared`` runs would pair all of them.  Of such runs each recording
    leaves out those it can do without: with runs in one order for all, commonest first, those
    at the front that weigh less than the hits needed.  Two recordings that share enough hits
    at an offset share one that neither leaves out, the last of them in that order, so that no
    pair is lost.  What a pair needs is the lesser of both needs; a recording has a row for each
    need there is, and joins by both.
    """

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each run: its value, its first place and its weight."""
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                prints = [np.frombuffer(raw, "<u4") for raw in part.column(3).to_pylist()]
                v = np.concatenate([*prints, np.zeros(0, "<u4")])
                starts = np.cumsum([0, *map(len, prints)])
                new, weight = _runs(v, starts[:-1])
                owner = np.searchsorted(starts, new, "right") - 1
                columns = [part.column(i).to_numpy()[owner] for i in range(3)]
                columns += [v[new].astype(np.int64), (new - starts[owner]).astype(np.int32), weight.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["same", "asked", "need", "value", "place", "weight"])

    schema = "same long, asked int, need int, value long, place int, weight int"
    posts = scratch.cut(reps.select("same", "asked", "need", "print").mapInArrow(post, schema), "posts")
    common = scratch.cut(posts.groupBy("value").count().filter(F.col("count") > shared), "common")
    order = Window.partitionBy("same").orderBy(F.desc("count"), "value", "place")
    ranked = posts.join(common, "value").withColumn("so_far", F.sum("weight").over(order))
    rare = posts.join(common, "value", "left_anti").withColumn("so_far", F.lit(None).cast("long"))
    needs = sorted(r.need for r in reps.select("need").distinct().collect())  # at most least_hits values
    kept = F.col("so_far").isNull() | (F.col("so_far") >= F.least("need", "other"))
    rows = rare.unionByName(ranked.drop("count")).withColumn("other", F.explode(F.array(*map(F.lit, needs)) if needs else F.array().cast("array<int>")))
    runs = scratch.cut(rows.filter(kept).select("same", "asked", "need", "other", "value", "place", "weight", F.col("so_far").isNotNull().alias("common")), "runs")
    loose = ranked.select("same").distinct()  # recordings that may leave out a run
    q = runs.filter("asked = 1").select(F.col("same").alias("q"), "value", "need", "other", F.col("place").alias("q_place"), F.col("weight").alias("q_weight"))
    d = runs.select(F.col("same").alias("d"), "value", F.col("need").alias("other"), F.col("other").alias("need"), F.col("place").alias("d_place"), F.col("weight").alias("d_weight"))
    met = q.join(d, ["value", "need", "other"]).filter("q <> d")
    seen = met.groupBy("q", "d", "need", "other", (F.col("q_place") - F.col("d_place")).alias("offset")).agg(F.sum(F.least("q_weight", "d_weight")).alias("seen"))
    least = F.least("need", "other")
    enough = seen.filter(F.col("seen") >= least).select("q", "d", "offset")
    few = seen.filter(F.col("seen") < least)
    both = few.join(loose.withColumnRenamed("same", "q"), "q", "left_semi").join(loose.withColumnRenamed("same", "d"), "d", "left_semi")
    return enough.unionByName(both.select("q", "d", "offset"))


def align(prints: DataFrame, every: int = 50, least_hits: int = 4, most_errors: float = 0.2, least_frames: int = 16, shared: int = 1_000) -> DataFrame:
    """Recordings that match each query: those whose id is divisible by ``every``, against all.

    Returns query_id, match_id (the smallest id of a class of equal fingerprints, the query's
    own class included if it has others), copies (rows in that class), offset_frames (by how
    much the match starts later), hits, frames and bit_errors.  Runs of equal integers that begin
    alike give hits at an offset: one, and one more for each LOOK frames that both last; silence
    gives one however long.  A pair is a match at an offset with ``least_hits`` hits or more, or
    with as many as a steady sound of the shorter one's length has, if at least ``least_frames``
    frames overlap there and at most ``most_errors`` of their bits differ; of several such
    offsets the one with most hits counts, then the one nearest to zero, then the smaller.
    ``shared`` is the number of runs from which on a value is joined with care; it changes no
    result.  Empty fingerprints and null ids match nothing.  An empty table gives no rows.
    """
    scratch = Scratch(prints.sparkSession, "chroma")
    prints = scratch.cut(prints, "prints")
    full = prints.filter("rec_id is not null and length(print) > 0")
    asked = F.max((F.col("rec_id") % every == 0).cast("int")).alias("asked")
    classes = scratch.cut(full.groupBy("same").agg(F.min("rec_id").alias("rep"), F.count("*").alias("copies"), asked), "classes")
    frames = F.floor(F.length("print") / 4)
    need = F.least(F.lit(least_hits), 1 + F.floor(frames / LOOK)).cast("int").alias("need")
    own_class = full.join(classes, (full.same == classes.same) & (full.rec_id == classes.rep))
    reps = scratch.cut(own_class.select(full.same, "rec_id", "copies", "asked", need, "print").dropDuplicates(["same"]), "reps")
    found = _candidates(scratch, reps.filter(frames >= least_frames), least_hits, shared)
    sides = [reps.select(F.col("same").alias(x), F.col("print").alias(f"{x}_print"), F.col("need").alias(f"{x}_need")) for x in ("q", "d")]
    pairs = found.join(sides[0], "q").join(sides[1], "d")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for r in batch.to_pylist():
                a, b = np.frombuffer(r["q_print"], "<u4"), np.frombuffer(r["d_print"], "<u4")
                got.append((_hits(a, b, r["offset"]), *_bits(a, b, r["offset"])))
            made = [pa.array([g[i] for g in got], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *made], names=["q", "d", "offset", "least", "hits", "frames", "bit_errors"])

    pairs = pairs.select("q", "d", "offset", F.least("q_need", "d_need").alias("least"), "q_print", "d_print")
    compared = pairs.mapInArrow(compare, "q long, d long, offset int, least int, hits long, frames long, bit_errors long")
    close = (F.col("frames") >= least_frames) & (F.col("bit_errors") <= most_errors * 32 * F.col("frames"))
    compared = compared.filter((F.col("hits") >= F.col("least")) & close)
    best = F.max(F.struct("hits", (-F.abs("offset")).alias("near"), (-F.col("offset")).alias("sign"), "frames", "bit_errors")).alias("b")
    compared = compared.groupBy("q", "d").agg(best).select("q", "d", (-F.col("b.sign")).alias("offset"), "b.hits", "b.frames", "b.bit_errors")
    own = reps.filter("asked = 1 and copies > 1").select(F.col("same").alias("q"), F.col("same").alias("d"), F.lit(0).alias("offset"), (F.length("print") / 4).cast("long").alias("hits"), (F.length("print") / 4).cast("long").alias("frames"), F.lit(0).cast("long").alias("bit_errors"))
    matched = scratch.cut(compared.union(own), "matched").join(reps.select(F.col("same").alias("d"), F.col("rec_id").alias("match_id"), "copies"), "d")
    asking = full.filter(F.col("rec_id") % every == 0).select(F.col("same").alias("q"), F.col("rec_id").alias("query_id"))
    return asking.join(matched, "q").select("query_id", "match_id", "copies", F.col("offset").alias("offset_frames"), "hits", "frames", "bit_errors")


RATE, NOTE, LATE = 4000, 640, 2_000


def melodies(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", covers: int = 10) -> DataFrame:
    """(rec_id, audio): recordings for tables that hold no media; audio is a score, which ``play`` decodes.

    Each vector is a melody, a note a component.  A row whose id leaves 1 when divided by
    ``covers`` is a late, noisy take of the melody of the row before it, if there is one.
    Null and non-finite components are rests; a null vector gives a null recording.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("rec_id"), F.col(vector).cast("array<double>").alias("v"))
    before = rows.filter(F.col("rec_id") % covers == 0).select((F.col("rec_id") + 1).alias("rec_id"), F.col("v").alias("cover"))
    rows = rows.join(before.dropDuplicates(["rec_id"]), "rec_id", "left")
    late = F.col("cover").isNotNull()
    score = F.struct(F.when(late, F.col("cover")).otherwise(F.col("v")).alias("notes"), F.when(late, F.abs("rec_id")).alias("take"))
    return rows.select("rec_id", F.when(F.col("v").isNotNull(), score).alias("audio"))


@cache
def _tones() -> np.ndarray:
    t = np.arange(NOTE) / RATE
    shape = np.sin(np.pi * np.arange(NOTE) / NOTE)
    return np.stack([8000 * shape * np.sin(2 * np.pi * 220 * 2 ** (k / 12) * t) for k in range(24)] + [np.zeros(NOTE)])


def play(score: dict | None) -> np.ndarray:
    """Samples of a score of ``melodies``: its notes and, for a take, when it starts and its noise."""
    if score is None:
        return pcm(None)
    x = np.array([np.nan if c is None else c for c in score["notes"]], float)
    ok = np.isfinite(x)
    pitch = np.floor(np.where(ok, np.clip(x, -1e6, 1e6), 0) * 64).astype(int) % 24
    sound = _tones()[np.where(ok, pitch, 24)].ravel()
    if score["take"] is not None:
        sound = np.concatenate([np.zeros(LATE), sound])
        sound += np.random.default_rng(score["take"]).normal(0, 200, len(sound))
    return sound.astype("<i2")
