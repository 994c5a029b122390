"""Phrase collocations by pivot partitioning, as in MG-FSM.

Words are numbered by descending frequency.  A phrase belongs to its rarest word, its pivot
(of equal words, the leftmost).  Each occurrence of a word as a possible pivot yields a
fragment: the word with what stands around it, cut where a rarer word or a piece's end comes,
since phrases beyond that belong to others.  Fragments are counted where the text is read and
shuffled by their pivot; phrases are then mined from fragments alone, and each is found at
one pivot only.

The numbering is broadcast, so its size is bounded.  Words beyond it (too rare for the bound,
or very long) pass as text, in a second routing by the same rules, which does without numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chunks import without_collector
from .scratch import Scratch

#: Words that are numbered, at most (20 bits hold a number), and the bytes of one.
BITS = 20
MOST_NUMBERED, LONGEST_NUMBERED = (1 << BITS) - 1, 64
#: Distinct words, and fragments, that a task holds before it passes on what it has counted.
MOST_COUNTED, MOST_HELD = 300_000, 1 << 19
#: Bytes of a text that are split into words at a time.
A_BLOCK = 1 << 20
#: Words a bucket, about, and occurrences of a word from which its fragments are dealt over several buckets.
A_BUCKET, A_PART = 1 << 18, 1 << 17
#: A byte that UTF-8 never holds stands for a piece's end.
END = b"\xff"
FREE, CUTS = b" \t", b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes(0xFF if b in CUTS else 0x20 if b in FREE else b for b in range(256))
UNKNOWN = "und"
_MIX = np.uint64(0x9E3779B97F4A7C15)
CANDIDATE = "lang string, words array<string>, counts array<long>, a long"


def words_in(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, A-Z lower-cased, with END wherever a piece ends; a bounded number at a time."""
    whole, at = (text or "").encode().lower().translate(_TABLE).replace(END, b" \xff "), 0
    while at < len(whole):
        to = whole.find(b" ", at + A_BLOCK)
        to = len(whole) if to < 0 else to
        yield whole[at:to].split()
        at = to


def stretches(text: str | None, reach: int) -> Iterator[tuple[list[bytes], int, int]]:
    """(words, start, end): every word of the text lies once between start and end, with up to ``reach`` words on either side."""
    held: list[bytes] = []
    done = 0
    for words in words_in(text):
        held = held + words
        upto = max(done, len(held) - reach)  # the last words' surroundings are yet to come
        yield held, done, upto
        done = min(upto, reach)
        held = held[upto - done :]
    yield held, done, len(held)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("string").alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, n: all occurrences of every word."""

    def rows(counts: dict[str, Counter]) -> pa.RecordBatch:
        langs, words, n = [], [], []
        for lang, count in counts.items():
            count.pop(END, None)
            langs += [lang] * len(count)
            words += count.keys()
            n += count.values()
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], names=["lang", "word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = counts.setdefault(lang, Counter())
                with without_collector():
                    for words in words_in(text.as_py()):
                        own.update(words)
                if sum(map(len, counts.values())) > MOST_COUNTED:
                    yield rows(counts)
                    counts = {}
        yield rows(counts)

    found = _texts(docs).mapInArrow(run, "lang string, word string, n long")
    return found.groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Numbering:
    """Numbers from 1 on, in descending frequency, for frequent words of every language; ``rest`` are those without one."""

    def __init__(self, frequent: DataFrame, most: int, longest: int):
        short = frequent.filter(F.octet_length("word") <= longest)
        # Words of like frequency are numbered together or not at all, in about as many steps as a count has bits, times 16.
        step = F.floor(F.log2("n") * 16)
        cut, held = None, 0
        for r in short.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("least")).orderBy(F.desc("step")).collect():
            held += r.words
            if held > most:
                break
            cut = r.least
        inside = (F.octet_length("word") <= longest) & (F.col("n") >= cut) if cut is not None else F.lit(False)
        known = frequent.filter(inside).select("lang", "word", "n").orderBy(F.desc("n"), "lang", "word").toArrow()
        self.rest = frequent.filter(~inside)
        counts = np.concatenate([np.zeros(1, np.int64), known["n"].to_numpy().astype(np.int64)])
        #: Of at most ``most`` words of ``longest`` bytes.
        self.shared = frequent.sparkSession.sparkContext.broadcast((known["lang"].to_pylist(), known["word"].to_pylist(), counts))


_kept: list = [None, {}]


def _numbers(shared: Broadcast) -> dict[str, dict[bytes, int]]:
    """Numbers by language and word; made once in each worker process."""
    if _kept[0] is not shared.value:
        out: dict[str, dict[bytes, int]] = {}
        with without_collector():
            for i, (lang, word) in enumerate(zip(*shared.value[:2], strict=True), 1):
                out.setdefault(lang, {})[word.encode()] = i
        _kept[:] = shared.value, out
    return _kept[1]


def fragments_of(numbers: np.ndarray, longest: int, start: int, end: int) -> np.ndarray:
    """Rows of 2 * longest - 1 numbers: a pivot from start to end in the middle, what may stand around it in its phrases, 0 beyond.

    ``numbers`` holds 0 for a piece's end and for words without a number.  Left of a pivot
    stand words with smaller numbers only; right of it, the same word may stand as well.
    """
    reach = longest - 1
    edge = np.zeros(reach, np.int32)
    padded = np.concatenate([edge, numbers, edge])
    own = padded[reach : len(padded) - reach]
    out = np.zeros((len(own), 2 * reach + 1), np.int32)
    out[:, reach] = own
    for side in (-1, 1):
        within = own > 0
        for k in range(1, reach + 1):
            other = padded[reach + side * k : len(padded) - reach + side * k]
            within = within & (other > 0) & ((other < own) if side < 0 else (other <= own))
            out[:, reach + side * k] = np.where(within, other, 0)
    out = out[start:end]
    return out[(out[:, reach - 1] > 0) | (out[:, reach + 1] > 0)]


def counted(rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of numbers, and the sum of ``n`` over each."""
    if not len(rows):
        return rows, n
    packed = []
    for at in range(0, rows.shape[1], 3):
        key = np.zeros(len(rows), np.int64)
        for column in rows.T[at : at + 3]:
            key = key << BITS | column
        packed.append(key)
    order = np.lexsort(packed[::-1]) if len(packed) > 1 else np.argsort(packed[0], kind="stable")
    new = np.zeros(len(rows), bool)
    new[0] = True
    for key in packed:
        new[1:] |= np.diff(key[order]) != 0
    at = np.flatnonzero(new)
    return rows[order[at]], np.add.reduceat(n[order], at)


def phrases_in(fragments: np.ndarray, n: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """The phrases of 2 to ``longest`` words that hold the fragments' pivots, as rows of ``longest`` numbers (0 beyond), with counts."""
    found, times = [], []
    for size in range(2, longest + 1):
        for start in range(longest - size, longest):
            part = fragments[:, start : start + size]
            whole = (part > 0).all(axis=1)
            found.append(np.pad(part[whole], ((0, 0), (0, longest - size))))
            times.append(n[whole])
    return counted(np.concatenate(found), np.concatenate(times))


def _dealt(rows: np.ndarray, counts: np.ndarray, longest: int, buckets: int) -> np.ndarray:
    """A bucket for each fragment: its pivot's, or one of several where the pivot is frequent."""
    pivot = rows[:, longest - 1]
    mixed = np.zeros(len(rows), np.uint64)
    for column in rows.T:
        mixed = (mixed ^ column.astype(np.uint64)) * _MIX
        mixed ^= mixed >> np.uint64(29)
    part = mixed % (1 + counts[pivot] // A_PART).astype(np.uint64)
    key = (pivot.astype(np.uint64) << np.uint64(32) | part) * _MIX
    return ((key ^ key >> np.uint64(31)) % np.uint64(buckets)).astype(np.int32)


def _routed(docs: DataFrame, shared: Broadcast, longest: int, buckets: int) -> DataFrame:
    """bucket, fragments, times: the distinct fragments that a task has counted, a row a bucket."""

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate([np.zeros((0, 2 * longest - 1), np.int32), *held])
        rows, n = counted(rows, np.ones(len(rows), np.int64))
        at = _dealt(rows, shared.value[2], longest, buckets)
        order = np.argsort(at, kind="stable")
        rows, n, at = rows[order], n[order], at[order]
        cuts = np.flatnonzero(np.diff(at, prepend=-1)).tolist() + [len(at)]
        spans = list(zip(cuts, cuts[1:], strict=False))
        columns = [pa.array([int(at[a]) for a, _ in spans], pa.int32()), pa.array([rows[a:b].T.astype("<i4").tobytes() for a, b in spans], pa.binary())]
        return pa.RecordBatch.from_arrays([*columns, pa.array([n[a:b].astype("<i4").tobytes() for a, b in spans], pa.binary())], names=["bucket", "fragments", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _numbers(shared)
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if (known := numbers.get(lang)) is None:
                    continue
                with without_collector():
                    for words, start, end in stretches(text.as_py(), longest - 1):
                        ids = np.fromiter(map(known.get, words, repeat(0)), np.int32, len(words))
                        held.append(fragments_of(ids, longest, start, end))
                        size += len(held[-1])
                        if size > MOST_HELD:
                            yield packed(held)
                            held, size = [], 0
        yield packed(held)

    return _texts(docs).mapInArrow(run, "bucket int, fragments binary, times binary")


def _mined(routed: DataFrame, shared: Broadcast, longest: int, least: int) -> DataFrame:
    """numbers, a and dealt of the phrases that a bucket's pivots own; of frequent pivots (dealt), all, since others may hold more of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, rows, times = None, [], []

        def found() -> pa.RecordBatch:
            phrases, a = phrases_in(np.concatenate(rows), np.concatenate(times), longest)
            dealt = shared.value[2][phrases.max(axis=1, initial=0)] >= A_PART
            take = dealt | (a >= least)
            numbers = pa.FixedSizeListArray.from_arrays(pa.array(phrases[take].ravel(), pa.int32()), longest).cast(pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([numbers, pa.array(a[take]), pa.array(dealt[take])], names=["numbers", "a", "dealt"])

        for batch in batches:
            for own, fragments, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != bucket and rows:
                    yield found()
                    rows, times = [], []
                bucket = own
                rows.append(np.frombuffer(fragments, "<i4").reshape(2 * longest - 1, -1).T)
                times.append(np.frombuffer(n, "<i4").astype(np.int64))
        if rows:
            yield found()

    return routed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "numbers array<int>, a long, dealt boolean")


def _named(mined: DataFrame, shared: Broadcast) -> DataFrame:
    """Candidates with their words, and how often each of these occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, words, counts = shared.value
        for batch in batches:
            rows = [[i for i in x if i] for x in batch.column(0).to_pylist()]
            columns = [pa.array([langs[x[0] - 1] for x in rows], pa.string()), pa.array([[words[i - 1] for i in x] for x in rows], pa.list_(pa.string()))]
            columns += [pa.array([[int(counts[i]) for i in x] for x in rows], pa.list_(pa.int64())), batch.column(1)]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "words", "counts", "a"])

    return mined.select("numbers", "a").mapInArrow(run, CANDIDATE)


def _by_numbers(docs: DataFrame, numbering: Numbering, longest: int, least: int, buckets: int, scratch: Scratch) -> DataFrame:
    """Candidates whose words all have numbers."""
    mined = scratch.cut(_mined(_routed(docs, numbering.shared, longest, buckets), numbering.shared, longest, least), "mined")
    joined = mined.filter("dealt").groupBy("numbers").agg(F.sum("a").alias("a")).filter(F.col("a") >= least)
    return _named(mined.filter("not dealt").select("numbers", "a").union(joined), numbering.shared)


def _around(words: list[bytes], at: int, reach: int) -> tuple[int, list[bytes]]:
    """The words around a place, up to ``reach`` of them on either side and not beyond the piece; first, the place among them."""
    left, right = at, at + 1
    while left > max(0, at - reach) and words[left - 1] != END:
        left -= 1
    while right < min(len(words), at + reach + 1) and words[right] != END:
        right += 1
    return at - left, words[left:right]


def _routed_text(docs: DataFrame, shared: Broadcast, longest: int) -> DataFrame:
    """lang, pivot, words, counts (of those with a number), place, times: what stands around the words that have no number."""
    schema = "lang string, pivot string, words array<string>, counts array<long>, place int, times long"

    def rows(count: Counter) -> pa.RecordBatch:
        numbers, counts = _numbers(shared), shared.value[2]
        columns: list[list] = [[], [], [], [], [], list(count.values())]
        for lang, place, words in count:
            own = [numbers.get(lang, {}).get(w) for w in words]
            for column, x in zip(columns, (lang, words[place].decode(), [w.decode() for w in words], [int(counts[i]) if i else None for i in own], place), strict=False):
                column.append(x)
        types = [pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["lang", "pivot", "words", "counts", "place", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                known = _numbers(shared).get(lang, {})
                for words, start, end in stretches(text.as_py(), longest - 1):
                    for i in range(start, end):
                        if words[i] not in known and words[i] != END:
                            place, near = _around(words, i, longest - 1)
                            if len(near) > 1:
                                count[lang, place, tuple(near)] += 1
                    if len(count) > MOST_COUNTED:
                        yield rows(count)
                        count = Counter()
        yield rows(count)

    return _texts(docs).mapInArrow(run, schema)


def _by_text(docs: DataFrame, numbering: Numbering, longest: int, least: int, scratch: Scratch) -> DataFrame:
    """Candidates with a word that has no number: mined at each such word, and left to the rarest of them."""
    rest = numbering.rest.select("lang", F.col("word").alias("pivot"), F.col("n").alias("f"))
    routed = _routed_text(docs, numbering.shared, longest).join(rest, ["lang", "pivot"])

    def phrase(size: int, start: int) -> Column:
        """The phrase that starts so many words before the pivot, where the fragment holds it and the pivot isn't in it before."""
        first = F.col("place") - start
        there = (first >= 0) & (first + size <= F.size("words"))
        return F.when(there & ~F.array_contains(F.slice("words", first + 1, F.lit(start)), F.col("pivot")), F.struct(F.slice("words", first + 1, F.lit(size)).alias("words"), F.slice("counts", first + 1, F.lit(size)).alias("counts")))

    every = F.array_compact(F.array(*[phrase(size, start) for size in range(2, longest + 1) for start in range(size)]))
    mined = routed.select("lang", "pivot", "f", "times", F.explode(every).alias("p")).groupBy("lang", "pivot", "f", "p.words", "p.counts").agg(F.sum("times").alias("a")).filter(F.col("a") >= least)
    owned = scratch.cut(mined.groupBy("lang", "words", "counts", "a").agg(F.min(F.struct("f", "pivot")).alias("owner")).drop("owner"), "owned")
    missing = owned.select("lang", "words", "counts", "a", F.posexplode("words")).select("lang", "words", "a", "pos", F.col("col").alias("pivot"), F.col("counts")[F.col("pos")].alias("known"))
    told = missing.filter("known is null").join(rest, ["lang", "pivot"]).select("lang", "words", "a", "pos", F.col("f").alias("known")).union(missing.filter("known is not null").select("lang", "words", "a", "pos", "known"))
    whole = told.groupBy("lang", "words", "a").agg(F.sort_array(F.collect_list(F.struct("pos", "known"))).alias("k"))  # as many as a phrase has words
    return whole.select("lang", "words", F.col("k.known").alias("counts"), "a")


def candidates(docs: DataFrame, counts: DataFrame, longest: int, least: int, scratch: Scratch, most_numbered: int = MOST_NUMBERED, longest_numbered: int = LONGEST_NUMBERED) -> DataFrame:
    """lang, words, counts (of each word) and a of every phrase of 2 to ``longest`` words that occurs ``least`` times; ``counts`` are those of all words."""
    frequent = counts.filter(F.col("n") >= least)
    numbering = Numbering(frequent, min(most_numbered, MOST_NUMBERED), longest_numbered)
    words = counts.agg(F.sum("n")).first()[0] or 0
    found = _by_numbers(docs, numbering, longest, least, 1 + words // A_BUCKET, scratch)
    if numbering.rest.limit(1).count():
        found = found.union(_by_text(docs, numbering, longest, least, scratch))
    return scratch.cut(found.withColumn("phrase", F.array_join("words", " ")), "candidates")


def scored(found: DataFrame, longest: int, percent: int) -> DataFrame:
    """Candidates that no longer one stands for, with l, r and score of their lowest cut."""
    inside = [(start, n) for n in range(2, longest) for start in range(longest - n + 1)]
    part = lambda start, n: F.struct(F.lit(start * longest + n).alias("place"), F.array_join(F.slice("words", start + 1, n), " ").alias("part"))
    short = found.filter(F.size("words") == 2).select("lang", F.struct("phrase", "counts", "a").alias("whole"), F.lit(None).cast("map<int,bigint>").alias("f"))
    parts = F.array_compact(F.array(F.lit(None).cast("struct<place:int,part:string>"), *[F.when((start + n <= F.size("words")) & (F.size("words") > n), part(start, n)) for start, n in inside]))
    split = found.filter(F.size("words") > 2).select("lang", F.struct("phrase", "counts", "a").alias("whole"), F.explode(parts).alias("p"))
    split = split.join(found.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f")), (split.lang == found.lang) & (F.col("p.part") == F.col("part"))).select(split.lang, "whole", "p.place", "part", "f")
    long = split.groupBy("lang", "whole").agg(F.map_from_entries(F.collect_list(F.struct("place", "f"))).alias("f"))  # a few a phrase
    held = split.groupBy("lang", F.col("part").alias("phrase")).agg(F.max("whole.a").alias("held"))
    every = short.union(long).select("lang", "whole.*", "f")
    size, million = F.size("counts"), F.lit(1_000_000).cast("decimal(7,0)")
    whole = lambda c: c.cast("decimal(14,0)")  # noqa: E731  (products of three then fit 38 digits)

    def times(start: int, n: Column) -> Column:
        return F.when(n == 1, F.col("counts")[start]).otherwise(F.col("f")[start * longest + n])

    def cut(k: int) -> Column:
        left, right = times(0, F.lit(k)), times(k, size - k)
        score = F.call_function("div", million * whole(F.col("a")) * whole(F.col("a")), whole(left) * whole(right))
        return F.when(size > k, F.struct(score.alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r")))

    every = every.join(held, ["lang", "phrase"], "left").filter(F.col("held").isNull() | (100 * F.col("held") < percent * F.col("a")))
    return every.withColumn("cut", F.array_min(F.array_compact(F.array(*map(cut, range(1, longest)))))).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def best(scores: DataFrame, top: int, tasks: int) -> DataFrame:
    """Each language's first ``top``: of every of ``tasks`` parts of its phrases first, then of what these leave."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    part = F.pmod(F.xxhash64("phrase"), F.lit(tasks))
    first = scores.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top).drop("part")


def collocations(
    docs: DataFrame, longest: int = 3, least: int = 10, percent: int = 50, top: int = 2000, most_numbered: int = MOST_NUMBERED, longest_numbered: int = LONGEST_NUMBERED,
) -> DataFrame:
    """Each language's phrases of 2 to ``longest`` words that hold together best.

    Returns lang, rank, phrase, a (its occurrences), l and r (of the parts of its lowest cut), n
    (words of the language) and score (a million times a * a / (l * r), rounded down).  Phrases
    don't reach over a piece's end.  A phrase that occurs fewer than ``least`` times, or of
    which a longer one makes up ``percent`` or more, is left out.

    Null and empty texts hold no words; a null language is ``und``; repeated rows count each
    time; ties go by a, then by the phrase's bytes.  An empty table gives an empty result.  Other
    columns, whatever their names, are ignored.  Counts up to 10^14 are exact.
    """
    if longest < 2:
        raise ValueError("phrases have two words at least")
    scratch = Scratch(docs.sparkSession, "collocation")
    counts = scratch.cut(word_counts(docs), "counts")
    found = candidates(docs, counts, longest, least, scratch, most_numbered, longest_numbered)
    # As many parts as make both rankings about alike in size.
    chosen = scratch.cut(best(scored(found, longest, percent), top, 1 + isqrt(4 * found.count() // top)), "best")
    sizes = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    return chosen.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
