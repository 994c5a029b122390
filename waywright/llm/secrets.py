"""Secret scans: fixed patterns, and a battery of randomness tests under false-discovery control.

The battery asks of every long token, and of long groups in it, whether its characters look
drawn at random from the encoding that it seems to use: a chi-squared test of uniformity, a
runs test around the alphabet's middle and a serial-correlation test, joined by Fisher's method
into one p value.  How often ordinary text reaches such a value depends on its length and on
how it is written, so tokens are judged in strata of length and family of encodings, against
ordinary text of that length in that family: the joined words of every document, in lower case
or with capitals as in mixed-case names.  A stratum's findings are limited by the
Benjamini-Hochberg rule.  Whole numbers in base 10 or 16 have no ordinary text; from 24 digits
on the battery alone judges them, at the rate of discovery.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from string import ascii_letters, ascii_lowercase, ascii_uppercase, digits

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed patterns of the base scan.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "random")

TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
GROUPS = re.compile(r"[-_]+")
LEAST_GROUP, LEAST_NUMBER = 16, 24
# Encodings, the smallest first; a token is taken to use the first that has all its characters.
ENCODINGS = (
    ("decimal", digits),
    ("hex", digits + "abcdef"),
    ("HEX", digits + "ABCDEF"),
    ("lower", ascii_lowercase),
    ("upper", ascii_uppercase),
    ("base32", ascii_uppercase + "234567"),
    ("base36", ascii_lowercase + digits),
    ("BASE36", ascii_uppercase + digits),
    ("letters", ascii_letters),
    ("base62", ascii_letters + digits),
    ("base64", ascii_uppercase + ascii_lowercase + digits + "+/"),
    ("base64url", ascii_uppercase + ascii_lowercase + digits + "-_"),
    ("base64any", ascii_uppercase + ascii_lowercase + digits + "+/-_"),
)
_SETS = tuple((name, frozenset(a), {c: i for i, c in enumerate(a)}) for name, a in ENCODINGS)
BINS_A_DECADE, MOST_BIN = 8, 255
DISCOVERY = 0.05
#: Lengths of the pieces of joined words, one a stratum, and how much ordinary text a stratum needs of its own.
JOINED = (16, 23, 32, 46, 64, 91, 128)
LEAST_ORDINARY = 200
#: Lengths of joined words with capitals; longer tokens are judged by the longest, as longer words pass for random less often.
CAPITALS = (16, 23, 32)
# Families of encodings: letters in one case, these with digits, letters in both cases, these with digits or signs, and whole numbers.
LOWER, ALNUM, LETTERS, MIXED, NUMBER = range(5)
FAMILY = {"decimal": NUMBER, "hex": NUMBER, "HEX": NUMBER, "lower": LOWER, "upper": LOWER, "base32": ALNUM, "base36": ALNUM, "BASE36": ALNUM, "letters": LETTERS}
#: Alphabets in which ordinary text is counted, by family.
WRITTEN = {LOWER: 26, ALNUM: 36, LETTERS: 52, MIXED: 62}
#: Kinds of a text's counts: tokens by family, and beyond this ordinary text by family.
ORDINARY = 8
COUNTS = np.dtype([("stratum", "u1"), ("kind", "u1"), ("level", "u1"), ("n", "<u4")])
WORD = re.compile(r"(?<!\S)[.,;:!?]*([A-Za-z][a-z]{1,18})[.,;:!?]*(?!\S)")
BLOCK = 1 << 20  # letters at a time
SLICE = 256

Span = tuple[int, int, int]  # start, place of the kind in KINDS, end
Stratum = tuple[int, int]  # of length, and family


def base_spans(text: str) -> list[Span]:
    """Whole matches of the fixed patterns: per kind leftmost and non-overlapping, too short ones dropped."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def encoding_of(token: str) -> tuple[str, dict[str, int]]:
    """Name and character places of the smallest encoding that has all characters; padding at the end doesn't count."""
    used = set(token.rstrip("="))
    for name, chars, place in _SETS:
        if used <= chars:
            return name, place
    return "mixed", {c: i for i, c in enumerate(sorted(used))}


def randomness(token: str) -> float:
    """How well a token passes for random characters of its encoding: a p value, 1 at best."""
    _, place = encoding_of(token)
    at = [place[c] for c in token.rstrip("=")]
    n, size = len(at), len(place)
    if n < 2 or size < 2:
        return 0.0
    counts = Counter(at)
    chi = sum(c * c for c in counts.values()) * size / n - n
    # Mean and variance of the statistic under a uniform multinomial, for any expected counts.
    z = (chi - (size - 1)) / math.sqrt(2 * (size - 1) * (n - 1) / n)
    tests = [max(1e-300, math.erfc(z / math.sqrt(2)) / 2)]
    high = [2 * x >= size for x in at]
    ones = sum(high)
    zeros = n - ones
    if ones and zeros:
        runs = 1 + sum(a != b for a, b in zip(high, high[1:], strict=False))
        mean = 1 + 2 * ones * zeros / n
        spread = math.sqrt(max(1e-9, (mean - 1) * (mean - 2) / (n - 1)))
        tests.append(_two_sided((runs - mean) / spread))
    else:
        tests.append(2.0 ** (1 - n))
    middle = sum(at) / n
    power = sum((x - middle) ** 2 for x in at)
    lag = sum((a - middle) * (b - middle) for a, b in zip(at, at[1:], strict=False)) / power if power else 1.0
    tests.append(_two_sided((lag + 1 / n) * math.sqrt(n)))
    x = -sum(math.log(max(p, 1e-300)) for p in tests)  # half of Fisher's statistic, six degrees of freedom
    return min(1.0, math.exp(-x) * (1 + x + x * x / 2)) if x < 700 else 0.0


def level(token: str) -> int:
    """The bin of a token's p value: 0 for the most random."""
    p = randomness(token)
    return MOST_BIN if p <= 0 else min(MOST_BIN, int(-BINS_A_DECADE * math.log10(p)))


def stratum(n: int) -> int:
    """Lengths in steps of half a doubling."""
    return int(2 * math.log2(n))


def judged(unit: str) -> tuple[Stratum, int]:
    """A unit's stratum and level; letters are in one case if a capital stands at the start alone."""
    unit = unit.rstrip("=")
    if unit.isalpha() and (unit[1:].islower() or unit.isupper()):
        unit = unit.lower()
    return (stratum(max(1, len(unit))), FAMILY.get(encoding_of(unit)[0], MIXED)), level(unit)


def units(token: str) -> list[str]:
    """What of a token is tested: itself and its long groups, or all groups as one where they make a whole number."""
    body = token.rstrip("=")
    if "-" not in body and "_" not in body:
        return [body]
    groups = [g for g in GROUPS.split(body) if g]
    whole = "".join(groups)
    if len(whole) >= LEAST_NUMBER and FAMILY.get(encoding_of(whole)[0]) == NUMBER:
        return [whole]
    return [body, *(g for g in groups if LEAST_GROUP <= len(g) < len(body))]


def _tokens(text: str, spans: list[Span]) -> Iterator[re.Match]:
    """Long tokens that overlap no base span."""
    k = 0
    ends, top = [], 0  # running maximum of ends, as spans may nest
    for s in spans:
        top = max(top, s[2])
        ends.append(top)
    for m in TOKEN.finditer(text):
        while k < len(spans) and spans[k][0] < m.end():
            k += 1
        if not k or ends[k - 1] <= m.start():
            yield m


def joined_words(words: list[str]) -> np.ndarray:
    """The letters of words, joined, from 0 for a, in lower case."""
    return np.frombuffer("".join(words).lower().encode(), np.uint8) - ord("a")


def in_capitals(words: list[str], joined: np.ndarray) -> np.ndarray:
    """Joined words with each word's first letter a capital, from 26 on: how mixed-case names are written."""
    at = joined.copy()
    at[np.cumsum([0, *map(len, words)], dtype=np.int64)[:-1]] += 26
    return at


@functools.cache
def _tables(n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Logarithms of the p values of n characters: of uniformity by the sum of squared counts, of runs by how many are high and change."""
    z = (np.arange(n * n + 1) * size / n - n - (size - 1)) / math.sqrt(2 * (size - 1) * (n - 1) / n)
    even = np.log([max(1e-300, math.erfc(x / math.sqrt(2)) / 2) for x in z.tolist()])
    runs = np.full((n + 1, n), math.log(2.0 ** (1 - n)))
    for ones in range(1, n):
        mean = 1 + 2 * ones * (n - ones) / n
        spread = math.sqrt(max(1e-9, (mean - 1) * (mean - 2) / (n - 1)))
        runs[ones] = [math.log(max(1e-300, _two_sided((1 + x - mean) / spread))) for x in range(n)]
    return even, runs


def levels(at: np.ndarray, sizes: tuple[int, ...] = (26,)) -> list[np.ndarray]:
    """``level`` of each row of a matrix of characters, as places in alphabets of these sizes."""
    k, n = at.shape
    most = min(sizes)
    counts = np.bincount((at + np.arange(k, dtype=np.int32)[:, None] * most).ravel(), minlength=most * k).reshape(k, most).astype(np.int32)
    squares = np.einsum("ij,ij->i", counts, counts)
    wide = at.astype(np.float32)  # sums of integers under 2 ** 24 are exact
    total, own, next_ = wide.sum(1).astype(float), np.einsum("ij,ij->i", wide, wide).astype(float), np.einsum("ij,ij->i", wide[:, 1:], wide[:, :-1]).astype(float)
    middle, power = total / n, own - total * total / n
    lag = next_ - middle * (2 * total - at[:, 0] - at[:, -1]) + (n - 1) * middle * middle
    lag = np.where(n * own > total * total, lag / np.where(power > 0, power, 1), 1.0)
    z = np.abs(lag + 1 / n) * math.sqrt(n / 2)
    serial = np.log([max(1e-300, math.erfc(v)) for v in z.tolist()])
    out = []
    for size in sizes:
        even, runs = _tables(n, size)
        high = 2 * at >= size
        x = -(even[squares] + runs[high.sum(1), (high[:, 1:] != high[:, :-1]).sum(1)] + serial)
        p = np.minimum(1.0, np.exp(-x) * (1 + x + x * x / 2))
        out.append(np.where(p > 0, np.minimum(MOST_BIN, -BINS_A_DECADE * np.log10(np.maximum(p, 1e-320))), MOST_BIN).astype(np.int64))
    return out


def ordinary(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each length in JOINED or CAPITALS and family, how many pieces of that length of each text's joined words have each level: keys (the text's place and the level) and counts."""
    words = [WORD.findall(t) for t in texts]
    plain = list(map(joined_words, words))
    for families, lengths, joined in (((LOWER, ALNUM), JOINED, plain), ((LETTERS, MIXED), CAPITALS, list(map(in_capitals, words, plain)))):
        for n in lengths:
            seen = np.zeros((len(families), len(texts) * (MOST_BIN + 1)), np.int64)
            cut = [x[: len(x) // n * n].reshape(-1, n) for x in joined]
            owner = np.repeat(np.arange(len(joined)), [len(x) for x in cut])
            rows = np.concatenate(cut) if cut else np.zeros((0, n), np.uint8)
            for a in range(0, len(rows), max(1, BLOCK // n)):
                b = a + max(1, BLOCK // n)
                for count, got in zip(seen, levels(rows[a:b], tuple(WRITTEN[f] for f in families)), strict=True):
                    count += np.bincount(owner[a:b] * (MOST_BIN + 1) + got, minlength=len(count))
            for family, count in zip(families, seen, strict=True):
                keys = np.flatnonzero(count)
                yield n, family, keys, count[keys]


def _counts(texts: list[str]) -> list[bytes]:
    """Each text's tokens and ordinary text, as COUNTS."""
    own, parts = [], []
    for i, text in enumerate(texts):
        count = Counter(judged(unit) for m in _tokens(text, base_spans(text)) for unit in units(m.group()))
        own += [(i, s, family, lev, k) for ((s, family), lev), k in count.items()]
    fields = [np.array(c, np.int64) for c in zip(*own, strict=True)] or [np.zeros(0, np.int64)] * 5
    for n, family, keys, k in ordinary(texts):
        parts.append([keys // (MOST_BIN + 1), np.full(len(keys), stratum(n)), np.full(len(keys), ORDINARY + family), keys % (MOST_BIN + 1), k])
    owner, *values = (np.concatenate(x) for x in zip(fields, *parts, strict=True))
    order = np.argsort(owner, kind="stable")
    table = np.empty(len(owner), COUNTS)
    for name, v in zip(COUNTS.names, values, strict=True):
        table[name] = v[order]
    cuts = np.searchsorted(owner[order], np.arange(len(texts) + 1)).tolist()
    return [table[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]


def calibrate(docs: DataFrame, discovery: float = DISCOVERY) -> dict[Stratum, int]:
    """For each stratum with findings, the largest level that counts as random; for whole numbers, the level of the rate of discovery.

    One pass over all whole texts counts ordinary text and tokens by stratum and level.  Each
    text gives one row of counts, and copies of a text count once: they are no evidence of
    their own.  The driver gets the sums, whose number doesn't grow with the rows.  A level's p
    value is the share of ordinary text of that length that reaches it (each count plus one;
    lengths with little take in shorter ones); it is accepted if it is at most ``discovery``
    times the share of the stratum's tokens that reach it.  No texts, or no tokens, give no limits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                texts = [t for t in dict.fromkeys(batch.column(0).slice(at, SLICE).to_pylist()) if t]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([hashlib.sha256(t.encode()).digest()[:16] for t in texts], pa.binary()), pa.array(_counts(texts), pa.binary())],
                    names=["text", "counts"],
                )

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1 << 19)  # whole numbers, exact up to 2 ** 53
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(0).to_pylist()), COUNTS)
            sums += np.bincount((x["stratum"].astype(np.int64) << 12) | (x["kind"].astype(np.int64) << 8) | x["level"], x["n"], minlength=len(sums))
        keys = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([*(pa.array(((keys >> shift) & most).astype(np.int32)) for shift, most in ((12, 127), (8, 15), (0, 255))), pa.array(sums[keys].astype(np.int64))], names=["stratum", "kind", "level", "n"])

    seen = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "text binary, counts binary")
    once = seen.groupBy("text").agg(F.first("counts").alias("counts")).select("counts")  # equal for equal texts
    sums = once.mapInArrow(unpack, "stratum int, kind int, level int, n long").groupBy("stratum", "kind", "level").agg(F.sum("n").alias("n"))
    return limits_of([tuple(r) for r in sums.collect()], discovery)


def limits_of(counts: list[tuple[int, int, int, int]], discovery: float) -> dict[Stratum, int]:
    """The Benjamini-Hochberg limit of each stratum, from (stratum of length, kind, level, n) counts."""
    table: dict[tuple[int, int], Counter] = {}
    for s, kind, lev, n in counts:
        table.setdefault((s, kind), Counter())[lev] += n
    limits = {}
    for s, family in sorted(k for k in table if k[1] < ORDINARY):
        if family == NUMBER:
            if s >= stratum(LEAST_NUMBER):
                limits[s, family] = int(-BINS_A_DECADE * math.log10(discovery))
            continue
        tokens, null = table[s, family], Counter()
        for t in sorted((t for t, other in table if other == ORDINARY + family and t <= s), reverse=True):
            null += table[t, ORDINARY + family]
            if null.total() >= LEAST_ORDINARY:
                break
        reached = of_null = 0
        for b in range(MOST_BIN + 1):
            reached, of_null = reached + tokens[b], of_null + null[b]
            if (1 + of_null) / (1 + null.total()) <= discovery * reached / tokens.total():
                limits[s, family] = b
    return limits


def _accepted(token: str, limits: dict[Stratum, int]) -> bool:
    for unit in units(token):
        where, found = judged(unit)
        if where in limits and found <= limits[where]:
            return True
    return False


def find(text: str | None, limits: dict[Stratum, int]) -> list[Span]:
    """All spans of a text, by start and then kind: the base scan's, and tokens that their stratum's limit accepts."""
    if not text:
        return []
    spans = base_spans(text)
    more = [(m.start(), 3, m.end()) for m in _tokens(text, spans) if _accepted(m.group(), limits)]
    return sorted(spans + more)


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, limits: dict[Stratum, int], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_assign, n_access, n_hex, n_random, base_sha256 and spans of each whole text, without a shuffle.

    Spans are code points with exclusive ends, ``kind:start:end``, by start and then kind,
    joined by commas; base_sha256 is the hash of the base scan's alone.  A null text is an
    empty one.  Repeated rows give repeated rows; other columns are ignored.
    """
    fields = [docs.schema[c] for c in keep]
    schema = T.StructType([*fields, *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                found = [find(t, limits) for t in part.column(len(keep)).to_pylist()]
                columns = [part.column(i) for i in range(len(keep))]
                columns += [pa.array([sum(s[1] == k for s in spans) for spans in found], pa.int64()) for k in range(len(KINDS))]
                columns.append(pa.array([hashlib.sha256(written([s for s in spans if s[1] < 3]).encode()).hexdigest() for spans in found]))
                columns.append(pa.array([written(spans) for spans in found], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(*keep, F.col("text").cast("string").alias("_text_to_scan")).mapInArrow(run, schema)


def redact(docs: DataFrame, limits: dict[Stratum, int], mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns, with each stretch of overlapping spans in ``text`` replaced by ``mark``.

    Null and empty texts stay as they are, as do all other columns and repeated rows; an empty
    table gives an empty result.
    """

    def clean(text: str | None) -> str | None:
        spans = find(text, limits)
        if not spans:
            return text
        out, end = [], 0
        for a, _, b in spans:
            if a >= end:
                out += [text[end:a], mark]
            end = max(end, b)
        return "".join([*out, text[end:]])

    names, place = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                columns = part.columns
                columns[place] = pa.array([clean(t) for t in columns[place].to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)
