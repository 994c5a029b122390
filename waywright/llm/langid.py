"""Language of texts by a convolutional network over bytes, trained in numpy.

A text's UTF-8 bytes (A-Z lower-cased) are cut into windows of fixed length.  Filters of
several widths slide over embedded bytes, each keeps its greatest response in a window, and a
softmax over these gives the window's languages.  A text's languages are the mean over all its
windows, weighed by their bytes, so that every byte counts and a foreign passage stays a part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import without_collector
from .scratch import Scratch

#: Bytes of a window; widths of filters, how many there are of each, and numbers that stand for a byte.
WINDOW, WIDTHS, FILTERS, EMBEDDED = 256, (2, 3, 4, 5), 16, 8
WIDEST = max(WIDTHS)
#: Distinct texts a language that training reads, about, and windows of each; languages, at most.
SAMPLE_TEXTS, SAMPLE_WINDOWS, MOST_LANGUAGES = 1_000, 3, 200
#: Windows that are convolved at a time.
TILE = 32
#: Bytes of texts that are gathered before they are scored; a longer text is scored by parts of as many.
GATHERED = 1 << 20
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


@dataclass
class Model:
    """Languages in order, byte embeddings, filters (rows: place and embedded number), biases, and softmax weights."""

    langs: list[str] = field(default_factory=list)
    embedding: np.ndarray | None = None
    filters: np.ndarray | None = None
    bias: np.ndarray | None = None
    out: np.ndarray | None = None
    out_bias: np.ndarray | None = None


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; such rows teach nothing.  False for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def mask() -> np.ndarray:
    """1 where a filter has a weight: the narrower ones don't reach all places."""
    own = np.zeros((WIDEST, EMBEDDED, len(WIDTHS) * FILTERS), np.float32)
    for i, width in enumerate(WIDTHS):
        own[:width, :, i * FILTERS : (i + 1) * FILTERS] = 1
    return own.reshape(WIDEST * EMBEDDED, -1)


def patches(embedding: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Each place's embedded bytes with those after it, up to the widest filter; the last places are short of some and left out."""
    x = embedding[flat]
    n = len(flat) - WIDEST + 1
    return np.ascontiguousarray(np.lib.stride_tricks.as_strided(x, (n, WIDEST * EMBEDDED), (x.strides[0], x.strides[1])))


def pooled(model: Model, flat: np.ndarray, last: np.ndarray | None = None) -> np.ndarray:
    """Each window's greatest response of every filter; ``flat`` holds whole windows and WIDEST - 1 bytes beyond.

    In ``last`` windows, whose last WIDEST - 1 bytes are empty, filters don't look on into the next window.
    """
    n = (len(flat) - WIDEST + 1) // WINDOW
    out = np.empty((n, model.filters.shape[1]), np.float32)
    for at in range(0, n, TILE):
        part = flat[at * WINDOW : min(n, at + TILE) * WINDOW + WIDEST - 1]
        response = (patches(model.embedding, part) @ model.filters).reshape(-1, WINDOW, out.shape[1])
        if last is not None:
            response[last[at : at + TILE], 1 - WIDEST :] = 0
        out[at : at + TILE] = response.max(axis=1)
    return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def languages(model: Model, pool: np.ndarray) -> np.ndarray:
    """Each window's share of every language."""
    return softmax((np.maximum(pool + model.bias, 0) @ model.out + model.out_bias).astype(float))


def fit(windows: list[bytes], langs: list[str], steps: int = 500, batch: int = 96, rate: float = 0.01, seed: int = 11) -> Model:
    """A network trained on windows of at most WINDOW bytes and their languages, by Adam on the cross entropy.

    Languages weigh alike, however many windows they have.  Some windows are cut short, so that
    short texts are known as well.  Only a filter's greatest place in a window passes a gradient on.
    """
    names = sorted(set(langs))
    rng = np.random.default_rng(seed)
    y = np.searchsorted(names, langs)
    x = np.zeros((len(windows), WINDOW + WIDEST - 1), np.uint8)
    for i, w in enumerate(windows):
        x[i, : len(w)] = np.frombuffer(w, np.uint8)
    n_filters, keep = len(WIDTHS) * FILTERS, mask()
    p = {
        "embedding": rng.normal(0, 0.5, (256, EMBEDDED)), "filters": rng.normal(0, 1, keep.shape) / np.sqrt(keep.sum(axis=0)) * keep, "bias": np.zeros(n_filters),
        "out": rng.normal(0, 0.1, (n_filters, len(names))), "out_bias": np.zeros(len(names)),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    p["embedding"][0] = 0
    mean, square = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    of_lang = [np.flatnonzero(y == j) for j in range(len(names))]
    for t in range(1, steps + 1):
        rows = np.array([rng.choice(of_lang[j]) for j in rng.integers(0, len(names), batch)])
        own = x[rows].copy()
        for i in np.flatnonzero(rng.random(batch) < 0.4):
            own[i, rng.integers(8, WINDOW) :] = 0
        model = Model(names, *(p[k] for k in ("embedding", "filters", "bias", "out", "out_bias")))
        every = np.stack([patches(model.embedding, w) for w in own])
        response = every @ model.filters
        place = response.argmax(axis=1)
        pool = np.take_along_axis(response, place[:, None], axis=1)[:, 0]
        hidden = np.maximum(pool + model.bias, 0)
        share = softmax(hidden @ model.out + model.out_bias)
        share[np.arange(batch), y[rows]] -= 1
        share /= batch
        back = (share @ model.out.T) * (hidden > 0)
        chosen = np.take_along_axis(every, place[:, :, None], axis=1)  # window, filter, patch
        grad = {"out": hidden.T @ share, "out_bias": share.sum(axis=0), "bias": back.sum(axis=0), "filters": np.einsum("wf,wfp->pf", back, chosen) * keep}
        to_bytes = np.zeros((256, EMBEDDED), np.float32)
        behind = (back[:, :, None] * model.filters.T[None]).reshape(batch, n_filters, WIDEST, EMBEDDED)
        held = own[np.arange(batch)[:, None, None], place[:, :, None] + np.arange(WIDEST)]
        for c in range(EMBEDDED):
            to_bytes[:, c] = np.bincount(held.ravel(), behind[..., c].ravel(), minlength=256)
        to_bytes[0] = 0  # what stands beyond a text stays at zero
        grad["embedding"] = to_bytes
        for k, g in grad.items():
            mean[k] = 0.9 * mean[k] + 0.1 * g
            square[k] = 0.99 * square[k] + 0.01 * g * g
            p[k] = (p[k] - rate * (1 - t / (steps + 1)) * (mean[k] / (1 - 0.9**t)) / (np.sqrt(square[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return Model(names, *(p[k] for k in ("embedding", "filters", "bias", "out", "out_bias")))


def _sample(docs: DataFrame, texts: int, windows: int, most: int, scratch: Scratch) -> list:
    """(lang, window) rows: of about ``texts`` distinct texts of each of the ``most`` frequent languages, chosen by a hash, ``windows`` places each."""
    known = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.col("doc_id").alias("id"))
    known = known.filter(F.col("lang").isNotNull() & ~held_out(F.col("id")) & F.col("text").rlike(r"\p{L}")).select("lang", "text", F.xxhash64("text").alias("h"))
    kinds = scratch.cut(known.groupBy("lang", "h").agg(F.lit(1).alias("one")).groupBy("lang").agg(F.count("*").alias("n")), "kinds")
    sizes = {r.lang: r.n for r in kinds.orderBy(F.desc("n"), "lang").limit(most).collect()}
    if not sizes:
        return []
    whole = 1 << 30
    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(whole, int(whole * texts / n))))])
    chosen = known.filter(F.col("lang").isin(list(sizes)) & (F.pmod(F.col("h"), F.lit(whole)) < share[F.col("lang")]))
    size = F.octet_length("text")
    at = lambda k: F.pmod(F.xxhash64("h", F.lit(k)), F.greatest(F.lit(1), size - WINDOW + 1)).cast("int")
    cut = F.array(*[F.substring(F.col("text").cast("binary"), at(k) + 1, F.lit(WINDOW)) for k in range(windows)])
    rows = chosen.select("lang", "h", F.explode(F.array_distinct(cut)).alias("window")).groupBy("lang", "h", "window").agg(F.lit(1).alias("one"))  # copies teach once
    return sorted((r.lang, bytes(r.window)) for r in rows.select("lang", "window").collect())


def train(docs: DataFrame, texts: int = SAMPLE_TEXTS, windows: int = SAMPLE_WINDOWS, most: int = MOST_LANGUAGES, steps: int = 500) -> Model:
    """Learn from text and lang of the documents that aren't held out.

    About ``texts`` distinct texts a language, chosen by a hash of the text, give ``windows``
    windows each, so the driver gets a bounded number of bytes however often texts repeat; the
    ``most`` frequent languages are learnt.  Rows without a language or a letter teach nothing.
    One language alone is always predicted; without any, all texts are ``und``.  Other columns
    of any name are ignored.
    """
    rows = _sample(docs, texts, windows, most, Scratch(docs.sparkSession, "langid"))
    langs = sorted({lang for lang, _ in rows})
    if len(langs) < 2:
        return Model(langs)
    return fit([w.lower() for _, w in rows], [lang for lang, _ in rows], steps)


def _scores(model: Model, texts: list[bytes]) -> np.ndarray:
    """Each text's share of every language."""
    counts = [max(1, -(-(len(t) + WIDEST - 1) // WINDOW)) for t in texts]
    starts = np.concatenate([[0], np.cumsum(counts)])
    flat = np.zeros(starts[-1] * WINDOW + WIDEST - 1, np.uint8)
    for t, at in zip(texts, starts.tolist(), strict=False):
        flat[at * WINDOW : at * WINDOW + len(t)] = np.frombuffer(t, np.uint8)
    size = np.array([len(t) for t in texts])
    own = np.repeat(np.arange(len(texts)), counts)
    weight = np.clip(size[own] - (np.arange(starts[-1]) - starts[own]) * WINDOW, 0, WINDOW)
    last = np.zeros(starts[-1], bool)
    last[starts[1:] - 1] = True
    shares = languages(model, pooled(model, flat, last)) * weight[:, None]
    return np.add.reduceat(shares, starts[:-1], axis=0)


class Predictor:
    """Languages of texts by a model; texts are gathered so that windows fill tiles."""

    def __init__(self, model: Model):
        self.model = model

    def shares(self, texts: list[bytes]) -> np.ndarray:
        """Sums over windows, weighed by bytes; of long texts, part by part."""
        out = np.zeros((len(texts), len(self.model.langs)))
        held: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            if len(text) > GATHERED:
                for at in range(0, len(text), GATHERED):  # a multiple of WINDOW; the filters look on into the next part
                    out[i] += self._part(text, at)
                continue
            held.append(i)
            size += len(text)
            if size > GATHERED:
                out[held] = _scores(self.model, [texts[k] for k in held])
                held, size = [], 0
        if held:
            out[held] = _scores(self.model, [texts[k] for k in held])
        return out

    def _part(self, text: bytes, at: int) -> np.ndarray:
        part = np.frombuffer(text, np.uint8, min(GATHERED, len(text) - at), at)
        n = -(-len(part) // WINDOW)
        flat = np.zeros(n * WINDOW + WIDEST - 1, np.uint8)
        seen = np.frombuffer(text, np.uint8, min(len(flat), len(text) - at), at)
        flat[: len(seen)] = seen
        weight = np.clip(len(part) - np.arange(n) * WINDOW, 0, WINDOW)
        return weight @ languages(self.model, pooled(self.model, flat))

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float], list[int]]:
        lettered = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
        langs, scores, windows = [UNKNOWN] * len(texts), [0.0] * len(texts), [0] * len(texts)
        if not self.model.langs:
            return langs, scores, windows
        own = [texts[i].encode().lower() for i in lettered]
        if len(self.model.langs) == 1:
            share = np.ones((len(own), 1))
        else:
            share = self.shares(own) / np.maximum(1, [len(t) for t in own])[:, None] if own else np.zeros((0, 1))
        for k, i in enumerate(lettered):
            best = int(share[k].argmax())
            langs[i], scores[i], windows[i] = self.model.langs[best], float(min(1.0, share[k, best])), -(-len(own[k]) // WINDOW)
        return langs, scores, windows


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The language of every whole text, found where it is read, without any shuffle.

    Returns ``keep`` columns, lang_pred, score (the language's mean share, 0 to 1) and
    n_windows.  A null text, or one without a letter, is ``und`` with score 0.  Repeated rows
    are each answered alike, ties go to the first language by name, and an empty table gives
    an empty result.  Columns other than text are only passed on, never read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size
    names = ["lang_pred", "score", "n_windows"]
    schema = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(n, t) for n, t in zip(names, (T.StringType(), T.DoubleType(), T.IntegerType()), strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                with without_collector():
                    found = predictor(part.column(len(keep)).to_pylist())
                own = [pa.array(x, t) for x, t in zip(found, (pa.string(), pa.float64(), pa.int32()), strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), *own], names=schema.names)

    return docs.select(*keep, F.col("text").cast("string").alias("_text_to_tell")).mapInArrow(run, schema)
