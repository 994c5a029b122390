"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, learnt from document labels.

A sentence's score is a logistic function of the evidence in it: words and word beginnings
that a test on label counts finds to mark toxic documents.  A document is toxic unless
every sentence and a leak (what labels hold beyond the evidence) fail to make it so.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import without_collector
from .scratch import Scratch

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
STEMS = range(3, 7)
SAMPLE_ROWS = 8_000
LEAST_DOCS = 4
LEAST_G = 20.0
L2 = 0.02
SLICE = 256
MOST_WORDS = 100_000
MOST_COUNTED = 100_000


@dataclass
class Model:
    """Weights of features, a bias, and the leak's probability."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    leak: float = 0.0


def held_out(doc_id) -> F.Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; such rows teach nothing.  False for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def features(word: str) -> list[str]:
    """The word itself and, marked by a star, its beginnings."""
    return [word, *(word[:k] + "*" for k in STEMS if len(word) >= k)]


def _sample(docs: DataFrame, labels: DataFrame, rows: int, scratch: Scratch) -> DataFrame:
    """About ``rows`` labelled documents, chosen by a hash of id and text; all, if there are no more.  Rows that repeat both count once."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(~held_out(F.col("doc_id"))).withColumn("said", F.xxhash64("text"))
    there = texts.select("doc_id", "said").join(known, "doc_id", "left_semi").groupBy("doc_id", "said").agg(F.lit(1).alias("one"))
    share = min(1.0, rows / max(1, there.count()))
    chosen = F.pmod(F.xxhash64("doc_id", "said"), F.lit(1 << 30)) < int(share * (1 << 30))
    return scratch.cut(texts.filter(chosen).join(known, "doc_id").groupBy("doc_id", "said").agg(F.min("text").alias("text"), F.min("toxic").alias("toxic")), "sample")


def _counted(sample: DataFrame) -> DataFrame:
    """feature, documents that have it, toxic ones among them."""

    def rows(count: list[Counter]) -> pa.RecordBatch:
        every = list(count[0].keys() | count[1].keys())
        toxic = [count[1][f] for f in every]
        return pa.RecordBatch.from_arrays([pa.array(every, pa.string()), pa.array([count[0][f] + n for f, n in zip(every, toxic, strict=True)], pa.int64()), pa.array(toxic, pa.int64())], names=["feature", "docs", "toxic"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = [Counter(), Counter()]
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = set(WORD.findall((text or "").lower()))
                count[toxic].update({f for w in words for f in features(w)})
                if len(count[0]) + len(count[1]) > MOST_COUNTED:
                    yield rows(count)
                    count = [Counter(), Counter()]
        yield rows(count)

    found = sample.select("text", "toxic").mapInArrow(run, "feature string, docs long, toxic long")
    return found.groupBy("feature").agg(F.sum("docs").alias("docs"), F.sum("toxic").alias("toxic"))


def _chosen(counts: DataFrame, n: int, n_toxic: int) -> list[str]:
    """All features that toxic documents have more often, by the G test of their counts; the sample bounds their number."""
    p, d, t = n_toxic / n, F.col("docs"), F.col("toxic")

    def term(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    g = 2 * (term(t, d * p) + term(d - t, d * (1 - p)) + term(n_toxic - t, n_toxic - d * p) + term((n - n_toxic) - (d - t), (n - n_toxic) - d * (1 - p)))
    rows = counts.filter((d >= LEAST_DOCS) & (t > d * p)).withColumn("g", g).filter(F.col("g") >= LEAST_G)
    return sorted(r.feature for r in rows.select("feature").collect())


def _evidence(sample: DataFrame, chosen: list[str]) -> DataFrame:
    """doc_id, toxic, found (for each kind of sentence with evidence, the places of its features in ``chosen``) and times (how many sentences are of that kind)."""
    place = sample.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(chosen)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, times = [], []
            for text in batch.column(1).to_pylist():
                kinds = Counter(tuple(sorted({place.value[f] for w in WORD.findall(s) for f in features(w) if f in place.value})) for s in SENTENCE.findall((text or "").lower()))
                kinds.pop((), None)
                kinds = sorted(kinds.items())
                found.append([k for k, _ in kinds])
                times.append([n for _, n in kinds])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.list_(pa.int32()))), pa.array(times, pa.list_(pa.int64()))], names=["doc_id", "toxic", "found", "times"])

    return sample.select("doc_id", "text", "toxic").mapInArrow(run, "doc_id long, toxic int, found array<array<int>>, times array<long>")


def fit(found: list[list[list[int]]], times: list[list[int]], toxic: list[int], n_features: int, steps: int = 400, rate: float = 0.1, l2: float = L2) -> tuple[np.ndarray, float, float]:
    """Weights, bias and leak that maximise the noisy-or likelihood of the labels, less a quadratic penalty.

    A document's label is 0 with the probability that no sentence and no leak makes it 1: the
    product of 1 - sigmoid(bias + sum of weights) over sentences, times 1 - leak.
    """
    y = np.array(toxic, float)
    of_doc = np.array([d for d, s in enumerate(found) for _ in s], np.int64)
    often = np.array([n for t in times for n in t], float)
    of_sent = np.array([i for i, s in enumerate(x for f in found for x in f) for _ in s], np.int64)
    of_feat = np.array([f for s in found for x in s for f in x], np.int64)
    theta = np.concatenate([np.full(n_features, 0.5), [-1.0, math.log((y.mean() * 0.1 + 1e-3) / (1 - y.mean() * 0.1))]])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        w, bias, leak = theta[:-2], theta[-2], theta[-1]
        z = bias + np.bincount(of_sent, w[of_feat], minlength=len(of_doc))
        log_not = -np.logaddexp(0, z)
        log_not_leak = -np.logaddexp(0, leak)
        none = np.exp(np.bincount(of_doc, often * log_not, minlength=len(y)) + log_not_leak)
        pull = np.where(y > 0, -none / np.maximum(1 - none, 1e-9), 1.0)
        slope = often * pull[of_doc] * -np.expm1(log_not)
        grad = np.concatenate([np.bincount(of_feat, slope[of_sent], minlength=n_features), [slope.sum(), pull.sum() * -np.expm1(log_not_leak)]])
        grad[:-1] += l2 * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        # Steps get shorter, so that the last ones settle.
        theta = theta - rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:-2], float(theta[-2]), float(1 / (1 + math.exp(-theta[-1])))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Learn from about ``rows`` labelled documents that aren't held out.

    Counting features and finding evidence run on Spark; the driver gets the evidence of
    the sample only, whose size the parameter bounds.  With no labelled rows the model
    scores 0; with labels of one kind only, it scores their share.

    A null text counts as empty.  An id labelled more than once is toxic if any of its labels
    says so; labels and ids that are null teach nothing.  Rows that repeat an id and its text
    teach once, and the bound holds however many rows an id has.  Other columns of either
    table, whatever their names, are ignored.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    sample = _sample(docs, labels, rows, scratch)
    n, n_toxic = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if n_toxic in (0, n):
        return Model(leak=n_toxic / n if n else 0.0)
    chosen = _chosen(_counted(sample), n, n_toxic)
    seen = sorted(_evidence(sample, chosen).collect())
    weights, bias, leak = fit([r.found for r in seen], [r.times for r in seen], [r.toxic for r in seen], len(chosen))
    scratch.drop("sample")
    return Model(dict(zip(chosen, weights.tolist(), strict=True)), bias, leak)


class Scorer:
    """Scores texts by a model; remembers which words hold no evidence."""

    def __init__(self, model: Model):
        self.model = model
        self.plain: set[str] = set()
        self.telling: dict[str, list[str]] = {}

    def _learn(self, words: set[str]) -> None:
        for w in words:
            if found := [f for f in features(w) if f in self.model.weights]:
                self.telling[w] = found
            else:
                self.plain.add(w)

    def __call__(self, text: str | None) -> tuple[float, int | None, int | None, float | None]:
        """The document's score; start, end (code points) and score of its worst sentence, if any has evidence."""
        text = text or ""
        words = set(WORD.findall(text.lower()))
        if len(self.plain) > MOST_WORDS:
            self.plain.clear()
        self._learn(words - self.plain - self.telling.keys())
        if words.isdisjoint(self.telling):
            return self.model.leak, None, None, None
        none, worst = 1.0 - self.model.leak, (-1.0, None, None)
        for m in SENTENCE.finditer(text):
            found = {f for w in WORD.findall(m.group().lower()) for f in self.telling.get(w, ())}
            if found:
                p = 1 / (1 + math.exp(-max(-500.0, min(500.0, self.model.bias + sum(self.model.weights[f] for f in sorted(found))))))
                none *= 1 - p
                if p > worst[0]:
                    worst = (p, m.start(), m.end())
        return 1 - none, worst[1], worst[2], worst[0] if worst[0] >= 0 else None


def score(docs: DataFrame, model: Model, threshold: float = 0.3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Scores every whole text where it is read, without any shuffle.

    Returns ``keep`` columns, score (0 to 1), predicted (1 if score >= threshold), worst_start,
    worst_end (code points of the worst sentence) and worst_score; the last three are null
    where no sentence has evidence.  A null or empty text has the leak's score, repeated rows
    are each scored, and an empty table gives an empty result.  Columns other than text are
    only passed on, never read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [docs.schema[c] for c in keep]
    schema = T.StructType([*fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("worst_start", T.IntegerType()), T.StructField("worst_end", T.IntegerType()), T.StructField("worst_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                with without_collector():
                    got = [scorer(t) for t in part.column(len(keep)).to_pylist()]
                p, a, b, w = zip(*got, strict=True)
                columns = [part.column(i) for i in range(len(keep))]
                columns += [pa.array(p, pa.float64()), pa.array([int(x >= threshold) for x in p], pa.int32()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(w, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(*keep, F.col("text").cast("string").alias("_text_to_score")).mapInArrow(run, schema)
