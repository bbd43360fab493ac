"""Toxic passages as maximum-scoring segments of token log-odds.

Fit, on a bounded sample of labelled rows:
    1. distinct words are counted per class over the sample's distinct texts;
    2. a word's log-odds between the classes get a Dirichlet prior (the pooled
       word distribution, plus a half count for each word), some standard errors
       and the classes' base rate are taken off; words still above zero are the
       positive tokens, every other token costs ``DRIFT``;
    3. the extreme-value parameters follow from the clean class: lambda solves
       E[exp(lambda * token score)] = 1, K is the maximum-likelihood location of
       the documents' best segments;
    4. the documents' sums of excess bit scores are mapped to a probability.

Score, in one linear pass per text: all maximal scoring segments (Ruzzo and
Tompa), each compared with what a clean text of this length reaches by chance.

Defined results
    * null and empty texts: no tokens, the score of a text without evidence;
    * a label row without a document, or with a null label, is not learned from;
      of several labels of one document the highest counts;
    * no usable labels: every score is 0;
    * repeated rows come back row for row; null ids are never held out;
    * only the named columns are read; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from domsift.llm.common import written

#: Labelled rows a model is fitted on (those of the smallest hashes of their ids).
FIT_ROWS = 20_000
#: Pseudo-counts of the prior that follow the pooled word distribution.
PRIOR = 500.0
#: What a token without evidence takes from a segment.
DRIFT = 0.05
#: Standard errors taken off a word's log-odds before it counts.
STANDARD_ERRORS = 1.5
#: Documents of the toxic class a word must stand in to count at all.
MIN_DOCS = 3
FOLDS, HELD_OUT = 5, 0

_WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Model:
    """``positive``: token scores above zero; at most the sample's vocabulary."""

    positive: dict[str, float]
    drift: float
    lam: float
    k: float
    intercept: float
    slope: float


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


class _Scores(dict):
    """White-space separated chunk -> score of its best word; bounded."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, chunk: str) -> float:
        score = max((self.model.positive.get(w, -self.model.drift) for w in _WORD.findall(chunk)), default=-self.model.drift)
        if len(self) >= 100_000:
            self.clear()
        if len(chunk) <= 64:
            self[chunk] = score
        return score


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), end exclusive; linear time."""
    total = np.concatenate(([0.0], np.cumsum(scores)))
    found: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum after
    for i in np.flatnonzero(scores > 0).tolist():
        start, low, high = i, float(total[i]), float(total[i + 1])
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j -= 1
            if j < 0 or found[j][3] >= high:
                found.append((start, i + 1, low, high))
                break
            start, low = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, high - low) for a, b, low, high in found]


def excess(segments: list[tuple[int, int, float]], n_tokens: int, lam: float, k: float) -> list[float]:
    """By how many nats each segment exceeds what n clean tokens give once by chance."""
    by_chance = math.log(max(1.0, k * n_tokens))
    return [lam * s - by_chance for _, _, s in segments]


def _lambda(positive: list[tuple[float, float]], drift: float) -> float:
    """Root of E[exp(lam * score)] = 1; ``positive``: (score, clean probability)."""

    def over(lam: float) -> float:
        rest = 1.0 - sum(p for _, p in positive)
        return sum(p * math.exp(min(700.0, lam * s)) for s, p in positive) + rest * math.exp(-lam * drift) - 1.0

    low, high = 1e-6, 50.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if over(mid) < 0 else (low, mid)
    return low


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton's method with a slight ridge on the slope, which is never negative."""
    a, b = 0.0, 1.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([(y - p).sum(), ((y - p) * x).sum() - 0.01 * b])
        h = np.array([[w.sum(), (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 0.01]])
        step = np.linalg.solve(h, g)
        a, b = a + float(np.clip(step[0], -2, 2)), max(0.0, b + float(np.clip(step[1], -2, 2)))
    return a, b


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, prior: float = PRIOR, drift: float = DRIFT) -> Model | None:
    """A model from ``labels`` (doc_id, toxic) outside the held-out fold; None without both classes."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("_toxic"))
    )
    chosen = written(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows), "labelled")
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("_text")).join(chosen, "doc_id")
    sample = written(texts.select("_toxic", "_text").distinct(), "labelled-texts")

    def distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [sorted({w for c in set(t.as_py().lower().split()) for w in _WORD.findall(c)}) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string()))], names=["toxic", "words"])

    words = sample.mapInArrow(distinct_words, "toxic int, words array<string>")
    counts = (
        words.select("toxic", F.explode("words").alias("word"))
        .groupBy("word")
        .agg(F.sum("toxic").alias("y1"), F.sum(1 - F.col("toxic")).alias("y0"))
    )
    counts = written(counts, "word-counts")
    n1, n0 = counts.agg(F.sum("y1"), F.sum("y0")).first()
    if not n1 or not n0:
        return None
    pooled, vocabulary = float(n1 + n0), counts.count()
    a0 = prior + 0.5 * vocabulary
    a = prior * (F.col("y1") + F.col("y0")) / pooled + 0.5
    t, c = F.col("y1") + a, F.col("y0") + a
    odds = F.log(t / (n1 + a0 - t)) - F.log(c / (n0 + a0 - c))
    docs1, docs0 = sample.agg(F.sum("_toxic"), F.sum(1 - F.col("_toxic"))).first()
    score = odds - STANDARD_ERRORS * F.sqrt(1 / t + 1 / c) - max(0.0, math.log(docs0 / docs1))
    kept = counts.where(F.col("y1") >= MIN_DOCS).select("word", score.alias("score"), (c / (n0 + a0)).alias("p")).where("score > 0")
    rows = kept.orderBy("word").collect()
    positive = {r.word: r.score for r in rows}
    lam = _lambda([(r.score, r.p) for r in rows], drift) if rows else 1.0

    # best segments and lengths of the sample's texts, for K and for the last mapping
    raw = Model(positive, drift, lam, 1.0, 0.0, 0.0)
    seen = _segments(sample.select(F.col("_toxic").alias("doc_id"), F.col("_text").alias("text")), raw, "doc_id", "text", "int")
    drawn = seen.select("doc_id", "n_tokens", F.transform("segments", lambda s: s["score"]).alias("scores")).collect()  # no more than fit_rows
    toxic = np.array([r.doc_id for r in drawn], dtype=float)
    best = np.array([max(r.scores, default=0.0) for r in drawn])
    size = np.array([r.n_tokens for r in drawn], dtype=float)
    clean = toxic == 0
    k = float(clean.sum() / max(1.0, (size[clean] * np.exp(-lam * best[clean])).sum()))
    x = np.array([_evidence([(0, 0, s) for s in r.scores], r.n_tokens, lam, k) for r in drawn])
    intercept, slope = _logistic(x, toxic)
    return Model(positive, drift, lam, k, intercept, slope)


def _evidence(segments: list, n_tokens: int, lam: float, k: float) -> float:
    """Aggregate of a text: its significant segments' excesses, on a log scale."""
    return math.log1p(sum(max(0.0, e) for e in excess(segments, n_tokens, lam, k)))


def _segments(df: DataFrame, model: Model, id_col: str, text_col: str, kind: str) -> DataFrame:
    """Per row: id, n_tokens, its maximal segments (token positions, score) and its evidence."""
    struct = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _Scores(model)
        for batch in batches:
            size, found, evidence = [], [], []
            for value in batch.column(1):
                chunks = (value.as_py() or "").lower().split()
                segments = maximal_segments(np.fromiter(map(scores.__getitem__, chunks), dtype=np.float64, count=len(chunks)))
                size.append(len(chunks))
                found.append([{"start": a, "end": b, "score": s} for a, b, s in segments])
                evidence.append(_evidence(segments, len(chunks), model.lam, model.k))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int32()), pa.array(found, pa.list_(struct)), pa.array(evidence, pa.float64())],
                names=[id_col, "n_tokens", "segments", "evidence"],
            )

    schema = f"`{id_col}` {kind}, n_tokens int, segments array<struct<start: int, end: int, score: double>>, evidence double"
    return df.select(id_col, text_col).mapInArrow(run, schema)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, score, predicted, n_tokens and the significant passages.

    A passage is a maximal segment that a clean text of this length would show
    less than once; ``start`` and ``end`` count white-space separated tokens.
    """
    model = model or Model({}, DRIFT, 1.0, 1.0, -1e9, 0.0)
    kind = docs.schema[id_col].dataType.simpleString()
    scored = _segments(docs, model, id_col, text_col, kind)
    by_chance = F.log(F.greatest(F.lit(1.0), F.lit(model.k) * F.col("n_tokens")))
    passages = F.filter("segments", lambda s: s["score"] * model.lam > by_chance)
    probability = 1 / (1 + F.exp(-(F.lit(model.intercept) + F.lit(model.slope) * F.col("evidence"))))
    out = scored.select(id_col, held_out(F.col(id_col)).alias("held_out"), probability.alias("score"), "n_tokens", passages.alias("passages"))
    return out.select(id_col, "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_tokens", "passages")


def keep_clean(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``score`` does not predict as toxic, with all their columns."""
    if model is None:
        return docs
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _Scores(model)
        for batch in batches:
            clean = []
            for value in batch.column(at):
                chunks = (value.as_py() or "").lower().split()
                segments = maximal_segments(np.fromiter(map(scores.__getitem__, chunks), dtype=np.float64, count=len(chunks)))
                clean.append(model.intercept + model.slope * _evidence(segments, len(chunks), model.lam, model.k) < 0)
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
