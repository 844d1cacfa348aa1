"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed byte trigrams (their shares in the text) and the share of words that repeat the word before
them is shared by all grades; ordered thresholds cut its
score into grades: P(grade <= k) = sigmoid(threshold_k - score). A document gets its expected grade and the probability of
the selected grade or a better one. Any number of grades works; two make it a logistic regression.

Null or empty text (and texts under three bytes): score 0, so the probabilities are those of the thresholds alone. Repeated
rows: the same result. Very long texts are scored whole. Without labels, or with one grade only, every document is kept with
probability 1. Null labels are left out; of several labels of one doc_id the largest counts. An empty table gives no row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Buckets of hashed trigrams.
BUCKETS = 1 << 15
#: Bounds of the sample for fitting: documents for each grade, and bytes of a text.
MOST_LABELLED, LONGEST = 3_000, 1 << 14
SCALE = 50.0
#: Added to the number of trigrams (words) under a share, so that a few of them decide little.
CALM, CALM_WORDS = 40, 8
STEPS = 150


@dataclass
class Ordinal:
    """Weights of the buckets, thresholds between the grades, and the grades from worst to best."""

    weights: np.ndarray
    thresholds: np.ndarray
    grades: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for each row and each grade but the worst."""
        return sigmoid(score[:, None] - self.thresholds[None, :])

    def expected(self, score: np.ndarray) -> np.ndarray:
        return self.grades[0] + self.tails(score) @ np.diff(self.grades)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def trigrams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all trigrams that lie in one text, and how many each text has."""
    counts = np.maximum(np.diff(at) - 2, 0)
    code = data[:-2].astype(np.uint32) | data[1:-1].astype(np.uint32) << np.uint32(8) | data[2:].astype(np.uint32) << np.uint32(16) if len(data) > 2 else np.zeros(0, np.uint32)
    bucket = (code * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
    inside = np.ones(len(code), bool)
    for k in (1, 2):  # trigrams that reach into the next text
        border = at[1:-1] - k
        inside[border[(border >= 0) & (border < len(code))]] = False
    return bucket[inside], counts


def repeats(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each text the scaled share of words that equal the word before."""
    from parley.llm.shared import IS_SPACE, Spans, runs, sums_by

    starts, ends, counts = runs(~IS_SPACE[data], at)
    word = Spans(data).hash(starts, ends)
    same = np.zeros(len(word))
    same[1:] = word[1:] == word[:-1]
    same[(np.cumsum(counts) - counts)[counts > 0]] = 0
    return SCALE * sums_by(same, counts) / (counts + CALM_WORDS)


def fit(texts: pa.Array, label: np.ndarray) -> Ordinal | None:
    """Maximum likelihood with a small ridge, by full-batch Adam; None if there are fewer than two grades."""
    from parley.llm.shared import flat, text_slices

    grades = np.unique(label)
    if len(grades) < 2:
        return None
    parts = []
    for part, first, end in text_slices(texts):
        text = flat(part)
        bucket, counts = trigrams(*text)
        owner = np.repeat(np.arange(len(counts)), counts)
        pair, times = np.unique(owner * BUCKETS + bucket, return_counts=True)
        owner, bucket = pair // BUCKETS, pair % BUCKETS
        share = SCALE * times / (counts[owner] + CALM)
        # the last weight is that of the repeated words
        parts.append((owner + first, bucket, share))
        parts.append((np.arange(first, end), np.full(end - first, BUCKETS), repeats(*text)))
    owner, bucket, share = (np.concatenate(x).astype(kind) for x, kind in zip(zip(*parts, strict=True), (np.int32, np.int32, np.float32), strict=True))
    n = BUCKETS + 1
    y = np.searchsorted(grades, label)
    # grades count alike, however common they are
    weight = 1 / np.bincount(y)[y] * len(y) / len(grades)
    k = len(grades) - 1
    theta = np.concatenate((np.zeros(n), [-(k - 1) / 2], np.zeros(k - 1)))  # weights, first threshold, log gaps
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        w, gaps = theta[:n], np.exp(theta[n + 1 :])
        cut = np.concatenate(([-np.inf], theta[n] + np.concatenate(([0], np.cumsum(gaps))), [np.inf]))
        score = np.bincount(owner, w[bucket] * share, len(y))
        upper, lower = sigmoid(cut[y + 1] - score), sigmoid(cut[y] - score)
        p = np.maximum(upper - lower, 1e-9)
        by_score = -(upper + lower - 1) * weight / len(y)
        by_cut = np.zeros(k + 2)
        np.add.at(by_cut, y + 1, -upper * (1 - upper) / p * weight / len(y))
        np.add.at(by_cut, y, lower * (1 - lower) / p * weight / len(y))
        by_cut = by_cut[1:-1]
        later = np.cumsum(by_cut[::-1])[::-1]  # a gap moves all thresholds above it
        gradient = np.concatenate((np.bincount(bucket, by_score[owner] * share, n) + 1e-5 * w, [later[0]], later[1:] * gaps))
        m = 0.9 * m + 0.1 * gradient
        v = 0.99 * v + 0.01 * gradient**2
        theta -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Ordinal(theta[:n], theta[n] + np.concatenate(([0], np.cumsum(np.exp(theta[n + 1 :])))), grades.astype(float))


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", most: int = MOST_LABELLED) -> Ordinal | None:
    """Fits on a bounded sample: at most `most` documents for each grade, texts of at most LONGEST bytes."""
    from parley.llm import labelled

    rows = labelled.sample(docs, labels, column, most, longest=LONGEST).select("doc_id", "text", "label").toArrow().sort_by("doc_id")
    return fit(rows.column("text").combine_chunks() if rows.num_rows else pa.array([], pa.string()), rows.column("label").to_numpy())


def scores(texts: pa.Array, model: Ordinal) -> np.ndarray:
    from parley.llm.shared import flat, sums_by

    text = flat(texts)
    bucket, counts = trigrams(*text)
    return SCALE * sums_by(model.weights[bucket], counts) / (counts + CALM) + model.weights[BUCKETS] * repeats(*text)


def graded(docs: DataFrame, model: Ordinal | None, best: int = 1, names: tuple[str, str] = ("quality_expected", "quality_tail")) -> DataFrame:
    """All columns of docs as they are, then the expected grade and the probability of one of the `best` highest grades.

    names: of the new columns; docs must have none of them (`shared.unused` finds free ones).
    """
    from parley.llm.shared import numbered, slices

    plain, text = numbered(docs), f"c{docs.columns.index('text')}"
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in slices(batches, text):
            n = batch.num_rows
            if model is None:
                expected, tail = np.full(n, np.nan), np.ones(n)
            else:
                score = scores(batch.column(text), model)
                expected, tail = model.expected(score), model.tails(score)[:, -best]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(expected, from_pandas=True), pa.array(tail)], names=[*batch.schema.names, *names])

    schema = T.StructType(plain.schema.fields[:]).add(names[0], "double").add(names[1], "double")
    return plain.mapInArrow(run, schema).toDF(*docs.columns, *names)
