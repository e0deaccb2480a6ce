"""Severity of toxic language by cumulative-link ordinal regression.

P(grade <= k) = sigmoid(t_k - w.x) for ordered thresholds t_k: all thresholds
share the weights w of sparse text features (which hashed words a text has).
The model is fitted on a bounded sample of labelled rows, with an L1 penalty
that leaves weight on few words, and every document is scored by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as W

#: Labelled rows that the fit takes at most, those whose ids hash lowest.
SAMPLE = 20_000
BUCKETS = 1 << 18
LETTERS = W.delimited("".join(chr(c) for c in range(128) if not chr(c).isalnum()))


def _features(part: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """Text and bucket of the distinct hashed words of each text of a slice."""
    bucket = (part.hashes & np.uint64(BUCKETS - 1)).astype(np.int64)
    pair = np.unique(part.doc * BUCKETS + bucket)
    return pair // BUCKETS, pair % BUCKETS


def _collect_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part in W.words(b.column(1), LETTERS, lower=True):
            doc, bucket = _features(part)
            offsets = np.searchsorted(doc, np.arange(part.n + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(part.first, part.n), pa.ListArray.from_arrays(pa.array(offsets), pa.array(bucket.astype(np.int32)))], ["grade", "features"])


@dataclass
class Model:
    """Shared weights by bucket, and thresholds in rising order; ``cut`` is the expected severity from which a text is rejected."""

    weights: np.ndarray
    thresholds: np.ndarray
    cut: float = 0.5

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score and threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))

    def expected(self, score: np.ndarray) -> np.ndarray:
        return self.above(score).sum(axis=1)


def _scores(weights: np.ndarray, doc: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, weights[bucket], n)


def fit(grade: np.ndarray, doc: np.ndarray, bucket: np.ndarray, penalty: float = 1e-3, steps: int = 120) -> Model:
    """Accelerated proximal gradient on the mean negative log-likelihood.

    ``grade`` has grades from 0; ``doc`` and ``bucket`` the features.  With no
    rows, or one grade only, every text gets that grade's severity (0 without rows).
    """
    n, levels = len(grade), int(grade.max(initial=0))
    if not n or not levels:
        return Model(np.zeros(BUCKETS), np.empty(0))
    seen, column = np.unique(bucket, return_inverse=True)
    weights, share = np.zeros(len(seen)), np.array([(grade > k).mean() for k in range(levels)])
    share = np.clip(share, 1 / (2 * n), 1 - 1 / (2 * n))
    t = np.maximum.accumulate(np.log((1 - share) / share) + np.arange(levels) * 1e-3)
    df = np.bincount(column, minlength=len(seen))
    weight_step = 8.0 / max(1.0, float(np.sqrt((df.astype(float) ** 2).sum()) / n) * 2)
    ahead_w, ahead_t, momentum = weights.copy(), t.copy(), 1.0
    hit = grade[:, None]
    level = np.arange(levels)[None, :]
    for _ in range(steps):
        score = np.bincount(doc, ahead_w[column], n)
        upper = np.where(hit < levels, 1 / (1 + np.exp(-np.clip(ahead_t[np.minimum(grade, levels - 1)] - score, -40, 40)))[:, None], 1.0)
        lower = np.where(hit > 0, 1 / (1 + np.exp(-np.clip(ahead_t[np.maximum(grade - 1, 0)] - score, -40, 40)))[:, None], 0.0)
        p = np.maximum(upper - lower, 1e-12)
        du, dl = (upper * (1 - upper) / p)[:, 0], (lower * (1 - lower) / p)[:, 0]
        slope = (du - dl) / n  # of the loss, by the score
        grad_w = np.bincount(column, slope[doc], len(seen))
        grad_t = -((level == hit) * (du / n)[:, None] - (level == hit - 1) * (dl / n)[:, None]).sum(axis=0)
        new = ahead_w - weight_step * grad_w
        new = np.sign(new) * np.maximum(np.abs(new) - weight_step * penalty, 0)
        new_t = np.maximum.accumulate(ahead_t - 2.0 * grad_t)
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead_w, ahead_t = new + (momentum - 1) / after * (new - weights), np.maximum.accumulate(new_t + (momentum - 1) / after * (new_t - t))
        if (grad_w * (new - weights)).sum() > 0:  # overshot: start the momentum anew
            ahead_w, ahead_t, after = new.copy(), new_t.copy(), 1.0
        weights, t, momentum = new, new_t, after
    full = np.zeros(BUCKETS)
    full[seen] = weights
    return Model(full, t)


def loss(model: Model, grade: np.ndarray, score: np.ndarray) -> float:
    """Mean negative log-likelihood of grades."""
    above = np.hstack([np.ones((len(score), 1)), model.above(score), np.zeros((len(score), 1))])
    k = np.minimum(grade, above.shape[1] - 2)
    rows = np.arange(len(score))
    return float(-np.log(np.maximum(above[rows, k] - above[rows, k + 1], 1e-12)).mean())


def best_cut(grade: np.ndarray, severity: np.ndarray) -> float:
    """Halfway between the two severities that the best F1 for grades above 0 parts."""
    n, order = len(grade), np.argsort(-severity, kind="stable")
    f1 = 2 * np.cumsum(grade[order] > 0) / (np.arange(1, n + 1) + (grade > 0).sum())
    ends = np.append(severity[order][1:] < severity[order][:-1], True)
    best = int(np.argmax(np.where(ends, f1, -1)))
    lower = severity[order][best + 1] if best + 1 < n else 0.0
    return float((severity[order][best] + lower) / 2)


def fit_held_out(grade: np.ndarray, doc: np.ndarray, bucket: np.ndarray, penalties: tuple[float, ...] = (1e-3, 4e-3, 1.6e-2)) -> Model:
    """The penalty of the smallest loss on held-out halves, with the cut that is best there, fitted on all rows."""
    n = len(grade)
    if n < 20 or not grade.any():
        model = fit(grade, doc, bucket)
        model.cut = best_cut(grade, model.expected(_scores(model.weights, doc, bucket, n))) if grade.any() else model.cut
        return model
    half = np.arange(n) % 2
    found = []
    for penalty in penalties:
        lost, severity = 0.0, np.zeros(n)
        for own in (0, 1):
            inner = half[doc] != own
            place = np.cumsum(half != own) - 1
            model = fit(grade[half != own], place[doc[inner]], bucket[inner], penalty)
            scores = _scores(model.weights, doc, bucket, n)[half == own]
            lost += loss(model, grade[half == own], scores)
            severity[half == own] = model.expected(scores)
        found.append((lost, penalty, best_cut(grade, severity)))
    _, penalty, cut = min(found)
    model = fit(grade, doc, bucket, penalty)
    model.cut = cut
    return model


def train(docs: DataFrame, grades: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", sample: int = SAMPLE) -> Model:
    """A model from the labelled documents; at most ``sample`` labels are taken, so what reaches the driver is bounded.

    Rows of ``grades`` with a null id or grade don't count.
    """
    spark = docs.sparkSession
    chosen = grades.select(grades[id_col].alias("id"), grades[grade_col].cast("int").alias("grade")).where("id is not null and grade is not null")
    chosen = chosen.orderBy(F.xxhash64("id"), "id", "grade").limit(sample)
    rows = [(r.id, r.grade) for r in chosen.collect()]
    known = spark.createDataFrame(rows, chosen.schema)
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).join(F.broadcast(known), "id").select("grade", "text")
    table = texts.mapInArrow(_collect_features, "grade int, features array<int>").toArrow().combine_chunks()
    lists = table["features"].combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.int32()))
    size = lists.value_lengths().to_numpy(zero_copy_only=False) if len(lists) else np.empty(0, np.int64)
    return fit_held_out(table["grade"].to_numpy().astype(np.int64), np.repeat(np.arange(len(size)), size), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64))


def _judge(at: np.ndarray, small: Model):
    """Slices of a text column with the severity of each text; ``small`` has the weights of the buckets ``at`` only."""
    own = np.zeros(BUCKETS)
    own[at] = small.weights
    marked = own != 0

    def run(texts: pa.Array) -> Iterator[tuple[W.Words, np.ndarray]]:
        for part in W.words(texts, LETTERS, lower=True):
            bucket = (part.hashes & np.uint64(BUCKETS - 1)).astype(np.int64)
            hit = marked[bucket]
            pair = np.unique(part.doc[hit] * BUCKETS + bucket[hit])
            yield part, small.expected(_scores(own, pair // BUCKETS, pair % BUCKETS, part.n))

    return run


def _rejected(model: Model, severity: np.ndarray) -> np.ndarray:
    if not len(model.thresholds):
        return np.zeros(len(severity), bool)
    return (severity >= model.cut) & (severity > model.expected(np.zeros(1))[0])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, severity, rejected) for every row: the expected grade, and whether it reaches the model's cut.

    One pass over whole texts without a shuffle.  A null or wordless text has
    no features and gets the severity of such a text; a text isn't rejected
    unless its words raise its severity above that; repeated rows stay; other
    columns aren't read.  The model goes to the tasks with its weights
    that aren't zero, of which there are at most ``BUCKETS``.
    """
    at = np.flatnonzero(model.weights)
    small = Model(model.weights[at], model.thresholds, model.cut)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _judge(at, small)
        for b in batches:
            for part, severity in judge(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(part.first, part.n), pa.array(severity), pa.array(_rejected(small, severity))], ["id", "severity", "rejected"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, severity double, rejected boolean").withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text isn't rejected; one pass without a shuffle."""
    at = np.flatnonzero(model.weights)
    small, place = Model(model.weights[at], model.thresholds, model.cut), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _judge(at, small)
        for b in batches:
            for part, severity in judge(b.column(place)):
                yield b.slice(part.first, part.n).filter(pa.array(~_rejected(small, severity)))

    return docs.mapInArrow(run, docs.schema)


def grades_of(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) from 0/1 labels: 0 not toxic, 1 toxic in a text of good quality, 2 toxic in one of poor quality."""
    return labels.select("doc_id", F.when(F.col("toxic") == 0, 0).when(F.col("quality") == 0, 2).otherwise(1).alias("grade")).where("grade is not null")
