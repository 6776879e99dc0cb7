"""Quality classifier: hashed word and character n-gram vectors averaged per document, softmax, trained by numpy gradient descent."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.llm.blocks import Rolling, BYTE_VALUES, attach, blocks, mix, words
from tidemark.llm.frames import drawn, fold_of, labelled_windows

BUCKETS_LOG2 = 18
DEPTH = 10
GRAMS = (3, 4)
AGAIN = np.uint64(0x51ED270B35A1C0D3)


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every feature of a block, by rows: words, words equal to the one before, and byte n-grams inside a text."""
    start, end, row = words(data, at)
    shift = np.uint64(64 - BUCKETS_LOG2)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = Rolling(BYTE_VALUES[data]).spans(start, end)
    again = np.flatnonzero((h[1:] == h[:-1]) & (row[1:] == row[:-1])) + 1
    found, rows = [h, np.full(len(again), AGAIN)], [row, row[again]]
    wide = data.astype(np.uint64)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    for n in GRAMS:
        m = len(data) - n + 1
        if m <= 0:
            continue
        code = np.full(m, n, np.uint64)
        for k in range(n):
            code = (code << np.uint64(8)) | wide[k : k + m]
        inside = np.flatnonzero(owner[n - 1 :] == owner[:m])
        found.append(mix(code[inside]))
        rows.append(owner[inside])
    return (np.concatenate(found) >> shift).astype(np.int64), np.concatenate(rows)


@dataclass
class Subwords:
    """What scoring needs: each bucket's vector times the output layer (the mean of products is the product of the mean), and the bias."""

    pull: np.ndarray
    bias: float

    def score(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        bucket, row = features(data, at)
        n = len(at) - 1
        total, count = np.bincount(row, self.pull[bucket], n), np.bincount(row, minlength=n)
        return 1 / (1 + np.exp(-(total / np.maximum(count, 1) + self.bias)))


def train(sample: list[tuple[int, str]], epochs: int = 8, rate: float = 2.0, seed: int = 9) -> Subwords:
    """Plain stochastic gradient descent, one document a step, the rate falling to zero. Without both labels every score is the share of ones."""
    rng = np.random.default_rng(seed)
    y = np.array([v for v, _ in sample], np.int64)
    vectors = rng.uniform(-1 / DEPTH, 1 / DEPTH, (1 << BUCKETS_LOG2, DEPTH)).astype(np.float32)
    out, bias = np.zeros((DEPTH, 2), np.float32), np.zeros(2, np.float32)
    if len(set(y.tolist())) < 2:
        return Subwords(np.zeros(1 << BUCKETS_LOG2), 0.0 if not len(y) else (4.0 if y[0] else -4.0))
    docs = []
    for _, text in sample:
        raw = np.frombuffer(text.encode(), np.uint8)
        bucket, _ = features(raw, np.array([0, len(raw)]))
        kinds, times = np.unique(bucket, return_counts=True)
        docs.append((kinds, (times / max(1, len(bucket))).astype(np.float32)))
    share = y.mean()
    bias[:] = np.log([1 - share, share])
    steps, done = epochs * len(docs), 0
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            kinds, weight = docs[i]
            if not len(kinds):
                continue
            lr = rate * (1 - done / steps)
            done += 1
            have = vectors[kinds]
            hidden = weight @ have
            s = hidden @ out + bias
            s = np.exp(s - s.max())
            s /= s.sum()
            s[y[i]] -= 1
            back = out @ s
            out -= lr * np.outer(hidden, s)
            bias -= 0.02 * lr * s
            vectors[kinds] = have - (lr * len(kinds) ** 0.5) * weight[:, None] * back
    gap = out[:, 1] - out[:, 0]
    return Subwords((vectors @ gap).astype(np.float64), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, per_label: int = 2500, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 4, held: int = 2) -> Subwords:
    """A model learned from labelled rows outside fold `held`: about `per_label` documents of each label, four windows of 750 code
    points each, the one bounded sample of this operator. Rows whose label is null, and labels of unknown documents, teach nothing."""
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    marks = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    marks = marks.where("label in (0, 1)").where(fold_of(F.col("doc_id"), folds) != held).groupBy("doc_id").agg(F.max("label").alias("label"))
    # the sample is drawn from the labels, so that no text is shuffled; about 2 x per_label ids are broadcast
    got = labelled_windows(base.join(F.broadcast(drawn(marks, per_label)), "doc_id"), per_label, 750, 4)
    return train([(r["label"], r["text"]) for r in got])


def score(docs: DataFrame, model: Subwords, text_col: str = "text", out: str = "score") -> DataFrame:
    """All columns of docs plus the probability of label 1, from the features of the whole text.

    Null and empty texts, and those of white space alone, get the model's prior. Rows stay as they are; a column named like the output is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: one number per bucket
    base = docs.drop(out)

    def run(batches):
        m = shared.value
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            got = np.zeros(len(column))
            for lo, hi, data, at in blocks(column, 1 << 20):
                got[lo:hi] = m.score(data, at)
            yield attach(batch, {out: pa.array(got)})

    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField(out, T.DoubleType())]))
