"""Language ID by a byte convolutional network: filters of several widths, max pooling and softmax, trained in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.llm.blocks import blocks
from tidemark.llm.frames import fold_of, labelled_windows

WIDTHS = (2, 3, 4)
FILTERS = 12
DEPTH = 8
#: Bytes of a window; successive windows share the bytes that the widest filter needs.
WINDOW = 260
STRIDE = WINDOW - max(WIDTHS) + 1
UNKNOWN = "und"


@dataclass
class ByteNet:
    """Weights: byte vectors (256, DEPTH), filters (widest * DEPTH, all filters; narrow filters end in zeros), output layer."""

    labels: list[str]
    bytes_: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def logits(self, windows: np.ndarray) -> np.ndarray:
        """windows: (n, WINDOW) bytes, zero padded. Every fourth place at once, so that no window is copied."""
        n, wide = len(windows), max(WIDTHS)
        per = WINDOW // wide
        flat = np.take(self.bytes_, windows.reshape(-1), axis=0, mode="clip")
        flat = np.concatenate([flat, np.zeros((wide, DEPTH), np.float32)])
        top = None
        for shift in range(wide):
            rows = flat[shift : shift + n * WINDOW].reshape(n * per, wide * DEPTH)
            hit = (rows @ self.filters).reshape(n, per, -1)
            hit = (hit if shift == 0 else hit[:, :-1]).max(axis=1)
            top = hit if top is None else np.maximum(top, hit)
        return np.maximum(top + self.bias, 0) @ self.out + self.out_bias


def to_windows(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Zero-padded windows that cover every byte of every text, the row of each window and the bytes in it."""
    size = np.diff(at)
    count = np.maximum(1, -(-np.maximum(size - WINDOW, 0) // STRIDE) + 1)
    row = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = at[:-1][row] + nth * STRIDE
    have = np.minimum(WINDOW, at[1:][row] - start)
    place = start[:, None] + np.arange(WINDOW)
    full = np.concatenate([data, np.zeros(1, np.uint8)])
    out = full[np.minimum(place, len(data))]
    out[np.arange(WINDOW) >= have[:, None]] = 0
    return out, row, have


def train(sample: list[tuple[str, str]], epochs: int = 6, rate: float = 0.004, seed: int = 5) -> ByteNet:
    """Adam on windows of the sample; some windows are shortened, as many texts are short. No labels: a net that knows nothing."""
    rng = np.random.default_rng(seed)
    labels = sorted({y for y, _ in sample})
    wide, total = max(WIDTHS), FILTERS * len(WIDTHS)
    keep = np.zeros((wide * DEPTH, total), np.float32)
    for k, w in enumerate(WIDTHS):
        keep[: w * DEPTH, k * FILTERS : (k + 1) * FILTERS] = 1
    p = [
        rng.normal(0, 0.5, (256, DEPTH)), rng.normal(0, 0.25, (wide * DEPTH, total)) * keep, np.zeros(total),
        rng.normal(0, 0.2, (total, max(1, len(labels)))), np.zeros(max(1, len(labels))),
    ]
    p = [x.astype(np.float32) for x in p]
    net = ByteNet(labels or [UNKNOWN], *p)
    if len(labels) < 2:
        return net
    raw = [t.encode() for _, t in sample]
    x, row, have = to_windows(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in raw])]))
    y = np.array([labels.index(v) for v, _ in sample])[row]
    first, second = [np.zeros_like(v) for v in p], [np.zeros_like(v) for v in p]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(order), 64):
            pick = order[lo : lo + 64]
            b, n = x[pick].copy(), len(pick)
            short = np.where(rng.random(n) < 0.35, rng.integers(6, 80, n), WINDOW)
            b[np.arange(WINDOW) >= short[:, None]] = 0
            places = WINDOW - wide + 1
            e = p[0][b]
            cols = np.concatenate([e[:, k : k + places] for k in range(wide)], axis=2)
            z = cols @ p[1]
            am = z.argmax(axis=1)
            pre = np.take_along_axis(z, am[:, None, :], 1)[:, 0] + p[2]
            h = np.maximum(pre, 0)
            s = h @ p[3] + p[4]
            s = np.exp(s - s.max(axis=1, keepdims=True))
            s /= s.sum(axis=1, keepdims=True)
            s[np.arange(n), y[pick]] -= 1
            s /= n
            dh = (s @ p[3].T) * (pre > 0)
            best = cols[np.arange(n)[:, None], am]
            dcols = dh[:, :, None] * (p[1] * keep).T[None]
            de = np.zeros_like(p[0])
            for k in range(wide):
                np.add.at(de, b[np.arange(n)[:, None], am + k], dcols[:, :, k * DEPTH : (k + 1) * DEPTH])
            grads = [de, np.einsum("nf,nfd->df", dh, best) * keep, dh.sum(0), h.T @ s, s.sum(0)]
            step += 1
            for v, g, a, q in zip(p, grads, first, second):
                a += 0.1 * (g - a)
                q += 0.001 * (g * g - q)
                v -= rate * (a / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.999**step)) + 1e-8)
    return net


def fit(docs: DataFrame, per_label: int = 600, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", folds: int = 5) -> ByteNet:
    """A net learned from rows outside fold 0 with a label, from at most about `per_label` documents of each language
    (three windows of 256 code points each): the one bounded sample of this operator."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{label_col}`").cast("string").alias("label"))
    got = labelled_windows(rows.where(fold_of(F.col("doc_id"), folds) != 0), per_label, 256, 3)
    return train([(r["label"], r["text"]) for r in got])


def predict(docs: DataFrame, net: ByteNet, text_col: str = "text", label_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """All columns of docs plus the predicted language and its probability.

    Every byte of a text is in a window; a text's logits are the mean of its windows' by bytes. Null texts and texts without a letter
    are `und` with score 0. Rows stay as they are, repeated ones included; columns named like the outputs are replaced. Only the text is read."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(net)  # a few thousand numbers, whatever the input
    base = docs.drop(label_out, score_out)
    letters, held = "__letters", base.withColumn("__letters", F.coalesce(F.col(f"`{text_col}`").cast("string").rlike(r"\p{L}"), F.lit(False)))
    schema = T.StructType([*held.schema.fields, T.StructField(label_out, T.StringType()), T.StructField(score_out, T.DoubleType())])

    def run(batches):
        model = shared.value
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            known = batch.column(batch.schema.get_field_index(letters)).to_numpy(zero_copy_only=False).astype(bool)
            best, score = np.zeros(len(known), np.int64), np.zeros(len(known))
            for lo, hi, data, at in blocks(column, 1 << 19):
                x, row, have = to_windows(data, at)
                total, weight = np.zeros((hi - lo, len(model.labels))), np.zeros(hi - lo)
                for k in range(0, len(x), 256):
                    np.add.at(total, row[k : k + 256], model.logits(x[k : k + 256]) * have[k : k + 256, None])
                np.add.at(weight, row, have)
                s = total / np.maximum(weight, 1)[:, None]
                s = np.exp(s - s.max(axis=1, keepdims=True))
                s /= s.sum(axis=1, keepdims=True)
                best[lo:hi], score[lo:hi] = s.argmax(axis=1), s.max(axis=1)
            labels = pa.array([model.labels[i] if k else UNKNOWN for i, k in zip(best, known)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, labels, pa.array(np.where(known, score, 0.0))], names=[*batch.schema.names, label_out, score_out])

    return held.mapInArrow(run, schema).drop(letters)


def accept(docs: DataFrame, net: ByteNet, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents whose language is recognised with a probability of at least `least`; all columns of docs stay."""
    scored = predict(docs, net, text_col, "__lang", "__score")
    return scored.where((F.col("__lang") != UNKNOWN) & (F.col("__score") >= least)).drop("__lang", "__score")
