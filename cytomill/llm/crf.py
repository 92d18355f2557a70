"""Document quality from a linear-chain conditional random field over lines.

Every line that holds a word is good or bad. A line's features are byte-class shares and shapes of
its own and of its neighbouring lines; the chain has start and transition weights. The field is
fitted by gradient ascent of the conditional likelihood (numpy, on the driver) on a bounded sample
of labelled documents, each of whose lines takes its document's label. Executors run
forward-backward over the lines of every whole text; the marginals of good, weighted by the lines'
lengths, average to a document value, which a two-parameter logistic curve fitted on the same sample
turns into the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import store
from .words import bounds, buffer_of, hashes, mix, pieces

#: SAMPLE_DOCS bounds the labelled rows, with their whole texts, that the driver fits on.
SAMPLE_DOCS, EPOCHS, RATE, L2 = 3000, 12, 0.02, 1e-4
#: Byte classes: white space, lower case, upper case, digit, sentence punctuation, exclamation mark, other ASCII, above ASCII.
CLASSES = np.full(256, 7, np.uint8)
CLASSES[:128] = 6
for _c, _bytes in ((0, b" \t\n\v\f\r"), (1, bytes(range(97, 123))), (2, bytes(range(65, 91))), (3, b"0123456789"), (4, b".,;:?'\"-()"), (5, b"!")):
    CLASSES[list(_bytes)] = _c
OWN = 15
FEATURES = 3 * OWN + 3


def lines(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, texts and weights (bytes outside white space) of all lines that hold a word."""
    full = offs[:-1] < offs[1:]
    starts = np.unique(np.concatenate([offs[:-1][full], np.flatnonzero(data == 10) + 1]))
    starts = starts[starts < len(data)]
    ends = np.append(starts[1:], len(data))
    word_at, word_end, _ = bounds(data, offs)
    n_words = np.searchsorted(word_at, ends) - np.searchsorted(word_at, starts)
    if not len(starts):
        return np.zeros((0, FEATURES), np.float32), np.zeros(0, np.int64), np.zeros(0)
    count = np.bincount(np.repeat(np.arange(len(starts)) * 8, ends - starts) + CLASSES[data], minlength=8 * len(starts)).reshape(-1, 8)
    word = hashes(data, word_at, word_end)
    echo = np.zeros(len(word) + 1, np.int64)
    np.cumsum(word[1:] == word[:-1], out=echo[2:])
    keep = n_words > 0
    if not keep.any():
        return np.zeros((0, FEATURES), np.float32), np.zeros(0, np.int64), np.zeros(0)
    starts, ends, n_words, count = starts[keep], ends[keep], n_words[keep], count[keep]
    row = np.searchsorted(offs, starts, side="right") - 1
    first = word_at[np.searchsorted(word_at, starts)]
    last = word_end[np.searchsorted(word_at, ends) - 1]
    chars = count[:, 1:].sum(1)
    share = count[:, 1:] / chars[:, None]
    again = np.zeros(len(starts))
    seen = mix(hashes(data, first, last) ^ mix(row.astype(np.uint64)))
    _, at = np.unique(seen, return_index=True)
    again[:] = 1
    again[at] = 0
    f = np.zeros((len(starts), OWN), np.float32)
    f[:, 0] = np.log1p(n_words) / 5
    f[:, 1] = np.minimum(chars / n_words, 30) / 10
    f[:, 2:8] = np.sqrt(share[:, 1:])
    f[:, 8] = share[:, 5] > 0.02
    f[:, 9] = share[:, 4] > 0.02
    f[:, 10] = CLASSES[data[last - 1]] == 4
    f[:, 11] = CLASSES[data[first]] == 2
    f[:, 12] = again
    f[:, 13] = share[:, 1] > 0.5
    i = np.searchsorted(word_at, starts)
    f[:, 14] = (echo[i + n_words] - echo[np.minimum(i + 1, len(word))]) / n_words  # words equal to the one before
    x = np.zeros((len(f), FEATURES), np.float32)
    x[:, :OWN] = f
    same = row[1:] == row[:-1]
    x[1:, OWN : 2 * OWN][same] = f[:-1][same]
    x[:-1, 2 * OWN : 3 * OWN][same] = f[1:][same]
    x[0, -3] = x[-1, -2] = 1
    x[1:, -3] = ~same
    x[:-1, -2] = ~same
    x[:, -1] = 1
    return x, row, chars.astype(float)


@dataclass
class LineCRF:
    """``w``: weights of good against bad; ``trans``: 2 x 2 log potentials; ``curve``: score = sigmoid(a + b * logit)."""

    w: np.ndarray
    trans: np.ndarray
    curve: tuple[float, float] = (0.0, 1.0)

    def marginals(self, unary: np.ndarray, first: np.ndarray, n: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """P(good) of each line by forward-backward; chain i has the ``n[i]`` lines from ``first[i]``
        on (n > 0). All chains advance together, the longest first. With ``pairs``, also the summed
        pair marginals."""
        order = np.argsort(-n, kind="stable")
        first, n = first[order], n[order]
        e = np.exp(self.trans)
        u = np.clip(unary, -30, 30)
        emit = np.stack([1 / (1 + np.exp(u)), 1 / (1 + np.exp(-u))], 1)
        alpha, beta = np.empty_like(emit), np.empty_like(emit)
        active = [int(np.searchsorted(-n, -t)) for t in range(int(n[0]) if len(n) else 0)]
        for t, k in enumerate(active):
            i = first[:k] + t
            a = emit[i] * (alpha[i - 1] @ e) if t else emit[i]
            alpha[i] = a / a.sum(1, keepdims=True)
        end = first + n - 1
        beta[end] = 0.5
        for t in range(len(active) - 2, -1, -1):
            i = first[: active[t + 1]] + t
            b = (emit[i + 1] * beta[i + 1]) @ e.T
            beta[i] = b / b.sum(1, keepdims=True)
        p = alpha * beta
        p /= p.sum(1, keepdims=True)
        if not pairs:
            return p[:, 1], None
        inner = np.ones(len(emit), bool)
        inner[end] = False
        i = np.flatnonzero(inner)
        xi = alpha[i][:, :, None] * e[None] * (emit[i + 1] * beta[i + 1])[:, None, :]
        return p[:, 1], (xi / xi.sum((1, 2), keepdims=True)).sum(0)

    def documents(self, x: np.ndarray, row: np.ndarray, weight: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Length-weighted mean marginal of each text, and which texts have lines."""
        n = np.bincount(row, minlength=rows)
        has = n > 0
        first = (np.cumsum(n) - n)[has]
        p, _ = self.marginals(x @ self.w, first, n[has])
        total = np.bincount(row, weight, minlength=rows)
        return np.where(has, np.bincount(row, weight * p, minlength=rows) / np.maximum(total, 1e-9), 0.0), has

    def score(self, mean: np.ndarray, has: np.ndarray) -> np.ndarray:
        m = np.clip(mean, 1e-6, 1 - 1e-6)
        a, b = self.curve
        return np.where(has, 1 / (1 + np.exp(-(a + b * np.log(m / (1 - m))))), 0.0)


def fit(texts: list[str], good: np.ndarray, seed: int = 5) -> LineCRF:
    x, row, weight = lines(*buffer_of(pa.array(texts, pa.large_string())))
    n = np.bincount(row, minlength=len(texts))
    first = np.cumsum(n) - n
    crf = LineCRF(np.zeros(FEATURES), np.zeros((2, 2)))
    m, v, step = np.zeros(FEATURES + 4), np.zeros(FEATURES + 4), 0
    rng = np.random.default_rng(seed)
    docs = np.flatnonzero(n)
    for epoch in range(EPOCHS):
        order = rng.permutation(docs)
        for i in range(0, len(order), 64):
            d = order[i : i + 64]
            at = np.concatenate([np.arange(first[k], first[k] + n[k]) for k in d])
            starts = np.cumsum(n[d]) - n[d]
            p, xi = crf.marginals(x[at] @ crf.w, starts, n[d], pairs=True)
            y = np.repeat(good[d], n[d]).astype(float)
            seen = np.zeros((2, 2))
            seen[0, 0], seen[1, 1] = (n[d] - 1)[good[d] == 0].sum(), (n[d] - 1)[good[d] == 1].sum()
            size = len(at)
            g = np.concatenate([(y - p) @ x[at] / size, ((seen - xi) / size).ravel()]) - L2 * np.concatenate([crf.w, 10 * crf.trans.ravel()])
            step += 1
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            move = RATE * (0.3 if epoch >= EPOCHS * 2 // 3 else 1) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            crf.w = crf.w + move[:FEATURES]
            crf.trans = np.clip(crf.trans + move[FEATURES:].reshape(2, 2), -2.5, 2.5)
    mean, has = crf.documents(x, row, weight, len(texts))
    z = np.log(np.clip(mean, 1e-6, 1 - 1e-6) / (1 - np.clip(mean, 1e-6, 1 - 1e-6)))[has]
    t, a, b = good[has].astype(float), 0.0, 1.0
    for _ in range(50):  # Newton steps of the logistic curve, slightly regularised
        p = 1 / (1 + np.exp(-(a + b * z)))
        r, s = t - p, p * (1 - p) + 1e-6
        h = np.array([[s.sum() + 1e-3, (s * z).sum()], [(s * z).sum(), (s * z * z).sum() + 1e-3]])
        d = np.linalg.solve(h, [r.sum() - 1e-3 * a, (r * z).sum() - 1e-3 * (b - 1)])
        a, b = a + float(np.clip(d[0], -1, 1)), b + float(np.clip(d[1], -1, 1))
    crf.curve = (a, max(b, 0.01))
    return crf


def sampled(docs: DataFrame, labels: DataFrame, usable: Column, text: str = "text", key: str = "doc_id", label: str = "quality", sample: int = SAMPLE_DOCS) -> list[tuple[int, int, str]]:
    """Hash of the id, label and whole text of at most ``sample`` labelled documents with ``usable``, first by a hash of
    their ids. Only their ids are broadcast, whose number ``sample`` bounds. Null ids, labels and texts are left out;
    of an id's labels the smallest counts, and of its texts the one that is first by a hash."""
    rows = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).where(usable).groupBy(key).agg(F.min(label).alias("_y"))
    chosen = store.bounded_sample(rows.withColumn("_h", F.xxhash64(F.lit(17), key)), "_h", sample).drop("_h")
    picked = docs.where(F.col(text).isNotNull()).select(key, F.xxhash64(text).alias("_h"), F.col(text).alias("_t")).join(F.broadcast(chosen), key)
    one = picked.groupBy(key).agg(F.min("_y").alias("_y"), F.min(F.struct("_h", "_t")).alias("_t"))
    return sorted((r["_h"], r["_y"], r["_t"]) for r in one.select(F.xxhash64(F.lit(17), key).alias("_h"), "_y", F.col("_t")["_t"].alias("_t")).collect())


def train(docs: DataFrame, labels: DataFrame, usable: Column, text: str = "text", key: str = "doc_id", label: str = "quality", sample: int = SAMPLE_DOCS) -> LineCRF | None:
    """Fit on the documents of ``sampled``; None if there are none."""
    got = sampled(docs, labels, usable, text, key, label, sample)
    return fit([t for _, _, t in got], np.array([y for _, y, _ in got])) if got else None


def score(docs: DataFrame, crf: LineCRF | None, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (double, 0 to 1). Texts that are null, empty or white space have no line
    and score 0; without a model every text scores 0.5. A column ``score`` of ``docs`` is replaced."""
    store.bound_batches(docs.sparkSession)
    docs = docs.drop("score")
    if crf is None:
        return docs.withColumn("score", F.lit(0.5))
    model, at = docs.sparkSession.sparkContext.broadcast(crf), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = model.value
        for batch in pieces(batches, text):
            x, row, weight = lines(*buffer_of(batch.column(at)))
            s = crf.score(*crf.documents(x, row, weight, batch.num_rows))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s)], names=[*batch.schema.names, "score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("score", DoubleType())]))
