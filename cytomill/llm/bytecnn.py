"""Language identification by a byte convolutional network.

The network: one-hot bytes of a fixed-length window, filters of several widths, a rectifier, max
pooling over the window, softmax. It is trained with plain numpy (Adam on the cross entropy) on a
bounded sample of labelled rows on the driver, and applied to every window of every whole text on
the executors. Filters over one-hot bytes are sums of table rows, so a forward pass is a few
gathers and adds per byte. A document's probabilities are the means of its windows' log
probabilities, weighted by the windows' lengths and normalised again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from . import store
from .words import buffer_of, pieces

#: Fixed parameters of the network. SAMPLE_DOCS bounds the labelled rows, with their whole texts, that the driver fits on, and
#: LANGUAGES the languages that the network can name.
WINDOW, WIDTHS, FILTERS, SAMPLE_DOCS, LANGUAGES = 256, (2, 3, 4), 12, 2000, 256
UNDETERMINED = "und"


@dataclass
class ByteCNN:
    """``tables[w]`` is (w, 256, FILTERS); ``bias`` and ``out`` belong to all widths together."""

    languages: list[str]
    tables: list[np.ndarray] = field(default_factory=list)
    bias: np.ndarray | None = None
    out: np.ndarray | None = None
    out_bias: np.ndarray | None = None

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Max over the positions of each window (rows of ``x``), and where each maximum stood."""
        best, where = [], []
        for t in self.tables:
            w = len(t)
            n = x.shape[1] - w + 1
            a = t[0][x[:, :n]]
            for j in range(1, w):
                a += t[j][x[:, j : j + n]]
            at = a.argmax(1)
            where.append(at)
            best.append(np.take_along_axis(a, at[:, None], 1)[:, 0])
        return np.concatenate(best, 1), where

    def features(self, x: np.ndarray) -> np.ndarray:
        """Max-pooled filters without positions, a few hundred windows at a time."""
        out = np.empty((len(x), FILTERS * len(self.tables)), np.float32)
        for i in range(0, len(x), 64):
            part = x[i : i + 64]
            for k, t in enumerate(self.tables):
                n = part.shape[1] - len(t) + 1
                a = t[0].take(part[:, :n], axis=0)
                for j in range(1, len(t)):
                    a += t[j].take(part[:, j : j + n], axis=0)
                out[i : i + 64, k * FILTERS : (k + 1) * FILTERS] = a.max(1)
        return out

    def log_probs(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(self.features(x) + self.bias, 0) @ self.out + self.out_bias
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 128, rate: float = 0.01, seed: int = 7) -> ByteCNN:
        rng = np.random.default_rng(seed)
        k = len(self.languages)
        self.tables = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias, self.out_bias = np.zeros(FILTERS * len(WIDTHS), np.float32), np.zeros(k, np.float32)
        self.out = rng.normal(0, 0.2, (FILTERS * len(WIDTHS), k)).astype(np.float32)
        params = [*self.tables, self.bias, self.out, self.out_bias]
        m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                rows = order[i : i + batch]
                xb, n = x[rows], len(rows)
                raw, where = self.pooled(xb)
                hidden = np.maximum(raw + self.bias, 0)
                z = hidden @ self.out + self.out_bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(n), y[rows]] -= 1
                p /= n
                back = (p @ self.out.T) * (hidden > 0)
                grads = []
                for j, t in enumerate(self.tables):
                    g, d = np.zeros_like(t), back[:, j * FILTERS : (j + 1) * FILTERS]
                    for o in range(len(t)):
                        np.add.at(g[o], (np.take_along_axis(xb, where[j] + o, 1), np.arange(FILTERS)[None, :]), d)
                    grads.append(g)
                grads += [back.sum(0), hidden.T @ p, p.sum(0)]
                step += 1
                for q, g, a, b in zip(params, grads, m, v, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    q -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
        return self


def layout(offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, texts and lengths of all windows; they do not overlap, a text's last one may be short."""
    n = np.diff(offs)
    count = -(-n // WINDOW)
    row = np.repeat(np.arange(len(n)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = offs[:-1][row] + nth * WINDOW
    return start, row, np.minimum(offs[1:][row] - start, WINDOW)


def gather(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The windows' bytes, padded with zero bytes."""
    steps = np.arange(WINDOW)
    x = data.take(np.minimum(start[:, None] + steps, len(data) - 1))
    x[steps >= length[:, None]] = 0
    return x


def quota(counts: list[int], sample: int) -> int:
    """The most texts of each language, of ``counts`` distinct ones, that leaves at most ``sample`` in all; at least one."""
    low, high = 1, max(sample, 1)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if sum(min(n, mid) for n in counts) <= sample else (low, mid - 1)
    return low


def sampled(labelled: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE_DOCS, languages: int = LANGUAGES) -> list[tuple[int, str, str]]:
    """Hash, language and whole text of at most ``sample`` distinct texts with a letter (one of each language at least), for
    which text and language are not null. Every language gives as many as any other as far as it has them, those that are
    first by a hash of the text, so that no order or source is preferred. Of more than ``languages`` languages those with most
    distinct texts are learned (ties: those that sort first), so dirty labels widen neither the sample nor the network."""
    known = labelled.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(text, lang).alias("h"))
    distinct = store.cut(known.select("lang", "h").distinct(), "labelled")
    counts = distinct.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages)
    found = counts.collect()
    if not found:
        return []
    most = quota([r["count"] for r in found], max(sample, len(found)))
    counts = labelled.sparkSession.createDataFrame(found, counts.schema)
    # far more than the quota stays below the threshold, far less than a large language goes to the window's one task
    near = F.pmod("h", F.lit(1 << 30)) * F.col("count") < F.lit((most + 6 * most**0.5 + 10) * (1 << 30))
    distinct = distinct.join(F.broadcast(counts), "lang").where(near)
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h"))
    chosen = distinct.withColumn("_n", nth).where(F.col("_n") <= most).select("h", "lang")
    picked = known.join(F.broadcast(chosen), ["h", "lang"]).select("h", "lang", "text")
    return sorted((r["h"], r["lang"], r["text"]) for r in picked.dropDuplicates(["h", "lang"]).collect())


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE_DOCS) -> ByteCNN | None:
    """Fit on all windows of the texts of ``sampled``; copies count once. None if there is nothing to learn from."""
    rows = sampled(labelled, text, lang, sample)
    if not rows:
        return None
    net = ByteCNN(sorted({r[1] for r in rows}))
    data, offs = buffer_of(pa.array([t for _, _, t in rows], pa.large_string()))
    start, row, length = layout(offs)
    x = gather(data, start, length)
    y = np.array([net.languages.index(name) for _, name, _ in rows])[row]
    keep = (length >= WINDOW // 2) | (np.bincount(row, minlength=len(rows))[row] == 1)
    return net.fit(x[keep], y[keep])


def identify(docs: DataFrame, net: ByteCNN | None, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` (string) and ``score`` (double, the probability of that language).

    Every byte of every text is in a window. A null text and one without a letter get ``und`` and
    score 0, as does every text when nothing was learned. Ties go to the language that sorts first.
    Columns of ``docs`` named ``lang_pred`` or ``score`` are replaced. An empty table stays empty.
    """
    store.bound_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    if net is None:
        return docs.withColumns({"lang_pred": F.lit(UNDETERMINED), "score": F.lit(0.0)})
    model = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        for batch in pieces(batches, text, 1 << 20):
            data, offs = buffer_of(batch.column(at))
            n = batch.num_rows
            total = np.zeros((n, len(net.languages)))
            start, row, length = layout(offs)
            for i in range(0, len(row), 1024):  # a very long text is worked through in parts
                k = slice(i, i + 1024)
                np.add.at(total, row[k], net.log_probs(gather(data, start[k], length[k])) * length[k, None])
            total /= np.maximum(np.diff(offs), 1)[:, None]
            p = np.exp(total - total.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            best = p.argmax(1)
            names = pa.array(net.languages).take(pa.array(best))
            yield pa.RecordBatch.from_arrays([*batch.columns, names, pa.array(p[np.arange(n), best])], names=[*batch.schema.names, "lang_pred", "score"])

    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    return docs.mapInArrow(run, schema).withColumns({"lang_pred": F.when(letter, F.col("lang_pred")).otherwise(UNDETERMINED), "score": F.when(letter, F.col("score")).otherwise(0.0)})
