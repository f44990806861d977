"""Quality classifier: a convolutional network over bytes, in numpy.

A text's UTF-8 bytes are covered by chunks of ``CHUNK`` windows; neighbouring
chunks overlap by the filter width less one, so every window of the text is in
exactly one chunk. ``FILTERS`` learned filters of ``WIDTH`` bytes slide over each
chunk and are max-pooled. The document is described by each filter's largest and
mean pooled value over its chunks; a logistic layer combines them into one
probability.

A filter over one-hot bytes is a table of 256 numbers per offset. Training uses
these tables; scoring folds two neighbouring offsets into a table over byte
pairs. Max-pooling passes gradients to one window per chunk and filter only.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathework.llm.common import documents, hash_sample, map_texts
from lathework.llm.langid import held_out

WIDTH, FILTERS, CHUNK = 8, 16, 256
#: Labelled rows that the network is fitted on at most.
MAX_TRAIN, EPOCHS, BATCH = 2_500, 16, 32
#: Windows that are convolved at once.
BLOCK = 1 << 17


def blocks(texts: list):
    """Pieces of ``BLOCK`` windows or fewer: padded bytes, chunk starts, each chunk's text, windows to ignore marked -1."""
    data: list[bytes] = []
    starts: list[int] = []
    owner: list[int] = []
    size = 0
    pad = bytes(WIDTH - 1)
    for k, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "replace") or b"\0"
        for at in range(0, len(raw), BLOCK):
            piece = raw[at : at + BLOCK + WIDTH - 1]
            n = min(BLOCK, len(raw) - at)
            if size and size + n > BLOCK:
                yield np.frombuffer(b"".join(data) + pad, np.uint8), np.array(starts), np.array(owner)
                data, starts, owner, size = [], [], [], 0
            for c in range(0, n, CHUNK):
                starts.append(size + c)
                owner.append(k)
            starts.append(size + n)  # the pad's windows reach into the next text
            owner.append(-1)
            piece += bytes(n + WIDTH - 1 - len(piece))
            data.append(piece)
            size += len(piece)
    if data:
        yield np.frombuffer(b"".join(data) + pad, np.uint8), np.array(starts), np.array(owner)


class Network:
    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        self.table = r.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = r.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.shift = np.zeros(1, np.float32)

    def pairs(self) -> list[np.ndarray]:
        return [(self.table[k][:, None, :] + self.table[k + 1][None, :, :]).reshape(65536, FILTERS) for k in range(0, WIDTH, 2)]

    @staticmethod
    def convolve(data: np.ndarray, pairs: list[np.ndarray]) -> np.ndarray:
        n = len(data) - WIDTH + 1
        pair = data[:-1].astype(np.int32) * 256 + data[1:]
        total = pairs[0][pair[:n]]
        for k in range(1, len(pairs)):
            total += pairs[k][pair[2 * k : 2 * k + n]]
        return total

    def pooled(self, texts: list, pairs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Each text's largest and mean pooled values."""
        top = np.zeros((len(texts), FILTERS), np.float32)
        total = np.zeros((len(texts), FILTERS))
        count = np.zeros(len(texts))
        for data, starts, owner in blocks(texts):
            chunk = np.maximum.reduceat(self.convolve(data, pairs), starts, axis=0)[owner >= 0]
            chunk = np.maximum(chunk + self.bias, 0)
            own = owner[owner >= 0]
            np.maximum.at(top, own, chunk)
            np.add.at(total, own, chunk)
            np.add.at(count, own, 1)
        return top, (total / np.maximum(count, 1)[:, None]).astype(np.float32)

    def score(self, texts: list, pairs: list[np.ndarray]) -> np.ndarray:
        top, mean = self.pooled(texts, pairs)
        return 1 / (1 + np.exp(-np.clip(np.hstack([top, mean]) @ self.out + self.shift[0], -30, 30).astype(np.float64)))

    def gradient(self, texts: list, labels: np.ndarray, weights: np.ndarray, pairs: list[np.ndarray]) -> list[np.ndarray]:
        n = len(texts)
        found = []
        top = np.zeros((n, FILTERS), np.float32)
        total = np.zeros((n, FILTERS))
        count = np.zeros(n)
        for data, starts, owner in blocks(texts):
            conv = self.convolve(data, pairs)
            ends = np.append(starts[1:], len(conv))
            use = np.nonzero(owner >= 0)[0]
            at = np.array([starts[k] + conv[starts[k] : ends[k]].argmax(axis=0) for k in use])
            chunk = np.maximum(np.take_along_axis(conv, at, axis=0) + self.bias, 0)
            own = owner[use]
            np.maximum.at(top, own, chunk)
            np.add.at(total, own, chunk)
            np.add.at(count, own, 1)
            found.append((data, at, chunk, own))
        mean = total / np.maximum(count, 1)[:, None]
        features = np.hstack([top, mean])
        p = 1 / (1 + np.exp(-np.clip(features @ self.out + self.shift[0], -30, 30)))
        delta = weights * (p - labels) / n
        g_table, g_bias = np.zeros((WIDTH, 256 * FILTERS)), np.zeros(FILTERS)
        lane = np.arange(FILTERS)
        for data, at, chunk, own in found:
            g = delta[own][:, None] * (self.out[None, FILTERS:] / count[own][:, None] + self.out[None, :FILTERS] * (chunk == top[own])) * (chunk > 0)
            g_bias += g.sum(axis=0)
            for k in range(WIDTH):
                g_table[k] += np.bincount((data[at + k].astype(np.int64) * FILTERS + lane).ravel(), weights=g.ravel(), minlength=256 * FILTERS)
        return [g_table.reshape(WIDTH, 256, FILTERS), g_bias, features.T @ delta, np.array([delta.sum()])]

    def fit(self, texts: list, labels: list[int], epochs: int = EPOCHS, rate: float = 0.02, decay: float = 1e-4, seed: int = 5) -> Network:
        """Adam on mini-batches; both classes count the same in the loss, by weights on the labels' shares."""
        order, y = np.random.default_rng(seed), np.array(labels, float)
        params = [self.table, self.bias, self.out, self.shift]
        m, v, step = [np.zeros(p.shape) for p in params], [np.zeros(p.shape) for p in params], 0
        weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
        steps = max(1, epochs * -(-len(texts) // BATCH))
        for _ in range(epochs):
            shuffled = order.permutation(len(texts))
            for a in range(0, len(texts), BATCH):
                pick = shuffled[a : a + BATCH]
                step += 1
                grads = self.gradient([texts[k] for k in pick], y[pick], weight[pick], self.pairs())
                pace = rate * (1 - 0.9 * step / steps)
                for q, (p, g) in enumerate(zip(params, grads, strict=True)):
                    g = g + decay * p
                    m[q] += 0.1 * (g - m[q])
                    v[q] += 0.001 * (g * g - v[q])
                    p -= (pace * (m[q] / (1 - 0.9**step)) / (np.sqrt(v[q] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def train(rows: DataFrame, text: str = "text", label: str = "label", max_train: int = MAX_TRAIN, epochs: int = EPOCHS) -> Network:
    """The network from ``rows (text, label)``; labels are 0 and 1, others and nulls are left out.

    It is fitted on the ``max_train`` rows with the smallest hashes. Without
    both labels among them it gives every text the share of label 1 (0.5
    without rows).
    """
    usable = rows.where(F.col(label).isin(0, 1)).select(F.coalesce(text, F.lit("")).alias("t"), label)
    sample = hash_sample(usable, max_train, usable.count(), "t", label).toArrow()
    texts, labels = sample.column(0).to_pylist(), sample.column(1).to_pylist()
    network = Network()
    if len(set(labels)) < 2:
        share = np.clip(np.mean(labels) if labels else 0.5, 0.01, 0.99)
        network.out[:] = 0
        network.shift[:] = np.log(share / (1 - share))
        return network
    return network.fit(texts, labels, epochs)


def score(docs: DataFrame, network: Network, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """The kept columns and ``score``. Null texts count as empty. One pass, without a shuffle."""

    def make() -> Callable:
        pairs = network.pairs()
        return lambda texts: [network.score(texts, pairs)]

    return map_texts(docs, keep or ["doc_id"], text_col, make, [("score", "double")])


def op7_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    # the sample is chosen among ids first, so that only its texts are moved
    usable = labels.where(~held_out() & F.col("label").isin(0, 1))
    chosen = hash_sample(usable, MAX_TRAIN, usable.count(), "doc_id", "label")
    network = train(docs.join(F.broadcast(chosen), "doc_id"))
    return score(docs, network).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
