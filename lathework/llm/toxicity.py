"""Toxicity: a factorization machine over hashed terms.

A text is the set of its terms: words (runs of letters, marks and digits,
lower-cased) and the beginnings of longer ones, hashed to ``1 << BITS`` features. Its logit is

    b + sum_i w_i + sum_{i<j} <v_i, v_j>

so that two terms that are harmless alone, such as an insult and the mention of a
group, can count together; a sum of single weights can't say that. The pair sum of
a text is half of ``|sum v|^2 - sum |v|^2`` and costs one pass over its terms.

Training runs on a bounded sample. Single weights follow the regularised leader
with an L1 penalty, factors take AdaGrad steps with a group penalty, so that a term
that tells nothing ends with exact zeros; terms whose share of toxic texts is like
the sample's take no part at all, not even in pairs. So a text of 20,000 harmless
words has the score of a short one. The features that are left travel to the tasks; scoring is
one pass over whole texts without a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lathework.llm.common import documents, hash_sample, map_texts

BITS, FACTORS = 20, 4
#: Labelled rows that the machine is fitted on at most, passes over them, rows of a step.
MAX_TRAIN, EPOCHS, BATCH = 6_000, 12, 64
#: Standard errors by which a feature's share of toxic texts is off the sample's share at least, or it is left out: among a million features chance does that for one or two.
SCREEN = 4.8
#: Texts of the sample that a feature occurs in at least.
MIN_TEXTS = 3
#: Lengths of the beginnings of longer words that are terms beside the words, so that inflected and compound forms share one.
BEGINNINGS = (5,)
TERM = regex.compile(r"[\p{L}\p{M}\p{N}]+")


def features(text: str | None) -> list[int]:
    """Hashed terms of a text, each once, ascending. Null and empty texts have none."""
    terms = {m[0] for m in TERM.finditer((text or "").lower())}
    terms |= {f"{t[:k]}-" for t in terms for k in BEGINNINGS if len(t) > k}
    return sorted({zlib.crc32(t.encode("utf-8", "replace")) >> (32 - BITS) for t in terms})


class Machine:
    """``ids`` (ascending) are the features with a weight ``w`` or factors ``v``; all others are zero."""

    def __init__(self, ids: np.ndarray, w: np.ndarray, v: np.ndarray, bias: float):
        self.ids, self.w, self.v, self.bias = ids, w, v, float(bias)

    def logits(self, rows: list) -> np.ndarray:
        """Of rows of ascending feature ids."""
        sizes = np.array([len(r) for r in rows], np.int64)
        out = np.full(len(rows), self.bias)
        if not len(self.ids) or not sizes.sum():
            return out
        flat = np.concatenate([np.asarray(r, np.int64) for r in rows])
        owner = np.repeat(np.arange(len(rows)), sizes)
        at = np.minimum(np.searchsorted(self.ids, flat), len(self.ids) - 1)
        known = self.ids[at] == flat
        at, owner = at[known], owner[known]
        out += np.bincount(owner, self.w[at], len(rows))
        for k in range(self.v.shape[1]):
            own = self.v[at, k]
            out += 0.5 * (np.bincount(owner, own, len(rows)) ** 2 - np.bincount(owner, own * own, len(rows)))
        return out

    def score(self, rows: list) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(rows), -30, 30)))


def gradients(w: np.ndarray, v: np.ndarray, bias: float, at: np.ndarray, owner: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Of the summed log loss of a batch: features met, gradients of their weights and factors, and of the bias.

    ``at`` and ``owner`` pair features with the batch's rows.
    """
    met, inverse = np.unique(at, return_inverse=True)
    wm, vm = w[met], v[met]
    n = len(y)
    logit = bias + np.bincount(owner, wm[inverse], n)
    sums = np.stack([np.bincount(owner, vm[inverse, k], n) for k in range(v.shape[1])], axis=1)
    squares = np.bincount(owner, (vm * vm).sum(axis=1)[inverse], n)
    logit += 0.5 * ((sums * sums).sum(axis=1) - squares)
    delta = 1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y
    gw = np.bincount(inverse, delta[owner], len(met))
    gv = np.stack([np.bincount(inverse, delta[owner] * sums[owner, k], len(met)) for k in range(v.shape[1])], axis=1) - gw[:, None] * vm
    return met, gw, gv, float(delta.sum())


def separation(positive: np.ndarray, seen: np.ndarray, share: float, n: int) -> np.ndarray:
    """How many standard errors the texts with a feature have more of label 1 than all ``n`` texts, whose share of it is ``share``."""
    error = np.sqrt(share * (1 - share) * seen * np.maximum(1 - seen / n, 1e-9))
    return (positive - share * seen) / np.maximum(error, 1e-12)


def fit(rows: list, labels: list[int], factors: int = FACTORS, epochs: int = EPOCHS, seed: int = 3, min_texts: int = MIN_TEXTS, rate: float = 0.3, l1: float = 2.0, group: float = 0.03, spread: float = 0.1, screen: float = SCREEN) -> Machine:
    """The machine of rows of ascending feature ids and labels 0 and 1.

    Without both labels it gives every text the share of label 1 (0.5 without rows).
    """
    y = np.array(labels, float)
    if len(set(labels)) < 2:
        share = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
        return Machine(np.zeros(0, np.int64), np.zeros(0), np.zeros((0, factors)), np.log(share / (1 - share)))
    sizes = np.array([len(r) for r in rows])
    flat = np.concatenate([np.asarray(r, np.int64) for r in rows])
    ids, inverse, seen = np.unique(flat, return_inverse=True, return_counts=True)
    label = np.repeat(y, sizes)
    often = (seen >= min_texts) & (np.abs(separation(np.bincount(inverse, label), seen, y.mean(), len(y))) >= screen)
    own = np.where(often, np.cumsum(often) - 1, -1)[inverse]
    ids = ids[often]
    edges = np.concatenate([[0], np.cumsum(sizes)])
    data = [own[a:b][own[a:b] >= 0] for a, b in zip(edges[:-1], edges[1:], strict=True)]

    order = np.random.default_rng(seed)
    n = len(ids)
    w, z, q = np.zeros(n), np.zeros(n), np.zeros(n)  # weights, and the leader's sums of gradients and squares
    v, s = order.normal(0, spread, (n, factors)), np.full(n, 1.0)
    bias, qb = float(np.log(y.mean() / (1 - y.mean()))), 1.0
    for _ in range(epochs):
        shuffled = order.permutation(len(data))
        for a in range(0, len(data), BATCH):
            pick = shuffled[a : a + BATCH]
            at = np.concatenate([data[k] for k in pick])
            owner = np.repeat(np.arange(len(pick)), [len(data[k]) for k in pick])
            met, gw, gv, gb = gradients(w, v, bias, at, owner, y[pick])
            qb += gb * gb
            bias -= rate * gb / np.sqrt(qb)
            q_new = q[met] + gw * gw
            z[met] += gw - (np.sqrt(q_new) - np.sqrt(q[met])) / rate * w[met]
            q[met] = q_new
            w[met] = np.where(np.abs(z[met]) <= l1, 0.0, -(z[met] - np.sign(z[met]) * l1) / ((1.0 + np.sqrt(q_new)) / rate))
            s[met] += (gv * gv).sum(axis=1)
            pace = (rate / np.sqrt(s[met]))[:, None]
            moved = v[met] - pace * gv
            length = np.sqrt((moved * moved).sum(axis=1, keepdims=True))
            v[met] = moved * np.maximum(0, 1 - pace * group / np.maximum(length, 1e-12))
    left = (w != 0) | (v != 0).any(axis=1)
    return Machine(ids[left], w[left], v[left], bias)


def train(rows: DataFrame, text: str = "text", label: str = "label", max_train: int = MAX_TRAIN) -> Machine:
    """The machine of ``rows (text, label)``; labels are 0 and 1, others and nulls are left out.

    Fitted on the ``max_train`` rows with the smallest hashes of text and label. Terms are
    cut and hashed where the rows are; the driver gets feature ids only.
    """
    usable = rows.where(F.col(label).isin(0, 1)).select(F.coalesce(text, F.lit("")).alias("t"), F.col(label).alias("y"))
    sample = hash_sample(usable, max_train, usable.count(), "t", "y")
    found = map_texts(sample, ["y"], "t", lambda: lambda texts: [[features(t) for t in texts]], [("ids", "array<int>")]).toArrow()
    ids = found.column(1).combine_chunks()
    edge, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
    return fit([flat[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)], found.column(0).to_pylist())


def score(docs: DataFrame, machine: Machine, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """The kept columns and ``score``: the probability of toxicity of each whole text, by one pass without a shuffle.

    Null texts count as empty and have the score of a text without terms. Rows
    repeat as in ``docs``; a column called ``score`` gives way to the result.
    """
    kept = [c for c in keep or ["doc_id"] if c != "score"]
    return map_texts(docs, kept, text_col, lambda: lambda texts: [machine.score([features(t) for t in texts])], [("score", "double")])


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text is divisible by 5; rows without an id are not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    # the sample is chosen among ids first, so that only its texts are moved
    usable = labels.where(~held_out() & F.col("label").isin(0, 1))
    chosen = hash_sample(usable, MAX_TRAIN, usable.count(), "doc_id", "label")
    machine = train(docs.join(F.broadcast(chosen), "doc_id"))
    return score(docs, machine).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
