"""Language identification: multinomial logistic regression on character n-grams.

Features are hashed character 1- to 3-grams of the lower-cased letters, weighted
by term frequency (share of the text's n-grams of that order) times inverse
document frequency. A sparse model is trained online by follow-the-regularised-
leader with an elastic-net penalty; a temperature fitted on rows that training
did not see calibrates its probabilities.

Document frequencies cover all training rows. The classifier itself is fitted
on a bounded sample of them (``max_train`` rows, those with the smallest
hashes); scoring is one pass over whole texts, without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lathework.llm.common import documents, hash_sample, map_texts

ORDERS, BITS = (1, 2, 3), 14
DIM = len(ORDERS) << BITS
#: Rows that the classifier is fitted on at most, and of these the share kept for calibration.
MAX_TRAIN, HELD = 3_000, 0.2
UNKNOWN = "und"


def letters_of(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, lower case, every run of other characters one space; and where each text starts.

    Every text is framed by spaces. A text without letters, if only of combining marks, is a single space.
    """
    import regex

    runs, letter = regex.compile(r"[^\p{L}\p{M}]+"), regex.compile(r"\p{L}")
    parts = [f" {runs.sub(' ', t.lower()).strip()} " if t and letter.search(t) else " " for t in texts]
    starts = np.cumsum([0, *map(len, parts)])
    return np.frombuffer("".join(parts).encode("utf-32-le", "replace"), dtype=np.uint32), starts


def grams(points: np.ndarray) -> list[np.ndarray]:
    """For each order the hashed n-gram that starts at each position, offset by order."""
    out = []
    hashed = np.zeros(len(points), dtype=np.uint32)
    for k in range(max(ORDERS)):
        shifted = np.zeros_like(points)
        shifted[: len(points) - k] = points[k:] if k else points
        hashed = (hashed ^ shifted) * np.uint32(0x9E3779B1)
        hashed ^= hashed >> np.uint32(15)
        if k + 1 in ORDERS:
            out.append(((hashed * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)).astype(np.int32) + (ORDERS.index(k + 1) << BITS))
    return out


def sparse_rows(texts: list) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct features of each text and their term frequencies."""
    points, starts = letters_of(texts)
    of = grams(points)
    rows = []
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        ids, values = [], []
        for n, g in zip(ORDERS, of, strict=True):
            own = g[a : b - n + 1]
            if b - a > 1 and len(own):
                u, c = np.unique(own, return_counts=True)
                ids.append(u)
                values.append(c / len(own))
        rows.append((np.concatenate(ids), np.concatenate(values)) if ids else (np.zeros(0, np.int32), np.zeros(0)))
    return rows


def document_frequencies(texts: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """In how many texts each feature occurs, and the number of texts. One sum of ``DIM`` numbers per task."""

    def count(batches):
        seen, n = np.zeros(DIM, dtype=np.int64), 0
        flag = np.zeros(DIM, dtype=bool)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                points, starts = letters_of(batch.column(0).slice(at, 512).to_pylist())
                of = grams(points)
                for a, b in zip(starts[:-1], starts[1:], strict=True):
                    if b - a > 1:
                        for k, g in zip(ORDERS, of, strict=True):
                            flag[g[a : b - k + 1]] = True
                        seen += flag
                        flag[:] = False
                        n += 1
        at = np.nonzero(seen)[0]
        yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), -1], pa.int32()), pa.array([*seen[at].tolist(), n], pa.int64())], names=["feature", "n"])

    found = texts.select(text).mapInArrow(count, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()  # DIM + 1 rows at most
    df = np.zeros(DIM, dtype=np.int64)
    n = 0
    for k, v in found:
        if k < 0:
            n = v
        else:
            df[k] = v
    return df, n


class Ftrl:
    """Follow the proximally regularised leader, one weight vector per class, elastic net."""

    def __init__(self, classes: int, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((DIM + 1, classes))
        self.n = np.zeros((DIM + 1, classes))

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, ids: np.ndarray, values: np.ndarray, label: int) -> None:
        at = np.append(ids, DIM)  # the last feature is the intercept
        x = np.append(values, 1.0)
        w = self.weights(at)
        p = softmax(x @ w)
        p[label] -= 1
        g = x[:, None] * p[None, :]
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(scores: np.ndarray, labels: np.ndarray, prior: float = 1.0) -> float:
    """The temperature with the least log loss, by golden section on its logarithm; 1 without rows.

    ``prior`` errors are assumed beside those seen, so that a model without
    errors on n rows is not taken to be certain.
    """
    if not len(labels):
        return 1.0
    k = scores.shape[1]
    doubt = prior / (len(labels) + 2 * prior)
    wanted = np.full(scores.shape, doubt / max(k - 1, 1))
    wanted[np.arange(len(labels)), labels] = 1 - doubt
    loss = lambda t: -np.mean((wanted * np.log(np.maximum(softmax(scores / math.exp(t)), 1e-300))).sum(axis=1))
    low, high, r = math.log(0.05), math.log(20.0), (math.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - r * (high - low), low + r * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return math.exp((low + high) / 2)


class Model:
    """Scores texts: per-feature class weights with idf and temperature folded in."""

    def __init__(self, classes: list[str], table: np.ndarray, bias: np.ndarray):
        self.classes, self.table, self.bias = classes, table.astype(np.float32), bias.astype(np.float32)

    def predict(self, texts: list) -> tuple[list[str], list[float]]:
        points, starts = letters_of(texts)
        size = np.diff(starts)
        total = np.tile(self.bias.astype(np.float64), (len(texts), 1))
        empty = size <= 1
        if len(points) and self.classes:
            of = grams(points)
            for n, g in zip(ORDERS, of, strict=True):
                w = self.table[g]
                for k in range(1, n):  # windows that reach into the next text
                    at = starts[1:] - k
                    w[at[at >= starts[:-1]]] = 0
                sums = np.add.reduceat(w, starts[:-1], axis=0, dtype=np.float64)
                total += sums / np.maximum(size - n + 1, 1)[:, None]
        p = softmax(total) if self.classes else np.zeros((len(texts), 1))
        best = p.argmax(axis=1)
        lang = [UNKNOWN if e or not self.classes else self.classes[k] for e, k in zip(empty, best, strict=True)]
        return lang, [0.0 if x == UNKNOWN and e else float(v) for x, e, v in zip(lang, empty | (not self.classes), p.max(axis=1), strict=True)]


def train(rows: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", max_train: int = MAX_TRAIN, epochs: int = 6) -> Model:
    """The model from ``rows`` with a language and letters; document frequencies from all of them.

    The sample is the ``max_train`` rows with the smallest hashes of id,
    language and text; of repeated rows any number may be in it. Without labelled rows
    the model knows no language and answers ``und``.
    """
    rows = rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    df, n = document_frequencies(rows, text)
    idf = np.log((1 + n) / (1 + df)) + 1
    sample = hash_sample(rows, max_train, n, *([id_col] if id_col in rows.columns else []), lang, text)

    def make() -> Callable:
        def of(texts: list) -> list[list]:
            found = sparse_rows(texts)
            return [[x.tolist() for x, _ in found], [v.tolist() for _, v in found]]

        return of

    found = map_texts(sample, [lang], text, make, [("ids", "array<int>"), ("tf", "array<float>")]).toArrow()
    labels = found.column(0).to_pylist()
    # views of the whole columns, so that the sample is held once
    ids, tf = found.column(1).combine_chunks(), found.column(2).combine_chunks()
    edge, ids, tf = ids.offsets.to_numpy(), ids.values.to_numpy(), tf.values.to_numpy()
    data = [(ids[a:b], tf[a:b] * idf[ids[a:b]], y) for a, b, y in zip(edge[:-1], edge[1:], labels, strict=True) if b > a]
    classes = sorted({y for *_, y in data})
    if not classes:
        return Model([], np.zeros((DIM, 1)), np.zeros(1))
    number = {y: k for k, y in enumerate(classes)}
    held = [x for k, x in enumerate(data) if k % round(1 / HELD) == 0] if len(data) >= 50 else []
    fit = [x for k, x in enumerate(data) if k % round(1 / HELD)] if held else data
    model = Ftrl(len(classes))
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(fit)):
            ids, values, y = fit[k]
            model.learn(ids, values, number[y])
    w = model.weights()
    scores = np.array([v @ w[i] + w[DIM] for i, v, _ in held]) if held else np.zeros((0, len(classes)))
    t = temperature(scores, np.array([number[y] for *_, y in held], dtype=int))
    return Model(classes, w[:DIM] * idf[:, None] / t, w[DIM] / t)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Per row: id, ``lang_pred``, ``score``. Null texts and texts without letters are ``und`` with score 0.

    With ``keep`` other columns are returned than the id; one that has a name of
    ``names`` gives way to the result.
    """
    kept = [c for c in keep or [id_col] if c not in names]
    return map_texts(docs, kept, text_col, lambda: lambda texts: list(model.predict(texts)), [(names[0], "string"), (names[1], "double")])


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 1 modulo 3; rows without an id are not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs.where(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
