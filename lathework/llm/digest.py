"""Improbable-feature digests and their likeness.

Every window of ``WINDOW`` bytes has an entropy. How often an entropy occurs in
the whole corpus ranks it: the rarer, the better a window with it tells texts
apart (windows of almost no entropy come last). In every span of ``SPAN``
neighbouring windows the best one, by rank and then by hash, wins a point;
windows with ``POINTS`` or more are the text's features. Features are inserted
into a chain of Bloom filters, ``PER_FILTER`` in each.

Ranks are those of the corpus whose counts are given: within one run those of all
its texts. To match digests across runs, counts are stored once and read again.

Two digests are compared filter by filter: the overlap of set bits is put on a
scale between what chance gives and the most there can be. Each filter of the
shorter chain takes its best partner; the mean is the likeness.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathework.llm.common import documents, range_parts

WINDOW, SPAN, POINTS = 8, 32, 8
FILTER_BITS, HASHES, PER_FILTER = 2_048, 5, 160
CHANCE = 0.05
GRAIN = 16
#: Sum of c*log2(c) over byte counts c, in 1/64 bit; a window's entropy falls with it.
_F = np.array([0, *[round(64 * c * np.log2(c)) for c in range(1, WINDOW + 1)]], dtype=np.int32)
_STEP = np.diff(_F, prepend=0).astype(np.int32)
BINS = int(_F[WINDOW]) // GRAIN + 1
#: Bins of windows with less than one bit of entropy a byte.
WEAK = int((np.log2(WINDOW) - 1) * 64 * WINDOW) // GRAIN
_PAD = SPAN + WINDOW
_BASE = 0x9E3779B97F4A7C15 | 1


def pack(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts with room between them; each text's first window and number of windows (one if shorter than a window, none if empty)."""
    parts, starts, at = [bytes(_PAD)], [], _PAD
    for t in texts:
        starts.append(at)
        parts += [t, bytes(max(0, WINDOW - len(t)) + _PAD)]
        at += max(len(t), WINDOW) + _PAD
    counts = np.array([len(t) - WINDOW + 1 if len(t) >= WINDOW else int(len(t) > 0) for t in texts], dtype=np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), np.array(starts, dtype=np.int64), counts


def entropies(data: np.ndarray) -> np.ndarray:
    """The entropy bin of the window at each position."""
    ahead, back = np.ones(len(data), np.uint8), np.ones(len(data), np.uint8)
    for d in range(1, WINDOW):
        same = (data[:-d] == data[d:]).view(np.uint8)
        ahead[:-d] += same
        back[d:] += same
    n = len(data) - WINDOW + 1
    total = np.empty(n, np.int32)
    first = np.bincount(data[:WINDOW], minlength=256)
    total[0] = _F[first].sum()
    np.cumsum(_STEP[back[WINDOW:]] - _STEP[ahead[: n - 1]], out=total[1:])
    total[1:] += total[0]
    return total // GRAIN


def valid(n: int, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Which positions are a text's windows."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + counts, -1)
    return np.cumsum(edge[:-1]) > 0


class Hasher:
    """Hashes of all windows by differences of running sums modulo 2^64."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        inverse = pow(_BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE, np.uint64)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, inverse, np.uint64)]), dtype=np.uint64)

    def __call__(self, data: np.ndarray) -> np.ndarray:
        if len(data) > len(self.up):
            self._grow(2 * len(data))
        n = len(data) - WINDOW + 1
        with np.errstate(over="ignore"):
            run = np.zeros(len(data) + 1, np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.down[: len(data)], out=run[1:])
            h = (run[WINDOW:] - run[:n]) * self.up[:n]
            h ^= h >> np.uint64(30)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(27)
            h *= np.uint64(0x94D049BB133111EB)
            return h ^ (h >> np.uint64(31))


def features(texts: list[bytes], rank: np.ndarray, hasher: Hasher) -> list[np.ndarray]:
    """Distinct feature hashes of each text in the order of their first windows."""
    data, starts, counts = pack(texts)
    bins, hashes = entropies(data), hasher(data)
    n = len(bins)
    worst = np.uint64(0xFFFFFFFFFFFFFFFF)
    shift = max(1, int(n).bit_length())
    room = 64 - 12 - shift
    key = (rank[bins].astype(np.uint64) << np.uint64(52)) | ((hashes >> np.uint64(64 - room)) << np.uint64(shift)) | np.arange(n, dtype=np.uint64)
    key = np.where(valid(n, starts, counts), key, worst)
    least = key
    size = 1
    while size < SPAN:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    winners = (least[least != worst] & np.uint64((1 << shift) - 1)).astype(np.int64)
    chosen = np.nonzero(np.bincount(winners, minlength=n) >= POINTS)[0]
    cut = np.searchsorted(chosen, np.concatenate([starts, [n]]))
    out = []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        own = hashes[chosen[a:b]]
        _, first = np.unique(own, return_index=True)
        out.append(own[np.sort(first)])
    return out


def bloom(own: np.ndarray) -> np.ndarray:
    """The chain of filters as rows of bits; no rows without features."""
    rows = -(-len(own) // PER_FILTER)
    bits = np.zeros((rows, FILTER_BITS), bool)
    at = np.arange(len(own)) // PER_FILTER
    for k in range(HASHES):
        bits[at, ((own >> np.uint64(11 * k)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = True
    return bits


def to_text(bits: np.ndarray) -> str:
    return base64.b64encode(np.packbits(bits, axis=1).tobytes()).decode() if len(bits) else ""


def from_text(digest: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(digest), np.uint8).reshape(-1, FILTER_BITS // 8)
    return np.unpackbits(raw, axis=1).astype(bool) if len(raw) else np.zeros((0, FILTER_BITS), bool)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1, symmetric; digests without features are like each other and unlike all others."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    x, y = a.astype(np.float32), b.astype(np.float32)
    both, na, nb = x @ y.T, x.sum(axis=1), y.sum(axis=1)
    most = np.minimum(na[:, None], nb[None, :])
    least = na[:, None] * nb[None, :] / FILTER_BITS
    cut = least + CHANCE * (most - least)
    scores = np.clip((both - cut) / np.maximum(most - cut, 1e-6), 0, 1)
    rows, columns = scores.max(axis=1), scores.max(axis=0)
    if len(a) != len(b):
        return float((rows * na).sum() / na.sum() if len(a) < len(b) else (columns * nb).sum() / nb.sum())
    return float(((rows * na).sum() / na.sum() + (columns * nb).sum() / nb.sum()) / 2)


def entropy_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """How many windows of all texts have each entropy; a row per bin reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BINS, np.int64)
        for batch in batches:
            for texts in _slices(batch.column(0)):
                data, starts, counts = pack([t.encode("utf-8", "replace") for t in texts])
                bins = entropies(data)
                seen += np.bincount(bins[valid(len(bins), starts, counts)], minlength=BINS)
        at = np.nonzero(seen)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[at], pa.int64())], names=["bin", "n"])

    found = np.zeros(BINS, np.int64)
    for k, n in docs.select(F.coalesce(F.col(text_col), F.lit(""))).mapInArrow(count, "bin int, n long").groupBy("bin").agg(F.sum("n")).collect():
        found[k] = n
    return found


def _slices(column: pa.Array, most: int = 1 << 19) -> Iterator[list[str]]:
    """Texts in lists of about ``most`` characters."""
    part, size = [], 0
    for value in column:
        part.append(value.as_py() or "")
        size += len(part[-1])
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def write_counts(spark: SparkSession, counts: np.ndarray, path: str) -> None:
    """Keeps the counts that ranks come from, a row per bin, so that texts of later runs and other corpora get digests that can be compared."""
    spark.createDataFrame([(k, int(n)) for k, n in enumerate(counts)], "bin int, n long").coalesce(1).write.parquet(path)


def read_counts(spark: SparkSession, path: str) -> np.ndarray:
    found = np.zeros(BINS, np.int64)
    for r in spark.read.parquet(path).collect():  # a row per bin
        found[r["bin"]] = r["n"]
    return found


def rarity(counts: np.ndarray) -> np.ndarray:
    """The rank of each bin, rarest first; bins of weak windows after all others."""
    order = sorted(range(BINS), key=lambda k: (k >= WEAK, counts[k], k))
    rank = np.empty(BINS, np.int64)
    rank[order] = np.arange(BINS)
    return rank


def digest_with_next(docs: DataFrame, rank: np.ndarray, id_col: str = "doc_id", text_col: str = "text", per_range: int = 4_000) -> DataFrame:
    """Digests of every text and of its edit, and likenesses with the edit and the next document.

    The next document is the next in ascending id, equal ids by text hash and
    text, null ids first; after the last comes the first. Ids are numbers; they
    are cut into ranges; each range also gets the first row of the next one, so rows stream
    through sorted partitions with one text held back. Null texts count as empty.
    """
    own = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    part, ranges = range_parts(own, "_id", per_range)
    own = own.withColumn("_part", part)
    firsts = {r[0]: r[1] for r in own.groupBy("_part").agg(F.min(F.struct(F.col("_id").isNotNull().alias("has"), "_id"))["_id"].alias("first")).collect()}  # a row per range
    if not firsts:
        return docs.sparkSession.createDataFrame([], _schema(docs, id_col))
    order = sorted(firsts)
    before = {p: order[k - 1] for k, p in enumerate(order)}  # the first range follows the last
    first = F.element_at(F.lit([firsts.get(p) for p in range(order[-1] + 1)]), F.col("_part") + 1) if any(v is not None for v in firsts.values()) else F.lit(None)
    back = F.element_at(F.lit([before.get(p, 0) for p in range(order[-1] + 1)]), F.col("_part") + 1)
    here = F.struct(F.col("_part").alias("part"), F.lit(False).alias("lent"))
    there = F.struct(back.cast("int").alias("part"), F.lit(True).alias("lent"))
    dealt = own.withColumn("_to", F.explode(F.when(F.col("_id").eqNullSafe(first), F.array(here, there)).otherwise(F.array(here))))
    dealt = dealt.select("_to.part", "_to.lent", "_id", "_text").repartitionById(order[-1] + 1, F.col("part")).sortWithinPartitions("part", "lent", F.col("_id").asc_nulls_first(), F.xxhash64("_text"), "_text")
    schema = _schema(docs, id_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        hasher = Hasher()
        pending = None  # (part, id, text) of the row that waits for its next
        for batch in batches:
            pairs, size = [], 0
            for part, lent, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                text = text.as_py()
                if pending and pending[0] == part:
                    pairs.append((pending[1], pending[2], text))
                    size += len(pending[2])
                pending = None if lent else (part, key, text)
                if size >= 1 << 18:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(_rows(pairs, rank, hasher), kinds.types, strict=True)], schema=kinds)
                    pairs, size = [], 0
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(_rows(pairs, rank, hasher), kinds.types, strict=True)], schema=kinds)

    return dealt.mapInArrow(work, schema)


def _schema(docs: DataFrame, id_col: str):
    from pyspark.sql import types as T

    return T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *T._parse_datatype_string("n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").fields])


def _rows(pairs: list[tuple], rank: np.ndarray, hasher: Hasher) -> list[list]:
    """Columns of the result for ``(id, text, next text)``."""
    edits = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for _, t, n in pairs]
    # neighbours follow each other: a text is digested once, as a row's own and as the next of the row before
    texts, at = [], []
    for k, (_, t, n) in enumerate(pairs):
        if not texts or texts[-1] != t or k == 0:
            texts.append(t)
        at.append(len(texts) - 1)
        texts.append(n)
    raw = [t.encode("utf-8", "replace") for t in texts] + [e.encode("utf-8", "replace") for e in edits]
    bits = [bloom(f) for f in features(raw, rank, hasher)]
    mine = [bits[k] for k in at]
    following = [bits[k + 1] for k in at]
    edited = bits[len(texts) :]
    return [
        [p[0] for p in pairs],
        [len(p[1]) for p in pairs],
        [hashlib.sha256(r).hexdigest() for r in raw[len(texts) :]],
        [to_text(b) for b in mine],
        [to_text(b) for b in edited],
        [likeness(a, b) for a, b in zip(mine, edited, strict=True)],
        [likeness(a, b) for a, b in zip(mine, following, strict=True)],
    ]


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return digest_with_next(docs, rarity(entropy_counts(docs)))
