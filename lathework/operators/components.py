"""Principal components of many features and any number of samples.

A block Krylov iteration on the features' side: a seeded random block of directions,
then again and again what the centred samples make of the last block, ``A'(A Q)``. A pass
over the samples sums d x b numbers in blocks of features; rows are never paired
with rows, nor features with features. The driver holds the basis and its image, d x m
each, behind a check of their size. A component has settled once the residual of
its eigenpair is small against the largest eigenvalue; what does not settle raises.

Where that basis could pass its limit, ``of_cells`` iterates on the samples' side instead:
block Lanczos on ``A A'``, which is a sum over blocks of features of ``A_f (A_f' Z)``. A
block's cells meet all of ``Z`` in one task, so nothing per feature is shuffled or
reaches the driver; the basis is a table with a row per sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from lathework.frames import global_rank
from lathework.operators import lanczos
from lathework.session import materialize

#: Directions of a block beyond the wanted components, numbers that the basis may have (256 MB), residual that counts as settled, features of a block of sums, numbers of a block of rows, share of a block's length below which a direction is nothing new.
SPARE, MAX_BASIS, SETTLED, CHUNK, BLOCK, NOTHING = 10, 2**25, 1e-8, 256, 2**22, 1e-10

#: For the samples' side: cells of a block of features, blocks of features at least, cells multiplied at a time, blocks that the basis holds, residual against the largest eigenvalue.
CELLS, FEWEST, SLICE, WIDEST, SIDE_SETTLED = 2**23, 16, 2**18, 16, 1e-7


class Components(NamedTuple):
    """``(id, pc)`` with the samples' scores, shares of the whole variance, unit axes as columns, residuals against the largest eigenvalue."""

    scores: DataFrame
    ratio: np.ndarray
    axes: np.ndarray
    residuals: np.ndarray


def _blocks(b: pa.RecordBatch, dims: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and dense rows of a batch of ``id, vec`` or ``id, at, v``, few enough rows at a time for ``BLOCK`` numbers."""
    step = max(1, BLOCK // dims)
    for k in range(0, b.num_rows, step):
        part = b.slice(k, step)
        if part.num_columns == 2:
            x = part.column(1).flatten().to_numpy(zero_copy_only=False)
            if len(x) != dims * part.num_rows:
                raise ValueError(f"a vector has other than {dims} values")
            yield part.column(0), x.reshape(-1, dims)
        else:
            x = np.zeros((part.num_rows, dims))
            row = np.repeat(np.arange(part.num_rows), part.column(1).value_lengths().to_numpy(zero_copy_only=False))
            x[row, part.column(1).flatten().to_numpy(zero_copy_only=False)] = part.column(2).flatten().to_numpy(zero_copy_only=False)
            yield part.column(0), x


def _summed(vectors: DataFrame, dims: int, wide: int, work) -> np.ndarray:
    """The sum of ``work(rows)``, ``dims`` x ``wide`` numbers, over all samples: by task, then by block of features."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, wide))
        for b in batches:
            for _, x in _blocks(b, dims):
                total += work(x)
        starts = list(range(0, dims, CHUNK))
        yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int32()), pa.array([total[a : a + CHUNK].tobytes() for a in starts], pa.binary())], names=["a", "s"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for a, s in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = np.frombuffer(s.as_buffer())
                held[a] = held[a] + x if a in held else x
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["a", "s"])

    kind = "a int, s binary"
    found = vectors.mapInArrow(part, kind).repartition("a").mapInArrow(add, kind).collect()  # dims x wide numbers
    out = np.zeros((dims, wide))
    for a, s in found:
        x = np.frombuffer(s).reshape(-1, wide)
        out[a : a + len(x)] = x
    return out


def krylov(vectors: DataFrame, dims: int, components: int = 10, seed: int = 0, settled: float = SETTLED) -> Components:
    """The leading principal components of ``(id, vec)``, all vectors ``dims`` long, or of the cells ``(id, at, v)`` that are not zero; no nulls.

    The frame is read once a pass, so give a stored one. Spark reads 4,096 rows
    of a Parquet file at a time: dense vectors of many features are better given as cells, or
    that number lowered. Fewer components come back where samples or features are fewer. Of each component the
    largest score (by size to six places) is positive. Raises if the basis would
    pass ``MAX_BASIS`` numbers before all components have settled.
    """
    if "at" in vectors.columns:
        vectors = vectors.select("id", F.col("at").cast("array<int>").alias("at"), F.col("v").cast("array<double>").alias("v"))
    else:
        vectors = vectors.select("id", F.col("vec").cast("array<double>").alias("vec"))
    n = vectors.count()
    width = min(components + SPARE, dims, max(n, 1))
    if dims * width > MAX_BASIS:
        raise ValueError(f"{dims} features and {width} directions; a basis takes {MAX_BASIS} numbers")
    mean = _summed(vectors, dims, 1, lambda x: x.sum(axis=0)[:, None])[:, 0] / max(n, 1)
    whole = _summed(vectors, dims, 1, lambda x: ((x - mean) ** 2).sum(axis=0)[:, None]).sum()
    most = max(min(components, n - 1, dims), 0)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, width)))[0]
    basis, image = np.zeros((dims, 0)), np.zeros((dims, 0))
    while True:
        moved = _summed(vectors, dims, q.shape[1], lambda x, q=q: (x - mean).T @ ((x - mean) @ q))
        basis, image = np.hstack([basis, q]), np.hstack([image, moved])
        inner = basis.T @ image
        theta, u = np.linalg.eigh((inner + inner.T) / 2)
        u = u[:, ::-1][:, :most]
        theta = np.maximum(theta[::-1][:most], 0)
        largest = max(theta.max(initial=0), 1e-300)
        residuals = np.linalg.norm(image @ u - (basis @ u) * theta, axis=0) / largest
        if residuals.max(initial=0) <= settled or basis.shape[1] >= dims:
            break
        # twice against the basis, so that what is left is orthogonal to it to the last place
        left = moved - basis @ (basis.T @ moved)
        left -= basis @ (basis.T @ left)
        axes, size, _ = np.linalg.svd(left, full_matrices=False)
        q = axes[:, size > NOTHING * largest]
        q -= basis @ (basis.T @ q)
        if not q.shape[1]:
            break
        q = np.linalg.qr(q)[0]
        if (basis.shape[1] + q.shape[1]) * dims > MAX_BASIS:
            raise RuntimeError(f"residuals of {residuals.max():.1e} with {basis.shape[1]} directions")
    axes = basis @ u
    kind = vectors.schema["id"].dataType.simpleString()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, x in _blocks(b, dims):
                y = (x - mean) @ axes
                ends = pa.array(np.arange(len(y) + 1) * most, pa.int32())
                yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(ends, pa.array(y.ravel()))], names=["id", "pc"])

    raw = vectors.mapInArrow(project, f"id {kind}, pc array<double>")
    if n and most:
        top = raw.agg(*[F.max(F.struct(F.round(F.abs(F.col("pc")[k]), 6).alias("size"), F.col("pc")[k].alias("v")))["v"].alias(f"v{k}") for k in range(most)]).first()
        signs = np.array([-1.0 if v < 0 else 1.0 for v in top])
        axes = axes * signs
        raw = vectors.mapInArrow(project, f"id {kind}, pc array<double>")
    return Components(raw, theta / max(whole, 1e-300), axes, residuals)


def fits(n: int, dims: int, components: int = 10) -> bool:
    """Whether ``krylov`` could hold a basis of the whole space, so that it can't pass its limit."""
    return dims * (min(n, dims) + components + SPARE) <= MAX_BASIS


class Scores(NamedTuple):
    """``(id, pc)`` with the samples' scores, shares of the whole variance, residuals against the largest eigenvalue."""

    scores: DataFrame
    ratio: np.ndarray
    residuals: np.ndarray


def _add(out: np.ndarray, to: np.ndarray, weight: np.ndarray, x: np.ndarray, of: np.ndarray) -> None:
    """``out[to] += weight * x[of]`` for all cells, ascending in ``to``."""
    for s in range(0, len(to), SLICE):
        own = to[s : s + SLICE]
        starts = np.flatnonzero(np.diff(own, prepend=own[0] - 1))
        out[own[starts]] += np.add.reduceat(weight[s : s + SLICE, None] * x[of[s : s + SLICE]], starts, axis=0)


def _pack(part: pa.Table) -> pa.Table:
    """A block's cells in one row, ascending by feature; its features are numbered anew."""
    at, sample, v = (part.column(c).to_numpy() for c in ("at", "sample", "v"))
    order = np.lexsort((sample, at))
    at = np.unique(at, return_inverse=True)[1]
    return pa.table({"f": part.column("f").slice(0, 1), "at": [at[order].astype(np.int32).tobytes()], "sample": [sample[order].astype(np.int32).tobytes()], "v": [v[order].astype(float).tobytes()]})


def of_cells(cells: DataFrame, components: int = 10, settled: float = SIDE_SETTLED, blocks: int | None = None) -> Scores:
    """The leading principal components of ``(id, at, v)``, the samples' cells that are not zero, for any number of features.

    A task holds a block of features' cells (about ``CELLS``) and a number per sample and direction. Components without variance
    are left out; signs as in ``krylov``.
    """
    order = F.col("id") if isinstance(cells.schema["id"].dataType, NumericType) else F.xxhash64("id")
    places = materialize(global_rank(cells.select("id").withColumn("_order", order), "_order", "sample").select("id", "sample"), "places")
    n = places.count()
    flat = cells.select("id", F.explode(F.arrays_zip("at", "v")).alias("c")).join(places, "id").select("sample", F.col("c.at").alias("at"), F.col("c.v").cast("double").alias("v"))
    if n < 2 or flat.isEmpty():
        return Scores(cells.select("id", F.array().cast("array<double>").alias("pc")), np.zeros(0), np.zeros(0))
    flat = materialize(flat, "cells")
    total = flat.count()
    blocks = blocks or max(FEWEST, -(-total // CELLS))
    dealt = flat.withColumn("f", F.pmod(F.xxhash64("at"), F.lit(blocks)).cast("int"))
    packed = materialize(dealt.groupBy("f").applyInArrow(_pack, "f int, at binary, sample binary, v binary"), "packed")
    square = flat.groupBy("at").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q")).agg(F.sum(F.col("q") - F.col("s") * F.col("s") / n)).first()[0]

    def times(block: DataFrame, b: int) -> DataFrame:
        def work(held: pa.Table, z: pa.Table) -> pa.Table:
            if not held.num_rows or not z.num_rows:
                return pa.table({"id": pa.array([], pa.int64()), "y": pa.array([], pa.list_(pa.float64()))})
            at, sample = (np.frombuffer(held.column(c)[0].as_buffer(), np.int32) for c in ("at", "sample"))
            v = np.frombuffer(held.column("v")[0].as_buffer())
            own = np.zeros((n, b))
            own[z.column("id").to_numpy()] = z.column("z").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, b)
            mean = np.bincount(at, v)[:, None] / n
            w = np.zeros((len(mean), b))
            _add(w, at, v, own, sample)
            w -= mean * own.sum(axis=0)
            by_sample = np.argsort(sample, kind="stable")
            y = np.zeros((n, b))
            _add(y, sample[by_sample], v[by_sample], w, at[by_sample])
            y -= (mean * w).sum(axis=0)
            return pa.table({"id": pa.array(np.arange(n)), "y": pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * b, pa.int32()), pa.array(y.ravel()))})

        copies = block.select("id", "z", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("f"))
        parts = packed.groupBy("f").cogroup(copies.groupBy("f")).applyInArrow(work, "id long, y array<double>")
        return parts.groupBy("id").agg(F.array(*[F.sum(F.col("y")[k]) for k in range(b)]).alias("y"))

    first = places.select(F.col("sample").alias("id"), (F.xxhash64("sample", F.lit(0)).cast("double") / 2.0**63).alias("root"))
    theta, residuals, table, s = lanczos.leading(times, first, min(components, n - 1), settled, widest=WIDEST)
    kept = theta > settled * theta.max()
    if not kept.any():
        return Scores(cells.select("id", F.array().cast("array<double>").alias("pc")), np.zeros(0), np.zeros(0))
    theta, s = theta[kept], s[:, kept]
    unit = lanczos.combine(table, s * np.sqrt(theta))
    scores = unit.join(places, unit["id"] == places["sample"]).select(places["id"], F.col("vec").alias("pc"))
    return Scores(scores, theta / square, residuals[kept] / theta.max())
