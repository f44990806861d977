"""Penalised Cox regression on a cohort that no task holds.

The same objective as ``cox.fit``: the negative partial log likelihood (Breslow
ties) over n plus an elastic net. A step needs, at the current coefficients, the
likelihood, its gradient and its Hessian. Rows are first summed per distinct time;
risk sets are running sums of these over ranges of time; what a row adds to the
Hessian is its weight times the hazard up to its time, met by a join. The driver
holds d numbers and d x d sums and solves the penalised quadratic in d
coordinates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathework.frames import running
from lathework.operators.cox import L1_RATIO, Slope, penalised_step
from lathework.session import materialize


def _predicted(rows: DataFrame, b: np.ndarray) -> DataFrame:
    return rows.withColumn("eta", F.aggregate(F.zip_with("vec", F.array(*[F.lit(float(v)) for v in b]), lambda x, v: x * v), F.lit(0.0), lambda s, x: s + x))


def _gram(rows: DataFrame, weight: str, vec: str, d: int) -> np.ndarray:
    """The sum over rows of weight times the vector's outer product, by task and then over tasks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for x in batches:
            v = x.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            total += (v * x.column(0).to_numpy(zero_copy_only=False)[:, None]).T @ v
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["r", "g"])

    sums = rows.select(weight, vec).mapInArrow(work, "r int, g array<double>").groupBy("r").agg(F.array(*[F.sum(F.col("g")[k]) for k in range(d)]).alias("g"))
    out = np.zeros((d, d))
    for r, g in sums.collect():  # d rows
        out[r] = g
    return out


def slope(rows: DataFrame, b: np.ndarray, n: int, per_range: int = 100_000, value_only: bool = False) -> Slope:
    """Of ``rows (time, event, vec)`` at ``b``."""
    d = len(b)
    own = _predicted(rows, b)
    top = own.agg(F.max("eta")).first()[0]
    own = own.withColumn("w", F.exp(F.col("eta") - F.lit(top)))
    sums = [] if value_only else [F.sum(F.col("w") * F.col("vec")[k]).alias(f"s{k}") for k in range(d)]
    died = F.col("event").cast("double")
    t = own.groupBy("time").agg(F.sum(died).alias("deaths"), F.sum(died * F.col("eta")).alias("won"), F.sum("w").alias("s"), *sums)
    t = running(t, [], "time", {"risk": "s"} | {f"r{k}": f"s{k}" for k in range(len(sums))}, reverse=True, per_range=per_range)
    if value_only:
        found = t.where("deaths > 0").agg(F.sum(F.col("won") - F.col("deaths") * (F.log("risk") + F.lit(top))).alias("v")).first()
        return Slope(-(found["v"] or 0.0) / n, np.zeros(0), np.zeros((0, 0)))
    t = materialize(t.select("time", "deaths", "won", "risk", F.array(*[F.col(f"r{k}") for k in range(d)]).alias("of_risk")), "risk_sets")
    at = t.where("deaths > 0").withColumn("share", F.transform("of_risk", lambda x: x / F.col("risk")))
    found = at.agg(F.sum(F.col("won") - F.col("deaths") * (F.log("risk") + F.lit(top))).alias("v"), *[F.sum(F.col("deaths") * F.col("share")[k]).alias(f"g{k}") for k in range(d)]).first()
    deaths = rows.where("event").agg(*[F.sum(F.col("vec")[k]).alias(f"x{k}") for k in range(d)]).first()
    gradient = np.array([(found[f"g{k}"] or 0.0) - (deaths[f"x{k}"] or 0.0) for k in range(d)])
    hazard = running(t, [], "time", {"hazard": F.when(F.col("deaths") > 0, F.col("deaths") / F.col("risk")).otherwise(0.0)}, per_range=per_range).select("time", "hazard")
    met = own.join(hazard, "time").select((F.col("w") * F.col("hazard")).alias("h"), "vec")
    hessian = _gram(met, "h", "vec", d) - _gram(at, "deaths", "share", d)
    return Slope(-(found["v"] or 0.0) / n, gradient / n, (hessian + hessian.T) / (2 * n))


def fit_frame(rows: DataFrame, alpha: float, l1_ratio: float = L1_RATIO, max_steps: int = 50, tolerance: float = 1e-8, per_range: int = 100_000) -> np.ndarray:
    """The coefficients of ``rows (time, event, vec)``; proximal Newton with halved steps where the goal would not fall.

    Rows without time, event or vector are left out. Zeros without any event. Raises if ``max_steps`` don't settle.
    """
    own = materialize(rows.where("time is not null and event is not null and vec is not null").select("time", "event", F.col("vec").cast("array<double>").alias("vec")), "cohort")
    size = own.agg(F.count("*").alias("n"), F.count_if("event").alias("deaths"), F.max(F.size("vec")).alias("d")).first()
    b = np.zeros(size["d"] or 0)
    if not size["deaths"]:
        return b
    l1, l2 = alpha * l1_ratio, alpha * (1 - l1_ratio)
    goal = lambda value, b: value + l1 * np.abs(b).sum() + l2 / 2 * (b @ b)
    for _ in range(max_steps):
        at = slope(own, b, size["n"], per_range)
        whole = penalised_step(b, at, l1, l2) - b
        if np.abs(whole).max() < tolerance:
            return b + whole
        step = 1.0
        while goal(slope(own, b + step * whole, size["n"], per_range, value_only=True).value, b + step * whole) > goal(at.value, b) + 1e-13 and step > 1e-6:
            step /= 2
        b = b + step * whole
    raise RuntimeError(f"the coefficients have not settled in {max_steps} steps")
