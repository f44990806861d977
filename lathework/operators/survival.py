"""Survival curves, group tests, concordance and its resampling.

Rows are ``(id, time, event, ...)`` with a boolean event. Curves and tests work
on counts per distinct time. Concordance compares pairs block by block in numpy
and returns sums, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathework.frames import cut_points, cut_position, hash_draw, hash_draws, running
from lathework.session import materialize


def life_table(rows: DataFrame, group: str | None = None, per_range: int = 100_000) -> DataFrame:
    """``(group, time, d, c, n)``: events, censored and number at risk at each distinct time, by a scan over ranges of time."""
    keys = [group] if group else []
    t = rows.where("time is not null and event is not null").groupBy(*keys, "time").agg(F.sum(F.col("event").cast("long")).alias("d"), F.sum((~F.col("event")).cast("long")).alias("c"))
    return running(t, keys, "time", {"n": F.col("d") + F.col("c")}, reverse=True, per_range=per_range)


def kaplan_meier(rows: DataFrame, group: str | None = None, per_range: int = 100_000) -> DataFrame:
    """``(group, time, n, d, s, low, high)`` at event times; Greenwood's variance on the log scale, 95 per cent.

    Log survival and variance are running sums; from a time at which all at risk have their event on, survival is zero.
    """
    keys = [group] if group else []
    d, n = F.col("d"), F.col("n")
    sums = {"ended": (d == n).cast("long"), "log_s": F.when(d < n, F.log(1 - d / n)), "v": F.when(d < n, d / (n * (n - d)))}
    out = running(life_table(rows, group, per_range).where("d > 0"), keys, "time", sums, per_range=per_range)
    out = out.withColumn("s", F.when(F.col("ended") > 0, 0.0).otherwise(F.exp("log_s"))).withColumn("v", F.sqrt("v"))
    bound = lambda sign: F.when(F.col("s") == 0, 0.0).otherwise(F.least(F.lit(1.0), F.col("s") * F.exp(sign * 1.959963984540054 * F.col("v"))))
    return out.select(*keys, "time", "n", "d", "s", bound(-1).alias("low"), bound(1).alias("high"))


def median_survival(rows: DataFrame, group: str) -> DataFrame:
    """The first time at which the curve is at one half or lower; null where it is not reached."""
    curve = kaplan_meier(rows, group)
    return rows.select(group).distinct().join(curve.where("s <= 0.5").groupBy(group).agg(F.min("time").alias("median")), group, "left")


#: Groups that a test compares at most; the covariances of all of them reach the driver.
MAX_GROUPS = 200


def _risk_sets(rows: DataFrame, group: str, per_range: int = 100_000) -> DataFrame:
    """``(time, group, d_g, n_g, d, n)`` at times with an event, for each group.

    A row per time holds all groups' counts side by side; those at risk are running sums from the last time back.
    """
    own = rows.where(f"time is not null and event is not null and {group} is not null")
    names = sorted(r[0] for r in own.select(group).distinct().limit(MAX_GROUPS + 1).collect())
    if len(names) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups")
    is_g = lambda g: F.col(group) == F.lit(g)
    counts = [F.sum((is_g(g) & F.col("event")).cast("long")).alias(f"d{k}") for k, g in enumerate(names)] + [F.sum(is_g(g).cast("long")).alias(f"m{k}") for k, g in enumerate(names)]
    t = own.groupBy("time").agg(F.sum(F.col("event").cast("long")).alias("d"), F.count("*").alias("m"), *counts)
    t = running(t, [], "time", {"n": "m"} | {f"n{k}": f"m{k}" for k in range(len(names))}, reverse=True, per_range=per_range).where("d > 0")
    kind = rows.schema[group].dataType
    cells = F.array(*[F.struct(F.lit(g).cast(kind).alias(group), F.col(f"d{k}").alias("d_g"), F.col(f"n{k}").alias("n_g")) for k, g in enumerate(names)])
    empty = f"array<struct<`{group}`:{kind.simpleString()},d_g:bigint,n_g:bigint>>"
    return t.select("time", F.explode(cells if names else F.array().cast(empty)).alias("g"), "d", "n").select("time", "g.*", "d", "n")


def log_rank_parts(rows: DataFrame, group: str) -> DataFrame:
    """Observed and expected events of each group."""
    return _risk_sets(rows, group).groupBy(group).agg(F.sum("d_g").cast("double").alias("observed"), F.sum(F.col("d") * F.col("n_g") / F.col("n")).alias("expected"))


def log_rank_two(rows: DataFrame, group: str) -> DataFrame:
    """The two-group statistic from the group with the smaller name: ``observed, expected, variance, chi2``."""
    sets = _risk_sets(rows, group)
    first = sets.join(sets.agg(F.min(group).alias(group)), group, "left_semi")
    n, d, m = F.col("n"), F.col("d"), F.col("n_g")
    var = F.when(n > 1, d * (m / n) * (1 - m / n) * (n - d) / (n - 1)).otherwise(0.0)
    out = first.agg(F.sum("d_g").cast("double").alias("observed"), F.sum(d * m / n).alias("expected"), F.sum(var).alias("variance"))
    return out.withColumn("chi2", F.try_divide((F.col("observed") - F.col("expected")) * (F.col("observed") - F.col("expected")), F.col("variance")))


def log_rank_many(rows: DataFrame, group: str) -> tuple[float, int, float]:
    """Statistic, degrees of freedom and p of the k-group test; only k sums and k*k covariances reach the driver."""
    from lathework.operators.tests import chi2_tail

    sets = _risk_sets(rows, group)
    other = sets.select("time", F.col(group).alias("h"), F.col("n_g").alias("n_h"))
    n, d = F.col("n"), F.col("d")
    share = F.when(F.col(group) == F.col("h"), F.col("n_g") / n * (1 - F.col("n_g") / n)).otherwise(-F.col("n_g") * F.col("n_h") / (n * n))
    cov = sets.join(other, "time").groupBy(group, "h").agg(F.sum(F.when(n > 1, d * share * (n - d) / (n - 1)).otherwise(0.0)).alias("v")).toPandas()
    parts = log_rank_parts(rows, group).toPandas().sort_values(group)
    names = parts[group].tolist()
    u = (parts["observed"] - parts["expected"]).to_numpy()[:-1]
    v = cov.pivot(index=group, columns="h", values="v").loc[names, names].to_numpy()[:-1, :-1]
    if not len(u):
        return 0.0, 0, 1.0
    stat = float(u @ np.linalg.pinv(v) @ u)
    return stat, len(u), chi2_tail(stat, len(u))


#: Events that a resample needs.
MIN_EVENTS = 2
def comparable(ta, ea, tb, eb) -> np.ndarray:
    """Which pairs (a, b) can be ordered: a has its event first; at equal times an event comes before a censored end."""
    return ea[:, None] & ((ta[:, None] < tb[None, :]) | ((ta[:, None] == tb[None, :]) & ~eb[None, :]))


def _placed(df: DataFrame, key: str, per_range: int, max_ranges: int) -> tuple[Column, Column]:
    """The range of a row, and whether the row is at the range's upper cut."""
    cuts = cut_points(df, key, per_range, max_ranges)
    if not cuts:
        return F.lit(0), F.lit(False)
    place = cut_position(F.col(key), cuts)
    return place, F.coalesce(F.get(F.lit(cuts), place) == F.col(key), F.lit(False))


def _time_range(df: DataFrame, per_range: int, max_ranges: int) -> Column:
    """Ranges of time in order, a multiple of three; events and censored ends at a cut have the two numbers after it for themselves."""
    place, cut = _placed(df, "time", per_range, max_ranges)
    return (3 * place + F.when(~cut, 0).when(F.col("event"), 1).otherwise(2)).cast("int")


def _risk_range(df: DataFrame, risk: str, per_range: int, max_ranges: int) -> Column:
    """Ranges of risk in order, even; a risk at a cut has the odd number for itself."""
    place, cut = _placed(df, risk, per_range, max_ranges)
    return (2 * place + cut.cast("int")).cast("int")


#: Ranges of time and of risk at most: their table of counts, six times the square, is summed on the driver.
MAX_RANGES = 256
#: Columns from which ``dominated`` takes products of stretches instead of a running sum per bit.
MANY = 16


def dominated(order: np.ndarray, rank: np.ndarray, weight: np.ndarray, asks: np.ndarray) -> np.ndarray:
    """The sum over x of asks[x] times the weights of all y with order[y] > order[x] and rank[y] < rank[x].

    ``weight`` and ``asks`` are n numbers, or n rows with a column per replicate; a number
    per column comes back. Ranks are compared bit by bit: x and y part at one bit, where x
    has a one and y a zero and the bits above are equal. For each bit one running
    sum, in descending order, over those with equal bits above.
    """
    n = len(rank)
    rank = np.unique(rank, return_inverse=True)[1]
    seat = np.lexsort((-rank, -order))  # of equal order the higher rank comes first and counts none of them
    rank, weight, asks = rank[seat], weight[seat].astype(float).reshape(n, -1), asks[seat].astype(float).reshape(n, -1)
    if weight.shape[1] >= MANY:
        return _dominated_in_squares(rank, weight, asks)
    total = np.zeros(weight.shape[1])
    for bit in range(int(rank.max(initial=0)).bit_length()):
        above, one = rank >> (bit + 1), (rank >> bit & 1).astype(bool)[:, None]
        by = np.argsort(above, kind="stable")
        before = np.vstack([np.zeros((1, weight.shape[1])), np.cumsum(np.where(one[by], 0.0, weight[by]), axis=0)])
        first = np.searchsorted(above[by], above[by], side="left")
        total += (asks[by] * one[by] * (before[:-1] - before[first])).sum(axis=0)
    return total


def _dominated_in_squares(rank: np.ndarray, weight: np.ndarray, asks: np.ndarray) -> np.ndarray:
    """``dominated`` for many columns, rows in their order: asks times the weights of earlier rows with a lower rank.

    Rows are cut into about the root of n stretches of the order and of the rank. Pairs
    inside a stretch are a product of its 0/1 matrix with the weights, pairs apart in
    both come from a table of the stretches' sums, about as many as rows.
    """
    n, total = len(rank), np.zeros(weight.shape[1])
    size = max(64, int(np.sqrt(n)))
    by_rank = np.lexsort((-np.arange(n), rank))  # of equals the later row first, so that none of them counts
    place = np.empty(n, np.int64)
    place[by_rank] = np.arange(n)
    lower = np.tri(size, k=-1, dtype=bool)
    for at in range(0, n, size):
        own = place[at : at + size]
        d = lower[: len(own), : len(own)] & (own[None, :] < own[:, None])
        total += np.einsum("ij,ij->j", asks[at : at + size], d.astype(float) @ weight[at : at + size])
    stretch = np.arange(n) // size
    for at in range(0, n, size):
        rows = by_rank[at : at + size]
        d = lower[: len(rows), : len(rows)] & (stretch[rows][None, :] < stretch[rows][:, None])
        total += np.einsum("ij,ij->j", asks[rows], d.astype(float) @ weight[rows])
    many = -(-n // size)
    below = np.zeros((many, weight.shape[1]))  # of the stretches before, by rank
    for at in range(0, n, size):
        at_rank = place[at : at + size] // size
        lesser = np.cumsum(below, axis=0) - below
        total += np.einsum("ij,ij->j", asks[at : at + size], lesser[at_rank])
        order = np.argsort(at_rank, kind="stable")
        firsts = np.flatnonzero(np.diff(at_rank[order], prepend=-1))
        below[at_rank[order][firsts]] += np.add.reduceat(weight[at : at + size][order], firsts, axis=0)
    return total


def later(order: np.ndarray, group: np.ndarray, weight: np.ndarray, asks: np.ndarray) -> np.ndarray:
    """The sum over x of asks[x] times the weights of all y of its group with order[y] > order[x], per column: one running sum."""
    by = np.lexsort((-order, group))
    order, group = order[by], group[by]
    new_group = np.diff(group, prepend=group[0] - 1) != 0
    new = new_group | (np.diff(order, prepend=order[0] - 1) != 0)
    at = np.arange(len(by))
    start, same = np.maximum.accumulate(np.where(new_group, at, 0)), np.maximum.accumulate(np.where(new, at, 0))
    if (start == same).all():  # nothing in a group comes after another
        return np.zeros(weight.shape[1])
    before = np.cumsum(weight[by], axis=0, dtype=float)
    before = np.vstack([np.zeros((1, weight.shape[1])), before])
    held = before[same]
    held -= before[start]
    return np.einsum("ij,ij->j", asks[by], held)


def concordance(rows: DataFrame, risk: str = "risk", per_range: int = 100_000, max_ranges: int = MAX_RANGES) -> DataFrame:
    """``(concordant, comparable, c)``: higher risk should have the event first; equal risks count one half.

    Pairs are counted, not made. Times and risks are cut into ranges, a value at
    a cut is a range of its own. Of a pair with different times and risks either
    the times share a range, or else the risks do, or neither: the first two are counted
    inside one range in n log n, the third from a table of the ranges' sizes.
    Each row is shuffled to its range of time and to its range of risk. Pairs
    that can be ordered and pairs of equal risk are running sums.
    """
    own = rows.where(f"time is not null and event is not null and {risk} is not null").select("time", F.col("event").cast("boolean").alias("event"), F.col(risk).cast("double").alias("r"))
    cells = materialize(own.groupBy("time", "event", "r").agg(F.count("*").alias("m")), "cells")
    cells = materialize(cells.withColumns({"p": _time_range(cells, per_range, max_ranges), "q": _risk_range(cells, "r", per_range, max_ranges)}), "placed", cells)

    def in_time(part: pd.DataFrame) -> pd.DataFrame:
        event = part["event"].to_numpy(bool)
        order = 2 * np.unique(part["time"].to_numpy(), return_inverse=True)[1] + ~event  # at equal times an event comes before a censored end
        m = part["m"].to_numpy(float)
        return pd.DataFrame({"good": dominated(order, part["r"].to_numpy(), m, np.where(event, m, 0))})

    def in_risk(part: pd.DataFrame) -> pd.DataFrame:
        m = part["m"].to_numpy(float)
        return pd.DataFrame({"good": dominated(part["p"].to_numpy(), part["r"].to_numpy(), m, np.where(part["event"].to_numpy(bool), m, 0))})

    near = cells.where("p % 3 = 0").groupBy("p").applyInPandas(in_time, "good double").unionByName(cells.where("q % 2 = 0").groupBy("q").applyInPandas(in_risk, "good double"))
    table = cells.groupBy("p", "q").agg(F.sum("m").alias("m"), F.sum(F.when(F.col("event"), F.col("m")).otherwise(0)).alias("e")).toPandas()  # 6 * MAX_RANGES ** 2 rows at most
    far = _apart(table["p"].to_numpy(int), table["q"].to_numpy(int), table["m"].to_numpy(float), table["e"].to_numpy(float)) if len(table) else 0.0

    events, all_m = F.when(F.col("event"), F.col("m")).otherwise(0), F.sum("m").alias("m")
    later = lambda keys: running(cells.groupBy(*keys, "time").agg(F.sum(events).alias("e"), all_m), keys, "time", {"later": "m"}, reverse=True, per_range=per_range).agg(
        F.coalesce(F.sum(F.col("e") * (F.col("later") - F.col("e"))), F.lit(0)).cast("double").alias("n")
    )
    sums = near.agg(F.coalesce(F.sum("good"), F.lit(0.0)).alias("near")).crossJoin(later(["r"]).withColumnRenamed("n", "ties")).crossJoin(later([]).withColumnRenamed("n", "comparable"))  # a row each
    return sums.select((F.col("near") + F.lit(far) + 0.5 * F.col("ties")).alias("concordant"), "comparable").withColumn("c", F.try_divide("concordant", "comparable"))


def _apart(p: np.ndarray, q: np.ndarray, m: np.ndarray, e: np.ndarray) -> float:
    """Events with a later range of time and a lower range of risk, from the table of ranges."""
    p, q = np.unique(p, return_inverse=True)[1], np.unique(q, return_inverse=True)[1]
    all_m, all_e = np.zeros((p.max() + 2, q.max() + 2)), np.zeros((p.max() + 2, q.max() + 2))
    all_m[p, q + 1], all_e[p, q + 1] = m, e
    below = np.cumsum(all_m, axis=1)  # risks up to column q - 1
    later = np.cumsum(below[::-1], axis=0)[::-1]
    return float((all_e[:-1, 1:] * later[1:, :-1]).sum())


def multiplicities(spark, n: int, replicates: int, seed: str = "b") -> DataFrame:
    """``(rank, w)``: how often each of n ranks is drawn in each replicate, as an array over replicates."""
    draws = spark.range(replicates * n).select(F.floor(F.col("id") / n).cast("int").alias("b"), (F.col("id") % n).alias("k"))
    drawn = draws.select("b", hash_draw(n, seed, F.col("b"), F.col("k")).alias("rank")).groupBy("rank", "b").agg(F.count("*").cast("int").alias("m"))
    return drawn.groupBy("rank").agg(F.map_from_entries(F.collect_list(F.struct("b", "m"))).alias("w"))


#: Ranks whose draws are put together in a task (offsets of two bytes), and draws that a task makes and sorts at a time.
RANKS, SORTED = 2**14, 2**20


def counted_draws(spark, n: int, replicates: int, seed: str = "b") -> DataFrame:
    """``(rank, w)``: the draws of ``multiplicities``, ``w`` with a byte per replicate, a row for each of the n ranks.

    A draw is shuffled as two bytes, its place in a range of ``RANKS`` ranks; no row per draw is.
    """
    chunks = -(-replicates * n // SORTED)
    tasks = max(1, min(chunks, max(4 * spark.sparkContext.defaultParallelism, chunks // 64)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(chunk: int) -> pa.RecordBatch:
            b, k = np.divmod(np.arange(chunk * SORTED, min((chunk + 1) * SORTED, replicates * n)), n)
            keys = np.sort(b * n + hash_draws(seed, b, k, n))  # by replicate, then rank
            b, rank = np.divmod(keys, n)
            part = rank // RANKS
            first = np.flatnonzero(np.r_[True, (np.diff(b) != 0) | (np.diff(part) != 0)])
            places = (rank % RANKS).astype(np.uint16)
            cells = [x.tobytes() for x in np.split(places, first[1:])]
            return pa.RecordBatch.from_arrays([pa.array(part[first], pa.int32()), pa.array(b[first], pa.int32()), pa.array(cells, pa.binary())], names=["part", "b", "places"])

        for x in batches:
            for chunk in x.column(0).to_pylist():
                yield packed(chunk)

    def counts(part: pa.Table) -> pa.Table:
        at = part.column("part")[0].as_py() * RANKS
        m = np.zeros((replicates, min(RANKS, n - at)), np.uint16)
        for b, places in zip(part.column("b").to_pylist(), part.column("places").to_pylist(), strict=True):
            m[b] += np.bincount(np.frombuffer(places, np.uint16), minlength=m.shape[1]).astype(np.uint16)
        if m.max(initial=0) > 255:
            raise ValueError("a rank was drawn more than 255 times in a replicate")
        m = np.ascontiguousarray(m.astype(np.uint8).T)
        ends = pa.array(np.arange(len(m) + 1) * replicates, pa.int32())
        return pa.table({"rank": pa.array(at + np.arange(len(m)), pa.int64()), "w": pa.Array.from_buffers(pa.binary(), len(m), [None, ends.buffers()[1], pa.py_buffer(m.tobytes())])})

    return spark.range(0, chunks, 1, tasks).mapInArrow(pack, "part int, b int, places binary").groupBy("part").applyInArrow(counts, "rank long, w binary")


#: Ranges of a resampled cohort at most, and replicates that a task holds side by side.
BOOT_RANGES, BOOT_CHUNK = 32, 100


def _drawn(part: pd.DataFrame, replicates: int):
    """``(first replicate, multiplicities of the rows)`` for chunks of replicates."""
    m = np.frombuffer(b"".join(part["w"]), np.uint8).reshape(len(part), replicates)
    for at in range(0, replicates, BOOT_CHUNK):
        yield at, m[:, at : at + BOOT_CHUNK].astype(float)


def bootstrap_concordance(ranked: DataFrame, risks: list[str], replicates: int = 1_000, seed: str = "b", per_range: int = 20_000) -> DataFrame:
    """``(b, c_<risk>...)`` per replicate: the concordance of each risk under the same resample of patients.

    ``ranked`` has ranks 0..n-1. A pair counts as often as the product of its
    patients' multiplicities. Pairs are counted as in ``concordance``, for all
    replicates side by side: a patient is shuffled to its range of time and to
    its range of each risk, and no pair is made. Replicates that drew fewer than
    ``MIN_EVENTS`` events have no row.
    """
    n = ranked.count()
    own = ranked.join(counted_draws(ranked.sparkSession, n, replicates, seed), "rank").withColumn("event", F.col("event").cast("boolean"))
    places = {"p": _time_range(ranked, per_range, BOOT_RANGES)} | {f"q{k}": _risk_range(ranked, r, per_range, BOOT_RANGES) for k, r in enumerate(risks)}
    own = materialize(own.withColumns(places).select("id", "time", "event", "w", *risks, *places), "resampled")
    # ranges of a single time are only summed up; they are dealt out
    own = own.withColumn("salt", F.when(F.col("p") % 3 == 0, 0).otherwise(F.pmod(F.xxhash64("id"), F.lit(8))).cast("int"))
    sums = "k int, p int, q int, at int, less array<double>, more array<double>, pairs array<double>, m array<double>, e array<double>"

    def rows(k, p, q, at, **of) -> dict:
        return {"k": k, "p": p, "q": q, "at": at} | {c: of.get(c) for c in ("less", "more", "pairs", "m", "e")}

    def sides(order, rank, m, e, pairs) -> tuple[np.ndarray, np.ndarray]:
        """Pairs with a lower risk later, and with a higher one: what is left of ``pairs`` without equal risks."""
        less = dominated(order, rank, m, e)
        return less, pairs - less - later(order, np.unique(rank, return_inverse=True)[1], m, e)

    def in_time(part: pd.DataFrame) -> pd.DataFrame:
        p, event = int(part["p"].iloc[0]), part["event"].to_numpy(bool)
        order = 2 * np.unique(part["time"].to_numpy(), return_inverse=True)[1] + ~event
        out = []
        for at, m in _drawn(part, replicates):
            e = m * event[:, None]
            pairs = later(order, np.zeros(len(order), np.int64), m, e) if p % 3 == 0 else None  # of any risk
            for k, r in enumerate(risks):
                if p % 3 == 0:
                    less, more = sides(order, part[r].to_numpy(float), m, e, pairs)
                    out.append(rows(k, None, None, at, less=less, more=more, pairs=pairs))
                q, group = np.unique(part[f"q{k}"].to_numpy(), return_inverse=True)
                own_m, own_e = np.zeros((len(q), m.shape[1])), np.zeros((len(q), m.shape[1]))
                np.add.at(own_m, group, m)
                np.add.at(own_e, group, e)
                out += [rows(k, p, int(x), at, m=own_m[g], e=own_e[g]) for g, x in enumerate(q)]
        return pd.DataFrame(out)

    def in_risk(part: pd.DataFrame) -> pd.DataFrame:
        k, order = int(part["k"].iloc[0]), part["p"].to_numpy()
        rank, event, out = part["r"].to_numpy(float), part["event"].to_numpy(bool), []
        for at, m in _drawn(part, replicates):
            e = m * event[:, None]
            less, more = sides(order, rank, m, e, later(order, np.zeros(len(order), np.int64), m, e))
            out.append(rows(k, None, None, at, less=less, more=more))
        return pd.DataFrame(out)

    def total(part: pd.DataFrame) -> pd.DataFrame:
        """A chunk of replicates of one risk: what tasks have counted, and pairs apart in both from the table of ranges."""
        local = part[part["p"].isna()]  # of ranges
        add = lambda c: sum((np.asarray(v) for v in local[c] if v is not None), np.zeros(width))
        table = part[part["p"].notna()]
        width = len(table["m"].iloc[0])
        p, q = (np.unique(table[c].to_numpy(), return_inverse=True)[1] for c in "pq")
        m, e = np.zeros((p.max() + 1, q.max() + 1, width)), np.zeros((p.max() + 1, q.max() + 1, width))
        np.add.at(m, (p, q), np.array(table["m"].tolist()))
        np.add.at(e, (p, q), np.array(table["e"].tolist()))
        later = np.cumsum(m[::-1], axis=0)[::-1]
        later = np.concatenate([later[1:], np.zeros((1, *later.shape[1:]))])
        below = np.cumsum(later, axis=1) - later
        any_risk = later.sum(axis=1, keepdims=True)
        less, more, pairs = (add(c) + (e * x).sum(axis=(0, 1)) for c, x in (("less", below), ("more", any_risk - below - later), ("pairs", any_risk)))
        at, k = int(part["at"].iloc[0]), int(part["k"].iloc[0])
        return pd.DataFrame({"k": k, "b": at + np.arange(width), "good": 0.5 * (less + pairs - more), "n": pairs})

    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"q{k}").alias("q"), F.col(r).cast("double").alias("r")) for k, r in enumerate(risks)]))
    by_risk = own.select("event", "w", "p", each.alias("x")).select("event", "w", "p", "x.*").where("q % 2 = 0")
    counted = own.groupBy("p", "salt").applyInPandas(in_time, sums).unionByName(by_risk.groupBy("k", "q").applyInPandas(in_risk, sums))
    found = counted.groupBy("k", "at").applyInPandas(total, "k int, b int, good double, n double").where("n > 0")

    def events(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(replicates, np.int64)
        for x in batches:
            total += np.frombuffer(b"".join(x.column(0).to_pylist()), np.uint8).reshape(x.num_rows, replicates).sum(axis=0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates), pa.int32()), pa.array(total)], names=["b", "events"])

    enough = own.where("event").select("w").mapInArrow(events, "b int, events long").groupBy("b").agg(F.sum("events").alias("events")).where(F.col("events") >= MIN_EVENTS)
    wide = found.groupBy("b").agg(*[F.max(F.when(F.col("k") == k, F.col("good") / F.col("n"))).alias(f"c_{r}") for k, r in enumerate(risks)])
    return wide.join(enough.select("b"), "b", "left_semi")


def interval(rows: DataFrame, value: str, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Percentile interval and mean of replicate values."""
    return rows.agg(F.avg(value).alias("mean"), F.percentile(value, F.lit(low)).alias("ci_lower"), F.percentile(value, F.lit(high)).alias("ci_upper"), F.count(value).alias("n"))


def delta_interval(replicates: DataFrame, a: str, b: str) -> DataFrame:
    """Interval of the paired difference, and whether it leaves out zero."""
    out = interval(replicates.withColumn("delta", F.col(f"c_{a}") - F.col(f"c_{b}")), "delta")
    return out.withColumn("ci_excludes_zero", (F.col("ci_lower") > 0) | (F.col("ci_upper") < 0)).withColumn("meets_criterion", F.col("ci_excludes_zero") & (F.col("mean") >= 0.03))
