"""Mixing sources to target weights by entropy balancing.

Every source has a target number of words. Among all rates from 0 to the limit
that meet the targets, the entropy-balanced ones stay closest, in relative
entropy, to taking each document once. A document of n words has the reference
weight ``n^(1 - TILT)``: between counting documents alike and counting words. The
rates are then tilted exponentially,

    rate = min(limit, exp(lambda_source * n^TILT)),

so that a source which must grow grows in its long documents first, and one which
must shrink loses of them first. The multipliers solve the convex dual

    minimise  sum_d n^(1 - TILT) * phi(lambda * n^TILT) - lambda * target,  phi' = min(limit, exp)

by Newton steps. Their sums are gathered by distributed aggregation over a row for
each size that a source has; steps that leave the known bracket halve it. Sums are
decimal, so reruns agree to the last digit.

Rates are rounded into whole copies by order sampling: each document gets
``floor(rate)`` copies, and one more by the order of ``u / (1 - u) * (1 - f) / f``,
where f is what is left of the rate and u a uniform hash, until the words that the
source still needs are reached: a document's chance is close to f. The cut is found
on a histogram of that order, refined within one bin and then by rows inside a
16-millionth. A single document per source whose size fits the rest best is then
added or left out. All this is a row per source; a document's copies follow
from that row alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from lathework.llm.common import documents, few, meet_groups, word_count
from lathework.session import materialize

WEIGHTS, SHARE, LIMIT = (5, 2, 1), 1.5, 2.0
TILT = 0.5
#: Parts of each source where there are too many sources to broadcast their rows.
SALT = 32
BINS = 4_096


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """``(has, source, source_size, target)`` from ``(has, source, source_size)``, a row per source.

    Sources by code point, null last, weigh ``weights`` in turn and share
    ``share`` times all words. A target stops at ``limit`` times its source;
    the excess is shared by weight among the others until none is above: in the
    end all others get the same level per weight. Works on a row per source.
    """
    # by code point: UTF-8 byte order is code point order
    rank = F.row_number().over(Window.orderBy(F.col("has").desc(), F.col("source").asc())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    own = sizes.withColumn("w", weight).withColumn("cap", limit * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("w"))
    everything = Window.orderBy("ratio", F.col("has").desc(), "source")
    before = everything.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    own = (
        own.withColumn("total", share * F.sum("source_size").over(whole))
        .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("rest_w", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        # the level if this source and all with higher ratios are below their limits
        .withColumn("level", F.when(F.col("ratio") * F.col("rest_w") >= F.col("total") - F.col("capped"), (F.col("total") - F.col("capped")) / F.col("rest_w")))
        .withColumn("level", F.first("level", ignorenulls=True).over(Window.orderBy("ratio", F.col("has").desc(), "source").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    return own.select("has", "source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


_KEYS = ["has", "source_key"]
_ROW = ("_order", "_hash", "_id", "_size")


def _rate(limit: float, tilt: float, size: str = "_size") -> Column:
    """The rate of a document from its source's ``lambda``; without one nothing is taken, but a document without words counts once."""
    free = F.least(F.lit(float(limit)), F.exp(F.col("lambda") * F.pow(F.col(size).cast("double"), F.lit(float(tilt)))))
    return F.when(F.col(size) == 0, F.lit(1.0)).otherwise(F.coalesce(free, F.lit(0.0)))


def solve(cells: DataFrame, limit: float = LIMIT, tilt: float = TILT, tolerance: float = 1e-10, max_steps: int = 80, small: bool | None = None) -> DataFrame:
    """Newton on the dual: ``(has, source_key, source_size, target, lambda)``.

    ``cells (has, source_key, salt, size, n, target)`` count the documents of each
    size; parts of a source may repeat a size. A source without words or with target zero has no
    finite solution and keeps lambda null. A target at or above the limit is met
    by the least lambda that takes all documents at the limit.
    """
    exact = lambda c: F.sum(c.cast("decimal(38,12)")).cast("double")
    x = F.pow(F.col("size").cast("double"), F.lit(float(tilt)))
    words = cells.where("size > 0")
    start = cells.groupBy(*_KEYS).agg(F.sum(F.col("size") * F.col("n")).cast("double").alias("source_size"), F.first("target").alias("target"), F.min(F.when(F.col("size") > 0, x)).alias("least"))
    grows = F.col("target") >= F.col("source_size")
    top = F.log(F.lit(float(limit))) / F.col("least")
    solvable = (F.col("source_size") > 0) & (F.col("target") > 0)
    low = F.when(grows, F.least(F.lit(0.0), top)).otherwise(F.least(top, F.log(F.col("target") / F.col("source_size")) / F.col("least")))
    high = F.when(grows, F.greatest(F.lit(0.0), top)).otherwise(F.lit(0.0))
    start = start.withColumn("low", F.when(solvable, low)).withColumn("high", F.when(solvable, high))
    state = materialize(start.withColumn("lambda", F.when(F.col("target") >= limit * F.col("source_size"), F.col("high")).otherwise(F.when(solvable, F.lit(0.0)))).drop("least"), "dual")
    small = few(state) if small is None else small
    for _ in range(max_steps):
        at = meet_groups(words, state.select(*_KEYS, "lambda"), _KEYS, copies=SALT, small=small)
        rate = F.exp(F.col("lambda") * x)
        mass = F.col("size") * F.col("n") * F.least(F.lit(float(limit)), rate)
        slope = F.when(rate < limit, F.col("size") * F.col("n") * x * rate).otherwise(F.lit(0.0))
        moved = at.groupBy(*_KEYS).agg(exact(mass).alias("mass"), exact(slope).alias("slope"))
        before = state
        met = state.join(moved, _KEYS, "left").withColumn("gap", F.abs(F.col("mass") - F.col("target")) / F.col("target"))
        met = met.withColumn("low", F.when(F.col("mass") < F.col("target"), F.greatest("low", "lambda")).otherwise(F.col("low")))
        met = met.withColumn("high", F.when(F.col("mass") > F.col("target"), F.least("high", "lambda")).otherwise(F.col("high")))
        newton = F.col("lambda") - (F.col("mass") - F.col("target")) / F.col("slope")
        step = F.when((F.col("slope") > 0) & (newton >= F.col("low")) & (newton <= F.col("high")), newton).otherwise((F.col("low") + F.col("high")) / 2)
        settled = (F.col("gap") < tolerance) | (F.col("high") - F.col("low") <= 1e-15)
        met = met.withColumn("done", F.col("lambda").isNull() | settled).withColumn("lambda", F.when(F.col("done"), F.col("lambda")).otherwise(step))
        seen = Observation()
        met = met.select(*_KEYS, "source_size", "target", "low", "high", "lambda", "done").observe(seen, F.count_if(~F.col("done")).alias("open"))
        state = materialize(met, "dual", before)
        if not seen.get["open"]:
            return state.select(*_KEYS, "source_size", "target", "lambda")
    raise RuntimeError(f"the dual has not settled in {max_steps} steps")


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """What a document's copies are decided by, with the whole row as ``_row``: source, size, hash and salt."""
    own = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), word_count(F.col(text_col)).alias("_size"), F.col(source_col).isNotNull().cast("int").alias("has"), F.coalesce(F.col(source_col), F.lit("")).alias("source_key"))
    own = own.withColumn("_hash", F.xxhash64(F.lit("mix"), F.col("_id"), F.col("_size")))
    return own.withColumn("salt", F.pmod(F.shiftright("_hash", 20), F.lit(SALT)).cast("int"))


def _rounding(rows: DataFrame, limit: float, tilt: float) -> DataFrame:
    """``rows`` with ``rate``, ``base`` copies for certain, and ``_order`` (0 to 1) for one more; null where none can be."""
    rows = rows.withColumn("rate", _rate(limit, tilt)).withColumn("base", F.least(F.floor(F.col("rate") + 1e-9), F.lit(int(limit))).cast("long"))
    left = F.col("rate") - F.col("base")
    u = (F.pmod("_hash", F.lit(1 << 52)) + 0.5) / float(1 << 52)
    odds = u / (1 - u) * (1 - left) / left
    rows = rows.withColumn("_order", F.when((left > 1e-9) & (F.col("base") + 1 <= limit), odds / (1 + odds)))
    at = F.floor(F.col("_order") * float(BINS * BINS))
    return rows.withColumn("_bin", F.floor(at / BINS)).withColumn("_fine", at - F.col("_bin") * BINS)


def _extra() -> Column:
    """Whether a document gets one copy more than its base: 1, 0, or -1 for one that is left out."""
    inside = F.struct(*_ROW) <= F.col("last")
    before = (F.col("_bin") < F.col("cut")) | ((F.col("_bin") == F.col("cut")) & (F.col("_fine") < F.col("fine")))
    here = (F.col("_bin") == F.col("cut")) & (F.col("_fine") == F.col("fine"))
    extra = F.when(F.col("_order").isNull(), 0).when(before, 1).when(here & F.col("last").isNotNull() & inside, 1).otherwise(0)
    flipped = F.size(F.filter("flips", lambda f: (f["_hash"] == F.col("_hash")) & f["_id"].eqNullSafe(F.col("_id")) & (f["_size"] == F.col("_size"))))
    return F.when(flipped % 2 == 0, extra).when((extra == 1) | (F.col("base") + 1 > F.col("most")), extra - 1).otherwise(1).cast("long")


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tilt: float = TILT) -> DataFrame:
    """The mix as a row per source, from which any document's copies follow.

    ``lambda`` gives the rates; the order of rounding is taken up to bin ``cut``,
    within it up to bin ``fine``, and within that up to the row ``last``; ``flips``
    is a single row for which it is the other way round. Rows equal in id, size
    and source are taken alike.
    """
    return _plan(_keyed(docs, id_col, text_col, source_col).drop("_row"), weights, share, limit, tilt)


def _first_beyond(bins: DataFrame, per: DataFrame, name: str, need: str) -> DataFrame:
    """Per source the bin in which the running sum passes what is needed, and the sum before it."""
    run = Window.partitionBy(*_KEYS).orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
    edges = bins.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0))).join(per.select(*_KEYS, need), _KEYS)
    return edges.where((F.col("before") <= F.col(need)) & (F.col("before") + F.col("words") > F.col(need))).select(*_KEYS, name, "before")


def _plan(keyed: DataFrame, weights: tuple[int, ...], share: float, limit: float, tilt: float) -> DataFrame:
    # one unit per distinct row, so that equal rows count together
    units = materialize(keyed.groupBy(*_KEYS, "_hash", "_id", "_size", "salt").agg((F.col("_size") * F.count("*")).alias("words"), F.count("*").alias("n")), "units")
    # a row for each size that a part of a source has
    cells = materialize(units.groupBy(*_KEYS, F.col("_size").alias("size"), F.pmod("_size", F.lit(SALT)).cast("int").alias("salt")).agg(F.sum("n").alias("n")), "cells")
    wanted = targets(cells.groupBy("has", F.col("source_key").alias("source")).agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, limit)
    wanted = materialize(wanted.select("has", F.col("source").alias("source_key"), "target"), "targets")
    small = few(wanted)
    per = solve(meet_groups(cells, wanted, _KEYS, copies=SALT, small=small), limit, tilt, small=small).withColumn("most", F.lit(int(limit)).cast("long"))
    per = materialize(per, "rates")

    dealt = lambda lam: _rounding(meet_groups(units, lam, _KEYS, copies=SALT, small=small), limit, tilt)
    bins = dealt(per.select(*_KEYS, "lambda")).groupBy(*_KEYS, "_bin").agg(F.sum(F.when(F.col("_order").isNotNull(), F.col("words")).otherwise(0)).alias("words"), F.sum(F.col("base") * F.col("words")).alias("sure"))
    bins = materialize(bins, "bins")
    sure = bins.groupBy(*_KEYS).agg(F.sum("sure").alias("sure"))
    per = per.join(sure, _KEYS).withColumn("need", F.floor(F.greatest(F.lit(0.0), F.col("target") - F.col("sure")) + 1e-6)).drop("sure")
    cut = _first_beyond(bins.where("_bin is not null"), per, "_bin", "need")
    # where all that can be taken is needed, or nothing, the cut lies beyond the bins
    per = per.join(cut.withColumnsRenamed({"_bin": "cut", "before": "cut_before"}), _KEYS, "left").withColumn("cut", F.coalesce(F.col("cut"), F.when(F.col("need") > 0, F.lit(BINS)).otherwise(F.lit(-1))).cast("long"))
    per = materialize(per.withColumn("rest", F.col("need") - F.col("cut_before")), "cuts")
    inside = dealt(per.select(*_KEYS, "lambda", "cut")).where("_bin = cut")
    fine = _first_beyond(inside.groupBy(*_KEYS, "_fine").agg(F.sum("words").alias("words")), per, "_fine", "rest")
    per = materialize(per.join(fine.withColumnsRenamed({"_fine": "fine", "before": "fine_before"}), _KEYS, "left").withColumn("rest", F.col("rest") - F.col("fine_before")), "fine_cuts")
    # the last row in that bin, equal rows together
    inside = dealt(per.select(*_KEYS, "lambda", "cut", "fine", "rest")).where("_bin = cut and _fine = fine")
    upto = F.sum("words").over(Window.partitionBy(*_KEYS).orderBy(*_ROW))
    last = inside.withColumn("upto", upto).where("upto <= rest").groupBy(*_KEYS).agg(F.max(F.struct(*_ROW)).alias("last"))
    none = F.filter(F.array(F.col("last")), lambda x: F.lit(False))
    per = per.drop("need", "cut_before", "fine_before", "rest").join(last, _KEYS, "left").withColumn("flips", none)
    return _fit(units, materialize(per, "plan"), limit, tilt, small)


def _fit(units: DataFrame, per: DataFrame, limit: float, tilt: float, small: bool) -> DataFrame:
    """Per source, the one row is flipped that brings the words taken closest to the target, if any does."""
    chosen = _rounding(meet_groups(units, per, _KEYS, copies=SALT, small=small), limit, tilt).withColumn("extra", _extra())
    taken = chosen.groupBy(*_KEYS).agg(F.sum((F.col("base") + F.col("extra")) * F.col("words")).alias("taken"))
    gap = materialize(per.join(taken, _KEYS).select(*_KEYS, (F.col("target") - F.col("taken")).alias("gap")), "gaps")
    single = "words > 0 and (base + extra < most or extra = 1 or base > 0) and not exists(flips, f -> f._hash = _hash and f._id <=> _id and f._size = _size)"
    scored = meet_groups(chosen.where(single), gap, _KEYS, copies=SALT, small=small)
    more = (F.col("extra") <= 0) & (F.col("base") + F.col("extra") < F.col("most"))
    after = F.abs(F.col("gap") - F.when(more, F.col("words")).otherwise(-F.col("words")))
    best = scored.withColumn("after", after).where(F.col("after") < F.abs("gap")).groupBy(*_KEYS, "salt").agg(F.min(F.struct("after", *_ROW)).alias("best")).groupBy(*_KEYS).agg(F.min("best").alias("best"))
    flip = best.select(*_KEYS, F.array(F.struct(*[F.col(f"best.{c}").alias(c) for c in _ROW])).alias("flip"))
    return materialize(per.join(flip, _KEYS, "left").withColumn("flips", F.when(F.col("flip").isNull(), F.col("flips")).otherwise(F.concat("flips", "flip"))).drop("flip"), "plan", per)


def apply_plan(docs: DataFrame, per: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", limit: float = LIMIT, tilt: float = TILT) -> DataFrame:
    """Each row of ``docs`` as often as the plan takes it, unchanged: no row moves if sources are few."""
    met = _rounding(meet_groups(_keyed(docs, id_col, text_col, source_col), per, _KEYS, copies=SALT), limit, tilt)
    taken = met.select("_row", (F.col("base") + _extra()).alias("_copies")).where("_copies > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select("_row.*")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tilt: float = TILT) -> DataFrame:
    """Per row: id, ``size``, ``source_size``, ``target``, ``rate``, ``copies``, ``taken``.

    Size is the number of words; a null text has none. A null source is a source
    of its own. Rows equal in id, size and source are taken alike. Documents
    without words are taken once and add none. No copies exceed ``limit``. The
    result is the same at any partitioning. Other columns are ignored.
    """
    own = materialize(_keyed(docs.select(id_col, text_col, source_col), id_col, text_col, source_col).drop("_row"), "sizes")  # words are counted once
    done = _rounding(meet_groups(own, _plan(own, weights, share, limit, tilt), _KEYS, copies=SALT), limit, tilt).withColumn("_copies", F.col("base") + _extra())
    return done.select(F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("source_size").cast("long").alias("source_size"), "target", "rate", F.col("_copies").alias("copies"), (F.col("_copies") * F.col("_size")).alias("taken"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(documents(spark, sf_dir))
    return found.select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")
