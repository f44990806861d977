"""Quality rules: fixed base rules, then robust multivariate outliers.

Statistics of a text are computed inside its row by DataFrame functions. Repeated
three-word windows are found by sorting the windows' hashes: a 64-bit hash's
upper 44 bits and the window's position are packed into one long, so a primitive
sort brings equal windows together; neighbours are then compared by their whole
hash. Texts with 2^20 windows or more take the same way with unpacked structs.

The documents that pass the base rules are judged by transformed statistic
vectors within their language and source, by minimum covariance determinant
estimates of location and scatter. The search has four deterministic starts
(the ordinary mean and scatter; medians and median deviations; these with the
correlations of squashed deviations; and with those of spatial signs). From each,
concentration steps re-estimate from the share ``h`` of rows with the smallest
Mahalanobis distances. After ``FIRST`` steps the start with the smallest
determinant is kept in each group and goes on until its determinant settles. The
scatter is made consistent at the normal distribution, rows beyond ``REWEIGHT`` of
it are set aside and the others give the final estimates. A document is rejected
if its squared distance passes the ``1 - TAIL`` quantile of the chi-squared
distribution.

Groups under ``min_group`` rows are pooled within their language, and those of
languages under ``min_group`` rows with each other. A group's rows are never
gathered: a step sums moments per fine bin of distance, and the bins up to the
share ``h`` (of the last one the part that is missing) give the next estimates.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from lathework.llm.common import WORD, documents, meet_groups
from lathework.session import materialize

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"
#: The share of rows that the estimates rest on, steps from every start, most steps in all, least rows of a group.
H, FIRST, STEPS, MIN_GROUP = 0.75, 2, 60, 200
#: Quantile up to which rows take part in the final estimates; the share of normal rows that is rejected.
REWEIGHT, TAIL = 0.975, 1e-3
#: Bins of the squared distance in each doubling, and the doublings that are told apart.
PER_OCTAVE, LOW, HIGH = 32, -12, 24
#: A change of a log determinant that counts as none.
SETTLED = 1e-4
#: Variance that is added to every feature, so that constant features don't make a scatter singular.
FLOOR = (0.04, 0.01, 0.002, 0.03, 0.03, 0.01)
SALT = 32


def _repeat_words(words: str) -> str:
    """SQL: words covered by three-word windows that occur twice or more, the first included."""
    n = f"(size({words}) - 2)"
    hashes = f"transform(sequence(0, size({words}) - 3), i -> xxhash64({words}[i], {words}[i + 1], {words}[i + 2]))"
    # h: hashes; s: sorted keys; positions of windows equal to a neighbour in sorted order
    packed = (
        "array_sort(filter(transform(sequence(0, size(s) - 1), i -> if("
        "(i > 0 and h[cast(s[i] & 1048575L as int)] = h[cast(s[greatest(i - 1, 0)] & 1048575L as int)]) or "
        "(i < size(s) - 1 and h[cast(s[i] & 1048575L as int)] = h[cast(s[least(i + 1, size(s) - 1)] & 1048575L as int)]), cast(s[i] & 1048575L as int), -1)), p -> p >= 0))"
    )
    wide = (
        "array_sort(filter(transform(sequence(0, size(s) - 1), i -> if("
        "(i > 0 and s[i].h = s[greatest(i - 1, 0)].h) or (i < size(s) - 1 and s[i].h = s[least(i + 1, size(s) - 1)].h), s[i].p, -1)), p -> p >= 0))"
    )
    cover = "aggregate({at}, struct(0 as upto, 0L as n), (a, p) -> struct(p + 3 as upto, a.n + p + 3 - greatest(p, a.upto) as n), a -> a.n)"
    bind = "aggregate(array(0), {value}, (a, e) -> a, {name} -> {body})"
    sort_packed = "sort_array(transform(h, (x, i) -> (x & -1048576L) | i))"
    sort_wide = "array_sort(transform(h, (x, i) -> struct(x as h, i as p)))"
    short = bind.format(value=sort_packed, name="s", body=cover.format(at=packed))
    long = bind.format(value=sort_wide, name="s", body=cover.format(at=wide))
    whole = f"if(size(array_distinct(h)) = size(h), 0L, if(size(h) < 1048576, {short}, {long}))"
    return f"if({n} < 2, 0L, {bind.format(value=hashes, name='h', body=whole)})"


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rest = [c for c in docs.columns if c != text_col]
    words = docs.select(*rest, text.alias("_t")).withColumn("_w", F.regexp_extract_all("_t", F.lit(f"({WORD})"), F.lit(1)))
    lines = r"filter(split(_t, '\n', -1), x -> x rlike '[^\\x20\\x09-\\x0D]')"
    words = words.withColumn("_l", F.expr(lines))
    return words.select(
        *rest,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.expr(_repeat_words("_w")).alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        F.regexp_count("_t", F.lit("[A-Z]")).cast("long").alias("n_upper"),
    )


def features() -> list[Column]:
    """Transformed statistics, roughly symmetric for ordinary prose."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    lines = F.greatest(F.col("n_lines"), F.lit(1)).cast("double")
    return [
        F.log1p(n),
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n) * 2.0,
        F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)).cast("double")) * 2.0,
        F.sqrt(F.col("n_dup_lines") / lines),
        F.sqrt(F.col("n_repeat_words") / n),
        F.sqrt(F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)).cast("double")) * 2.0,
    ]


D = len(FLOOR)
X = [f"x{i}" for i in range(D)]
PAIRS = [(i, j) for i in range(D) for j in range(i + 1)]


def chi_squared(x: float, k: int) -> float:
    """The distribution function for an even number of degrees of freedom."""
    term, total = 1.0, 0.0
    for j in range(k // 2):
        total += term
        term *= x / 2 / (j + 1)
    return 1 - math.exp(-x / 2) * total


def chi_quantile(p: float, k: int = D) -> float:
    low, high = 0.0, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_squared(mid, k) < p else (low, mid)
    return high


def consistency(share: float) -> float:
    """What the scatter of the ``share`` of normal rows nearest to the centre has to be multiplied by."""
    return share / chi_squared(chi_quantile(share), D + 2)


def _moments(weight: Column | None = None) -> list[Column]:
    w = F.lit(1.0) if weight is None else weight
    return [F.sum(w).alias("n"), *[F.sum(w * F.col(x)).alias(f"s_{x}") for x in X], *[F.sum(w * F.col(X[i]) * F.col(X[j])).alias(f"q_{i}{j}") for i, j in PAIRS]]


def _cholesky(df: DataFrame, keys: list[str]) -> DataFrame:
    """``m_i`` and the Cholesky factor ``l_ij`` of the scatter ``c_ij`` with the floor on its diagonal, and ``logdet``.

    One projection: later columns refer to earlier ones.
    """
    steps = []
    for j in range(D):
        for i in range(j, D):
            inner = F.col(f"c_{i}{j}") + F.lit(FLOOR[i] if i == j else 0.0)
            for k in range(j):
                inner = inner - F.col(f"l_{i}{k}") * F.col(f"l_{j}{k}")
            # the floor on the diagonal keeps pivots at FLOOR or above, but for rounding
            steps.append((F.sqrt(F.greatest(inner, F.lit(FLOOR[i] / 2))) if i == j else inner / F.col(f"l_{j}{j}")).alias(f"l_{i}{j}"))
    logdet = sum((F.log(f"l_{i}{i}") for i in range(1, D)), F.log("l_00")) * 2
    return df.select(*keys, *[f"m_{i}" for i in range(D)], *steps, logdet.alias("logdet"))


def _estimate(sums: DataFrame, keys: list[str], factor: float = 1.0) -> DataFrame:
    """Location and factored scatter, times ``factor``, from sums."""
    means = [(F.col(f"s_{x}") / F.col("n")).alias(f"m_{i}") for i, x in enumerate(X)]
    scatter = [((F.col(f"q_{i}{j}") / F.col("n") - F.col(f"m_{i}") * F.col(f"m_{j}")) * F.lit(factor)).alias(f"c_{i}{j}") for i, j in PAIRS]
    return _cholesky(sums.select(*keys, *means, *scatter), keys)


def _distance(df: DataFrame) -> DataFrame:
    """The squared Mahalanobis distance by forward substitution."""
    steps = []
    for i in range(D):
        z = F.col(X[i]) - F.col(f"m_{i}")
        for k in range(i):
            z = z - F.col(f"l_{i}{k}") * F.col(f"_z{k}")
        steps.append((z / F.col(f"l_{i}{i}")).alias(f"_z{i}"))
    used = {*[f"m_{i}" for i in range(D)], *[f"l_{i}{j}" for i, j in PAIRS]}
    total = sum((F.col(f"_z{i}") * F.col(f"_z{i}") for i in range(1, D)), F.col("_z0") * F.col("_z0"))
    return df.select("*", *steps).select(*[c for c in df.columns if c not in used], total.alias("d2"))


GROUP = ["g_lang", "g_source"]


def _starts(own: DataFrame) -> DataFrame:
    """``(group, start, m_i, l_ij, logdet)``: four estimates of each group."""
    plain = _estimate(own.groupBy(*GROUP).agg(*_moments()), GROUP).withColumn("start", F.lit(0))
    middle = lambda c, n: F.percentile_approx(c, 0.5, 10_000).alias(n)
    medians = materialize(own.groupBy(*GROUP).agg(*[middle(x, f"m_{i}") for i, x in enumerate(X)]), "medians")
    away = meet_groups(own, medians, GROUP)
    mads = materialize(away.groupBy(*GROUP).agg(*[middle(F.abs(F.col(x) - F.col(f"m_{i}")), f"d_{i}") for i, x in enumerate(X)]).join(medians, GROUP), "deviations")
    # median deviations of normal rows are 0.6745 of a standard deviation; the floor stands for those of constant features
    sd = lambda i: F.sqrt(F.pow(F.col(f"d_{i}") / 0.6744897501960817, F.lit(2.0)) + F.lit(FLOOR[i]))
    z = meet_groups(own, mads, GROUP).select(*GROUP, *[((F.col(x) - F.col(f"m_{i}")) / sd(i)).alias(x) for i, x in enumerate(X)])
    length = F.sqrt(sum((F.col(x) * F.col(x) for x in X[1:]), F.col(X[0]) * F.col(X[0])))
    views = {2: z.select(*GROUP, *[F.tanh(x).alias(x) for x in X]), 3: z.select(*GROUP, *[F.coalesce(F.try_divide(F.col(x), length), F.lit(0.0)).alias(x) for x in X])}
    out = plain
    alone = mads.select(*GROUP, *[f"m_{i}" for i in range(D)], *[(F.pow(sd(i), F.lit(2.0)) - F.lit(FLOOR[i]) if i == j else F.lit(0.0)).alias(f"c_{i}{j}") for i, j in PAIRS])
    out = out.unionByName(_cholesky(alone, GROUP).withColumn("start", F.lit(1)))
    for start, view in views.items():
        sums = view.groupBy(*GROUP).agg(*_moments()).join(mads, GROUP)
        cov = {(i, j): F.col(f"q_{i}{j}") / F.col("n") - F.col(f"s_{X[i]}") * F.col(f"s_{X[j]}") / F.col("n") / F.col("n") for i, j in PAIRS}
        # correlations of the view, a feature without spread being alone, under the scale of the median deviations
        corr = {(i, j): F.coalesce(F.try_divide(cov[i, j], F.sqrt(cov[i, i] * cov[j, j])), F.lit(0.0)) * 0.99 for i, j in PAIRS if i != j}
        scatter = [(corr[i, j] * sd(i) * sd(j) if i != j else F.pow(sd(i), F.lit(2.0)) - F.lit(FLOOR[i])).alias(f"c_{i}{j}") for i, j in PAIRS]
        out = out.unionByName(_cholesky(sums.select(*GROUP, *[f"m_{i}" for i in range(D)], *scatter), GROUP).withColumn("start", F.lit(start)))
    return out


def _concentrate(own: DataFrame, state: DataFrame, h: float) -> DataFrame:
    """One step: estimates from the share ``h`` of each group's rows nearest to the estimates of each start."""
    keys = [*GROUP, "start"]
    packed = state.groupBy(*GROUP).agg(F.collect_list(F.struct(*[c for c in state.columns if c not in (*GROUP, "logdet")])).alias("_s"))
    each = meet_groups(own, packed, GROUP).select(*GROUP, *X, F.explode("_s").alias("_s")).select(*GROUP, *X, "_s.*")
    bin_of = F.floor(PER_OCTAVE * F.log2(F.greatest(F.lit(2.0**LOW), F.least(F.lit(2.0**HIGH), F.col("d2"))))).cast("int")
    bins = _distance(each).withColumn("bin", bin_of).groupBy(*keys, "bin").agg(*_moments())
    upto = Window.partitionBy(*keys).orderBy("bin")
    bins = bins.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy(*keys)))
    part = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.lit(h) * F.col("all") - (F.col("upto") - F.col("n"))) / F.col("n")))
    kept = bins.withColumn("part", part).where("part > 0")
    sums = kept.groupBy(*keys).agg(*[F.sum(F.col("part") * F.col(c)).alias(c) for c in ("n", *[f"s_{x}" for x in X], *[f"q_{i}{j}" for i, j in PAIRS])])
    return _estimate(sums, keys)


def determinant_search(own: DataFrame, h: float = H) -> DataFrame:
    """``(group, m_i, l_ij)``: the estimates of ``own (group, x0..)`` with the smallest determinant, not yet made consistent."""
    keys = [*GROUP, "start"]
    state = materialize(_starts(own), "estimates")
    for _ in range(FIRST):
        state = materialize(_concentrate(own, state, h), "estimates", state)
    best = state.groupBy(*GROUP).agg(F.min(F.struct("logdet", "start"))["start"].alias("start"))
    state = materialize(state.join(best, keys, "left_semi"), "estimates", state)
    for _ in range(STEPS):
        new = _concentrate(own, state.drop("was"), h).join(state.select(*keys, F.col("logdet").alias("was")), keys)
        seen = Observation()
        state = materialize(new.observe(seen, F.count_if(F.abs(F.col("was") - F.col("logdet")) > SETTLED).alias("moved")), "estimates", state)
        if not seen.get["moved"]:
            break
    return state.drop("was", "start", "logdet")


def outlier_distance(rows: DataFrame, h: float = H, min_group: int = MIN_GROUP) -> DataFrame:
    """``rows (lang_key, source_key, salt, x0..)`` with ``d2``, the squared robust distance within their group."""
    keys = ["lang_key", "source_key"]
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    by_lang = sizes.groupBy("lang_key").agg(F.sum("n").alias("n_lang"))
    # a row's group: its own, the small ones of its language, or those of small languages
    level = sizes.join(by_lang, "lang_key").select(
        *keys,
        F.when((F.col("n") >= min_group) | (F.col("n_lang") >= min_group), F.col("lang_key")).otherwise(F.lit("*")).alias("g_lang"),
        F.when(F.col("n") >= min_group, F.col("source_key")).otherwise(F.lit("*")).alias("g_source"),
    )
    own = materialize(meet_groups(rows, materialize(level, "levels"), keys), "vectors")
    core = materialize(_scaled(determinant_search(own, h), consistency(h)), "core")
    near = _distance(meet_groups(own, core, GROUP)).where(F.col("d2") <= chi_quantile(REWEIGHT))
    final = materialize(_estimate(near.groupBy(*GROUP).agg(*_moments()), GROUP, consistency(REWEIGHT)).drop("logdet"), "final")
    # a group none of whose rows is near keeps the core's estimates
    final = final.unionByName(core.join(final.select(*GROUP), GROUP, "left_anti"))
    return _distance(meet_groups(own, materialize(final, "final"), GROUP))


def _scaled(state: DataFrame, factor: float) -> DataFrame:
    """The scatter times ``factor``."""
    return state.select(*GROUP, *[f"m_{i}" for i in range(D)], *[(F.col(f"l_{i}{j}") * math.sqrt(factor)).alias(f"l_{i}{j}") for i, j in PAIRS])


def judge(docs: DataFrame, tail: float = TAIL, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", id_col: str = "doc_id", **how) -> DataFrame:
    """Per row: id, statistics, ``base_failed``, ``d2``, ``kept``.

    A null text counts as empty and fails the base rules. Null languages and
    sources are groups of their own. Rows that fail the base rules take no part
    in the estimates. Equal rows get equal verdicts. Other columns are ignored.
    """
    key = lambda c, p: F.coalesce(F.concat(F.lit(p), F.col(c)), F.lit("-"))
    own = docs.select(F.col(id_col).alias("_id"), key(lang_col, "l").alias("lang_key"), key(source_col, "s").alias("source_key"), F.col(text_col).alias("_text"))
    own = statistics(own, "_text")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    own = own.withColumn("base_failed", failed).withColumn("salt", F.pmod(F.xxhash64("_id", "n_words", "word_chars"), F.lit(SALT)).cast("int"))
    own = own.select("*", *[f.alias(x) for f, x in zip(features(), X, strict=True)])
    own = materialize(own, "statistics")
    scored = outlier_distance(own.where("not base_failed"), **how)
    out = ["_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    good = scored.select(*out, "d2", (F.col("d2") <= chi_quantile(1 - tail)).alias("kept"))
    bad = own.where("base_failed").select(*out, F.lit(None).cast("double").alias("d2"), F.lit(False).alias("kept"))
    return good.unionByName(bad).withColumnRenamed("_id", id_col)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir))
