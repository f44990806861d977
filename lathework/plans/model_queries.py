"""Queries on spectra, clusterings, batch effects and survival models. Iterative: checked by tests rather than SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lathework.frames import global_rank
from lathework.functions.columns import r6
from lathework.operators import clusters
from lathework.operators import cox as C
from lathework.operators import graph as G
from lathework.operators import lanczos as Z
from lathework.operators import matrix as M
from lathework.operators import relate as R
from lathework.operators import spectral as L
from lathework.operators import survival as S
from lathework.operators import tiles
from lathework.operators.records import records
from lathework.operators.components import fits, krylov, of_cells
from lathework.operators.cox_frame import fit_frame
from lathework.operators.dense_spectrum import kernel_spectrum
from lathework.plans.base import COUNTS, Registry, counts, patients, r, rounded, vectors
from lathework.plans.graph_queries import KERNELS, slices, spread, transition
from lathework.plans.matrix_queries import zscore_sql
from lathework.plans.survival_queries import folds
from lathework.session import materialize, table

query = Registry()
PARTS = [(0, 21), (21, 42), (42, 64)]


def _graph(spark, d):
    return L.gather(G.affinity(G.pair_distances(vectors(spark, d))))


def _samples(spark, d):
    """Vectors with the survival of the patient of the same number, if there is one."""
    return vectors(spark, d).join(patients(spark, d).select(F.col("pid").alias("id"), "time", "event"), "id", "left")


def _known(spark, d, ids):
    """Labels and survival in the order of ``ids``: as many rows as the dense graph has."""
    own = _samples(spark, d).select("id", "label", "time", "event").toPandas().set_index("id").loc[ids]
    return own["label"].to_numpy(), (own["time"].to_numpy(float), own["event"].eq(True).to_numpy(bool))


def _dense(vectors) -> bool:
    """Whether the graph of all pairs is small enough for a dense matrix; beyond, eigenpairs come from passes over the pairs."""
    return vectors.count() <= L.MAX_SAMPLES


@query("laplacian_spectrum")
def laplacian_spectrum(spark, d):
    """All eigenvalues; beyond the dense bound the matrix is a table of panels."""
    own = vectors(spark, d)
    if not _dense(own):
        return kernel_spectrum(G.Kernel(own))
    _, w = _graph(spark, d)
    return spark.createDataFrame(pd.DataFrame({"idx": np.arange(len(w)), "value": L.spectrum(w)}))


@query("eigengap_k")
def eigengap_k(spark, d):
    own = vectors(spark, d)
    values = L.spectrum(_graph(spark, d)[1]) if _dense(own) else Z.kernel_pairs(G.Kernel(own), 12, Z.KERNEL_SETTLED)[0].values
    return spark.createDataFrame([(L.eigengap(values), float(values[0]))], "k int, smallest double")


@query("spectral_embedding")
def spectral_embedding(spark, d):
    own = vectors(spark, d)
    if not _dense(own):
        return Z.kernel_vectors(G.Kernel(own), 50, first=False)
    ids, w = _graph(spark, d)
    return spark.createDataFrame(pd.DataFrame({"id": ids, "vec": L.embed(w, 50).tolist()}))


@query("spectral_clustering")
def spectral_clustering(spark, d):
    own = vectors(spark, d)
    if not _dense(own):
        ks = range(2, 7)
        found = clusters.k_means_runs(materialize(Z.kernel_vectors(G.Kernel(own), 6), "vectors"), [(k, 0) for k in ks])  # shared passes
        return found.select("id", *[F.get("labels", F.lit(at)).alias(f"cluster_k{k}") for at, k in enumerate(ks)])
    ids, w = _graph(spark, d)
    return spark.createDataFrame(pd.DataFrame({"id": ids} | {f"cluster_k{k}": L.spectral_labels(w, k) for k in range(2, 7)}))


def _sparse(spark, d):
    """The graph of each sample's 20 nearest; nothing of it reaches the driver."""
    return materialize(Z.neighbour_graph(vectors(spark, d), 20), "graph")


@query("sparse_spectrum")
def sparse_spectrum(spark, d):
    """The 12 lowest eigenvalues of the neighbour graph's Laplacian, whether each has settled, and the gap to the next."""
    found = Z.lowest_pairs(_sparse(spark, d), 13)  # the last one for the twelfth's gap
    values = np.round(found.values, 6) + 0.0
    gaps = [float(np.round(g, 6)) + 0.0 for g in np.diff(values)] + [None]
    rows = [(k, float(v), bool(r <= Z.SETTLED), g) for k, (v, r, g) in enumerate(zip(values, found.residuals, gaps, strict=True))]
    return spark.createDataFrame(rows[:12], "idx int, value double, settled boolean, gap double")


@query("sparse_embedding")
def sparse_embedding(spark, d):
    return Z.embedding(_sparse(spark, d), 8)


@query("sparse_clustering")
def sparse_clustering(spark, d):
    """Three groups of the neighbour graph: its embedding, clustered by sums; nothing per sample reaches the driver."""
    vec = materialize(Z.embedding(_sparse(spark, d), 3), "embedding")
    return clusters.k_means(vec, 3)[0]


@query("k_selection")
def k_selection(spark, d):
    """A record for each k; the first k with the largest silhouette is primary."""
    own = vectors(spark, d)
    if not _dense(own):
        rows = pd.DataFrame(records(*Z.both_vectors(G.Kernel(own), 6), _samples(spark, d), range(2, 7), 10))
        rows["primary"] = np.arange(len(rows)) == int(np.argmax(np.round(rows["silhouette"], 12)))
        return spark.createDataFrame(rows)
    ids, w = _graph(spark, d)
    ref, times = _known(spark, d, ids)
    out = pd.DataFrame([L.clustering_record(w, k, ref, 10, times) for k in range(2, 7)])
    out["primary"] = np.arange(len(out)) == int(np.argmax(np.round(out["silhouette"], 12)))
    return spark.createDataFrame(out)


def _fusion(steps: int) -> str:
    """All steps of the fusion, a matrix of each modality after each."""
    parts = [f"w{q} as materialized {w}, s{q} as materialized {spread(f'w{q}')}, p{q}_0 as materialized {transition(f'w{q}')}" for q, w in enumerate(KERNELS)]
    for k in range(steps):
        for q in range(3):
            a, b = (x for x in range(3) if x != q)
            parts.append(f"q{q}_{k} as materialized (select a.i, a.j, (a.p + b.p) / 2 as p from p{a}_{k} a join p{b}_{k} b on a.i = b.i and a.j = b.j)")
            parts.append(f"t{q}_{k} as materialized (select s.i, q.j, sum(s.s * q.p) as p from s{q} s join q{q}_{k} q on s.j = q.i group by 1, 2)")
            parts.append(f"u{q}_{k} as materialized (select t.i, s.i as j, sum(t.p * s.s) as p from t{q}_{k} t join s{q} s on t.j = s.j group by 1, 2)")
            parts.append(f"p{q}_{k + 1} as materialized (select a.i, a.j, (a.p + b.p) / 2 as p from u{q}_{k} a join u{q}_{k} b on a.i = b.j and a.j = b.i)")
    return f"with {', '.join(parts)} select x.i, x.j, {r('(x.p + y.p + z.p) / 3')} as w from p0_{steps} x join p1_{steps} y on x.i = y.i and x.j = y.j join p2_{steps} z on x.i = z.i and x.j = z.j where x.i <> x.j"


@query("network_fusion", _fusion(20))
def network_fusion(spark, d):
    """Three modalities, 20 neighbours, 20 steps; no matrix is whole in a task or on the driver."""
    return rounded(tiles.fuse(slices(spark, d), 20, 20), "w")


@query("early_integration")
def early_integration(spark, d):
    """Features side by side, principal components, kernel, two groups."""
    own, _ = L.principal_components(vectors(spark, d), 64, 50)
    if not _dense(own):
        return clusters.k_means(Z.kernel_vectors(G.Kernel(own.withColumnRenamed("pc", "vec")), 2), 2)[0]
    ids, w = L.gather(G.affinity(G.pair_distances(own.withColumnRenamed("pc", "vec"))))
    return spark.createDataFrame(pd.DataFrame({"id": ids, "label": L.spectral_labels(w, 2)}))


@query("pca_scores")
def pca_scores(spark, d):
    return L.principal_components(vectors(spark, d), 64, 10)[0]


@query("explained_variance")
def explained_variance(spark, d):
    _, ratio = L.principal_components(vectors(spark, d), 64, 10)
    return spark.createDataFrame(pd.DataFrame({"component": np.arange(1, len(ratio) + 1), "ratio": ratio, "cumulative": np.cumsum(ratio)}))


@query("wide_components")
def wide_components(spark, d):
    """Twenty components of suppliers over all parts: by a Krylov iteration on parts, or on suppliers where parts are too many for a basis."""
    long = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("sample_id"), F.col("l_partkey").alias("feature_id")).agg(F.log2(F.sum("l_quantity") + 1).alias("value"))
    dims = long.agg(F.max("feature_id")).first()[0] + 1
    own = materialize(M.to_cells(long).withColumnRenamed("sample_id", "id"), "wide")
    found = krylov(own, dims, 20) if fits(own.count(), dims, 20) else of_cells(own, 20)
    return found.scores.select("id", F.transform("pc", r6).alias("pc"))


@query("batch_check")
def batch_check(spark, d):
    """Principal components, the variance between batches, and the status at its thresholds."""
    scores, _ = L.principal_components(vectors(spark, d), 64, 10)
    wide = scores.select((F.col("id") % 7).alias("site"), *[F.element_at("pc", q + 1).alias(f"pc{q}") for q in range(10)])
    from lathework.functions.columns import threshold_status

    eta = R.eta_squared(wide, "site", [f"pc{q}" for q in range(10)]).agg(F.avg("eta2").alias("eta2"), F.avg("omega2").alias("omega2"))
    return eta.select(r6("eta2").alias("eta2"), r6("omega2").alias("omega2"), threshold_status(F.col("eta2"), names=("OK", "WARN", "CORRECT")).alias("status"))


def _batches(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("sample_id"), (F.col("s_nationkey") % 5).alias("batch"))


_SITES = "(select s_suppkey as sample_id, s_nationkey % 5 as batch from supplier)"
_DENSE = f"(select s.sample_id, f.feature_id, coalesce(value, 0.0) as value from (select distinct sample_id from {COUNTS}) s cross join (select distinct feature_id from {COUNTS}) f left join {COUNTS} c on c.sample_id = s.sample_id and c.feature_id = f.feature_id)"
#: The same by aggregates and a recursion of 200 steps; on the smallest tables a batch has one sample, and means alone are shrunk.
_COMBAT = f"""(with recursive own as materialized (select z.*, batch from {zscore_sql(_DENSE)} z join {_SITES} using (sample_id)), single as (select bool_or(n = 1) as single from (select count(*) as n from {_SITES} group by batch)),
 cells as materialized (select feature_id, batch, count(*)::double as n, avg(value) as mean, coalesce(var_samp(value), 0.0) as var from own group by 1, 2),
 whole as (select feature_id, grand, case when sd = 0 then 1.0 else sd end as sd from (select feature_id, sum(n * mean) / sum(n) as grand, sqrt(sum((n - 1) * var) / sum(n)) as sd from cells group by 1)),
 scaled as materialized (select feature_id, batch, n, grand, sd, (mean - grand) / sd as gamma, var / sd / sd as delta from cells join whole using (feature_id)),
 prior as (select batch, avg(gamma) as g_bar, greatest(coalesce(var_samp(gamma), 0.0), 1e-12) as t2, avg(delta) as m, greatest(coalesce(var_samp(delta), 0.0), 1e-12) as s2 from scaled group by 1),
 start as materialized (select s.*, g_bar, t2, (2 * s2 + m * m) / s2 as a, (m * s2 + m * m * m) / s2 as b from scaled s join prior using (batch)),
 step as (select feature_id, batch, 0 as k, gamma as star, case when delta = 0 then 1.0 else delta end as scale, gamma, delta, n, g_bar, t2, a, b from start
  union all select feature_id, batch, k + 1, new, (b + 0.5 * ((n - 1) * delta + n * (gamma - new) * (gamma - new))) / (n / 2 + a - 1), gamma, delta, n, g_bar, t2, a, b from (select *, (n * t2 * gamma + scale * g_bar) / (n * t2 + scale) as new from step where k < 200)),
 eb as (select s.feature_id, s.batch, s.grand, s.sd, case when single then (s.n * s.t2 * s.gamma + s.g_bar) / (s.n * s.t2 + 1) else e.star end as star, case when single then 1.0 else e.scale end as scale from start s join step e on e.feature_id = s.feature_id and e.batch = s.batch and e.k = 200, single)
 select sample_id, feature_id, ((value - grand) / sd - star) / sqrt(scale) * sd + grand as value from own join eb using (feature_id, batch))"""


@query("combat", f"select sample_id, feature_id, {r('value')} as value from {_COMBAT}")
def combat(spark, d):
    return rounded(L.combat(M.zscore(M.densify(counts(spark, d), 0.0)), _batches(spark, d)), "value")


_BATCHED = f"(select c.*, s_nationkey % 5 as batch from {COUNTS} c join supplier on s_suppkey = sample_id)"


@query("batch_mean_shift", f"select sample_id, feature_id, {r('value - avg(value) over (partition by feature_id, batch) + avg(value) over (partition by feature_id)')} as value from {_BATCHED}")
def batch_mean_shift(spark, d):
    return rounded(L.mean_shift(counts(spark, d), _batches(spark, d)), "value")


@query("parameter_sweep")
def parameter_sweep(spark, d):
    """One at a time around the reference configuration; repeated configurations once."""
    base = (20, 64, "sqeuclidean")
    configs = [base, *[(k, *base[1:]) for k in (10, 15, 20, 25)], *[(base[0], n, base[2]) for n in (32, 64)], *[(*base[:2], m) for m in ("sqeuclidean", "cosine")]]
    return L.sweep(_samples(spark, d), configs, PARTS)


# survival models ---------------------------------------------------------------------------------------------------


def cohort(spark, d):
    """Each patient under two feature sets: orders and account."""
    own = patients(spark, d).select(F.col("pid").alias("id"), "time", "event", "risk", "site", "stage")
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").cast("double").alias("n"), F.avg("o_totalprice").alias("a"), F.max("o_totalprice").alias("b"), F.min("o_totalprice").alias("c"))
    both = own.join(o, "id")
    orders = both.select(F.lit("orders").alias("method"), "id", "time", "event", F.array("n", "a", "b", "c").alias("vec"))
    account = both.select(F.lit("account").alias("method"), "id", "time", "event", F.array("risk", *[(F.col("site") % 5 == k).cast("double") for k in range(4)], F.col("stage").cast("double")).alias("vec"))
    return orders, account


#: Of the five seeds the one whose out-of-fold risks are used.
PRIMARY_SEED = 2


def _folds(spark, d):
    return folds(spark, d).withColumnRenamed("pid", "id")


@query("cox_cross_validation")
def cox_cross_validation(spark, d):
    """Repeated cross-validation with tuned penalties: fold means and deviations per method, with the average of both methods' risks."""
    orders, account = cohort(spark, d)
    rows = orders.unionByName(account)
    oof = C.cross_validate(rows, _folds(spark, d)).drop("alpha")
    return C.summary(C.fold_scores(oof.unionByName(C.late_average(oof)), rows))


@query("cox_whole_cohort")
def cox_whole_cohort(spark, d):
    """Coefficients of one model of all patients, by risk sets over ranges of time; no task holds the cohort."""
    orders, _ = cohort(spark, d)
    b = fit_frame(orders, 0.1)
    return spark.createDataFrame([(k, float(np.round(v, 6)) + 0.0) for k, v in enumerate(b)], "feature int, coefficient double")


@query("cox_late_concat")
def cox_late_concat(spark, d):
    """Both feature sets side by side in one model."""
    orders, account = cohort(spark, d)
    rows = orders.join(account.select("id", F.col("vec").alias("v2")), "id").select(F.lit("late_concat").alias("method"), "id", "time", "event", F.concat("vec", "v2").alias("vec"))
    return C.summary(C.fold_scores(C.cross_validate(rows, _folds(spark, d)), rows))


@query("cox_covariate_adjusted")
def cox_covariate_adjusted(spark, d):
    """A feature set with covariates that have gaps, filled inside each fold."""
    orders, _ = cohort(spark, d)
    extra = patients(spark, d).select(F.col("pid").alias("id"), F.when(F.col("pid") % 5 > 0, F.col("risk")).alias("age"), F.when(F.col("pid") % 7 > 0, F.col("stage").cast("double")).alias("stage"))
    rows = orders.join(extra, "id").select(F.lit("adjusted").alias("method"), "id", "time", "event", F.concat("vec", F.array("age", "stage")).alias("vec"))
    return C.summary(C.fold_scores(C.cross_validate(rows, _folds(spark, d), impute=2), rows))


@query("cox_oof_bootstrap")
def cox_oof_bootstrap(spark, d):
    """Out-of-fold risks of one seed, their concordance and its interval, with the paired difference of two methods."""
    orders, account = cohort(spark, d)
    oof = C.cross_validate(orders.unionByName(account), _folds(spark, d).where(F.col("seed") == PRIMARY_SEED))
    wide = oof.groupBy("id").agg(*[F.max(F.when(F.col("method") == m, F.col("risk"))).alias(m) for m in ("orders", "account")])
    ranked = global_rank(wide.dropna().join(orders.select("id", "time", "event"), "id"), "id")
    boot = S.bootstrap_concordance(ranked, ["orders", "account"], 1_000)
    return S.interval(boot, "c_orders").select(F.lit("orders").alias("what"), "mean", "ci_lower", "ci_upper").unionByName(S.interval(boot, "c_account").select(F.lit("account").alias("what"), "mean", "ci_lower", "ci_upper")).unionByName(S.delta_interval(boot, "orders", "account").select(F.lit("orders - account").alias("what"), "mean", "ci_lower", "ci_upper"))


QUERIES, ORACLES = query.QUERIES, query.ORACLES
