"""Dense linear algebra on sample graphs: spectra, embeddings, clusterings, fusion, principal components.

These work on n x n matrices of samples. A matrix is gathered as edges into one
numpy array, behind a check of n (``max_samples``): 4,000 samples are 128 MB.
Features are never gathered: their covariance is summed in blocks of rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathework.operators.components import krylov
from lathework.operators.records import sweep_records

MAX_SAMPLES = 4_000


def gather(edges: DataFrame, value: str = "w", max_samples: int = MAX_SAMPLES) -> tuple[list, np.ndarray]:
    """Ids in order and the dense matrix of an edge list; an error beyond ``max_samples``."""
    n = edges.select("i").distinct().count()
    if n > max_samples:
        raise ValueError(f"{n} samples; dense methods take {max_samples} at most")
    own = edges.select("i", "j", F.col(value).alias("w")).toArrow().to_pandas()
    ids = sorted(set(own["i"]) | set(own["j"]))
    at = {x: k for k, x in enumerate(ids)}
    out = np.zeros((len(ids), len(ids)))
    out[own["i"].map(at).to_numpy(), own["j"].map(at).to_numpy()] = own["w"].to_numpy()
    return ids, out


def to_edges(spark: SparkSession, ids: list, matrix: np.ndarray) -> DataFrame:
    n = len(ids)
    i, j = np.meshgrid(np.arange(n), np.arange(n), indexing="ij")
    keep = i != j
    ids = np.array(ids)
    return spark.createDataFrame(pd.DataFrame({"i": ids[i[keep]], "j": ids[j[keep]], "w": matrix[keep]}))


def fix_signs(vectors: np.ndarray) -> np.ndarray:
    """Each column's largest coordinate (the first of equals) made positive."""
    at = np.abs(np.round(vectors, 9)).argmax(axis=0)
    sign = np.sign(vectors[at, np.arange(vectors.shape[1])])
    return vectors * np.where(sign == 0, 1, sign)


def normalised(w: np.ndarray) -> np.ndarray:
    d = np.maximum(w.sum(axis=1), 1e-10)
    s = 1 / np.sqrt(d)
    return w * s[:, None] * s[None, :]


def spectrum(w: np.ndarray) -> np.ndarray:
    """Eigenvalues of the normalised Laplacian, ascending."""
    return np.linalg.eigvalsh(np.eye(len(w)) - normalised(w))


def eigengap(values: np.ndarray, most: int = 10) -> int:
    """The number of groups, 2 to ``most + 1``, after which the next eigenvalue is farthest."""
    gaps = np.diff(values[1 : most + 2])
    return 2 + int(np.argmax(np.round(gaps, 12))) if len(gaps) else 1


def embed(w: np.ndarray, dims: int = 50) -> np.ndarray:
    """Leading eigenvectors after the trivial one, scaled back by degree, signs fixed."""
    d = np.maximum(w.sum(axis=1), 1e-10)
    values, vectors = np.linalg.eigh(np.eye(len(w)) - normalised(w))
    return fix_signs(vectors[:, 1 : dims + 1] / np.sqrt(d)[:, None])


def k_means(x: np.ndarray, k: int, seed: int = 0, starts: int = 10, steps: int = 300) -> np.ndarray:
    """Lloyd's algorithm from k-means++ starts; labels numbered by first appearance."""
    r = np.random.default_rng(seed)
    best, least = None, np.inf
    for _ in range(starts):
        centres = [x[r.integers(len(x))]]
        for _ in range(1, k):
            d = np.min([((x - c) ** 2).sum(axis=1) for c in centres], axis=0)
            centres.append(x[r.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[r.integers(len(x))])
        c = np.array(centres)
        labels = None
        for _ in range(steps):
            d = ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
            new = d.argmin(axis=1)
            if labels is not None and (new == labels).all():
                break
            labels = new
            c = np.array([x[labels == q].mean(axis=0) if (labels == q).any() else c[q] for q in range(k)])
        cost = d[np.arange(len(x)), labels].sum()
        if cost < least - 1e-12:
            best, least = labels, cost
    _, first, inverse = np.unique(best, return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[inverse]


def spectral_labels(w: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """k-means on the first ``k`` eigenvectors, the trivial one included, scaled back by degree."""
    return k_means(first_vectors(w, k), k, seed)


def first_vectors(w: np.ndarray, k: int) -> np.ndarray:
    d = np.maximum(w.sum(axis=1), 1e-10)
    _, vectors = np.linalg.eigh(np.eye(len(w)) - normalised(w))
    return fix_signs(vectors[:, :k] / np.sqrt(d)[:, None])


def silhouette_scores(w: np.ndarray, labels: np.ndarray, k: int) -> float:
    """Mean silhouette in the row-normalised space of the top ``k`` scaled singular vectors."""
    u, s, _ = np.linalg.svd(normalised(w))
    x = u[:, :k] * s[:k]
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x = x / np.where(norm == 0, 1, norm)
    d = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * x @ x.T, 0))
    groups = np.unique(labels)
    sums = np.stack([d[:, labels == g].sum(axis=1) for g in groups], axis=1)
    sizes = np.array([(labels == g).sum() for g in groups])
    own = np.searchsorted(groups, labels)
    a = sums[np.arange(len(x)), own] / np.maximum(sizes[own] - 1, 1)
    other = sums / sizes
    other[np.arange(len(x)), own] = np.inf
    b = other.min(axis=1)
    return float(np.where(sizes[own] == 1, 0, (b - a) / np.maximum(np.maximum(a, b), 1e-300)).mean())


def fuse(matrices: list[np.ndarray], k: int = 20, steps: int = 20, boost: float = 0.0) -> np.ndarray:
    """Similarity network fusion by cross-diffusion; ``boost`` is added to the diagonal after each step."""
    def dense(w):
        off = w.sum(axis=1, keepdims=True) - np.diag(w)[:, None]
        p = w / np.where(off == 0, 1, 2 * off)
        np.fill_diagonal(p, 0.5)
        return p

    def local(w):
        out = np.zeros_like(w)
        order = np.lexsort((np.broadcast_to(np.arange(len(w)), w.shape), -np.round(w, 9)))[:, :k]
        rows = np.arange(len(w))[:, None]
        out[rows, order] = w[rows, order]
        total = out.sum(axis=1, keepdims=True)
        return out / np.where(total == 0, 1, total)

    p, s = [dense(w) for w in matrices], [local(w) for w in matrices]
    for _ in range(steps):
        total = sum(p)
        # each modality's network spreads the mean of the others
        p = [a @ ((total - b) / max(1, len(p) - 1)) @ a.T for a, b in zip(s, p, strict=True)]
        p = [(q + q.T) / 2 + boost * np.eye(len(q)) for q in p]
    out = sum(p) / len(p)
    return (out + out.T) / 2


def covariance(vectors: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean, covariance and count of ``vec`` by summing outer products per task: d x d numbers each."""

    def sums(batches):
        total, outer, n = np.zeros(dims), np.zeros((dims, dims)), 0
        for batch in batches:
            x = np.array(batch["vec"].tolist(), float)
            if len(x):
                total += x.sum(axis=0)
                outer += x.T @ x
                n += len(x)
        yield pd.DataFrame({"k": np.arange(dims + 1), "row": [*outer.tolist(), [*total.tolist()]], "n": n})

    found = vectors.select("vec").mapInPandas(sums, "k int, row array<double>, n long").groupBy("k", F.size("row").alias("size"), F.lit(0).alias("z"))
    summed = found.agg(F.sum("n").alias("n"), *[F.sum(F.element_at("row", q + 1)).alias(f"c{q}") for q in range(dims)]).toPandas().sort_values("k")
    values = summed[[f"c{q}" for q in range(dims)]].to_numpy()
    n = int(summed["n"].iloc[0])
    mean = values[dims] / max(n, 1)
    return mean, values[:dims] / max(n, 1) - np.outer(mean, mean), n


#: Features beyond which components come from a block Krylov iteration instead of the features' covariance.
WIDE = 1_024


def principal_components(vectors: DataFrame, dims: int, components: int = 10) -> tuple[DataFrame, np.ndarray]:
    """``(id, pc array)`` of the centred vectors and the explained variance ratios; signs fixed.

    In up to ``WIDE`` features each axis' largest coordinate is made positive, beyond each component's largest score.
    """
    if dims > WIDE:
        found = krylov(vectors, dims, components)
        return found.scores, found.ratio
    mean, cov, n = covariance(vectors, dims)
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][:components]
    axes = fix_signs(axes[:, order])
    ratio = values[order] / max(values.sum(), 1e-300)

    def project(batches):
        for batch in batches:
            x = np.array(batch["vec"].tolist(), float)
            yield pd.DataFrame({"id": batch["id"], "pc": ((x - mean) @ axes).tolist() if len(x) else []})

    kind = vectors.schema["id"].dataType.simpleString()
    return vectors.select("id", "vec").mapInPandas(project, f"id {kind}, pc array<double>"), ratio


def shrink(n: np.ndarray, gamma: np.ndarray, delta: np.ndarray, prior: tuple[float, float, float, float], tolerance: float = 1e-8, steps: int = 1_000) -> tuple[np.ndarray, np.ndarray]:
    """Empirical-Bayes location and scale of standardised features in a batch, each iterated by itself until it settles.

    ``n`` samples with mean ``gamma`` and sample variance ``delta``; ``prior`` is
    the mean and variance of the locations and of the scales over all features.
    """
    g_bar, t2, m, s2 = prior
    t2, s2 = max(t2, 1e-12), max(s2, 1e-12)
    a, b = (2 * s2 + m * m) / s2, (m * s2 + m**3) / s2
    star, scale = gamma.copy(), np.where(delta == 0, 1.0, delta)
    active = np.ones(len(n), bool)
    for _ in range(steps):
        k, g, q = n[active], gamma[active], scale[active]
        new = (k * t2 * g + q * g_bar) / (k * t2 + q)
        squares = (k - 1) * delta[active] + k * (g - new) ** 2
        spread = (b + 0.5 * squares) / (k / 2 + a - 1)
        moved = np.maximum(np.abs(new - star[active]) / np.maximum(np.abs(star[active]), 1e-12), np.abs(spread - q) / q)
        star[active], scale[active] = new, spread
        active[np.flatnonzero(active)] = moved >= tolerance
        if not active.any():
            return star, scale
    raise RuntimeError(f"{active.sum()} features have not settled in {steps} steps")


def combat(long: DataFrame, batches: DataFrame) -> DataFrame:
    """``(sample_id, feature_id, value)`` adjusted for ``batches (sample_id, batch)`` by empirical Bayes.

    Moments per feature and batch are aggregates; priors are taken over all
    features of a batch, a row per batch; each feature's shrunken location and
    scale follow from its own moments and the priors. If any batch has one sample
    only, means are adjusted and scales are not. The frame must be dense.
    """
    single = not batches.groupBy("batch").count().where("count = 1").isEmpty()
    own = long.join(batches, "sample_id")
    cells = own.groupBy("feature_id", "batch").agg(F.count("*").cast("double").alias("n"), F.avg("value").alias("mean"), F.coalesce(F.var_samp("value"), F.lit(0.0)).alias("var"))
    whole = cells.groupBy("feature_id").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"), F.sqrt(F.sum((F.col("n") - 1) * F.col("var")) / F.sum("n")).alias("sd"))
    whole = whole.withColumn("sd", F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd")))
    scaled = cells.join(whole, "feature_id").select("feature_id", "batch", "n", "grand", "sd", ((F.col("mean") - F.col("grand")) / F.col("sd")).alias("gamma"), (F.col("var") / F.col("sd") / F.col("sd")).alias("delta"))
    none = lambda c: F.coalesce(c, F.lit(0.0))
    prior = scaled.groupBy("batch").agg(F.avg("gamma").alias("g_bar"), none(F.var_samp("gamma")).alias("t2"), F.avg("delta").alias("m"), none(F.var_samp("delta")).alias("s2"))
    if single:
        t2 = F.greatest(F.col("t2"), F.lit(1e-12))
        star = scaled.join(prior, "batch").withColumn("star", (F.col("n") * t2 * F.col("gamma") + F.col("g_bar")) / (F.col("n") * t2 + 1)).withColumn("scale", F.lit(1.0))
    else:

        def work(parts):
            for part in parts:
                out = part[["feature_id", "batch", "grand", "sd"]].assign(star=0.0, scale=1.0)
                for _, rows in part.reset_index(drop=True).groupby("batch"):
                    first = rows.iloc[0]
                    found = shrink(rows["n"].to_numpy(), rows["gamma"].to_numpy(), rows["delta"].to_numpy(), (first["g_bar"], first["t2"], first["m"], first["s2"]))
                    out.iloc[rows.index, out.columns.get_loc("star")], out.iloc[rows.index, out.columns.get_loc("scale")] = found
                yield out

        kinds = {f.name: f.dataType.simpleString() for f in scaled.schema.fields}
        star = scaled.join(prior, "batch").mapInPandas(work, f"feature_id {kinds['feature_id']}, batch {kinds['batch']}, grand double, sd double, star double, scale double")
    z = (F.col("value") - F.col("grand")) / F.col("sd")
    done = (z - F.col("star")) / F.sqrt("scale") * F.col("sd") + F.col("grand")
    return own.join(star.select("feature_id", "batch", "grand", "sd", "star", "scale"), ["feature_id", "batch"]).select("sample_id", "feature_id", done.alias("value"))


def mean_shift(long: DataFrame, batches: DataFrame) -> DataFrame:
    """The plain adjustment: each batch's feature means are moved to the feature's mean. SQL operations only."""
    own = long.join(batches, "sample_id")
    by = own.groupBy("feature_id", "batch").agg(F.avg("value").alias("bm"))
    whole = own.groupBy("feature_id").agg(F.avg("value").alias("fm"))
    return own.join(by, ["feature_id", "batch"]).join(whole, "feature_id").select("sample_id", "feature_id", (F.col("value") - F.col("bm") + F.col("fm")).alias("value"))


def kernel_matrix(x: np.ndarray, k: int = 20, mu: float = 0.5, metric: str = "sqeuclidean") -> np.ndarray:
    """The locally scaled kernel as a dense matrix, zero on the diagonal."""
    from lathework.operators.graph import TINY, _matrix

    d = _matrix(x, x, metric)
    far = d.copy()
    np.fill_diagonal(far, np.inf)
    m = np.sort(far, axis=1)[:, :k].mean(axis=1)
    s = np.maximum(mu * (m[:, None] + m[None, :] + d) / 3, TINY)
    w = np.exp(-d / (2 * s))
    np.fill_diagonal(w, 0)
    return (w + w.T) / 2


def rand_index(a: np.ndarray, b: np.ndarray) -> float:
    n = pd.crosstab(a, b).to_numpy().astype(float)
    pairs = lambda v: (v * (v - 1) / 2).sum()
    rows, columns, total = pairs(n.sum(axis=1)), pairs(n.sum(axis=0)), n.sum() * (n.sum() - 1) / 2
    expected, most = rows * columns / max(total, 1), (rows + columns) / 2
    return 1.0 if most == expected else float((pairs(n) - expected) / (most - expected))


def shared_information(a: np.ndarray, b: np.ndarray) -> float:
    """Mutual information over the mean of the two entropies; one where both are zero."""
    n = pd.crosstab(a, b).to_numpy().astype(float) / len(a)
    h = lambda p: -(p[p > 0] * np.log(p[p > 0])).sum()
    ha, hb = h(n.sum(axis=1)), h(n.sum(axis=0))
    return 1.0 if ha + hb <= 1e-15 else float(2 * (ha + hb - h(n.ravel())) / (ha + hb))


def group_survival_p(labels: np.ndarray, time: np.ndarray, event: np.ndarray) -> float:
    """p of the log-rank test between labels; samples without a time are left out, NaN without two groups or an event."""
    from lathework.operators.tests import chi2_tail

    known = ~np.isnan(time)
    labels, time, event = labels[known], time[known], event[known].astype(bool)
    names = np.unique(labels)
    if len(names) < 2 or not event.any():
        return float("nan")
    at = np.unique(time[event])
    n = np.stack([(np.sort(time[labels == g])[:, None] >= at[None, :]).sum(axis=0) for g in names]).astype(float)
    d = np.stack([((time[:, None] == at[None, :]) & (event & (labels == g))[:, None]).sum(axis=0) for g in names]).astype(float)
    total, died = n.sum(axis=0), d.sum(axis=0)
    u = (d - died * n / total).sum(axis=1)[:-1]
    factor = np.where(total > 1, died * (total - died) / np.maximum(total - 1, 1), 0)
    share = n / total
    v = np.diag((factor * share).sum(axis=1)) - (factor * share) @ share.T
    return chi2_tail(float(u @ np.linalg.pinv(v[:-1, :-1]) @ u), len(u))


def clustering_record(w: np.ndarray, k: int, reference: np.ndarray, seeds: int = 10, survival: tuple[np.ndarray, np.ndarray] | None = None) -> dict:
    """Sizes, silhouette, agreement with the reference and between seeds, and the log-rank p of the labels (NaN without ``survival (time, event)``)."""
    v = first_vectors(w, k)
    runs = [k_means(v, k, s) for s in range(seeds)]
    ari = [rand_index(runs[a], runs[b]) for a in range(seeds) for b in range(a + 1, seeds)]
    return {
        "k": k, "sizes": str([int((runs[0] == g).sum()) for g in range(k)]), "silhouette": silhouette_scores(w, runs[0], k), "ari": rand_index(runs[0], reference), "nmi": shared_information(runs[0], reference),
        "logrank_p": group_survival_p(runs[0], *survival) if survival else float("nan"), "stability_mean": float(np.mean(ari)), "stability_sd": float(np.std(ari)), "stable": bool(np.mean(ari) >= 0.8),
    }


def sweep(vectors: DataFrame, configs: list[tuple[int, int, str]], parts: list[tuple[int, int]], steps: int = 20, seeds: int = 10) -> DataFrame:
    """One row per distinct configuration ``(neighbours, dimensions, metric)``: fusion of the parts' kernels and its two-group record.

    ``vectors (id, vec, label, time, event)``; times may be null.

    Up to ``MAX_SAMPLES`` samples configurations run side by side and each task holds the samples' matrices;
    beyond, one after the other on tiles (``records.sweep_records``).
    """
    spark, kind = vectors.sparkSession, "config string, cluster_sizes string, " + ", ".join(f"{c} double" for c in _RECORD)
    if vectors.count() > MAX_SAMPLES:
        rows = sweep_records(vectors, configs, parts, steps, seeds)
        return spark.createDataFrame([(r["config"], r["sizes"], *[float(r[c]) for c in _RECORD]) for r in rows], kind)
    seen = spark.createDataFrame(sorted(set(configs)), "k int, dims int, metric string")
    each = vectors.crossJoin(F.broadcast(seen))

    def work(part: pd.DataFrame) -> pd.DataFrame:
        k, dims, metric = int(part["k"].iloc[0]), int(part["dims"].iloc[0]), part["metric"].iloc[0]
        part = part.sort_values("id")
        x = np.array(part["vec"].tolist(), float)
        use = np.sort(np.argsort(-np.round(np.median(np.abs(x - np.median(x, axis=0)), axis=0), 12), kind="stable")[:dims])
        kernels = [kernel_matrix(x[:, own], k, metric=metric) for a, b in parts if len(own := use[(use >= a) & (use < b)])]
        survival = part["time"].to_numpy(float), part["event"].eq(True).to_numpy(bool)
        fused = np.maximum(fuse(kernels, k, steps), 0)
        np.fill_diagonal(fused, 0)
        record = clustering_record((fused + fused.T) / 2, 2, part["label"].to_numpy(), seeds, survival)
        return pd.DataFrame([{"config": f"K={k} · {dims}feat · {metric}", "cluster_sizes": record["sizes"], **{c: record[c] for c in _RECORD}}])

    return each.groupBy("k", "dims", "metric").applyInPandas(work, kind)


_RECORD = ("ari", "nmi", "silhouette", "stability_mean", "stability_sd", "logrank_p")
