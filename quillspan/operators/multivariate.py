"""Principal components, clustering and the stability of both.

Components come from moments that Spark sums (features are few, sessions many); the driver sees
only matrices of features by features. Clusterings are pyspark.ml's.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .inference import SEED, resampled, uniform

#: Rows of a block of the silhouette: the distances of two blocks are held at once.
BLOCK_ROWS = 2_000
#: Starts of a clustering, of which the best counts (fixed values).
STARTS = {"kmeans": 20, "gmm": 5}


def complete(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which all columns are present and finite."""
    for c in columns:
        df = df.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) != float("inf")))
    return df


def scaled(df: DataFrame, columns: list[str], how: str = "standard") -> DataFrame:
    """The columns scaled (standard: population deviation; robust: median and iqr), one aggregate for all; no spread: only centred."""
    if how == "standard":
        row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    else:
        q = df.agg(*[F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(c) for c in columns]).first()
        row = {f"m_{c}": q[c] and q[c][1] for c in columns} | {f"s_{c}": q[c] and q[c][2] - q[c][0] for c in columns}
    return df.withColumns({c: (F.col(c) - F.lit(row[f"m_{c}"])) / F.lit(row[f"s_{c}"] or 1.0) for c in columns})


def _moments(df: DataFrame, columns: list[str], weight: str | None = None, by: list[str] | None = None) -> list[Row]:
    w = F.col(weight) if weight else F.lit(1)
    sums = [F.sum(w).alias("n"), *[F.sum(F.col(c) * w).alias(f"s{i}") for i, c in enumerate(columns)]]
    sums += [F.sum(F.col(a) * F.col(b) * w).alias(f"p{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j]
    return df.groupBy(*(by or [])).agg(*sums).collect()  # a short row per group


def _components(row: Row, p: int, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Components (rows; the largest loading is positive) and their shares of the variance."""
    n = row["n"]
    mean = np.array([row[f"s{i}"] for i in range(p)]) / n
    cov = np.array([[row[f"p{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)]) / n - np.outer(mean, mean)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:keep]
    parts = vectors[:, order].T
    parts = parts * np.where(np.take_along_axis(parts, np.abs(parts).argmax(axis=1)[:, None], axis=1) < 0, -1, 1)
    total = max(float(np.trace(cov)), 1e-300)
    return parts, np.maximum(values[order], 0) / total


def fit_pca(df: DataFrame, columns: list[str], k: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Components and explained variance ratios of complete rows; an empty table has none."""
    row = _moments(complete(df, columns), columns)[0]
    return _components(row, len(columns), k) if row["n"] else (np.empty((0, len(columns))), np.empty(0))


def pca_tables(df: DataFrame, columns: list[str], id_col: str = "session_id", k: int = 4, how: str = "standard") -> dict[str, DataFrame]:
    """variance (component, explained and cumulative ratio), loadings (component, feature, loading, absolute_loading) and scores (PC1..)."""
    spark, x = df.sparkSession, scaled(complete(df, columns), columns, how)
    parts, ratio = fit_pca(x, columns, k)
    variance = [(how, i + 1, float(r), float(c)) for i, (r, c) in enumerate(zip(ratio, np.cumsum(ratio), strict=True))]
    loadings = [(how, i + 1, c, float(parts[i, j]), abs(float(parts[i, j]))) for i in range(len(parts)) for j, c in enumerate(columns)]
    means = x.agg(*[F.avg(c).alias(c) for c in columns]).first()
    score = lambda part: sum((F.col(c) - F.lit(means[c])) * F.lit(float(w)) for c, w in zip(columns, part, strict=True))
    return {
        "variance": spark.createDataFrame(variance, "scaling string, component int, explained_variance_ratio double, cumulative_variance_ratio double"),
        "loadings": spark.createDataFrame(loadings, "scaling string, component int, feature string, loading double, absolute_loading double"),
        "scores": x.select(id_col, *[score(p).alias(f"PC{i + 1}") for i, p in enumerate(parts)]),
    }


def component_alignment(reference: np.ndarray, other: np.ndarray) -> list[tuple[int, float]]:
    """For each reference component its partner and |cosine|, by the assignment with the greatest sum."""
    cos = np.abs(reference @ other.T)
    best = max(permutations(range(len(other)), len(reference)), key=lambda p: sum(cos[i, j] for i, j in enumerate(p)))
    return [(j, float(min(1.0, cos[i, j]))) for i, j in enumerate(best)]


def subspace_cosines(reference: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Cosines of the principal angles between two sets of orthonormal rows."""
    return np.clip(np.linalg.svd(reference @ other.T, compute_uv=False), 0, 1)


def _drawn(df: DataFrame, columns: list[str], id_col: str, how: str, k: int, repeats: int, seed: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Components and variance ratios of all sessions, and the components of each resampling; a repeat is one row of moments."""
    x = scaled(complete(df, columns), columns, how)
    parts, ratio = fit_pca(x, columns, k)
    rows = _moments(resampled(x, id_col, repeats, seed), columns, "weight", ["repeat"]) if len(parts) else []
    return parts, ratio, [_components(r, len(columns), k)[0] for r in rows]


def bootstrap_pca(df: DataFrame, columns: list[str], id_col: str = "session_id", k: int = 4, repeats: int = 200, seed: int = SEED, how: str = "standard") -> DataFrame:
    """Per component: how well components of resampled sessions agree with the full ones."""
    schema = "component int, reference_explained_variance_ratio double, mean_absolute_cosine double, median_absolute_cosine double, p05_absolute_cosine double, p95_absolute_cosine double, bootstrap_repeats int"
    parts, ratio, drawn = _drawn(df, columns, id_col, how, k, repeats, seed)
    if not drawn:
        return df.sparkSession.createDataFrame([], schema)
    d = np.array([[cos for _, cos in component_alignment(parts, other)] for other in drawn])
    rows = [(i + 1, float(ratio[i]), float(d[:, i].mean()), float(np.median(d[:, i])), *map(float, np.quantile(d[:, i], [0.05, 0.95])), repeats) for i in range(len(parts))]
    return df.sparkSession.createDataFrame(rows, schema)


def bootstrap_subspaces(df: DataFrame, columns: list[str], id_col: str = "session_id", k: int = 4, repeats: int = 200, seed: int = SEED, how: str = "standard") -> DataFrame:
    """Per number of leading components: mean and least cosine of the angles between their space and that of resampled sessions."""
    schema = "top_components int, mean_of_mean_principal_cosine double, p05_mean_principal_cosine double, mean_min_principal_cosine double, p05_min_principal_cosine double, bootstrap_repeats int"
    parts, _, drawn = _drawn(df, columns, id_col, how, k, repeats, seed)
    rows = []
    for m in range(1, len(parts) + 1):
        cos = [subspace_cosines(parts[:m], other[:m]) for other in drawn]
        mean, least = np.array([c.mean() for c in cos]), np.array([c.min() for c in cos])
        if len(cos):
            rows.append((m, float(mean.mean()), float(np.quantile(mean, 0.05)), float(least.mean()), float(np.quantile(least, 0.05)), repeats))
    return df.sparkSession.createDataFrame(rows, schema)


def fit_labels(df: DataFrame, columns: list[str], algorithm: str, k: int, *, id_col: str = "session_id", seed: int = SEED, starts: int | None = None) -> tuple[DataFrame, dict[str, float]]:
    """(id, cluster) of complete rows and, for gmm, aic and bic. The best of several starts counts.

    algorithm: kmeans, gmm or ward. kmeans and gmm are Spark's. ward merges one pair after
    another, which no cluster of machines shortens: the complete rows (features only) come to the
    driver, whose memory bounds them and whose time grows with their square.
    """
    x = complete(df, columns)
    if algorithm == "ward":
        rows = sorted(x.select(id_col, *columns).collect(), key=lambda r: r[id_col])
        labels = ward(np.array([[float(r[c]) for c in columns] for r in rows]).reshape(len(rows), len(columns)), k)
        kind = dict(df.dtypes)[id_col]
        return df.sparkSession.createDataFrame([(r[id_col], int(c)) for r, c in zip(rows, labels, strict=True)], f"{id_col} {kind}, cluster int"), {}
    starts = starts or STARTS.get(algorithm, 1)
    vectors = VectorAssembler(inputCols=columns, outputCol="features").transform(x.select(id_col, *columns))
    if algorithm == "kmeans":
        model = min((KMeans(k=k, seed=seed + i, featuresCol="features", predictionCol="cluster").fit(vectors) for i in range(starts)), key=lambda m: m.summary.trainingCost)
        extra = {}
    elif algorithm == "gmm":
        model = max((GaussianMixture(k=k, seed=seed + i, featuresCol="features", predictionCol="cluster").fit(vectors) for i in range(starts)), key=lambda m: m.summary.logLikelihood)
        p = len(columns)
        free = k * (p + p * (p + 1) / 2) + k - 1
        extra = {"aic": 2 * free - 2 * model.summary.logLikelihood, "bic": free * float(np.log(vectors.count())) - 2 * model.summary.logLikelihood}
    else:
        raise ValueError(f"unknown algorithm {algorithm}")
    return model.transform(vectors).select(id_col, F.col("cluster").cast("int").alias("cluster")), extra


def ward(x: np.ndarray, k: int) -> np.ndarray:
    """Agglomerative clusters of least added variance, numbered by first member.

    A chain of nearest neighbours finds the merges from centres and sizes alone, so nothing
    of the size of all pairs is held; the n - k merges of least height make the clusters.
    """
    n = len(x)
    centre, size, alive = x.astype(float).copy(), np.ones(n), np.ones(n, bool)
    merges: list[tuple[float, int, int]] = []
    chain: list[int] = []
    while len(merges) < n - 1:
        if not chain:
            chain.append(int(alive.argmax()))
        a = chain[-1]
        d = size[a] * size / (size[a] + size) * ((centre - centre[a]) ** 2).sum(axis=1)
        d[~alive] = np.inf
        d[a] = np.inf
        b = int(d.argmin())
        if len(chain) > 1 and d[chain[-2]] <= d[b]:
            low, high = sorted((a, chain[-2]))
            merges.append((float(d[chain[-2]]), low, high))
            del chain[-2:]
            centre[low] = (size[low] * centre[low] + size[high] * centre[high]) / (size[low] + size[high])
            size[low] += size[high]
            alive[high] = False
        else:
            chain.append(b)
    owner = list(range(n))

    def root(i: int) -> int:
        while owner[i] != i:
            owner[i] = owner[owner[i]]
            i = owner[i]
        return i

    for _, a, b in sorted(merges)[: max(0, n - k)]:
        low, high = sorted((root(a), root(b)))
        owner[high] = low
    first = {c: i for i, c in enumerate(dict.fromkeys(root(i) for i in range(n)))}
    return np.array([first[root(i)] for i in range(n)], int)


def silhouette(x: DataFrame, columns: list[str], id_col: str = "session_id") -> DataFrame:
    """id, cluster and Euclidean silhouette of every row of (id, cluster, columns), exactly; 0 in a cluster of one.

    Every block of rows meets every other in a task and leaves a sum for each row and cluster: the
    work is the square of the rows, as the measure's is, the memory two blocks.
    """
    rows = x.select(F.col(id_col).alias("id"), F.col("cluster").cast("int").alias("cluster"), F.array(*[F.col(c).cast("double") for c in columns]).alias("v"))
    blocks = max(1, -(-rows.count() // BLOCK_ROWS))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    kind = dict(rows.dtypes)["id"]
    left, right = rows.withColumn("other", every), rows.select(F.col("own").alias("o_"), "cluster", "v").withColumn("i_", every)

    def join(a: pa.Table, b: pa.Table) -> pa.Table:
        ids, at = a["id"], b["cluster"].to_numpy() if b.num_rows else np.empty(0, np.int32)
        matrix = lambda t: t["v"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
        groups = np.unique(at)
        if not a.num_rows or not len(groups):
            return pa.table({"id": a["id"].slice(0, 0), "other": pa.array([], pa.int32()), "total": pa.array([], pa.float64())})
        u, v = matrix(a), matrix(b)
        total = np.stack([np.sqrt(((u[:, None] - v[None, at == g]) ** 2).sum(axis=2)).sum(axis=1) for g in groups], axis=1)
        return pa.table({"id": pc.take(ids, pa.array(np.repeat(np.arange(len(u)), len(groups)))), "other": pa.array(np.tile(groups, len(u)), pa.int32()), "total": pa.array(total.ravel())})

    named = lambda df, of: df.select(*[F.col(c).alias(f"{n}_") for n, c in of.items()]).toDF(*of).groupBy("own", "other")
    sums = named(left, {"own": "own", "other": "other", "id": "id", "v": "v"}).cogroup(named(right, {"own": "i_", "other": "o_", "cluster": "cluster", "v": "v"})).applyInArrow(join, f"id {kind}, other int, total double")
    sums = sums.groupBy("id", "other").agg(F.sum("total").alias("total"))
    sizes = rows.groupBy("cluster").agg(F.count("*").alias("n"))
    both = rows.select("id", "cluster").join(sums, "id").join(sizes.select(F.col("cluster").alias("other"), "n"), "other")
    mine = F.col("cluster") == F.col("other")
    per = both.groupBy("id", "cluster").agg(F.max(F.when(mine, F.col("n"))).alias("n"), F.max(F.when(mine & (F.col("n") > 1), F.col("total") / (F.col("n") - 1))).alias("a"), F.min(F.when(~mine, F.col("total") / F.col("n"))).alias("b"))
    value = F.when((F.col("n") > 1) & F.col("b").isNotNull(), F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))).otherwise(0.0)
    return per.select(F.col("id").alias(id_col), "cluster", value.alias("silhouette"))


def adjusted_rand(a: DataFrame, b: DataFrame, id_col: str = "session_id") -> float:
    """Agreement of two clusterings over the ids in both, from their table of counts."""
    both = a.select(id_col, F.col("cluster").alias("x")).join(b.select(id_col, F.col("cluster").alias("y")), id_col)
    cells = both.groupBy("x", "y").agg(F.count("*").alias("n")).collect()  # clusters by clusters
    pairs = lambda ns: sum(n * (n - 1) / 2 for n in ns)
    side = lambda c: pairs([sum(r["n"] for r in cells if r[c] == v) for v in {r[c] for r in cells}])
    total, same, left, right = pairs([sum(r["n"] for r in cells)]), pairs([r["n"] for r in cells]), side("x"), side("y")
    chance = left * right / total if total else 0.0
    top = (left + right) / 2
    return 1.0 if top == chance else (same - chance) / (top - chance)


def cluster_quality(df: DataFrame, labels: DataFrame, columns: list[str], id_col: str = "session_id") -> dict[str, float | None]:
    """Calinski-Harabasz, Davies-Bouldin, sizes and the mean Euclidean silhouette: grouped aggregates, the last over blocks of rows."""
    x = df.select(id_col, *columns).join(labels, id_col)
    centre = x.groupBy("cluster").agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in columns])
    gap = sum((F.col(c) - F.col(f"m_{c}")) ** 2 for c in columns)
    spread = x.join(F.broadcast(centre), "cluster").groupBy("cluster").agg(F.sum(gap).alias("w"), F.avg(F.sqrt(gap)).alias("r"))
    rows = centre.join(spread, "cluster").orderBy("cluster").collect()  # a row per cluster
    n, k = sum(r["n"] for r in rows), len(rows)
    out = {"calinski_harabasz": None, "davies_bouldin": None, "silhouette": None, "min_cluster_size": min((r["n"] for r in rows), default=0), "max_cluster_size": max((r["n"] for r in rows), default=0)}
    if not 1 < k < n:
        return out
    c, size = np.array([[r[f"m_{f}"] for f in columns] for r in rows]), np.array([r["n"] for r in rows])
    within, radius = sum(r["w"] for r in rows), np.array([r["r"] for r in rows])
    between = float((size * ((c - (size[:, None] * c).sum(0) / n) ** 2).sum(1)).sum())
    out["calinski_harabasz"] = between * (n - k) / (within * (k - 1)) if within else 1.0
    apart = np.sqrt(((c[:, None] - c[None]) ** 2).sum(2))
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(apart > 0, (radius[:, None] + radius[None]) / apart, 0)
    out["davies_bouldin"] = float(ratio.max(1).mean())
    out["silhouette"] = silhouette(x, columns, id_col).agg(F.avg("silhouette")).first()[0]
    return out


def subsample_stability(df: DataFrame, columns: list[str], labels: DataFrame, algorithm: str, k: int, *, id_col: str = "session_id", repeats: int = 40, fraction: float = 0.8, seed: int = SEED) -> list[float]:
    """Agreement of the full clustering with those of subsamples, drawn by a hash of the id."""
    return [adjusted_rand(labels, fit_labels(df.where(uniform(F.lit(seed), F.lit(i), id_col) < fraction), columns, algorithm, k, id_col=id_col, starts=1)[0], id_col) for i in range(repeats)]


def evaluate_clusters(df: DataFrame, columns: list[str], ks: range = range(2, 9), algorithms: tuple[str, ...] = ("kmeans", "ward", "gmm"), *, id_col: str = "session_id", repeats: int = 40) -> DataFrame:
    """The row of every algorithm and k: quality, stability, sizes, aic and bic."""
    rows = []
    for algorithm in algorithms:
        for k in ks:
            labels, extra = fit_labels(df, columns, algorithm, k, id_col=id_col)
            q = cluster_quality(df, labels, columns, id_col)
            ari = subsample_stability(df, columns, labels, algorithm, k, id_col=id_col, repeats=repeats)
            rows.append((algorithm, k, q["silhouette"], q["calinski_harabasz"], q["davies_bouldin"], float(np.mean(ari)) if ari else None, float(np.std(ari)) if ari else None, q["min_cluster_size"], q["max_cluster_size"], extra.get("aic"), extra.get("bic")))
    return df.sparkSession.createDataFrame(rows, "algorithm string, k int, silhouette double, calinski_harabasz double, davies_bouldin double, stability_ari_mean double, stability_ari_std double, min_cluster_size long, max_cluster_size long, aic double, bic double")


def feature_drop(df: DataFrame, columns: list[str], k: int, id_col: str = "session_id") -> DataFrame:
    """k, removed_feature, retained_feature_count and agreement with the clusters of all features."""
    x = complete(df, columns)
    full, _ = fit_labels(x, columns, "kmeans", k, id_col=id_col)
    rows = [(k, c, len(columns) - 1, adjusted_rand(full, fit_labels(x, [f for f in columns if f != c], "kmeans", k, id_col=id_col)[0], id_col)) for c in columns]
    return df.sparkSession.createDataFrame(rows, "k int, removed_feature string, retained_feature_count int, ari_vs_primary double")


def compare_scalings(df: DataFrame, columns: list[str], k: int, id_col: str = "session_id") -> DataFrame:
    """k, scaling and agreement of the clusters with those under robust scaling."""
    x = complete(df, columns)
    found = {how: fit_labels(scaled(x, columns, how), columns, "kmeans", k, id_col=id_col)[0] for how in ("robust", "standard")}
    return df.sparkSession.createDataFrame([(k, how, adjusted_rand(found["robust"], labels, id_col)) for how, labels in found.items()], "k int, scaling string, ari_vs_primary double")


def sensitivity(features: DataFrame, primary: list[str], further: dict[str, list[str]], ks: tuple[int, ...] = (2, 4), id_col: str = "session_id") -> dict[str, DataFrame]:
    """How far clusters depend on scaling, feature set and algorithm: agreement with k-means of the primary features under robust scaling.

    A feature set is compared over the rows complete in it.
    """
    spark, x = features.sparkSession, complete(features, primary)
    robust = scaled(x, primary, "robust")
    sets, algorithms, scalings = [], [], None
    for k in ks:
        base, _ = fit_labels(robust, primary, "kmeans", k, id_col=id_col)
        for name, columns in {"primary": primary, **further}.items():
            own = base if name == "primary" else fit_labels(scaled(complete(features, columns), columns, "robust"), columns, "kmeans", k, id_col=id_col)[0]
            sets.append((k, name, len(columns), adjusted_rand(base, own, id_col)))
        algorithms += [(k, a, adjusted_rand(base, base if a == "kmeans" else fit_labels(robust, primary, a, k, id_col=id_col)[0], id_col)) for a in ("kmeans", "ward", "gmm")]
        table = compare_scalings(features, primary, k, id_col)
        scalings = table if scalings is None else scalings.unionByName(table)
    return {
        "scaling_sensitivity": scalings,
        "feature_set_sensitivity": spark.createDataFrame(sets, "k int, feature_set string, feature_count int, ari_vs_primary double"),
        "algorithm_sensitivity": spark.createDataFrame(algorithms, "k int, algorithm string, ari_vs_kmeans double"),
    }


def dimension_tables(df: DataFrame, columns: list[str], keep: int = 4, repeats: int = 200, id_col: str = "session_id") -> dict[str, DataFrame]:
    """Components under both scalings: variance, loadings, scores, their alignment and common subspaces, and bootstraps of components and subspaces."""
    spark, x = df.sparkSession, complete(df, columns)
    keep = min(keep, len(columns))
    per, out = {}, {}
    for how in ("robust", "standard"):
        tables = pca_tables(x, columns, id_col, keep, how)
        per[how] = fit_pca(scaled(x, columns, how), columns, keep)[0]
        boot = {"component_bootstrap": bootstrap_pca(x, columns, id_col, keep, repeats, how=how), "subspace_bootstrap": bootstrap_subspaces(x, columns, id_col, keep, repeats, how=how)}
        for name, table in (tables | boot).items():
            named = table.select(F.lit(how).alias("scaling"), *[c for c in table.columns if c != "scaling"])
            out[name] = out[name].unionByName(named) if name in out else named
    pairs = [(i + 1, j + 1, cos) for i, (j, cos) in enumerate(component_alignment(per["robust"], per["standard"]))]
    out["alignment"] = spark.createDataFrame(pairs, "component_robust int, component_standard int, absolute_cosine double")
    cosines = [subspace_cosines(per["robust"][:m], per["standard"][:m]) for m in range(1, len(per["robust"]) + 1)]
    out["subspaces"] = spark.createDataFrame([(m + 1, float(c.mean()), float(c.min())) for m, c in enumerate(cosines)], "top_components int, mean_principal_cosine double, min_principal_cosine double")
    return out
