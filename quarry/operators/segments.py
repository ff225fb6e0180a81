"""Customer segments: scores, standardised columns, clusters and their profiles."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.columns import money, one_row, ratio, with_stats
from quarry.functions.ordered import quantiles


def rfm(df: DataFrame, cust: str, ts: str, amount: str, asof: str) -> DataFrame:
    """recency (days before asof), frequency, monetary of each customer; later rows than asof don't count."""
    cut = F.lit(asof).cast("date")
    known = df.where(F.to_date(ts) <= cut)
    return known.groupBy(cust).agg(F.datediff(cut, F.max(ts)).cast("long").alias("recency"), F.count("*").alias("frequency"), F.sum(money(amount)).cast("double").alias("monetary"))


def quantile_score(df: DataFrame, cols: list[str], n: int = 5) -> DataFrame:
    """Adds <col>_score: 1 and the number of exact n-quantile cuts strictly below the value; ties share a score."""
    shares = [k / n for k in range(1, n)]
    out = df
    for c in cols:
        out = out.crossJoin(one_row(quantiles(df, c, shares).select(F.col("q").alias(f"{c}__cuts"))))
    score = lambda c: reduce(lambda a, b: a + b, [(F.col(f"{c}__cuts")[k] < F.col(c)).cast("int") for k in range(n - 1)], F.lit(1))
    return out.withColumns({f"{c}_score": score(c) for c in cols}).drop(*[f"{c}__cuts" for c in cols])


def label_segments(df: DataFrame, rules: list[tuple[str, str]], other: str = "other") -> DataFrame:
    """Adds segment: the name of the first rule (name, SQL condition) that holds."""
    out = reduce(lambda made, r: (F if made is None else made).when(F.expr(r[1]), r[0]), rules, None)
    return df.withColumn("segment", F.lit(other) if out is None else out.otherwise(other))


def standardize(df: DataFrame, cols: list[str], how: str = "z") -> DataFrame:
    """Adds <col>_std by mean and sample deviation (z), range (minmax) or median and quartile distance (robust); no spread gives 0."""
    made = {
        "z": lambda c: (F.avg(c), F.stddev_samp(c)),
        "minmax": lambda c: (F.min(c).cast("double"), (F.max(c) - F.min(c)).cast("double")),
    }.get(how)
    if made:
        out = df.crossJoin(one_row(df.agg(*[x.alias(f"{c}__{k}") for c in cols for k, x in zip("ab", made(c), strict=True)])))
    else:
        out = df
        for c in cols:
            q = F.col("q")
            out = out.crossJoin(one_row(quantiles(df, c, [0.25, 0.5, 0.75]).select(q[1].alias(f"{c}__a"), (q[2] - q[0]).alias(f"{c}__b"))))
    value = lambda c: F.when(F.col(c).isNotNull(), F.coalesce(ratio(F.col(c) - F.col(f"{c}__a"), F.col(f"{c}__b")), F.lit(0.0)))
    return out.withColumns({f"{c}_std": value(c) for c in cols}).drop(*[f"{c}__{k}" for c in cols for k in "ab"])


def assembled(cols: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="skip")


def cluster_fit(df: DataFrame, cols: list[str], kind: str, k: int, seed: int = 7) -> PipelineModel | Mixture:
    """k-means, bisecting k-means or a Gaussian mixture; transform() of the model adds `prediction`."""
    if kind == "mixture":
        return mixture_fit(df, cols, k, seed)
    made = {"kmeans": KMeans, "bisecting": BisectingKMeans}[kind](k=k, seed=seed)
    ready = assembled(cols)
    return PipelineModel([ready, made.fit(ready.transform(df))])


def kmeans_fit(df: DataFrame, cols: list[str], k: int, seed: int = 7) -> PipelineModel:
    return cluster_fit(df, cols, "kmeans", k, seed)


class Mixture:
    """A mixture of normal distributions with full covariances."""

    def __init__(self, cols: list[str], weights: np.ndarray, means: np.ndarray, covariances: np.ndarray):
        self.cols, self.weights, self.means, self.covariances = cols, weights, means, covariances

    def log_densities(self) -> list[Column]:
        """The logarithm of each component's weight times its density, as columns."""
        out = []
        for w, m, c in zip(self.weights, self.means, self.covariances, strict=True):
            half = np.linalg.inv(np.linalg.cholesky(c))  # |half (x - m)|^2 is the squared distance
            off = [F.col(x) - F.lit(float(v)) for x, v in zip(self.cols, m, strict=True)]
            rows = [reduce(lambda a, b: a + b, [F.lit(float(half[i, j])) * off[j] for j in range(i + 1)]) for i in range(len(self.cols))]
            constant = math.log(max(w, 1e-300)) - 0.5 * len(self.cols) * math.log(2 * math.pi) + float(np.log(np.diag(half)).sum())
            out.append(F.lit(constant) - 0.5 * reduce(lambda a, b: a + b, [r * r for r in rows]))
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds prediction: the likeliest component, the lower one of ties; null for rows with a null."""
        known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in self.cols])
        best = F.array_max(F.array(*[F.struct(d.alias("d"), F.lit(-i).alias("i")) for i, d in enumerate(self.log_densities())]))
        return df.withColumn("prediction", F.when(known, -best["i"]))


def mixture_fit(df: DataFrame, cols: list[str], k: int, seed: int = 7, rounds: int = 100, tolerance: float = 1e-6) -> Mixture:
    """Expectation-maximisation from the centres and spreads of the best of several k-means fits, until the mean log-likelihood rises by less than `tolerance`.

    Each round is one aggregate of sufficient statistics (sums of responsibilities, of values and of their products), so
    the driver holds k * (d + 1)^2 numbers and no row.
    """
    ready = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).dropna().cache()
    vectors = assembled(cols).transform(ready)
    fits = [KMeans(k=k, seed=seed + i).fit(vectors) for i in range(5)]
    best = min(fits, key=lambda f: f.summary.trainingCost)
    centres, d = np.array(best.clusterCenters()), len(cols)
    whole = ready.agg(*[F.var_pop(c) for c in cols]).first()
    floor = np.diag([1e-6 * (v or 0.0) + 1e-12 for v in whole])  # keeps covariances invertible
    near = assign_centroid(ready, cols, centres.tolist())
    hard = [(F.col("cluster") == i).cast("double") for i in range(len(centres))]
    model = _from_sums(near, cols, hard, floor)
    last = -math.inf
    for _ in range(rounds):
        logs = model.log_densities()
        most = F.greatest(*logs) if len(logs) > 1 else logs[0]
        placed = ready.select(*cols, F.array(*logs).alias("l"), most.alias("m"))
        total = placed.withColumn("t", F.col("m") + F.log(F.aggregate("l", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("m")))))
        shares = [F.exp(F.col("l")[i] - F.col("t")) for i in range(len(logs))]
        model = _from_sums(total, cols, shares, floor, F.avg("t"))
        if model.likelihood - last < tolerance:
            break
        last = model.likelihood
    ready.unpersist()
    return model


def _from_sums(df: DataFrame, cols: list[str], shares: list[Column], floor: np.ndarray, likelihood: Column | None = None) -> Mixture:
    """The mixture whose components have these shares of each row, by one aggregate."""
    d = len(cols)
    products = [(i, j) for i in range(d) for j in range(i + 1)]
    named = df.select(*cols, *[s.alias(f"__r{i}") for i, s in enumerate(shares)], *(["t"] if likelihood is not None else []))
    sums = [F.sum(f"__r{i}") for i in range(len(shares))]
    sums += [F.sum(F.col(f"__r{i}") * F.col(c)) for i in range(len(shares)) for c in cols]
    sums += [F.sum(F.col(f"__r{i}") * F.col(cols[a]) * F.col(cols[b])) for i in range(len(shares)) for a, b in products]
    got = named.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)], *([likelihood.alias("likelihood")] if likelihood is not None else [])).first()
    values, k = np.array([got[f"s{i}"] or 0.0 for i in range(len(sums))]), len(shares)
    n = np.maximum(values[:k], 1e-12)
    means = values[k : k + k * d].reshape(k, d) / n[:, None]
    second = values[k + k * d :].reshape(k, len(products)) / n[:, None]
    covariances = np.zeros((k, d, d))
    for at, (a, b) in enumerate(products):
        covariances[:, a, b] = covariances[:, b, a] = second[:, at] - means[:, a] * means[:, b]
    made = Mixture(cols, n / n.sum(), means, covariances + floor)
    made.likelihood = float(got["likelihood"]) if likelihood is not None else -math.inf
    return made


def kmeans_sweep(df: DataFrame, cols: list[str], ks: list[int], seed: int = 7) -> DataFrame:
    """k, cost (within clusters), silhouette of a k-means fit for each k."""
    ready = assembled(cols).transform(df).select("features").cache()
    rows = []
    for k in ks:
        model = KMeans(k=k, seed=seed).fit(ready)
        rows.append((k, float(model.summary.trainingCost), float(ClusteringEvaluator().evaluate(model.transform(ready)))))
    ready.unpersist()
    return df.sparkSession.createDataFrame(rows, "k int, cost double, silhouette double")


def assign_centroid(df: DataFrame, cols: list[str], centroids: list[list[float]]) -> DataFrame:
    """Adds cluster (place of the nearest centroid, the lower one for ties) and distance; null coordinates give null."""
    square = lambda c: reduce(lambda a, b: a + b, [(F.col(x) - v) * (F.col(x) - v) for x, v in zip(cols, c, strict=True)])
    near = F.array_min(F.array(*[F.struct(square(c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centroids)]))
    known = reduce(lambda a, b: a & b, [F.col(x).isNotNull() for x in cols])
    return df.withColumn("__near", F.when(known, near)).withColumns({"cluster": F.col("__near.i"), "distance": F.sqrt("__near.d")}).drop("__near")


def cluster_profile(df: DataFrame, cluster: str, cols: list[str]) -> DataFrame:
    """Long form: size and share of each cluster; mean, median, and lift of the mean over all rows' mean, of each column."""
    sizes = df.groupBy(cluster).agg(F.count("*").alias("size"))
    whole = one_row(df.agg(F.count("*").alias("__n")))
    long = df.select(cluster, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in cols])).alias("x")).select(cluster, "x.*")
    means = long.groupBy(cluster, "feature").agg(F.avg("v").alias("mean"))
    every = long.groupBy("feature").agg(F.avg("v").alias("__all"))  # a row per column
    medians = quantiles(long, "v", [0.5], [cluster, "feature"]).select(cluster, "feature", F.col("q")[0].alias("median"))
    out = with_stats(with_stats(means, medians, [cluster, "feature"]), sizes, [cluster]).join(F.broadcast(every), "feature").crossJoin(whole)
    return out.select(cluster, "size", ratio(F.col("size"), F.col("__n")).alias("share"), "feature", "mean", "median", ratio(F.col("mean"), F.col("__all")).alias("lift"))


def cluster_purity(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """n of each cluster and label, and the cluster's purity (share of its commonest label)."""
    counts = df.groupBy(cluster, label).agg(F.count("*").alias("n"))
    w = Window.partitionBy(cluster)
    return counts.withColumn("purity", F.max("n").over(w) / F.sum("n").over(w))
