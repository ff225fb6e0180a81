"""Comparison of models: column roles, preparation, cross-validation, leaderboards, ensembles, importance."""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import Imputer, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.columns import one_row
from quarry.functions.ordered import positions
from quarry.operators.regression import alike, hash_split, mean_baseline, regression_metrics
from quarry.sources.shared import written


def infer_roles(df: DataFrame, limit: int) -> DataFrame:
    """column_name, n_distinct, role: constant, id (as many values as rows), time, numeric, categorical (at most limit values), text."""
    total = df.agg(F.count("*").alias("__n"))
    value = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("v")) for i, c in enumerate(df.columns)])).alias("x")
    found = df.select(value).select("x.*").where("v IS NOT NULL").distinct().groupBy("i").count()  # one shuffle of the distinct values
    counts = one_row(total).crossJoin(one_row(found.agg(*[F.coalesce(F.max(F.when(F.col("i") == i, F.col("count"))), F.lit(0)).alias(c) for i, c in enumerate(df.columns)])))
    of = {f.name: f.dataType for f in df.schema}
    kind = lambda t: "time" if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "numeric" if isinstance(t, T.NumericType) else "text"
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_distinct"), F.lit(kind(of[c])).alias("kind")) for c in df.columns]))
    role = F.when(F.col("n_distinct") <= 1, "constant").when((F.col("n_distinct") == F.col("__n")) & (F.col("kind") != "time"), "id").when(F.col("kind") != "text", F.col("kind")).when(F.col("n_distinct") <= limit, "categorical").otherwise("text")
    return counts.select("__n", each.alias("x")).select("__n", "x.*").select("column_name", "n_distinct", role.alias("role"))


def auto_prep(df: DataFrame, roles: DataFrame, label: str) -> Pipeline:
    """A pipeline that imputes numbers and encodes categories into `features`. roles has a row per column."""
    role = {r["column_name"]: r["role"] for r in roles.collect() if r["column_name"] != label}
    numbers, kinds = ([c for c, r in role.items() if r == k] for k in ("numeric", "categorical"))
    stages = []
    if numbers:
        stages.append(Imputer(strategy="median", inputCols=numbers, outputCols=[f"{c}_filled" for c in numbers]))
    if kinds:
        stages += [StringIndexer(inputCols=kinds, outputCols=[f"{c}_index" for c in kinds], handleInvalid="keep", stringOrderType="frequencyDesc"), OneHotEncoder(inputCols=[f"{c}_index" for c in kinds], outputCols=[f"{c}_hot" for c in kinds])]
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=[f"{c}_filled" for c in numbers] + [f"{c}_hot" for c in kinds], outputCol="features")])


def settings(estimator, grid: dict) -> list[dict]:
    """All combinations of a candidate's parameters."""
    maps = ParamGridBuilder()
    for p, values in grid.items():
        maps = maps.addGrid(estimator.getParam(p), values)
    return maps.build()


def named(params: dict) -> str:
    return str({p.name: v for p, v in params.items()})


def by_moments(estimator, grid: dict) -> bool:
    """Whether all fits of a candidate take from rows of equal features only the number, sum and sum of squares of labels, as alike() keeps them."""
    made = [estimator.copy(m) for m in settings(estimator, grid)]
    if isinstance(estimator, LinearRegression):
        return all(e.getLoss() == "squaredError" for e in made)
    return isinstance(estimator, DecisionTreeRegressor) and all(e.getMinInstancesPerNode() == 1 for e in made)


def weighed(df: DataFrame, y: str, candidates: dict, features: list[str], by: list[str]) -> DataFrame:
    """by, features (a vector), y, weight of the rows that all candidates are fitted on: those of alike() where that changes no fit."""
    if all(by_moments(*c) for c in candidates.values()):
        rows = alike(df, features, y, by)
    else:
        rows = df.select(*dict.fromkeys([*by, *features, y]), F.lit(1.0).alias("weight"))
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(rows).select(*by, "features", y, "weight")


def labelled(estimator, y: str, more: dict | None = None):
    """The estimator with its label, and the weights if it takes any."""
    return estimator.copy({estimator.labelCol: y} | ({estimator.weightCol: "weight"} if estimator.hasParam("weightCol") else {}) | (more or {}))


def weighed_rmse(df: DataFrame, y: str, yhat: str) -> float:
    e = F.col(y) - F.col(yhat)
    return float(df.agg(F.sqrt(F.sum(F.col("weight") * e * e) / F.sum("weight"))).first()[0])


def cross_validate(df: DataFrame, y: str, key: str, candidates: dict, k: int, features: list[str], by: list[str]) -> DataFrame:
    """model, params, mean_rmse, sd_rmse over k folds fixed by the key. candidates: name -> (estimator, {param: values}).

    The group-mean baseline (over `by`) is scored on the same folds. Fits and scores go over the rows of weighed().
    """
    folds = weighed(hash_split(df, key, k), y, candidates, features, ["fold", *by]).cache()
    rows = []
    for name, (estimator, grid) in candidates.items():
        made = CrossValidator(estimator=labelled(estimator, y), estimatorParamMaps=settings(estimator, grid), evaluator=RegressionEvaluator(labelCol=y, metricName="rmse", weightCol="weight"), numFolds=k, foldCol="fold").fit(folds)
        rows += [(name, named(m), float(a), float(s)) for m, a, s in zip(made.getEstimatorParamMaps(), made.avgMetrics, made.stdMetrics, strict=True)]
    scores = [weighed_rmse(mean_baseline(folds.where(F.col("fold") != f), folds.where(F.col("fold") == f), by, y, "weight"), y, "yhat") for f in range(k)]
    mean = sum(scores) / k
    rows.append(("group mean", "{}", mean, (sum((s - mean) ** 2 for s in scores) / k) ** 0.5))
    folds.unpersist()
    return df.sparkSession.createDataFrame(rows, "model string, params string, mean_rmse double, sd_rmse double")


def fold_sums(df: DataFrame, y: str, xs: list[str], fold: str) -> dict[int, np.ndarray]:
    """The matrix of sums of products of (1, xs, y) over each fold's rows without nulls, in one pass."""
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in xs], F.col(y).cast("double")]
    places = [(i, j) for i in range(len(cols)) for j in range(i + 1)]
    got = df.dropna(subset=[*xs, y]).groupBy(fold).agg(*[F.sum(cols[i] * cols[j]).alias(f"s{n}") for n, (i, j) in enumerate(places)]).collect()
    out = {}
    for r in got:
        m = np.zeros((len(cols), len(cols)))
        for n, (i, j) in enumerate(places):
            m[i, j] = m[j, i] = r[f"s{n}"]
        out[r[fold]] = m
    return out


def ridge(sums: np.ndarray, reg: float) -> tuple[np.ndarray, float]:
    """Coefficients and intercept of least squares from sums of products, with a penalty reg as LinearRegression scales it (on standardised columns)."""
    n = sums[0, 0]
    mean = sums[0, 1:] / n
    covariance = sums[1:, 1:] / n - np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(covariance), 0))
    used = np.flatnonzero(spread[:-1] > 0)
    beta = np.zeros(len(mean) - 1)
    if len(used) and spread[-1] > 0:
        beta[used] = np.linalg.lstsq(covariance[np.ix_(used, used)] + np.diag(reg / spread[-1] * spread[used] ** 2), covariance[used, -1], rcond=None)[0]
    return beta, float(mean[-1] - beta @ mean[:-1])


def linear_cross_validate(df: DataFrame, y: str, xs: list[str], key: str, regs: list[float], k: int) -> DataFrame:
    """model, params, mean_rmse, sd_rmse of ridge fits as cross_validate gives them, all folds and penalties from one pass.

    Each fit takes the sums of all folds less its own; its error on the fold left out comes from that fold's sums too, so
    rows are read once however many folds and penalties there are.
    """
    own = fold_sums(hash_split(df, key, k), y, xs, "fold")
    whole = sum(own.values())
    rows = []
    for reg in regs:
        errors = []
        for sums in own.values():
            beta, intercept = ridge(whole - sums, reg)
            c = np.array([-intercept, *-beta, 1.0])  # y less the prediction
            errors.append(math.sqrt(max(0.0, c @ sums @ c) / sums[0, 0]))
        rows.append(("linear", str({"regParam": reg}), float(np.mean(errors)), float(np.std(errors))))
    return df.sparkSession.createDataFrame(rows, "model string, params string, mean_rmse double, sd_rmse double")


def holdout_scores(train: DataFrame, test: DataFrame, y: str, candidates: dict, features: list[str], by: list[str]) -> DataFrame:
    """model, params, holdout_rmse of the candidates and of the group-mean baseline, fitted on train and scored on test."""
    known, unseen = (weighed(df, y, candidates, features, by).cache() for df in (train, test))
    rows = [(name, named(m), weighed_rmse(labelled(estimator, y, m).fit(known).transform(unseen), y, "prediction")) for name, (estimator, grid) in candidates.items() for m in settings(estimator, grid)]
    rows.append(("group mean", "{}", weighed_rmse(mean_baseline(known, unseen, by, y, "weight"), y, "yhat")))
    known.unpersist()
    unseen.unpersist()
    return train.sparkSession.createDataFrame(rows, "model string, params string, holdout_rmse double")


def leaderboard(results: DataFrame, holdout: DataFrame) -> DataFrame:
    """results (cross_validate) with holdout_rmse (holdout_scores), which takes no part in the order, and place by mean_rmse. There is a row per candidate, so one task orders them."""
    return results.join(holdout, ["model", "params"], "left").withColumn("place", F.rank().over(Window.orderBy("mean_rmse")))


def score_predictions(df: DataFrame, by: list[str], y: str = "y", yhat: str = "yhat") -> DataFrame:
    """regression_metrics of stored predictions of many models, and place by rmse."""
    return regression_metrics(df, y, yhat, by).withColumn("place", F.rank().over(Window.orderBy("rmse")))


def greedy_ensemble(preds: DataFrame, y: str, models: list[str], rounds: int) -> DataFrame:
    """model, weight: forward selection with replacement of the columns whose running mean has the least squared error."""
    chosen: list[str] = []
    for _ in range(rounds):
        total = sum((F.col(c) for c in chosen), F.lit(0.0))
        errors = preds.agg(*[F.avg(F.pow(F.col(y) - (total + F.col(c)) / (len(chosen) + 1), F.lit(2.0))).alias(c) for c in models]).first()
        chosen.append(min(models, key=lambda c: (errors[c], c)))
    return preds.sparkSession.createDataFrame([(c, chosen.count(c) / rounds) for c in models], "model string, weight double")


def bijection(n: int, seed: int) -> tuple[int, int]:
    """a, c of the map r -> (a r + c) mod n, which moves each of 0 to n - 1 to a place of its own."""
    digest = hashlib.sha256(f"{seed}:{n}".encode()).digest()
    most = max(1, min(n - 1, (2**62) // max(1, n)))  # a r + c stays within a long
    a = 1 + int.from_bytes(digest[:8], "little") % most
    while math.gcd(a, n) != 1:
        a = a % most + 1
    return a, int.from_bytes(digest[8:16], "little") % n if n else 0


def reordered(placed: DataFrame, col: str, n: int, seed: int) -> DataFrame:
    """placed (with __pos, the rank of each row by a seeded hash of its key) with the values of col moved by a keyed bijection of the ranks."""
    a, c = bijection(n, seed)
    moved = placed.select(((F.col("__pos") * a + c) % n).alias("__pos"), F.col(col))
    return placed.drop(col).join(moved, "__pos").drop("__pos")


def permutation_importance(model, df: DataFrame, cols: list[str], y: str, key: str, seed: int = 7) -> DataFrame:
    """column_name, importance: how much rmse rises when the column's values are dealt out anew among all rows.

    Rows are ranked once, by a hash of the key and through ranges of it; each column then moves by a bijection of its own
    and one join of equal numbers, so no task sorts a fixed share of the rows.
    """
    base = regression_metrics(model.transform(df), y, "prediction").first()["rmse"]
    ranked = df.withColumn("__h", F.md5(F.concat(F.col(key).cast("string"), F.lit(f"p{seed}"))))
    placed = written(positions(ranked, ["__h", key]).drop("__h"), "ranked")
    n = placed.count()
    rows = []
    for i, c in enumerate(cols):
        scored = model.transform(reordered(placed, c, n, seed + i))
        rows.append((c, float(regression_metrics(scored, y, "prediction").first()["rmse"] - base) if n else None))
    return df.sparkSession.createDataFrame(rows, "column_name string, importance double")
