"""Features, fits and scores for regression."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.columns import hash_number, one_row, ratio


def calendar_columns(ts: str) -> dict[str, Column]:
    """year, month, day_of_week (1 is Monday), hour, is_weekend of a time."""
    day = F.weekday(ts) + 1
    return {"year": F.year(ts), "month": F.month(ts), "day_of_week": day, "hour": F.hour(ts), "is_weekend": day >= 6}


def calendar_features(df: DataFrame, ts: str) -> DataFrame:
    """Adds the columns of calendar_columns."""
    return df.withColumns(calendar_columns(ts))


def duration(df: DataFrame, start: str, end: str, unit: str = "day") -> DataFrame:
    """Adds elapsed (whole days, or seconds) from start to end, negative where end comes first, and is_negative."""
    elapsed = F.datediff(end, start).cast("long") if unit == "day" else F.timestamp_diff("MICROSECOND", F.col(start), F.col(end)) / 1e6
    return df.withColumn("elapsed", elapsed).withColumn("is_negative", F.col("elapsed") < 0)


def hash_split(df: DataFrame, key: str, k: int) -> DataFrame:
    """Adds fold, 0 to k-1, fixed by the key."""
    return df.withColumn("fold", (hash_number(key) % k).cast("int"))


def ols(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Slope, intercept, r2 and n of least squares in each group; rows without x or y don't count."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return both.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.count("*").alias("n"))


def linear_fit(df: DataFrame, xs: list[str], y: str, reg: float = 0.0) -> PipelineModel:
    """Least squares (ridge with reg > 0) by the normal equations."""
    ready = VectorAssembler(inputCols=xs, outputCol="features", handleInvalid="skip")
    model = LinearRegression(labelCol=y, solver="normal", regParam=reg, elasticNetParam=0.0).fit(ready.transform(df))
    return PipelineModel([ready, model])


def alike(df: DataFrame, xs: list[str], y: str, by: list[str] = ()) -> DataFrame:
    """by, xs, y, weight: rows that are equal in by and xs as two, of mean less and plus deviation of y, with half their number as weight each.

    Their number, sum and sum of squares of y stay, which is all that least squares, splits by variance and squared errors
    take from such rows. One y leaves one row. Rows with a null in xs or y are left out.
    """
    keys = list(dict.fromkeys([*by, *xs]))
    groups = df.dropna(subset=[*xs, y]).groupBy(*keys).agg(F.count("*").alias("__n"), F.avg(y).alias("__m"), F.stddev_pop(y).alias("__s"))
    sides = F.when(F.col("__s") > 0, F.array(F.lit(-1.0), F.lit(1.0))).otherwise(F.array(F.lit(0.0)))
    both = groups.withColumn("__sides", sides).withColumn("__side", F.explode("__sides"))
    return both.select(*keys, (F.col("__m") + F.col("__side") * F.col("__s")).alias(y), (F.col("__n") / F.size("__sides")).alias("weight"))


def tree_fit(df: DataFrame, xs: list[str], y: str, kind: str = "boosted", seed: int = 7) -> PipelineModel:
    """Boosted trees or a random forest. Boosting goes over rows many times, so it takes those of alike(); a forest draws single rows."""
    ready = VectorAssembler(inputCols=xs, outputCol="features", handleInvalid="skip")
    if kind == "boosted":
        rows = ready.transform(alike(df, xs, y)).select("features", y, "weight").cache()
        fitted = GBTRegressor(labelCol=y, weightCol="weight", seed=seed, maxIter=20, maxDepth=4).fit(rows)
        rows.unpersist()
        return PipelineModel([ready, fitted])
    made = RandomForestRegressor(labelCol=y, seed=seed, numTrees=20, maxDepth=8)
    return PipelineModel([ready, made.fit(ready.transform(df))])


def mean_baseline(train: DataFrame, test: DataFrame, by: list[str], y: str, weight: str | None = None) -> DataFrame:
    """test with yhat: the mean of y (weighted by a column) over the training rows of the same group, or over all of them for a new group."""
    mean = F.sum(F.col(weight) * F.col(y)) / F.sum(weight) if weight else F.avg(y)
    groups = train.groupBy(*by).agg(mean.alias("group_mean"))
    overall = one_row(train.agg(mean.alias("overall_mean")))
    return test.join(groups, by, "left").crossJoin(overall).withColumn("yhat", F.coalesce("group_mean", "overall_mean")).drop("group_mean", "overall_mean")


def regression_metrics(df: DataFrame, y: str, yhat: str, by: list[str] | None = None) -> DataFrame:
    """n, mae, rmse, r2, mape (over rows with y other than 0; n_zero counts the rest) of each group."""
    both = df.where(F.col(y).isNotNull() & F.col(yhat).isNotNull())
    e = F.col(y) - F.col(yhat)
    total = F.var_pop(y) * F.count("*")
    return both.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - ratio(F.sum(e * e), total)).alias("r2"),
        F.avg(F.when(F.col(y) != 0, F.abs(e / F.nullif(F.col(y), F.lit(0.0))))).alias("mape"), F.count_if(F.col(y) == 0).alias("n_zero"),
    )


def error_slices(df: DataFrame, y: str, yhat: str, by: list[str]) -> DataFrame:
    """regression_metrics per segment, with the segment's share of all squared error."""
    per = regression_metrics(df, y, yhat, by)
    squared = F.col("rmse") * F.col("rmse") * F.col("n")
    return per.withColumn("error_share", ratio(squared, F.sum(squared).over(Window.partitionBy())))
