"""Series: resampling, gaps, lags, smoothing, forecasts, backtests. A series is the rows of one `by` key in order of time.

Windows and folds run by series while all are short. Lags, rolling statistics and smoothing cut longer series into blocks
with the same results: windows borrow the rows before a block, folds begin where the block before ends.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.columns import ratio, with_stats
from quarry.functions.ordered import BLOCK, back, blocked, positions, quantiles
from quarry.operators.regression import calendar_columns, linear_fit
from quarry.sources.shared import written

#: Values of a series that one fold goes over; a longer series is folded in so many at a time.
CHUNK = 10_000
#: Calendar features that stand for kinds, with their values but for the first.
KINDS = {"month": range(2, 13), "day_of_week": range(2, 8), "hour": range(1, 24)}


def in_order(by: list[str], ts: str):
    return Window.partitionBy(*(by or [F.lit(1)])).orderBy(ts)


def resample(df: DataFrame, ts: str, period: str, aggs: dict[str, Column], by: list[str] | None = None, partial: bool = True) -> DataFrame:
    """by, period (date for days and longer), aggregates. partial=False drops the first and last period of all rows."""
    cut = F.date_trunc(period, F.col(ts))
    cut = cut.cast("date") if period.lower() in ("day", "week", "month", "quarter", "year") else cut.cast("timestamp_ntz")
    out = df.where(F.col(ts).isNotNull()).groupBy(*(by or []), cut.alias("period")).agg(*[c.alias(n) for n, c in aggs.items()])
    if partial:
        return out
    ends = out.agg(F.min("period").alias("__a"), F.max("period").alias("__b"))
    return out.crossJoin(F.broadcast(ends)).where("period > __a AND period < __b").drop("__a", "__b")


def fill_gaps(df: DataFrame, ts: str, step: str, how: str, by: list[str], y: str) -> DataFrame:
    """by, ts, y at every step between each series' ends; missing y by `zero`, `last` value, or `linear` between neighbours."""
    ends = df.groupBy(*by).agg(F.min(ts).alias("__a"), F.max(ts).alias("__b"))
    grid = ends.select(*by, F.explode(F.expr(f"sequence(__a, __b, interval {step})")).alias(ts))
    full = grid.join(df.select(*by, ts, y), [*by, ts], "left")
    if how == "zero":
        return full.withColumn(y, F.coalesce(y, F.lit(0.0)))
    w = in_order(by, ts)
    last = F.last(y, ignorenulls=True).over(w)
    if how == "last":
        return full.withColumn(y, last)
    place = F.row_number().over(w)
    placed = full.withColumn("__i", place).withColumn("__k", F.when(F.col(y).isNotNull(), F.col("__i")))
    after = w.rowsBetween(0, Window.unboundedFollowing)
    y0, i0 = F.last(y, ignorenulls=True).over(w), F.last("__k", ignorenulls=True).over(w)
    y1, i1 = F.first(y, ignorenulls=True).over(after), F.first("__k", ignorenulls=True).over(after)
    return placed.withColumn("__v", F.when(F.col(y).isNotNull(), F.col(y)).otherwise(y0 + (y1 - y0) * ratio(F.col("__i") - i0, i1 - i0))).withColumn(y, F.col("__v")).drop("__i", "__k", "__v")


def time_split(df: DataFrame, ts: str, at: str | None = None, h: int | None = None, by: list[str] | None = None) -> DataFrame:
    """Adds is_test: rows from `at` on, or the last h rows of each series."""
    if at is not None:
        return df.withColumn("is_test", F.col(ts) >= F.lit(at).cast("timestamp_ntz"))
    w = Window.partitionBy(*(by or [F.lit(1)])).orderBy(F.col(ts).desc())
    return df.withColumn("is_test", F.row_number().over(w) <= h)


def lags(df: DataFrame, y: str, ks: list[int], by: list[str], ts: str, block: int = BLOCK) -> DataFrame:
    """Adds lag_k and diff_k for each k."""
    rows, keys, own = blocked(df, ts, max(ks), by, block)
    w = Window.partitionBy(*keys).orderBy(ts)
    return back(rows.withColumns({f"lag_{k}": F.lag(y, k).over(w) for k in ks} | {f"diff_{k}": F.col(y) - F.lag(y, k).over(w) for k in ks}), own)


def rolling(df: DataFrame, y: str, n: int, by: list[str], ts: str, block: int = BLOCK) -> DataFrame:
    """Adds roll_mean, roll_std, roll_min, roll_max of the n rows before; the row itself doesn't count."""
    rows, keys, own = blocked(df, ts, n, by, block)
    w = Window.partitionBy(*keys).orderBy(ts).rowsBetween(-n, -1)
    return back(rows.withColumns({"roll_mean": F.avg(y).over(w), "roll_std": F.stddev_samp(y).over(w), "roll_min": F.min(y).over(w), "roll_max": F.max(y).over(w)}), own)


def simple_forecast(df: DataFrame, how: str, h: int, by: list[str], ts: str = "period", y: str = "y") -> DataFrame:
    """by, step 1 to h, yhat: the last value (naive), the line from first to last (drift), or the mean."""
    last, first, n = F.max_by(y, ts), F.min_by(y, ts), F.count(y)
    slope = {"naive": F.lit(0.0), "mean": F.lit(0.0), "drift": F.coalesce(ratio(last - first, n - 1), F.lit(0.0))}[how]
    per = df.where(F.col(y).isNotNull()).groupBy(*by).agg((F.avg(y) if how == "mean" else last).alias("__b"), slope.alias("__s"))
    return per.select(*by, F.explode(F.sequence(F.lit(1), F.lit(h))).alias("step"), "__b", "__s").select(*by, "step", (F.col("__b") + F.col("step") * F.col("__s")).alias("yhat"))


def ordered_values(ts: str, y: str) -> Column:
    """The values of a series in order, as one array (an aggregate)."""
    return F.transform(F.array_sort(F.collect_list(F.struct(ts, y))), lambda x: x[y])


def seasonal_naive(df: DataFrame, m: int, h: int, by: list[str], ts: str = "period", y: str = "y") -> DataFrame:
    """by, step, yhat: the value of the same season in the last m values, repeated for h over m; none for shorter series."""
    last = df.where(F.col(y).isNotNull()).groupBy(*by).agg(ordered_values(ts, y).alias("__v")).where(F.size("__v") >= m)
    step = last.select(*by, "__v", F.explode(F.sequence(F.lit(1), F.lit(h))).alias("step"))
    return step.select(*by, "step", F.element_at("__v", F.size("__v") - m + 1 + (F.col("step") - 1) % m).alias("yhat"))


def advanced(level, trend, season, x, a, b, g, seasonal: bool):
    """Level, trend, the season's next value, and the error of the forecast, after a value x: of columns or of numbers."""
    e = x - (level + trend + season)
    new = a * (x - season) + (1 - a) * (level + trend)
    return new, b * (new - level) + (1 - b) * trend, (g * (x - new) + (1 - g) * season) if seasonal else 0.0 * season, e


def power(a: float, b: float, g: float, m: int, n: int) -> list[list[float]]:
    """What n values of zero make of a state (level, trend, seasons): a matrix, as each step is linear in state and value."""
    seasons = max(1, m)
    one = np.zeros((2 + seasons, 2 + seasons))
    for i, unit in enumerate(np.eye(2 + seasons)):
        level, trend, new, _ = advanced(unit[0], unit[1], unit[2], 0.0, a, b, g, m > 1)
        one[:, i] = [level, trend, *unit[3:], new]
    return np.linalg.matrix_power(one, n).tolist()


def long_fold(df: DataFrame, m: int, grid: list[tuple[float, float, float]], by: list[str], ts: str, y: str, chunk: int, flat: bool = False) -> DataFrame:
    """by, alpha, beta, gamma, s (state array: level, trend, seasons; and sse) of holt_winters or, with flat (no trend), ses, for long series.

    A series is cut into chunks. What a chunk makes of the state before it is a power of one matrix times that state,
    and its own fold from zero. So all chunks are folded at once from zero, one short fold over a series' chunks gives
    the state before each, and a second fold of all chunks from there gives the errors.
    """
    seasonal, seasons = m > 1, max(1, m)
    placed = positions(df.where(F.col(y).isNotNull()), ts, by, "__i").withColumn("__k", F.floor(F.col("__i") / chunk))
    parts = placed.groupBy(*by, "__k").agg(ordered_values(ts, y).alias("__v"))
    settings = [F.struct(F.lit(float(a)).alias("alpha"), F.lit(float(b)).alias("beta"), F.lit(float(g)).alias("gamma"), F.array(*[F.array(*map(F.lit, row)) for row in power(a, b, g, m, chunk)]).alias("__m")) for a, b, g in grid]
    each = written(parts.select(*by, "__k", "__v", F.explode(F.array(*settings)).alias("p")).select(*by, "__k", "__v", "p.*"), "chunks")
    a, b, g, v = F.col("alpha"), F.col("beta"), F.col("gamma"), F.col("__v")

    def step(s: Column, x: Column) -> Column:
        old = s["s"]
        level, trend, new, e = advanced(old[0], old[1], old[2], x, a, b, g, seasonal)
        return F.struct(F.concat(F.array(level, trend), F.slice(old, 4, seasons - 1), F.array(new)).alias("s"), (s["sse"] + e * e).alias("sse"))

    from_state = lambda values, state: F.aggregate(values, F.struct(state.alias("s"), F.lit(0.0).alias("sse")), step)
    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda s, e: s + e) / m
    if seasonal:
        level0 = mean(F.slice(v, 1, m))
        start, skip = F.concat(F.array(level0, (mean(F.slice(v, m + 1, m)) - level0) / m), F.transform(F.slice(v, 1, m), lambda x: x - level0)), m
    else:
        start, skip = F.array(v[0], F.lit(0.0) if flat else v[1] - v[0], F.lit(0.0)), 1
    zero = F.array(*[F.lit(0.0)] * (2 + seasons))
    rest = F.slice(v, skip + 1, F.greatest(F.size(v) - skip, F.lit(0)))
    ends = each.select(*by, "alpha", "beta", "gamma", "__m", "__k", F.when(F.col("__k") == 0, from_state(rest, start)["s"]).otherwise(from_state(v, zero)["s"]).alias("w"))
    chain = ends.groupBy(*by, "alpha", "beta", "gamma").agg(F.first("__m").alias("__m"), F.transform(F.array_sort(F.collect_list(F.struct("__k", "w"))), lambda x: x["w"]).alias("w"))
    times = lambda state: F.transform("__m", lambda row: F.aggregate(F.zip_with(row, state, lambda p, q: p * q), F.lit(0.0), lambda t, x: t + x))
    follow = lambda done, w: F.concat(done, F.array(F.zip_with(times(F.element_at(done, -1)), w, lambda p, q: p + q)))
    states = chain.select(*by, "alpha", "beta", "gamma", F.posexplode(F.aggregate(F.slice("w", 2, F.size("w") - 1), F.slice("w", 1, 1), follow)).alias("__before", "__state"))
    same = [*by, "alpha", "beta", "gamma"]
    states = states.withColumn("__k", F.col("__before") + 1).select(*same, "__k", "__state")
    joined = with_stats(each, states, [*same, "__k"])
    folded = F.when(F.col("__k") == 0, from_state(rest, start)).otherwise(from_state(v, F.col("__state")))
    done = joined.select(*by, "alpha", "beta", "gamma", "__k", folded.alias("f"))
    return done.groupBy(*by, "alpha", "beta", "gamma").agg(F.max_by("f.s", "__k").alias("s"), F.sum("f.sse").alias("sse"))


def longest(df: DataFrame, by: list[str], y: str) -> int:
    return df.where(F.col(y).isNotNull()).groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def ses(df: DataFrame, alphas: list[float], h: int, by: list[str], ts: str = "period", y: str = "y", chunk: int = CHUNK) -> DataFrame:
    """by, alpha, level, sse of simple exponential smoothing with the alpha of least squared one-step error; the forecast of every step is the level."""
    if longest(df, by, y) > chunk:
        fitted = long_fold(df, 0, [(a, 0.0, 0.0) for a in alphas], by, ts, y, chunk, flat=True).select(*by, "alpha", F.struct(F.col("s")[0].alias("level"), "sse").alias("s"))
    else:
        values = df.where(F.col(y).isNotNull()).groupBy(*by).agg(ordered_values(ts, y).alias("__v"))
        grid = values.select(*by, "__v", F.explode(F.array(*map(F.lit, alphas))).alias("alpha"))
        start = F.struct(F.col("__v")[0].alias("level"), F.lit(0.0).alias("sse"))
        fold = F.aggregate(F.slice("__v", 2, F.greatest(F.size("__v") - 1, F.lit(0))), start, lambda s, v: F.struct((s["level"] + F.col("alpha") * (v - s["level"])).alias("level"), (s["sse"] + (v - s["level"]) * (v - s["level"])).alias("sse")))
        fitted = grid.select(*by, "alpha", fold.alias("s"))
    best = fitted.groupBy(*by).agg(F.min_by(F.struct("alpha", "s"), F.struct("s.sse", "alpha")).alias("b")).select(*by, "b.alpha", "b.s.level", "b.s.sse")
    return best.select("*", F.explode(F.sequence(F.lit(1), F.lit(h))).alias("step"), F.col("level").alias("yhat"))


def holt_winters(df: DataFrame, m: int, grid: list[tuple[float, float, float]], h: int, by: list[str], ts: str = "period", y: str = "y", chunk: int = CHUNK) -> DataFrame:
    """by, alpha, beta, gamma, sse, step, yhat of additive Holt-Winters (m seasons; m of 1 or less: Holt without seasons).

    The level starts at the first value and the trend at the first difference (without seasons), or at the mean of the
    first season and the mean step to the second, with the first season's deviations as seasons.
    """
    if longest(df, by, y) > max(chunk, 2 * m):
        known = with_stats(df.where(F.col(y).isNotNull()), df.where(F.col(y).isNotNull()).groupBy(*by).agg(F.count("*").alias("__n")), by).where(F.col("__n") >= max(2, 2 * m)).drop("__n")
        long = long_fold(known, m, grid, by, ts, y, max(chunk, 2 * m))
        state = F.struct(F.col("s")[0].alias("level"), F.col("s")[1].alias("trend"), "sse", F.slice("s", 3, max(1, m)).alias("seasons"))
        return best_forecast(long.select(*by, "alpha", "beta", "gamma", state.alias("s")), m, h, by)
    values = df.where(F.col(y).isNotNull()).groupBy(*by).agg(ordered_values(ts, y).alias("__v")).where(F.size("__v") >= max(2, 2 * m))
    each = values.select(*by, "__v", F.explode(F.array(*[F.struct(F.lit(a).alias("alpha"), F.lit(b).alias("beta"), F.lit(g).alias("gamma")) for a, b, g in grid])).alias("p")).select(*by, "__v", "p.*")
    a, b, g, v = F.col("alpha"), F.col("beta"), F.col("gamma"), F.col("__v")
    mean = lambda x, n: F.aggregate(x, F.lit(0.0), lambda s, e: s + e) / n
    if m > 1:
        level0, trend0 = mean(F.slice(v, 1, m), m), (mean(F.slice(v, m + 1, m), m) - mean(F.slice(v, 1, m), m)) / m
        start = F.struct(level0.alias("level"), trend0.alias("trend"), F.lit(0.0).alias("sse"), F.transform(F.slice(v, 1, m), lambda x: x - level0).alias("seasons"))
        rest = F.slice(v, m + 1, F.size(v) - m)
    else:
        start = F.struct(v[0].alias("level"), (v[1] - v[0]).alias("trend"), F.lit(0.0).alias("sse"), F.array(F.lit(0.0)).alias("seasons"))
        rest = F.slice(v, 2, F.size(v) - 1)

    def step(s: Column, x: Column) -> Column:
        level, trend, new, e = advanced(s["level"], s["trend"], s["seasons"][0], x, a, b, g, m > 1)
        return F.struct(level.alias("level"), trend.alias("trend"), (s["sse"] + e * e).alias("sse"), F.concat(F.slice(s["seasons"], 2, F.size(s["seasons"]) - 1), F.array(new)).alias("seasons"))

    return best_forecast(each.select(*by, "alpha", "beta", "gamma", F.aggregate(rest, start, step).alias("s")), m, h, by)


def best_forecast(fitted: DataFrame, m: int, h: int, by: list[str]) -> DataFrame:
    """The forecasts of holt_winters by the fit of each series with the least squared error."""
    best = fitted.groupBy(*by).agg(F.min_by(F.struct("alpha", "beta", "gamma", "s"), F.struct("s.sse", "alpha", "beta", "gamma")).alias("b")).select(*by, "b.*")
    steps = best.select(*by, "alpha", "beta", "gamma", "s", F.explode(F.sequence(F.lit(1), F.lit(h))).alias("step"))
    season = F.element_at("s.seasons", (F.col("step") - 1) % max(1, m) + 1)
    return steps.select(*by, "alpha", "beta", "gamma", F.col("s.sse").alias("sse"), "step", (F.col("s.level") + F.col("step") * F.col("s.trend") + season).alias("yhat"))


def decompose(df: DataFrame, m: int, by: list[str], ts: str = "period", y: str = "y") -> DataFrame:
    """Adds trend (centred moving average over m), season (mean deviation of the phase, centred on 0), remainder."""
    w = in_order(by, ts)
    at = df.withColumn("__i", F.row_number().over(w) - 1)
    half = m // 2
    wide, inner = w.rowsBetween(-half, half), w.rowsBetween(-half + 1, half - 1)
    sums = (F.sum(y).over(wide) + F.sum(y).over(inner)) / (2 * m) if m % 2 == 0 else F.avg(y).over(wide)
    at = at.withColumn("trend", F.when(F.count(y).over(wide) == 2 * half + 1, sums)).withColumn("__phase", F.col("__i") % m)
    phases = at.groupBy(*by, "__phase").agg(F.avg(F.col(y) - F.col("trend")).alias("__s"))
    centred = phases.withColumn("season", F.col("__s") - F.avg("__s").over(Window.partitionBy(*(by or [F.lit(1)])))).drop("__s")
    return at.join(centred, [*by, "__phase"], "left").withColumn("remainder", F.col(y) - F.col("trend") - F.col("season")).drop("__i", "__phase")


def acf(df: DataFrame, most: int, by: list[str], ts: str = "period", y: str = "y") -> DataFrame:
    """by, lag 1 to `most`, acf with the mean and variance of the whole series."""
    means = df.groupBy(*by).agg(F.avg(y).alias("__m"))
    centred = (df.join(means, by) if by else df.crossJoin(F.broadcast(means))).withColumn("__c", F.col(y) - F.col("__m"))
    w = in_order(by, ts)
    products = centred.select(*by, "__c", *[(F.col("__c") * F.lag("__c", k).over(w)).alias(f"__{k}") for k in range(1, most + 1)])
    sums = products.groupBy(*by).agg(F.sum(F.col("__c") * F.col("__c")).alias("__v"), *[F.sum(f"__{k}").alias(f"__{k}") for k in range(1, most + 1)])
    return sums.select(*by, F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), ratio(F.col(f"__{k}"), F.col("__v")).alias("acf")) for k in range(1, most + 1)])).alias("x")).select(*by, "x.*")


def lag_regression(df: DataFrame, ks: list[int], by: list[str], train: Column, ts: str = "period", y: str = "y", reg: float = 0.0, calendar: tuple[str, ...] = ()) -> DataFrame:
    """df with lags and yhat of a linear fit on lags and calendar features of ts, fitted where `train` holds; rows without all lags are left out.

    calendar: names of calendar_features; month, day_of_week and hour count as kinds, a 0/1 column for each value but the first.
    """
    made = lags(df, y, ks, by, ts)
    ready = made.dropna(subset=[f"lag_{k}" for k in ks])
    own = {}
    for c in calendar:
        value = calendar_columns(ts)[c]
        own |= {f"__{c}_{k}": (value == k).cast("double") for k in KINDS[c]} if c in KINDS else {f"__{c}": value.cast("double")}
    ready = ready.withColumns(own)
    fitted = linear_fit(ready.where(train).dropna(subset=[y]), [*(f"lag_{k}" for k in ks), *own], y, reg)
    return fitted.transform(ready).withColumnRenamed("prediction", "yhat").drop("features", *own)


def backtest(df: DataFrame, forecaster: Callable[[DataFrame, int, list[str]], DataFrame], cuts: list[int], h: int, by: list[str], ts: str = "period", y: str = "y") -> DataFrame:
    """by, cut, step, y, yhat: forecasts of h steps from the first `cut` values of each series; all cuts run in one job."""
    placed = df.withColumn("__i", F.row_number().over(in_order(by, ts)))
    each = placed.withColumn("cut", F.explode(F.array(*map(F.lit, cuts))))
    known = each.where("__i <= cut").drop("__i")
    actual = each.where((F.col("__i") > F.col("cut")) & (F.col("__i") <= F.col("cut") + h)).select(*by, "cut", (F.col("__i") - F.col("cut")).alias("step"), F.col(y).alias("y"))
    return actual.join(forecaster(known, h, [*by, "cut"]), [*by, "cut", "step"])


def forecast_metrics(df: DataFrame, by: list[str], scale: DataFrame | None = None) -> DataFrame:
    """n, mae, rmse, smape (in percent) per key, and mase by scale (columns `on` and scale), if given."""
    e = F.abs(F.col("y") - F.col("yhat"))
    out = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(e).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (200 * F.avg(ratio(e, F.abs("y") + F.abs("yhat")))).alias("smape"))
    if scale is None:
        return out
    on = [c for c in scale.columns if c != "scale"]
    whole = out.join(scale, on) if on else out.crossJoin(F.broadcast(scale))
    return whole.withColumn("mase", ratio(F.col("mae"), F.col("scale"))).drop("scale")


def seasonal_scale(df: DataFrame, m: int, by: list[str], ts: str = "period", y: str = "y") -> DataFrame:
    """by, scale: the mean absolute difference to one season before, within the sample."""
    return lags(df, y, [m], by, ts).groupBy(*by).agg(F.avg(F.abs(f"diff_{m}")).alias("scale"))


def residual_interval(forecast: DataFrame, backtested: DataFrame, levels: tuple[float, float], by: list[str]) -> DataFrame:
    """forecast with low and high: yhat and percentiles of the backtest's residuals at the same step."""
    r = quantiles(backtested.withColumn("__e", F.col("y") - F.col("yhat")), "__e", list(levels), [*by, "step"])
    told = with_stats(forecast, r, [*by, "step"], "inner")
    return told.withColumns({"low": F.col("yhat") + F.col("q")[0], "high": F.col("yhat") + F.col("q")[1]}).drop("q")
