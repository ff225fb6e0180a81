"""Registered queries of forecasts, and of word counts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.columns import hash_number, money, rounded, uniform
from quarry.operators import corpus, forecast
from quarry.plans.registry import query
from quarry.sources.tables import table

BY = ["o_orderpriority"]


def monthly(spark: SparkSession, d: str) -> DataFrame:
    """Order sums per priority and whole month."""
    orders = table(spark, d, "orders").select("o_orderpriority", "o_orderdate", "o_totalprice")
    return forecast.resample(orders, "o_orderdate", "month", {"y": F.sum(money("o_totalprice")).cast("double")}, BY, partial=False)


def counts(spark: SparkSession, d: str) -> DataFrame:
    """Orders per whole month, as one series."""
    orders = table(spark, d, "orders").select("o_orderdate")
    return forecast.resample(orders, "o_orderdate", "month", {"y": F.count("*").cast("double")}, partial=False)


M_SQL = """WITH m0 AS (SELECT o_orderpriority, date_trunc('month', o_orderdate)::DATE AS period, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS y FROM orders GROUP BY ALL),
m AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY period) AS i, count(*) OVER (PARTITION BY o_orderpriority) AS len FROM m0 WHERE period > (SELECT min(period) FROM m0) AND period < (SELECT max(period) FROM m0)),
c0 AS (SELECT date_trunc('month', o_orderdate)::DATE AS period, count(*)::DOUBLE AS y FROM orders GROUP BY 1),
c AS (SELECT *, row_number() OVER (ORDER BY period) AS i FROM c0 WHERE period > (SELECT min(period) FROM c0) AND period < (SELECT max(period) FROM c0))
"""


@query(M_SQL + "SELECT o_orderpriority, period, y FROM m")
def ts01_resample(spark: SparkSession, d: str) -> DataFrame:
    return monthly(spark, d)


@query("""WITH c AS (SELECT o_orderdate::DATE AS period, count(*)::DOUBLE AS n FROM orders GROUP BY 1),
g AS (SELECT unnest(generate_series(min(period), max(period), INTERVAL 1 DAY))::DATE AS period FROM c)
SELECT g.period, coalesce(n, 0) AS zero, last_value(n IGNORE NULLS) OVER (ORDER BY g.period) AS last,
round(coalesce(n, p.a + (q.b - p.a) * date_diff('day', p.at, g.period) / date_diff('day', p.at, q.bt)), 4) AS linear
FROM g LEFT JOIN c USING (period), LATERAL (SELECT max(x.period) AS at, arg_max(x.n, x.period) AS a FROM c x WHERE x.period <= g.period) p, LATERAL (SELECT min(x.period) AS bt, arg_min(x.n, x.period) AS b FROM c x WHERE x.period >= g.period) q""")
def ts02_fill_gaps(spark: SparkSession, d: str) -> DataFrame:
    days = forecast.resample(table(spark, d, "orders").select("o_orderdate"), "o_orderdate", "day", {"n": F.count("*").cast("double")})
    made = [forecast.fill_gaps(days, "period", "1 day", how, [], "n").withColumnRenamed("n", how) for how in ("zero", "last", "linear")]
    return rounded(made[0].join(made[1], "period").join(made[2], "period"))


@query(M_SQL + "SELECT o_orderpriority, period, y, i > len - 12 AS is_test FROM m")
def ts03_time_split(spark: SparkSession, d: str) -> DataFrame:
    return forecast.time_split(monthly(spark, d), "period", h=12, by=BY)


@query(M_SQL + "SELECT o_orderpriority, period, lag(y, 1) OVER w AS lag_1, lag(y, 12) OVER w AS lag_12, round(y - lag(y, 1) OVER w, 2) AS diff_1, round(y - lag(y, 12) OVER w, 2) AS diff_12 FROM m WINDOW w AS (PARTITION BY o_orderpriority ORDER BY period)")
def ts04_lags(spark: SparkSession, d: str) -> DataFrame:
    return rounded(forecast.lags(monthly(spark, d), "y", [1, 12], BY, "period").drop("y"), 2)


@query(M_SQL + "SELECT o_orderpriority, period, round(avg(y) OVER w, 4) AS roll_mean, round(stddev_samp(y) OVER w, 4) AS roll_std, round(min(y) OVER w, 4) AS roll_min, round(max(y) OVER w, 4) AS roll_max FROM m WINDOW w AS (PARTITION BY o_orderpriority ORDER BY period ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)")
def ts05_rolling(spark: SparkSession, d: str) -> DataFrame:
    return rounded(forecast.rolling(monthly(spark, d), "y", 6, BY, "period").drop("y"), 4)


@query(M_SQL + """, s AS (SELECT o_orderpriority, arg_max(y, period) AS l, arg_min(y, period) AS f, avg(y) AS a, count(*) AS n FROM m GROUP BY 1), h AS (SELECT unnest(range(1, 7))::INT AS step)
SELECT 'naive' AS how, o_orderpriority, step, round(l, 2) AS yhat FROM s, h UNION ALL SELECT 'drift', o_orderpriority, step, round(l + step * (l - f) / (n - 1), 2) FROM s, h UNION ALL SELECT 'mean', o_orderpriority, step, round(a, 2) FROM s, h""")
def ts06_simple_forecast(spark: SparkSession, d: str) -> DataFrame:
    made = [forecast.simple_forecast(monthly(spark, d), how, 6, BY).withColumn("how", F.lit(how)) for how in ("naive", "drift", "mean")]
    return rounded(made[0].unionByName(made[1]).unionByName(made[2]), 2)


@query(M_SQL + "SELECT o_orderpriority, step::INT AS step, y AS yhat FROM m, unnest(range(1, 19)) h(step) WHERE i = len - 12 + 1 + (step - 1) % 12")
def ts07_seasonal_naive(spark: SparkSession, d: str) -> DataFrame:
    return forecast.seasonal_naive(monthly(spark, d), 12, 18, BY)


@query("""WITH RECURSIVE """ + M_SQL[5:] + """, a(alpha) AS (VALUES (0.1::DOUBLE), (0.3::DOUBLE), (0.6::DOUBLE)),
f AS (SELECT o_orderpriority, alpha, i, y AS level, 0.0::DOUBLE AS sse FROM m, a WHERE i = 1 UNION ALL SELECT f.o_orderpriority, f.alpha, m.i, f.level + f.alpha * (m.y - f.level), f.sse + (m.y - f.level) ** 2 FROM f JOIN m ON m.o_orderpriority = f.o_orderpriority AND m.i = f.i + 1),
e AS (SELECT f.* FROM f JOIN (SELECT o_orderpriority, max(i) AS i FROM m GROUP BY 1) USING (o_orderpriority, i))
SELECT o_orderpriority, arg_min(alpha, (sse, alpha)) AS alpha, round(arg_min(level, (sse, alpha)), 2) AS level, step::INT AS step, round(arg_min(level, (sse, alpha)), 2) AS yhat FROM e, unnest(range(1, 4)) h(step) GROUP BY o_orderpriority, step""")
def ts08_ses(spark: SparkSession, d: str) -> DataFrame:
    return rounded(forecast.ses(monthly(spark, d), [0.1, 0.3, 0.6], 3, BY).drop("sse"), 2)


@query("""WITH RECURSIVE """ + M_SQL[5:] + """,
f AS (SELECT a.o_orderpriority, 1 AS i, a.y AS level, b.y - a.y AS trend FROM m a JOIN m b USING (o_orderpriority) WHERE a.i = 1 AND b.i = 2
UNION ALL SELECT o_orderpriority, i, level, 0.1 * (level - old) + 0.9 * trend FROM (SELECT f.o_orderpriority, m.i, 0.3 * m.y + 0.7 * (f.level + f.trend) AS level, f.level AS old, f.trend FROM f JOIN m ON m.o_orderpriority = f.o_orderpriority AND m.i = f.i + 1)),
e AS (SELECT f.* FROM f JOIN (SELECT o_orderpriority, max(i) AS i FROM m GROUP BY 1) USING (o_orderpriority, i))
SELECT o_orderpriority, step::INT AS step, round(level + step * trend, 2) AS yhat FROM e, unnest(range(1, 7)) h(step)""")
def ts09_holt(spark: SparkSession, d: str) -> DataFrame:
    return rounded(forecast.holt_winters(monthly(spark, d), 1, [(0.3, 0.1, 0.0)], 6, BY).select("o_orderpriority", "step", "yhat"), 2)


def season(spark: SparkSession, d: str) -> DataFrame:
    """The planted season (80 months), one series for each order priority in the table; for tests."""
    keys = table(spark, d, "orders").select("o_orderpriority").distinct()
    i = F.col("period")
    y = 100 + 0.1 * i + 10 * F.sin(i * (2 * math.pi / 12)) + uniform(i, "s")
    return keys.select("o_orderpriority", F.explode(F.sequence(F.lit(0), F.lit(79))).alias("period")).withColumn("y", y)


HW = (0.3, 0.1, 0.2)


@query("""WITH RECURSIVE """ + M_SQL[5:] + """,
z AS (SELECT o_orderpriority, avg(y) FILTER (i <= 12) AS l0, (avg(y) FILTER (i > 12 AND i <= 24) - avg(y) FILTER (i <= 12)) / 12 AS t0, list(y ORDER BY i) AS v FROM m GROUP BY 1),
f AS (SELECT o_orderpriority, 12 AS i, l0 AS level, t0 AS trend, list_transform(v[1:12], lambda x: x - l0) AS s, v FROM z
UNION ALL SELECT o_orderpriority, i + 1, nl, 0.1 * (nl - level) + 0.9 * trend, list_append(s[2:], 0.2 * (v[i + 1] - nl) + 0.8 * s[1]), v FROM (SELECT *, 0.3 * (v[i + 1] - s[1]) + 0.7 * (level + trend) AS nl FROM f WHERE i < len(v))),
e AS (SELECT o_orderpriority, arg_max(level, i) AS level, arg_max(trend, i) AS trend, arg_max(s, i) AS s FROM f GROUP BY 1)
SELECT o_orderpriority, step::INT AS step, round(level + step * trend + s[((step - 1) % 12 + 1)::INT], 2) AS yhat FROM e, unnest(range(1, 19)) h(step)""")
def ts09c_holt_winters_fixed(spark: SparkSession, d: str) -> DataFrame:
    """Holt-Winters with fixed parameters on the monthly order sums."""
    return rounded(forecast.holt_winters(monthly(spark, d), 12, [HW], 18, BY).select("o_orderpriority", "step", "yhat"), 2)


@query()
def ts09b_holt_winters(spark: SparkSession, d: str) -> DataFrame:
    """Holt-Winters, grid-fitted, on the monthly order sums: errors of a backtest."""
    return holt_winters_errors(monthly(spark, d))


def holt_winters_errors(df: DataFrame) -> DataFrame:
    grid = [(a, b, g) for a in (0.1, 0.3) for b in (0.01, 0.1) for g in (0.1, 0.3)]
    tested = forecast.backtest(df, lambda x, h, by: forecast.holt_winters(x, 12, grid, h, by).select(*by, "step", "yhat"), [56, 64], 12, BY)
    return forecast.forecast_metrics(tested, [*BY, "cut"])


@query(M_SQL + """, t AS (SELECT *, CASE WHEN count(*) OVER w = 13 THEN (sum(y) OVER w + sum(y) OVER v) / 24 END AS trend, (i - 1) % 12 AS ph FROM m WINDOW w AS (PARTITION BY o_orderpriority ORDER BY period ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING), v AS (PARTITION BY o_orderpriority ORDER BY period ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)),
s AS (SELECT o_orderpriority, ph, avg(y - trend) AS s0 FROM t GROUP BY ALL), z AS (SELECT o_orderpriority, ph, s0 - avg(s0) OVER (PARTITION BY o_orderpriority) AS season FROM s)
SELECT o_orderpriority, period, round(trend, 4) AS trend, round(season, 4) AS season, round(y - trend - season, 4) AS remainder FROM t JOIN z USING (o_orderpriority, ph)""")
def ts10_decompose(spark: SparkSession, d: str) -> DataFrame:
    return rounded(forecast.decompose(monthly(spark, d), 12, BY).drop("y"), 4)


@query(M_SQL + """, x AS (SELECT *, y - avg(y) OVER (PARTITION BY o_orderpriority) AS c FROM m)
SELECT a.o_orderpriority, k::INT AS lag, round(sum(a.c * b.c) / any_value(v), 4) AS acf FROM x a JOIN unnest(range(1, 13)) h(k) ON true JOIN x b ON a.o_orderpriority = b.o_orderpriority AND a.i = b.i + k JOIN (SELECT o_orderpriority, sum(c * c) AS v FROM x GROUP BY 1) q ON q.o_orderpriority = a.o_orderpriority GROUP BY ALL""")
def ts11_acf(spark: SparkSession, d: str) -> DataFrame:
    return rounded(forecast.acf(monthly(spark, d), 12, BY))


@query(M_SQL + """, x AS (SELECT *, lag(y) OVER (PARTITION BY o_orderpriority ORDER BY period) AS a, i > len - 18 AS is_test FROM m),
s AS (SELECT regr_slope(y, a) AS b, regr_intercept(y, a) AS c FROM x WHERE NOT is_test AND a IS NOT NULL)
SELECT o_orderpriority, period, round(c + b * a, 2) AS yhat FROM x, s WHERE a IS NOT NULL""")
def ts12b_lag_regression_values(spark: SparkSession, d: str) -> DataFrame:
    """Fitted values of the regression on one lag, fitted before the last 18 months."""
    split = forecast.time_split(monthly(spark, d), "period", h=18, by=BY)
    return rounded(forecast.lag_regression(split, [1], BY, ~F.col("is_test")).select(*BY, "period", "yhat"), 2)


@query()
def ts12_lag_regression(spark: SparkSession, d: str) -> DataFrame:
    """One-step errors of the monthly order sums in the last 18 months, of the regression and of the seasonal naive forecast."""
    split = forecast.time_split(monthly(spark, d), "period", h=18, by=BY)
    return lag_regression_errors(split, ~F.col("is_test"), F.col("is_test"), ("year", "month"))


def lag_regression_errors(df: DataFrame, train: Column, test: Column, calendar: tuple[str, ...] = ()) -> DataFrame:
    made = forecast.lag_regression(df, [1, 12], BY, train, calendar=calendar).where(test)
    both = made.select(*BY, F.lit("regression").alias("model"), "y", "yhat").unionByName(made.select(*BY, F.lit("seasonal naive").alias("model"), "y", F.col("lag_12").alias("yhat")))
    return forecast.forecast_metrics(both, [*BY, "model"])


CUTS = [48, 54, 60]


def tested(spark: SparkSession, d: str) -> DataFrame:
    return forecast.backtest(counts(spark, d), lambda x, h, by: forecast.seasonal_naive(x, 12, h, by), CUTS, 12, [])


B_SQL = M_SQL + ", k(cut) AS (VALUES (48), (54), (60)), b AS (SELECT k.cut::INT AS cut, (t.i - k.cut)::INT AS step, t.y, f.y AS yhat FROM k JOIN c t ON t.i > k.cut AND t.i <= k.cut + 12 JOIN c f ON f.i = t.i - 12)\n"


@query(B_SQL + "SELECT cut, step, y, yhat FROM b")
def ts13_backtest(spark: SparkSession, d: str) -> DataFrame:
    return tested(spark, d)


@query(B_SQL + "SELECT cut, count(*) AS n, round(avg(abs(y - yhat)), 4) AS mae, round(sqrt(avg((y - yhat) ** 2)), 4) AS rmse, round(200 * avg(abs(y - yhat) / (abs(y) + abs(yhat))), 4) AS smape, round(avg(abs(y - yhat)) / (SELECT avg(abs(a.y - z.y)) FROM c a JOIN c z ON a.i = z.i + 12 WHERE a.i <= b.cut), 4) AS mase FROM b GROUP BY 1")
def ts14_forecast_metrics(spark: SparkSession, d: str) -> DataFrame:
    placed = counts(spark, d).withColumn("i", F.row_number().over(Window.orderBy("period")))  # a row per month
    samples = placed.withColumn("cut", F.explode(F.array(*map(F.lit, CUTS)))).where("i <= cut")
    return rounded(forecast.forecast_metrics(tested(spark, d), ["cut"], forecast.seasonal_scale(samples, 12, ["cut"])))


@query(B_SQL + ", f AS (SELECT (i - (SELECT max(i) FROM c) + 12)::INT AS step, y AS yhat FROM c WHERE i > (SELECT max(i) FROM c) - 12) SELECT step, f.yhat, round(f.yhat + quantile_cont(b.y - b.yhat, 0.1), 4) AS low, round(f.yhat + quantile_cont(b.y - b.yhat, 0.9), 4) AS high FROM f JOIN b USING (step) GROUP BY step, f.yhat")
def ts15_residual_interval(spark: SparkSession, d: str) -> DataFrame:
    return rounded(forecast.residual_interval(forecast.seasonal_naive(counts(spark, d), 12, 12, []), tested(spark, d), (0.1, 0.9), []))


W_SQL = r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '\p{L}+') AS w FROM documents),
g AS (SELECT doc_id, list_zip(w[:-2], w[2:]) AS g FROM w WHERE len(w) >= 2), u AS (SELECT doc_id, unnest(g) AS p FROM g), r AS (SELECT doc_id, p[1] AS w0, p[2] AS w1 FROM u)
"""


@query(W_SQL + "SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM w) GROUP BY 1")
def lm01_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return corpus.vocabulary(table(spark, d, "documents"), "text")


@query(W_SQL + "SELECT w0, w1, count(*) AS n FROM r GROUP BY ALL")
def lm02_ngrams(spark: SparkSession, d: str) -> DataFrame:
    return corpus.ngrams(table(spark, d, "documents"), "doc_id", "text", 2)


@query(W_SQL + ", c AS (SELECT w0, w1, count(*) AS n FROM r GROUP BY ALL) SELECT w0, w1, round((n + 0.1) / (sum(n) OVER (PARTITION BY w0) + 0.1 * (SELECT count(DISTINCT x) + 1 FROM (SELECT unnest(w) AS x FROM w))), 8) AS p FROM c")
def lm03_bigram_model(spark: SparkSession, d: str) -> DataFrame:
    return rounded(corpus.probabilities(corpus.bigram_model(table(spark, d, "documents"), "doc_id", "text", 0.1), 0.1), 8)


FOLD = "(('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 5)"


@query(W_SQL + f""", c AS (SELECT w0, w1, count(*) AS n FROM r WHERE {FOLD} <> 0 GROUP BY ALL), f AS (SELECT w0, sum(n) AS n0 FROM c GROUP BY 1),
v AS (SELECT count(DISTINCT x) + 1 AS v FROM (SELECT unnest(w) AS x FROM w WHERE {FOLD} <> 0))
SELECT doc_id, count(*) AS n_bigrams, round(exp(-avg(ln((coalesce(n, 0) + 0.1) / (coalesce(n0, 0) + 0.1 * v)))), 2) AS perplexity FROM r LEFT JOIN c USING (w0, w1) LEFT JOIN f USING (w0), v WHERE {FOLD} = 0 GROUP BY 1""")
def lm04_perplexity(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("fold", hash_number("doc_id") % 5)
    model = corpus.bigram_model(docs.where("fold <> 0"), "doc_id", "text", 0.1)
    return rounded(corpus.perplexity(docs.where("fold = 0"), "doc_id", "text", model, 0.1), 2)
