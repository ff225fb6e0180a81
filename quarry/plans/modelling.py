"""Registered queries of regression, segments, rules and anomalies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.columns import rounded, uniform
from quarry.operators import anomaly, automl, regression, rules, segments
from quarry.plans.registry import query
from quarry.sources.tables import table, tables

LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
FOLD = "('0x' || substr(md5({0}::VARCHAR), 1, 8))::BIGINT % 5"
U = "(('0x' || substr(md5({0}::VARCHAR || '{1}'), 1, 8))::BIGINT / 4294967296.0)"


@query("SELECT event_id, year(ts) AS year, month(ts) AS month, isodow(ts) AS day_of_week, hour(ts) AS hour, isodow(ts) >= 6 AS is_weekend FROM events")
def rg01_calendar_features(spark: SparkSession, d: str) -> DataFrame:
    return regression.calendar_features(table(spark, d, "events").select("event_id", "ts"), "ts").drop("ts")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, date_diff('day', o_orderdate, l_shipdate) AS elapsed, l_shipdate < o_orderdate AS is_negative
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def rg02_duration(spark: SparkSession, d: str) -> DataFrame:
    line, orders = tables(spark, d, "lineitem", "orders")
    both = line.join(orders.select("o_orderkey", "o_orderdate"), line.l_orderkey == orders.o_orderkey)
    return regression.duration(both, "o_orderdate", "l_shipdate").select(*LINE, "elapsed", "is_negative")


@query(f"SELECT o_orderkey, ({FOLD.format('o_orderkey')})::INT AS fold FROM orders")
def rg03_hash_split(spark: SparkSession, d: str) -> DataFrame:
    return regression.hash_split(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 5)


@query("""SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
round(regr_r2(l_extendedprice, l_quantity), 4) AS r2, count(*) AS n FROM lineitem GROUP BY 1""")
def rg04_ols(spark: SparkSession, d: str) -> DataFrame:
    return rounded(regression.ols(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"]))


def exact_line(spark: SparkSession, d: str) -> DataFrame:
    """lineitem with a label that is a plane, one with a step and noise, and a test mark."""
    y = 5 + 3 * F.col("l_quantity") - 100 * F.col("l_discount") + 40 * F.col("l_tax")
    line = table(spark, d, "lineitem").withColumn("y", y).withColumn("flag_r", (F.col("l_returnflag") == "R").cast("double"))
    return line.withColumn("noisy", F.col("y") + 50 * F.col("flag_r") + uniform(F.col("l_extendedprice"), "n")).withColumn("is_test", F.col("l_orderkey") % 5 == 0)


XS = ["l_quantity", "l_discount", "l_tax"]


@query("SELECT * FROM (VALUES ('l_quantity', 3.0::DOUBLE), ('l_discount', -100.0), ('l_tax', 40.0), ('intercept', 5.0)) t(term, coefficient)")
def rg05_linear_fit(spark: SparkSession, d: str) -> DataFrame:
    fitted = regression.linear_fit(exact_line(spark, d), XS, "y").stages[-1]
    rows = [*zip(XS, map(float, fitted.coefficients), strict=True), ("intercept", float(fitted.intercept))]
    return rounded(spark.createDataFrame(rows, "term string, coefficient double"))


@query("""WITH s AS (SELECT covar_pop(l_extendedprice, l_quantity) AS xy, var_pop(l_quantity) AS xx, stddev_pop(l_extendedprice) AS sy, avg(l_quantity) AS mx, avg(l_extendedprice) AS my FROM lineitem),
r AS (SELECT xy / (xx + 5000.0 / sy * xx) AS slope, mx, my FROM s) SELECT 'l_quantity' AS term, round(slope, 4) AS coefficient FROM r UNION ALL SELECT 'intercept', round(my - slope * mx, 4) FROM r""")
def rg05b_ridge(spark: SparkSession, d: str) -> DataFrame:
    """Price on quantity with a penalty of 5000 on the standardised column."""
    fitted = regression.linear_fit(table(spark, d, "lineitem"), ["l_quantity"], "l_extendedprice", 5000.0).stages[-1]
    rows = [("l_quantity", float(fitted.coefficients[0])), ("intercept", float(fitted.intercept))]
    return rounded(spark.createDataFrame(rows, "term string, coefficient double"))


@query()
def rg06_tree_fit(spark: SparkSession, d: str) -> DataFrame:
    rows = exact_line(spark, d)
    model = regression.tree_fit(rows.where("NOT is_test"), [*XS, "flag_r"], "noisy")
    return regression.regression_metrics(model.transform(rows.where("is_test")), "noisy", "prediction")


def baseline(spark: SparkSession, d: str) -> DataFrame:
    line, part = tables(spark, d, "lineitem", "part")
    both = regression.hash_split(line.join(part, line.l_partkey == part.p_partkey), "l_orderkey", 5)
    return regression.mean_baseline(both.where("fold <> 0"), both.where("fold = 0"), ["p_brand"], "l_extendedprice")


BASE_SQL = f"""WITH l AS (SELECT *, {FOLD.format('l_orderkey')} AS fold FROM lineitem JOIN part ON l_partkey = p_partkey),
g AS (SELECT p_brand, avg(l_extendedprice) AS m FROM l WHERE fold <> 0 GROUP BY 1),
b AS (SELECT l.*, coalesce(m, (SELECT avg(l_extendedprice) FROM l WHERE fold <> 0)) AS yhat, l_extendedprice AS y FROM l LEFT JOIN g USING (p_brand) WHERE fold = 0)
"""


@query(BASE_SQL + "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, p_brand, round(yhat, 4) AS yhat FROM b")
def rg07_mean_baseline(spark: SparkSession, d: str) -> DataFrame:
    return rounded(baseline(spark, d).select(*LINE, "p_brand", "yhat"))


METRICS = "count(*) AS n, round(avg(abs(y - yhat)), 4) AS mae, round(sqrt(avg((y - yhat) ** 2)), 4) AS rmse, round(1 - sum((y - yhat) ** 2) / nullif(var_pop(y) * count(*), 0), 4) AS r2, round(avg(abs((y - yhat) / nullif(y, 0))), 4) AS mape, count(*) FILTER (y = 0) AS n_zero"


@query(BASE_SQL + f"SELECT {METRICS} FROM b")
def rg08_regression_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(regression.regression_metrics(baseline(spark, d), "l_extendedprice", "yhat"))


@query(BASE_SQL + f"SELECT p_type, {METRICS}, round(sum((y - yhat) ** 2) / (SELECT sum((y - yhat) ** 2) FROM b), 4) AS error_share FROM b GROUP BY 1")
def rg09_error_slices(spark: SparkSession, d: str) -> DataFrame:
    return rounded(regression.error_slices(baseline(spark, d), "l_extendedprice", "yhat", ["p_type"]))


RFM_SQL = """WITH r AS (SELECT o_custkey, date_diff('day', max(o_orderdate)::DATE, DATE '2001-09-01') AS recency, count(*) AS frequency, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS monetary FROM orders WHERE o_orderdate::DATE <= DATE '2001-09-01' GROUP BY 1)
"""
SCORED_SQL = RFM_SQL + f", q AS (SELECT quantile_cont(recency, [0.2, 0.4, 0.6, 0.8]) AS qr, quantile_cont(frequency, [0.2, 0.4, 0.6, 0.8]) AS qf, quantile_cont(monetary, [0.2, 0.4, 0.6, 0.8]) AS qm FROM r), s AS (SELECT r.*, {', '.join(f'(1 + len(list_filter({q}, lambda c: c < {c})))::INT AS {c}_score' for q, c in (('qr', 'recency'), ('qf', 'frequency'), ('qm', 'monetary')))} FROM r, q)\n"
RFM = ["recency", "frequency", "monetary"]


def customers(spark: SparkSession, d: str) -> DataFrame:
    return segments.rfm(table(spark, d, "orders"), "o_custkey", "o_orderdate", "o_totalprice", "2001-09-01")


@query(RFM_SQL + "SELECT * FROM r")
def sg01_rfm(spark: SparkSession, d: str) -> DataFrame:
    return customers(spark, d)


@query(SCORED_SQL + "SELECT * FROM s")
def sg02_quantile_score(spark: SparkSession, d: str) -> DataFrame:
    return segments.quantile_score(customers(spark, d), RFM)


RULES = [("champions", "recency_score <= 2 AND frequency_score >= 4 AND monetary_score >= 4"), ("loyal", "frequency_score >= 4"), ("recent", "recency_score <= 2"), ("lapsed", "recency_score >= 4")]


@query(SCORED_SQL + "SELECT segment, count(*) AS n FROM (SELECT CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, c in RULES) + " ELSE 'other' END AS segment FROM s) GROUP BY 1")
def sg03_label_segments(spark: SparkSession, d: str) -> DataFrame:
    return segments.label_segments(segments.quantile_score(customers(spark, d), RFM), RULES).groupBy("segment").agg(F.count("*").alias("n"))


@query(RFM_SQL + "SELECT o_custkey, " + ", ".join(f"round(({c} - (SELECT median({c}) FROM r)) / (SELECT quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) FROM r), 4) AS {c}_std" for c in RFM) + " FROM r")
def sg04_standardize(spark: SparkSession, d: str) -> DataFrame:
    return rounded(segments.standardize(customers(spark, d), RFM, "robust").select("o_custkey", *[f"{c}_std" for c in RFM]))


@query(RFM_SQL + "SELECT o_custkey, " + ", ".join(f"round(({c} - (SELECT avg({c}) FROM r)) / (SELECT stddev_samp({c}) FROM r), 4) AS {c}_z, round(({c} - (SELECT min({c}) FROM r)) / (SELECT max({c}) - min({c}) FROM r), 4) AS {c}_minmax" for c in RFM) + " FROM r")
def sg04b_standardize_z_minmax(spark: SparkSession, d: str) -> DataFrame:
    made = segments.standardize(customers(spark, d), RFM, "z").withColumnsRenamed({f"{c}_std": f"{c}_z" for c in RFM})
    made = segments.standardize(made, RFM, "minmax").withColumnsRenamed({f"{c}_std": f"{c}_minmax" for c in RFM})
    return rounded(made.select("o_custkey", *[f"{c}_{how}" for c in RFM for how in ("z", "minmax")]))


def blobs(spark: SparkSession, d: str) -> DataFrame:
    g = F.col("c_custkey") % 3
    return table(spark, d, "customer").select("c_custkey", g.alias("g"), (10 * (g == 1).cast("double") + uniform("c_custkey", "x")).alias("x"), (10 * (g == 2).cast("double") + uniform("c_custkey", "y")).alias("y"))


@query("SELECT c_custkey % 3 AS g, count(*) AS n, 1.0::DOUBLE AS purity FROM customer GROUP BY 1")
def sg05_kmeans_fit(spark: SparkSession, d: str) -> DataFrame:
    made = segments.kmeans_fit(blobs(spark, d), ["x", "y"], 3).transform(blobs(spark, d))
    return segments.cluster_purity(made, "prediction", "g").select("g", "n", "purity")


CENTROIDS = [[10.0, 20000.0], [25.0, 50000.0], [40.0, 80000.0]]
NEAR_SQL = "WITH c(cluster, a, b) AS (VALUES (0, 10.0::DOUBLE, 20000.0::DOUBLE), (1, 25.0, 50000.0), (2, 40.0, 80000.0)), n AS (SELECT l.*, arg_min(cluster, ((l_quantity - a) ** 2 + (l_extendedprice - b) ** 2, cluster))::INT AS cluster, sqrt(min((l_quantity - a) ** 2 + (l_extendedprice - b) ** 2)) AS distance FROM lineitem l, c GROUP BY ALL)\n"


def near(spark: SparkSession, d: str) -> DataFrame:
    return segments.assign_centroid(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"], CENTROIDS)


@query(NEAR_SQL + "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, cluster, round(distance, 4) AS distance FROM n")
def sg06_assign_centroid(spark: SparkSession, d: str) -> DataFrame:
    return rounded(near(spark, d).select(*LINE, "cluster", "distance"))


@query()
def sg07_kmeans_sweep(spark: SparkSession, d: str) -> DataFrame:
    return segments.kmeans_sweep(blobs(spark, d), ["x", "y"], [2, 3, 4, 5])


@query("SELECT c_custkey % 3 AS g, count(*) AS n, 1.0::DOUBLE AS purity FROM customer GROUP BY 1")
def sg08_cluster_fit(spark: SparkSession, d: str) -> DataFrame:
    made = segments.cluster_fit(blobs(spark, d), ["x", "y"], "bisecting", 3).transform(blobs(spark, d))
    return segments.cluster_purity(made, "prediction", "g").select("g", "n", "purity")


@query("SELECT c_custkey % 3 AS g, count(*) AS n, 1.0::DOUBLE AS purity FROM customer GROUP BY 1")
def sg08b_mixture_fit(spark: SparkSession, d: str) -> DataFrame:
    """A Gaussian mixture of the same rows."""
    made = segments.cluster_fit(blobs(spark, d), ["x", "y"], "mixture", 3).transform(blobs(spark, d))
    return segments.cluster_purity(made, "prediction", "g").select("g", "n", "purity")


@query(NEAR_SQL + " UNION ALL ".join(f"SELECT cluster, count(*) AS size, round(count(*) / (SELECT count(*) FROM n), 4) AS share, '{c}' AS feature, round(avg({c}), 4) AS mean, round(median({c}), 4) AS median, round(avg({c}) / (SELECT avg({c}) FROM n), 4) AS lift FROM n GROUP BY 1" for c in ("l_quantity", "l_extendedprice")))
def sg09_cluster_profile(spark: SparkSession, d: str) -> DataFrame:
    return rounded(segments.cluster_profile(near(spark, d), "cluster", ["l_quantity", "l_extendedprice"]))


@query(NEAR_SQL + "SELECT cluster, l_returnflag, n, round(max(n) OVER (PARTITION BY cluster) / sum(n) OVER (PARTITION BY cluster), 4) AS purity FROM (SELECT cluster, l_returnflag, count(*) AS n FROM n GROUP BY ALL)")
def sg10_cluster_purity(spark: SparkSession, d: str) -> DataFrame:
    return rounded(segments.cluster_purity(near(spark, d), "cluster", "l_returnflag"))


def basket_lines(spark: SparkSession, d: str) -> DataFrame:
    line, part = tables(spark, d, "lineitem", "part")
    return line.join(part, line.l_partkey == part.p_partkey).select("l_orderkey", "p_name")


AR_SQL = """WITH t AS (SELECT DISTINCT l_orderkey AS tx, p_name AS item FROM lineitem JOIN part ON l_partkey = p_partkey),
m AS (SELECT count(DISTINCT tx) AS n_tx, ceil(0.003 * count(DISTINCT tx)) AS least FROM t),
i AS (SELECT item, count(*) AS n, count(*) / (SELECT n_tx FROM m) AS support FROM t GROUP BY 1 HAVING count(*) >= (SELECT least FROM m)),
p AS (SELECT x.item AS a, y.item AS b, count(*) AS n, count(*) / (SELECT n_tx FROM m) AS support FROM t x JOIN t y ON x.tx = y.tx AND x.item < y.item GROUP BY ALL HAVING count(*) >= (SELECT least FROM m)),
r AS (SELECT antecedent, consequent, r.n, r.support, r.support / l.support AS confidence, r.support / (l.support * c.support) AS lift, r.support - l.support * c.support AS leverage, (1 - c.support) / nullif(1 - r.support / l.support, 0) AS conviction
  FROM (SELECT a AS antecedent, b AS consequent, n, support FROM p UNION ALL SELECT b, a, n, support FROM p) r JOIN i l ON l.item = antecedent JOIN i c ON c.item = consequent)
"""
LEAST = 0.003


@query(AR_SQL + "SELECT tx, array_to_string(list_sort(list(item)), '|') AS items, count(*) AS size FROM t GROUP BY 1")
def ar01_baskets(spark: SparkSession, d: str) -> DataFrame:
    return rules.baskets(basket_lines(spark, d), "l_orderkey", "p_name").withColumn("items", F.array_join("items", "|"))


@query(AR_SQL + "SELECT item, n, round(support, 6) AS support FROM i")
def ar02_item_support(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rules.item_support(basket_lines(spark, d), "l_orderkey", "p_name", LEAST), 6)


@query(AR_SQL + "SELECT a, b, n, round(support, 6) AS support FROM p")
def ar03_pair_support(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rules.pair_support(basket_lines(spark, d), "l_orderkey", "p_name", LEAST), 6)


@query(AR_SQL + "SELECT antecedent, consequent, n, round(support, 6) AS support, round(confidence, 6) AS confidence, round(lift, 6) AS lift, round(leverage, 6) AS leverage, round(conviction, 6) AS conviction FROM r")
def ar04_pair_rules(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rules.pair_rules(basket_lines(spark, d), "l_orderkey", "p_name", LEAST), 6)


@query(AR_SQL + """, z AS (SELECT x.item AS a, y.item AS b, w.item AS c, count(*) AS n FROM t x JOIN t y ON x.tx = y.tx AND x.item < y.item JOIN t w ON w.tx = x.tx AND y.item < w.item GROUP BY ALL HAVING count(*) >= (SELECT least FROM m))
SELECT item AS items, 1 AS size, n, round(support, 6) AS support FROM i UNION ALL SELECT a || '|' || b, 2, n, round(support, 6) FROM p UNION ALL SELECT a || '|' || b || '|' || c, 3, n, round(n / (SELECT n_tx FROM m), 6) FROM z""")
def ar05_frequent_itemsets(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rules.frequent_itemsets(basket_lines(spark, d), "l_orderkey", "p_name", LEAST).withColumn("items", F.array_join("items", "|")), 6)


Z_SQL = """, z AS (SELECT x.item AS a, y.item AS b, w.item AS c, count(*) AS n, count(*) / (SELECT n_tx FROM m) AS support FROM t x JOIN t y ON x.tx = y.tx AND x.item < y.item JOIN t w ON w.tx = x.tx AND y.item < w.item GROUP BY ALL HAVING count(*) >= (SELECT least FROM m)),
r3 AS (SELECT s.a || '|' || s.b AS antecedent, s.c AS consequent, s.support, s.support / p.support AS confidence, s.support / (p.support * i.support) AS lift, s.support - p.support * i.support AS leverage, (1 - i.support) / nullif(1 - s.support / p.support, 0) AS conviction
  FROM (SELECT a, b, c, support FROM z UNION ALL SELECT a, c, b, support FROM z UNION ALL SELECT b, c, a, support FROM z) s JOIN p ON p.a = s.a AND p.b = s.b JOIN i ON i.item = s.c)
"""


@query(AR_SQL + Z_SQL + "SELECT antecedent, consequent, round(support, 6) AS support, round(confidence, 6) AS confidence, round(lift, 6) AS lift, round(leverage, 6) AS leverage, round(conviction, 6) AS conviction FROM (SELECT * EXCLUDE (n) FROM r UNION ALL SELECT * FROM r3) WHERE confidence >= 0.0501")
def ar06_itemset_rules(spark: SparkSession, d: str) -> DataFrame:
    made = rules.itemset_rules(basket_lines(spark, d), "l_orderkey", "p_name", LEAST, 0.0501)
    return rounded(made.withColumn("antecedent", F.array_join("antecedent", "|")), 6)


@query(AR_SQL + """, o AS (SELECT t.tx, consequent AS item, round(max(confidence), 9) AS score FROM t JOIN r ON t.item = antecedent GROUP BY ALL),
k AS (SELECT o.*, row_number() OVER (PARTITION BY tx ORDER BY score DESC, item) AS place FROM o ANTI JOIN t USING (tx, item))
SELECT tx, item, round(score, 6) AS score, place::INT AS place FROM k WHERE place <= 3""")
def ar07_recommend(spark: SparkSession, d: str) -> DataFrame:
    lines = basket_lines(spark, d)
    made = rules.pair_rules(lines, "l_orderkey", "p_name", LEAST).withColumn("confidence", F.round("confidence", 9))
    return rounded(rules.recommend(rules.baskets(lines, "l_orderkey", "p_name"), made, 3), 6)


@query("SELECT event_id, round((value - m) / s, 4) AS z, abs((value - m) / s) > 3 AS flag FROM events JOIN (SELECT event_type, avg(value) AS m, stddev_samp(value) AS s FROM events GROUP BY 1) USING (event_type)")
def an01_zscore(spark: SparkSession, d: str) -> DataFrame:
    return rounded(anomaly.zscore(table(spark, d, "events"), "value", ["event_type"]).select("event_id", "z", "flag"))


@query("""WITH m AS (SELECT *, median(value) OVER () AS md FROM events), s AS (SELECT median(abs(value - md)) AS mad FROM m)
SELECT event_id, round((value - md) / (1.4826 * mad), 4) AS z, abs((value - md) / (1.4826 * mad)) > 3.5 AS flag FROM m, s""")
def an02_mad_score(spark: SparkSession, d: str) -> DataFrame:
    return rounded(anomaly.mad_score(table(spark, d, "events"), "value", []).select("event_id", "z", "flag"))


@query("""WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)
SELECT event_id, round(a - 1.5 * (b - a), 4) AS low, round(b + 1.5 * (b - a), 4) AS high, value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a) AS flag FROM events, q""")
def an03_iqr_fence(spark: SparkSession, d: str) -> DataFrame:
    return rounded(anomaly.iqr_fence(table(spark, d, "events"), "value", []).select("event_id", "low", "high", "flag"))


@query("""WITH w AS (SELECT event_id, value, count(value) OVER b AS n, avg(value) OVER b AS m, stddev_samp(value) OVER b AS s FROM events WINDOW b AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING))
SELECT event_id, round(CASE WHEN n >= 30 THEN (value - m) / nullif(s, 0) END, 4) AS z, coalesce(n >= 30 AND abs((value - m) / nullif(s, 0)) > 3, false) AS flag FROM w""")
def an04_rolling_z(spark: SparkSession, d: str) -> DataFrame:
    return rounded(anomaly.rolling_z(table(spark, d, "events"), "value", ["event_type"], ["ts", "event_id"], 50, 30, 3.0).select("event_id", "z", "flag"))


@query(RFM_SQL + """, c AS (SELECT avg(recency) AS mx, avg(monetary) AS my, var_samp(recency) AS xx, var_samp(monetary) AS yy, covar_samp(recency, monetary) AS xy FROM r),
k AS (SELECT o_custkey, (yy * (recency - mx) ** 2 - 2 * xy * (recency - mx) * (monetary - my) + xx * (monetary - my) ** 2) / (xx * yy - xy * xy) AS d2 FROM r, c)
SELECT o_custkey, round(d2, 4) AS d2, d2 > 5.991 AS flag FROM k""")
def an05_mahalanobis(spark: SparkSession, d: str) -> DataFrame:
    return rounded(anomaly.mahalanobis(customers(spark, d), ["recency", "monetary"], 5.991).select("o_custkey", "d2", "flag"))


@query(NEAR_SQL + ", k AS (SELECT cluster, quantile_cont(distance, 0.99) AS cut FROM n GROUP BY 1) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, cluster, round(distance, 4) AS distance, round(cut, 4) AS cut, distance > cut AS flag FROM n JOIN k USING (cluster)")
def an06_centroid_outliers(spark: SparkSession, d: str) -> DataFrame:
    found = anomaly.centroid_outliers(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"], CENTROIDS, 0.99)
    return rounded(found.select(*LINE, "cluster", "distance", "cut", "flag"))


@query("SELECT source AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents), 4) AS share FROM documents GROUP BY 1 HAVING count(*) < 0.051 * (SELECT count(*) FROM documents)")
def an07_rare_values(spark: SparkSession, d: str) -> DataFrame:
    return rounded(anomaly.rare_values(table(spark, d, "documents"), "source", 0.051))


@query("""WITH c AS (SELECT event_type, date_trunc('hour', ts) AS period, count(*)::DOUBLE AS n_rows FROM events GROUP BY ALL),
g AS (SELECT event_type, unnest(generate_series(min(period), max(period), INTERVAL 1 HOUR)) AS period FROM c GROUP BY 1),
f AS (SELECT event_type, period, coalesce(n_rows, 0) AS n_rows FROM g LEFT JOIN c USING (event_type, period)),
w AS (SELECT *, count(*) OVER b AS n, avg(n_rows) OVER b AS m, stddev_samp(n_rows) OVER b AS s FROM f WINDOW b AS (PARTITION BY event_type ORDER BY period ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING))
SELECT event_type, period, n_rows, round(CASE WHEN n >= 24 THEN (n_rows - m) / nullif(s, 0) END, 4) AS z, coalesce(n >= 24 AND abs((n_rows - m) / nullif(s, 0)) > 3, false) AS flag FROM w""")
def an08_count_spikes(spark: SparkSession, d: str) -> DataFrame:
    return rounded(anomaly.count_spikes(table(spark, d, "events"), "ts", "hour", ["event_type"], 48, 24, 3.0))


def outliers(spark: SparkSession, d: str) -> DataFrame:
    y = (F.col("event_id") % 100 == 0).cast("int")
    return table(spark, d, "events").select("event_id", y.alias("y"), (F.col("value") + 600 * y).alias("value"))


OUT_SQL = "WITH e AS (SELECT event_id, (event_id % 100 = 0)::INT AS y, value, value + 600 * (event_id % 100 = 0)::INT AS shifted FROM events)\n"


@query()
def an09_isolation_forest(spark: SparkSession, d: str) -> DataFrame:
    return anomaly.isolation_forest(outliers(spark, d), ["value"], "event_id")


@query(OUT_SQL + ", c AS (SELECT count(*) FILTER (y = 1 AND shifted >= 400) AS tp, count(*) FILTER (y = 0 AND shifted >= 400) AS fp, count(*) FILTER (y = 1 AND shifted < 400) AS fn, count(*) FILTER (y = 0 AND shifted < 400) AS tn FROM e) SELECT *, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall, round(2 * tp / (2 * tp + fp + fn), 4) AS f1 FROM c")
def an10_detector_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(anomaly.detector_metrics(outliers(spark, d), "y", "value", 400.0))


@query("""WITH r AS (SELECT (event_id % 7 = 0)::INT AS y, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2 AS rk FROM events)
SELECT count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg, round((sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS auc FROM r""")
def an11_auc(spark: SparkSession, d: str) -> DataFrame:
    return rounded(anomaly.auc(table(spark, d, "events").withColumn("y", (F.col("event_id") % 7 == 0).cast("int")), "y", "value"), 6)


@query()
def an11b_auc_sketched(spark: SparkSession, d: str) -> DataFrame:
    """AN-11 from sketches, with the bound of its error."""
    return anomaly.auc_sketched(table(spark, d, "events").withColumn("y", (F.col("event_id") % 7 == 0).cast("int")), "y", "value")


@query("""WITH e AS (SELECT event_id, (event_id % 7 = 0)::INT AS y, value FROM events),
s AS (SELECT value, sum(y) AS pos, sum(sum(y)) OVER w AS tp, sum(count(*)) OVER w AS seen FROM e GROUP BY value WINDOW w AS (ORDER BY value DESC)),
k AS (SELECT y FROM e ORDER BY value DESC, event_id LIMIT 100)
SELECT round((SELECT sum(pos * tp / seen) / sum(pos) FROM s), 6) AS average_precision, 100::BIGINT AS k, (SELECT count(*) FROM k WHERE y = 1) AS hits, round((SELECT avg(y) FROM k), 6) AS precision""")
def an12_precision_at_k(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("y", (F.col("event_id") % 7 == 0).cast("int"))
    return rounded(anomaly.average_precision(rows, "y", "value").crossJoin(anomaly.precision_at_k(rows, "y", "value", "event_id", 100)), 6)


@query("""SELECT * FROM (VALUES ('p_partkey', (SELECT count(DISTINCT p_partkey) FROM part), 'id'), ('p_name', (SELECT count(DISTINCT p_name) FROM part), 'text'), ('p_brand', (SELECT count(DISTINCT p_brand) FROM part), 'categorical'),
('p_type', (SELECT count(DISTINCT p_type) FROM part), 'categorical'), ('p_size', (SELECT count(DISTINCT p_size) FROM part), 'numeric'), ('p_retailprice', (SELECT count(DISTINCT p_retailprice) FROM part), CASE WHEN (SELECT count(DISTINCT p_retailprice) = count(*) FROM part) THEN 'id' ELSE 'numeric' END)) t(column_name, n_distinct, role)""")
def am01_infer_roles(spark: SparkSession, d: str) -> DataFrame:
    return automl.infer_roles(table(spark, d, "part"), 30)


@query()
def am02_auto_prep(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    from pyspark.ml.functions import vector_to_array

    made = automl.auto_prep(part, automl.infer_roles(part, 30), "p_retailprice").fit(part).transform(part)
    return made.select("p_partkey", vector_to_array("features").alias("features"))


@query("""WITH b AS (SELECT p_brand, row_number() OVER (ORDER BY count(*) DESC, p_brand) - 1 AS i FROM part GROUP BY 1), t AS (SELECT p_type, row_number() OVER (ORDER BY count(*) DESC, p_type) - 1 AS j FROM part GROUP BY 1)
SELECT p_partkey, array_to_string(list_concat([p_size::BIGINT], list_transform(range((SELECT count(*) FROM b)), lambda x: (x = i)::BIGINT), list_transform(range((SELECT count(*) FROM t)), lambda x: (x = j)::BIGINT)), ',') AS features FROM part JOIN b USING (p_brand) JOIN t USING (p_type)""")
def am02b_prepared_features(spark: SparkSession, d: str) -> DataFrame:
    """AM-02 over named roles, as text: the size, then a place for each brand and type from the commonest on."""
    from pyspark.ml.functions import vector_to_array

    part = table(spark, d, "part").select("p_partkey", "p_size", "p_brand", "p_type")
    roles = spark.createDataFrame([("p_size", 1, "numeric"), ("p_brand", 1, "categorical"), ("p_type", 1, "categorical")], "column_name string, n_distinct long, role string")
    made = automl.auto_prep(part, roles, "p_retailprice").fit(part).transform(part)
    return made.select("p_partkey", F.array_join(F.transform(vector_to_array("features"), lambda x: x.cast("long").cast("string")), ",").alias("features"))


def candidates() -> dict:
    from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression

    return {"linear": (LinearRegression(solver="normal"), {"regParam": [0.0, 1.0]}), "tree": (DecisionTreeRegressor(seed=7), {"maxDepth": [4, 6]})}


@query()
def am03_cross_validate(spark: SparkSession, d: str) -> DataFrame:
    """Mean and deviation of the error over three folds, of two candidates and the baseline on planted data."""
    return automl.cross_validate(exact_line(spark, d), "noisy", "l_orderkey", candidates(), 3, [*XS, "flag_r"], ["l_returnflag"])


@query(f"""WITH l AS (SELECT l_quantity AS x, l_extendedprice AS y, ('0x' || substr(md5(l_orderkey::VARCHAR), 1, 8))::BIGINT % 3 AS fold FROM lineitem),
s AS (SELECT f.fold, covar_pop(y, x) AS xy, var_pop(x) AS xx, stddev_pop(y) AS sy, avg(x) AS mx, avg(y) AS my FROM l JOIN (SELECT unnest(range(3)) AS fold) f ON l.fold <> f.fold GROUP BY 1),
b AS (SELECT fold, reg, xy / (xx + reg / sy * xx) AS slope, mx, my FROM s, (VALUES (0.0::DOUBLE), (1000.0), (5000.0)) r(reg)),
e AS (SELECT reg, l.fold, sqrt(avg((y - my - slope * (x - mx)) ** 2)) AS rmse FROM l JOIN b ON l.fold = b.fold GROUP BY ALL)
SELECT 'linear' AS model, '{{''regParam'': ' || printf('%.1f', reg) || '}}' AS params, round(avg(rmse), 4) AS mean_rmse, round(stddev_pop(rmse), 4) AS sd_rmse FROM e GROUP BY reg""")
def am03b_linear_cross_validate(spark: SparkSession, d: str) -> DataFrame:
    """Ridge fits of price on quantity for three penalties and three folds, from one pass."""
    return rounded(automl.linear_cross_validate(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"], "l_orderkey", [0.0, 1000.0, 5000.0], 3))


@query()
def am04_leaderboard(spark: SparkSession, d: str) -> DataFrame:
    """Cross-validation (AM-03) of two candidates and the baseline on planted data, ranked, and their errors on rows held out from it."""
    rows, xs, by = exact_line(spark, d), [*XS, "flag_r"], ["l_returnflag"]
    train, test = rows.where("NOT is_test"), rows.where("is_test")
    results = automl.cross_validate(train, "noisy", "l_orderkey", candidates(), 3, xs, by)
    return automl.leaderboard(results, automl.holdout_scores(train, test, "noisy", candidates(), xs, by))


@query(BASE_SQL + f", s AS (SELECT 'brand' AS model, y, yhat FROM b UNION ALL SELECT 'global', y, (SELECT avg(l_extendedprice) FROM l WHERE fold <> 0) FROM b), k AS (SELECT model, {METRICS}, sqrt(avg((y - yhat) ** 2)) AS e FROM s GROUP BY 1) SELECT * EXCLUDE (e), rank() OVER (ORDER BY e)::INT AS place FROM k")
def am05_score_predictions(spark: SparkSession, d: str) -> DataFrame:
    line, part = tables(spark, d, "lineitem", "part")
    both = regression.hash_split(line.join(part, line.l_partkey == part.p_partkey), "l_orderkey", 5)
    train, test = both.where("fold <> 0"), both.where("fold = 0")
    rows = [regression.mean_baseline(train, test, by, "l_extendedprice").select(F.lit(n).alias("model"), F.col("l_extendedprice").alias("y"), "yhat") for n, by in (("brand", ["p_brand"]), ("global", ["fold"]))]
    return rounded(automl.score_predictions(rows[0].unionByName(rows[1]), ["model"]))


AM6 = ["high", "low", "even"]


def greedy_sql(rounds: int = 5) -> str:
    """Forward selection unrolled: each round scores the three columns with the sum chosen so far."""
    parts = [f"p AS (SELECT 5 + 3 * l_quantity - 100 * l_discount + 40 * l_tax AS even, l_returnflag, l_extendedprice FROM lineitem WHERE l_orderkey % 5 <> 0)",
             f"q AS (SELECT even + 50 * (l_returnflag = 'R')::INT + {U.format('l_extendedprice', 'n')} AS y, even + 30 AS high, even - 5 AS low, even FROM p)"]
    parts.append("c0 AS (SELECT 0 AS high, 0 AS low, 0 AS even)")
    for n in range(rounds):
        total = " + ".join(f"c.{m} * q.{m}" for m in AM6)
        scored = " UNION ALL ".join(f"SELECT '{m}' AS m, avg((y - ({total} + q.{m}) / {n + 1}) ** 2) AS e FROM q, c{n} c" for m in AM6)
        parts.append(f"b{n} AS (SELECT arg_min(m, (e, m)) AS m FROM ({scored}))")
        parts.append(f"c{n + 1} AS (SELECT " + ", ".join(f"c.{m} + (b.m = '{m}')::INT AS {m}" for m in AM6) + f" FROM c{n} c, b{n} b)")
    return "WITH " + ",\n".join(parts) + "\n" + " UNION ALL ".join(f"SELECT '{m}' AS model, {m} / {rounds} AS weight FROM c{rounds}" for m in AM6)


@query(greedy_sql())
def am06_greedy_ensemble(spark: SparkSession, d: str) -> DataFrame:
    rows = exact_line(spark, d).where("NOT is_test")
    preds = rows.select("noisy", (F.col("y") + 30).alias("high"), (F.col("y") - 5).alias("low"), F.col("y").alias("even"))
    return automl.greedy_ensemble(preds, "noisy", ["high", "low", "even"], 5)


@query()
def am07_permutation_importance(spark: SparkSession, d: str) -> DataFrame:
    rows = exact_line(spark, d).withColumn("unused", uniform(F.col("l_partkey"), "q")).withColumn("own", F.concat_ws("-", *LINE))
    cols = ["l_quantity", "l_tax", "unused"]
    model = regression.linear_fit(rows.where("NOT is_test"), [*XS, "unused"], "y")
    return automl.permutation_importance(model, rows.where("is_test"), cols, "y", "own")
