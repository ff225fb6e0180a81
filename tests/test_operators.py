"""Small tables worked by hand, planted truth, and properties."""

import pytest
from pyspark.sql import functions as F

from quarry.functions import ordered
from quarry.operators import anomaly, audit, automl, charts, corpus, forecast, prep, regression, rules, segments
from quarry.plans import modelling, quality, series  # noqa: F401

SF = "/root/testdata/sf0.001"


def one(df):
    return df.first().asDict()


def test_metrics_leave_out_nulls_and_zero(spark):
    df = spark.createDataFrame([(2.0, 1.0), (4.0, 6.0), (0.0, 1.0), (None, 1.0)], "y double, p double")
    got = one(regression.regression_metrics(df, "y", "p"))
    assert (got["n"], got["n_zero"]) == (3, 1)
    assert got["mae"] == pytest.approx(4 / 3) and got["mape"] == pytest.approx(0.5) and got["r2"] == pytest.approx(1 - 6 / 8)


def test_constant_target_has_no_r2(spark):
    assert one(regression.regression_metrics(spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "y double, p double"), "y", "p"))["r2"] is None


def test_baseline_uses_only_training_rows(spark):
    train = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 10.0)], "k string, y double")
    test = spark.createDataFrame([("a", 99.0), ("new", 99.0)], "k string, y double")
    got = {r.k: r.yhat for r in regression.mean_baseline(train, test, ["k"], "y").collect()}
    assert got == {"a": 2.0, "new": pytest.approx(14 / 3)}


def test_trees_beat_the_baseline(spark):
    assert modelling.rg06_tree_fit(spark, SF).first()["rmse"] < 10
    rows = modelling.exact_line(spark, SF)
    forest = regression.tree_fit(rows.where("NOT is_test"), [*modelling.XS, "flag_r"], "noisy", "forest").transform(rows.where("is_test"))
    plain = regression.mean_baseline(rows.where("NOT is_test"), rows.where("is_test"), ["l_linenumber"], "noisy")
    assert regression.regression_metrics(forest, "noisy", "prediction").first()["rmse"] < regression.regression_metrics(plain, "noisy", "yhat").first()["rmse"] / 3


def test_scores_share_ties(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (3,), (4,)], "v int")
    assert sorted(r.v_score for r in segments.quantile_score(df, ["v"]).collect()) == [1, 1, 3, 4, 5]


def test_no_spread_standardizes_to_zero(spark):
    df = spark.createDataFrame([(5.0,), (5.0,), (None,)], "v double")
    for how in ("z", "minmax", "robust"):
        assert [r.v_std for r in segments.standardize(df, ["v"], how).orderBy("v").collect()] == [None, 0.0, 0.0]


def test_nearest_centroid_ties_to_the_lower(spark):
    df = spark.createDataFrame([(5.0,), (9.0,), (None,)], "v double")
    assert [r.cluster for r in segments.assign_centroid(df, ["v"], [[0.0], [10.0]]).orderBy("v").collect()] == [None, 0, 1]


def test_silhouette_is_highest_at_the_planted_k(spark):
    got = {r.k: r.silhouette for r in modelling.sg07_kmeans_sweep(spark, SF).collect()}
    assert max(got, key=got.get) == 3


def test_baskets_are_sets_and_certain_rules_have_no_conviction(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "b"), (4, None)], "tx int, item string")
    got = {(r.antecedent, r.consequent): r for r in rules.pair_rules(df, "tx", "item", 1).collect()}
    ab = got["a", "b"]
    assert (ab.n, ab.support, ab.confidence, ab.conviction) == (2, pytest.approx(2 / 3), 1.0, None)
    assert got["b", "a"].confidence == pytest.approx(2 / 3) and ab.lift == pytest.approx(1.0)


def test_pair_support_is_at_most_item_support(spark):
    lines = modelling.basket_lines(spark, SF)
    single = {r["item"]: r["n"] for r in rules.item_support(lines, "l_orderkey", "p_name", 2).collect()}
    assert all(r["n"] <= min(single[r["a"]], single[r["b"]]) for r in rules.pair_support(lines, "l_orderkey", "p_name", 2).collect())


def test_zero_spread_scores_are_null(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 2.0)], "k string, v double")
    for made in (anomaly.zscore(df, "v", ["k"]), anomaly.mad_score(df, "v", ["k"])):
        assert [(r.z, r.flag) for r in made.collect()] == [(None, False)] * 3


def test_isolation_forest_finds_planted_outliers(spark):
    scored = modelling.an09_isolation_forest(spark, SF)
    assert anomaly.auc(scored, "y", "score").first()["auc"] > 0.9


def test_auc_of_ties_is_half(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 1.0)], "y int, s double")
    assert one(anomaly.auc(df, "y", "s")) == {"n_pos": 1, "n_neg": 1, "auc": 0.5}


def test_baseline_ranks_last_on_planted_data(spark):
    got = modelling.am04_leaderboard(spark, SF).orderBy("place").collect()
    assert got[-1]["model"] == "group mean" and got[0]["model"] == "linear"
    assert got[0]["holdout_rmse"] < 1 and max(got, key=lambda r: r.holdout_rmse).model == "group mean"


def test_ensemble_is_no_worse_than_the_best(spark):
    df = spark.createDataFrame([(1.0, 0.0, 3.0), (2.0, 1.0, 4.0), (3.0, 2.0, 5.0)], "y double, a double, b double")
    w = {r.model: r.weight for r in automl.greedy_ensemble(df, "y", ["a", "b"], 3).collect()}
    error = lambda a, b: sum((r.y - a * r.a - b * r.b) ** 2 for r in df.collect())
    assert error(w["a"], w["b"]) <= min(error(1, 0), error(0, 1))


def test_unused_column_has_no_importance(spark):
    got = {r.column_name: r.importance for r in modelling.am07_permutation_importance(spark, SF).collect()}
    assert abs(got["unused"]) < 1e-6 < got["l_tax"] < got["l_quantity"]


def test_prepared_features_have_no_nulls(spark):
    df = spark.createDataFrame([(1, "x", 5.0), (2, "y", None), (3, "x", 6.0), (4, None, 6.0)], "k int, c string, y double")
    roles = spark.createDataFrame([("c", "categorical"), ("y", "numeric"), ("k", "id")], "column_name string, role string")
    assert automl.auto_prep(df, roles, "none").fit(df).transform(df).where("features IS NULL").count() == 0


def test_gaps_are_filled_three_ways(spark):
    df = spark.createDataFrame([("2020-01-01", 2.0), ("2020-01-04", 8.0)], "d string, y double").withColumn("d", F.to_date("d"))
    got = lambda how: [r.y for r in forecast.fill_gaps(df, "d", "1 day", how, [], "y").orderBy("d").collect()]
    assert got("zero") == [2, 0, 0, 8] and got("last") == [2, 2, 2, 8] and got("linear") == [2, 4, 6, 8]


def test_smoothing_by_hand(spark):
    df = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 10.0)], "period int, y double")
    got = one(forecast.ses(df, [0.5], 1, []))
    assert (got["level"], got["sse"], got["yhat"]) == (12.5, 125.0, 12.5)


def test_models_beat_the_seasonal_naive_forecast(spark):
    planted = series.season(spark, SF)
    for r in series.holt_winters_errors(planted).collect():
        assert r.mae < 1.0
    got = {r.model: r.mae for r in series.lag_regression_errors(planted, F.col("period") < 60, F.col("period") >= 60).collect()}
    assert got["regression"] < got["seasonal naive"]
    dated = planted.withColumn("period", F.add_months(F.lit("2000-01-01").cast("date"), F.col("period")))
    with_months = {r.model: r.mae for r in series.lag_regression_errors(dated, F.col("period") < "2005-01-01", F.col("period") >= "2005-01-01", ("year", "month")).collect()}
    assert with_months["regression"] < got["seasonal naive"]


def test_calendar_of_a_lag_regression_tells_months(spark):
    """Values that only the month fixes: lag 1 alone can't give them, months do; columns that clash stay."""
    value = F.pmod(F.month("period") * 7, F.lit(5)).cast("double")
    df = spark.range(60).select(F.add_months(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")).alias("period"), F.lit("x").alias("month")).withColumn("y", value)
    made = forecast.lag_regression(df, [1], [], F.col("period") < "2003-01-01", calendar=("month", "is_weekend"))
    assert made.columns == ["period", "month", "y", "lag_1", "diff_1", "yhat"]
    assert made.count() == 59 and made.agg(F.max(F.abs(F.col("y") - F.col("yhat")))).first()[0] < 1e-6


def test_checks_count_nulls_as_bad(spark):
    df = spark.createDataFrame([(1,), (None,), (9,)], "v int")
    assert one(audit.in_range(df, "v", 0, 5)) == {"check_name": "range", "column_name": "v", "n_rows": 3, "n_bad": 2, "pass": False}


def test_reconcile_takes_nulls_as_equal(spark):
    a = spark.createDataFrame([(1, None), (2, 5), (3, 5)], "k int, v int")
    b = spark.createDataFrame([(1, None), (2, 6), (4, 5)], "k int, v int")
    assert {r.status: r.n for r in audit.reconcile(a, b, ["k"], ["v"]).collect()} == {"equal": 1, "differing": 1, "only_left": 1, "only_right": 1}


def test_masking(spark):
    df = spark.createDataFrame([("to a@b.cc now",), (None,)], "t string")
    assert [r.t for r in audit.mask(df, "t", {"mail": r"\S+@\S+"}).collect()] == ["to <mail> now", None]
    assert audit.mask(df, "t", {}, "salt").first().t == audit.mask(df, "t", {}, "salt").first().t


def test_statistics_come_from_training_rows(spark):
    train = spark.createDataFrame([(1.0,), (3.0,), (3.0,)], "v double")
    df = spark.createDataFrame([(None,), (100.0,)], "v double")
    assert [r.v for r in prep.impute(train, df, ["v"], "mode").collect()] == [3.0, 100.0]
    assert [r.v for r in prep.winsorize(train, df, ["v"], 0.0, 1.0).collect()] == [None, 3.0]
    assert [r.bucket for r in prep.bucketize(train, df, "v", 2).collect()] == [None, 1]


def test_histogram_closes_the_last_bin(spark):
    df = spark.createDataFrame([(0.0,), (10.0,), (11.0,), (None,)], "v double")
    assert [r.n for r in charts.histogram(df, "v", 0.0, 10.0, 2).orderBy("bin").collect()] == [1, 1]


def test_perplexity_of_unseen_words_is_finite(spark):
    train = spark.createDataFrame([(1, "a b a b")], "k int, t string")
    model = corpus.bigram_model(train, "k", "t", 1.0)
    got = corpus.perplexity(spark.createDataFrame([(2, "c d"), (3, "a"), (4, None)], "k int, t string"), "k", "t", model, 1.0).collect()
    assert [(r.k, r.n_bigrams) for r in got] == [(2, 1)] and got[0].perplexity == pytest.approx(3.0)


def test_results_do_not_depend_on_partitions(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    made = [sorted(map(tuple, anomaly.rolling_z(events.repartition(n), "value", ["event_type"], ["ts", "event_id"], 20, 10, 3.0).select("event_id", "flag").collect())) for n in (1, 5)]
    assert made[0] == made[1]


@pytest.mark.parametrize("name", ["ar04_pair_rules", "sg06_assign_centroid", "an04_rolling_z", "vz08_m4", "lm02_ngrams"])
def test_plans_stay_in_the_jvm(spark, name):
    from quarry.plans.registry import QUERIES

    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_quantiles_and_running_sums_of_a_million_values(spark):
    df = spark.range(0, 1_000_000, 1, 8).select((F.pmod(F.col("id") * 7919, F.lit(1_000_003)) / 3.0).alias("v"), (F.col("id") % 2).alias("k"))
    for by in ([], ["k"]):
        shares = [0.0, 0.1, 0.5, 0.937, 1.0]
        want = df.groupBy(*by).agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("q"))
        got = ordered.quantiles(df, "v", shares, by)
        for a, b in zip(got.orderBy(*(by or ["q"])).collect(), want.orderBy(*(by or ["q"])).collect(), strict=True):
            assert list(a.q) == pytest.approx(list(b.q), rel=1e-12)
    run = ordered.running(df.withColumn("n", F.lit(1)), "v", ["n"])
    assert tuple(run.agg(F.max("n_run"), F.count_distinct("n_run")).first()) == (1_000_000, 1_000_000)
    most = run.groupBy((F.col("n_run") / 100_000).cast("int")).count().agg(F.max("count")).first()[0]
    assert most <= 100_000
    back = ordered.running(df.withColumn("n", F.lit(1)), "v", ["n"], descending=True).orderBy("v").select("n_run").first()[0]
    assert back == 1_000_000


def test_levels_that_differ_in_signs_have_columns_of_their_own(spark):
    df = spark.createDataFrame([("A-B",), ("A_B",), ("a b",), (None,)], "k string")
    got = prep.one_hot(df, df, "k", 5).collect()
    assert [sum(v for c, v in r.asDict().items() if c != "k" and c != "k_other") for r in got] == [1, 1, 1, 0] and len(got[0]) == 5
