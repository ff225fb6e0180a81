"""Operators whose long groups, large baskets and many rows are cut into parts: the same results as the plain form, in bounded parts."""

import math
import random
import re
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import ordered
from quarry.operators import anomaly, audit, automl, charts, corpus, forecast, prep, regression, rules, segments
from quarry.operators.regression import hash_split
from quarry.plans import audited_regression, modelling  # noqa: F401
from quarry.sources.tables import table, tables

SF = "/root/testdata/sf0.001"


def close(got, want):
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=str), sorted(want, key=str), strict=True):
        assert a[:-1] == b[:-1] and (a[-1] == b[-1] or a[-1] == pytest.approx(b[-1], rel=1e-9, abs=1e-9)), (a, b)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# order


@pytest.mark.parametrize("kind", ["date", "timestamp_ntz", "timestamp", "string", "bigint", "double", "decimal(20,3)", "boolean"])
def test_order_of_any_type(spark, kind):
    raw = {"date": ["2020-01-05", "2020-01-01", "2021-07-01"], "timestamp_ntz": ["2020-01-01 00:00:00.5", "2020-01-01 00:00:00", "1999-01-01"], "timestamp": ["2020-01-01 00:00:00.5", "2020-01-01", "1999-01-01"], "string": ["b", "Z", "é"], "bigint": ["9007199254740993", "9007199254740992", "9007199254740994"], "double": ["1.5", "-2", "1e300"], "decimal(20,3)": ["10000000000000000.001", "10000000000000000.002", "0.001"], "boolean": ["true", "false", "false"]}[kind]
    df = spark.createDataFrame([(x,) for x in [*raw, raw[0], None]], "x string").select(F.col("x").cast(kind).alias("x"))
    got = {r.value: (r.n, round(r.share, 6)) for r in charts.ecdf(df, "x").collect()}
    values = [r.x for r in df.where("x IS NOT NULL").collect()]
    assert got == {v: (values.count(v), round(sum(w <= v for w in values) / len(values), 6)) for v in set(values)}
    assert audit.ks(df, df.limit(0), "x").first()["ks"] is None
    assert audit.ks(df, df, "x").first()["ks"] == 0


def test_distinct_counts_above_two_to_the_53(spark):
    big = 2**53
    df = spark.createDataFrame([(big, 0.0), (big + 1, -0.0), (big + 2, 1.5), (None, None)], "a long, b double")
    got = {r.column_name: r for r in audit.profile(df).collect()}
    assert (got["a"].n_distinct, got["b"].n_distinct, got["a"].n_null) == (3, 2, 1)
    assert got["b"].median == 0.0


def test_quantiles_of_many_groups_and_of_one_huge_one(spark):
    small = spark.range(400_000).select((F.col("id") % 200_000).alias("g"), (F.col("id") * 7 % 1000).cast("double").alias("v"))
    huge = spark.range(1_000_000).select(F.lit(None).cast("long").alias("g"), F.col("id").cast("double").alias("v"))
    got = ordered.quantiles(small.unionByName(huge), "v", [0.25, 0.5], ["g"])
    want = small.groupBy("g").agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.5))).alias("w"))
    assert got.where("g IS NULL").first()["q"] == [249999.75, 499999.5]
    both = got.join(want, "g")
    assert both.count() == 200_000 and both.where("abs(q[0] - w[0]) > 1e-9 OR abs(q[1] - w[1]) > 1e-9").count() == 0


def test_statistics_of_groups_are_not_forced_on_all_tasks(spark):
    line = table(spark, SF, "lineitem")
    for made in (anomaly.iqr_fence(line, "l_extendedprice", ["l_orderkey"]), anomaly.mad_score(line, "l_extendedprice", ["l_orderkey"]), charts.boxplot(line, "l_extendedprice", ["l_orderkey"])):
        assert "strategy=broadcast" not in made._jdf.queryExecution().logical().toString()
    got = {tuple(r) for r in anomaly.iqr_fence(line, "l_extendedprice", ["l_orderkey"]).select("l_orderkey", "low").distinct().collect()}
    want = line.groupBy("l_orderkey").agg(F.percentile("l_extendedprice", F.array(F.lit(0.25), F.lit(0.75))).alias("q")).collect()
    assert {k: round(x, 6) for k, x in got} == {r.l_orderkey: round(r.q[0] - 1.5 * (r.q[1] - r.q[0]), 6) for r in want}


def test_null_groups_are_groups(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), (None, 100.0), ("a", 5.0)], "g string, v double")
    assert {(r.g, r.low) for r in anomaly.iqr_fence(df, "v", ["g"]).collect()} == {(None, 1.5 - 1.5 * (51 - 1.5)), ("a", 5.0)}


# windows of long groups


def events(spark):
    return table(spark, SF, "events").select("event_id", "event_type", "ts", "value")


@pytest.mark.parametrize(("n", "block"), [(50, 60), (50, 7), (1, 1), (5, 100_000)])
def test_blocks_see_what_whole_groups_do(spark, n, block):
    df = events(spark)
    w = Window.partitionBy("event_type").orderBy("ts", "event_id").rowsBetween(-n, -1)
    mean = lambda rows, over: rows.withColumn("m", F.avg("value").over(over)).withColumn("c", F.count("value").over(over))
    rows, keys, own = ordered.blocked(df, ["ts", "event_id"], n, ["event_type"], block)
    got = ordered.back(mean(rows, Window.partitionBy(*keys).orderBy("ts", "event_id").rowsBetween(-n, -1)), own)
    assert got.columns == [*df.columns, "m", "c"]
    close([(r.event_id, r.c, r.m) for r in got.collect()], [(r.event_id, r.c, r.m) for r in mean(df, w).collect()])
    if block < 100:
        assert rows.select("event_type", "__block").distinct().count() > 2 * df.select("event_type").distinct().count()  # more tasks than keys
        assert rows.groupBy("event_type", "__block").count().agg(F.max("count")).first()[0] <= max(block, n) + n


def test_scores_gaps_and_rolling_in_blocks(spark):
    df = events(spark)
    z = lambda block: [(r.event_id, r.flag, r.z) for r in anomaly.rolling_z(df, "value", ["event_type"], ["ts", "event_id"], 20, 10, 2.0, block).collect()]
    close(z(25), z(10**6))
    f = lambda block: [tuple(r) for r in audit.freshness(df, "ts", ["event_type"], "2030-01-01", block).collect()]
    close(f(3), f(10**6))
    series = df.groupBy("event_type", F.date_trunc("hour", "ts").alias("period")).agg(F.sum("value").alias("y"))
    for made in (lambda b: forecast.rolling(series, "y", 6, ["event_type"], "period", b).select("event_type", "period", "roll_mean"), lambda b: forecast.lags(series, "y", [1, 7], ["event_type"], "period", b).select("event_type", "period", "lag_7")):
        close([tuple(r) for r in made(8).collect()], [tuple(r) for r in made(10**6).collect()])


def walk(spark, n, k=2):
    rng = np.random.default_rng(4)
    rows = [(f"s{j}" if j else None, i, float(20 + 5 * math.sin(i * math.pi / 2) + rng.normal() + 0.01 * i)) for j in range(k) for i in range(n - j)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "k string, period int, y double")


@pytest.mark.parametrize(("n", "chunk"), [(203, 20), (40, 10), (41, 40)])
def test_smoothing_in_chunks_equals_the_fold(spark, n, chunk):
    df = walk(spark, n)
    s = lambda c: [(r.k, r.alpha, r.step, r.level) for r in forecast.ses(df, [0.1, 0.5], 2, ["k"], chunk=c).collect()]
    close(s(chunk), s(10**6))
    for m in (1, 4):
        grid = [(0.3, 0.1, 0.2), (0.6, 0.05, 0.1)]
        h = lambda c, m=m, grid=grid: [(r.k, r.alpha, r.step, r.yhat) for r in forecast.holt_winters(df, m, grid, 5, ["k"], chunk=c).collect()]
        close(h(chunk), h(10**6))
        e = lambda c, m=m, grid=grid: [(r.k, r.step, r.sse) for r in forecast.holt_winters(df, m, grid, 1, ["k"], chunk=c).collect()]
        close(e(chunk), e(10**6))


def test_cuts_of_clusters_are_sent_to_the_rows(spark):
    """A join by cluster would deal all rows out to as many tasks as there are centroids."""
    line = table(spark, SF, "lineitem")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = anomaly.centroid_outliers(line, ["l_quantity", "l_extendedprice"], modelling.CENTROIDS, 0.99)
        got = {(r.cluster, r.cut): r.n for r in found.groupBy("cluster", "cut").agg(F.count_if("flag").alias("n")).collect()}
        shown = plan(found)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in shown and "SortMergeJoin" not in shown and "ShuffledHashJoin" not in shown
    near = segments.assign_centroid(line, ["l_quantity", "l_extendedprice"], modelling.CENTROIDS).toPandas()
    for (c, cut), n in got.items():
        of = near[near["cluster"] == c]["distance"]
        assert cut == pytest.approx(of.quantile(0.99)) and n == int((of > cut).sum())


# baskets


def test_large_baskets_are_paired_in_blocks(spark):
    r = random.Random(2)
    rows = [(1, f"i{k}") for k in range(300)] + [(t, f"i{r.randrange(40)}") for t in range(2, 30) for _ in range(6)] + [(None, "i1"), (3, None)]
    df = spark.createDataFrame(rows, "tx long, item string")
    pairs = lambda block: sorted(map(tuple, rules.pair_support(df, "tx", "item", 1, block).collect()))
    assert pairs(7) == pairs(10**6) and len(pairs(7)) == 300 * 299 // 2
    assert sorted(map(tuple, rules.pair_rules(df, "tx", "item", 3, 7).collect())) == sorted(map(tuple, rules.pair_rules(df, "tx", "item", 3, 10**6).collect()))


def test_a_basket_of_thousands_of_items(spark):
    n = 4000
    df = spark.range(n).select(F.lit(1).alias("tx"), F.col("id").alias("item"))
    got = rules.pair_counts(df, 500).agg(F.count("*").alias("n"), F.max("n").alias("most")).first()
    assert (got.n, got.most) == (n * (n - 1) // 2, 1)


def some_baskets(spark, n=60):
    r = random.Random(5)
    held = {t: sorted({f"i{min(r.randrange(9), r.randrange(9))}" for _ in range(r.randrange(1, 8))}) for t in range(n)}
    df = spark.createDataFrame([(t, i) for t, items in held.items() for i in [*items, items[0]]] + [(None, "i1"), (1, None)], "tx long, item string")
    return held, df


def test_recommendations_are_cut_before_they_are_grouped(spark):
    held, df = some_baskets(spark)
    r = random.Random(6)
    made = {(f"i{a}", f"i{b}"): r.randrange(1, 6) / 8 for a in range(9) for b in range(30) if a != b and r.random() < 0.8}
    offered = spark.createDataFrame([(a, b, c) for (a, b), c in made.items()], "antecedent string, consequent string, confidence double")
    got = rules.recommend(rules.baskets(df, "tx", "item"), offered, 3)
    want = []
    for t, items in held.items():
        best = {}
        for (a, b), c in made.items():
            if a in items and b not in items:
                best[b] = max(best.get(b, 0), c)
        want += [(t, b, c, i + 1) for i, (b, c) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:3])]
    assert sorted(map(tuple, got.select("tx", "item", "score", "place").collect())) == sorted(want)
    assert not re.search(r"hashpartitioning\(tx#\d+L?, item#", plan(got))  # baskets stay where they are, and offers aren't shuffled
    assert "LeftAnti" not in plan(got)


def brute_sets(held, least):
    items = sorted({i for b in held.values() for i in b})
    found = {c: sum(set(c) <= set(b) for b in held.values()) for k in range(1, 8) for c in combinations(items, k)}
    return {c: n for c, n in found.items() if n >= least}


@pytest.mark.parametrize("minimum", [4, 0.1, 61])
def test_itemsets_of_any_size_are_counted_in_place(spark, minimum):
    held, df = some_baskets(spark)
    want = brute_sets(held, minimum if minimum >= 1 else math.ceil(minimum * len(held)))
    got = rules.frequent_itemsets(df, "tx", "item", minimum)
    assert {tuple(r["items"]): (r["size"], r["n"], r["support"]) for r in got.collect()} == {c: (len(c), n, n / len(held)) for c, n in want.items()}
    assert got.count() == len(want) and (minimum > 60 or max(map(len, want)) >= 4)
    assert "ExistingRDD" not in plan(got)  # no trees of whole shares of the baskets, made anew for each reader


def test_rules_of_itemsets(spark):
    held, df = some_baskets(spark)
    n, sets = len(held), brute_sets(held, 4)
    want = {}
    for c, joint in sets.items():
        for x in c if len(c) > 1 else ():
            a = tuple(i for i in c if i != x)
            if joint / sets[a] >= 0.5:
                want[a, x] = (joint / n, joint / sets[a], joint * n / (sets[a] * sets[x,]))
    got = rules.itemset_rules(df, "tx", "item", 4, 0.5)
    told = {(tuple(r["antecedent"]), r["consequent"]): (r["support"], r["confidence"], r["lift"]) for r in got.collect()}
    assert set(told) == set(want) and len(want) > 20
    assert all(told[k] == pytest.approx(want[k]) for k in want)
    assert "ExistingRDD" not in plan(got)


# isolation forest


@pytest.mark.parametrize("n", [100, 2000, 1_000_000])
def test_each_tree_has_its_sample_at_any_size(spark, n):
    df = spark.range(n).select("id", (F.col("id") * 37 % 1009).cast("double").alias("x"))
    made = anomaly.tree_samples(df, ["x"], "id", 100, 256, 7)
    sizes = [r["count"] for r in made.groupBy("tree").count().collect()]
    assert len(sizes) == 100 and set(sizes) == {min(n, 256)}


def test_forest_scores_by_hand(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate((rng.normal(size=(300, 2)), [[9.0, 9.0], [-8.0, 7.0]]))
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, a double, b double")
    samples = anomaly.tree_samples(df, ["a", "b"], "id", 20, 64, 3)
    nodes = anomaly.forest_nodes(samples, ["a", "b"], 3).toPandas()
    c = lambda m: 0.0 if m <= 1 else 1.0 if m == 2 else 2 * (math.log(m - 1) + 0.5772156649) - 2 * (m - 1) / m
    data = samples.toPandas()
    at = {(r.tree, r.node): r for r in nodes.itertuples()}

    def path(tree, point):
        """Depth of the point's leaf, and the mean depth below it by how many rows of the tree's own sample end there."""
        node, depth, rows = 0, 0, data[data.tree == tree][["a", "b"]].to_numpy()
        while at[tree, node].feature >= 0:
            f, cut = at[tree, node].feature, at[tree, node].cut
            low = point[f] < cut
            rows = rows[(rows[:, f] < cut) == low]
            node, depth = 2 * node + (1 if low else 2), depth + 1
        return depth + c(len(rows))

    got = {r.id: r.score for r in anomaly.forest_scores(df, ["a", "b"], nodes).collect()}
    for i in (0, 7, 299, 300, 301):
        want = 2 ** (-np.mean([path(t, x[i]) for t in range(20)]) / c(64))
        assert got[i] == pytest.approx(want)
    assert min(got[300], got[301]) > max(v for k, v in got.items() if k < 300) - 0.05


# mixtures, ridge, importance, ranks, sketches, stages


@pytest.mark.parametrize("seed", range(10))
def test_mixture_recovers_blobs(spark, seed):
    rng = np.random.default_rng(seed)
    centres = np.array([[0, 0], [6, 0], [0, 7]]) + rng.normal(size=(3, 2))
    spread = [np.diag([1.0, 0.2]), np.array([[0.5, 0.3], [0.3, 0.5]]), np.eye(2) * 0.3]
    x = np.concatenate([rng.multivariate_normal(m, s, 150 + 60 * k) for k, (m, s) in enumerate(zip(centres, spread, strict=True))])
    df = spark.createDataFrame(pd.DataFrame({"x": x[:, 0], "y": x[:, 1], "g": np.repeat([0, 1, 2], [150, 210, 270])}))
    model = segments.mixture_fit(df, ["x", "y"], 3, seed)
    purity = segments.cluster_purity(model.transform(df), "prediction", "g").where("n > 20").agg(F.min("purity"), F.count("*")).first()
    assert purity[0] > 0.97 and purity[1] == 3
    for m, c, n in zip(centres, spread, (150, 210, 270), strict=True):
        k = int(np.argmin(((model.means - m) ** 2).sum(axis=1)))
        assert np.abs(model.means[k] - m).max() < 0.35 and np.abs(model.covariances[k] - c).max() < 0.35 and model.weights[k] == pytest.approx(n / 630, abs=0.03)


def test_ridge_from_sums_equals_cross_validator(spark):
    df = modelling.exact_line(spark, SF).select("l_orderkey", "l_quantity", "l_discount", "l_tax", "flag_r", "noisy")
    xs, regs = ["l_quantity", "l_discount", "l_tax", "flag_r"], [0.0, 0.5, 10.0]
    got = {r.params: (r.mean_rmse, r.sd_rmse) for r in automl.linear_cross_validate(df, "noisy", xs, "l_orderkey", regs, 3).collect()}
    folds = VectorAssembler(inputCols=xs, outputCol="features").transform(hash_split(df, "l_orderkey", 3))
    est = LinearRegression(labelCol="noisy", solver="normal")
    cv = CrossValidator(estimator=est, estimatorParamMaps=[{est.regParam: r} for r in regs], evaluator=RegressionEvaluator(labelCol="noisy", metricName="rmse"), numFolds=3, foldCol="fold").fit(folds)
    for r, mean, sd in zip(regs, cv.avgMetrics, cv.stdMetrics, strict=True):
        assert got[str({"regParam": r})] == (pytest.approx(mean, rel=1e-8), pytest.approx(sd, rel=1e-6))


@pytest.mark.parametrize("n", [1, 2, 97, 1000, 4096])
def test_reordering_moves_every_value_once(spark, n):
    a, c = automl.bijection(n, 3)
    assert sorted((a * r + c) % n for r in range(n)) == list(range(n))
    df = spark.range(n).select(F.col("id").alias("__pos"), (F.col("id") * 10).alias("v"))
    moved = automl.reordered(df, "v", n, 3)
    assert sorted(r.v for r in moved.collect()) == [10 * i for i in range(n)] and moved.columns == ["v"]


def test_ranks_take_one_join_for_all_columns(spark):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({c: rng.integers(0, 9, 400).astype(float) for c in "abc"})
    frame.loc[3, "b"] = None
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "a double, b double, c double")
    got = {(r.a, r.b): r["corr"] for r in charts.corr_matrix(df, ["a", "b", "c"], "spearman").collect()}
    want = frame.dropna().rank().corr()
    assert all(v == pytest.approx(want.loc[a, b]) for (a, b), v in got.items()) and len(got) == 3
    assert plan(charts.average_ranks(df, ["a", "b", "c"])).count("Join") <= 2  # AQE shows the first plan and the one that runs


def test_common_values_are_ranked_without_the_join(spark):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"a": rng.integers(0, 5, 1000).astype(float), "b": rng.normal(size=1000), "c": np.where(rng.random(1000) < 0.5, 0.0, rng.normal(size=1000))})
    df = spark.createDataFrame(frame)
    rows = charts.to_rank(df.withColumn("__row", F.monotonically_increasing_id()), list("abc"), {0: {float(x): 1.0 for x in range(5)}, 2: {0.0: 2.0}})
    assert {r.c: r["count"] for r in rows.groupBy("c").count().collect()} == {-1: 1000, 1: 1000, 2: int((frame.c != 0).sum())}
    got = {(r.a, r.b): r["corr"] for r in charts.corr_matrix(df, list("abc"), "spearman").collect()}
    want = frame.rank().corr()
    assert all(v == pytest.approx(want.loc[x, y]) for (x, y), v in got.items()) and len(got) == 3


def test_sketches_keep_within_their_bounds(spark):
    df = spark.range(60_000).select((F.hash("id") % 100_003).cast("double").alias("v"), (F.pmod(F.xxhash64("id"), F.lit(3)) == 0).cast("int").alias("y")).withColumn("v", F.col("v") + 9000 * F.col("y"))
    exact, told = anomaly.auc(df, "y", "v").first(), anomaly.auc_sketched(df, "y", "v").first()
    assert abs(exact.auc - told.auc) <= told.error < 0.01 and (exact.n_pos, exact.n_neg) == (told.n_pos, told.n_neg)
    a, b = df.where("y = 1"), df.where("y = 0")
    exact, told = audit.ks(a, b, "v").first(), audit.ks_sketched(a, b, "v").first()
    assert abs(exact.ks - told.ks) <= told.error < 0.01
    values = np.sort([r.v for r in df.collect()])
    for r in charts.ecdf_sketched(df, "v", [0.01, 0.5, 0.99]).collect():
        assert abs(np.searchsorted(values, r.value, "right") / len(values) - r.asked) <= r.error + 1 / len(values)
    assert audit.ks_sketched(df.limit(0), df, "v").first().ks is None and charts.ecdf_sketched(df.limit(0), "v", [0.5]).collect() == []


def test_stage_counts_come_from_the_pass_that_makes_the_rows(spark):
    line, orders = tables(spark, SF, "lineitem", "orders")
    kept, stages = audited_regression.passed(line, orders)
    both = line.join(orders, line.l_orderkey == orders.o_orderkey)
    assert stages["n_joined"] == both.count() and stages["n_passed"] == kept.count() == both.where("l_shipdate >= o_orderdate AND l_extendedprice > 0").count()
    assert "lineitem.parquet" not in plan(audited_regression.audited_regression(line, orders))


def test_encoding_keeps_rows_without_a_fold(spark):
    df = spark.createDataFrame([("a", 1.0, 0), ("a", 3.0, 1), ("a", 5.0, None), (None, 7.0, 1)], "k string, y double, f int")
    got = {(r.k, r.f): r.encoded for r in prep.target_encode(df, "k", "y", "f", 1.0).collect()}
    assert got == {("a", 0): pytest.approx((8 + 5) / 3), ("a", 1): pytest.approx((6 + 3) / 3), ("a", None): pytest.approx((4 + 11 / 3) / 3), (None, 1): pytest.approx(3.0)}


# rows of equal features


def test_alike_rows_keep_number_sum_and_sum_of_squares(spark):
    df = spark.createDataFrame([(1, 0.5, 1.0), (1, 0.5, 4.0), (1, 0.5, 4.0), (2, 0.5, 7.0), (None, 0.5, 3.0), (None, 0.5, 3.0), (1, None, 9.0), (1, 0.5, None)], "g int, x double, y double")
    got = regression.alike(df, ["x"], "y", ["g"])
    sums = {r.g: (r.n, r.s, r.q) for r in got.groupBy("g").agg(F.sum("weight").alias("n"), F.sum(F.expr("weight * y")).alias("s"), F.sum(F.expr("weight * y * y")).alias("q")).collect()}
    assert sums == {1: pytest.approx((3, 9, 33)), 2: pytest.approx((1, 7, 49)), None: pytest.approx((2, 6, 18))}
    assert got.count() == 4


def test_fits_over_alike_rows_are_those_over_all(spark):
    """Columns of at most 32 values, whose thresholds Spark doesn't draw."""
    df = spark.range(4000).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 11 / 11).alias("b"), (F.col("id") % 3).alias("g"))
    df = df.withColumn("y", 3 * F.col("a") - 2 * F.col("b") + modelling.uniform("id", "n"))
    candidates = {"linear": (LinearRegression(solver="normal"), {"regParam": [0.0, 1.0]}), "tree": (DecisionTreeRegressor(seed=7), {"maxDepth": [2, 4]})}
    assert automl.weighed(df, "y", candidates, ["a", "b"], ["g"]).count() == 2 * 7 * 11 * 3
    got = {(r.model, r.params): (r.mean_rmse, r.sd_rmse) for r in automl.cross_validate(df, "y", "id", candidates, 3, ["a", "b"], ["g"]).collect()}
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(hash_split(df, "id", 3))
    for name, (estimator, grid) in candidates.items():
        made = CrossValidator(estimator=estimator.copy({estimator.labelCol: "y"}), estimatorParamMaps=automl.settings(estimator, grid), evaluator=RegressionEvaluator(labelCol="y", metricName="rmse"), numFolds=3, foldCol="fold").fit(rows)
        for m, a, d in zip(made.getEstimatorParamMaps(), made.avgMetrics, made.stdMetrics, strict=True):
            assert got[name, automl.named(m)] == pytest.approx((a, d), rel=1e-6, abs=1e-9)
    errors = [regression.regression_metrics(regression.mean_baseline(rows.where(F.col("fold") != f), rows.where(F.col("fold") == f), ["g"], "y"), "y", "yhat").first()["rmse"] for f in range(3)]
    assert got["group mean", "{}"] == pytest.approx((np.mean(errors), np.std(errors)))
    train, test = df.where("id % 5 <> 0"), df.where("id % 5 = 0")
    held = {(r.model, r.params): r.holdout_rmse for r in automl.holdout_scores(train, test, "y", candidates, ["a", "b"], ["g"]).collect()}
    plain = VectorAssembler(inputCols=["a", "b"], outputCol="features")
    scored = DecisionTreeRegressor(labelCol="y", seed=7, maxDepth=4).fit(plain.transform(train)).transform(plain.transform(test))
    assert held["tree", "{'maxDepth': 4}"] == pytest.approx(regression.regression_metrics(scored, "y", "prediction").first()["rmse"])


def test_candidates_that_need_single_rows_get_them(spark):
    df = spark.range(300).select("id", (F.col("id") % 2).cast("double").alias("a"), (F.col("id") % 3).cast("double").alias("y"), F.lit(1).alias("g"))
    candidates = {"tree": (DecisionTreeRegressor(seed=7), {"minInstancesPerNode": [1, 50]})}
    rows = automl.weighed(df, "y", candidates, ["a"], ["g"])
    assert rows.count() == 300 and rows.agg(F.sum("weight")).first()[0] == 300
    assert automl.cross_validate(df, "y", "id", candidates, 3, ["a"], ["g"]).count() == 3


def test_boosting_goes_over_alike_rows(spark):
    df = spark.range(2000).select((F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"), (F.col("id") % 7 * 2 + F.col("id") % 5 + modelling.uniform("id", "n")).alias("y"))
    model = regression.tree_fit(df, ["a", "b"], "y")
    assert model.stages[-1].getWeightCol() == "weight"
    plain = GBTRegressor(labelCol="y", seed=7, maxIter=20, maxDepth=4).fit(model.stages[0].transform(df))
    known = model.stages[0].transform(df.select("a", "b").distinct())
    want = {(r.a, r.b): r.prediction for r in plain.transform(known).collect()}
    assert {(r.a, r.b): r.prediction for r in model.stages[-1].transform(known).collect()} == {k: pytest.approx(v) for k, v in want.items()}


# texts


def test_texts_are_read_once_for_a_bigram_model(spark):
    df = spark.createDataFrame([(1, "a b a b c"), (2, "d"), (3, None), (4, "B a")], "k int, t string")
    model = corpus.bigram_model(df, "k", "t", 0.5)
    made = corpus.probabilities(model, 0.5)
    assert "regexp" not in plan(made)  # from written counts
    assert {(r.w0, r.w1): r.p for r in made.collect()} == {("a", "b"): pytest.approx(2.5 / 4.5), ("b", "a"): pytest.approx(2.5 / 5.5), ("b", "c"): pytest.approx(1.5 / 5.5)}
    assert model[2] == 5
    got = corpus.perplexity(spark.createDataFrame([(9, "a b a z"), (8, "x")], "k int, t string"), "k", "t", model, 0.5)
    assert [(r.k, r.n_bigrams, r.perplexity) for r in got.collect()] == [(9, 3, pytest.approx((2.5 / 4.5 * 2.5 / 5.5 * 0.5 / 4.5) ** (-1 / 3)))]
    assert not re.search(r"hashpartitioning\(k#\d+L?, w0#", plan(got))  # a shuffle less
