"""Properties that hold for any rows: order and partitions of rows change nothing, supports and scores keep their bounds."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.operators import anomaly, audit, charts, regression, rules, segments

few = settings(max_examples=4, deadline=None, derandomize=True, suppress_health_check=[HealthCheck.function_scoped_fixture])
number = st.one_of(st.none(), st.integers(-50, 50).map(float))


@few
@given(rows=st.lists(st.tuples(st.integers(0, 5), st.one_of(st.none(), st.sampled_from("abcdef"))), min_size=1, max_size=40), parts=st.integers(1, 5))
def test_supports(spark, rows, parts):
    df = spark.createDataFrame(rows, "tx int, item string")
    single = {r.item: r.support for r in rules.item_support(df, "tx", "item", 1).collect()}
    pairs = sorted(map(tuple, rules.pair_support(df, "tx", "item", 1, 2).collect()))
    assert all(a < b and 0 < s <= min(single[a], single[b]) <= 1 for a, b, _, s in pairs)
    assert pairs == sorted(map(tuple, rules.pair_support(df.orderBy(F.desc("tx")).repartition(parts), "tx", "item", 1, 100).collect()))


@few
@given(values=st.lists(number, min_size=2, max_size=40), scale=st.sampled_from([0.5, 4.0]), parts=st.integers(1, 5))
def test_scores(spark, values, scale, parts):
    df = spark.createDataFrame([(i, i % 3, v, None if v is None else v * scale + 7) for i, v in enumerate(values)], "id int, g int, v double, w double")
    for score in (anomaly.zscore, anomaly.mad_score):
        z = [{r.id: r.z for r in score(df.repartition(parts), c, ["g"]).collect()} for c in ("v", "w")]
        assert set(z[0]) == set(range(len(values)))
        assert all(z[0][i] == (None if z[1][i] is None else pytest.approx(z[1][i], abs=1e-6)) for i in z[0])
    std = {r.id: (r.v_std, r.w_std) for r in segments.standardize(df, ["v", "w"], "robust").collect()}
    assert all(a == (None if b is None else pytest.approx(b, abs=1e-9)) for a, b in std.values())


@few
@given(rows=st.lists(st.tuples(number, number), min_size=1, max_size=40), parts=st.integers(1, 5))
def test_metrics(spark, rows, parts):
    df = spark.createDataFrame(rows, "y double, p double").repartition(parts)
    m = regression.regression_metrics(df, "y", "p").first()
    known = [(y, p) for y, p in rows if y is not None and p is not None]
    assert m["n"] == len(known) and (not known or (0 <= m["mae"] <= m["rmse"] + 1e-9 and (m["r2"] is None or m["r2"] <= 1)))
    labelled = df.withColumn("label", (F.col("y") > 0).cast("int"))
    auc = anomaly.auc(labelled, "label", "p").first()["auc"]
    pairs = [(p > q) + (p == q) / 2 for y, p in known if y > 0 for z, q in known if z <= 0]
    assert auc == (pytest.approx(sum(pairs) / len(pairs)) if pairs else None)
    share = [r.share for r in charts.ecdf(df, "y").orderBy("value").collect()]
    assert share == sorted(share) and (not share or share[-1] == 1)
    d = audit.ks(df.select("y"), df.select(F.col("p").alias("y")), "y").first()["ks"]
    assert d is None or 0 <= d <= 1
