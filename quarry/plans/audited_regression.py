"""The integrated job: audit, rows that pass, features, baseline, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quarry.operators.regression import calendar_features, hash_split, mean_baseline, regression_metrics
from quarry.sources.shared import written


def passed(line: DataFrame, orders: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """The rows that pass with their features, written once, and the rows of each stage, observed in the pass that makes them."""
    both = line.join(orders.select("o_orderkey", "o_orderdate"), line.l_orderkey == orders.o_orderkey)
    good = F.coalesce((F.col("l_shipdate") >= F.col("o_orderdate")) & (F.col("l_extendedprice") > 0), F.lit(False))
    rows = hash_split(calendar_features(both.withColumn("good", good), "o_orderdate"), "l_orderkey", 5)
    seen = Observation("stages")
    watched = rows.observe(seen, F.count("*").alias("n_joined"), F.count_if("good").alias("n_passed"), F.count_if(F.col("good") & (F.col("fold") != 0)).alias("n_train"))
    kept = written(watched.where("good").select("l_returnflag", "month", "is_weekend", "l_extendedprice", "fold"), "passed")
    return kept, seen.get


def audited_regression(line: DataFrame, orders: DataFrame) -> DataFrame:
    """is_weekend, rows at each stage, n, mae, rmse of the group-mean baseline for the price of lines.

    Lines pass that ship on or after their order's date and have a price; the baseline groups by return flag and
    month of the order, learned on four folds of five and scored on the fifth.
    """
    kept, stages = passed(line, orders)
    scored = mean_baseline(kept.where("fold <> 0"), kept.where("fold = 0"), ["l_returnflag", "month"], "l_extendedprice")
    counts = [F.lit(stages[c]).cast("long").alias(c) for c in ("n_joined", "n_passed", "n_train")]
    return regression_metrics(scored, "l_extendedprice", "yhat", ["is_weekend"]).select("is_weekend", *counts, "n", "mae", "rmse")
