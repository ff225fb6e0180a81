"""Anomaly scores, flags, and their evaluation."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.columns import one_row, ratio, with_stats
from quarry.functions.ordered import BLOCK, back, blocked, quantiles, running
from quarry.functions.sketches import quantiles_of, rank_error, ranks_of
from quarry.operators.segments import assign_centroid


def zscore(df: DataFrame, col: str, by: list[str], t: float = 3.0) -> DataFrame:
    """Adds z by mean and sample deviation of the group (all rows without by; null for no spread) and flag |z| > t."""
    stats = df.groupBy(*by).agg(F.avg(col).alias("__m"), F.stddev_samp(col).alias("__s"))
    z = ratio(F.col(col) - F.col("__m"), F.col("__s"))
    return with_stats(df, stats, by).withColumn("z", z).withColumn("flag", F.coalesce(F.abs("z") > t, F.lit(False))).drop("__m", "__s")


def mad_score(df: DataFrame, col: str, by: list[str], t: float = 3.5) -> DataFrame:
    """Adds z by the median and 1.4826 times the median absolute deviation (null for none), and flag."""
    with_median = with_stats(df, quantiles(df, col, [0.5], by).select(*by, F.col("q")[0].alias("__m")), by)
    away = with_median.select(*by, F.abs(F.col(col) - F.col("__m")).alias("__away"))
    spread = quantiles(away, "__away", [0.5], by).select(*by, F.col("q")[0].alias("__d"))
    z = ratio(F.col(col) - F.col("__m"), F.col("__d") * 1.4826)
    return with_stats(with_median, spread, by).withColumn("z", z).withColumn("flag", F.coalesce(F.abs("z") > t, F.lit(False))).drop("__m", "__d")


def iqr_fence(df: DataFrame, col: str, by: list[str], k: float = 1.5) -> DataFrame:
    """Adds low and high (quartiles less and plus k times their distance) and flag for values outside."""
    q = quantiles(df, col, [0.25, 0.75], by).withColumnRenamed("q", "__q")
    q = q.select(*by, (F.col("__q")[0] - k * (F.col("__q")[1] - F.col("__q")[0])).alias("low"), (F.col("__q")[1] + k * (F.col("__q")[1] - F.col("__q")[0])).alias("high"))
    return with_stats(df, q, by).withColumn("flag", F.coalesce((F.col(col) < F.col("low")) | (F.col(col) > F.col("high")), F.lit(False)))


def rolling_z(df: DataFrame, col: str, by: list[str], order: list[str], n: int, m: int, t: float, block: int = BLOCK) -> DataFrame:
    """Adds z against the n rows before (without the row itself; null for fewer than m or no spread) and flag. Long groups are cut into blocks."""
    rows, keys, own = blocked(df, order, n, by, block)
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-n, -1)
    z = F.when(F.count(col).over(w) >= m, ratio(F.col(col) - F.avg(col).over(w), F.stddev_samp(col).over(w)))
    return back(rows.withColumn("z", z), own).withColumn("flag", F.coalesce(F.abs("z") > t, F.lit(False)))


def mahalanobis(df: DataFrame, cols: list[str], t: float) -> DataFrame:
    """Adds d2, the squared distance from the mean by the inverse sample covariance, and flag d2 > t."""
    d = len(cols)
    got = df.agg(*[F.avg(c) for c in cols], *[F.covar_samp(a, b) for a in cols for b in cols]).first()
    if any(x is None for x in got):
        return df.withColumn("d2", F.lit(None).cast("double")).withColumn("flag", F.lit(False))
    mean, inverse = got[:d], np.linalg.pinv(np.array(got[d:], float).reshape(d, d))
    off = [F.col(c) - F.lit(float(m)) for c, m in zip(cols, mean, strict=True)]
    d2 = sum((off[i] * off[j] * F.lit(float(inverse[i, j])) for i in range(d) for j in range(d)), F.lit(0.0))
    return df.withColumn("d2", d2).withColumn("flag", F.coalesce(F.col("d2") > t, F.lit(False)))


def centroid_outliers(df: DataFrame, cols: list[str], centroids: list[list[float]], p: float) -> DataFrame:
    """assign_centroid with flag for distances over the cluster's p-percentile. There is a cut per centroid, so they go to all tasks and the rows stay where they are."""
    near = assign_centroid(df, cols, centroids)
    cut = quantiles(near, "distance", [p], ["cluster"]).select("cluster", F.col("q")[0].alias("cut"))
    return near.join(F.broadcast(cut), "cluster").withColumn("flag", F.col("distance") > F.col("cut"))


def rare_values(df: DataFrame, col: str, floor: float) -> DataFrame:
    """value, n, share of values with a share of rows below floor."""
    counts = df.groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"))
    return counts.crossJoin(one_row(counts.agg(F.sum("n").alias("__all")))).withColumn("share", ratio(F.col("n"), F.col("__all"))).where(F.col("share") < floor).drop("__all")


def count_spikes(df: DataFrame, ts: str, bucket: str, by: list[str], n: int, m: int, t: float) -> DataFrame:
    """by, period, n_rows, z, flag: rows per period (0 for empty ones), against the periods before."""
    from quarry.operators.forecast import fill_gaps, resample

    counts = fill_gaps(resample(df, ts, bucket, {"n_rows": F.count("*").cast("double")}, by), "period", f"1 {bucket}", "zero", by, "n_rows")
    return rolling_z(counts, "n_rows", by, ["period"], n, m, t)


def average_path(n: float) -> float:
    """Mean depth of an unsuccessful search among n, by which path lengths are scaled."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def tree_samples(df: DataFrame, cols: list[str], key: str, trees: int, sample: int, seed: int) -> DataFrame:
    """cols, tree: `sample` rows without nulls for each tree, drawn without replacement (all rows where there are fewer).

    Each row is dealt to several trees by hashes of its key, about twice as many rows as are needed in all, and each
    tree takes those of the smallest hashes. The rows that are shuffled don't grow with the table.
    """
    whole = df.select(*cols, key).dropna()
    n = max(1, whole.count())
    if n <= 16 * sample:  # every row to every tree
        tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))
    else:
        each = 2.0 * sample * trees / n  # trees a row is dealt to, on average
        draws = max(1, round(each))
        accepted = F.filter(F.transform(F.sequence(F.lit(1), F.lit(draws)), lambda j: F.when(F.pmod(F.xxhash64(F.lit(seed), F.col(key), j), F.lit(1_000_000)) < int(1_000_000 * min(1.0, each / draws)), F.pmod(F.xxhash64(F.lit(seed + 1), F.col(key), j), F.lit(trees)))), lambda t: t.isNotNull())
        tree = F.explode(F.array_distinct(accepted))
    dealt = whole.withColumn("tree", tree).withColumn("tree", F.col("tree").cast("int"))
    order = Window.partitionBy("tree").orderBy(F.xxhash64(F.lit(seed + 2), F.col(key), F.col("tree")), key)
    return dealt.withColumn("__place", F.row_number().over(order)).where(F.col("__place") <= sample).select(*cols, "tree")


def forest_nodes(samples: DataFrame, cols: list[str], seed: int) -> DataFrame:
    """tree, node (children of i: 2i+1, 2i+2), feature (-1: a leaf), cut, path (of a leaf: its depth and the mean depth below), size of the tree's sample. Each tree grows in a task of its own."""

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng([seed, tree])
        x = pdf[cols].sort_values(cols).to_numpy(float)
        most = math.ceil(math.log2(max(2, len(x))))
        rows: list[tuple] = []
        todo = [(0, np.arange(len(x)), 0)]
        while todo:
            node, at, depth = todo.pop()
            spread = np.ptp(x[at], axis=0) if len(at) else np.zeros(len(cols))
            if depth >= most or len(at) <= 1 or not spread.any():
                rows.append((tree, node, -1, 0.0, depth + average_path(len(at)), len(x)))
                continue
            f = int(rng.choice(np.flatnonzero(spread)))
            cut = float(rng.uniform(x[at, f].min(), x[at, f].max()))
            rows.append((tree, node, f, cut, 0.0, len(x)))
            todo += [(2 * node + 1, at[x[at, f] < cut], depth + 1), (2 * node + 2, at[x[at, f] >= cut], depth + 1)]
        return pd.DataFrame(rows, columns=["tree", "node", "feature", "cut", "path", "size"])

    return samples.groupBy("tree").applyInPandas(grow, "tree int, node long, feature int, cut double, path double, size long")


def forest_scores(df: DataFrame, cols: list[str], nodes: pd.DataFrame) -> DataFrame:
    """df with score 2^(-E[h] / c(size)): mean path length over the trees by that of an unsuccessful search. Rows with a null have none."""
    grown = [{r.node: (r.feature, r.cut, r.path) for r in t.itertuples()} for _, t in nodes.sort_values(["tree", "node"]).groupby("tree")]
    scale = average_path(float(nodes["size"].mean())) if len(nodes) else 1.0
    sent = df.sparkSession.sparkContext.broadcast(grown)  # at most trees * 2 * sample nodes

    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            x = pdf[cols].to_numpy(float)
            total = np.zeros(len(x))
            for tree in sent.value:
                todo = [(0, np.arange(len(x)))]
                while todo:
                    node, at = todo.pop()
                    f, cut, path = tree[node]
                    if f < 0:
                        total[at] += path
                    elif len(at):
                        low = x[at, f] < cut
                        todo += [(2 * node + 1, at[low]), (2 * node + 2, at[~low])]
            found = 2 ** (-total / max(1, len(sent.value)) / max(scale, 1e-9))
            yield pdf.assign(score=np.where(np.isnan(x).any(axis=1), np.nan, found))

    return df.mapInPandas(score, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", score double")


def isolation_forest(df: DataFrame, cols: list[str], key: str, trees: int = 100, sample: int = 256, seed: int = 7) -> DataFrame:
    """Adds score (0 to 1, higher: easier to isolate) by `trees` trees on samples of `sample` rows each, whatever the table's size."""
    nodes = forest_nodes(tree_samples(df, cols, key, trees, sample, seed), cols, seed).toPandas()
    return forest_scores(df, cols, nodes)


def detector_metrics(df: DataFrame, label: str, score: str, t: float) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1 of score >= t; rows without label or score don't count."""
    known = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).select((F.col(label) == 1).alias("y"), (F.col(score) >= t).alias("p"))
    c = known.agg(F.count_if(F.col("y") & F.col("p")).alias("tp"), F.count_if(~F.col("y") & F.col("p")).alias("fp"), F.count_if(F.col("y") & ~F.col("p")).alias("fn"), F.count_if(~F.col("y") & ~F.col("p")).alias("tn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def by_score(df: DataFrame, label: str, score: str) -> DataFrame:
    """score, pos, neg: counts at each distinct score, which windows then run over instead of over rows."""
    known = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    return known.groupBy(F.col(score).alias("score")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """n_pos, n_neg, auc (area under the ROC curve; ties count one half)."""
    ranked = running(by_score(df, label, score), "score", ["neg"]).withColumn("below", F.col("neg_run") - F.col("neg"))
    won = F.sum(F.col("pos") * (F.col("below") + F.col("neg") * 0.5))
    return ranked.agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), ratio(won, (F.sum("pos") * F.sum("neg")).cast("double")).alias("auc"))


def auc_sketched(df: DataFrame, label: str, score: str, k: int = 4000, points: int = 500) -> DataFrame:
    """n_pos, n_neg, auc, error: the same from one KLL sketch per label, in one pass and without a shuffle of scores.

    A sketch of size k tells ranks to within rank_error(k) of its rows (with 99 % confidence); the mean rank of
    `points` evenly spaced quantiles of one label among the other's is off by both errors and half a step at most.
    """
    known = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).select((F.col(label) == 1).alias("__y"), F.col(score).cast("double").alias("__s"))
    row = known.agg(F.count_if("__y").alias("n_pos"), F.count_if(~F.col("__y")).alias("n_neg"), *[F.kll_sketch_agg_double(F.when(F.col("__y") == y, F.col("__s")), F.lit(k)).alias(n) for y, n in ((True, "__p"), (False, "__n"))]).first()
    found = None
    if row["n_pos"] and row["n_neg"]:
        session = df.sparkSession
        values = quantiles_of(session, row["__p"], [(i + 0.5) / points for i in range(points)])
        found = sum(ranks_of(session, row["__n"], values)) / points
    return df.sparkSession.createDataFrame([(row["n_pos"], row["n_neg"], found, 2 * rank_error(k) + 0.5 / points)], "n_pos long, n_neg long, auc double, error double")


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    """average_precision over distinct scores from the highest."""
    ranked = running(by_score(df, label, score), "score", ["pos", "neg"], descending=True).withColumns({"tp": F.col("pos_run"), "seen": F.col("pos_run") + F.col("neg_run")})
    return ranked.agg(ratio(F.sum(F.col("pos") * F.col("tp") / F.col("seen")), F.sum("pos")).alias("average_precision"))


def precision_at_k(df: DataFrame, label: str, score: str, key: str, k: int) -> DataFrame:
    """k, hits, precision among the k rows of highest score; ties by key."""
    top = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).orderBy(F.col(score).desc(), key).limit(k)
    return top.agg(F.lit(k).cast("long").alias("k"), F.count_if(F.col(label) == 1).alias("hits"), F.avg((F.col(label) == 1).cast("double")).alias("precision"))
