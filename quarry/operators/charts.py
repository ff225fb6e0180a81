"""Aggregates behind charts: Spark reduces the rows to what a chart draws."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.columns import one_row, ratio, with_stats
from quarry.functions.ordered import quantiles, running
from quarry.functions.sketches import rank_error
from quarry.sources.shared import written


def histogram(df: DataFrame, col: str, low: float, high: float, n: int) -> DataFrame:
    """bin, low, high, n of equal bins; the last is closed, empty ones are there, values outside don't count."""
    place = F.least(F.floor((F.col(col) - low) / ((high - low) / n)), F.lit(n - 1)).cast("int")
    counts = df.where(F.col(col).between(low, high)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    grid = df.sparkSession.range(n).select(F.col("id").cast("int").alias("bin"))
    edge = lambda k: F.lit(low) + k * F.lit((high - low) / n)
    return one_row(grid).join(counts, "bin", "left").select("bin", edge(F.col("bin")).alias("low"), edge(F.col("bin") + 1).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def boxplot(df: DataFrame, col: str, by: list[str], k: float = 1.5) -> DataFrame:
    """by, q1, median, q3, whisker_low, whisker_high (last values inside the fence), n_outliers."""
    q = quantiles(df, col, [0.25, 0.5, 0.75], by).select(*by, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    inside = F.col(col).between(F.col("q1") - k * (F.col("q3") - F.col("q1")), F.col("q3") + k * (F.col("q3") - F.col("q1")))
    each = with_stats(df.where(F.col(col).isNotNull()), q, by)
    return each.groupBy(*by, "q1", "median", "q3").agg(F.min(F.when(inside, F.col(col))).alias("whisker_low"), F.max(F.when(inside, F.col(col))).alias("whisker_high"), F.count_if(~inside).alias("n_outliers"))


def ecdf(df: DataFrame, col: str, shares: list[float] | None = None) -> DataFrame:
    """value, n, share of rows at or below it, at distinct values of any sortable type; or with shares, for each of them (asked) the row of the least value with so many."""
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"))
    run = running(counts, "value", ["n"], totals=True).withColumn("__before", F.col("n_run") - F.col("n"))
    out = run.select("value", "n", ratio(F.col("n_run"), F.col("n_all")).alias("share"), ratio(F.col("__before"), F.col("n_all")).alias("__before"))
    if shares is None:
        return out.drop("__before")
    # a share of 0 is asked of the first value
    met = lambda p: (F.lit(float(p)) <= F.col("share")) & ((F.lit(float(p)) > F.col("__before")) | ((F.lit(float(p)) <= 0) & (F.col("__before") <= 0)))
    asked = F.filter(F.array(*[F.when(met(p), F.lit(float(p))) for p in shares]), lambda x: x.isNotNull())
    return out.where(F.size(asked) > 0).select(F.explode(asked).alias("asked"), "value", "n", "share")


def ecdf_sketched(df: DataFrame, col: str, shares: list[float], k: int = 4000) -> DataFrame:
    """asked, value, error: values whose shares of rows are within `error` of those asked for, from one KLL sketch in one pass."""
    made = df.agg(F.kll_sketch_agg_double(F.col(col).cast("double"), F.lit(k)).alias("__s"))
    at = F.array(*[F.lit(float(p)) for p in shares])
    return made.where(F.kll_sketch_get_n_double("__s") > 0).select(F.explode(F.arrays_zip(at.alias("asked"), F.kll_sketch_get_quantile_double("__s", at).alias("value"))).alias("x")).select("x.asked", "x.value", F.lit(rank_error(k)).alias("error"))


def to_rank(base: DataFrame, cols: list[str], often: dict[int, dict[float, float]]) -> DataFrame:
    """__row, c, v, known: a row of each value of base whose rank isn't in `often` (column's place -> value -> rank), and one (c is -1, v the row's own) of the ranks known from it."""
    look = lambda i, c: F.try_element_at(F.create_map(*[F.lit(x) for pair in often[i].items() for x in pair]), F.col(c)) if often.get(i) else F.lit(None).cast("double")
    known = base.select("__row", *cols, F.array(*[look(i, c) for i, c in enumerate(cols)]).alias("known"))
    none = F.lit(None).cast("array<double>")
    own = F.struct(F.lit(-1).alias("c"), F.col("__row").cast("double").alias("v"), F.col("known"))
    each = [F.struct(F.lit(i).alias("c"), F.when(F.col("known")[i].isNull(), F.col(c)).alias("v"), none.alias("known")) for i, c in enumerate(cols)]
    return known.select("__row", F.explode(F.array(own, *each)).alias("x")).select("__row", "x.*").where("v IS NOT NULL")


def average_ranks(df: DataFrame, cols: list[str]) -> DataFrame:
    """cols as average ranks; rows with a null don't count.

    All columns are ranked together: their values in long form, counted, put in order by one range exchange, and joined
    back and regrouped by row once. Values of a hundredth of the rows or more, at most 100 a column, are looked up
    instead, so no task of the join gets a common value.
    """
    base = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).dropna().withColumn("__row", F.monotonically_increasing_id())
    counts = to_rank(base, cols, {}).where("c >= 0").groupBy("c", "v").agg(F.count("*").alias("n"))
    ranks = written(running(counts, "v", ["n"], ["c"]).select("c", "v", "n", (F.col("n_run") - (F.col("n") - 1) / 2).alias("rank")), "ranks")
    total = (ranks.agg(F.sum("n")).first()[0] or 0) / max(1, len(cols))
    often: dict[int, dict[float, float]] = {}
    for r in ranks.where(F.col("n") * 100 >= total).collect():
        often.setdefault(r["c"], {})[r["v"]] = r["rank"]
    long = to_rank(base, cols, often).join(ranks.select("c", "v", "rank"), ["c", "v"], "left")
    rank = lambda i: F.max(F.when(F.col("c") == i, F.col("rank")).when(F.col("c") == -1, F.col("known")[i]))
    return long.groupBy("__row").agg(*[rank(i).alias(c) for i, c in enumerate(cols)]).drop("__row")


def corr_matrix(df: DataFrame, cols: list[str], how: str = "pearson") -> DataFrame:
    """a, b, corr of each pair of columns, in one pass."""
    ready = average_ranks(df, cols) if how == "spearman" else df
    pairs = list(combinations(cols, 2))
    sums = ready.agg(*[F.corr(a, b).alias(f"{a}__{b}") for a, b in pairs])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}__{b}").alias("corr")) for a, b in pairs])).alias("x")).select("x.*")


def grid_counts(df: DataFrame, x: str, y: str, nx: int, ny: int) -> DataFrame:
    """ix, iy, n of cells over the ranges of x and y; cells without rows are left out."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ends = one_row(both.agg(*[f(c).cast("double").alias(n) for c, a, b in ((x, "__x0", "__x1"), (y, "__y0", "__y1")) for f, n in ((F.min, a), (F.max, b))]))
    cell = lambda c, a, b, n: F.least(F.floor(F.coalesce(ratio((F.col(c) - F.col(a)) * n, F.col(b) - F.col(a)), F.lit(0.0))), F.lit(n - 1)).cast("int")
    return both.crossJoin(ends).groupBy(cell(x, "__x0", "__x1", nx).alias("ix"), cell(y, "__y0", "__y1", ny).alias("iy")).agg(F.count("*").alias("n"))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, n, row_share, column_share of the pairs that occur."""
    n = df.groupBy(a, b).agg(F.count("*").alias("n"))
    return n.withColumns({"row_share": F.col("n") / F.sum("n").over(Window.partitionBy(a)), "column_share": F.col("n") / F.sum("n").over(Window.partitionBy(b))})


def top_other(df: DataFrame, col: str, n: int) -> DataFrame:
    """label, n of the n commonest values (ties by name) and of all others as `other`."""
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("label")).agg(F.count("*").alias("n"))
    top = counts.orderBy(F.col("n").desc(), "label").limit(n)
    rest = counts.join(F.broadcast(top.select("label")), "label", "left_anti").agg(F.lit("other").alias("label"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return top.unionByName(rest)


def m4(df: DataFrame, ts: str, y: str, key: str, seconds: int, by: list[str]) -> DataFrame:
    """by, bucket, first, last, low, high of y in each bucket of time; ties of time by key."""
    bucket = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("long")
    at = F.struct(ts, key)
    return df.where(F.col(y).isNotNull()).groupBy(*by, bucket.alias("bucket")).agg(F.min_by(y, at).alias("first"), F.max_by(y, at).alias("last"), F.min(y).alias("low"), F.max(y).alias("high"))


def mean_interval(df: DataFrame, y: str, by: list[str], z: float = 1.96) -> DataFrame:
    """by, n, mean, low, high of the normal interval around the mean."""
    half = z * F.stddev_samp(y) / F.sqrt(F.count(y).cast("double"))
    return df.groupBy(*by).agg(F.count(y).alias("n"), F.avg(y).alias("mean"), (F.avg(y) - half).alias("low"), (F.avg(y) + half).alias("high"))
