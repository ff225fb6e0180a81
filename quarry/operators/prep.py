"""Preparation that learns its statistics from training rows alone, and checks of splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.columns import hash_number, one_row, ratio, with_stats
from quarry.functions.ordered import quantiles


def impute(train: DataFrame, df: DataFrame, cols: list[str], how: str) -> DataFrame:
    """df with nulls of cols as the training mean, median or mode (the smaller of ties), and <col>_was_missing."""
    if how == "median":
        stats = reduce(lambda a, b: a.crossJoin(one_row(b)), [quantiles(train, c, [0.5]).select(F.col("q")[0].alias(f"{c}__fill")) for c in cols])
    else:
        made = {"mean": F.avg, "mode": lambda c: F.mode(c, deterministic=True)}[how]
        stats = train.agg(*[made(c).alias(f"{c}__fill") for c in cols])
    out = df.crossJoin(one_row(stats)).withColumns({f"{c}_was_missing": F.col(c).isNull() for c in cols})
    return out.withColumns({c: F.coalesce(c, f"{c}__fill") for c in cols}).drop(*[f"{c}__fill" for c in cols])


def winsorize(train: DataFrame, df: DataFrame, cols: list[str], low: float, high: float) -> DataFrame:
    """df with cols kept within training percentiles; nulls stay."""
    out = df
    for c in cols:
        out = out.crossJoin(one_row(quantiles(train, c, [low, high]).select(F.col("q")[0].alias(f"{c}__a"), F.col("q")[1].alias(f"{c}__b"))))
    value = lambda c: F.when(F.col(c).isNotNull(), F.greatest(F.least(F.col(c), F.col(f"{c}__b")), F.col(f"{c}__a")))
    return out.withColumns({c: value(c) for c in cols}).drop(*[f"{c}__{n}" for c in cols for n in "ab"])


def bucketize(train: DataFrame, df: DataFrame, col: str, n: int, how: str = "width") -> DataFrame:
    """Adds bucket, 0 to n-1, of equal width over the training range (outside values in the end buckets) or equal training count."""
    if how == "count":
        cuts = one_row(quantiles(train, col, [k / n for k in range(1, n)]).withColumnRenamed("q", "__c"))
        place = reduce(lambda a, b: a + b, [(F.col("__c")[k] < F.col(col)).cast("int") for k in range(n - 1)], F.lit(0))
        return df.crossJoin(cuts).withColumn("bucket", place).drop("__c")
    ends = one_row(train.agg(F.min(col).cast("double").alias("__a"), F.max(col).cast("double").alias("__b")))
    place = F.floor(F.coalesce(ratio((F.col(col) - F.col("__a")) * n, F.col("__b") - F.col("__a")), F.lit(0.0))).cast("int")
    return df.crossJoin(ends).withColumn("bucket", F.when(F.col(col).isNotNull(), F.greatest(F.lit(0), F.least(F.lit(n - 1), place)))).drop("__a", "__b")


def one_hot(train: DataFrame, df: DataFrame, col: str, top: int) -> DataFrame:
    """Adds a 0/1 column for each of the commonest training levels (ties by name) and <col>_other. Names that would clash get numbers."""
    levels = [r[0] for r in train.where(F.col(col).isNotNull()).groupBy(col).count().orderBy(F.col("count").desc(), col).limit(top).collect()]
    taken, known = {c.lower() for c in [*df.columns, f"{col}_other"]}, {}
    for v in levels:
        plain = name = f"{col}_{''.join(ch if ch.isalnum() else '_' for ch in str(v))}"
        n = 1
        while name.lower() in taken:  # levels that differ only in signs get numbers
            n += 1
            name = f"{plain}_{n}"
        taken.add(name.lower())
        known[name] = F.coalesce(F.col(col) == v, F.lit(False)).cast("int")
    return df.withColumns(known | {f"{col}_other": (~F.coalesce(F.col(col).isin(levels), F.lit(False))).cast("int")})


def target_encode(df: DataFrame, col: str, y: str, fold: str, smoothing: float = 10.0) -> DataFrame:
    """Adds encoded: the level's mean of y over the other folds, drawn to their overall mean by `smoothing` rows. A null level or fold is one like any other."""
    cells = df.groupBy(col, fold).agg(F.sum(F.col(y).cast("double")).alias("__s"), F.count(y).alias("__n"))
    sums = lambda by, name: cells.groupBy(*by).agg(F.coalesce(F.sum("__s"), F.lit(0.0)).alias(f"__s_{name}"), F.sum("__n").alias(f"__n_{name}"))
    rest = with_stats(with_stats(with_stats(cells, sums([col], "level"), [col]), sums([fold], "fold"), [fold]), sums([], "all"), [])
    own = F.coalesce("__s", F.lit(0.0))
    overall = ratio(F.col("__s_all") - F.col("__s_fold"), F.col("__n_all") - F.col("__n_fold"))
    encoded = ratio(F.col("__s_level") - own + smoothing * overall, F.col("__n_level") - F.col("__n") + smoothing)
    return with_stats(df, rest.select(col, fold, encoded.alias("encoded")), [col, fold])


def stratified_split(df: DataFrame, key: str, y: str, share: float, slices: int = 64) -> DataFrame:
    """Adds is_test: the first ceil(share n) rows of each class in the order of the md5 of the key.

    A class is cut into slices of that order first, so that no task sorts a whole class.
    """
    h = F.md5(F.col(key).cast("string"))
    at = df.withColumn("__h", h).withColumn("__s", (hash_number(key) * slices / 4294967296).cast("int"))
    sizes = at.groupBy(y, "__s").agg(F.count("*").alias("__n"))
    w = Window.partitionBy(y).orderBy("__s")
    sizes = sizes.select(y, "__s", (F.sum("__n").over(w) - F.col("__n")).alias("__before"), F.sum("__n").over(Window.partitionBy(y)).alias("__all"))
    placed = at.join(sizes, at[y].eqNullSafe(sizes[y]) & (at["__s"] == sizes["__s"])).drop(sizes[y]).drop(sizes["__s"])
    place = F.row_number().over(Window.partitionBy(y, "__s").orderBy("__h", key)) + F.col("__before")
    return placed.withColumn("is_test", place <= F.ceil(F.col("__all") * share)).drop("__h", "__s", "__before", "__all")


def leakage(train: DataFrame, test: DataFrame, key: str, cols: list[str], ts: str | None = None) -> DataFrame:
    """n_keys and n_contents of the test rows that the training rows have too; n_early: test rows not after the last training time."""
    text = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]), 256).alias("h")
    keys = test.select(key).join(train.select(key).distinct(), key, "left_semi").agg(F.count("*").alias("n_keys"))
    contents = test.select(text).join(train.select(text).distinct(), "h", "left_semi").agg(F.count("*").alias("n_contents"))
    out = keys.crossJoin(contents)
    if ts is None:
        return out
    last = one_row(train.agg(F.max(ts).alias("__last")))
    return out.crossJoin(test.crossJoin(last).agg(F.count_if(F.col(ts) <= F.col("__last")).alias("n_early")))


def planted_nulls(df: DataFrame, col: str, when: Column) -> DataFrame:
    return df.withColumn(col, F.when(~when, F.col(col)))
