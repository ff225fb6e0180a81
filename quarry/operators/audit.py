"""Data-quality checks, drift, personal data, reconciliation. A check is (check, column, n_rows, n_bad, pass)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.columns import all_of, one_row, ratio
from quarry.functions.ordered import BLOCK, back, blocked, quantiles_of_counts, running
from quarry.functions.sketches import quantiles_of, rank_error, ranks_of

CHECK = ("check_name", "column_name", "n_rows", "n_bad", "pass")


def checked(df: DataFrame, rules: list[tuple[str, str, Column]], most: float = 0.0) -> DataFrame:
    """One check per (name, column, good): rows where good isn't true are bad; it passes with a share of at most `most`. One pass."""
    sums = df.agg(F.count("*").alias("n"), *[F.count_if(~F.coalesce(good, F.lit(False))).alias(f"b{i}") for i, (_, _, good) in enumerate(rules)])
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("check_name"), F.lit(c).alias("column_name"), F.col("n").alias("n_rows"), F.col(f"b{i}").alias("n_bad"), (F.col(f"b{i}") <= F.col("n") * most).alias("pass")) for i, (name, c, _) in enumerate(rules)]))
    return sums.select(each.alias("x")).select("x.*")


def profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """column_name, n, n_null, n_distinct, low, high, mean, deviation, q1, median, q3, kurtosis of each number column.

    Moments take one pass. Exact numbers of distinct values and quartiles come from the counts at distinct values of
    each column; without exact, from sketches in the same pass.
    """
    cols = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    made = {"n": lambda c: F.count("*"), "n_null": lambda c: F.count_if(F.col(c).isNull()), "low": lambda c: F.min(c).cast("double"), "high": lambda c: F.max(c).cast("double"), "mean": F.avg, "deviation": F.stddev_samp, "kurtosis": F.kurtosis}
    if not exact:
        made |= {"n_distinct": F.approx_count_distinct, **{n: lambda c, p=p: F.percentile_approx(c, p).cast("double") for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))}}
    sums = df.agg(*[f(c).alias(f"{c}__{n}") for c in cols for n, f in made.items()])
    out = sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), *[F.col(f"{c}__{n}").alias(n) for n in made]) for c in cols])).alias("x")).select("x.*")
    if not exact:
        return out
    # values are told apart as text, which is exact for all of a long or decimal, and put in order as doubles
    exactly = lambda c: F.when(F.col(c).isNotNull(), (F.col(c) + F.lit(0.0) if isinstance(df.schema[c].dataType, T.FractionalType) and not isinstance(df.schema[c].dataType, T.DecimalType) else F.col(c)).cast("string"))
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v"), exactly(c).alias("x")) for c in cols])).alias("x")).select("x.*").where("v IS NOT NULL")
    counts = long.groupBy("column_name", "v", "x").agg(F.count("*").alias("__n"))
    distinct = counts.groupBy("column_name").agg(F.count("*").alias("n_distinct"))
    cuts = quantiles_of_counts(counts, ["v", "x"], "__n", [0.25, 0.5, 0.75], ["column_name"])
    return out.join(distinct, "column_name", "left").join(cuts, "column_name", "left").select("column_name", "n", "n_null", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"), "low", "high", "mean", "deviation", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "kurtosis")


def completeness(df: DataFrame, cols: list[str], least: float = 1.0) -> DataFrame:
    return checked(df, [("completeness", c, F.col(c).isNotNull()) for c in cols], 1 - least)


def uniqueness(df: DataFrame, key: list[str]) -> DataFrame:
    """n_rows, n_groups (keys with more than one row), n_extra (rows beyond the first of a key), pass."""
    counts = df.groupBy(*key).agg(F.count("*").alias("n"))
    return counts.agg(F.sum("n").alias("n_rows"), F.count_if(F.col("n") > 1).alias("n_groups"), F.sum(F.col("n") - 1).alias("n_extra")).withColumn("pass", F.col("n_extra") == 0)


def in_domain(df: DataFrame, col: str, values: list) -> DataFrame:
    return checked(df, [("domain", col, F.col(col).isin(values))])


def in_range(df: DataFrame, col: str, low: float, high: float) -> DataFrame:
    return checked(df, [("range", col, F.col(col).between(low, high))])


def matches(df: DataFrame, col: str, regex: str) -> DataFrame:
    return checked(df, [("pattern", col, F.col(col).rlike(regex))])


def foreign_key(child: DataFrame, parent: DataFrame, on: tuple[str, str]) -> DataFrame:
    """n_orphans (child rows whose key, if any, the parent lacks) and n_childless (parent keys without a row)."""
    c, p = child.select(F.col(on[0]).alias("k")).where("k IS NOT NULL"), parent.select(F.col(on[1]).alias("k")).where("k IS NOT NULL").distinct()
    orphans = c.join(p, "k", "left_anti").agg(F.count("*").alias("n_orphans"))
    return orphans.crossJoin(p.join(c, "k", "left_anti").agg(F.count("*").alias("n_childless")))


def row_rule(df: DataFrame, name: str, predicate: Column) -> DataFrame:
    return checked(df, [(name, "*", predicate)])


def functional_dependency(df: DataFrame, a: str, b: str) -> DataFrame:
    """n_values of a, n_bad with more than one value of b, pass."""
    per = df.groupBy(a).agg(F.count_distinct(b).alias("n"))
    return per.agg(F.count("*").alias("n_values"), F.count_if(F.col("n") > 1).alias("n_bad")).withColumn("pass", F.col("n_bad") == 0)


def schema_check(df: DataFrame, expected: T.StructType) -> DataFrame:
    """column_name, problem (missing, extra, or type) of columns that differ from the contract."""
    have, want = ({f.name: f.dataType.simpleString() for f in s} for s in (df.schema, expected))
    rows = [(c, "missing") for c in want if c not in have] + [(c, "extra") for c in have if c not in want] + [(c, "type") for c in want if c in have and have[c] != want[c]]
    return df.sparkSession.createDataFrame(rows, "column_name string, problem string")


def schema_fit(df: DataFrame, expected: T.StructType) -> DataFrame:
    """schema_check with n_rows, and n_unfit: rows whose value changes or fails when read as the contract's type (all rows of a missing column)."""
    bad = []
    for r in schema_check(df, expected).collect():  # a row per differing column
        c, problem = r["column_name"], r["problem"]
        kept = F.col(c).isNull() | F.col(c).try_cast(expected[c].dataType).try_cast(df.schema[c].dataType).eqNullSafe(F.col(c)) if problem == "type" else F.lit(problem == "extra")
        bad.append((c, problem, kept))
    sums = df.agg(F.count("*").alias("n"), *[F.count_if(~kept).alias(f"b{i}") for i, (_, _, kept) in enumerate(bad)])
    each = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(problem).alias("problem"), F.col("n").alias("n_rows"), F.col(f"b{i}").alias("n_unfit")) for i, (c, problem, _) in enumerate(bad)])
    none = "array<struct<column_name:string,problem:string,n_rows:bigint,n_unfit:bigint>>"
    return sums.select(F.explode(each if bad else F.array().cast(none)).alias("x")).select("x.*")


def freshness(df: DataFrame, ts: str, by: list[str], asof: str, block: int = BLOCK) -> DataFrame:
    """by, age_seconds of the latest row at asof, longest_gap_seconds between neighbours. Long groups are cut into blocks."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    rows, keys, own = blocked(df.select(*by, ts).where(F.col(ts).isNotNull()), ts, 1, by, block)
    gap = micros(F.col(ts)) - micros(F.lag(ts).over(Window.partitionBy(*keys).orderBy(ts)))
    age = micros(F.lit(asof)) - micros(F.max(ts))
    return back(rows.withColumn("__g", gap), own).groupBy(*by).agg((age / 1e6).alias("age_seconds"), (F.max("__g") / 1e6).alias("longest_gap_seconds"))


def counted(base: DataFrame, cur: DataFrame, value: Column) -> DataFrame:
    """v, n_base, n_cur of each value that either table has."""
    both = base.select(value.alias("v"), F.lit(1).alias("b")).unionByName(cur.select(value.alias("v"), F.lit(0).alias("b")))
    return both.where("v IS NOT NULL").groupBy("v").agg(F.sum("b").alias("n_base"), F.sum(1 - F.col("b")).alias("n_cur"))


def psi(base: DataFrame, cur: DataFrame, col: str, bins: list[float]) -> DataFrame:
    """Population stability index over fixed bins (cuts), with 0.5 added to each count."""
    place = reduce(lambda a, b: a + b, [(F.col(col) >= x).cast("int") for x in bins], F.lit(0))
    n = len(bins) + 1
    grid = one_row(base.sparkSession.range(n).select(F.col("id").cast("int").alias("v")))
    counts = grid.join(counted(base, cur, F.when(F.col(col).isNotNull(), place)), "v", "left").fillna(0)
    w = Window.partitionBy()
    p, q = ((F.col(c) + 0.5) / (F.sum(c).over(w) + 0.5 * n) for c in ("n_base", "n_cur"))
    return counts.select(p.alias("p"), q.alias("q")).agg(F.sum((F.col("q") - F.col("p")) * F.ln(F.col("q") / F.col("p"))).alias("psi"))


def ks(base: DataFrame, cur: DataFrame, col: str) -> DataFrame:
    """Largest distance of the two distributions, from the counts at distinct values of any sortable type."""
    run = running(counted(base, cur, F.col(col)), "v", ["n_base", "n_cur"], totals=True)
    return run.agg(F.max(F.abs(ratio(F.col("n_base_run"), F.col("n_base_all")) - ratio(F.col("n_cur_run"), F.col("n_cur_all")))).alias("ks"))


def ks_sketched(base: DataFrame, cur: DataFrame, col: str, k: int = 4000, points: int = 500) -> DataFrame:
    """ks, error: the same from one KLL sketch per table, in one pass over each and without a shuffle of values.

    Distances are taken at `points` evenly spaced quantiles of each table; error is the bound by both sketches'
    rank_error and the step between two quantiles.
    """
    session, value = base.sparkSession, F.col(col).cast("double")
    a, b = (df.agg(F.count(value), F.kll_sketch_agg_double(value, F.lit(k))).first() for df in (base, cur))
    found = None
    if a[0] and b[0]:
        shares = [i / points for i in range(points + 1)]
        values = quantiles_of(session, a[1], shares) + quantiles_of(session, b[1], shares)
        found = max(abs(x - y) for x, y in zip(ranks_of(session, a[1], values), ranks_of(session, b[1], values), strict=True))
    return session.createDataFrame([(found, 2 * rank_error(k) + 1.0 / points)], "ks double, error double")


def chi_square(base: DataFrame, cur: DataFrame, col: str) -> DataFrame:
    """statistic and degrees of freedom of the two-row table of counts."""
    counts = counted(base, cur, F.col(col))
    total = one_row(counts.agg(F.sum("n_base").alias("tb"), F.sum("n_cur").alias("tc")))
    n = F.col("n_base") + F.col("n_cur")
    part = lambda c, t: F.pow(F.col(c) - n * F.col(t) / (F.col("tb") + F.col("tc")), F.lit(2.0)) / F.nullif(n * F.col(t) / (F.col("tb") + F.col("tc")), F.lit(0.0))
    return counts.crossJoin(total).agg(F.sum(part("n_base", "tb") + part("n_cur", "tc")).alias("statistic"), (F.count("*") - 1).alias("degrees"))


def duplicate_content(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """content_hash, n, first_key of contents that more than one row has."""
    text = F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}) if len(cols) > 1 else F.coalesce(F.col(cols[0]).cast("string"), F.lit(""))
    return df.groupBy(F.sha2(text, 256).alias("content_hash")).agg(F.count("*").alias("n"), F.min(key).alias("first_key")).where("n > 1")


def pii_scan(df: DataFrame, col: str, patterns: dict[str, str]) -> DataFrame:
    """kind, n_rows with a hit, n_hits. All patterns in one pass."""
    hits = df.select(*[F.regexp_count(col, F.lit(p)).alias(k) for k, p in patterns.items()])
    sums = hits.agg(*[x.alias(f"{k}__{n}") for k in patterns for n, x in (("rows", F.count_if(F.col(k) > 0)), ("hits", F.coalesce(F.sum(k), F.lit(0)).cast("long")))])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}__rows").alias("n_rows"), F.col(f"{k}__hits").alias("n_hits")) for k in patterns])).alias("x")).select("x.*")


def mask(df: DataFrame, col: str, patterns: dict[str, str], salt: str | None = None) -> DataFrame:
    """col with each hit as <kind>, or with a salt the whole column as a hash."""
    if salt is not None:
        return df.withColumn(col, F.sha2(F.concat(F.lit(salt), F.col(col).cast("string")), 256))
    return df.withColumn(col, reduce(lambda c, p: F.regexp_replace(c, p[1], f"<{p[0]}>"), patterns.items(), F.col(col)))


def reconcile(a: DataFrame, b: DataFrame, key: list[str], cols: list[str]) -> DataFrame:
    """status (only_left, only_right, differing, equal) and n of keys in two tables; nulls equal nulls."""
    left = a.select(*key, F.struct(*cols).alias("__a"), F.lit(True).alias("__in_a"))
    right = b.select(*key, F.struct(*cols).alias("__b"), F.lit(True).alias("__in_b"))
    status = F.when(F.col("__in_b").isNull(), "only_left").when(F.col("__in_a").isNull(), "only_right").when(all_of([F.col(f"__a.{c}").eqNullSafe(F.col(f"__b.{c}")) for c in cols]), "equal").otherwise("differing")
    return left.join(right, key, "full").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def scorecard(tables: list[tuple[DataFrame, list[tuple[str, str, Column, float]]]]) -> DataFrame:
    """Checks (name, column, good, weight) of many tables, one pass over each, with weight and the weighted share that passes."""
    parts = []
    for df, rules in tables:
        weight = F.create_map(*[F.lit(x) for name, c, _, w in rules for x in (f"{name}:{c}", float(w))])
        parts.append(checked(df, [r[:3] for r in rules]).withColumn("weight", weight[F.concat_ws(":", "check_name", "column_name")]))
    every = reduce(DataFrame.unionByName, parts)
    w = Window.partitionBy()
    return every.withColumn("pass_rate", ratio(F.sum(F.when(F.col("pass"), F.col("weight")).otherwise(0.0)).over(w), F.sum("weight").over(w)))
