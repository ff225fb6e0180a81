"""Running sums, places, exact quantiles and bounded windows in the order of any sortable columns, without a task that gets a whole group.

Rows are dealt out by ranges of (group, order) with Spark's range exchange, so one huge group takes many ranges and many
small groups share one. The dealt rows are written once, because each range exchange draws its own borders. What each
range adds to a group is carried to the group's later ranges as one row, which the window of a range begins with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.sources.shared import written

#: Rows of a block of blocked(), at least. A group of no more rows is a single block.
BLOCK = 100_000


def listed(order: str | list[str]) -> list[str]:
    return [order] if isinstance(order, str) else list(order)


def running(df: DataFrame, order: str | list[str], sums: list[str], by: list[str] = (), descending: bool = False, totals: bool = False) -> DataFrame:
    """Adds <c>_run for each column of sums: its sum up to and with the row, within by (null is a group like any other).

    Rows that are equal in all of by and order come in any order. totals: adds <c>_all, the sum over the whole group.
    """
    direction = lambda c: F.col(c).desc() if descending else F.col(c).asc()
    keys = [direction(c) for c in listed(order)]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = written(df.repartitionByRange(parts, *[F.col(c) for c in by], *keys).withColumn("__part", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    per = placed.groupBy(*by, "__part").agg(*[F.sum(c).alias(f"__{c}") for c in sums])  # a row per range and group there
    carried = per.select(*by, "__part", *[F.sum(f"__{c}").over(before).alias(c) for c in sums], *[F.sum(f"__{c}").over(Window.partitionBy(*by)).alias(f"{c}_all") for c in sums if totals], F.lit(True).alias("__carried"))
    if not totals:
        carried = carried.where(F.coalesce(*sums).isNotNull())
    both = placed.withColumn("__carried", F.lit(False)).unionByName(carried, allowMissingColumns=True)
    inside = Window.partitionBy(*by, "__part")
    upto = inside.orderBy(F.col("__carried").desc(), *keys).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumns({f"{c}_run": F.sum(c).over(upto) for c in sums} | ({f"{c}_all": F.max(f"{c}_all").over(inside) for c in sums} if totals else {}))
    return out.where(~F.col("__carried")).drop("__part", "__carried")


def positions(df: DataFrame, order: str | list[str], by: list[str] = (), name: str = "__pos") -> DataFrame:
    """Adds the place of each row in its group, from 0 on."""
    return running(df.withColumn("__one", F.lit(1).cast("long")), order, ["__one"], by).withColumn(name, F.col("__one_run") - 1).drop("__one", "__one_run")


def quantiles(df: DataFrame, col: str, shares: list[float], by: list[str] = ()) -> DataFrame:
    """by, q: the exact quantiles (linear between neighbours, as percentile gives them), from counts at distinct values."""
    counts = df.where(F.col(col).isNotNull()).groupBy(*by, F.col(col).alias("__v")).agg(F.count("*").alias("__n"))
    return quantiles_of_counts(counts, "__v", "__n", shares, by)


def quantiles_of_counts(counts: DataFrame, value: str | list[str], n: str, shares: list[float], by: list[str] = ()) -> DataFrame:
    """The same from counts n at distinct values. value: the column, or it and what tells equal ones apart."""
    run = running(counts, value, [n], by, totals=True)
    size, upto, v = F.col(f"{n}_all"), F.col(f"{n}_run"), F.col(listed(value)[0]).cast("double")
    at = lambda p, up: (F.ceil if up else F.floor)(F.lit(p) * (size - 1))
    holds = lambda p, up: (upto > at(p, up)) & (upto - F.col(n) <= at(p, up))
    wanted = [holds(p, up) for p in shares for up in (False, True)]
    some = wanted[0]
    for w in wanted[1:]:
        some |= w
    found = lambda p, up: F.max(F.when(holds(p, up), v))
    share = lambda p: F.lit(p) * (F.max(size) - 1) - F.floor(F.lit(p) * (F.max(size) - 1))
    return run.where(some).groupBy(*by).agg(F.array(*[found(p, False) + (found(p, True) - found(p, False)) * share(p) for p in shares]).alias("q"))


def blocked(df: DataFrame, order: str | list[str], n: int, by: list[str] = (), size: int = BLOCK) -> tuple[DataFrame, list[str], Column]:
    """df for windows over a row and the n rows before it: (rows, partition columns, whether a row is its own block's).

    A group of more than `size` rows is cut into blocks of its order, each of which begins with the last n rows of the
    one before, so a window within blocks sees what one over the group does. Rows that a block only borrows are to be
    left out afterwards. A table of short groups stays as it is.
    """
    own = F.coalesce(~F.col("__borrowed"), F.lit(False))
    longest = df.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if longest <= size:
        return df.withColumns({"__block": F.lit(0).cast("long"), "__borrowed": F.lit(False)}), [*by, "__block"], own
    size = max(size, n)
    placed = positions(df, order, by).withColumn("__block", F.floor(F.col("__pos") / size))
    lent = F.col("__pos") % size >= size - n
    copies = F.when(lent, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    both = placed.withColumn("__borrowed", F.explode(copies)).withColumn("__block", F.col("__block") + F.col("__borrowed").cast("long"))
    return both.drop("__pos"), [*by, "__block"], own


def back(df: DataFrame, own: Column) -> DataFrame:
    """The rows of blocked() after the windows, each once, without its columns."""
    return df.where(own).drop("__block", "__borrowed")
