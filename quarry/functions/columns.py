"""Column expressions that several operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_number(key: str | Column, salt: str = "") -> Column:
    """First 8 hex digits of the md5 of the key as text, as a number below 2^32."""
    return F.conv(F.substring(F.md5(F.concat(col(key).cast("string"), F.lit(salt))), 1, 8), 16, 10).cast("long")


def uniform(key: str | Column, salt: str) -> Column:
    """A number in [0, 1) that the key and the salt fix."""
    return hash_number(key, salt) / F.lit(4294967296.0)


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0 or null."""
    return a / F.nullif(b.cast("double"), F.lit(0.0))


def money(c: str | Column) -> Column:
    """A double as an exact decimal, so that sums don't depend on the order of rows."""
    return col(c).cast("decimal(18,2)")


def rounded(df: DataFrame, places: int = 4) -> DataFrame:
    """Doubles rounded, as two engines sum them in different orders; minus zero as zero."""
    return df.select(*[(F.round(F.col(f"`{c}`"), places) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def with_stats(df: DataFrame, stats: DataFrame, by: list[str], how: str = "left") -> DataFrame:
    """df with its group's row of stats; a null key is a group like any other. Spark plans the join by the size of stats."""
    if not by:
        return df.crossJoin(one_row(stats))
    own = stats.withColumnsRenamed({c: f"__on_{c}" for c in by})
    return df.join(own, all_of([df[c].eqNullSafe(own[f"__on_{c}"]) for c in by]), how).drop(*[f"__on_{c}" for c in by])


def one_row(df: DataFrame) -> DataFrame:
    """Marks a table of statistics, which has one row, for broadcast."""
    return F.broadcast(df)
