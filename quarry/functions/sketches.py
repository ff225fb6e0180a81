"""What mergeable sketches of values tell. A sketch is a few kilobytes, however many rows it is of, so its answers are read on the driver."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def rank_error(k: int) -> float:
    """The rank error, as a share of the rows, that a KLL sketch of size k keeps within with 99 % confidence (the fitted formula of its public documentation)."""
    return 2.296 / k**0.9021


def asked(spark: SparkSession, sketch: bytes, answer) -> list[float]:
    return spark.createDataFrame([(bytearray(sketch),)], "s binary").select(answer(F.col("s"))).first()[0]


def quantiles_of(spark: SparkSession, sketch: bytes, shares: list[float]) -> list[float]:
    """The values at these shares of the rows."""
    return asked(spark, sketch, lambda s: F.kll_sketch_get_quantile_double(s, F.lit(shares)))


def ranks_of(spark: SparkSession, sketch: bytes, values: list[float]) -> list[float]:
    """The shares of rows at or below these values."""
    return asked(spark, sketch, lambda s: F.kll_sketch_get_rank_double(s, F.lit(values)))
