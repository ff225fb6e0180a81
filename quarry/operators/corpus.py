"""Word and n-gram counts of texts, and a smoothed bigram model with its perplexity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.sources.shared import written


def words(text: str):
    """Maximal runs of letters, lower-cased."""
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"\p{L}+"), F.lit(0))


def vocabulary(df: DataFrame, text: str, minimum: int = 1) -> DataFrame:
    """word, n of words that occur at least `minimum` times."""
    return df.select(F.explode(words(text)).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= minimum)


def gram_rows(df: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """key, w0, w1, ... of each n-gram, repeats included."""
    w = df.select(key, words(text).alias("w"))
    each = w.select(key, "w", F.posexplode("w").alias("__at", "w0")).where(F.col("__at") <= F.size("w") - n)
    return each.select(key, "w0", *[F.get("w", F.col("__at") + i).alias(f"w{i}") for i in range(1, n)])


def ngrams(df: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """w0, w1, ..., n of each n-gram within a document."""
    cols = [f"w{i}" for i in range(n)]
    return gram_rows(df, key, text, n).groupBy(*cols).agg(F.count("*").alias("n"))


def bigram_model(df: DataFrame, key: str, text: str, k: float) -> tuple[DataFrame, DataFrame, int]:
    """The model: bigram counts (w0, w1, n), counts of first words (w0, n0), and the number of words with one for unseen ones.

    Texts are read once: each word is counted with the next one (null after the last), and these counts are written.
    """
    w = df.select(words(text).alias("w")).select("w", F.posexplode("w").alias("__at", "w0")).select("w0", F.get("w", F.col("__at") + 1).alias("w1"))
    counts = written(w.groupBy("w0", "w1").agg(F.count("*").alias("n")), "bigrams")
    each = written(counts.groupBy("w0").agg(F.sum(F.when(F.col("w1").isNotNull(), F.col("n"))).alias("n0")), "first-words")
    return counts.where("w1 IS NOT NULL"), each.where("n0 IS NOT NULL"), each.count() + 1


def probabilities(model: tuple[DataFrame, DataFrame, int], k: float) -> DataFrame:
    """w0, w1, p with k added to each count."""
    pairs, first, v = model
    return pairs.join(first, "w0").select("w0", "w1", ((F.col("n") + k) / (F.col("n0") + k * v)).alias("p"))


def perplexity(df: DataFrame, key: str, text: str, model: tuple[DataFrame, DataFrame, int], k: float) -> DataFrame:
    """key, n_bigrams, perplexity of each document with a bigram; words that the model lacks share one token."""
    pairs, first, v = model
    p = (F.coalesce("n", F.lit(0)) + k) / (F.coalesce("n0", F.lit(0)) + k * v)
    seen = gram_rows(df, key, text, 2).join(first, "w0", "left").select(key, "w0", "w1", "n0")
    scored = seen.join(pairs, ["w0", "w1"], "left").withColumn("ln", F.ln(p))
    return scored.groupBy(key).agg(F.count("*").alias("n_bigrams"), F.exp(-F.avg("ln")).alias("perplexity"))
