"""Training-data pipeline over documents: each stage reads all that the one before kept, written as Parquet.

Defined results for all stages: null texts count as empty; texts of any length are read whole; rows without doc_id and
rows that repeat one are judged each on its own; an empty table gives an empty result; further columns go through as
they are, with any names, up to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quarry.llm import bpe, decontamination, exact_dedup, near_copies, simhash, toxicity
from quarry.llm.common import new_path, written
from quarry.sources.shared import released, remove

#: Of the stages, the model of toxicity and XXH64 can't be expressed in SQL.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that aren't predicted toxic. Null and empty texts stay; repeated rows are judged alike."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: most code points, then smallest doc_id; of ties and repeated rows one stays."""
    return exact_dedup.without_copies(docs, exact_dedup.middle_id(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates. Null and empty texts are copies of each other; of repeated rows one stays.

    First SimHash: fingerprints of 5-word shingles that differ in at most 2 bits. What that leaves is compared by the
    exact Jaccard similarity of the same shingles, 0.8 or more, since 64 bits can't tell such pairs from strangers.
    """
    return near_copies.one_of_each(written(simhash.one_of_each(docs, near_copies.WORDS), "simhash"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a passage of the benchmark. Null and empty texts stay; repeated rows are judged alike."""
    return decontamination.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text, of each row; null and empty texts have no tokens."""
    return bpe.encoded_digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("bpe encoding and decoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir. What a stage wrote besides its rows goes when it is done, and its rows when the next one is."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = new_path(spark, name.replace(" ", "-"))
        with released(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
