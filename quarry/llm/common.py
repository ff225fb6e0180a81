"""What the training-data operators share: numbers of rows, filters by them, document columns."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.shared import drop_path, new_path, released, shared_folder, written  # noqa: F401  (the operators take them from here)

#: Characters of `[\x20\x09-\x0D]`, the white space of the contracts.
SPACES = " \t\n\x0b\x0c\r"


#: Numbers of so many rows are sent to all tasks (8 bytes each); those of more are joined by shuffling.
SENT_ROWS = 500_000


#: A row's number has so many bits for its place in its file; the rest tells the file.
PLACE_BITS = 28
#: What a table may consist of to be read again with the same rows: files, columns, filters.
STEADY = {"LogicalRelation", "Project", "Filter"}


def steady(docs: DataFrame, name: str = "rows") -> DataFrame:
    """docs if it is read from Parquet files as it stands, so that each row has a file and a place in it; else a written copy."""
    todo = [docs._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() not in STEADY or not node.deterministic():
            return written(docs, name)
        todo += [node.children().apply(i) for i in range(node.children().size())]
    try:
        docs.metadataColumn("_metadata").getField("row_index")
        docs.select(docs.metadataColumn("_metadata").getField("row_index"))
    except AnalysisException:  # files of another format
        return written(docs, name)
    return docs


def file_seed(docs: DataFrame) -> int:
    """The first seed by which the hashes of the table's files differ."""
    files = sorted({re.sub("^file:/+", "file:/", f) for f in docs.inputFiles()})
    if not files:
        return 0
    names = docs.sparkSession.createDataFrame([(f,) for f in files], "file string")
    for seed in range(64):
        if names.select(F.count_distinct(file_hash(F.col("file"), seed))).first()[0] == len(files):
            return seed
    raise ValueError(f"{len(files)} files are too many to tell apart")


def file_hash(path: Column, seed: int) -> Column:
    return F.xxhash64(path, F.lit(seed)).bitwiseAND(F.lit(2 ** (63 - PLACE_BITS) - 1))


def row_number(docs: DataFrame) -> Column:
    """A number for each row of a table that steady() gave, from its file and its place there.

    It is the same in every query, however the scan is split, so executors and cores may come and go between two reads.
    """
    known = docs.metadataColumn("_metadata")
    place = known.getField("row_index")
    checked = F.when(place < 2**PLACE_BITS, place).otherwise(F.raise_error(F.lit("a file of too many rows")).cast("long"))
    return F.shiftleft(file_hash(known.getField("file_path"), file_seed(docs)), PLACE_BITS).bitwiseOR(checked)


def without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs (which steady() gave) without the rows whose numbers are in gone, a table of one column `row`. All columns stay as they are."""
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("own"), row_number(docs).alias("row"))
    gone = written(gone.select("row"), "gone")
    few = gone.count() <= SENT_ROWS
    return keyed.join(F.broadcast(gone) if few else gone, "row", "left_anti").select("own.*")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text alone (and other named columns), null texts as empty ones."""
    return docs.select("doc_id", F.coalesce(docs["text"], F.lit("")).alias("text"), *more)


def bucket_count(spark: SparkSession, rows: int, each: int) -> int:
    """How many hash buckets hold `rows` rows with about `each` rows in one."""
    return max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))
